"""Settlement pages: cells out of HTML, then typed settles.

Only cell extraction runs in Python, a page at a time inside ``mapInPandas``; what the cells mean is
decided by Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_number, is_bad_number, is_placeholder
from ..operators.validate import header_signature

# The pinned header row, month names in calendar order, and texts of challenge pages.
HEADERS = ["Month", "Open", "High", "Low", "Last", "Change", "Settle", "Est. Volume", "Prior Day OI"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
CHALLENGES = ["cf-please-wait", "Checking if the site connection is secure", "Just a moment...", "_cf_chl_opt", "cf_chl_"]
# Where the table is looked for, first match wins (attribute, value).
TABLE_PLACES = [("id", "settlementsTable"), ("class", "cmeTable"), ("class", "main-table")]

CELLS = "page_id bigint, has_table boolean, has_head boolean, has_body boolean, headers array<string>, cell_rows array<array<string>>, status string, page_text string"


class _Cells(HTMLParser):
    """Collects tables (head cells, body rows), the status span and the page text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.text: list[str] = []
        self.status: str | None = None
        self.in_status = 0
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.mute += 1
        if tag == "span" and (self.in_status or ("status-value" in a.get("class", "").split() and self.status is None)):
            self.in_status += 1
            self.status = self.status or ""
        if tag == "table":
            t = {"id": a.get("id", ""), "class": a.get("class", "").split(), "part": None, "head": None, "rows": None, "cell": None, "row": None}
            self.tables.append(t)
            self.open.append(t)
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("thead", "tbody"):
            t["part"] = tag
            if tag == "thead" and t["head"] is None:
                t["head"] = []
            if tag == "tbody" and t["rows"] is None:
                t["rows"] = []
        elif tag == "tr" and t["part"]:
            t["row"] = []
        elif tag in ("td", "th"):
            t["cell"] = []

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.mute:
            self.mute -= 1
        if tag == "span" and self.in_status:
            self.in_status -= 1
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th") and t["cell"] is not None:
            wanted = "th" if t["part"] == "thead" else "td"
            if t["row"] is not None and tag == wanted:
                t["row"].append("".join(t["cell"]))
            t["cell"] = None
        elif tag == "tr" and t["row"] is not None:
            if t["part"] == "thead":
                if not t["head"]:
                    t["head"] = t["row"]
            elif t["rows"] is not None:
                t["rows"].append(t["row"])
            t["row"] = None
        elif tag in ("thead", "tbody"):
            t["part"] = None
        elif tag == "table":
            self.open.pop()

    def handle_data(self, data):
        piece = data.strip()
        if not piece or self.mute:
            return
        self.text.append(piece)
        if self.in_status:
            self.status = (self.status or "") + piece
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(piece)

    def chosen(self) -> dict | None:
        for attribute, value in TABLE_PLACES:
            for t in self.tables:
                if t["id"] == value if attribute == "id" else value in t["class"]:
                    return t
        return self.tables[0] if self.tables else None


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for page_id, html in zip(pdf["page_id"], pdf["html"]):
            p = _Cells()
            p.feed(html or "")
            p.close()
            t = p.chosen()
            out.append((
                page_id, t is not None, bool(t and t["head"] is not None), bool(t and t["rows"] is not None),
                (t["head"] if t and t["head"] else []), (t["rows"] if t and t["rows"] else []), p.status, " ".join(p.text),
            ))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CELLS.split(", ")])


def is_challenge(html: Column) -> Column:
    hit = F.lit(False)
    for m in CHALLENGES:
        hit = hit | F.contains(html, F.lit(m))
    return hit


def _state(status: Column, text: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    final, prelim = text.rlike(r"\bFinal\b"), text.rlike(r"\bPreliminary\b")
    return (
        F.when(F.contains(s, F.lit("final")), "final").when(F.contains(s, F.lit("preliminary")), "preliminary")
        .when(final & ~prelim, "final").otherwise("preliminary")
    )


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settles, problems) from pages with page_id, root, as_of_date, as_of, html.

    A problem names what is wrong with a page or row: challenge, no table, no head, header drift,
    no body, empty body, cell count, month text, number text. Rows without a settle are dropped.
    """
    p = pages.withColumn("page_sha", F.sha2("html", 256)).withColumn("challenge", is_challenge(F.col("html")))
    blocked = p.filter("challenge").select("page_id", F.lit("challenge").alias("problem"))
    cells = p.filter("NOT challenge").select("page_id", "html").mapInPandas(_extract, CELLS)
    facts = p.select("page_id", "root", "as_of_date", "as_of", "page_sha")
    pinned = header_signature(F.array(*[F.lit(h) for h in HEADERS]))
    page_problem = (
        F.when(~F.col("has_table"), "no table").when(~F.col("has_head"), "no head")
        .when(header_signature(F.col("headers")) != pinned, "header drift")
        .when(~F.col("has_body"), "no body").when(F.size("cell_rows") == 0, "empty body")
    )
    c = cells.withColumn("problem", page_problem)
    rows = c.filter("problem IS NULL").select("page_id", _state(F.col("status"), F.col("page_text")).alias("settle_state"), F.posexplode("cell_rows").alias("row_no", "v"))
    rows = rows.withColumn("width_ok", F.size("v") == len(HEADERS))
    cell = lambda i: F.get(F.col("v"), i)
    parts = F.split(F.upper(F.trim(cell(0))), r"\s+")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, 0))
    month_ok = (F.size(parts) == 2) & (month > 0) & F.get(parts, 1).rlike("^[0-9]{2}$")
    numbers = [(1, "open"), (2, "high"), (3, "low"), (4, "last"), (5, "change"), (6, "settle")]
    whole = [(7, "volume_est"), (8, "oi_prior")]
    bad = F.lit(False)
    for i, _ in numbers:
        bad = bad | is_bad_number(cell(i))
    for i, _ in whole:
        bad = bad | is_bad_number(cell(i), "bigint")
    priced = ~is_placeholder(cell(6))
    row_problem = F.when(~F.col("width_ok"), "cell count").when(~month_ok, "month text").when(is_bad_number(cell(6)) | (priced & bad), "number text")
    rows = rows.withColumn("problem", row_problem)
    good = rows.filter("problem IS NULL").filter(priced).join(facts, "page_id")
    code = F.substring(F.lit("FGHJKMNQUVXZ"), month.cast("int"), F.lit(1))
    contract = F.concat("root", code, F.get(parts, 1))
    settle = clean_number(cell(6))
    filled = {name: F.coalesce(clean_number(cell(i)), settle if name != "change" else F.lit(0).cast("decimal(20,8)")) for i, name in numbers}
    counts = {name: F.coalesce(clean_number(cell(i), "bigint"), F.lit(0).cast("bigint")) for i, name in whole}
    settles = good.select(
        "page_id", contract.alias("contract"), "as_of_date", filled["settle"].alias("settle"), "settle_state",
        *[filled[n].alias(n) for n in ("open", "high", "low", "last", "change")], *[counts[n].alias(n) for n in ("volume_est", "oi_prior")],
        "as_of", F.sha2(F.concat_ws("||", "page_sha", contract), 256).alias("sha"),
    )
    problems = blocked.unionByName(c.filter("problem IS NOT NULL").select("page_id", "problem")).unionByName(
        rows.filter("problem IS NOT NULL").select("page_id", "problem"))
    return settles, problems
