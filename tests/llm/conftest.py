"""A small corpus with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import pathlib
import random
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

SLURS = ["stupid", "idiot", "worthless", "trash"]


def _words(rnd, n):
    parts = ["er", "on", "the", "an", "ing", "re", "ti", "ou", "ñ", "st", "ly"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def make_documents(n=90, seed=3):
    rnd = random.Random(seed)
    passage = " ".join(_words(rnd, 60))
    items = [" ".join(_words(rnd, 20)) for _ in range(6)] + ["Two words", "one", "", None]
    docs = []
    for i in range(n):
        w = _words(rnd, rnd.randint(20, 160))
        if i % 9 == 0:
            w[5:5] = passage.split()
        if i % 11 == 0:
            w[3:3] = items[i % 6].upper().split()
        if i % 13 == 0:
            w[2:2] = "All Rights RESERVED. Licensed under CC BY-NC 4.0. GNU General Public License".split()
        if i % 4 == 1:
            w[7:7] = [rnd.choice(SLURS)]
        docs.append((i * 3, "\n".join([" ".join(w[:10]), " ".join(w[10:])])))
    base = docs[10][1].split(" ")
    docs += [(1000 + i, " ".join(base[: len(base) - i])) for i in range(4)]
    docs += [(2000, docs[5][1]), (2001, docs[5][1]), docs[7], docs[7], (docs[8][0], "another text under the same id here now")]
    docs += [(3000, None), (3001, ""), (3002, "  \t\n"), (3003, "three short words"), (3004, "Three  SHORT words"), (None, "a row without an id " * 3), (None, None)]
    docs += [(3005, " ".join(_words(rnd, 30_000))), (3006, "ü, " * 300), (3007, "a\x00b   é <|endoftext|> x  y"), (3008, "the Two words of one")]
    return docs, [(i, t) for i, t in enumerate(items)] + [(0, items[0]), (None, "item without an id")]


def write(folder, docs, items, extra=True):
    n = len(docs)
    columns = {
        "doc_id": pa.array([d for d, _ in docs], pa.int64()),
        "text": pa.array([t for _, t in docs], pa.string()),
        "lang": pa.array(["en" if i % 3 else None for i in range(n)], pa.string()),
        "source": pa.array(["s"] * n, pa.string()),
        "n_chars": pa.array([len(t) if t is not None else None for _, t in docs], pa.int64()),
    }
    if extra:
        columns |= {c: pa.array(["clash"] * n, pa.string()) for c in ("row", "n_words", "kept", "score", "row_key", "marks", "ids", "place", "slot", "trained")}
    pq.write_table(pa.table(columns), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), folder / "benchmark.parquet")
    known = [(d, int(any(s in (t or "") for s in SLURS))) for d, t in docs if d is not None and d % 2 == 0] + [(None, 1), (4, None)] if docs else []
    pq.write_table(
        pa.table({"doc_id": pa.array([d for d, _ in known], pa.int64()), "quality": pa.array([0] * len(known), pa.int32()), "toxic": pa.array([t for _, t in known], pa.int32())}),
        folder / "labels.parquet",
    )
    urls = [None, "", "no scheme", "HTTP://A.Org/x?y", "http://a.example.org/es/1", "http://example.org/en/12#z", "http://b.com", "http://b.com/fr/1", "http://b.com/fr/2"]
    urls += [f"http://c.com/{k}/{i}" for k in ("de", "fr", "en") for i in range(30)] + ["http://c.com/en/1"] * 2
    urls = urls if docs else []
    pq.write_table(pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array([""] * len(urls), pa.string())}), folder / "pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def corpus():
    return make_documents()


@pytest.fixture(scope="session")
def small(tmp_path_factory, corpus):
    return write(tmp_path_factory.mktemp("small"), *corpus)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [])
