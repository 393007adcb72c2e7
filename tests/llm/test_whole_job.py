"""The whole job where shorter ones would give other results."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import brute
import pytest

from marketframe.llm import katz, url_templates
from marketframe.llm.url_templates import path_templates, template_verdicts
from marketframe.session import work_dir


def plain_katz(docs):
    """Scores of (id, text, trained) by Katz's formulas over all words and pairs of the training texts."""
    words = [brute.SPACED.findall(brute.low(t)) + ["\0end"] for _, t, _ in docs]
    one, two = Counter(), Counter()
    for w, (_, _, trained) in zip(words, docs, strict=True):
        if trained:
            one.update(w)
            two.update(zip(["\0begin", *w], w, strict=False))
    after = Counter()
    for (h, _), n in two.items():
        after[h] += n

    def discount(counts):
        of = [Counter(counts.values())[r] for r in range(7)]
        half = {r: (r - 0.5) / r for r in range(1, 6)}
        if not all(of[1:]):
            return half
        top = 6 * of[6] / of[1]
        d = {r: ((r + 1) * of[r + 1] / of[r] / r - top) / (1 - top) if top < 1 else 0 for r in range(1, 6)}
        return d if all(0 < x < 1 for x in d.values()) else half

    d1, d2, total = discount(one), discount(two), sum(one.values())
    left = sum(n * (1 - d1.get(n, 1)) for n in one.values()) / total

    def low(w):
        return d1.get(one[w], 1) * one[w] / total if one[w] else left

    followers = defaultdict(list)
    for h, w in two:
        followers[h].append(w)
    shrink, weight = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for h, own in followers.items():
        given = sum(d2.get(two[h, w], 1) * two[h, w] / after[h] for w in own)
        if given >= 1 - 1e-12:
            shrink[h] = after[h] / (after[h] + 1)
        weight[h] = (1 - given * shrink[h]) / (1 - sum(low(w) for w in own))

    def p(h, w):
        return d2.get(two[h, w], 1) * two[h, w] / after[h] * shrink[h] if two[h, w] else weight[h] * low(w)

    return {d: sum(math.log10(p(h, x)) for h, x in zip(["\0begin", *w], w, strict=False)) for (d, _, _), w in zip(docs, words, strict=True)}


@pytest.mark.parametrize("blocks", [1, 7])
def test_op5_all_words_are_histories(spark, blocks):
    """Rare words after one another, a hot word, copies, held-out and untrained texts; one block or several."""
    rnd = random.Random(5)
    docs = [(i, " ".join("the" if rnd.random() < 0.2 else f"w{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(0, 60))), i % 5 != 1) for i in range(300)]
    docs += [(1000 + i, "rare pair", True) for i in range(40)] + [(2000, "Rare pair", False), (2001, "never seen", False), (2002, None, None), (2003, "", True)]
    docs += [(3000 + i, "always same", True) for i in range(8)]
    want = plain_katz(docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string, trained boolean").repartition(blocks)
    got = {r.doc_id: r.score for r in katz.katz_scores(rows).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_op5_hot_pair_is_asked_for_once_per_block(spark, monkeypatch):
    """Thousands of copies of a text put no entry per document into a bucket."""
    asked, answers = [], katz._answers

    def watched(rows, answer):
        asked.append(rows.selectExpr("sum(length(keys) / 8)").first()[0])
        return answers(rows, answer)

    monkeypatch.setattr(katz, "_answers", watched)
    docs = spark.range(4000, numPartitions=2).selectExpr("id AS doc_id", "'always same' AS text", "true AS trained")
    assert katz.katz_scores(docs).filter("n_known = 3 AND train_tokens = 12000").count() == 4000
    assert asked == [2 * (3 + 3), 2 * 3]


def test_op4_small_branches_speak_for_themselves_only(spark):
    """One page in a hundred is blocked, at any depth; unlabelled siblings are judged by the host."""
    pages = [("b.com", f"/fr/{i}", False) for i in range(500)] + [("b.com", f"/de/{i}", True) for i in range(10)] + [("b.com", f"/s{i % 70}/{i}", None) for i in range(490)]
    deep = "/1/2/3/4/5/6/7"
    pages += [("d.com", f"{deep}/fr/{i}", False) for i in range(300)] + [("d.com", f"{deep}/de/{i}", True) for i in range(4)]
    # two blocked branches that are alike: they merge, but are few beside what has no labels
    pages += [("e.com", f"/ok/{i}", False) for i in range(500)] + [("e.com", f"/{k}/{i}", True) for k in ("x", "y") for i in range(40)] + [("e.com", f"/t{i % 50}/{i}", None) for i in range(900)]
    pages += [("e.com", f"/p{i}/{i}", False) for i in range(3)]
    rows = spark.createDataFrame(pages, "host string, path string, blocked boolean")
    got = {(r.host, r.path): r.rejected for r in template_verdicts(rows).collect()}
    assert len(got) == len(pages)
    assert [(h, p) for h, p, blocked in pages if got[(h, p)] != bool(blocked)] == []


def plain_templates(paths, z=1.96):
    """Template by (host, path), by a tree that is walked one segment at a time."""
    out, todo = {}, defaultdict(list)
    for host, path, n, labelled, blocked in paths:
        todo[host, ""].append(([p for p in path.split("/") if p], path, n, labelled, blocked))
    while todo:
        (host, template), rows = todo.popitem()
        branches = defaultdict(list)
        for row in rows:
            if row[0]:
                branches[row[0][0]].append(row)
            else:
                out[host, row[1]] = template
        sums = {p: [sum(r[i] for r in b) for i in (2, 3, 4)] for p, b in branches.items()}
        total, bad = (sum(s[i] for s in sums.values()) for i in (1, 2))
        names = {}
        for p, (_, labels, blocked) in sums.items():
            others = total - labels
            if labels and others:
                gap, rate = blocked / labels - (bad - blocked) / others, bad / total
                names[p] = p if abs(gap) > z * math.sqrt(rate * (1 - rate) * (1 / labels + 1 / others)) else None
            else:
                names[p] = p if labels else None
        merged = sum(s[1] for p, s in sums.items() if names[p] is None)
        silent = sum(s[0] for s in sums.values() if s[1] == 0)
        for p, b in branches.items():
            name = names[p] or ("*" if sums[p][1] or not merged or merged >= silent else "?")
            todo[host, f"{template}/{name}"] += [(r[0][1:], *r[1:]) for r in b]
    return out


def test_op4_templates_are_those_of_a_plain_tree(spark):
    rnd = random.Random(4)
    paths = {}
    for _ in range(1500):
        host = rnd.choice(["a.com", "b.org", ""])
        parts = [rnd.choice(["fr", "de", "x", "y", "", *"0123456789"]) for _ in range(rnd.randint(0, 6))]
        labelled = rnd.choice([0, 0, 1, 3])
        blocked = labelled if "de" in parts[:2] else rnd.randint(0, labelled) if rnd.random() < 0.2 else 0
        paths[host, "/" + "/".join(parts)] = (rnd.randint(labelled, 5) or 1, labelled, blocked)
    # one chain of labelled paths, with unlabelled ones that end in it, leave it and go on after it
    for path, labelled in (("/p/q/r/s", 2), ("/p/q/r/t", 2), ("/p/q", 0), ("/p/q/r", 0), ("/p/z/r/s", 0), ("/p/q/r/s/1/2", 0)):
        paths["chain.net", path] = (2, labelled, labelled if path.endswith("t") else 0)
    rows = [(h, p, *v) for (h, p), v in paths.items()]
    df = spark.createDataFrame(rows, "host string, path string, n long, labelled long, blocked long")
    got = [((r.host, r.path), r.template) for r in path_templates(df).collect()]
    assert len(got) == len(rows)
    assert dict(got) == plain_templates(rows)


def test_op4_one_deep_url_decides_no_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(url_templates, "work_dir", lambda *a: made.append(work_dir(*a)) or made[-1])
    deep = "/seg" * 2000
    pages = [("a.com", f"/{k}/{i}", k == "x") for k in "xy" for i in range(20)] + [("a.com", "/x" + deep, True), ("a.com", deep, None), ("b.com", deep, False), (None, None, None)]
    got = {(r.host, r.path): r for r in template_verdicts(spark.createDataFrame(pages, "host string, path string, blocked boolean")).collect()}
    assert len(got) == len(pages) and len(made) <= 7
    assert got["b.com", deep].template == deep and got["", ""].template == ""
    assert got["a.com", "/x/3"].rejected and not got["a.com", "/y/3"].rejected
    empty = spark.createDataFrame([], "host string, path string, blocked boolean")
    assert template_verdicts(empty).count() == 0
