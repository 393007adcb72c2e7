"""Toxicity of whole texts from character n-gram vectors.

A word is the bag of its character n-grams (with signs for its ends). The vectors of a bag are averaged and
a linear softmax makes two class probabilities; vectors and softmax are trained together in numpy. A
text is as toxic as its most toxic word, so length does not dilute it. Words of clean texts are clean;
which words of a toxic text carry its label is estimated in turn with the model: each gets a weight by its
own probability. A misspelt or inflected word shares most n-grams with the words seen in training.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import give_back, scan_texts
from .words import _POWERS, ALNUM_LOWER, Words, buffers, chunks, list_of, mix64, signed, words_of

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
#: Buckets that a training step changes at a time, to keep what it makes on the way small.
PART = 1 << 14
#: Labelled documents to learn from, at most: this many of each class, those whose id hashes lowest, and
#: no more than this many characters of whole texts.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2_500, 5_000, 60_000_000


class Model(NamedTuple):
    """``weight`` of every n-gram bucket and ``bias``: the softmax's log odds are bias + mean weight."""

    weight: np.ndarray
    bias: float


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words ``data[start:end]``, and the word of each."""
    size = end - start
    first = np.cumsum(size + 2) - (size + 2)
    flat = np.full(int((size + 2).sum()), 2, np.uint64)
    flat[first] = 1
    flat[np.repeat(first + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())] = data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype(np.uint64) + np.uint64(3)
    up, down = _POWERS.of(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * up[: len(flat)], out=sums[1:])
    buckets, owner = [], []
    for n in SIZES:
        count = np.maximum(size + 3 - n, 0)
        who = np.repeat(np.arange(len(size)), count)
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        value = mix64((sums[at + n] - sums[at]) * down[at] + np.uint64(n))
        buckets.append((value & np.uint64(BUCKETS - 1)).astype(np.int64))
        owner.append(who)
    value = mix64((sums[first + size + 2] - sums[first]) * down[first])  # the word itself
    buckets.append((value & np.uint64(BUCKETS - 1)).astype(np.int64))
    owner.append(np.arange(len(size)))
    return np.concatenate(buckets), np.concatenate(owner)


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct word of a chunk, and the distinct word of every place."""
    _, place, which = np.unique(w.hash, return_index=True, return_inverse=True)
    return place, which


def word_logits(w: Words, place: np.ndarray, model: Model, step: int = 5_000) -> np.ndarray:
    """Log odds of the words at ``place``; n-grams are made for a part of them at a time."""
    out = np.empty(len(place))
    for at in range(0, len(place), step):
        some = place[at : at + step]
        bucket, owner = word_grams(w.data, w.start[some], w.end[some])
        n = np.bincount(owner, minlength=len(some))
        out[at : at + step] = model.bias + np.bincount(owner, model.weight[bucket], len(some)) / np.maximum(n, 1)
    return out


class Bags(NamedTuple):
    """Pairs (text, distinct word), and the n-gram buckets of all words end to end with their number by word."""

    texts: int
    doc: np.ndarray
    word: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def _distinct_words(texts: DataFrame) -> DataFrame:
    """(number, toxic, hashes, words): the distinct words of each text."""

    def run(batches):
        for part in chunks(batches, limit=200_000):
            w = words_of(part.column("text"), ALNUM_LOWER)
            value, place, which = np.unique(w.hash, return_index=True, return_inverse=True)
            many = max(len(value), 1)
            pair = np.unique(w.owner() * many + which)  # a word counts once in a text
            off = np.searchsorted(pair // many, np.arange(part.num_rows + 1))
            raw = w.data.tobytes()
            spelt = pa.array([raw[a:b] for a, b in zip(w.start[place].tolist(), w.end[place].tolist(), strict=True)], pa.binary())
            words = pa.ListArray.from_arrays(pa.array(off, pa.int32()), spelt.take(pa.array(pair % many)))
            yield pa.RecordBatch.from_arrays([part.column("number"), part.column("toxic"), list_of(signed(value[pair % many]), off, pa.int64()), words], names=["number", "toxic", "hashes", "words"])

    return texts.select("number", "toxic", "text").mapInArrow(run, "number long, toxic boolean, hashes array<long>, words array<binary>")


def _bags(docs: pa.Table, words: pa.Table, step: int = 5_000) -> Bags:
    """Bags from distinct words by text and the words' bytes; n-grams are made for a part of the words at a time."""
    hashes = docs.column("hashes").combine_chunks()
    doc = np.repeat(np.arange(docs.num_rows, dtype=np.int32), np.diff(hashes.offsets.to_numpy()))
    value = words.column("hash").to_numpy()
    order = np.argsort(value)
    word = order.astype(np.int32)[np.searchsorted(value, hashes.flatten().to_numpy(), sorter=order)]
    buckets, counts = [], []
    for at in range(0, words.num_rows, step):
        raw, off = buffers(words.column("word").slice(at, step).combine_chunks())
        bucket, owner = word_grams(raw, off[:-1], off[1:])
        by = np.argsort(owner, kind="stable")
        buckets.append(bucket[by].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(off) - 1))
    none = [np.zeros(0, np.int32)]
    return Bags(docs.num_rows, doc, word, np.concatenate(buckets or none), np.concatenate(counts or none))


def train(bags: Bags, toxic: np.ndarray, dim: int = 8, rounds: int = 4, epochs: int = 3, batch: int = 8_192, rate: float = 0.02, seed: int = 7) -> Model:
    """Fit vectors and softmax on labelled texts. Without both classes: a constant by the labels' share."""
    toxic = np.asarray(toxic, bool)
    texts, all_doc, all_word, bucket, count = bags
    if not len(count):
        toxic = toxic[:0]
    if not len(toxic) or toxic.all() or not toxic.any():
        share = (toxic.sum() + 0.5) / (len(toxic) + 1.0) if len(toxic) else 0.01
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    n = len(count)
    held = np.arange(texts) % 5 == 0 if texts >= 50 else np.zeros(texts, bool)  # for the scale of scores
    if toxic[~held].all() or not toxic[~held].any() or toxic[held].all() or not toxic[held].any():
        held[:] = False
    doc, word = all_doc[~held[all_doc]], all_word[~held[all_doc]]
    first = np.concatenate([[0], np.cumsum(count)])
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32), rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.array([1.0, -1.0], np.float32)]
    moment = [np.zeros_like(p) for p in params]
    spread = [np.zeros_like(p) for p in params]
    bad = toxic[doc]
    clean = np.bincount(word[~bad], minlength=n).astype(float)
    dirty_doc, dirty_word = doc[bad], word[bad]
    share = 1.0 / np.bincount(dirty_doc, minlength=texts)[dirty_doc]
    step = 0
    for r in range(rounds):
        carried = np.bincount(dirty_word, share, n)
        # within a toxic text, what does not carry the label counts as clean
        seen = np.bincount(dirty_word, minlength=n)
        weight = np.stack([clean + (seen - carried if r else 0), carried * (20 if r == 0 else 5)], 1)
        weight = weight * np.minimum(1.0, 50.0 / np.maximum(weight.sum(1, keepdims=True), 1e-9))
        used = np.flatnonzero(weight.sum(1) > 0)
        for _ in range(epochs):
            rng.shuffle(used)
            for at in range(0, len(used), batch):
                pick = used[at : at + batch]
                many = count[pick]
                rows = np.repeat(first[pick] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                begin = np.cumsum(many) - many
                mean = np.add.reduceat(params[0][bucket[rows]], begin, axis=0) / many[:, None]
                logit = mean @ params[1] + params[2]
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                t = weight[pick]
                error = (p * t.sum(1, keepdims=True) - t) / t.sum()
                back = (error @ params[1].T) / many[:, None]
                grads = [np.empty_like(params[0]), mean.T @ error, error.sum(0)]
                for k in range(dim):
                    grads[0][:, k] = np.bincount(bucket[rows], np.repeat(back[:, k], many), BUCKETS)
                step += 1
                for p, m, s, g in zip(params, moment, spread, grads, strict=True):
                    for a in range(0, len(p), PART):
                        b = slice(a, a + PART)
                        m[b] += 0.1 * (g[b] - m[b])
                        s[b] += 0.01 * (g[b] * g[b] - s[b])
                        p[b] -= rate * (m[b] / (1 - 0.9**step)) / (np.sqrt(s[b] / (1 - 0.99**step)) + 1e-8)
        scale = (params[0] @ (params[1][:, 1] - params[1][:, 0])).astype(np.float32)
        odds = np.concatenate([np.add.reduceat(scale[bucket[first[a] : first[min(a + batch, n)]]], first[a : min(a + batch, n)] - first[a]) for a in range(0, n, batch)]) / count
        # a word's part of its text's label
        top = np.full(texts, -np.inf)
        np.maximum.at(top, dirty_doc, odds[dirty_word])
        power = np.exp(odds[dirty_word] - top[dirty_doc])
        share = power / np.bincount(dirty_doc, power, texts)[dirty_doc]
    weight = params[0] @ (params[1][:, 1] - params[1][:, 0])
    best = np.full(texts, -np.inf)
    np.maximum.at(best, all_doc, odds[all_word])
    scale = held if held.any() else np.ones(texts, bool)
    return _calibrated(weight, best[scale], toxic[scale])


def _calibrated(weight: np.ndarray, best: np.ndarray, toxic: np.ndarray) -> Model:
    """Scale and bias by a logistic fit of texts' largest log odds."""
    ok = np.isfinite(best)
    x, y = best[ok], toxic[ok].astype(float)
    centre, width = x.mean(), x.std() + 1e-9
    z = (x - centre) / width
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * z).sum() + 0.01 * a, (p - y).sum()])
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return Model(weight * (a / width), float(b - a * centre / width))


def _trained(texts: DataFrame, words: DataFrame) -> Model:
    """The model of (number, toxic, hashes) and (hash, word), trained in one task: the sample bounds what it holds."""
    none = {"toxic": F.lit(None).cast("boolean"), "hashes": F.lit(None).cast("array<long>"), "word": F.lit(None).cast("binary")}
    first = words.select(F.lit(0).alias("kind"), F.col("hash").alias("at"), "word").withColumns({c: none[c] for c in ("toxic", "hashes")})
    then = texts.select(F.lit(1).alias("kind"), F.col("number").alias("at"), "toxic", "hashes").withColumn("word", none["word"])
    rows = first.unionByName(then).repartition(1).sortWithinPartitions("kind", "at").select("kind", F.col("at").alias("hash"), "toxic", "hashes", "word")

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = int((table.column("kind").to_numpy() == 0).sum())
        toxic, bags = table.column("toxic").slice(n).to_numpy(), _bags(table.slice(n), table.slice(0, n))
        held.clear()
        del table
        give_back()
        model = train(bags, toxic)
        del bags
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype(np.float64).tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weight", "bias"])

    made = rows.mapInArrow(run, "weight binary, bias double").first()
    if made is None:  # no text to learn from
        return train(_bags(pa.table({"hashes": pa.array([], pa.list_(pa.int64()))}), pa.table({"hash": pa.array([], pa.int64()), "word": pa.array([], pa.binary())})), np.zeros(0, bool))
    return Model(np.frombuffer(made["weight"]), made["bias"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of ``labels`` (doc_id, toxic): ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents.

    The sample is taken by hash of the id, the same on any partitioning; its texts are whole, and a text that
    would pass ``SAMPLE_CHARS`` in all is left out. A document of several rows is learnt from its least text, one of
    several labels is toxic if one says so. Null labels and labels without a document are left out. Words are
    found by the tasks; one of them gets numbers of words by text and each distinct word once, and the driver
    gets the weights.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic").orderBy(*order).limit(SAMPLE_TOXIC).union(known.filter("NOT toxic").orderBy(*order).limit(SAMPLE_CLEAN))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = cut_lineage(rows, "sample")
    place = Window.orderBy(*order)  # of ids and lengths, in number bounded by the sample
    sizes = rows.select("doc_id", F.length("text").alias("size")).withColumns({"number": F.row_number().over(place).cast("long"), "upto": F.sum("size").over(place)})
    rows = rows.join(F.broadcast(sizes.filter(F.col("upto") <= SAMPLE_CHARS).select("doc_id", "number")), "doc_id")
    found = cut_lineage(_distinct_words(rows), "words")
    pairs = found.select(F.explode(F.arrays_zip("hashes", "words")).alias("w")).groupBy(F.col("w.hashes").alias("hash")).agg(F.min("w.words").alias("word"))
    return _trained(found.select("number", "toxic", "hashes"), pairs)


def score_texts(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row and its ``score``: the probability that its most toxic word is toxic.

    A text without words, or null, gets the score of the bias alone; repeated rows are scored one by one;
    an empty table gives no rows. The model is a few hundred kilobytes whatever it was trained on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def scan(batches):
        m = Model(*shared.value)
        for part in chunks(batches):
            w = words_of(part.column("text"), ALNUM_LOWER)
            best = np.full(part.num_rows, m.bias)
            if len(w.hash):
                place, which = _distinct(w)
                logit = word_logits(w, place, m)[which]
                some = np.flatnonzero(w.counts)
                best[some] = np.maximum.reduceat(logit, w.first[:-1][some])
            yield part, {"score": pa.array(1 / (1 + np.exp(-np.clip(best, -40, 40))))}

    return scan_texts(docs, scan, "score double", keep)
