"""A Katz backoff model of word pairs over a whole corpus, and the scores of all its texts.

P(word | history) is the Good-Turing discounted share of the pair if training has it, else the history's
backoff weight times P(word); P(word) is the discounted share of the word, or what the discounts leave for
words not seen. Every word of the training texts is a history, and so is the begin of a text; all words and
pairs are counted in all training texts. Backoff weights are exact, so every history's probabilities add up
to one.

Texts are packed into blocks, which are stored. A block asks buckets of hashes for the counts of its distinct
words and pairs, and hands over its own counts with the question: a bucket has one entry per block for a word
or pair however frequent it is, adds up one count per distinct key, and answers in the order of the question.
One of the blocks that hold a pair is told to own it; owners add the pair to what its history has given
away, so every distinct pair counts once, and a second question brings the backoff weights back. What goes
to the driver is counts of counts.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import SPACED_LOWER, chunks, mix64, words_of

#: Counts above this are not discounted.
K = 5
BLOCK_TOKENS, BUCKET_TOKENS = 500_000, 4_000_000

#: Ends every text; as a history, where it cannot stand otherwise, it is the begin of a text.
END = np.uint64(0x0123456789ABCDEF)
_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)
PAIRS, WORDS, HISTORIES = 0, 1, 2
_BLOCKS = "block long, words binary, tokens binary, ids array<long>, held array<boolean>, n_tokens array<long>"
_ASKED = "block long, kind int, bucket int, keys binary, n binary, given binary, lower binary"
_ANSWERS = "block long, kind int, bucket int, found binary, of array<long>, total long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()),
}


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte of equal weight, so that bytes that are mostly zero lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _small(x: np.ndarray) -> bytes:
    """Whole numbers of the least width that holds them all, packed: most are far below the largest."""
    return zlib.compress(_planes(x.astype(np.min_scalar_type(int(x.max(initial=0))))), 1)


def _from_small(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    return _from_planes(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _reals(x: np.ndarray) -> bytes:
    """Doubles packed: many are zero, and of the others many are alike."""
    return zlib.compress(x.tobytes(), 1)


def _from_reals(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.float64)


def _rows(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))]))


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts as places in the block's list of words, the frequent ones first."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            words, index, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            row = {"block": number, "words": words[order].tobytes(), "tokens": zlib.compress(_planes(rank[index]), 1)}
            return _rows(_BLOCKS, [row | {name: [x for h in held for x in h[i]] for i, name in ((1, "ids"), (2, "held"), (3, "n_tokens"))}])

        for part in chunks(batches):
            w = words_of(part.column("text"), SPACED_LOWER)
            n = part.num_rows
            tok = np.full(len(w.hash) + n, END, np.uint64)
            tok[np.arange(len(w.hash)) + w.owner()] = w.hash
            if held and size + len(tok) > BLOCK_TOKENS:
                yield flush()
                number, held, size = number + 1, [], 0
            held.append((tok, part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), (w.counts + 1).tolist()))
            size += len(tok)
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), (~F.coalesce("trained", F.lit(False))).alias("held_out"), "text").mapInArrow(run, _BLOCKS)


class _Block:
    """Distinct words and pairs of a stored block; ``hist`` and ``word`` are places in ``words``."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def of(name):
            return batch.column(name)[row]

        self.number = of("block").as_py()
        self.words = np.frombuffer(of("words").as_py(), np.uint64)
        self.tokens = _from_planes(zlib.decompress(of("tokens").as_py()), np.uint32).astype(np.int64)
        self.ids, self.held = of("ids").values, of("held").values
        self.n_tokens = of("n_tokens").values.to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(len(self.n_tokens)), self.n_tokens)
        hist = np.empty_like(self.tokens)
        hist[1:] = self.tokens[:-1]
        hist[0] = self.tokens[-1]  # an end, as before every other text
        key, self.pair = np.unique(hist * len(self.words) + self.tokens, return_inverse=True)
        self.hist, self.word = key // len(self.words), key % len(self.words)
        self.pair_keys = mix64(self.words[self.hist] * _STEP + self.words[self.word])

    def learnt(self) -> np.ndarray:
        """Whether a token belongs to a training text."""
        return ~self.held.to_numpy(zero_copy_only=False)[self.doc]


def _ask(number: int, kind: int, keys: np.ndarray, buckets: int, n: np.ndarray, given=None, lower=None) -> pa.RecordBatch:
    """Rows of a question, one for each bucket of hashes that has some of ``keys``."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    bucket = _bucket(keys, buckets)
    some, first = np.unique(bucket, return_index=True)
    out = []
    for b, lo, hi in zip(some.tolist(), first.tolist(), [*first.tolist()[1:], len(keys)], strict=True):
        row = {"block": number, "kind": kind, "bucket": b, "keys": _planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), "n": _small(n[lo:hi])}
        if given is not None:
            row |= {"given": _reals(given[order[lo:hi]]), "lower": _reals(lower[order[lo:hi]])}
        out.append(row)
    return _rows(_ASKED, out)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _answers(asked: DataFrame, answer) -> DataFrame:
    """Stored rows of ``answer(kind, sizes, key, n, rows)``, which gives an array per row and may add a sum.

    ``key`` numbers the bucket's distinct keys in all rows laid end to end.
    """

    def answered(kind, bucket, rows):
        sizes = [size for *_, size in rows]
        keys = np.concatenate([r.pop("keys") for r, _ in rows])
        n = np.concatenate([r.pop("n") for r, _ in rows])
        _, first, key = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        found, more = answer(kind, key, first, n, [r for r, _ in rows])
        pack = _small if found.dtype == np.int64 else _reals
        at = 0
        for r, size in rows:
            yield _rows(_ANSWERS, [{"block": r["block"], "kind": kind, "bucket": bucket, "found": pack(found[at : at + size])}])
            at += size
        if more:
            yield _rows(_ANSWERS, [{"block": None, "kind": kind} | more])

    def run(batches):
        place, rows = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("block", "kind", "bucket", "given", "lower")}
                here = (r.pop("kind"), r.pop("bucket"))
                if rows and here != place:
                    yield from answered(*place, rows)
                    rows = []
                place = here
                r["keys"] = np.cumsum(_from_planes(batch.column("keys")[row].as_buffer(), np.uint64))
                size = len(r["keys"])
                r["n"] = _from_small(batch.column("n")[row].as_buffer(), size)
                rows.append((r, size))
        if rows:
            yield from answered(*place, rows)

    # sorted rows stream by: a task holds one bucket, and what is sorted may spill
    dealt = asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    return cut_lineage(dealt.select("block", "kind", "bucket", "keys", "n", "given", "lower").mapInArrow(run, _ANSWERS), "answers")


class Katz(NamedTuple):
    """What all blocks must know: numbers of trained tokens and word types, and discounts by count."""

    tokens: int
    types: int
    word_discount: np.ndarray  # by count up to K; 1 beyond
    pair_discount: np.ndarray
    unseen: float  # probability of a word not seen
    shrink: float  # of the words seen

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        seen = self.word_discount[np.minimum(count, K + 1)] * count / max(self.tokens, 1) * self.shrink
        return np.where(count > 0, seen, self.unseen)

    def pair_share(self, count: np.ndarray, hist_count: np.ndarray) -> np.ndarray:
        return self.pair_discount[np.minimum(count, K + 1)] * count / np.maximum(hist_count, 1)


def discounts(of_count: np.ndarray) -> np.ndarray:
    """Katz's discounts for counts 0..K+1 from the numbers of types that occur r times (``of_count[r]``).

    Where those numbers are too few to give discounts between 0 and 1, (r - 1/2) / r is taken for all r.
    """
    r = np.arange(K + 2)
    plain = np.where((r > 0) & (r <= K), (r - 0.5) / np.maximum(r, 1), 1.0)
    if (of_count[1 : K + 2] <= 0).any():
        return plain
    top = (K + 1) * of_count[K + 1] / of_count[1]
    turing = (r[1 : K + 1] + 1) * of_count[2 : K + 2] / of_count[1 : K + 1] / r[1 : K + 1]
    d = (turing - top) / (1 - top) if top < 1 else np.zeros(K)
    if (d <= 0).any() or (d >= 1).any():
        return plain
    return np.concatenate([[1.0], d, [1.0]])


def fit(answers: DataFrame) -> Katz:
    """Discounts from the counts of counts of all distinct words and pairs."""
    sums = answers.filter("block IS NULL").groupBy("kind").agg(F.sum("total").alias("total"), *[F.sum(F.get("of", F.lit(r))).alias(f"of{r}") for r in range(K + 3)])
    got = {r["kind"]: r for r in sums.collect()}
    of_word, of_pair = (np.array([got[k][f"of{r}"] if k in got else 0 for r in range(K + 3)], float) for k in (WORDS, PAIRS))
    tokens, types = int(got[WORDS]["total"]) if got else 0, int(of_word[1:].sum())
    word_discount = discounts(of_word)
    r = np.arange(K + 1)
    left = float((of_word[: K + 1] * r * (1 - word_discount[: K + 1])).sum() / max(tokens, 1)) if tokens else 1.0
    shrink = 1.0
    if left <= 0:
        left, shrink = 1 / (tokens + 1), tokens / (tokens + 1)
    return Katz(tokens, types, word_discount, discounts(of_pair), left, shrink)


def _counted(kind, key, first, n, rows):
    """Twice the count of each key, and one more for the first block that holds it."""
    count = np.bincount(key, n).astype(np.int64)
    own = np.zeros(len(key), np.int64)
    own[first] = 1
    return 2 * count[key] + own, {"of": np.bincount(np.minimum(count, K + 2), minlength=K + 3).tolist(), "total": int(count.sum())}


def _weighed(kind, key, first, n, rows):
    """The backoff weight of each history; below zero where it has no discounts and its pairs must shrink."""
    given, lower = (np.bincount(key, np.concatenate([_from_reals(r[c]) for r in rows])) for c in ("given", "lower"))
    count = n[first]  # the same in every block
    full = (count > 0) & (given >= 1 - 1e-12)
    rest = 1 - np.where(full, given * count / (count + 1), given)
    weight = np.where(count > 0, rest / np.maximum(1 - lower, 1e-300), 1.0)
    return np.where(full, -weight, weight)[key], None


def _with_answers(blocks: DataFrame, answers: DataFrame, buckets: int, each, ddl: str) -> DataFrame:
    """What ``each`` makes of every block and the answers it got, by kind and in the order of its words or pairs."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block, got = _Block(batch, row), {}
                answered = batch.column("answers")[row].as_py()
                for kind, keys in ((PAIRS, block.pair_keys), (WORDS, block.words), (HISTORIES, block.words)):
                    own = sorted((a for a in answered if a["kind"] == kind), key=lambda a: a["bucket"])
                    if own:
                        order = np.argsort(keys)
                        first = np.searchsorted(_bucket(keys[order], buckets), np.array([a["bucket"] for a in own], np.uint64)).tolist()
                        read = _from_small if kind != HISTORIES else lambda raw, n: _from_reals(raw)
                        found = np.concatenate([read(a["found"], hi - lo) for a, lo, hi in zip(own, first, [*first[1:], len(keys)], strict=True)])
                        got[kind] = np.empty_like(found)
                        got[kind][order] = found
                yield each(block, got)

    of_block = answers.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "found")).alias("answers"))
    return blocks.join(of_block, "block").mapInArrow(run, ddl)


def katz_scores(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, trained): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10 probabilities).

    Words are separated by white space after A-Z are lower-cased; every text ends with one end token. Null
    texts are empty; rows whose ``trained`` is null or false are only scored; repeated rows count as often
    as they stand. With nothing to learn from, any word is the one unseen class with probability one. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = cut_lineage(_blocks(docs), "blocks")
    tokens = blocks.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))

    def ask(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = _Block(batch, row)
                learnt = b.learnt()
                yield _ask(b.number, PAIRS, b.pair_keys, buckets, np.bincount(b.pair, learnt, len(b.word)).astype(np.int64))
                yield _ask(b.number, WORDS, b.words, buckets, np.bincount(b.tokens, learnt, len(b.words)).astype(np.int64))

    counts = _answers(blocks.mapInArrow(ask, _ASKED), _counted)
    model = fit(counts)

    def give(b: _Block, got):
        """What the pairs this block owns take from their histories, and what their words would take."""
        count, n = got[PAIRS] >> 1, got[WORDS] >> 1
        own = np.flatnonzero((got[PAIRS] & 1 == 1) & (count > 0))
        hist = b.hist[own]
        given = np.bincount(hist, model.pair_share(count[own], n[hist]), len(b.words))
        lower = np.bincount(hist, model.word_probability(n)[b.word[own]], len(b.words))
        return _ask(b.number, HISTORIES, b.words, buckets, n, given, lower)

    weights = _answers(_with_answers(blocks, counts, buckets, give, _ASKED), _weighed)

    def score(b: _Block, got):
        count, n, weight = got[PAIRS] >> 1, got[WORDS] >> 1, got[HISTORIES]
        kept = np.where(weight < 0, n / (n + 1), 1.0)[b.hist]
        p = np.where(count > 0, model.pair_share(count, n[b.hist]) * kept, np.abs(weight)[b.hist] * model.word_probability(n)[b.word])
        base = np.log10(n + 0.5) - np.log10(model.tokens + 0.5 * (model.types + 1))
        sums = [np.bincount(b.doc, x, len(b.n_tokens)) for x in (np.log10(p)[b.pair], base[b.tokens], (n > 0)[b.tokens])]
        return pa.RecordBatch.from_arrays(
            [b.ids, b.held, pa.array(b.n_tokens), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(b.n_tokens), model.tokens)), pa.array(sums[1]), pa.array(sums[0])],
            names=[c.split()[0] for c in _SCORES.split(", ")],
        )

    return _with_answers(blocks, counts.unionByName(weights), buckets, score, _SCORES)
