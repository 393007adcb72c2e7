"""Byte-pair encoding by backtracking, and decoding by an offset table.

A piece of text is covered from the left by the longest token that fits; a token may follow another only
if merging would not have joined them otherwise (``Merges.compatible``), else a shorter token is tried, or
the one before is taken back. That gives exactly the tokens of the ordered merges in time linear in the
text. Longest tokens come from a trie walked from all bytes at once, as an Aho-Corasick automaton's goto
table; failure links are not needed, since every byte starts a walk of its own. All distinct new pieces of
a chunk of texts are encoded together in numpy arrays; pieces seen before come from a bounded table.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .scan import scan_texts
from .words import chunks

#: Splits text before merging (fixed values of byte-level vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
KEPT_PIECES = 200_000
_NEVER = 1 << 40


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if it prints, else 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Tokens by rank: 256 bytes, then the product of each merge in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        char_of = {b: c for c, b in byte_of.items()}
        names = [char_of[b] for b in range(256)]
        rank = {c: b for b, c in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if a + b not in rank:
                rank[a + b] = len(names)
                names.append(a + b)
                left.append(rank[a])
                right.append(rank[b])
        self.ids = np.array([vocab[n] for n in names], np.int64)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        tokens = [bytes(byte_of[c] for c in n) for n in names]
        self.size = np.array([len(t) for t in tokens], np.int64)
        n = self.n = len(tokens)
        made = np.arange(256, n)
        key = self.left[256:] * n + self.right[256:]
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], made[order]
        self._trie(tokens)
        known = {t: r for r, t in enumerate(tokens)}
        self.shorter = np.array([next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in tokens], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {int(i): t for i, t in zip(self.ids, tokens, strict=True)} | {i: c.encode() for c, i in self.special.items()}
        blob = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in blob])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)

    def _trie(self, tokens: list[bytes]) -> None:
        node: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        edges = []
        for t in tokens:
            for k in range(2, len(t) + 1):
                if t[:k] not in node:
                    node[t[:k]] = len(node)
                    edges.append((node[t[: k - 1]] * 256 + t[k - 1], node[t[:k]]))
        edges.sort()
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.to = np.array([x for _, x in edges], np.int64)
        self.token_at = np.full(len(node), -1, np.int64)
        for r, t in enumerate(tokens):
            self.token_at[node[t]] = r
        self.second = np.full(65536, -1, np.int64)
        early = self.edge < 65536
        self.second[self.edge[early]] = self.to[early]

    def longest(self, data: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For every byte the longest token that starts there and ends by ``stop``."""
        best = data.astype(np.int64)
        live = np.flatnonzero(np.arange(len(data)) + 1 < stop)
        node = self.second[best[live] * 256 + data[live + 1]]
        depth = 2
        while len(live):
            live, node = live[node >= 0], node[node >= 0]
            token = self.token_at[node]
            best[live[token >= 0]] = token[token >= 0]
            more = live + depth < stop[live]
            live, node = live[more], node[more]
            key = node * 256 + data[live + depth]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            node = np.where(self.edge[at] == key, self.to[at], -1)
            depth += 1
        return best

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves tokens a and b apart when they stand side by side.

        Undo the later of the two merges again and again; the pair breaks if what then meets at the border
        would have been merged before that. At equal ranks the merge further left comes first.
        """
        ok = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), _NEVER)
        a, b = a.copy(), b.copy()
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            broken = (self.pair_key[at] == key) & (self.pair_rank[at] < limit)
            ok[live[broken]] = False
            first = np.where(a > b, a >= 256, b < 256)  # undo a, or else b
            done = broken | ((a < 256) & (b < 256))
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
        return ok

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces end to end, and the offsets of each piece's ids."""
        size = np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(pieces), np.uint8)
        stop = np.repeat(start + size, size)
        longest = self.longest(data, stop)
        gap = np.arange(len(pieces))  # a piece's last border is not the next one's first
        open_ = np.ones(len(data) + len(pieces) + 1, bool)
        out = np.zeros(len(data) + 1, np.int64)
        depth = np.zeros(len(pieces), np.int64)
        live = np.flatnonzero(size > 0)
        pos = start[live].copy()
        token = longest[pos]
        while len(live):
            begin, d = start[live], depth[live]
            end = pos + self.size[token]
            good = open_[end + gap[live]]
            inner = np.flatnonzero(good & (d > 0))
            good[inner] = self.compatible(out[begin[inner] + d[inner] - 1], token[inner])
            g = np.flatnonzero(good)
            out[begin[g] + d[g]] = token[g]
            depth[live[g]] += 1
            pos[g] = end[g]
            over = np.zeros(len(live), bool)
            over[g] = pos[g] == begin[g] + size[live[g]]
            go = g[~over[g]]
            token[go] = longest[pos[go]]
            bad = np.flatnonzero(~good)
            shorter = self.shorter[token[bad]]
            token[bad[shorter >= 0]] = shorter[shorter >= 0]
            back = bad[shorter < 0]
            open_[pos[back] + gap[live[back]]] = False
            depth[live[back]] -= 1
            token[back] = out[begin[back] + depth[live[back]]]
            pos[back] -= self.size[token[back]]
            live, pos, token = live[~over], pos[~over], token[~over]
        first = np.concatenate([[0], np.cumsum(depth)]).astype(np.int64)
        take = np.repeat(start - first[:-1], depth) + np.arange(first[-1])
        return self.ids[out[take]], first

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, by their places in one string of all tokens."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        total = int(size.sum())
        return self.blob[np.repeat(self.offsets[ids] - (np.cumsum(size) - size), size) + np.arange(total)]

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.offsets[ids + 1] - self.offsets[ids]


class Encoder:
    """Encodes texts piece by piece, with a bounded table of pieces seen before.

    A space between two other characters that are no white space always begins a new piece, so most texts
    are cut by a plain split; a key without a leading line end stands for a piece with its space.
    """

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.special = self.merges.special
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _keys(self, text: str) -> list[str]:
        if " \n" in text:  # a later key would look like that of a first piece
            return ["\n" + p for p in self.split(text)]
        keys = text.split(" ")
        if keys[0]:
            keys[0] = "\n" + keys[0]
        for k in set(keys).difference(self.known):
            body = k[1:] if k[:1] == "\n" and k is keys[0] else k
            if not body or body[0].isspace() or body[-1].isspace() or len(body) > 64:
                return ["\n" + p for p in self.split(text)]
        return keys

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        plans = []
        for text in texts:
            if self.apart and any(s in text for s in self.special):
                plan = []
                for i, part in enumerate(self.apart(text)):
                    plan += [self.special[part]] if i % 2 else self._keys(part) if part else []
                plans.append(plan)
            else:
                plans.append(self._keys(text) if text else [])
        fresh = [k for k in set().union(*plans).difference(self.known) if isinstance(k, str)]
        pieces, count = [], []
        for k in fresh:
            cut = self.split(k[1:] if k[:1] == "\n" else " " + k)
            pieces += [p.encode() for p in cut]
            count.append(len(cut))
        long: dict = {}
        if fresh:
            ids, first = self.merges.encode(pieces)
            raw = ids.astype("<i4").tobytes()
            bound = (first[np.concatenate([[0], np.cumsum(count)])] * 4).tolist()
            for k, a, b in zip(fresh, bound[:-1], bound[1:], strict=True):
                (self.known if len(k) <= 66 else long)[k] = raw[a:b]
        for i in self.special.values():
            long[i] = i.to_bytes(4, "little")
        known = self.known
        return [b"".join([known[k] if k in known else long[k] for k in plan]) for plan in plans]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, its token ``ids``, and the text ``decoded`` from those ids.

    A null text is empty and has no ids; special strings of the vocabulary inside a text are single tokens;
    repeated rows are encoded one by one; an empty table gives no rows.
    """

    def scan(batches):
        e = encoder(path)
        for part in chunks(batches):
            raw = e.ids([t or "" for t in part.column("text").to_pylist()])
            ids = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
            first = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            text = e.merges.decode(ids).tobytes()
            bound = np.concatenate([[0], np.cumsum(e.merges.sizes(ids))])[first]
            yield (
                part,
                {
                    "ids": pa.ListArray.from_arrays(pa.array(first), pa.array(ids.astype(np.int32))),
                    "decoded": pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.string()),
                },
            )

    return scan_texts(docs, scan, "ids array<int>, decoded string", keep)
