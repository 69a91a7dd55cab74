"""Byte n-gram counts over all texts, and the trie that finds every position's n-gram by array lookups.

Each position of a text has one n-gram: its byte and the bytes before it, with zero bytes before the text's start.
Counts of shorter contexts are sums over the longer ones, so one pass counts every order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2 << 20
PENDING = 2_000_000


def padded(raw: bytes, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined with ``pad`` zero bytes before each; where each starts and ends."""
    zeros = bytes(pad)
    data = np.frombuffer(zeros + zeros.join([raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]) + b"\0", np.uint8)
    starts = offsets[:-1] - offsets[0] + pad * np.arange(1, len(offsets))
    return data, starts, starts + np.diff(offsets)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """At each byte from the size-1st on, the number that the last ``size`` bytes spell."""
    kind = np.uint32 if size <= 4 else np.uint64
    code = data[: len(data) - size + 1].astype(kind)
    for k in range(1, size):
        code <<= kind(8)
        code |= data[k : len(data) - size + 1 + k]
    return code


def tally(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their counts, or with the sums of their weights."""
    if weights is None:
        codes = np.sort(codes)
        at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        return codes[at], np.diff(np.r_[at, len(codes)])
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat(weights, at) if len(at) else weights[:0]


def count_grams(rows: DataFrame, size: int) -> DataFrame:
    """(grp, gram, n) over all texts; ``rows`` has grp (string) and text. Tasks add up before they send."""

    def work(batches):
        held: dict[str, list] = {}
        pending = 0

        def merged(g):
            return tally(np.concatenate([x for x, _ in held[g]]), np.concatenate([n for _, n in held[g]]))

        def send():
            for g in held:
                codes, n = merged(g)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["grp", "gram", "n"])

        for b in batches:
            groups = b.column(0).dictionary_encode()
            offsets, data = C.column_bytes(b.column(1))
            raw, which = data.tobytes(), groups.indices.to_numpy()
            for i, j in C.windows(offsets, WINDOW):
                for k in np.unique(which[i:j]):
                    rows_k = i + np.flatnonzero(which[i:j] == k)
                    text = b"".join([bytes(size - 1) + raw[offsets[r] : offsets[r + 1]] for r in rows_k])
                    code = grams(np.frombuffer(text, np.uint8), size)
                    if not len(code):
                        continue
                    # n-grams that end in the zeros before a later text belong to no text
                    ends = np.cumsum(size - 1 + np.diff(offsets)[rows_k])[:-1]
                    if len(ends):
                        drop = (ends[:, None] + np.arange(size - 1)[None, :] - (size - 1)).ravel()
                        mask = np.ones(len(code), bool)
                        mask[drop] = False
                        code = code[mask]
                    part = tally(code)
                    held.setdefault(groups.dictionary[int(k)].as_py(), []).append(part)
                    pending += len(part[0])
                if pending > PENDING:
                    held = {g: [merged(g)] for g in held}
                    pending = sum(len(x[0][0]) for x in held.values())
                    if pending > PENDING:
                        yield from send()
                        held, pending = {}, 0
        yield from send()

    parts = rows.select("grp", "text").mapInArrow(C.tidy(work), "grp string, gram long, n long")
    return parts.groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame, size: int) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """For each group and each order, the codes and counts of all its n-grams. There are at most 256 ** size of them a group, at any input size."""
    longest = counts.toPandas()
    out: dict[str, list] = {}
    for g, part in longest.groupby("grp", sort=True):
        codes, n = part["gram"].to_numpy(np.int64).astype(np.uint64), part["n"].to_numpy(np.int64)
        out[g] = [tally(codes & np.uint64((1 << 8 * k) - 1), n) for k in range(1, size + 1)]
    return out


class Trie:
    """Finds each position's node of every order. Node 0 of an order stands for n-grams the tree lacks.

    Only the n-gram numbers are pickled; the lookup tables are built where they are used.
    """

    def __init__(self, codes: list[np.ndarray]):
        """codes: the sorted n-gram numbers of orders 1, 2, ...; whatever an n-gram extends is there too."""
        self.codes = [np.union1d(c.astype(np.uint64), np.zeros(1, np.uint64)) for c in codes]
        self.child = None

    def __getstate__(self):
        return {"codes": self.codes, "child": None}

    def build(self) -> None:
        """One table an order: by the node before and the byte's symbol. Bytes without a node share a symbol."""
        known = self.codes[0].astype(np.int64)
        self.width = len(known) + 1
        self.symbol = np.full(256, len(known), np.int64)
        self.symbol[known] = np.arange(len(known))
        self.child = []
        for k, c in enumerate(self.codes):
            table = np.zeros((len(self.codes[k - 1]) + 1 if k else 1) * self.width, np.int32)
            at = (1 + np.searchsorted(self.codes[k - 1], c >> np.uint64(8))) if k else np.zeros(len(c), np.int64)
            table[at * self.width + self.symbol[(c & np.uint64(255)).astype(np.int64)]] = 1 + np.arange(len(c), dtype=np.int32)
            self.child.append(table)

    def node(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Nodes of order k (from 0) of n-gram numbers."""
        at = np.searchsorted(self.codes[k], codes)
        at[at == len(self.codes[k])] = 0
        return np.where(self.codes[k][at] == codes, at + 1, 0)

    def suffix(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Nodes of order k - 1 that n-grams of order k have without their first byte."""
        return self.node(k - 1, codes & np.uint64((1 << (8 * k)) - 1))

    def ids(self, data: np.ndarray) -> list[np.ndarray]:
        """At every byte the node of each order's n-gram that ends there; bytes before the array count as zeros."""
        if self.child is None:
            self.build()
        own = self.symbol[data]
        out = [self.child[0][own]]
        for table in self.child[1:]:
            before = np.empty(len(data), np.int64)
            before[:1] = self.width  # the node of zeros is the first
            np.multiply(out[-1][:-1], self.width, out=before[1:], casting="unsafe")
            before += own
            out.append(table[before])
        return out


class ContextCosts:
    """Code lengths of texts under models that share a trie: bits of a byte in the longest context that the trie has.

    ``cost[k]`` has a row for each node of order k (row 0: a byte no node has) and a column for each model;
    ``escape[k]`` the bits of leaving a context of k bytes, by the context's node of order k - 1 (one row for k = 0).
    """

    trie: Trie
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def bits(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each model."""
        last = len(self.cost) - 1
        data, starts, ends = padded(raw[offsets[0] : offsets[-1]], offsets - offsets[0], last)
        ids = self.trie.ids(data)
        value = self.cost[last][ids[last]]
        at = np.flatnonzero(ids[last] == 0)
        if len(at):  # n-grams that the trie lacks: escape until an order has them
            value[at] = 0
            k = last
            while len(at):
                lacks = ids[k][at] == 0
                done = at[~lacks] if k else at
                value[done] += self.cost[k][ids[k][done]]
                at = at[lacks] if k else at[:0]
                if len(at):
                    before = np.where(at > 0, ids[k - 1][at - 1], 1)
                    value[at] += self.escape[k][before]
                k -= 1
        sums = np.add.reduceat(value, np.c_[starts, ends].ravel(), axis=0)[::2]
        sums[starts == ends] = 0
        return sums
