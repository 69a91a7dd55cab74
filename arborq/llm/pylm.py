"""Language-model scoring by a hierarchical Pitman-Yor model.

Every training token is a customer in the restaurant of the word before it (of the end token for a document's first word). The tables of these restaurants
are the customers of one restaurant of words, and its tables are the customers of a
spelling model: restaurants for the contexts of up to ``order`` bytes within a word, where a context shares its parent
with all contexts that have the same last bytes, down to the empty context, whose parent is uniform over bytes. So a word's
probability mixes its count behind the word before it, the number of contexts it has, and its spelling, and words never seen have one too.

The score takes a word never seen in training for the one outcome "unknown word", as the base score does: its probability is that
of a new table times the spelling model's mass outside the vocabulary. spelled_score has each such word's own spelling instead.

Seating is sampled by Gibbs sweeps. A sweep takes the customers of each dish out and seats them again one at a time by the
Chinese restaurant process, given the tables of all other dishes (beyond the first ``SINGLY`` customers, which join in
blocks of an eighth of those seated). Word seatings are sampled where the words are, from seeds made of the sweep
and the shard, so that a task that runs again samples the same; spelling seatings are sampled on the driver over the whole tree, which
has at most 2 ** 24 leaves at any input size. Predictive probabilities of the sweeps after the first are averaged. Discounts are set from the numbers of
dishes with one and with two customers. Restaurants of preceding words are swept where all their customers are, given the words' shares of the training tokens, before
the words' restaurant and the spelling's are; their last seating counts, and those of a shard share a discount.

Counts cover all training documents: tasks count blocks of documents, shards of the vocabulary add the blocks' counts and
send each block its words' numbers back. With these a block sends its pairs to the shards of their first words, which seat them, send each block its pairs' counts and tables,
and the words' shards the tables of each word. What is sent is packed: ascending numbers as differences, bytes by their place, zstandard.

Results for odd inputs: a null or empty text is one end token; without training documents every word has its spelling's uniform
probability and base_score takes N = V = 0; repeated rows count and are scored as often as they occur; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .bytetrie import ContextCosts, Trie, grams, levels, tally

#: No token holds white space, so this one is the end's alone; words are spelled with LAST behind them.
END, LAST = b"\f", b"\n"
#: Bytes of the longest spelling context.
ORDER = 2
SWEEPS, BURN_IN = 4, 1
CONTEXT_SWEEPS = 3
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
SINGLY = 24
STRENGTH = 1.0
SEED = 20
#: In place of a sweep's number in the seeds of restaurants of preceding words.
CONTEXT = 1 << 16


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers from 0, or of any sign if not all fit 32 bits."""
    own = np.diff(values, prepend=0) if ascending else values
    wide = len(own) and (int(own.max()) >> 32 or int(own.min()) < 0)
    planes = np.ascontiguousarray(own.astype("<i8" if wide else "<u4").view(np.uint8).reshape(len(own), 8 if wide else 4).T)
    return bytes([8 if wide else 4]) + len(own).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, ascending: bool = False) -> np.ndarray:
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    own = np.ascontiguousarray(planes.T).view("<i8" if size == 8 else "<u4").reshape(n).astype(np.int64)
    return np.cumsum(own) if ascending else own


def pack_words(words: list[bytes]) -> bytes:
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_words(raw: bytes) -> list[bytes]:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True).split(b" ")


def blocks(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds. shard >= 0: a block's words of that shard, with their places in the block and training counts. shard = -1:
    the block's documents: doc_id, whether held out, and the places of their tokens."""
    rows = C.id_and_text(docs.select("doc_id", "text")).withColumn("held", C.remainder(10).eqNullSafe(0))
    kind = rows.schema["doc_id"].dataType

    def work(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        names = ["shard", "block", "words", "places", "counts", "docs", "held", "sizes", "tokens"]
        id_type = None

        def send(block, vocabulary, ids, held, tokens):
            words = list(vocabulary)
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.concatenate(tokens)
            trained = np.bincount(flat[np.repeat(~np.array(held), size)], minlength=len(words))
            shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
            order = np.argsort(shard, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)]
            parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            n = len(parts)
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([
                pa.array([int(shard[p[0]]) for p in parts] + [-1], pa.int32()), pa.array([block] * (n + 1), pa.int64()),
                pa.array([pack_words([words[i] for i in p.tolist()]) for p in parts] + [None], pa.binary()),
                pa.array([pack(p, True) for p in parts] + [None], pa.binary()), pa.array([pack(trained[p]) for p in parts] + [None], pa.binary()),
                pa.concat_arrays([none(n, pa.list_(id_type)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, id_type))]),
                pa.array([None] * n + [np.array(held, np.uint8).tobytes()], pa.binary()), pa.array([None] * n + [pack(size)], pa.binary()),
                pa.array([None] * n + [pack(flat)], pa.binary()),
            ], names)

        fresh = lambda: (defaultdict(counter().__next__), [], [], [])
        vocabulary, ids, held, tokens = fresh()
        size = 0
        for b in batches:
            id_type = b.column(0).type
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes().lower()  # bytes: A-Z only
            for i, j, doc, out in zip(offsets[:-1].tolist(), offsets[1:].tolist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = raw[i:j].split()
                words.append(END)
                ids.append(doc)
                held.append(out)
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
                size += j - i + 1
                if size >= block_bytes:
                    yield from send(block, vocabulary, ids, held, tokens)
                    vocabulary, ids, held, tokens = fresh()
                    size, block = 0, block + 1
        if ids:
            yield from send(block, vocabulary, ids, held, tokens)

    return rows.mapInArrow(C.tidy(work), f"shard int, block long, words binary, places binary, counts binary, docs array<{kind.simpleString()}>, held binary, sizes binary, tokens binary")


def vocabulary(parts: DataFrame) -> DataFrame:
    """One row a shard: words and training counts, the most frequent first; n, v: customers and dishes."""

    def work(table: pa.Table) -> pa.Table:
        place: dict[bytes, int] = defaultdict(counter().__next__)
        at, n = [], []
        for words, counts in zip(table.column("words"), table.column("counts"), strict=True):
            own = unpack_words(words.as_py())
            at.append(np.fromiter(map(place.__getitem__, own), np.int64, len(own)))
            n.append(unpack(counts.as_py()))
        words = list(place)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, np.concatenate(at), np.concatenate(n))
        order = sorted(range(len(words)), key=lambda i: (-total[i], words[i]))
        total = total[order]
        row = [table.column("shard")[0].as_py(), b" ".join([words[i] for i in order]), total.astype("<i8").tobytes(), int(total.sum()), int((total > 0).sum())]
        return pa.table([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["shard", "words", "counts", "n", "v"])

    return parts.filter("shard >= 0").select("shard", "words", "counts").groupBy("shard").applyInArrow(work, "shard int, words binary, counts binary, n long, v long")


#: Rows that go to a block. shard < 0: places of words in the block (one), their numbers (two), training counts (three), log10 probabilities (four).
#: shard >= 0: of the block's pairs whose first word is in that shard, in the order of their numbers, counts (one) and tables (two), and the tables of their first words (three).
TO_BLOCK = "block long, shard int, discount double, one binary, two binary, three binary, four binary"


def to_block(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], [x.split()[0] for x in TO_BLOCK.split(", ")])


def words_of_blocks(parts: DataFrame, vocab: DataFrame, shards: int, logp=None) -> DataFrame:
    """For each block and shard the numbers and training counts of its words. ``logp``: also their probabilities, from (shard, words, counts, customers)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_block([])
        row = {c: right.column(c)[0].as_py() for c in right.column_names}
        words, counts = row["words"].split(b" "), np.frombuffer(row["counts"], "<i8")
        rank = {w: i for i, w in enumerate(words)}
        p = None if logp is None else logp(row["shard"], words, np.frombuffer(row["customers"], "<i8"))
        out = []
        for block, own, at in zip(left.column("block"), left.column("words"), left.column("places"), strict=True):
            own = unpack_words(own.as_py())
            i = np.fromiter(map(rank.__getitem__, own), np.int64, len(own))
            out.append((block.as_py(), -1, None, at.as_py(), pack(i * shards + row["shard"]), pack(counts[i]), None if p is None else p[i].astype("<f4").tobytes()))
        return to_block(out)

    words = parts.filter("shard >= 0").select("shard", "block", "words", "places")
    return words.groupBy("shard").cogroup(vocab.groupBy("shard")).applyInArrow(work, TO_BLOCK)


class Pairs:
    """The pairs of a block: each token (``at``) with the token before it, the first with the end. Their numbers (``key``: first word's, second word's) are sorted
    and dealt by the first word's shard."""

    def __init__(self, left: pa.Table, right: pa.Table, shards: int):
        self.sizes, self.flat = unpack(left.column("sizes")[0].as_py()), unpack(left.column("tokens")[0].as_py())
        self.held = np.frombuffer(left.column("held")[0].as_py(), np.uint8).astype(bool)
        rows = [r for r in right.to_pylist() if r["shard"] < 0]
        at = np.concatenate([unpack(r["one"], True) for r in rows])
        self.number, self.count, self.logp = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.zeros(len(at))
        self.number[at] = np.concatenate([unpack(r["two"]) for r in rows])
        self.count[at] = np.concatenate([unpack(r["three"]) for r in rows])
        if rows[0]["four"] is not None:
            self.logp[at] = np.concatenate([np.frombuffer(r["four"], "<f4") for r in rows])
        before = np.r_[self.flat[-1:], self.flat[:-1]]  # every document ends with the end
        self.key, first, self.at = np.unique(self.number[before] << np.uint64(32) | self.number[self.flat], return_index=True, return_inverse=True)
        self.first, self.second = before[first], self.flat[first]
        shard = ((self.key >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)]
        self.parts = {int(shard[order[a]]): order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def pairs_of_blocks(documents: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, block): ranks of first words within their shard (firsts) and how many seconds each has (fans), numbers of the second words (seconds), training counts
    of the pairs (counts), and training counts of the different second words, ascending by number (words)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Pairs(left, right, shards)
        trained = np.bincount(own.at, np.repeat(~own.held, own.sizes), len(own.key)).astype(np.int64)
        out = []
        for shard, i in own.parts.items():
            firsts, fans = np.unique(own.key[i] >> np.uint64(32), return_counts=True)
            seconds = (own.key[i] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            _, at = np.unique(seconds, return_index=True)
            out.append((shard, pack((firsts // np.uint64(shards)).astype(np.int64), True), pack(fans), pack(seconds), pack(trained[i]), pack(own.count[own.second[i[at]]])))
        block = left.column("block")[0].as_py()
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array([block] * len(out), pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["shard", "block", "firsts", "fans", "seconds", "counts", "words"])

    schema = "shard int, block long, firsts binary, fans binary, seconds binary, counts binary, words binary"
    return documents.select("block", "held", "sizes", "tokens").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(work, schema)


def seat_contexts(context: np.ndarray, customers: np.ndarray, share: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int) -> np.ndarray:
    """Tables of each dish in the restaurants of ``context`` (from 0) by Gibbs sweeps, given the parent's probability of each dish."""
    tables = (customers > 0).astype(np.int64)
    for _ in range(sweeps):
        others = np.bincount(context, tables)[context] - tables
        tables = seat(customers, (STRENGTH + discount * others) * share, discount, rng)
    return tables


def contexts(pairs: DataFrame, shards: int, n: int, sweeps: int = CONTEXT_SWEEPS) -> DataFrame:
    """Restaurants of preceding words, all of a word's in its shard: rows of TO_BLOCK, and, without a block, for each shard of words the ranks (one) of its words here and their tables (two)."""

    def work(table: pa.Table) -> pa.Table:
        shard, low = table.column("shard")[0].as_py(), np.uint64(0xFFFFFFFF)
        keys, counts, words, shares = [], [], [], []
        for r in table.select(["firsts", "fans", "seconds", "counts", "words"]).to_pylist():
            seconds = unpack(r["seconds"]).astype(np.uint64)
            keys.append(np.repeat(unpack(r["firsts"], True), unpack(r["fans"])).astype(np.uint64) << np.uint64(32) | seconds)
            counts.append(unpack(r["counts"]))
            words.append(np.unique(seconds))
            shares.append(unpack(r["words"]))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        customers = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
        word, first = np.unique(np.concatenate(words), return_index=True)
        share = np.concatenate(shares)[first] / max(1, n)
        own = np.searchsorted(word, key & low)
        context = np.cumsum(np.r_[True, key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)]) - 1
        discount = discount_of((customers == 1).sum(), (customers == 2).sum())
        tables = seat_contexts(context, customers, share[own], discount, np.random.default_rng([SEED, CONTEXT, shard]), sweeps)
        total = np.bincount(context, tables).astype(np.int64)
        out = []
        for block, i in zip(table.column("block").to_pylist(), np.split(at, cuts), strict=True):
            here = context[i]
            out.append((block, shard, discount, pack(customers[i]), pack(tables[i]), pack(total[here[np.r_[True, here[1:] != here[:-1]]]]), None))
        sums = np.bincount(own, tables, len(word)).astype(np.int64)
        for to in range(shards):
            i = np.flatnonzero((word % np.uint64(shards) == to) & (sums > 0))
            if len(i):
                out.append((None, to, None, pack((word[i] // np.uint64(shards)).astype(np.int64), True), pack(sums[i]), None, None))
        return to_block(out)

    return pairs.groupBy("shard").applyInArrow(work, TO_BLOCK)


def with_customers(vocab: DataFrame, seated: DataFrame) -> DataFrame:
    """The vocabulary with the customers of its words: the tables that they have in the restaurants of preceding words."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(len(left.column("counts")[0].as_py()) // 8, np.int64)
        for one, two in zip(right.column("one"), right.column("two"), strict=True):
            total[unpack(one.as_py(), True)] += unpack(two.as_py())
        row = left.select(["shard", "words", "counts"])
        row = row.append_column("n", pa.array([int(total.sum())])).append_column("customers", pa.array([total.astype("<i8").tobytes()], pa.binary()))
        return row.append_column("ones", pa.array([int((total == 1).sum())])).append_column("twos", pa.array([int((total == 2).sum())]))

    tables = seated.filter("block IS NULL").select("shard", "one", "two")
    return vocab.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(work, "shard int, words binary, counts binary, n long, customers binary, ones long, twos long")


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that each dish's customers take when they sit down in turn: the first opens one, a later one opens a
    further one with probability weight / (weight + seated - discount * tables)."""
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    most = customers[order]
    seated, n = 1, len(order)
    while True:
        n = int(np.searchsorted(-most[:n], -seated, "left"))  # dishes with further customers
        if not n:
            return tables
        own = order[:n]
        block = 1 if seated < SINGLY else seated // 8
        w = weight[own]
        opens = np.clip(w / (w + seated - discount * tables[own]), 0, 1)
        more = np.minimum(block, customers[own] - seated)
        tables[own] += (rng.random(n) < opens) if block == 1 else rng.binomial(more, opens)
        tables[own] = np.minimum(tables[own], customers[own])
        seated += block


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones + twos else 0.5


class Spelling(ContextCosts):
    """Restaurants of byte contexts: seated customers, and their predictive probabilities as code lengths."""

    def __init__(self, kept: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, sweeps: int = 2):
        size = len(kept)
        self.trie = Trie([codes for codes, _ in kept])
        raw = []
        for k, (codes, n) in enumerate(kept):
            own = np.zeros(len(self.trie.codes[k]), np.int64)
            own[np.searchsorted(self.trie.codes[k], codes)] = n
            raw.append(own)
        codes = self.trie.codes
        context = [np.zeros(len(codes[0]), np.int64)] + [self.trie.node(k - 1, codes[k] >> np.uint64(8)) for k in range(1, size)]
        suffix = [None] + [self.trie.suffix(k, codes[k]) - 1 for k in range(1, size)]
        rooms = [1] + [len(codes[k - 1]) + 1 for k in range(1, size)]
        # n-grams that the tree has no longer form of are customers where they are
        direct = [raw[k] - np.bincount(suffix[k + 1], raw[k + 1], len(codes[k])).astype(np.int64) if k + 1 < size else raw[k] for k in range(size)]
        direct = [np.maximum(d, 0) for d in direct]
        tables = [(d > 0).astype(np.int64) for d in raw]
        customers = [None] * size

        def fill(k):
            customers[k] = direct[k] + (np.bincount(suffix[k + 1], tables[k + 1], len(codes[k])).astype(np.int64) if k + 1 < size else 0)
            tables[k] = np.minimum(np.maximum(tables[k], customers[k] > 0), customers[k])

        def rooms_of(k):
            ones, twos = (customers[k] == 1).sum(), (customers[k] == 2).sum()
            d = discount_of(ones, twos)
            sat, set_ = np.bincount(context[k], customers[k], rooms[k]), np.bincount(context[k], tables[k], rooms[k])
            return d, sat, set_

        def predictive():
            p, back = [], []
            for k in range(size):
                d, sat, set_ = rooms_of(k)
                parent = np.full(len(codes[0]), 1 / 256) if k == 0 else p[k - 1][suffix[k]]
                share = np.where(sat > 0, (STRENGTH + d * set_) / (STRENGTH + sat), 1.0)
                own = np.where(sat > 0, 1 / (STRENGTH + sat), 0)[context[k]] * np.maximum(customers[k] - d * tables[k], 0)
                p.append(own + share[context[k]] * parent)
                back.append(share)
            return p, back

        for k in reversed(range(size)):
            fill(k)
        for _ in range(sweeps):
            p, _ = predictive()
            for k in reversed(range(size)):
                if k + 1 < size:
                    fill(k)
                d, _, set_ = rooms_of(k)
                parent = np.full(len(codes[0]), 1 / 256) if k == 0 else p[k - 1][suffix[k]]
                others = np.maximum(set_[context[k]] - tables[k], 0)
                tables[k] = seat(customers[k], (STRENGTH + d * others) * parent, d, rng)
        p, back = predictive()
        self.escape = [-np.log2(b)[:, None] for b in back]
        self.cost = [np.concatenate([[[8.0 - np.log2(back[0][0])]] if k == 0 else [[0.0]], -np.log2(p[k])[:, None]]) for k in range(size)]


def spelled(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join([w + LAST for w in words]), np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]


def spelling_bits(model: Spelling | None, words: list[bytes]) -> np.ndarray:
    """Code length of each word's spelling; 8 bits a byte without a model."""
    raw, offsets = spelled(words)
    if model is None:
        return 8.0 * np.diff(offsets)
    out = np.zeros(len(words))
    for i, j in C.windows(offsets, 2 << 20):
        out[i:j] = model.bits(raw, offsets[i : j + 1])[:, 0]
    return out


class Sweep:
    """What a sweep over the vocabulary starts from: the spelling model, the discount, all customers and tables."""

    def __init__(self, number: int, spelling: Spelling | None, discount: float, customers: int, tables: int):
        self.number, self.spelling, self.discount, self.customers, self.tables = number, spelling, discount, customers, tables

    def seat(self, shard: int, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables and spelling probability of each word of a shard; the same whenever it is called."""
        base = np.exp2(-spelling_bits(self.spelling, words))
        weight = (STRENGTH + self.discount * self.tables) * base
        return seat(counts, weight, self.discount, np.random.default_rng([SEED, self.number, shard])), base


def _type_grams(words: list[bytes], tables: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the spellings of words that have tables, each weighed by the word's tables."""
    own = np.flatnonzero(tables)
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chosen = [words[i] for i in own.tolist()]
    size = np.fromiter(map(len, chosen), np.int64, len(chosen)) + 1
    pad = bytes(order)
    data = np.frombuffer(b"".join([pad + w + LAST for w in chosen]), np.uint8)
    code = grams(data, order + 1)
    start = np.cumsum(size + order) - size - order
    at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return tally(code[at].astype(np.uint64), np.repeat(tables[own], size))


def sweep(vocab: DataFrame, state: Sweep, order: int, stage: C.Stage) -> tuple[Spelling, int]:
    """One Gibbs sweep: words are seated anew given ``state``; then their tables are seated in the spelling restaurants."""
    spark = vocab.sparkSession
    held = spark.sparkContext.broadcast(state)

    def work(batches):
        for b in batches:
            for shard, words, counts in zip(b.column(0), b.column(1), b.column(2), strict=True):
                own = words.as_py().split(b" ")
                tables, _ = held.value.seat(shard.as_py(), own, np.frombuffer(counts.as_py(), "<i8"))
                code, n = _type_grams(own, tables, order)
                yield pa.RecordBatch.from_arrays([pa.array(["w"] * (len(code) + 1)), pa.array(np.r_[code.astype(np.int64), -1]), pa.array(np.r_[n, tables.sum()])], ["grp", "gram", "n"])

    counts = vocab.select("shard", "words", "customers").mapInArrow(C.tidy(work), "grp string, gram long, n long")
    counts = stage.table(counts.groupBy("grp", "gram").agg(F.sum("n").alias("n")))
    tables = counts.filter("gram = -1").agg(F.sum("n")).first()[0] or 0
    kept = levels(counts.filter("gram >= 0"), order + 1)
    stage.drop(counts)
    held.destroy()
    return (Spelling(kept["w"], np.random.default_rng([SEED, state.number])) if kept else None), int(tables)


def known_mass(vocab: DataFrame, held, n: int) -> list[float]:
    """For each of the ``n`` broadcast states the spelling probability of all training words together."""

    def work(batches):
        for b in batches:
            for words, counts in zip(b.column(0), b.column(1), strict=True):
                seen = np.frombuffer(counts.as_py(), "<i8") > 0
                own = words.as_py().split(b" ")
                yield pa.RecordBatch.from_arrays([pa.array(range(len(held.value)), pa.int32()), pa.array([float(np.exp2(-spelling_bits(m.spelling, own))[seen].sum()) for m in held.value], pa.float64())], ["state", "mass"])

    mass = {r["state"]: r["mass"] for r in vocab.select("words", "counts").mapInArrow(C.tidy(work), "state int, mass double").groupBy("state").agg(F.sum("mass").alias("mass")).collect()}
    return [min(1.0, mass.get(i, 0.0)) for i in range(n)]


def score_documents(docs: DataFrame, order: int = ORDER, sweeps: int = SWEEPS, burn_in: int = BURN_IN, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, perplexity."""
    spark = docs.sparkSession
    stage = C.Stage(spark, "pylm")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // shard_bytes))
    parts = stage.table(blocks(docs, shards, block_bytes))
    vocab = stage.table(vocabulary(parts))
    n, v = (int(x or 0) for x in vocab.agg(F.sum("n"), F.sum("v")).first())
    documents = parts.filter("shard = -1").select("block", "docs", "held", "sizes", "tokens")
    seated = stage.table(contexts(pairs_of_blocks(documents, words_of_blocks(parts, vocab, shards), shards), shards, n))
    counted, vocab = vocab, stage.table(with_customers(vocab, seated))
    stage.drop(counted)
    customers, ones, twos = (int(x or 0) for x in vocab.agg(*[F.sum(c) for c in ("n", "ones", "twos")]).first())
    discount = discount_of(ones, twos)
    states, spelling, tables = [], None, v
    for s in range(sweeps):
        state = Sweep(s, spelling, discount, customers, tables)
        if s >= burn_in:
            states.append(state)
        if s + 1 < sweeps:
            spelling, tables = sweep(vocab, state, order, stage)
    held = spark.sparkContext.broadcast(states)
    new = np.mean([(STRENGTH + x.discount * x.tables) / (STRENGTH + customers) * (1 - m) for x, m in zip(states, known_mass(vocab, held, len(states)), strict=True)])
    unknown = float(np.log10(max(new, 1e-300)))

    def probabilities(shard: int, words: list[bytes], own: np.ndarray) -> np.ndarray:
        p = np.zeros(len(words))
        for state in held.value:
            t, base = state.seat(shard, words, own)
            p += (np.maximum(own - state.discount * t, 0) + (STRENGTH + state.discount * state.tables) * base) / (STRENGTH + state.customers)
        return np.log10(np.maximum(p / max(1, len(held.value)), 1e-300))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scale = np.log10(max(n + 0.1 * (v + 1), 1e-300))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Pairs(left, right, shards)
        kept, opened = np.zeros(len(own.key)), np.zeros(len(own.key))
        for r in right.to_pylist():
            if r["shard"] >= 0:
                i = own.parts[r["shard"]]
                fans = np.unique(own.key[i] >> np.uint64(32), return_counts=True)[1]
                kept[i] = np.maximum(unpack(r["one"]) - r["discount"] * unpack(r["two"]), 0)
                opened[i] = r["discount"] * np.repeat(unpack(r["three"]), fans)
        room = STRENGTH + own.count[own.first]
        seen = own.count > 0

        def logs(words: np.ndarray) -> np.ndarray:
            """log10 of each pair's probability, given those of the words by themselves."""
            parent = np.log10((STRENGTH + opened) / room) + words[own.second]
            return np.where(kept > 0, np.log10(np.maximum(kept / room + 10.0**parent, 1e-300)), parent)

        value = np.column_stack([logs(np.where(seen, own.logp, unknown))[own.at], np.log10(own.count[own.flat] + 0.1) - scale, seen[own.flat], logs(own.logp)[own.at]])
        sums = C.segment_sums(value, np.r_[0, np.cumsum(own.sizes)])
        return pa.table([left.column("docs")[0].values, pa.array(own.held), pa.array(own.sizes), pa.array(sums[:, 2].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 0]), pa.array(sums[:, 3])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "spelled_score"])

    values = words_of_blocks(parts, vocab, shards, probabilities).unionByName(seated.filter("block IS NOT NULL"))
    out = documents.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, spelled_score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "spelled_score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.documents(spark, sf_dir))
