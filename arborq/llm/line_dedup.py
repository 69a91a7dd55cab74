"""Line deduplication by content-defined chunks of lines.

A line ends at a line break, at white space behind one of .!?,;: and behind words of one hash in ``CUT``, so that long paragraphs and texts
without stops have lines too. A rolling hash over the hashes of ``rolled`` neighbouring lines chooses the boundaries: a chunk ends where it is
smaller than at the ``RADIUS`` lines before and after, which depends on nothing but the lines nearby, so a passage is cut alike wherever it
stands, and a chunk has several lines. A chunk of fewer than ``min_words`` words before another such takes in as many of the next ones as it
needs; what stays shorter is no chunk of its own, and goes only where a run of removed chunks is extended over it. A chunk that occurs again anywhere is removed but for its first occurrence (smallest doc_id,
then place), after its bytes have been compared with those of the first. What is removed is then extended to both sides, byte by byte, as far as
the text agrees with that around the first occurrence, in whole words; where the bytes at hand agree to their end, more are fetched until
the texts differ. Of a row whose whole text has the digest of the first occurrence's
text, what is left around its chunks goes by that digest. Every byte removed
equals one at an earlier place, so one copy of a passage always stays.

Results for odd inputs: null text is the empty text and stays empty; texts without a repeated chunk stay as they are; rows that
repeat both identifier and text count as one document; a text of which everything is removed becomes empty, and its row stays;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WINDOW = 1 << 18
#: (rolled, seed) of each tiling: how many lines the rolling hash covers, and its multiplier.
TILINGS = ((2, 0xC2B2AE3D27D4EB4F),)
MIN_WORDS = 8
#: A word in so many ends a line, so that text without stops has lines too.
CUT = 2
#: Lines beyond the next chunk, on either side, that the first comparison sees.
LINES = 3
#: Bytes that the next comparison sees where the first sees no difference; each further one sees four times as many.
WIDER = 1 << 9
#: A boundary's rolling hash is the smallest of those so many lines before and after it.
RADIUS = 2
#: Behind the end of any text.
END = (1 << 31) - 2
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?,;:", np.uint8))
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0xD1342543DE82EF95
_INVERSE = pow(_ODD, -1, 1 << 64)
_kept: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(factor: int, n: int) -> np.ndarray:
    """1, factor, factor squared, ...: n + 1 of them, kept by each worker for windows of ordinary size."""
    held = _kept.get(factor)
    if held is None or len(held) <= n:
        held = np.full(max(n, WINDOW) + 1, factor, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= WINDOW:
            _kept[factor] = held
    return held[: n + 1]


class _Hashes:
    """Hashes of any byte ranges of one array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_ODD, len(data))[:-1], out=self.sums[1:])
        self.back = _powers(_INVERSE, len(data))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def chunks(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, tilings=TILINGS):
    """Of texts laid end to end: (text, start, end, next, hash, before, after) of each chunk.

    next is where the line after it starts; before and after bound the bytes to compare around it: LINES lines beyond the next chunk to each side.
    """
    none = np.zeros((0, 7), np.int64)
    blank = (data - np.uint8(9) < 5) | (data == 32)
    heads, tails = ~blank, ~blank
    heads[1:] &= blank[:-1]
    tails[:-1] &= blank[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    heads[full] |= ~blank[full]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    tails[ends] |= ~blank[ends]
    word, stop = np.flatnonzero(heads), np.flatnonzero(tails) + 1
    if not len(word):
        return none
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(word, offsets)))
    hashes = _Hashes(data)
    last = _STOPS[data[stop - 1]] | (hashes(word, stop) & np.uint64(CUT - 1) == 0)
    broken = np.searchsorted(word, np.flatnonzero(data == 10))
    last[broken[broken > 0] - 1] = True
    last[:-1] |= text[1:] != text[:-1]
    last[-1] = True
    tail = np.flatnonzero(last)  # the last word of each line, and the first
    head = np.r_[0, tail[:-1] + 1]
    start, end, text = word[head], stop[tail], text[head]
    line = hashes(start, end)
    same_before, same_after = np.r_[False, text[1:] == text[:-1]], np.r_[text[1:] == text[:-1], False]
    out = [none]
    for rolled, seed in tilings:
        r = line * np.uint64(seed | 1)
        for k in range(1, rolled):
            # lines of the text before do not count: the same text is cut alike whatever stands before it in a batch
            r[k:] += np.where(text[k:] == text[:-k], line[:-k] * np.uint64((seed | 1) * pow(3, k) & ((1 << 64) - 1)), np.uint64(0))
        r = _mix(r)
        low = same_before & same_after
        for k in range(1, RADIUS + 1):  # neighbours in other texts do not count
            near = text[k:] == text[:-k]
            low[k:] &= ~near | (r[k:] < r[:-k])
            low[:-k] &= ~near | (r[:-k] < r[k:])
        top = low | ~same_after
        lo, hi = np.flatnonzero(np.r_[True, top[:-1]]), np.flatnonzero(top)
        short = tail[hi] + 1 - head[lo] < min_words
        both = np.flatnonzero(short & np.r_[short[1:] & (text[lo[1:]] == text[lo[:-1]]), False][: len(short)])
        to = np.searchsorted(tail[hi] + 1, head[lo[both]] + min_words)  # the first chunk with enough words before its end
        both, to = both[to < len(hi)], to[to < len(hi)]
        same = text[hi[to]] == text[lo[both]]
        hi, tops = hi.copy(), hi
        hi[both[same]] = tops[to[same]]
        use = (hi > lo) & (tail[hi] + 1 - head[lo] >= min_words)
        lo, hi = lo[use], hi[use]
        if not len(lo):
            continue
        a, b, t = start[lo], end[hi], text[lo]
        nxt = np.where(same_after[hi], np.r_[start, len(data)][hi + 1], offsets[t + 1])
        early, late = np.searchsorted(text, t), np.searchsorted(text, t, "right") - 1
        # the chunks before and after that do not overlap it
        prior, later = np.searchsorted(hi, lo) - 1, np.searchsorted(lo, hi, "right")
        at = np.maximum(prior, 0)
        before = np.where((prior >= 0) & (t[at] == t), np.maximum(lo[at] - LINES, early), early)
        at = np.minimum(later, len(lo) - 1)
        after = np.where((later < len(lo)) & (t[at] == t), np.minimum(hi[at] + LINES, late), late)
        left = np.where(before == early, offsets[t], start[before])
        right = np.where(after == late, offsets[t + 1], end[after])
        out.append(np.column_stack([t, a, b, nxt, hashes(a, b).view(np.int64), left, right]))
    return np.concatenate(out)


def _windows(batch):
    """(first row, bytes, offsets, the bytes as an array) of a bounded window of whole texts at a time."""
    offsets, data = C.column_bytes(batch.column(1))
    for i, j in C.windows(offsets, WINDOW):
        part = data[offsets[i] : offsets[j]]
        if len(part):
            yield i, part.tobytes(), offsets[i : j + 1] - offsets[i], part


def repeated_chunks(docs: DataFrame, stage: C.Stage, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), from, to: byte ranges of repeated chunks that are not the first of their kind."""
    spark = docs.sparkSession
    rows = C.id_and_text(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def occurrences(batches):
        for b in batches:
            for _, _, offsets, part in _windows(b):
                value, n = np.unique(chunks(part, offsets, min_words)[:, 4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["hash", "n"])

    seen = rows.select("doc_id", "text").mapInArrow(C.tidy(occurrences), "hash long, n long")
    index = stage.table(seen.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash"))
    held = spark.sparkContext.broadcast(C.filter_bits(index, "hash"))
    stage.drop(index)

    def candidates(batches):
        for b in batches:
            for i, raw, offsets, part in _windows(b):
                c = chunks(part, offsets, min_words)
                c = c[C.maybe_in(held.value, c[:, 4])]
                if len(c):
                    base, who = offsets[c[:, 0]], pa.array(i + c[:, 0])
                    body = pa.array([raw[x:y] for x, y in c[:, 1:3].tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c[:, 4]), b.column(0).take(who), b.column(2).take(who), pa.array(c[:, 1] - base), pa.array(c[:, 2] - base), pa.array(c[:, 3] - base), body], ["hash", "doc_id", "digest", "from", "end", "to", "body"])

    found = rows.select("doc_id", "text", "digest").mapInArrow(C.tidy(candidates), f"hash long, doc_id {kind}, digest long, from long, end long, to long, body binary")
    found = stage.table(found)
    total = max(1, found.count())
    firsts = found.groupBy("hash").agg(F.min(F.struct("doc_id", F.col("from").alias("at"), "digest", "body")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = C.join_by_group(found, stage.table(firsts), ["hash"], "n", total, "inner")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("from") == F.col("first.at"))
    ranges = joined.filter(~is_first & (F.col("body") == F.col("first.body"))).select("doc_id", "digest", "hash", "from", "end", "to", F.struct("first.doc_id", "first.at", "first.digest").alias("first"))
    # Ranges that touch or overlap are one run. A range that starts later ends later; rows that share identifier and text give a range twice.
    own = W.partitionBy("doc_id", "digest").orderBy("from", "to", "hash")
    starts = F.coalesce(F.max("to").over(own.rowsBetween(W.unboundedPreceding, -1)) < F.col("from"), F.lit(True))
    ranges = ranges.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(own))
    edge = F.struct("hash", "from", "end", "to", "first")
    runs = ranges.groupBy("doc_id", "digest", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.min_by(edge, "from").alias("left"), F.max_by(edge, "to").alias("right"), F.count(F.lit(1)).cast("int").alias("n"))
    # of a text equal to that of the first occurrence the ends go too: there is nothing around them to compare
    whole = lambda side: (F.col(f"{side}.first.digest") == F.col("digest")) & (F.col(f"{side}.first.at") == F.col(f"{side}.from"))
    runs = runs.withColumns({"from": F.when(whole("left"), F.lit(0).cast("long")).otherwise(F.col("from")), "to": F.when(whole("right"), F.lit(END).cast("long")).otherwise(F.col("to")), "left": F.when(~whole("left"), F.col("left")), "right": F.when(~whole("right"), F.col("right"))})
    runs = stage.table(runs)
    held.unpersist()
    stage.drop(found)
    grown = stage.table(_extended(rows, runs, stage, min_words))
    return runs.select("doc_id", "digest", "from", "to", "n").unionByName(grown.withColumn("n", F.lit(0)))


def _at_word(text: bytes, i: int) -> bool:
    """Whether a word ends or starts there: at blanks, the text's ends, and before letters of scripts without blanks."""
    return i in (0, len(text)) or bool(_BLANK[text[i]] or _BLANK[text[i - 1]]) or text[i] >= 0xE3


def _common(n: int, equal) -> int:
    """The largest k up to n for which equal(k) holds; it holds for all smaller ones."""
    if equal(n):
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if equal(mid) else (low, mid)
    return low


def _longest(mine: bytes, other: bytes, back: bool) -> int:
    """Length of the longest common prefix, or suffix."""
    same = (lambda n: not n or mine[-n:] == other[-n:]) if back else (lambda n: mine[:n] == other[:n])
    return _common(min(len(mine), len(other)), same)


def agreement(mine: bytes, other: bytes) -> int:
    """Length of the longest common prefix that ends between words of both."""
    k = _longest(mine, other, False)
    while k and not (_at_word(mine, k) and _at_word(other, k)):
        k -= 1
    return k


def agreement_before(mine: bytes, other: bytes) -> int:
    """Length of the longest common suffix that starts between words of both."""
    k = _longest(mine, other, True)
    while k and not (_at_word(mine, len(mine) - k) and _at_word(other, len(other) - k)):
        k -= 1
    return k


def _agrees_on(mine: bytes, other: bytes, whole: bool, other_whole: bool, back: bool) -> bool:
    """Whether two windows agree up to the end of one that does not reach its text's end, so that more has to be compared."""
    k = _longest(mine, other, back)
    return not (k < min(len(mine), len(other)) or (k == len(mine) and whole) or (k == len(other) and other_whole))


def _extended(rows: DataFrame, runs: DataFrame, stage: C.Stage, min_words: int) -> DataFrame:
    """doc_id, digest, from, to: what each run is extended by to either side, as far as the text around the first occurrence agrees.

    The first windows compared are a few lines long. Ends whose windows agree as a whole are compared again in windows of WIDER bytes, and so on, until
    the texts differ or one ends.
    """
    end = lambda side, name: F.when(F.col(name).isNotNull(), F.struct(F.lit(side).cast("long").alias("side"), f"{name}.*"))
    sides = F.explode(F.array_compact(F.array(end(-1, "left"), end(0, "right"))))
    ends = stage.table(runs.select("doc_id", "digest", sides.alias("e")).select("doc_id", "digest", "e.*"))
    found, used = _compared(ends, _near_chunks(rows, ends, min_words), stage)
    stage.drop(ends, *used)
    parts, size, texts = [found.filter("NOT open")], WIDER, None
    while not (ends := found.filter("open").select(ends.columns)).isEmpty():
        texts = stage.table(_texts_of(rows, ends)) if texts is None else texts  # few texts have such ends, and fewer from round to round
        found, used = _compared(ends, _slices(texts, ends, size), stage)
        stage.drop(*used)
        parts, size = [*parts, found.filter("NOT open")], size * 4
    if texts is not None:
        stage.drop(texts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    back = F.col("side") == -1
    start, stop = F.when(back, F.col("from") - F.col("size")).otherwise(F.col("end")), F.when(back, F.col("from")).otherwise(F.greatest("to", F.col("end") + F.col("size")))
    return out.select("doc_id", "digest", start.alias("from"), stop.alias("to"))


def _filtered(rows: DataFrame, ends: DataFrame):
    """A broadcast filter of the digests of texts that have ends, or first occurrences that ends are compared with."""
    return rows.sparkSession.sparkContext.broadcast(C.filter_bits(ends.select(F.explode(F.array("digest", "first.digest")).alias("d")).distinct(), "d"))


def _near_chunks(rows: DataFrame, ends: DataFrame, min_words: int) -> DataFrame:
    """hash, side, doc_id, digest, from, near (bytes around the chunk), whole (they reach the text's end) of chunks that have ends or are first."""
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    place = lambda at: F.col("hash").bitwiseXOR(F.col(at)).bitwiseXOR(F.col("side"))
    held = spark.sparkContext.broadcast(C.filter_bits(ends.select(F.explode(F.array(place("from"), place("first.at"))).alias("place")), "place"))
    texts = _filtered(rows, ends)

    def around(batches):
        for b in batches:
            b = b.filter(pa.array(C.maybe_in(texts.value, b.column(2).to_numpy())))
            for i, raw, offsets, part in _windows(b):
                c = chunks(part, offsets, min_words)
                at = c[:, 1] - offsets[c[:, 0]]
                for side, bounds in ((-1, [5, 1]), (0, [2, 6])):
                    use = np.flatnonzero(C.maybe_in(held.value, c[:, 4] ^ at ^ side))
                    if len(use):
                        text = c[use, 0]
                        who = pa.array(i + text)
                        near = pa.array([raw[x:y] for x, y in c[use][:, bounds].tolist()], pa.binary())
                        whole = c[use, 5] == offsets[text] if side else c[use, 6] == offsets[text + 1]
                        yield pa.RecordBatch.from_arrays([pa.array(c[use, 4]), pa.array(np.full(len(use), side)), b.column(0).take(who), b.column(2).take(who), pa.array(at[use]), near, pa.array(whole)], ["hash", "side", "doc_id", "digest", "from", "near", "whole"])

    return rows.select("doc_id", "text", "digest").mapInArrow(C.tidy(around), f"hash long, side long, doc_id {kind}, digest long, from long, near binary, whole boolean")


def _texts_of(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, digest, text (bytes) of the texts that ends or first occurrences are in, and of some more."""
    held = _filtered(rows, ends)

    def work(batches):
        for b in batches:
            yield b.filter(pa.array(C.maybe_in(held.value, b.column(1).to_numpy())))

    texts = rows.select("doc_id", "digest", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, text binary")


def _slices(texts: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """As ``_near_chunks``, of the ``size`` bytes next to each chunk."""
    length = F.col("end") - F.col("from")
    own = ends.select("hash", "side", F.col("doc_id").alias("doc"), F.col("digest").alias("own"), "from", length.alias("n"))
    first = ends.select("hash", "side", F.col("first.doc_id").alias("doc"), F.col("first.digest").alias("own"), F.col("first.at").alias("from"), length.alias("n"))
    wanted = own.unionByName(first).distinct()
    j = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("doc")) & (F.col("digest") == F.col("own")))
    back, total = F.col("side") == -1, F.octet_length("text").cast("long")
    start = F.when(back, F.greatest(F.lit(0).cast("long"), F.col("from") - size)).otherwise(F.col("from") + F.col("n"))
    stop = F.when(back, F.col("from")).otherwise(F.least(total, F.col("from") + F.col("n") + size))
    near = F.substring("text", (start + 1).cast("int"), (stop - start).cast("int"))
    return j.select("hash", "side", "doc_id", "digest", "from", near.alias("near"), F.when(back, start == 0).otherwise(stop == total).alias("whole"))


def _compared(ends: DataFrame, texts: DataFrame, stage: C.Stage) -> tuple[DataFrame, list[DataFrame]]:
    """ends with size, the bytes on which the text next to the chunk agrees with that of the first occurrence, and open: whether that may be more; and the tables used on the way."""
    texts = stage.table(texts)
    own = lambda df, *names: df.select(*[F.col(c).alias("_" + c) if c in ("hash", "side", "doc_id", "digest", "from") else F.col(c) for c in names])
    same = (texts["hash"] == F.col("_hash")) & (texts["side"] == F.col("_side")) & texts["doc_id"].eqNullSafe(F.col("_doc_id")) & (texts["from"] == F.col("_from"))
    mine = texts.join(own(ends, "hash", "side", "doc_id", "digest", "from", "end", "to", "first").hint("shuffle_hash"), same & (texts["digest"] == F.col("_digest"))).drop("_hash", "_side", "_doc_id", "_digest", "_from")
    firsts = ends.groupBy("hash", "side").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")).select("hash", "side", F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("from"), "n")
    there = texts.join(own(firsts, "hash", "side", "doc_id", "from", "n").hint("shuffle_hash"), same)
    # one text, where rows share an identifier
    there = stage.table(there.groupBy("hash", "side").agg(F.min_by(F.struct("near", "whole"), "digest").alias("other"), F.max("n").alias("n")))
    pairs = C.join_by_group(mine, there, ["hash", "side"], "n", max(1, ends.count()), "inner")

    def work(batches):
        for b in batches:
            side = b.column(b.schema.get_field_index("side")).to_pylist()
            both = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("near", "near_there", "whole", "whole_there")), side, strict=True))
            size = np.fromiter((agreement_before(x, y) if s else agreement(x, y) for x, y, _, _, s in both), np.int64, len(both))
            more = np.fromiter((_agrees_on(*x[:4], bool(x[4])) for x in both), bool, len(both))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(size), pa.array(more)], [*names, "size", "open"])

    names = ends.columns
    kinds = ", ".join(f"`{c}` {ends.schema[c].dataType.simpleString()}" for c in names)
    both = pairs.select(*names, "near", "whole", F.col("other.near").alias("near_there"), F.col("other.whole").alias("whole_there"))
    return stage.table(both.mapInArrow(C.tidy(work), f"{kinds}, size long, open boolean")), [texts, there]


def without_ranges(text, ranges):
    """The text column without the union of the byte ranges (array of from, to)."""
    raw = text.cast("binary")
    cut = lambda at, end: F.substring(raw, (at + 1).cast("int"), F.greatest(end - at, F.lit(0)).cast("int"))
    step = lambda acc, r: F.struct(F.greatest(acc["at"], r["from"], r["to"]).alias("at"), F.when(r["from"] > acc["at"], F.concat(acc["out"], cut(acc["at"], r["from"]))).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))
    return F.aggregate(F.sort_array(ranges), start, step, lambda acc: F.concat(acc["out"], cut(acc["at"], F.octet_length(text).cast("long")))).cast("string")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text cleaned, and removed_chunks."""
    spark = docs.sparkSession
    stage = C.Stage(spark, "lines")
    ranges = repeated_chunks(docs, stage, min_words, id_col, text_col)
    doc, digest, own, spans, removed = C.free_names(docs, "doc", "digest", "own", "ranges", "removed")
    per_doc = ranges.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("from", "to")).alias(spans), F.sum("n").cast("int").alias(removed))
    per_doc = per_doc.select(F.col("doc_id").alias(doc), F.col("digest").alias(digest), spans, removed).hint("shuffle_hash")  # no sort of whole texts
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.withColumn(own, F.xxhash64(text)).join(per_doc, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(digest)), "left")
    clean = F.when(F.col(spans).isNull(), text).otherwise(without_ranges(text, F.col(spans)))
    return joined.withColumn(text_col, clean).select(*docs.columns, F.coalesce(removed, F.lit(0)).alias("removed_chunks"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "text", F.greatest("removed_chunks", F.lit(0)).alias("removed_chunks"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks go; every document stays, with its length counted anew.

    A null text becomes the empty text; an empty one, or one of which everything goes, stays as an empty row; rows that repeat identifier and text lose the same;
    columns of any names stay as they are; an empty table stays empty.
    """
    out = line_dedup(docs).drop("removed_chunks")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
