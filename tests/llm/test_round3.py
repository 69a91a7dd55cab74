"""Decontamination, session closing and vector codes against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from arborq.llm import common as C
from arborq.llm import decontaminate, session_closing, vector_codes

rng = random.Random(1)


@pytest.fixture(autouse=True)
def seeded(request):
    rng.seed(request.node.name)


# Decontamination --------------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(texts, items, window=10):
    patterns = defaultdict(set)
    for name, text in items:
        w = words_of(text)
        for j in range(len(w) - min(window, len(w)) + 1 if w else 0):
            patterns[tuple(w[j : j + window])].add(name)
    out = []
    for t in texts:
        w, hit, own = words_of(t), set(), set()
        for k in {len(p) for p in patterns}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in patterns:
                    own |= patterns[tuple(w[j : j + k])]
                    hit |= set(range(j, j + k))
        out.append((len(w), len(hit), sorted(own)))
    return out


def passages():
    prose = lambda n: [rng.choice(("the", "of", "a", "Ünï", "x9", "東京", "end", "B")) for _ in range(n)]
    items = [(str(i), " ".join(prose(rng.choice((3, 9, 10, 11, 40))))) for i in range(12)] + [("7", "one more text"), ("", None), ("w", "!?"), ("s", "solo")]
    texts = [None, "", "!!", "Solo", "solo.", "so lo", " ".join(prose(20_000))]
    for _, t in items:
        w = (t or "").split()
        texts += [" ".join(prose(7) + w + prose(9)), "-".join(w).upper(), ", ".join(w[:-1]), " ".join(w + w)]
    return texts, items


@pytest.mark.parametrize("window", [10, 2, 1])
def test_search_finds_every_occurrence(window):
    """Few different words, so windows overlap, repeat and share their ends; texts lie one behind the other without a gap."""
    texts, items = passages()
    s = decontaminate.Searcher(items, window)
    raw = [(t or "").encode() for t in texts]
    n, ranges, found = s.search(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    got = [(int(n[k]), decontaminate.covered(ranges.get(k, [])), sorted(s.names[x] for x in found.get(k, ()))) for k in range(len(texts))]
    assert got == plain_hits(texts, items, window)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_in_one_and_in_many_passes(spark, block_bytes):
    """Repeated and null identifiers, rows that repeat, columns of other names; a benchmark of several blocks gives the same rows."""
    texts, items = passages()
    texts += [texts[8]] * 3
    ids = [*range(len(texts) - 3), 8, 8, None]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, items int, ranges string").repartition(3)
    bench = spark.createDataFrame([(None if i == "" else i, t) for i, t in items], "item_id string, text string")
    got = decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    pairs = lambda r: list(zip(r[::2], r[1::2], strict=True))
    have = sorted(((r.doc_id, r.n_words, decontaminate.covered(pairs(r.ranges)), list(r["items"])) for r in got), key=key)
    assert have == sorted(((i, *x) for i, x in zip(ids, plain_hits(texts, items), strict=True)), key=key)
    assert decontaminate.contamination(docs.limit(0), bench, block_bytes=block_bytes).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.ranges for r in none)


def test_op11_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = sorted(tuple(r) for r in decontaminate.op11_benchmark_decontamination(spark, sf).collect())
    want = plain_hits([r.text for r in docs], [(str(r.item_id), r.text) for r in bench])
    assert got == sorted((r.doc_id, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for r, (n, h, i) in zip(docs, want, strict=True))


# Session closing ----------------------------------------------------------------------------------------------------------------

T0 = datetime(2024, 1, 1)


def micros(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def plain_sessions(rows, batches, delay):
    """Sessions of clean rows (click, us, arrived, client), batch by batch."""
    hour, gap = 3600 * 10**6, 1800 * 10**6
    hours = [a // hour for _, _, a, _ in rows if a is not None]
    lo, hi = min(hours, default=0), max(hours, default=0)
    dealt = defaultdict(list)
    for i, us, a, c in rows:
        b = batches - 1 if a is None else batches * (a // hour - lo) // (hi - lo + 1)
        if b < batches - 1 and zlib.crc32(f"{c}:{us // hour}".encode()) % 5 == 0:
            b += 1
        dealt[b].append((c, us, zlib.crc32(str(i).encode())))
    bound = top = None
    held, out = defaultdict(list), []
    for b in range(batches):
        new = defaultdict(list)
        for c, us, k in dealt[b]:
            if bound is None or us >= bound:
                new[c].append([us, us, 1, k, 0, 0])
            top = us if top is None else max(top, us)
        for c in new:
            merged = []
            for x in sorted([[*x[:5], 1] for x in held[c]] + new[c]):
                if merged and x[0] - merged[-1][1] <= gap:
                    r = merged[-1]
                    r[1] = max(r[1], x[1])
                    r[2:] = [p + q for p, q in zip(r[2:], x[2:], strict=True)]
                else:
                    merged.append(list(x))
            for r in merged:
                r[4] += max(0, r[5] - 1)
            held[c] = merged
        bound = None if top is None else top - delay
        for c, own in held.items():
            done = [r for r in own if b == batches - 1 or (bound is not None and r[1] + gap < bound)]
            out += [(c, *r[:5], b + 1) for r in done]
            held[c] = [r for r in own if r not in done]
    return sorted(out)


def clicks(n, hours, clients):
    """Clicks of a few clients at round and odd times, some late, some an hour boundary apart, some exactly a gap apart."""
    rows, us = [], 0
    for i in range(n):
        us = rng.randrange(hours * 3600) * 10**6 + rng.choice((0, 0, 0, 1, 999, 1000, 500_000))
        late = rng.choice((0, 0, 0, 0, 3600, 40 * 3600, 100 * 3600)) * 10**6
        rows.append((i, T0 + timedelta(microseconds=us), T0 + timedelta(microseconds=us + late + 10**6), rng.randrange(clients)))
        if i % 7 == 0:
            rows.append((n + i, T0 + timedelta(microseconds=us + 1800 * 10**6 + rng.choice((-1, 0, 1))), T0 + timedelta(microseconds=us + late), rows[-1][3]))
    return rows


def test_sessions_against_plain_python(spark, tmp_path):
    """Bridged sessions, repeated clicks, nulls, clicks at a bound and a gap exactly, columns named like working ones."""
    rows = clicks(1500, 240, 4)
    edge = [(10**6 + i, T0 + timedelta(hours=h, microseconds=u), T0 + timedelta(hours=h + d), 99) for i, (h, u, d) in enumerate([(0, 0, 0), (100, 0, 0), (52, 0, 60), (51, 3_599_999_999, 60), (150, 0, 0), (102, 0, 60), (101, 1, 70), (239, 0, 0)])]
    rows += edge
    broken = [(5 * 10**6, None, T0, 1), (5 * 10**6 + 1, T0, T0, None), (None, T0, T0, 1), *rows[:40], (7 * 10**6, T0 + timedelta(hours=238), None, 2)]
    table = [(*r, "k", 1) for r in rows + broken]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, n string, batch int")
    clean = {r[0]: (r[0], micros(r[1]), r[2] and micros(r[2]), r[3]) for r in rows + broken if None not in (r[0], r[1], r[3])}
    want = plain_sessions(list(clean.values()), 10, session_closing.DELAY)
    got = sorted(tuple(r) for r in session_closing.sessions(df).collect())
    assert got == want and sum(r[5] for r in want) > 20 and len({r[6] for r in want}) > 4


def test_sessions_of_an_empty_table_and_settings_stay(spark):
    before = {k: spark.conf.get(k, None) for k in session_closing._CONF}
    df = spark.createDataFrame([], "click_id long, ts timestamp, arrived_at timestamp, client_id long")
    assert session_closing.sessions(df, batches=2).count() == 0
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_slot_sums_bound_a_hot_client():
    """A client's rows become one a slot of half an hour, however many there are and however batches cut them."""
    import pyarrow as pa

    us = np.sort(np.random.default_rng(0).integers(0, 10 * session_closing.GAP, 50_000))
    parts = [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 7)), pa.array(x), pa.array(np.ones(len(x), np.int64))], ["client_id", "us", "crc"]) for x in np.array_split(us, 9)]
    out = pa.Table.from_batches(list(session_closing.slot_sums(iter(parts)))).to_pylist()
    sums = list(session_closing.PART.iter_unpack(out[0]["sums"]))
    assert len(out) == 1 and len(sums) == 10 and sum(x[2] for x in sums) == 50_000 and all(x[1] - x[0] < session_closing.GAP for x in sums)


# Vector codes -----------------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    m = np.array([[math.floor(1024 * x) for x in v] for _, v in rows]).astype(np.int64)
    p = np.split(np.pad(m, ((0, 0), (0, -m.shape[1] % parts))), parts, axis=1)
    books = [x[:entries].copy() for x in p]

    def near(x, b):
        d = ((x[:, None, :] - b[None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for k in range(parts):
            which, _ = near(p[k], books[k])
            for e in set(which.tolist()):
                books[k][e] = p[k][which == e].sum(0) // (which == e).sum()
    final = [near(p[k], books[k]) for k in range(parts)]
    return [(i, [int(f[0][j]) for f in final], int(sum(f[1][j] for f in final))) for j, (i, _) in enumerate(rows)], np.array(books)


@pytest.mark.parametrize("entries,width,grid", [(16, 8, 3), (256, 12, 4), (64, 7, 1000)])
def test_vector_codes_against_plain_python(spark, entries, width, grid):
    """A coarse grid of values makes many equal distances and equal entries, so ties decide; floors of negative sums; a width that parts don't divide."""
    rows = [(i, [rng.randrange(-grid, grid + 1) / 1024 * 1.5 for _ in range(width)]) for i in range(400)]
    broken = [(1000, None), (1001, [None] * width), (1002, [float("nan")] * width), (1003, [float("inf")] * width), (1004, [1.0]), (1005, [1e9] * width)]
    df = spark.createDataFrame([(i, v, i % 3 or None, 1, "x") for i, v in rows + broken], "vec_id long, embedding array<float>, label int, n int, ints string").repartition(5)
    coded, books = vector_codes.compress(df, parts=4, entries=entries, rounds=4)
    floats = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want, want_books = plain_codes(floats, 4, entries, 4)
    assert sorted((r.vec_id, list(r.codes), r.error) for r in coded.collect()) == want
    assert (books == want_books).all()


def test_tree_search_is_exact():
    g = np.random.default_rng(3)
    for n, dim, top in ((1, 3, 5), (9, 1, 2), (200, 4, 3), (256, 16, 50), (50, 2, 1)):
        entries, points = g.integers(-top, top, (n, dim)), g.integers(-top * 2, top * 2, (500, dim))
        which, far = vector_codes.Tree(entries).nearest(points)
        d = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (which == d.argmin(1)).all() and (far == d.min(1)).all()


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert coded.count() == 0 and coded.columns == ["vec_id", "label", "codes", "error"] and not books.size
    same = spark.createDataFrame([(i // 2, [0.5, -0.25], None) for i in range(6)] + [(None, [0.5, -0.25], 1)], schema)
    coded, _ = vector_codes.compress(same)
    assert [list(r.codes) for r in coded.collect()] == [[0] * 4] * 7 and {r.error for r in coded.collect()} == {0}


def test_op13_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding))
    want, books = plain_codes([r[:2] for r in rows], 4, 256, 4)
    total = defaultdict(int)
    for (_, _, label), (_, _, e) in zip(rows, want, strict=True):
        total[label] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    got = sorted(tuple(r) for r in vector_codes.op13_vector_codes(spark, sf).collect())
    assert got == [(i, "".join(f"{c:02x}" for c in codes), e, total[r[2]], digest) for r, (i, codes, e) in zip(rows, want, strict=True)]
    assert C.BATCH_ROWS


# Near copies of the pipeline -----------------------------------------------------------------------------------------------------


def test_planted_near_copies_are_found(spark):
    """Of documents with a few words changed, put in or taken out, all that stay at a Jaccard of 0.8 of five-word shingles share a class with their original; no others do."""
    from arborq.llm import simhash

    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) >= 40]
    planted, words = [], "alpha beta gamma delta".split()
    for k, r in enumerate(docs * 3):
        w = r.text.split()
        for _ in range(rng.choice((1, 1, 2, 3, max(1, len(w) // 60)))):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1))] = [rng.choice(words)] * rng.choice((0, 1))
        planted.append((10**6 + k, r.doc_id, " ".join(w)))
    table = spark.createDataFrame([(r.doc_id, r.text) for r in docs] + [(i, t) for i, _, t in planted], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_classes(table).collect()}
    text = {r.doc_id: r.text for r in docs}
    share = lambda a, b: len(a & b) / len(a | b)
    sets = lambda t: set(simhash.shingles(t.encode()).tolist())
    alike = [(i, o) for i, o, t in planted if share(sets(t), sets(text[o])) >= 0.8]
    assert len(alike) > 100 and all(found[i] == found[o] for i, o in alike)
