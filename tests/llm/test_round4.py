"""Hours of far times, and the fingerprints of the pipeline's near dedup stage."""

import zlib

import numpy as np
from arborq.llm import session_closing, simhash
from pyspark.sql import functions as F


def test_batches_of_times_in_far_and_early_years_are_exact(spark):
    hour = session_closing.HOUR
    at = [k * hour + d for k in (61_000_000, 61_000_001, 61_000_037, -500_000, 0, 472_000) for d in (-1, 0, 1)]
    rows = [(us, a) for us in at for a in at]
    lo, hi = min(at) // hour, max(at) // hour
    df = spark.createDataFrame(rows, "us long, arrived long")
    got = df.select("us", "arrived", session_closing.batch_of(F.col("arrived"), F.col("us"), F.lit(12), lo, hi, 10).alias("b")).collect()

    def want(us, a):
        b = 10 * (a // hour - lo) // (hi - lo + 1)
        return b + (b < 9 and zlib.crc32(f"12:{us // hour}".encode()) % 5 == 0)

    assert [r.b for r in got] == [want(r.us, r.arrived) for r in got]


def test_near_dedup_stage_finds_candidates_by_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
    fp = lambda t: simhash.fingerprint(t.encode(), simhash.WORDS)
    base = " ".join(words)
    near = next(t for i in range(200) if 0 < (fp(base) ^ fp(t := base + f" more{i}")).bit_count() <= 2)
    same = next(t for i in range(2000) if fp(base) == fp(t := base + f" other{i}"))
    far = " ".join(reversed(words))
    monkeypatch.setattr(simhash, "bands", lambda hashes: np.zeros(0, np.uint64))
    docs = spark.createDataFrame(list(enumerate([base, near, far, same])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0}
