"""Restaurants of preceding words in the language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from arborq.llm import pylm

rng = random.Random(8)
VOCABULARY = [f"w{i}" for i in range(40)]
TEXTS = [" ".join(rng.choice(VOCABULARY[: rng.choice((3, 10, 40))]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
TRAINED = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(TEXTS))]


def tokens(text):
    return [*text.encode().split(), pylm.END]


def test_numbers_and_words_are_packed_without_loss():
    for a in ([], [0], [0, 3, 9], [5, 5, 1 << 31], [0, 1 << 40]):
        a = np.array(a, np.int64)
        assert (pylm.unpack(pylm.pack(a)) == a).all() and (pylm.unpack(pylm.pack(a, True), True) == a).all()
    assert (pylm.unpack(pylm.pack(np.array([7, -2, 3]))) == [7, -2, 3]).all()
    assert pylm.unpack_words(pylm.pack_words([b"a", b"\xc3\xa9"])) == [b"a", b"\xc3\xa9"]


def test_pairs_are_counted_over_blocks_and_scores_follow_from_their_tables(spark):
    shards, want = 5, Counter()
    for text, trained in zip(TEXTS, TRAINED, strict=True):
        t = tokens(text)
        want.update(zip([pylm.END, *t], t, strict=False) if trained else [])
    parts = pylm.blocks(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(2), shards, 1500).cache()
    vocab = pylm.vocabulary(parts).cache()
    n = vocab.groupBy().sum("n").first()[0]
    assert n == sum(want.values())
    names = {k * shards + r.shard: w for r in vocab.collect() for k, w in enumerate(bytes(r.words).split(b" "))}
    documents = parts.filter("shard = -1")
    words = pylm.words_of_blocks(parts, vocab, shards)
    seated = pylm.contexts(pylm.pairs_of_blocks(documents, words, shards), shards, n).cache()
    rows = documents.count()
    assert rows > 2
    left, right, back = documents.toArrow(), words.toArrow(), seated.toArrow()
    of = lambda table, block: table.filter([x == block for x in table.column("block").to_pylist()])
    got, tables, total = {}, {}, {}
    for block in left.column("block").to_pylist():
        own = pylm.Pairs(of(left, block), of(right, block), shards)
        for r in of(back, block).to_pylist():
            i = own.parts[r["shard"]]
            pairs = [(names[int(k) >> 32], names[int(k) & 0xFFFFFFFF]) for k in own.key[i]]
            for at, pair in enumerate(pairs):
                c, t = int(pylm.unpack(r["one"])[at]), int(pylm.unpack(r["two"])[at])
                assert got.setdefault(pair, c) == c and tables.setdefault(pair, t) == t
            for u, t in zip(dict.fromkeys(u for u, _ in pairs), pylm.unpack(r["three"]).tolist(), strict=True):
                assert total.setdefault(u, t) == t
    assert {k: c for k, c in got.items() if c} == dict(want)
    assert all((t > 0) == (got[k] > 0) and t <= got[k] for k, t in tables.items()) and any(1 < t < got[k] for k, t in tables.items())
    opened, customers = Counter(), Counter()
    for (u, w), t in tables.items():
        opened[u] += t
        customers[w] += t
    assert {u: t for u, t in total.items() if t} == {u: t for u, t in opened.items() if t}
    for r in pylm.with_customers(vocab, seated).collect():
        assert np.frombuffer(r.customers).tobytes() == np.array([customers[w] for w in bytes(r.words).split(b" ")], "<i8").tobytes()


def test_a_word_is_likelier_behind_a_word_it_has_followed_and_others_keep_their_shares(spark):
    followers = {w.decode() for t, own in zip(TEXTS, TRAINED, strict=True) if own for u, w in zip(tokens(t), tokens(t)[1:], strict=False) if u == b"w30"}
    known = sorted({w.decode() for t, own in zip(TEXTS, TRAINED, strict=True) if own for w in t.encode().split()})
    held = iter(i for i in range(10_000, 100_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    asked = {text: next(held) for text in [f"{u} {x}" for u in ("unseen", "w30") for x in [*known, "new"]] + ["w0 w1 w2 w0", "w2 w0 w0 w1", "other", "new"]}
    rows = list(enumerate(TEXTS)) + [(i, text) for text, i in asked.items()]
    got = {r.doc_id: r.score for r in pylm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=900, shard_bytes=500).collect()}
    p = {text: got[i] for text, i in asked.items()}
    assert p["w0 w1 w2 w0"] != p["w2 w0 w0 w1"] and math.isclose(p["other"], p["new"])
    # both texts end alike behind x; behind a word never seen x has its share of all words
    more = {x: p[f"w30 {x}"] - p[f"unseen {x}"] for x in [*known, "new"]}
    plain = [v for x, v in more.items() if x not in followers]
    assert len(plain) > 5 and len(followers) > 5 and max(plain) - min(plain) < 1e-5
    assert all(more[x] > max(plain) + 1e-3 for x in followers - {"\f"})
