"""The training-data operators against plain Python, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from arborq.llm import common as C
from arborq.llm import exact_dedup, language, line_dedup, media, packing, pylm, quality, simhash, spencode, toxicity
from arborq.llm.components import components
from arborq.llm.labelled import Isotonic

rng = random.Random(5)


@pytest.fixture(autouse=True)
def seeded(request):
    """Each test draws its own data, whichever ran before."""
    rng.seed(request.node.name)


def word():
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))


def prose(n):
    return " ".join(word() + rng.choice(["", "", "", "", ",", ".", ".\n"]) for _ in range(n))


BASE = [prose(rng.randint(1, 120)) for _ in range(30)]
TEXTS = [None, "", " ", "\t\n", "a", "A b", "a  b", "a\nb", "x" * 5000, prose(3000), *BASE, *BASE[:10], BASE[0], BASE[0] + " z", "Ünï 東京 😀 ▁ x", "a <|endoftext|> b"]


def table(spark, texts=TEXTS, ids=None):
    """doc_id and text, with columns named like working columns, and repeated and null identifiers."""
    ids = ids or [*range(len(texts))]
    rows = [(i, t, "en", "s", 1, 2, "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, hash string, n int, fp int, _doc string")


def empty(spark):
    return table(spark).limit(0)


def plain(t):
    import re

    return re.sub("[ \t-\r]+", " ", t or "")


@pytest.mark.parametrize("bits", [128, 8])
def test_exact_dedup(spark, bits):
    """With 8 bits digests collide: byte verification must keep different texts apart."""
    ids = [*range(len(TEXTS))]
    ids[-1], ids[-2] = None, 3
    got = exact_dedup.exact_dedup(table(spark, TEXTS, ids), digest_bits=bits, memtable_rows=7).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, TEXTS, strict=True):
        groups[plain(t)].append(i)
    want = []
    for t, own in groups.items():
        keep = min((i for i in own if i is not None), default=None)
        want += [(i, keep, len(own), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in own]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    again = exact_dedup.exact_dedup(table(spark, TEXTS, ids), digest_bits=bits, memtable_rows=3, fan=2).collect()  # several levels
    assert sorted(map(tuple, again), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [512, 0])
def test_simhash(spark, bucket):
    got = {r.doc_id: (r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(table(spark), bucket=bucket).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    label = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    label[a] = min(label[a], label[b])
    assert got == {i: (fps[i], label[i]) for i in fps}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [512, 3, 0])
def test_hamming_links_are_complete(spark, bucket):
    vals = {rng.getrandbits(64) for _ in range(8)}
    for b in list(vals):
        for _ in range(25):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.choice([0, 1, 2, 3, 31, 32, 33, 60, 63])
            vals.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = {(min(r), max(r)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket).collect()}
    assert got == want


def test_near_dedup_stage_links_by_five_word_jaccard(spark):
    """All pairs of Jaccard 0.8 or more are linked, and no others."""
    base = [" ".join(word() for _ in range(rng.randint(40, 200))) for _ in range(25)]
    changed = lambda t, k: " ".join(word() if i in set(rng.sample(range(len(t.split())), k)) else w for i, w in enumerate(t.split()))
    texts = TEXTS + base + [t + " " + word() for t in base] + [changed(t, 1) for t in base] + [changed(t, 4) for t in base]
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(table(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))
    find = lambda i: i if low[i] == i else find(low[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}
    docs = table(spark, texts)
    assert {r.doc_id for r in simhash.simhash_stage(spark, docs, "").collect()} == {i for i in range(len(texts)) if find(i) == i}
    assert simhash.similar_classes(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), C.Stage(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in TEXTS]
    rows = packing.pack(table(spark), length=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(pieces[i], len(x)) for i, x in enumerate(ids)] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 64
    packs = []  # shortest-pack-first, one length after the other
    for n in sorted((len(x) % 64 for x in ids), reverse=True):
        if n:
            into = min((p for p in packs if sum(p) + n <= 64), key=sum, default=None)
            packs.append([n]) if into is None else into.append(n)
    want = Counter(map(sum, packs)) + Counter({64: sum(len(x) // 64 for x in ids)})  # packs of equal totals are alike
    assert Counter(sum(n for _, n in s) for s in sequences.values()) == want
    assert packing.pack(empty(spark)).count() == 0


def test_shortest_pack_first_uses_every_length():
    histogram = {700: 300, 324: 40, 10: 7, 1023: 2, 1: 5, 512: 9}
    patterns = packing.shortest_pack_first(histogram, 1024)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 1024
        for x in p:
            used[x] += n
    assert used == histogram


def test_language_code_lengths(spark):
    train = [("a", "".join(rng.choice("abcd e") for _ in range(40))) for _ in range(5)] + [("b", "".join(rng.choice("cdefé ") for _ in range(40))) for _ in range(5)] + [("b", "")]
    model = language.train(spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string"))

    def brute(lang, text, order=language.ORDER):
        count = [Counter() for _ in range(order + 1)]
        for x, t in train:
            raw = bytes(order) + t.encode()
            for i in range(order, len(raw)) if x == lang else ():
                for k in range(order + 1):
                    count[k][raw[i - k : i + 1]] += 1
        raw, bits = bytes(order) + text.encode(), 0.0
        for i in range(order, len(raw)):
            for k in range(order, -1, -1):
                own = {g: n for g, n in count[k].items() if g[:-1] == raw[i - k : i]}
                if not own:
                    continue
                t, q, g = sum(own.values()), len(own), raw[i - k : i + 1]
                if g in own:
                    bits -= math.log2(own[g] / (t + q))
                    break
                bits -= math.log2(q / (t + q))
            else:
                bits += 8
        return bits

    texts = ["abca cdé", "", "zz ab", "dcé f", train[0][1]]
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    assert np.allclose(model.bits("".join(texts).encode(), offsets), [[brute("a", t), brute("b", t)] for t in texts])
    out = {r.doc_id: r for r in language.identify(table(spark), model).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[3].lang_pred == "und" and len(out) == len(TEXTS)
    assert language.identify(table(spark), language.train(empty(spark))).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(empty(spark), model).count() == 0


def test_language_held_out(spark):
    p = language.op4_language_id(spark, "/root/testdata/sf0.01").toPandas()
    q = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().merge(p, on="doc_id")
    held = q[q.held_out & (q.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_spelling_scores_and_counts(spark):
    got = pylm.score_documents(table(spark), sweeps=2, block_bytes=4000, shard_bytes=2000).collect()
    tokens = {i: (t or "").encode().lower().split() + [b"\f"] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(TEXTS)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[r.doc_id], len(t), n, sum(count[w] > 0 for w in t))
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score <= 1e-9 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    assert pylm.score_documents(empty(spark)).count() == 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    p = pylm.op7_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert p.score.sum() > p.base_score.sum()


def test_seating():
    g = np.random.default_rng(1)
    customers = np.array([0, 1, 2, 5, 1000, 100_000])
    tables = np.mean([pylm.seat(customers, np.full(6, 2.0), 0.5, g) for _ in range(200)], axis=0)
    exact = []
    for c in customers[:4]:  # expected tables by the recursion over the number of tables
        p = {0: 1.0}
        for j in range(c):
            q = defaultdict(float)
            for t, x in p.items():
                o = 1.0 if j == 0 else 2.0 / (2.0 + j - 0.5 * t)
                q[t + 1] += x * o
                q[t] += x * (1 - o)
            p = q
        exact.append(sum(t * x for t, x in p.items()))
    assert np.allclose(tables[:4], exact, atol=0.25) and tables[3] < tables[4] < tables[5] < 100


def test_spelling_model_is_a_distribution(spark):
    words = [b"ab", b"abc", b"b", b"ba"]
    codes, n = pylm._type_grams(words, np.array([3, 1, 2, 1]), 4)
    kept = [pylm.tally(codes & np.uint64((1 << 8 * k) - 1), n) for k in range(1, 6)]
    model = pylm.Spelling(kept, np.random.default_rng(0))
    short = [bytes([b]) for b in range(256) if b not in (0, 10)]
    first = np.exp2(-pylm.spelling_bits(model, [*short]))
    assert 0 < first.sum() < 1 and np.exp2(-pylm.spelling_bits(model, words)).sum() > 0.2


def test_sentencepiece(spark):
    e = spencode.encoder(spencode.default_model())
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "東", "😀", "▁", "1", "23", ".", "the", "\r", " \n ", "½", "ﬁ", "<s>", "<0x41>", "<unk>"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(1500)]
    for t in texts:
        ids, spans, decoded = e.encode(t.encode())
        want = e.processor.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and e.processor.decode(want).encode() == decoded
        raw = t.encode()
        if len(spans):
            assert spans[0, 0] == 0 and spans[-1, 1] == len(raw) and (spans[1:, 0] == spans[:-1, 1]).all()
            for i, (a, b) in zip(want[1:-1], spans, strict=True):
                own, piece = raw[a:b].replace(spencode.BLANK, b" "), e.surface[i].replace(spencode.BLANK, b" ")
                assert own == piece or (a == 0 and b" " + own == piece)
    assert spencode.encode(empty(spark)).count() == 0 and spencode.encode(table(spark)).count() == len(TEXTS)


def test_character_map_takes_the_longest_prefix():
    """A hand-laid double array for a -> x, ab -> yz."""
    units = [0] * 512
    leaf = lambda v: v | (1 << 31)
    node = lambda byte, offset, has: byte | (offset << 10) | (has << 8)
    units[0] = node(0, 128, 0)
    a = 0 ^ 128 ^ ord("a")
    units[a] = node(ord("a"), 300, 1)
    units[a ^ 300] = leaf(0)
    b = a ^ 300 ^ ord("b")
    units[b] = node(ord("b"), 77, 1)
    units[b ^ 77] = leaf(2)
    raw = np.array(units, "<u4").tobytes()
    m = spencode.CharacterMap(len(raw).to_bytes(4, "little") + raw + b"x\0yz\0")
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    e = spencode.encoder(spencode.default_model())
    plain_map, e.map = e.map, m
    try:
        text, places = e.normalise("ab東a".encode())
        assert text == "yz東x".encode() and places.tolist() == [0, 0, 2, 3, 4, 5, 6]
    finally:
        e.map = plain_map


def test_media(spark):
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xx\xff\0y\xff\xd9"
    parts = [("image/png", png), ("audio/wav", media.store(b"x" * 7)), ("image/gif", gif), ("image/jpeg", jpeg), ("application/gzip", gzip.compress(b"q" * 1000)), ("application/zip", z.getvalue())]
    blob = b"junkBM RIFF ".join([b"", *[p for _, p in parts], b""])
    found = media.sniff(blob)
    assert [(k, blob[s : s + n]) for k, s, n in found] == parts
    for kind, p in parts:
        assert media.sniff(p[:-1]) == [] and media.corrected(p, "text/plain", media.sniff(p)) == kind
    # what lies in another medium is one level deeper; a zip that stores a zip keeps its own end
    z2 = io.BytesIO()
    with zipfile.ZipFile(z2, "w", zipfile.ZIP_STORED) as f:
        f.writestr("inner.zip", z.getvalue())
        f.writestr("p.png", png)
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n25\n%%EOF\n"
    pdf = pdf.replace(b"25", str(pdf.index(b"xref\n0")).encode())
    updated = pdf + b"2 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF\r\n" % (len(pdf) + 15)
    nested = [("application/zip", z2.getvalue(), 0), ("application/zip", z.getvalue(), 1), ("image/png", png, 1), ("application/pdf", updated, 0)]
    blobs = spark.createDataFrame([(7, b"xx" + z2.getvalue() + updated + b"tail %%EOF", "x"), (8, None, "x"), (9, media.store(png), "x")], "k int, blob binary, type string")
    got = sorted((r.id, r.start, r.type, bytes(r.bytes), r.depth) for r in media.carve(blobs, "k", "blob", out_bytes=10).collect())
    assert {x[2:] for x in got if x[0] == 7} >= set(nested) and [x[2:] for x in got if x[0] == 9] == [("audio/wav", media.store(png), 0), ("image/png", png, 1)]
    out = {r.doc_id: r for r in media.features(media.stored_texts(table(spark, [*TEXTS[:-1], "see GIF87a " + pdf.decode()]))).collect()}
    assert out[len(TEXTS) - 1].feature.endswith("embedded=1")
    out = {r.doc_id: r for r in media.features(media.stored_texts(table(spark))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert out[i].media_sha256 == hashlib.sha256(media.store(payload)).hexdigest() and out[i].feature.startswith("audio/wav")
    rows = spark.createDataFrame([(1, png, "text/plain"), (2, None, "x/y"), (3, b"", None)], "k int, blob binary, kind string")
    assert {r.id: r.type for r in media.inspect(rows, "k", "blob", "kind").collect()} == {1: "image/png", 2: "x/y", 3: None}


def test_line_dedup_removes_shared_passages_only(spark):
    passages = [prose(k) for k in (55, 60, 70, 90, 120)]
    docs = [(i, prose(80) + " " + passages[i % 5] + " " + prose(90), passages[i % 5]) for i in range(40)]
    clean = [(100 + i, prose(200), None) for i in range(20)] + [(200, None, None), (201, "", None), (300, "one", None), (301, "one", None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in docs + clean], "doc_id long, text string, hash int, _ranges string")
    out = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    for i, t, p in docs:
        assert (out[i].text == t) if i < 5 else (p not in out[i].text and len(out[i].text) < len(t))
    for i, t, _ in clean:
        assert out[i].text == (t or "")
    assert out[0].hash == 1 and line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_removes_whole_passages(spark):
    """Of planted passages of over 50 words, cut at any word and with or without stops, nearly all bytes go."""
    plain_words = lambda k: " ".join(word() for _ in range(k))
    passages = [f(k) for f in (prose, plain_words) for k in range(52, 82)]
    docs = [(i, prose(60) + " " + p + " " + prose(60), p) for i, p in enumerate(passages * 2)]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    share = []
    for i, t, p in docs:
        if i < len(passages):
            assert out[i] == t
        else:
            share.append((len(t) - len(out[i])) / len(p))
    assert min(share) > 0.9 and max(share) < 1.1, sorted(share)[:5]


def plain_chunks(text, min_words=8):
    """(start, end, next, hash) of a text's chunks, one word after the other."""
    raw = text.encode()
    spans = [m.span() for m in __import__("re").finditer(rb"[^ \t\n\v\f\r]+", raw)]
    if not spans:
        return []
    h = line_dedup._Hashes(np.frombuffer(raw, np.uint8))
    value = lambda x, y: int(h(np.array([x]), np.array([y]))[0])
    lines, first = [], 0
    for i, (x, y) in enumerate(spans):
        gap = raw[y : spans[i + 1][0]] if i + 1 < len(spans) else b"\n"
        if raw[y - 1] in b".!?,;:" or b"\n" in gap or value(x, y) % line_dedup.CUT == 0 or i + 1 == len(spans):
            lines.append((first, i))
            first = i + 1
    own = [value(spans[x][0], spans[y][1]) for x, y in lines]
    (rolled, seed), mask = line_dedup.TILINGS[0], (1 << 64) - 1
    roll = [sum(own[i - k] * ((seed | 1) * 3**k & mask) for k in range(rolled) if i >= k) & mask for i in range(len(own))]
    roll = [int(line_dedup._mix(np.array([r], np.uint64))[0]) for r in roll]
    near = lambda i: [roll[j] for j in range(max(0, i - line_dedup.RADIUS), min(len(roll), i + line_dedup.RADIUS + 1)) if j != i]
    low = [0 < i < len(roll) - 1 and all(roll[i] < r for r in near(i)) for i in range(len(roll))]
    tops = [i for i in range(len(roll)) if low[i] or i == len(roll) - 1]
    out, lo = [], 0
    size = [lines[hi][1] + 1 - lines[tops[k - 1] + 1 if k else 0][0] for k, hi in enumerate(tops)]
    for k, hi in enumerate(tops):
        last = hi
        if size[k] < min_words and k + 1 < len(tops) and size[k + 1] < min_words:
            last = next((t for t in tops[k:] if lines[t][1] + 1 - lines[lo][0] >= min_words), hi)
        if last > lo and lines[last][1] + 1 - lines[lo][0] >= min_words:
            x, y = spans[lines[lo][0]][0], spans[lines[last][1]][1]
            out.append((x, y, spans[lines[last][1] + 1][0] if last + 1 < len(lines) else len(raw), value(x, y)))
        lo = hi + 1
    return out


def test_line_chunks_against_plain_python():
    texts = [prose(k) for k in (0, 1, 7, 40, 300)] + ["", " \n ", "a\n\nb. c  d,e\n" * 20, "x" * 400] + [" ".join(word() for _ in range(200)) for _ in range(5)]
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
    got = line_dedup.chunks(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        own = got[got[:, 0] == i][:, 1:5] - np.array([offsets[i]] * 3 + [0])
        assert [(x, y, z, h & ((1 << 64) - 1)) for x, y, z, h in own.tolist()] == plain_chunks(t)


def test_line_dedup_against_plain_python(spark):
    """Chunks by hash and bytes, the first kept, runs extended by whole words: all by dictionaries and loops."""
    shared = [prose(k) for k in (30, 70, 200)]
    texts = [prose(60) + " " + shared[i % 3] + " " + prose(50) for i in range(12)] + [shared[2]] * 3 + [None, "", "a b"]
    where = defaultdict(list)
    for i, t in enumerate(texts):
        for x, y, z, h in plain_chunks(t or ""):
            where[h].append((i, x, y, z))
    bodies = lambda i, x, y: (texts[i] or "").encode()[x:y]
    want = []
    for i, t in enumerate(texts):
        raw, gone = (t or "").encode(), []
        again = [(x, y, z, min(where[h])) for x, y, z, h in plain_chunks(t or "") if min(where[h])[:2] != (i, x) and bodies(i, x, y) == bodies(*min(where[h])[:3])]
        runs = []
        for x, y, z, f in sorted(again):
            if runs and max(r[2] for r in runs[-1]) >= x:
                runs[-1].append((x, y, z, f))
            else:
                runs.append([(x, y, z, f)])
        for run in runs:
            (x, _, _, f), (_, y, z, g) = run[0], max(run, key=lambda r: r[2])
            back, on = texts[f[0]].encode(), texts[g[0]].encode()
            k = line_dedup.agreement_before(raw[:x], back[: f[1]])
            n = line_dedup.agreement(raw[y:], on[g[2] :])
            gone.append((x - k, max(z, y + n)))
        out, at = b"", 0
        for x, y in sorted(gone):
            out += raw[at:x] if x > at else b""
            at = max(at, y)
        want.append((out + raw[at:]).decode())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()} == dict(enumerate(want))


def test_line_dedup_on_odd_tables(spark):
    """Columns named like working ones, null and repeated identifiers, a very long text, ties."""
    p = prose(90)
    rows = [(None, p, 1, 2, 3, "a"), (None, p, 1, 2, 3, "a"), (5, p, 1, 2, 3, "a"), (5, prose(30) + " " + p, 1, 2, 3, "a"), (9, prose(40_000), 1, 2, 3, "a"), (10, "w " * 5000, 1, 2, 3, "a"), (11, "w " * 5000, 1, 2, 3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own int, _doc int, digest int, ranges string")
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "removed_chunks"] and out.count() == len(rows)
    got = sorted((r.doc_id or 0, len(r.text)) for r in out.collect())
    assert [x for x in got if x[0] == 0] == [(0, len(p))] * 2  # equal rows of one identifier are one document
    assert got[2][1] == 0 or got[3][1] == 0


def test_quality_against_one_solve(spark):
    """The partition-summed equations give the weights of one least-squares solve over all rows."""
    docs = [(i, prose(rng.randint(1, 60)) + (" !!! $$$" * (i % 2))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, float(i % 2), i % 3 % 2) for i in range(60)], "doc_id long, y double, fold int")
    stats = quality.document_statistics(df)
    model = quality.fit(stats, labels, features=16)
    by_id = {r.doc_id: r.stats for r in stats.collect()}
    for i, t in docs:
        assert np.allclose(by_id[i], quality.statistics(t.encode(), np.array([0, len(t.encode())]))[0])
    x, y, fold = np.array([by_id[i] for i in range(60)]), np.arange(60) % 2.0, np.arange(60) % 3 % 2
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6, atol=1e-5)
    f = model.features(x)
    solve = lambda m, p: np.linalg.solve(f[m].T @ f[m] + np.diag([1e-6] + [p] * 16), f[m].T @ y[m])
    error = {p: np.mean((np.where(fold == 0, f @ solve(fold == 1, p), f @ solve(fold == 0, p)) - y) ** 2) for p in quality.PENALTIES}
    best = min(quality.PENALTIES, key=error.get)
    assert np.allclose(model.weights, solve(fold >= 0, best), atol=1e-6)
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert np.allclose([got[i] for i in range(60)], model.score(x))


def test_toxicity_window_lengths(spark):
    """Each window's two compressed lengths, one compressor call after the other."""
    import zstandard

    model = toxicity.Model(toxicity.Model.train([b"you idiot " * 9 + prose(9).encode() for _ in range(12)], [prose(80).encode() for _ in range(40)]))
    got = {r.doc_id: r.f for r in toxicity.window_features(table(spark), model).collect()}

    def size(content, window):  # a compressor of its own for each window
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=d, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for i, t in enumerate(TEXTS[:30]):
        raw = (t or "").encode().lower()
        parts = toxicity.cut(raw, toxicity.WINDOW) + (toxicity.cut(raw, toxicity.WINDOW // 2) if len(raw) > toxicity.WINDOW // 2 else [])
        gain = sorted(size(model.dictionaries[1], w) - size(model.dictionaries[0], w) for w in parts)
        assert b"".join(toxicity.cut(raw, toxicity.WINDOW)) == raw
        want = [math.log1p(sum(g >= k for g in gain)) for k in range(1, toxicity.STEPS + 1)] + [max(gain[-1], 0), max(sum(gain[-2:]), 0), math.log1p(len(gain))] if gain else [0.0] * (toxicity.STEPS + 3)
        assert np.allclose(got[i], want, atol=1e-9)


def page(serial, flags, body=b"x" * 9):
    return b"OggS\0" + bytes([flags]) + bytes(8) + serial.to_bytes(4, "little") + bytes(8) + bytes([1, len(body)]) + body


def test_ogg_streams_are_whole():
    """One medium from the first page to the end of all its streams; no later page starts one."""
    one = page(7, 2) + page(7, 0) + page(7, 0) + page(7, 4)
    two = page(1, 2) + page(2, 2) + page(1, 4) + page(2, 0) + page(2, 4)
    blob = b"a" + one + b"bb" + two + page(3, 0) + page(3, 4)
    want = [("audio/ogg", 1, len(one)), ("audio/ogg", 3 + len(one), len(two))]
    assert [tuple(m) for m in media.sniff(blob)] == want
    assert [i for i in range(len(blob)) if blob.startswith(b"OggS", i) and media._ogg(blob, i)] == [x[1] for x in want]
    assert media._ogg(one[:-3], 0) is None and media._ogg(page(7, 2) + page(8, 4), 0) is None


def test_quality_held_out(spark):
    p = quality.op2_quality(spark, "/root/testdata/sf0.01").toPandas()
    q = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(p, on="doc_id")
    held = q[q.held_out]
    assert (held.quality == held.predicted).mean() > 0.95 and p.score.between(0, 1).all()


def test_classifiers_on_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, None if i % 3 else 1) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for fn in (quality.classify, toxicity.classify):
        assert fn(table(spark), labels).count() == len(TEXTS)
        assert fn(empty(spark), labels.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    p = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    q = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().merge(p, on="doc_id")
    held = q[q.held_out]
    assert (held.toxic == held.predicted).mean() > max(0.93, 1 - held.toxic.mean()) and p.score.between(0, 1).all()


def test_isotonic():
    g = np.random.default_rng(0)
    x = g.normal(size=500)
    y = (g.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float)
    curve = Isotonic(x, y)
    assert (np.diff(curve.y) > 0).all() and (np.diff(curve(np.sort(x))) >= 0).all()


def test_pipeline(spark):
    """Each stage keeps exactly what its operator says of its own input, and nothing else."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = docs.columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = C.Stage(spark, "test").table(stage(spark, docs, sf))
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
            continue
        assert out.columns == names
        if name in ("quality", "toxicity"):
            found = (quality if name == "quality" else toxicity).classify(docs, labels)
            assert ids(out) == ids(found.filter(f"predicted = {int(name == 'quality')}"))
        elif name == "line dedup":
            assert ids(out) == ids(docs) and out.filter("n_chars <> length(text)").count() == 0
        else:
            kept = simhash.similar_classes(docs)
            assert ids(out) == sorted({r.component_id for r in kept.select("component_id").distinct().collect()})
        docs = out


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, further columns, and an empty table: every stage's columns stay, nothing fails."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _own int, label string"
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in enumerate(TEXTS)] + [(0, None, None, None, None, None, None)] * 2 + [(3, TEXTS[3], "en", "s", 2, 1, "x")]
    for k, own in enumerate((rows, [])):
        sf = str(tmp_path / str(k))
        spark.createDataFrame(own, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)] if own else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and (out.count() > 0) == bool(own)
