"""Queries on sf0.001 and on awkward rows, against SQL or brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import entries, langid, mix, mpeg, quality, secrets, shards, simhash, tiling, tokens, urls
from tessera.llm.common import components, table

from ..conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"
LONG = "Word and more. " * 20_000
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "same text of some words here", "en", "a", 1), (4, "same text of some words here", "fr", "b", 1), (5, "Same Text OF some words\there", "en", None, 1),
    (6, LONG, "en", "a", 1), (7, LONG, "en", "a", 1), (7, LONG, "en", "a", 1), (8, "été où ça  　 <|endoftext|> 12", "fr", "b", 1), (9, "\n\t ", None, "b", 1), (None, "no id", "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 9, 0.5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("select doc_id, text, lang, source from documents").fetchall()


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_sql(spark, same, name):
    same(entries.QUERIES[name](spark, DATA), entries.ORACLES[name])


def test_mix_targets(spark, odd):
    rows = mix.op1_mix(spark, DATA).collect()
    by = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["target"], r["source_size"]][0] += r["taken"]
    assert sum(t for t, _ in by) == pytest.approx(1.5 * sum(s for _, s in by))
    assert sorted(rows) == sorted(mix.op1_mix(spark, DATA).collect())
    out = mix.mix(odd)
    assert out.columns == odd.columns and out.count() > 0 and mix.mix(odd.limit(0)).count() == 0


def test_mix_inclusion_odds(spark):
    """Odds of a document are in proportion to its size, large ones are certain, and they add up to the words left."""
    rows = [(k, " ".join(["w"] * n), "a") for k, n in enumerate([1, 2, 3, 4, 5, 8, 13, 40, 400] * 12)] + [(1000 + k, "w w w w", "b") for k in range(300)] + [(2000, None, "a"), (2001, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow, done = mix.plan(docs)
    got = narrow.join(done, "_key").withColumn("p", mix.odds()).withColumn("_rank", mix.rank()).withColumn("copies", mix.copies()).collect()
    for key in {r["_key"] for r in got}:
        own = [r for r in got if r["_key"] == key]
        if own[0]["capped"]:
            assert {r["copies"] for r in own} == {2}
            continue
        assert sum(r["p"] * r["_size"] for r in own) == pytest.approx(own[0]["_words"])
        ratio = {round(r["p"] / r["_size"], 12) for r in own if 0 < r["p"] < 1}
        assert len(ratio) <= 1 and all(r["copies"] == r["_whole"] + 1 for r in own if r["p"] == 1)
        assert all(r["p"] <= q["p"] for r in own for q in own if r["_size"] <= q["_size"])
    shares = {r["_key"]: len({round(r["p"], 9) for r in got if r["_key"] == r["_key"]}) for r in got}
    assert max(shares.values()) > 2


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_fp(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps):
    ids, group = list(fps), {d: d for d in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d: root(d) for d in ids}


def test_simhash_query(spark, docs):
    fps = {d: brute_fp(t) for d, t, *_ in docs}
    group = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash_golay(spark, DATA).collect()}
    assert got == {d: (f"{fps[d]:016x}", group[d]) for d in fps}


def test_simhash_odd_rows(spark, odd):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(odd).collect()}
    assert got[1] == got[2] == got[9] == 1 and got[3] == got[4] == got[5] == 3 and got[6] == got[7] == 6
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_golay_code():
    r = np.random.default_rng(0)
    w = r.integers(0, 1 << 23, 3000)
    near = simhash.nearby(w)
    assert set((near >= 0).sum(axis=1).tolist()) == {1, 6}
    for flips in (1, 2):
        other = w.copy()
        for _ in range(flips):
            other ^= 1 << r.integers(0, 23, len(w))
        mine = simhash.nearby(other)
        if flips == 1:
            assert (near == simhash.decode(other)[:, None]).any(axis=1).all()
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(near, mine, strict=True))


def test_golay_keys_meet():
    r = np.random.default_rng(1)
    x = r.integers(-(2**63), 2**63 - 1, 2000)
    y = x.copy()
    for _ in range(3):
        y ^= np.int64(1) << r.integers(0, 64, len(x))
    rows, keys = simhash.keys(x, True)
    index = set(zip(rows.tolist(), keys.tolist(), strict=True))
    rows, keys = simhash.keys(y, False)
    assert {i for i, k in zip(rows.tolist(), keys.tolist(), strict=True) if (i, k) in index} == set(range(len(x)))


def test_deduplicate(spark):
    r = np.random.default_rng(2)
    base = [" ".join(f"w{k}" for k in r.integers(0, 5000, 200)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t) for k, t in enumerate(base[:10])] + [(200 + k, t.replace(t.split()[50], "other", 1)) for k, t in enumerate(base[:10])]
    rows += [(300, None), (301, ""), (None, "kept")]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x[0] for x in out.select("doc_id").collect() if x[0] is not None) == [*range(30), 300]
    assert out.where("doc_id is null").count() == 1


def test_deduplicate_dense_buckets(spark):
    """Chains of edits, whose ends are far from any hub, and two families that share a passage: as by comparing all pairs."""
    r = np.random.default_rng(4)
    rows = []
    for c in range(3):
        t = [f"w{k}" for k in r.integers(0, 5000, 300)]
        for step in range(120):
            rows.append((1000 * c + step, " ".join(t)))
            for at in r.integers(0, 300, 3):
                t[at] = f"x{c}-{step}-{at}"
    shared = [f"s{k}" for k in range(30)]
    for c in range(4):
        t = [f"w{k}" for k in r.integers(0, 5000, 120)]
        for step in range(45):
            own = list(t)
            for at in r.integers(0, 120, 3 + c):
                own[at] = f"y{c}-{step}-{at}"
            rows.append((10_000 + 100 * c + step, " ".join(own[:60] + shared + own[60:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x[0] for x in simhash.deduplicate(docs).select("doc_id").collect()}
    assert out == exact_survivors(rows) and len(out) < len(rows) - 200


def test_deduplicate_pairs_grow_with_rows(spark, monkeypatch):
    """One family of near copies with one or three words changed: pairs of the latter are below 0.8, and all hang together by the
    former. Pairs compared grow with the rows, not their square."""
    def pairs_of(n):
        r = np.random.default_rng(5)
        base, rows = [f"w{k}" for k in r.integers(0, 5000, 200)], []
        for k in range(n):
            t = list(base)
            for at in r.choice(200, 1 + k % 2 * 2, replace=False):
                t[at] = f"z{k}-{at}"
            rows.append((k, " ".join(t)))
        seen = []
        kept = simhash.save

        def save(df, name, **options):
            out = kept(df, name, **options)
            if name == "dedup_pairs":
                seen.append(out.count())
            return out

        monkeypatch.setattr(simhash, "save", save)
        out = {x[0] for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
        monkeypatch.setattr(simhash, "save", kept)
        if n <= 150:
            assert out == exact_survivors(rows)
        return sum(seen)

    small, large = pairs_of(150), pairs_of(600)
    assert small < 5 * 150 and large < 5 * 600


def test_deduplicate_unlike_families(spark, monkeypatch):
    """Families of texts that share half their shingles, with a few links of 0.8 among them: numbers too small for the sample
    to show must not make a family's texts meet all others. Candidate pairs stay few and no link is lost."""
    monkeypatch.setattr(simhash, "common_shingles", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    r = np.random.default_rng(11)
    rows = []
    for f in range(6):
        base = [f"w{k}" for k in r.integers(0, 5000, 150 + 30 * f)]
        for k in range(40):
            t = list(base)
            for at in r.choice(len(t), len(t) // 10, replace=False):
                t[at] = f"v{f}-{k}-{at}"
            rows.append((1000 * f + k, " ".join(t)))
            if k % 8 == 0:
                t[len(t) // 2] = f"u{f}-{k}"
                rows.append((1000 * f + 500 + k, " ".join(t)))
    seen = []
    kept = simhash.save

    def save(df, name, **options):
        out = kept(df, name, **options)
        if name == "dedup_pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "save", save)
    out = {x[0] for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert out == exact_survivors(rows) and len(out) == len(rows) - 30
    assert sum(seen) < 6 * len(rows)


def test_golay_keys_are_not_broadcast(spark):
    """A fingerprint has over a hundred keys, though Spark takes them for as small as the fingerprints: no side holding them goes to the driver."""
    texts = spark.createDataFrame([(k, k * 7919, k << 40) for k in range(50)], "node long, fp long, info long")
    plan = simhash.golay_stars(texts, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def five_words(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def changed_copies(seed, shares, each=20):
    """(text, copy, five-word similarity): passages appended, cut and inserted, in texts of 30 to 400 words."""
    r = np.random.default_rng(seed)
    out = []
    for share in shares:
        for k in range(each):
            n = (30, 100, 400)[k % 3]
            t = [f"w{x}" for x in r.integers(0, 5000, n)]
            m = int(n * share)
            added, at = [f"w{x}" for x in r.integers(0, 5000, m)], int(r.integers(0, n))
            copy = (t + added, t[: n - m], t[:at] + added + t[at:])[k // 3 % 3]
            a, b = " ".join(t), " ".join(copy)
            out.append((a, b, len(five_words(a) & five_words(b)) / len(five_words(a) | five_words(b))))
    return out


def test_deduplicate_appended_and_cut_passages(spark):
    """Pairs of 0.9 or more are all found, however far apart their fingerprints are."""
    found = [p for p in changed_copies(6, (0.05, 0.08)) if p[2] >= 0.9]
    rows = [(k, a) for k, (a, *_) in enumerate(found)] + [(1000 + k, b) for k, (_, b, _) in enumerate(found)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(found) > 20 and sorted(x[0] for x in out.select("doc_id").collect()) == list(range(len(found)))


def test_deduplicate_equals_exact_similarity(spark):
    """Pairs beside 0.8 fall on the side their own sets put them."""
    pairs = [p for p in changed_copies(7, (0.1, 0.15, 0.2, 0.22), 60) if 0.6 <= p[2]]
    rows = [(k, a) for k, (a, *_) in enumerate(pairs)] + [(1000 + k, b) for k, (_, b, _) in enumerate(pairs)]
    out = {x[0] for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    near = [s >= 0.8 for *_, s in pairs]
    assert 20 < sum(near) < len(pairs) - 20
    assert out == {*range(len(pairs)), *(1000 + k for k, n in enumerate(near) if not n)}


def test_deduplicate_repeated_id(spark):
    """An id that repeats with other texts is a document for each; no text without a copy goes."""
    r = np.random.default_rng(8)
    a, b = (" ".join(f"w{k}" for k in r.integers(0, 5000, 100)) for _ in range(2))
    for first, second in ((a, b), (b, a)):
        out = simhash.deduplicate(spark.createDataFrame([(1, first), (1, second), (2, f"{a} end"), (3, f"{b} end")], "doc_id long, text string"))
        assert [x[0] for x in out.select("doc_id").collect()] == [1, 1]
    out = simhash.deduplicate(spark.createDataFrame([(3, a), (5, a), (5, b), (None, a), (None, "own"), (None, f"{b} end")], "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, a), (5, b), (None, "own")], key=str)


def test_deduplicate_text_ids_and_odd_rows(spark, odd):
    out = simhash.deduplicate(spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", None), ("d", "")], "doc_id string, text string"))
    assert sorted(x[0] for x in out.select("doc_id").collect()) == ["a", "c"]
    assert sorted(x[0] for x in simhash.deduplicate(odd).select("doc_id").collect() if x[0] is not None) == [1, 3, 6, 8, 9]
    assert simhash.deduplicate(odd.limit(0)).count() == 0


def test_clashing_names(spark):
    odd_docs = spark.createDataFrame([(k, f"some words {k} here", "en", "a", 1, 2, 3, 4, 0.5, "s") for k in range(8)], "doc_id long, text string, lang string, source string, _key long, target long, source_size long, _copy long, score double, shard string")
    out = mix.mix(odd_docs)
    assert out.columns == odd_docs.columns and {tuple(x)[4:] for x in out.collect()} == {(1, 2, 3, 4, 0.5, "s")}
    kept = quality.kept(odd_docs, quality.train([(b"a", 1)]))
    assert kept.columns == odd_docs.columns and kept.count() == 8 and {x["score"] for x in kept.collect()} == {0.5}
    assert shards.shard_documents(odd_docs).columns == odd_docs.columns
    assert simhash.deduplicate(odd_docs).columns == tiling.decontaminate(odd_docs, spark.createDataFrame([(1, "none")], "item_id long, text string")).columns == odd_docs.columns
    pages = spark.createDataFrame([(1, "http://a.com/x", "h", 1.0, True)], "page_id long, url string, host string, purity double, reject boolean")
    assert urls.judge(pages).select("host", "purity", "reject").first()[0] == "a.com"


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (5, 5)]
    for few in (0, 1000):
        got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"), few=few).collect()))
        assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_byte_shards(spark, docs, odd):
    got = {r["doc_id"]: r for r in shards.op5_byte_shards(spark, DATA).collect()}
    size = {d: len((t or "").encode()) + 1 for d, t, *_ in docs}
    total, at, slots = sum(size.values()), 0, collections.Counter()
    for d in sorted(size):
        shard = min(7, (2 * at + size[d]) * 8 // (2 * total))
        r = got[d]
        assert (r["size"], r["shard"], r["slot"], r["law"], r["grown_shard"]) == (size[d], shard, slots[shard], "bytes", None)
        at += size[d]
        slots[shard] += 1
    assert all(got[d]["text_crc32"] == zlib.crc32((t or "").encode()) for d, t, *_ in docs)
    out = shards.shard_documents(odd, 3)
    assert out.count() == len(ROWS) and set(out.columns) == {*odd.columns, "shard"}
    assert shards.shard_documents(odd.limit(0)).count() == 0


def payload(t):
    b = (t or "").encode()
    return b + b" " * (-len(b) % 192 if b else 192)


def test_mpeg_query(spark, docs):
    got = {r["doc_id"]: r for r in mpeg.op3_mpeg_audio(spark, DATA).collect()}
    for d, t, *_ in docs:
        p = payload(t)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["samples"] == r["frames"] * 1152 and r["media_sha256"] == hashlib.sha256(mpeg.pack((t or "").encode())).hexdigest()


def test_mpeg_streams():
    media = mpeg.pack(b"x" * 5000)
    whole = mpeg.parse(media)
    assert mpeg.unpack(media) == payload("x" * 5000) and whole["crc_ok"] == len(whole["offsets"]) == whole["vbr"]["frames"]
    assert whole["vbr"]["bytes"] == len(media) - mpeg.read_tags(media)[1] and whole["tags"]["TXXX:n_bytes"] == "5000"
    at = whole["offsets"][1]
    broken = mpeg.parse(media[:at] + b"junk!" + media[at:])
    assert broken["resyncs"] == 1 and broken["skipped"] == 5 and len(broken["offsets"]) == len(whole["offsets"])
    flipped = bytearray(media)
    flipped[at + 8] ^= 1  # side information
    assert mpeg.parse(bytes(flipped))["crc_bad"] == 1
    old = media + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    assert mpeg.parse(old)["tags"]["TIT2"] == "Title" and mpeg.parse(b"no audio at all")["offsets"] == []
    # fixed values of the standard: MPEG-1 layer III 128 kbit/s 44.1 kHz, layer II 192 kbit/s 48 kHz, MPEG-2 layer III 64 kbit/s 22.05 kHz
    assert [mpeg.header(h)[3:6] for h in (0xFFFB9000, 0xFFFDA400, 0xFFF38000)] == [(44100, 417, 1152), (48000, 576, 1152), (22050, 208, 576)]


def with_checksums(word, n, seed):
    """Frames of a header with random bodies and right checksums."""
    r, out = np.random.default_rng(seed), b""
    for _ in range(n):
        h = mpeg.header(word)
        body = bytes(r.integers(0, 255, h[4] - 6).astype(np.uint8))
        frame = word.to_bytes(4, "big") + b"\0\0" + body
        bits = mpeg.protected_bits(frame, 0, word, h)
        out += frame[:4] + mpeg.crc16(frame[2:4] + frame[6 : 6 + (bits + 7) // 8], 16 + bits).to_bytes(2, "big") + body
    return out


@pytest.mark.parametrize("word,bits", [(0xFFFEA000, 256), (0xFFFEA040 | 0x20, 4 * (32 + 12)), (0xFFFEA0C0, 128), (0xFFFCA400, None), (0xFFFCA050, None), (0xFFFC30C0, None), (0xFFF480C0, None), (0xFFFA9000, 32 * 8)])
def test_mpeg_checksums_of_all_layers(word, bits):
    media = with_checksums(word, 4, 1)
    found = mpeg.parse(media)
    assert (found["crc_ok"], found["crc_bad"], len(found["offsets"])) == (4, 0, 4)
    assert bits is None or mpeg.protected_bits(media, 0, word, mpeg.header(word)) == bits
    spoiled = bytearray(media)
    spoiled[7] ^= 1
    assert mpeg.parse(bytes(spoiled))["crc_bad"] == 1


def test_mpeg_free_bitrate():
    frame = (0xFFFB0000 | 0xC0).to_bytes(4, "big") + bytes(300)
    found = mpeg.parse(frame * 6)
    assert len(found["offsets"]) == 6 and set(found["sizes"]) == {304} and found["samples"] == 6 * 1152


def test_mpeg_odd_rows(spark, odd):
    rows = mpeg.media_columns(odd).collect()
    by = collections.defaultdict(set)
    for r, (_, t, *_) in zip(sorted(rows, key=lambda r: str(r["doc_id"])), sorted(ROWS, key=lambda r: str(r[0])), strict=True):
        by[r["doc_id"]].add(bytes(r["media"]))
        assert r["samples"] == len(r["seek_offsets"]) * 1152
    assert by[1] == by[2] and by[6] == by[7] and all(len(v) == 1 for v in by.values())
    assert mpeg.unpack(by[6].pop()) == payload(LONG) and mpeg.media_columns(odd.limit(0)).count() == 0


def test_token_query(spark, docs, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    ids = lambda t: [*own.encode(t or "", add_special_tokens=False).ids, 2]
    got = {r["doc_id"]: tuple(r) for r in tokens.op4_token_ids(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for d, t, *_ in sorted(docs):
        i = ids(t)
        assert got[d] == (d, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes()))
        start += len(i)
    tokens.write_tokens(odd, f"file://{tmp_path}/odd", path)
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/odd").select("doc_id", "ids").collect()]
    assert sorted(map(str, rows)) == sorted(str((d, ids(t))) for d, t, *_ in ROWS)
    back = sorted((r["start"], r["n_tokens"]) for r in tokens.read_tokens(spark, f"file://{tmp_path}/odd").collect())
    assert [a for a, _ in back] == [sum(n for _, n in back[:k]) for k in range(len(back))]


def test_token_encoder_equals_library():
    """Ids of odd texts, by chunks and by the library on the whole text."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    own, mine = Tokenizer.from_file(path), tokens.Encoder(path)
    own.encode_special_tokens = True
    plain = ["a", "b", "the", "é", "ß", "×", "÷", "’", "'", "'s", "1", "23", "  ", "\t", "\n", "\r\n", ",", ".", "!", ";", ":", "-", "<|endoftext|>", "<|", "½", "中", "😀", "ÿ", "Ã", "\xad", "don't", "ï,", "x:", "\x0b", "\x00", "abcdefghijklmnopqrst", " word"]
    texts = ["".join(r.choice(plain if r.random() < 0.9 else ["\u00a0", "\u3000", "\x1c", "\u0085"]) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        ids, edge = mine.encode([t.encode() for t in part], 2)
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)] == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in part]


def test_token_tables(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    clash = spark.createDataFrame([(k, f"some words {k}", k, "ids") for k in range(50)], "doc_id long, text string, n_tokens long, ids string")
    tokens.write_tokens(clash, f"file://{tmp_path}/t", path)
    got = tokens.read_range(spark, f"file://{tmp_path}/t", 10, 12)
    assert sorted(r["doc_id"] for r in got.collect()) == [10, 11, 12] and got.columns == ["doc_id", "n_tokens"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "ids" not in plan.split("ReadSchema")[1]
    tokens.write_tokens(clash.limit(0), f"file://{tmp_path}/none", path)
    assert spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(f"file://{tmp_path}/none").count() == 0


def test_language_query(spark, docs):
    lang = {d: x for d, _, x, _ in docs}
    rows = langid.op2_language_id(spark, DATA).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97


def test_language_odd_rows(spark, odd):
    model = langid.train([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 9)] == ["und"] * 3 and got[6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train([])).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_language_of_a_text_stands_alone():
    """A score does not depend on what stands beside a text; sums by plain loops."""
    model = langid.train([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der Hund und die Katze", "de")] * 8)
    texts = ["le chat", "ab " * 30, LONG * 8, "x", "été", "the dog", "le chat"]
    together = model.predict(texts)
    assert together == [model.predict([t])[0] for t in texts] == model.predict(texts[::-1])[::-1] and together[0] == together[-1]
    for t in ("le chat et", "x", "été où"):
        data = np.frombuffer(langid.stream(t), np.uint8)
        rows = np.concatenate([model.rows[h] for h in langid.windows(data)]).astype(np.float64)
        p = langid.softmax((rows.mean(axis=0) + model.bias) / model.heat)
        assert model.predict([t])[0][1] == pytest.approx(p.max(), abs=1e-6)


def test_language_letters():
    model = langid.train([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10)
    assert [x[0] for x in model.predict(["½ ²", "١٢ ⅷ 12", "_ -", "😀"])] == ["und"] * 4
    assert all(x[0] != "und" for x in model.predict(["ª", "中", "a"]))


def test_language_learns_from_long_texts(spark):
    """A language that has only very long texts is learned, from windows over all of them."""
    long = "bonjour le monde entier " * 40_000
    rows = [(k, "good day to the whole world " * 20, "en") for k in range(12)] + [(100 + k, long, "fr") for k in range(12)] + [(None, "good day to you", "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"] and model.predict(["bonjour le monde", "good day to the world"])[0][0] == "fr"


def test_quality(spark, odd):
    rows = quality.op9_quality_cnn(spark, DATA).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    r = np.random.default_rng(0)
    good = [" ".join("the and of cat dog".split()[k] for k in r.integers(0, 5, 80)).encode() for _ in range(120)]
    bad = [g.upper().replace(b" ", b"!! ") for g in good]
    net = quality.train([(t, 1) for t in good[:90]] + [(t, 0) for t in bad[:90]], (0.5, 0.5))
    assert (net.score(good[90:]) > 0.5).mean() > 0.95 and (net.score(bad[90:]) < 0.5).mean() > 0.95
    one = net.score([b"", LONG.encode(), b"x"])
    assert one.tolist() == pytest.approx([float(net.score([t])[0]) for t in (b"", LONG.encode(), b"x")], abs=2e-6)
    assert quality.train([(b"a", 1)]).score([b"z"]).tolist() == [1.0]
    out = quality.scores(odd.drop("score"), net)
    assert out.count() == len(ROWS)


def naive_quality(net, text):
    """One text's score by plain loops: embedding, filters over eight bytes in steps of four, chunks of two halves."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    body = b"\0" * quality.STEP + text
    halves = (len(text) + 2 * quality.STEP - 1) // quality.PAIR + 1
    body = body.ljust(halves * quality.PAIR, b"\0") + b"\0" * quality.STEP
    best = []
    for h in range(halves):
        found = []
        for at in range(h * quality.PAIR, (h + 1) * quality.PAIR, quality.STEP):
            x = np.concatenate([w["emb"][c] for c in body[at : at + 8]])
            found.append(x[: quality.STEP * quality.DIM] @ w["a"] + x[quality.STEP * quality.DIM :] @ w["b"])
        best.append(np.max(found, axis=0))
    chunks = [np.maximum(np.maximum(best[h], best[h + 1] if h + 1 < halves else best[h]) + w["c"], 0) for h in range(halves)]
    doc = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    z = np.tanh(doc @ w["h"] + w["hb"]) @ w["o"] + w["ob"][0] + net.shift
    return 1 / (1 + np.exp(-z))


def test_quality_forward_equals_plain_loops():
    net, r = quality.Net(), np.random.default_rng(5)
    for k in net.w:
        net.w[k] = net.w[k] + r.normal(0, 0.1, net.w[k].shape).astype(np.float32)
    texts = [b"", b"x", b"some bytes of text " * 30, bytes(r.integers(0, 256, 700).astype(np.uint8)), "été où ça ".encode() * 13]
    assert net.score(texts).tolist() == pytest.approx([naive_quality(net, t) for t in texts], abs=2e-6)


def test_quality_gradients():
    """Back-propagation of every weight against differences of the loss."""
    net = quality.Net()
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    texts, y = [b"some bytes of text " * 12, b"ZZZ!! " * 90, b"abc" * 200, b"x"], np.array([1.0, 0.0, 1.0, 0.0])
    g = net.grads(texts, y)

    def loss():
        data, starts = quality.laid(texts)
        doc = net._top(net._conv(data)[1].max(axis=1), starts)[2]
        p = 1 / (1 + np.exp(-(np.tanh(doc @ net.w["h"] + net.w["hb"]) @ net.w["o"] + net.w["ob"][0])))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    assert set(g) == set(net.w)
    for name in net.w:
        for at in np.abs(g[name]).ravel().argsort()[::-1][:4]:
            k = np.unravel_index(at, g[name].shape)
            old = net.w[name][k]
            net.w[name][k] = old + 1e-5
            up = loss()
            net.w[name][k] = old - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(float(g[name][k]), rel=1e-3, abs=1e-6)
            net.w[name][k] = old


def test_quality_held_out(spark, duck):
    """Rows held out are those of the checksum, they are never learned from, and most of them are told right."""
    got = {r["doc_id"]: r for r in quality.op9_quality_cnn(spark, DATA).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    known = dict(duck.sql("select doc_id, min(quality) from labels where quality is not null group by 1").fetchall())
    held = [(got[d]["score"], q) for d, q in known.items() if d in got and got[d]["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert good and np.mean([s >= 0.3 for s in good]) >= 0.9
    assert not bad or np.mean([g > b for g in good for b in bad]) >= 0.7


def test_quality_odd_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(odd, none).flat == 0.5 and quality.fit(odd.limit(0), none).flat == 0.5
    labels = spark.createDataFrame([(3, 1.0), (3, 0.0), (6, None), (None, 1.0), (999, 0.0), (8, 1.0)], "doc_id long, quality double")
    net = quality.fit(odd, labels)
    assert net.flat is None and len(set(r["score"] for r in quality.scores(odd, net).where("text like 'Word%'").collect())) == 1
    assert quality.scores(odd.limit(0), net).count() == 0


def test_tiling(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    cases = {1: "lead " + item.upper() + "! tail", 2: " ".join(w[6:]) + ". And then: " + " ".join(w[:6]), 3: "nothing of the kind at all", 4: " ".join(w[:5]) + " end", 5: None, 6: "", 7: " ".join(w[:5] * 5), 8: "filler words. " * 30_000 + item}
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "two words"), (10, item)], "item_id long, text string")
    got = {(r["doc_id"], r["coverage"]) for r in tiling.leaks(docs, bench).collect()}
    assert got == {(1, 1.0), (2, 1.0), (8, 1.0)}
    assert got == {(r["doc_id"], r["coverage"]) for r in tiling.leaks(docs, bench, part_words=8).collect()}
    assert sorted(r["doc_id"] for r in tiling.decontaminate(docs, bench).collect()) == [3, 4, 5, 6, 7]
    assert tiling.leaks(docs.limit(0), bench).count() == tiling.leaks(docs, bench.limit(0)).count() == 0


def test_tiling_query_equals_search(spark, docs, duck):
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [(i, norm(t)) for i, t in duck.sql("select item_id, text from benchmark").fetchall()]
    whole = {(d, i) for d, t, *_ in docs for i, x in items if x in norm(t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in tiling.op7_string_tiling(spark, DATA).collect() if r["coverage"] == 1}
    assert got == whole and whole


def plain_tiles(text, item, least):
    """Greedy string tiling as defined: the longest match of unmarked words each time, first in the item, then in the text."""
    text_used, item_used, out = [False] * len(text), [False] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not item_used[i + n] and not text_used[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, t)
        if best is None:
            return out
        out.append(best)
        for k in range(best[0]):
            item_used[best[1] + k] = text_used[best[2] + k] = True


def test_tiles_equal_plain_greedy_tiling():
    r = np.random.default_rng(3)
    for _ in range(150):
        text = r.integers(0, int(r.integers(2, 6)), int(r.integers(5, 60))).astype(np.uint64)
        item, least = r.integers(0, 4, int(r.integers(5, 30))).astype(np.uint64), int(r.integers(2, 5))
        assert tiling.tile(text, item, least, start=int(r.integers(3, 12))) == plain_tiles(text.tolist(), item.tolist(), least)


def test_tiling_partial_coverage_equals_plain_tiling(spark):
    """Passages cut, reordered and repeated: coverage of every document and item by plain greedy tiling."""
    r = np.random.default_rng(6)
    items = [[f"w{k}" for k in r.integers(0, 40, n)] for n in (12, 25, 40)]
    texts = []
    for k in range(40):
        parts = []
        for _ in range(int(r.integers(1, 5))):
            item = items[int(r.integers(0, 3))]
            a = int(r.integers(0, len(item) - 5))
            parts += item[a : a + int(r.integers(5, 20))] + [f"x{v}" for v in r.integers(0, 50, int(r.integers(0, 6)))]
        texts.append(parts)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n = sum(x[0] for x in plain_tiles(t, item, 5))
            if n >= 0.5 * len(item):
                want[d, i] = round(n / len(item), 6)
    assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.leaks(docs, bench).collect()} == want and len(want) > 10


def test_secrets(spark, docs):
    text = {d: t for d, t, *_ in docs}
    truth = {(d, m.start(1), m.end(1)) for d, t in text.items() for m in re.finditer(r'token = "([0-9a-fA-F]{40})"', t or "", re.I)}
    got = {(r["doc_id"], r["start"], r["end"]) for r in secrets.op8_secret_forest(spark, DATA).collect()}
    assert got == truth
    found = secrets.labelled(600, seed=99)
    x = np.array([secrets.features(t[a:b], t[max(0, a - 48) : a], t[b : b + 48]) for t, a, b, _ in found])
    right = (secrets.train(secrets.labelled()).predict(x) >= 0.5) == np.array([k for *_, k in found], bool)
    assert right.mean() > 0.95


def test_secret_offsets(spark):
    key = "0f1e2d3c4b5a69788796a5b4c3d2e1f001234567"
    rows = [(1, f'été token = "{key}" fin'), (2, None), (3, ""), (None, f'secret="{key}"')]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), secrets.train(secrets.labelled())).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == {(1, 13, 53), (None, 8, 48)}


def test_secret_values_of_any_kind(spark):
    """Short, digitless and symbol-holding values, credentials, and names before `=` (marked by braces)."""
    marked = [
        "set API_KEY={Zk3vQ9xLw2Rt8YbN5mPc} now", 'password = "{q7!Rx#2pVz}" then', "the DB_PASSWORD={kT9$wLm2&xQ} and", 'client_secret: "{QxZvKjWqPfYbGmTdRhLs}" end',
        "see postgres://admin:{s3cRe7pw!x}@db.example.com/main for", "été token={0f1e2d3c4b5a69788796a5b4c3d2e1f001234567} fin", "plain words: nothing of the kind, mailto:someone@site.example.com", "https://site.example.com/a/page?title=holiday&lang=english",
    ]
    rows = [(k, re.sub("[{}]", "", t)) for k, t in enumerate(marked)]
    want = {(k, t.index("{"), t.index("}") - 1) for k, t in enumerate(marked) if "{" in t}
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), secrets.train(secrets.labelled())).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == want


def test_urls(spark):
    rows = [(1, "http://A.Example.COM/en/70?x"), (2, "https://com/en/"), (3, "http://xcom/en/1"), (4, "http://a.net/de/8"), (5, "http://b.example.net/de/81#t"), (6, None), (7, "no scheme"), (8, "http://h.org"), (9, "HTTP://h.ORG/es/"), (10, "a://b://c/d")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("a.example.com", "/en/70", "example.com/en/7", "allow"), 2: ("com", "/en/", "com/en/", "block"), 3: ("xcom", "/en/1", None, "allow"), 4: ("a.net", "/de/8", "net/de/", "allow"), 5: ("b.example.net", "/de/81", "example.net/de/8", "block"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("h.org", "", None, "allow"), 9: ("h.org", "/es/", "org/es/", "block"), 10: ("b:", "//c/d", None, "allow"),
    }
    many = [(k, f"http://s.com/spam/{k}") for k in range(60)] + [(100 + k, f"http://s.com/news/{k}/x") for k in range(60)]
    df = spark.createDataFrame(many, "page_id long, url string")
    out = urls.judge(df, rules=(("block", "s.com", "/spam/1"), ("block", "s.com", "/spam/2"), ("block", "s.com", "/spam/3"), ("allow", "s.com", "/news/1"))).collect()
    assert {r["template"] for r in out} == {"/spam/*", "/news/*/x"}
    assert all(r["verdict"] == ("block" if r["page_id"] < 100 else "allow") for r in out)
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_merge_at_every_level(spark):
    """Branches that are alike merge at any level, so pages no rule names are rejected by templates learned elsewhere."""
    rules = [("block", f"s{h}.com", f"/{x}/spam/{k}") for h in range(2) for x in ("a", "b", "c") for k in range(12)] + [("allow", f"s{h}.com", f"/{x}/news/{k}") for h in range(2) for x in ("a", "b", "c") for k in range(12)]
    pages = [(f"http://s{h}.com/{x}/{y}/{k}/end/deep/er/{k}", y) for h in range(2) for x in ("a", "b", "c", "new") for y in ("spam", "news") for k in range(10, 40)]
    pages += [(f"http://s0.com/p{k}/spam/{k}/end/deep/er/{k}", "spam") for k in range(30)]
    df = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(pages)], "page_id long, url string, kind string")
    out = urls.judge(df, rules=rules, least_rows=20).collect()
    merged = [r for r in out if "/~" in r["template"]]
    assert {r["template"] for r in merged} >= {"/~/spam/*/end/deep/er/*", "/~/news/*/end/deep/er/*"}
    assert all(r["verdict"] == ("block" if r["kind"] == "spam" else "allow") for r in merged)
    unruled = [r for r in merged if r["rule"] is None and r["kind"] == "spam"]
    assert unruled and all(r["verdict"] == "block" for r in unruled)


def test_urls_odd_rows(spark):
    long = "http://h.com/" + "x/" * 5000 + "y?q"
    rows = [(1, long), (2, long), (2, long), (3, None), (4, ""), (5, "://"), (6, "http:///p//q//")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and {r["template"] for r in got if r["page_id"] in (1, 2)} == {"/*" * urls.LEVELS + "/**"}
    assert {(r["host"], r["path"]) for r in got if r["page_id"] in (3, 4, 5)} == {("", "")}


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    start = table(spark, DATA, "documents")
    out = cp.run(spark, DATA)
    assert out.columns == [*start.columns, "shard"] and 0 < out.count()
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    leaks = {r["doc_id"] for r in tiling.op7_string_tiling(spark, DATA).collect()}
    assert not kept & leaks
    texts = collections.Counter(t for d, t, *_ in docs if d in kept)
    assert max(texts.values()) == 1


def exact_survivors(rows):
    """Ids that near-dedup keeps, by comparing all pairs of (id, text)."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    text, group = {d: t or "" for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if text[a] == text[b] or (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d for d in ids if root(d) == d}


def test_pipeline_equals_exact_near_dedup(spark, docs, tmp_path):
    import corpus_pipeline as cp

    planted = [t for p in changed_copies(9, (0.05, 0.1, 0.15, 0.2), 12) for t in p[:2]]
    start = table(spark, DATA, "documents")
    more = spark.createDataFrame([(10**6 + k, t, "en", "web", len(t)) for k, t in enumerate(planted)], "doc_id long, text string, lang string, source string, n_chars long")
    start.unionByName(more.select(*[F.col(c).cast(start.schema[c].dataType) for c in start.columns])).write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, DATA, name).write.parquet(f"file://{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    all_docs = table(spark, sf, "documents")
    want = exact_survivors([tuple(r) for r in all_docs.select("doc_id", "text").collect()])
    assert {r[0] for r in cp.near_deduplicated(spark, all_docs, sf).select("doc_id").collect()} == want
    good = exact_survivors([tuple(r) for r in cp.good_quality(spark, all_docs, sf).select("doc_id", "text").collect()])
    kept = {r[0] for r in cp.run(spark, sf).select("doc_id").collect()}
    assert kept and kept <= good


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    """Every stage takes nulls, very long texts, repeats, clashing names and no rows at all."""
    import corpus_pipeline as cp

    plain = odd.drop("fp", "score")
    for name, docs_ in (("odd", plain.union(plain)), ("none", plain.limit(0))):
        sf = f"file://{tmp_path}/{name}"
        docs_.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "no id"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = cp.run(spark, sf)
        assert out.columns == [*plain.columns, "shard"]
        texts = [r["text"] for r in out.collect()]
        assert (not texts) == (name == "none") and all(0 <= r["shard"] < 8 for r in out.collect())
