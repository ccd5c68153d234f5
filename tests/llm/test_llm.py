"""The ten training-data operators: brute force, round trips, held-out accuracy, and the awkward inputs of each."""

import hashlib
import io
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe_chunks, common, components, exact_dedup, kd_shard, langid, license_scan, minhash, packing, quality, queries, token_output, tokens, warc, wordhash

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    """Documents with awkward columns besides."""
    rows = [(i if ids is None else ids[i], x, "en", "s", 1) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("own") for c in ("kept", "words", "keep_id", "slot", "score", "row", "shard", "facts", "suspect", "lang_pred", "ids")})


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [None, "", "  \n\t ", "same text here " * 9, "same text here " * 9, "x", "Ünï 日本 <|endoftext|> é", LONG, "same text here " * 9, "y"], [0, 1, 2, 3, 4, 5, 6, 7, 4, None]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]


# exact deduplication

def brute_exact(docs):
    groups = {}
    for i, x in docs:
        groups.setdefault(x or "", []).append(i)
    out = []
    for i, x in docs:
        ids = groups[x or ""]
        keep = max((y for y in ids if y is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((x or "").encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [1 << 15, 1 << 22])
@pytest.mark.parametrize("form", [exact_dedup.annotate, exact_dedup.decide])
def test_exact_dedup(spark, odd, none, bits, form):
    def found(df):
        return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in rows(form(df, most_bits=bits)))

    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute_exact(docs)
    assert found(none) == []
    hot = frame(spark, ["hot" if i % 3 == 0 else f"t{i // 2}" for i in range(4000)])
    assert found(hot) == brute_exact([(r.doc_id, r.text) for r in hot.collect()])
    clash = hot.withColumns({c: F.lit(1) for c in ("_k", "hot_key", "salt", "_salt", "bitmap", "a.b")})
    assert found(clash) == found(hot) and set(clash.columns) - {"kept", "keep_id"} <= set(exact_dedup.annotate(clash).columns)


def test_filters_clear_strangers(spark):
    """A filter follows the count of its members, so that few others shuffle; one that is full flags all."""
    held = common.cut(spark.range(200_000).select(F.col("id").alias("slot")))
    others = spark.range(1_000_000, 1_100_000)
    flagged = lambda f, df: common.with_probe(df, F.col("id"), f, "flag").filter("flag").count()
    sized = common.membership_filter(held)
    assert flagged(sized, spark.range(200_000)) == 200_000 and flagged(sized, others) < 3_000
    full = common.membership_filter(held, most_bits=1 << 15)
    assert flagged(full, spark.range(200_000)) == 200_000 and flagged(full, others) > 90_000


def test_group_facts_and_losers(spark):
    """One key with a third of all rows, null keys, missing groups, and losers by two keys."""
    data = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"k{i // 2}") for i in range(6000)]
    df = spark.createDataFrame(data, "id long, k string").withColumn("salt", F.lit("own"))
    sizes = {}
    for _, k in data:
        sizes[k] = sizes.get(k, 0) + 1
    groups = df.filter("k IS NOT NULL AND k <> 'k1'").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = {r["id"]: (r["k"], r["n"], r["salt"]) for r in rows(common.with_group_facts(df, groups, "k", "n", 6000, ["id"]))}
    assert got == {i: (k, None if k in (None, "k1") else sizes[k], "own") for i, k in data}
    inner = common.with_group_facts(df, groups, "k", "n", 6000, ["id"], inner=True)
    assert inner.count() == sum(k not in (None, "k1") for _, k in data)
    losers = common.cut(df.filter("id % 5 = 0").select("id", "k"))
    want = sum(not (i % 5 == 0 and k is not None) for i, k in data)  # a null key is in no list
    assert common.without_ids(df, losers, ["id", "k"]).count() == want
    assert sorted(r["id"] for r in rows(common.without_ids(df, losers, ["id"]))) == [i for i, _ in data if i % 5]


# quality rules

def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, odd, none):
    random.seed(5)
    texts = [" ".join(random.choice(["a", "bb", "the", "c|", "#"]) for _ in range(random.randint(0, 60))) + random.choice(["", "\nline\nline\n line"]) for _ in range(60)]
    for df in (odd, frame(spark, texts)):
        for r in rows(quality.annotate(df)):
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(r["text"])
            assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])
        kept = quality.annotate(df).filter("kept").select("doc_id").collect()
        assert sorted(map(str, kept)) == sorted(map(str, quality.keep(df).select("doc_id").collect())) and quality.keep(df).columns == df.columns
    assert quality.annotate(none).count() == 0
    good = "the cat of the house and a dog in the garden was on the road to the town with that old man from by"
    assert rows(quality.annotate(frame(spark, [good, good.upper(), good.replace(" ", "## ")])))[0]["kept"]
    assert [r["kept"] for r in rows(quality.annotate(frame(spark, [good, good.upper(), good.replace(" ", "## ")])))] == [True, False, False]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


# language

def test_language_scores_sum_all_segmentations():
    pieces = ["", "▁", "a", "b", "ab", "▁a", "ba"]
    model = langid.build(pieces, ["p", "q"], np.array([[0, 0], [5, 1], [3, 9], [2, 2], [7, 1], [1, 4], [2, 2]]))
    scorer = langid.Scorer(model)

    def total(word, k):
        if not word:
            return 1.0
        out = model.unknown * total(word[1:], k)
        for i, p in enumerate(pieces):
            if p and word.startswith(p):
                out += model.table[i, k] * total(word[len(p) :], k)
        return out

    words = ["▁ab", "▁aba", "▁bbab", "▁zab"]
    assert np.allclose(np.exp(scorer.words(words)), [[total(w, k) for k in (0, 1)] for w in words], rtol=1e-9)


def test_language_sums_long_words_whole(monkeypatch):
    pieces = ["", "▁", "a", "b", "ab", "▁a", "ba", "日本", "日", "abab"]
    rng = np.random.default_rng(1)
    model = langid.build(pieces, ["p", "q"], rng.integers(0, 9, (len(pieces), 2)))
    at = {p: i for i, p in enumerate(pieces) if p}

    def plain(word):
        alpha, logs = [np.ones(2)], np.zeros(2)
        for t in range(1, len(word) + 1):
            new = alpha[-1] * model.unknown
            for n in range(1, min(t, len(alpha), model.longest) + 1):
                if word[t - n : t] in at:
                    new = new + alpha[-n] * model.table[at[word[t - n : t]]]
            logs += np.log(new)
            alpha = [x / new for x in [*alpha, new]][-model.longest :]
        return logs

    random.seed(3)
    words = ["▁" + "".join(random.choice("ab日本z") for _ in range(n)) for n in (1, 64, 65, 66, 300, 1000, 5000)]
    words += ["▁" + "ab" * 1200, "▁b"]
    want = np.array([plain(w) for w in words])
    assert np.allclose(langid.Scorer(model).words(words), want, rtol=1e-9)
    monkeypatch.setattr(langid, "GROUP_CHARS", 37)
    assert np.allclose(langid.Scorer(model).words(words), want, rtol=1e-9)


def test_language(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out()))
    judged = rows(langid.predict(docs, model).withColumn("out", langid.held_out()))
    out = [r for r in judged if r["out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in judged)
    found = rows(langid.predict(odd, model))
    assert [r["lang_pred"] for r in found][:3] == ["und"] * 3 and len(found) == odd.count()
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in rows(langid.predict(odd, langid.fit(none)))} == {"und"}


# tokens and packing

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_encoder_agrees_with_the_library(library):
    enc = tokens.encoder(tokens.vocabulary_path())
    random.seed(2)
    signs = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0x1F600, 0x1E00, 0x660, 0xFEFF, 0x85]]
    texts = ["".join(random.choice(signs) for _ in range(60)) for _ in range(300)] + ["a<|endoftext|>b", "it's  we'll \n\n x ", ""]
    for x in texts:
        ids = library.encode(x, add_special_tokens=False).ids
        assert enc.encode(x).tolist() == ids
        assert enc.decode_bytes(np.array(ids, np.uint32)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def packed_rows(df, library, docs, capacity, seq):
    """Checks that pieces rebuild each document and fill their sequences without gaps."""
    by_doc, by_seq = {}, {}
    for r in df:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(seq(r), []).append((r["offset"], r["length"]))
    for held in by_seq.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    for i, x in docs.items():
        ids = np.array([*library.encode(x or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        at, pieces = 0, sorted(by_doc[i], key=lambda r: r["piece"])
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == capacity for r in pieces[1:])
    return by_seq


def test_packing(odd, none, library):
    docs = {r.doc_id: r.text for r in odd.collect()}
    once = odd.dropDuplicates(["doc_id"])
    found = packed_rows(rows(packing.pack(once, 64)), library, docs, 64, lambda r: r["sequence_id"])
    total = sum(n for held in found.values() for _, n in held)
    assert len(found) <= -(-total // 64) + 1
    assert packing.pack(none).count() == 0
    assert packing.pack(odd, 64).count() > packing.pack(once, 64).count()


def test_plan_is_best_fit_decreasing():
    random.seed(7)
    for _ in range(60):
        capacity = random.choice([8, 16, 64])
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 200))]
        counts = {n: items.count(n) for n in set(items)}
        places = packing.plan(counts, capacity)
        seqs = {}
        for n, count in counts.items():
            for rank in range(count):
                (_, low, _, base, per, place), = [p for p in places if p[0] == n and p[1] <= rank < p[2]]
                seqs.setdefault(base + (rank - low) // per, []).append((place + n * ((rank - low) % per), n))
        for held in seqs.values():
            assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(held)))
        free = []
        for n in sorted(items, reverse=True):
            fits = [(f, i) for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits)[1]] -= n
            else:
                free.append(capacity - n)
        tree = token_output.pack(items, capacity)
        assert len(free) == len(seqs) == 1 + max(r for r, _ in tree)


def test_token_files(spark, odd, none, library):
    once = odd.dropDuplicates(["doc_id"]).repartition(3)
    docs = {r.doc_id: r.text for r in odd.collect()}
    packed_rows(rows(token_output.round_trip(once, 64)), library, docs, 64, lambda r: (r["file"], r["row"]))
    assert token_output.round_trip(none).count() == 0
    blob = token_output.block_file([np.arange(3), np.arange(5)], [(1, 0, 0), (None, 0, 0)], 6, 2, "<u2")
    with np.load(io.BytesIO(blob)) as f:
        assert f["cu_seqlens"].tolist() == [0, 5, 8] and f["row_segments"].tolist() == [0, 1, 2] and f["ids"].shape == (2, 6)
    assert [(d, list(ids)) for d, _, _, ids, _, _ in token_output.segments(blob)] == [(None, [0, 1, 2, 3, 4]), (1, [0, 1, 2])]


# chunk reuse

def test_joins_are_repaired(library):
    enc = tokens.encoder(tokens.vocabulary_path())
    joiner = bpe_chunks.Joiner(enc)
    random.seed(3)
    alphabet = ["the ", "house", "'ll", "  ", "\n", "é", "日本", "123", "!?", " x", "\t", "ing ", "　"]
    for _ in range(300):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(2, 60)))
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = sorted({len(text[:k].encode()) for k in random.sample(range(1, len(text)), min(5, len(text) - 1))} | {len(data)})
        begins = [0, *cuts[:-1]]
        known = [enc.encode_plain(data[a:b].tobytes().decode()) if random.random() < 0.6 else None for a, b in zip(begins, cuts, strict=True)]
        assert joiner.encode(data, cuts, known).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks(spark, odd, none, library):
    shared = LONG[:9000]
    more = frame(spark, [f"{i} {shared} tail {i}" for i in range(6)] + [LONG, LONG])
    for df in (odd, more):
        for r in rows(bpe_chunks.encode(df).join(df.select("doc_id", "text").distinct(), "doc_id")):
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert bpe_chunks.encode(df).count() == df.count()
    assert bpe_chunks.encode(none).count() == 0


# WARC

def test_salvage():
    random.seed(4)
    bodies = [bytes(random.randrange(256) for _ in range(random.randrange(0, 2500))) for _ in range(25)]
    for pack in (warc.gzip_member, bytes):
        parts = [pack(warc.record_bytes(i, "http://x/", b, hashlib.sha256(b).hexdigest(), None)) for i, b in enumerate(bodies)]
        at = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        broken = bytearray(b"".join(parts))
        for k in (2, 3, 9, 24):
            broken[at[k] + len(parts[k]) // 2] ^= 0xFF
        data = bytes(broken[: at[15]]) + b"junk \x1f\x8b\x08 WARC/1.0\r\n" + bytes(broken[at[15] :])
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        assert [x.payload for x in found if isinstance(x, warc.Record)] == [b for i, b in enumerate(bodies) if i not in (2, 3, 9, 24)]
        spans = sorted((x.offset, x.end) for x in found if isinstance(x, warc.Gap))
        assert spans[0] == (at[2], at[4]) and spans[-1][1] == len(data)
        assert all(x.reason for x in found if isinstance(x, warc.Gap))
    assert list(warc.salvage(io.BytesIO(b""), 0)) == []


def test_salvage_inside_members():
    random.seed(5)
    bodies = [bytes(random.randrange(256) for _ in range(900)) for _ in range(12)]
    parts = [warc.record_bytes(i, "http://x/", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)]

    def found(data):
        out = list(warc.salvage(io.BytesIO(data), len(data)))
        return [bodies.index(x.payload) for x in out if isinstance(x, warc.Record)], [x for x in out if isinstance(x, warc.Gap)]

    hurt = bytearray(b"".join(parts))
    hurt[len(parts[0]) * 3 + 900] ^= 0xFF
    kept, gaps = found(warc.gzip_member(bytes(hurt)) + warc.gzip_member(parts[3]))
    assert kept == [0, 1, 2, *range(4, 12), 3] and len(gaps) == 1 and "block digest" in gaps[0].reason
    kept, gaps = found(warc.gzip_member(b"".join([*parts[:5], b"junk between", *parts[5:]])))
    assert kept == list(range(12)) and len(gaps) == 1
    whole = warc.gzip_member(b"".join(parts))
    kept, gaps = found(whole[: len(whole) // 2])
    assert kept == list(range(len(kept))) and len(kept) in (5, 6) and gaps
    torn = bytearray(whole)
    torn[len(whole) // 2 : len(whole) // 2 + 200] = bytes([255]) * 200
    kept, gaps = found(bytes(torn) + warc.gzip_member(parts[11]))
    assert kept[:5] == [0, 1, 2, 3, 4] and kept[-1] == 11 and gaps
    torn = bytearray(whole)
    torn[-6] ^= 0xFF
    assert found(bytes(torn))[0] == list(range(12))


@pytest.mark.parametrize("hold", [0, 1 << 24])
def test_salvage_at_every_cut(monkeypatch, hold):
    """Members of three records, cut off or hurt anywhere, then a whole one: what isn't touched comes back."""
    monkeypatch.setattr(warc, "HOLD", hold)
    random.seed(6)
    bodies = [bytes(random.randrange(256) for _ in range(80)) for _ in range(4)]
    parts = [warc.record_bytes(i, "http://x/", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)]
    whole, tail = b"".join(parts[:3]), warc.gzip_member(parts[3])
    ends = list(itertools.accumulate(map(len, parts[:3])))

    def found(data):
        return [bodies.index(x.payload) for x in warc.salvage(io.BytesIO(data), len(data)) if isinstance(x, warc.Record)]

    for cut_at in range(0, len(whole), 13):  # inside the plain bytes, then compressed
        hurt = bytearray(whole)
        hurt[cut_at] ^= 0x55
        got = found(warc.gzip_member(bytes(hurt)) + tail)
        touched = next(i for i, e in enumerate(ends) if cut_at < e)
        assert [i for i in got if i != touched] == [i for i in (0, 1, 2, 3) if i != touched]
        assert found(bytes(hurt) + parts[3]).count(3) == 1
        assert found(warc.gzip_member(whole[:cut_at]) + tail) == [*range(sum(e <= cut_at + 4 for e in ends)), 3]
    packed = warc.gzip_member(whole)
    for cut_at in range(0, len(packed), 7):
        got = found(packed[:cut_at] + tail)
        assert got[-1] == 3 and got[:-1] == list(range(len(got) - 1))
        hurt = bytearray(packed)
        hurt[cut_at] ^= 0x55
        got = found(bytes(hurt) + tail)
        assert got[-1] == 3 and got == sorted(set(got))


def test_salvage_is_linear_and_bounded():
    import time

    body = random.Random(1).randbytes(1500)
    one = warc.gzip_member(warc.record_bytes(1, "u", body, hashlib.sha256(body).hexdigest(), None))
    hurt = bytearray(one)
    hurt[len(hurt) // 2] ^= 0xFF
    took = {}
    for mb in (4, 16):
        data = bytes(hurt) * ((mb << 20) // len(hurt))
        began = time.perf_counter()
        (gap,) = warc.salvage(io.BytesIO(data), len(data))
        took[mb] = time.perf_counter() - began
        assert (gap.offset, gap.end) == (0, len(data))
    assert took[16] < 10 * took[4]


def test_digest_labels():
    import base64

    for label, f in (("sha1", hashlib.sha1), ("SHA-256", hashlib.sha256), ("md5", hashlib.md5)):
        good, bad = f(b"x").digest(), f(b"y").digest()
        for code in (lambda d: d.hex(), lambda d: base64.b32encode(d).decode()):
            assert warc._digest_of(f"{label}:{code(good)}", b"x") is True and warc._digest_of(f"{label}:{code(bad)}", b"x") is False
    assert warc._digest_of("blake3:00", b"x") is None and warc._digest_of("", b"x") is None
    text = warc.record_bytes(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None).replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: crc9:")
    (one,) = warc.salvage(io.BytesIO(text), len(text))
    assert one.unchecked == "warc-payload-digest"
    wrong = text.replace(b"WARC-Payload-Digest: crc9:", b"WARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nX: ")
    assert [type(x) for x in warc.salvage(io.BytesIO(wrong), len(wrong))] == [warc.Gap]


@pytest.mark.parametrize("pack", [warc.gzip_member, bytes])
def test_salvage_reads_long_headers(pack):
    data = pack(warc.record_bytes(1, "data:" + "x" * 200_000, b"body", hashlib.sha256(b"body").hexdigest(), None))
    (one,) = warc.salvage(io.BytesIO(data), len(data))
    assert one.payload == b"body" and len(one.headers["warc-target-uri"]) == 200_005


def test_warc_round_trip(spark):
    big, small = "é" * 5000, "tiny"
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, big), (4, "a\r\nb", big), (5, "u", small), (6, "u", small), (None, "u", big), (4, "u", big)], "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    found = sorted(map(str, (tuple(r) for r in warc.round_trip(pages).collect())))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, 0, sha(""), "response", None), (2, 0, sha(""), "response", None), (3, 10000, sha(big), "response", None), (4, 10000, sha(big), "revisit", 3), (4, 10000, sha(big), "revisit", 3), (5, 4, sha(small), "response", None), (6, 4, sha(small), "response", None), (None, 10000, sha(big), "response", None)]
    assert found == sorted(map(str, want))
    assert warc.round_trip(pages.filter("page_id > 99")).count() == 0
    named = spark.createDataFrame([("a b", "u", big), ("ü/1", "u", big), ("c", "u", LONG * 8), (None, None, None)], "page_id string, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(named))}
    assert got == {"a b": (10000, "response", None), "ü/1": (10000, "revisit", "a b"), "c": (8 * len(LONG), "response", None), None: (0, "response", None)}


# near-duplicates

def brute_near(docs, k, percent):
    sets = {}
    for i, x in docs.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("block", [4, 512])
def test_near_dedup(spark, odd, none, block):
    random.seed(9)
    base = [f"w{random.randrange(5000)}" for _ in range(120)]
    texts = {i: x for i, x in enumerate(["", None, "one", "One", "two words", LONG, LONG + " z"])}
    for i in range(60):  # a chain of copies, each with more words changed
        w = list(base)
        for _ in range(random.randrange(0, 8)):
            w[random.randrange(len(w))] = f"x{random.randrange(9999)}"
        texts[100 + i] = " ".join(w)
    df = frame(spark, list(texts.values()), list(texts))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(minhash.groups(df, 3, 85, block=block))}
    assert found == brute_near(texts, 3, 85)
    if block == 512:
        assert minhash.groups(none).count() == 0
        got = rows(minhash.groups(odd, 3, 85))
        assert len(got) == odd.count() and [r for r in got if r["doc_id"] is None][0]["kept"] is False
        assert minhash.keep_one(odd, 3, 85).columns == odd.columns


def test_bayes_and_bands():
    assert minhash.banding(85) == (37, 6) and minhash.banding(80) == (44, 5)
    least = minhash.least_matches(85)
    assert least == sorted(least) and least[-1] < 0.85 * minhash.HASHES


def test_crowded_bands(spark, monkeypatch):
    """Texts that differ but share a band cost about one visit each; links within it are found by another shared band."""
    rng = np.random.default_rng(8)
    n, block = 640, 16
    places = [rng.integers(0, 1 << 16, minhash.HASHES).astype("<u2") for _ in range(n)]
    pairs = [(i, i + 320) for i in range(0, 40, 2)]
    for i, j in pairs:
        places[j] = places[i].copy()
        places[j][::40] = 7
    bands = {i: [1] + ([100 + i, 2] if any(i in p for p in pairs) else []) for i in range(n)}
    for i, j in pairs:
        bands[j] = [1, 100 + i, 2]
    for i in range(41, 300, 2):
        bands[i].append(2)
    for i in range(300, 312):  # these pairs share crowded bands only
        places[i + 320] = places[i].copy()
        bands[i], bands[i + 320] = [1, 2], [1, 2]
        pairs.append((i, i + 320))
    flat = [(g, i, bytearray(places[i].tobytes())) for i in range(n) for g in bands[i]]
    members = minhash._sized(spark.createDataFrame(flat, "grp long, id long, payload binary").select("grp", "id"))
    members = members.join(spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(places)], "id long, payload binary"), "id").select("grp", "size", "id", "payload")
    seen, plain = [], minhash._linked
    monkeypatch.setattr(minhash, "_linked", lambda df, m: (seen.append(df.filter("visits").count()), plain(df, m))[1])
    found = minhash.link_groups(members, minhash.Signatures(85), block, banded=True)
    root = {i: i for i in range(n)} | {r.node: r.component for r in components.components(found).collect()}
    assert all(root[i] == root[j] for i, j in pairs) and len(set(root.values())) == n - len(pairs)
    assert sum(seen) < members.count() * 3 < n * n // block


def test_registered_near_dedup_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = brute_near({r.doc_id: r.text for r in docs.collect()}, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(queries.QUERIES["op5_minhash_near_dedup"](spark, data))}
    assert got == want


def test_components_of_large_stars(spark):
    """A centre that is smaller, or larger, than all it is linked with."""
    edges = [(0, i) for i in range(1, 3000)] + [(9000, i) for i in range(3000, 6000)] + [(2999, 3000)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0} and len(found) == 6001
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    random.seed(11)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_word_hashes_respect_documents():
    import pyarrow as pa

    texts = ["a b", "b", "", None, "A  B\t", "ab"]
    got = dict(wordhash.document_words(pa.array(texts)))
    assert got[0].tolist() == got[4].tolist() and got[1].tolist() == got[0][1:].tolist() and len(got[3]) == 0 and got[5][0] not in got[0]


# sharding

def brute_kd(points, shards, first=0):
    """The tree by sorting: points are (id, size, values, tie); the ranges of the whole table come with the first call."""
    span = [(max(p[2][d] for p in points) - min(p[2][d] for p in points)) or 1.0 for d in range(3)]

    def split(held, first, shards):
        if shards == 1 or not held:
            return {p[0]: first for p in held}
        low = [min(p[2][d] for p in held) for d in range(3)]
        wide = [max(p[2][d] for p in held) - low[d] for d in range(3)]
        d = max(range(3), key=lambda d: wide[d] / span[d])
        key = lambda p: (int((p[2][d] - low[d]) / (wide[d] or 1.0) * float((1 << kd_shard.GRID_BITS) - 1)), p[3])
        held = sorted(held, key=key)
        goal, upto = sum(p[1] for p in held) * (shards // 2) / shards, 0
        for k, p in enumerate(held):
            upto += p[1]
            if upto >= goal:
                k += upto - goal <= goal - (upto - p[1])
                break
        return split(held[:k], first, shards // 2) | split(held[k:], first + shards // 2, shards - shards // 2)

    return split(points, first, shards)


def test_kd_sharding(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df, n in ((docs, 4), (odd, 2)):
        got = rows(kd_shard.shard_documents(df, n))
        assert len(got) == df.count() and {r["shard"] for r in got} <= set(range(n))
        for s in range(n):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        assert all(r["law"] == "bytes" and r["grown_shard"] is None and r["text_crc32"] is not None for r in got)
    got = rows(kd_shard.shard_documents(docs, 4))
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert kd_shard.shard_documents(none, 4).count() == 0
    same = frame(spark, ["equal text"] * 64)
    assert [sum(r["shard"] == s for r in rows(kd_shard.shard_documents(same, 4))) for s in range(4)] == [16] * 4
    assert kd_shard.shards_for(same.withColumn("w", F.lit(10)), "w", 100) == 7
    assert {r["shard"] for r in rows(kd_shard.shard_to_target(same, 18 * 16))} == {0, 1, 2, 3}


@pytest.mark.parametrize("shards", [2, 6])
def test_kd_splits_match_sorting(spark, data, shards):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    body, code = F.coalesce("text", F.lit("")), lambda c: F.pmod(F.xxhash64(c), F.lit(1000))
    order = [F.shiftrightunsigned(F.xxhash64(F.xxhash64(body)), 64 - kd_shard.NEAR_BITS), F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64(body)), 64 - kd_shard.TIE_BITS)]
    points = docs.select("doc_id", F.octet_length(body) + 8, F.log2(F.octet_length(body) + 8), code("source"), code("lang"), *order).collect()
    want = brute_kd([(r[0], r[1], r[2:5], r[5:]) for r in points], shards)
    assert {r["doc_id"]: r["shard"] for r in rows(kd_shard.shard_documents(docs, shards))} == want


def test_kd_keeps_equal_texts_together(spark):
    """Copies with the same metadata part only where a median falls among them: at most once a level on each side."""
    random.seed(2)
    texts = [f"text {i % 200} " + "x" * (i % 200) for i in range(2000)]
    got = rows(kd_shard.shard_documents(frame(spark, texts), 4))
    homes = {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in homes.values()) <= 3


# licenses

def test_alignment_matches_brute_force():
    random.seed(13)

    def full(d, t):
        best, table = 0, [[0] * (len(t) + 1) for _ in range(len(d) + 1)]
        for i, j in itertools.product(range(1, len(d) + 1), range(1, len(t) + 1)):
            table[i][j] = max(0, table[i - 1][j - 1] + (1 if d[i - 1] == t[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
        return best

    for _ in range(60):
        t = [random.randrange(40) for _ in range(20)]
        d = [random.randrange(40) for _ in range(7)] + [x for x in t if random.random() > 0.1] + [random.randrange(40) for _ in range(5)]
        matches, begin, end = license_scan.align(np.array(d), np.array(t), 7, 7)
        assert 0 <= begin < end <= len(d) and matches >= full(d, t)


def test_licenses(spark, odd, none):
    grant = license_scan.TEMPLATES["mit-grant"]
    texts = ["Vorwärts! " + grant.upper().replace("COPY", "CPY") + " end", "x\nReleased  under the MIT-License!\ny", "nothing here", "Licensed under"]
    got = rows(license_scan.scan(frame(spark, texts)))
    assert [(r["doc_id"], r["template"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(0, "mit-grant"), (1, "mit-name")]
    assert all(texts[r["doc_id"]][r["first_char"] : r["end_char"]].split()[0] in ("PERMISSION", "Released") for r in got)
    first = [r for r in got if r["doc_id"] == 0][0]
    assert first["matched_words"] == first["template_words"] - 1
    twice = frame(spark, ["Licensed under CC BY-NC 4.0. " * 3])
    assert license_scan.scan(twice).count() == 3 and license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0
    with pytest.raises(ValueError):
        license_scan.Index({"short": "two words"})


def test_license_texts_and_short_variants(spark):
    whole = ["gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "apache-2.0", "mit", "isc", "bsd-2-clause", "bsd-3-clause", "cc-by-sa-4.0", "cc0-1.0"]
    texts = [f"Before.\n{license_scan.TEMPLATES[n + '-text']}\nAfter" for n in whole]
    texts += ["Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0.", "Released under the FOO License.", "Released under an MIT License.", license_scan.TEMPLATES["mit-warranty"]]
    got = {}
    for r in rows(license_scan.scan(frame(spark, texts))):
        got.setdefault(r["doc_id"], {})[r["template"]] = r["coverage"]
    for i, n in enumerate(whole):
        assert [(t, c) for t, c in got[i].items() if t.endswith("-text")] == [(n + "-text", 1.0)], n
    i = len(whole)
    assert [set(got[j]) for j in (i, i + 1, i + 3, i + 4)] == [{"cc-by-sa-4.0-name"}, {"cc-by-nc-4.0-name"}, {"mit-name"}, {"mit-warranty"}]


# pipeline

def test_pipeline(spark, data, odd, none, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "exact_dedup", "minhash_near_dedup", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, data))
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    before = kept["quality_rules"]
    newest = {x: max(i for i, y in before.items() if y == x) for x in before.values()}
    assert set(kept["exact_dedup"]) == set(newest.values())
    near = brute_near(kept["exact_dedup"], 5, 80)
    assert set(kept["minhash_near_dedup"]) == {i for i, v in near.items() if v[2]}
    packed_rows(rows(corpus_pipeline.STAGES[-1][1](spark, docs, data)), library, kept["minhash_near_dedup"], 1024, lambda r: r["sequence_id"])
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, none, data).count() == 0
        assert stage(spark, odd, data).columns == odd.columns
