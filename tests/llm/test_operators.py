"""The corpus operators on small fixtures: against brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat, common, decontaminate, licenses, line_dedup, mixing, quality, simhash, tiff, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "a line of more than twenty characters"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, all in one table."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return docs(spark, [(1, None, None), (2, "", "a"), (3, long, "a"), (4, LINE, None), (4, LINE, None), (5, f"{LINE}\n{LINE}\n", "b"), (6, f"x\n {LINE.upper()}\t", "b"), (None, LINE, "b"), (None, None, None), (7, "\n\n", "a"), (8, "é ü 漢字", "c")])


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_lines_odd_rows(spark):
    out = by_id(line_dedup.dedup_lines(odd(spark)), "n_lines", "n_dropped", "text")
    # Ids 4, 5 and 6 hold the line: it stays in 6 alone, and the row without id counts for nothing.
    assert out[1] == (1, 0, "") and out[2] == (1, 0, "") and out[4] == (1, 1, "") and out[5] == (3, 2, "") and out[6][1] == 0 and out[7] == (3, 0, "\n\n")
    assert line_dedup.dedup_lines(odd(spark).limit(0)).count() == 0
    assert line_dedup.dedup_lines(odd(spark)).count() == odd(spark).count()


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"common line number {i} of this small corpus" for i in range(12)] + ["short", "", "  "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {i} {k} with enough characters" for k in range(rng.randrange(6))), "s") for i in range(60)]
    holders = {}
    for i, t, _ in rows:
        for key in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")}:
            holders.setdefault(key, set()).add(i)
    gone = lambda i, x: len(k := x.strip(" \t\n\x0b\x0c\r").lower()) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != i
    for n_batches, fanout in ((1, 2), (5, 2), (7, 3)):
        out = by_id(line_dedup.dedup_lines(docs(spark, rows), n_batches=n_batches, fanout=fanout), "text", "n_dropped")
        for i, t, _ in rows:
            lines = t.split("\n")
            assert out[i] == ("\n".join(x for x in lines if not gone(i, x)), sum(gone(i, x) for x in lines))


def test_runs_merge_in_order(spark):
    """Merging with runs neither shuffles nor sorts; replaced runs and, at the end, everything is deleted."""
    store = line_dedup.LineRuns(spark)
    table = docs(spark, [(i, f"{LINE} {i % 7}\nanother line of some length {i}", "s") for i in range(60)])
    found = line_dedup.occurrences(table, 20)
    for i in range(3):
        store.add(found.where(F.col("doc_id") % 4 == i))
    incoming = store._write(found.where(F.col("doc_id") % 4 == 3).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"), F.max("doc_id").alias("max_doc")))
    with line_dedup.sorted_runs(spark):
        for plan in (store.fresh(incoming), store._merged([incoming, store.runs()[0]])):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in text and "Sort [" not in text and "Exchange" not in text
    for table in [incoming, *store.runs()]:
        files = [f.rsplit("/", 1)[1].rsplit("_", 1)[1] for f in spark.table(table).inputFiles()]
        assert len(files) == len(set(files))
    store.add(found.where(F.col("doc_id") % 4 == 3))
    assert {(r["n_rows"], r["max_doc"]) for r in store.common_keys(3).collect()} == {(sum(i % 7 == k for i in range(60)), max(i for i in range(60) if i % 7 == k)) for k in range(7)}
    store._drop(incoming)
    store.close()
    fs = spark._jvm.org.apache.hadoop.fs.Path(store.root)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.name)]


def test_lines_of_text_ids(spark):
    rows = [(f"id{i}", f"{LINE}\nown {i}", "s") for i in range(9)]
    out = by_id(line_dedup.dedup_lines(docs(spark, rows, DOCS.replace("doc_id long", "doc_id string"))), "text")
    assert out == {f"id{i}": (f"{LINE}\nown 8" if i == 8 else f"own {i}",) for i in range(9)}
    assert line_dedup.dedup_lines(docs(spark, rows, DOCS.replace("doc_id long", "doc_id string")).limit(0)).count() == 0


def test_heat_join_is_a_join(spark):
    left = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id % 500) as k")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0").withColumn("v", F.col("k") * 10)
    want = sorted(map(tuple, left.join(right.drop("n"), "k").select("id", "k", "v").collect()))
    for most in (1, 4, 2000):
        assert sorted(map(tuple, common.heat_join(left, right, ["k"], "n", most).select("id", "k", "v").collect())) == want
    assert common.heat_join(left, right.limit(0), ["k"], "n").count() == 0


def test_clashing_columns(spark):
    """Columns named as what operators add or use inside are replaced or dropped, and results stay the same."""
    plain = odd(spark)
    names = ["n_lines", "n_dropped", "_key", "_id", "key", "th", "h1", "size", "target", "taken", "sid", "slice", "n_words", "n_hit", "rid", "hash", "labels", "score", "predicted", "held_out", "fp", "root", "n_bytes", "n_tokens", "pre", "page", "pixels"]
    more = plain.withColumns({n: F.lit("clash") for n in names})
    bench = spark.createDataFrame([(1, LINE)], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cases = [
        (line_dedup.dedup_lines, ["doc_id", "text", "n_lines", "n_dropped"]), (mixing.mix_sources, ["doc_id", "size", "taken"]),
        (lambda d: decontaminate.contamination(d, bench), ["doc_id", "n_words", "n_hit", "contaminated"]), (token_counts.count_tokens, ["doc_id", "n_tokens"]),
        (simhash.simhash_groups, ["doc_id", "fp", "component_id"]), (licenses.scan_licenses, ["doc_id", "n_words", "labels", "score"]), (lambda d: toxicity.score_toxicity(d, none), ["doc_id", "score", "predicted"]),
        (lambda d: quality.score_quality(d, none), ["doc_id", "score", "predicted"]),
    ]
    for fn, cols in cases:
        a, b = (sorted(map(repr, fn(d).select(*cols).collect())) for d in (plain, more))
        assert a == b


def test_mix_hits_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice("aabbbbbbcd")) for i in range(300)] + [(1000, None, None), (1001, "x", None)]
    out = mixing.mix_sources(docs(spark, rows)).collect()
    sums, size, target = {}, {}, {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and len(r["positions"]) <= 3 and all(0 <= p <= 1 for p in r["positions"])
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
    assert all(abs(sums[s] - target[s]) <= 1 for s in sums)
    assert sum(target.values()) == pytest.approx(sum(size.values())) and all(target[s] <= 3 * size[s] for s in size)
    order = [r["position"] for r in mixing.training_order(mixing.mix_sources(docs(spark, rows))).collect()]
    assert order == sorted(order)
    assert mixing.mix_sources(odd(spark)).count() == odd(spark).count() and mixing.mix_sources(odd(spark).limit(0)).count() == 0


def test_chat_round_trip(spark):
    tricky = ["", "\\", "[INST]", "a</s>b", "\\[INST]", "<<SYS>>x<</SYS>>", "[[/INST]", "<", "é<s>\n", None]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(tricky)] + [(2, 0, "user", "alone"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, target int")
    examples = chat.chat_examples(df)
    read = examples.select("conv_id", "target", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    mine = sorted((r["target"], r["loss"]) for r in read if r["conv_id"] == 1)
    assert mine == [(i + 1, t or "") for i, t in enumerate(tricky) if i % 2]
    longest = max((r for r in read if r["conv_id"] == 1), key=lambda r: r["target"])
    assert [(t["role"], t["text"]) for t in longest["turns"]] == [("user" if i % 2 == 0 else "assistant", t or "") for i, t in enumerate(tricky)]
    assert sorted(r["conv_id"] or 0 for r in read) == [0, 1, 1, 1, 1, 1, 2, 3, 3]
    assert chat.chat_examples(df.limit(0)).count() == 0


def test_tiff_codecs_and_pages(spark):
    rng = random.Random(1)
    for n in (1, 63, 64, 700, 9000):
        for data in (rng.randbytes(n), bytes(rng.choice(b"ab ") for _ in range(n)), b"x" * n):
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data
    pixels = np.frombuffer(rng.randbytes(50 * 37), np.uint8).reshape(50, 37)
    pages = [{"pixels": pixels, "compression": c, "predictor": p, **place} for c in tiff.ENCODE for p in (1, 2) for place in ({"rows": 7}, {"rows": 50}, {"tile": 16})]
    file = tiff.write_pages(pages)
    assert all(p["pixels"] == pixels.tobytes() for p in tiff.iter_pages(file)) and len(list(tiff.iter_pages(file))) == len(pages)
    # A big-endian file of 16 bits, with differencing, written by hand.
    row = np.array([5, 300, 299, 70], ">u2")
    step = np.diff(row.astype(np.int64), prepend=0).astype(">u2").tobytes()
    tags = [(256, 4), (257, 1), (258, 16), (259, 1), (273, 8), (277, 1), (278, 1), (279, 8), (317, 2)]
    big = b"MM\0*" + struct.pack(">I", 16) + step + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHIHH", t, 3, 1, v, 0) for t, v in tags) + b"\0\0\0\0"
    assert next(tiff.iter_pages(big))["pixels"] == row.tobytes()
    df = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"no")), (4, bytearray(b"")), (5, bytearray(file[:900]))], "doc_id long, media binary")
    rows = tiff.tiff_pages(df).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == len(pages) and {r["doc_id"]: r["error"] is None for r in rows if r["page"] is None} == {2: True, 3: False, 4: False, 5: False}


def features_by_hand(payload, n_pages):
    mean = sum(payload) / len(payload)
    shares = [payload.count(v) / len(payload) for v in set(payload)]
    return f"pages={n_pages};mean={mean:.3f};entropy={-sum(p * math.log2(p) for p in shares) + 0.0:.3f};values={len(shares)}"


def check_tiff_rows(texts, rows):
    """Every column of op9's rows against the payloads, and each stored form against a second writing of it."""
    for doc_id, text in texts:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = tiff.payload_file(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        got = rows[doc_id]
        assert want == tuple(got[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"))
        assert got["feature"] == features_by_hand(payload, -(-len(payload) // (tiff.ROW * tiff.PAGE_ROWS)))


def test_tiff_query_round_trip(spark):
    stored = lambda d: tiff.store_texts(d).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    out = tiff.page_digests(tiff.tiff_pages(stored(odd(spark)))).collect()
    assert len(out) == odd(spark).count()
    check_tiff_rows([(r["doc_id"], r["text"]) for r in odd(spark).where("doc_id is not null").collect()], {r["doc_id"]: r for r in out})
    assert tiff.page_digests(tiff.tiff_pages(stored(odd(spark).limit(0)))).count() == 0
    # A text of many pages goes through every form.
    file = tiff.payload_file(bytes(range(64)) * 256 * 7)
    assert {(p["compression"], p["predictor"]) for p in tiff.iter_pages(file)} == {(f["compression"], f.get("predictor", 1)) for f in tiff.FORMS}


def test_tiff_rows_of_broken_files(spark):
    """Files without pages, or whose second page is broken, among whole ones; columns that clash are dropped."""
    good = tiff.payload_file(b"abc " * 8000)
    second = [p for p in range(len(good)) if good[p : p + 2] == struct.pack("<H", 10)][-1]
    late = good[: second + 14] + struct.pack("<HHII", 257, 4, 1, 0) + good[second + 26 :]
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"II*\0")), (4, bytearray(late)), (None, bytearray(good)), (1, bytearray(good)), (5, bytearray(b""))], "doc_id long, media binary").coalesce(1)
    pages = tiff.tiff_pages(df.withColumns({"page": F.lit("clash"), "error": F.lit(1)}))
    assert [(r["page"], r["error"] is None) for r in pages.where("doc_id = 4").collect()] == [(0, True), (1, False)]
    rows = [(r["doc_id"], r["payload_bytes"]) for r in tiff.page_digests(pages).collect()]
    assert rows == [(1, 32000), (2, 0), (3, 0), (4, 16384), (None, 32000), (1, 32000), (5, 0)]
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_mutated_files_never_raise(spark):
    """2,000 files with bytes changed or cut off give rows; sizes they name aren't believed."""
    rng = random.Random(1)
    pixels = np.frombuffer(rng.randbytes(50 * 37), np.uint8).reshape(50, 37)
    seeds = [tiff.write_pages([{"pixels": pixels, "compression": c, "predictor": p, **place} for c in tiff.ENCODE for p in (1, 2) for place in ({"rows": 7}, {"tile": 16})]), tiff.payload_file(b"abc " * 1600)]
    files = []
    for i in range(2000):
        b = bytearray(rng.choice(seeds))
        for _ in range(rng.randrange(1, 12)):
            b[rng.randrange(len(b)) if rng.random() < 0.5 else max(0, len(b) - 1 - rng.randrange(300))] = rng.choice([0, 255, rng.randrange(256)])
        files.append((i, b[: rng.randrange(len(b))] if rng.random() < 0.2 else b))
    df = spark.createDataFrame(files, "doc_id long, media binary")
    assert tiff.tiff_pages(df).select("doc_id").distinct().count() == 2000
    one = lambda *fields: b"II*\0\x08\0\0\0" + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in fields) + bytes(4)
    base = {256: 8, 257: 8, 258: 8, 259: 1, 273: 0, 277: 1, 278: 8, 279: 64}
    for change, reason in (({256: 0}, "0 x 8"), ({278: 0}, "8 x 0"), ({256: 1 << 31, 257: 1 << 31}, "parts"), ({256: 1 << 31, 257: 1 << 31, 278: 1 << 31}, "bytes from"), ({266: 2}, "fill order 2"), ({277: 3, 284: 2}, "planar configuration 2"), ({258: 12}, "12 bits"), ({259: 7}, "compression 7"), ({277: 0}, "x 0")):
        with pytest.raises(ValueError, match=reason):
            list(tiff.iter_pages(one(*sorted((base | change).items()))))
    assert len(list(tiff.iter_pages(one(*base.items())))) == 1


def lists_file(parts, code=1, size=(8, 8), directories=1, fill=b"", share=True):
    """Directories whose strips of 8 rows name the given places; the lists lie after the fill, once or once for each."""
    body, out = b"II*\0" + bytes(4) + fill, bytearray()
    lists = b"".join(struct.pack(f"<{len(parts)}I", *column) for column in zip(*parts, strict=True))
    for d in range(directories):
        at = len(body) + (0 if share else d * len(lists))
        fields = [(256, 1, size[0]), (257, 1, size[1]), (258, 1, 8), (259, 1, code), (273, len(parts), at), (277, 1, 1), (278, 1, 8), (279, len(parts), at + 4 * len(parts))]
        if len(parts) == 1:
            fields[4], fields[7] = (273, 1, parts[0][0]), (279, 1, parts[0][1])
        first = len(body) + len(lists) * (1 if share else directories) + len(out)
        follows = first + 2 + 12 * len(fields) + 4 if d < directories - 1 else 0
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, 4, n, v) for t, n, v in fields) + struct.pack("<I", follows)
    start = len(body) + len(lists) * (1 if share else directories)
    return body[:4] + struct.pack("<I", start) + body[8:] + lists * (1 if share else directories) + bytes(out)


def test_files_that_name_their_bytes_over_and_over():
    """Work is bounded by the file's size, whatever overlaps; equal parts are read once, as blank tiles are in sound files."""
    mega = bytes(1 << 20)
    # 20,000 strips that are the same megabyte: read once. Places that differ by a byte: refused.
    began = time.monotonic()
    same = lists_file([(8, 1 << 20)] * 20_000, size=(8, 160_000), fill=mega)
    assert next(tiff.iter_pages(same))["pixels"] == bytes(8 * 160_000)
    with pytest.raises(ValueError, match="parts beyond"):
        list(tiff.iter_pages(lists_file([(8 + k, 1 << 20) for k in range(20_000)], size=(8, 160_000), fill=mega)))
    # Many pages over one list of strips: those come that the bytes allow, and then the reason.
    many, got = lists_file([(8, 1 << 16)] * 5_000, size=(8, 40_000), directories=2_000, fill=bytes(1 << 16)), []
    with pytest.raises(ValueError, match="beyond"):
        for page in tiff.iter_pages(many):
            got.append(len(page["pixels"]))
    assert 0 < sum(got) <= tiff.REUSE * len(many) + tiff.MOST_PAGE
    assert time.monotonic() - began < 5
    # A sound file in which two pages and all their strips are the same.
    twice = lists_file([(8, 64)] * 3, size=(8, 24), directories=2, fill=bytes(range(64)))
    assert [p["pixels"] for p in tiff.iter_pages(twice)] == [bytes(range(64)) * 3] * 2


def test_tokens_equal_the_library(spark):
    sp = token_counts.load(None)
    rng = random.Random(2)
    bits = ["a", " ", "  ", "\n", "▁", "é", "\t", "<s>", "</s>", "word", "\r", " \n", "😀", "\x01", "<unk>", "ﬁ", "日本"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(12))), "s") for i in range(400)] + [(None, None, None), (7, "7", "s")]
    for known in (0, 50):
        out = token_counts.count_tokens(docs(spark, rows), known=known).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_bytes"]) for r in out) == sorted((i or -1, len(sp.encode(t or "")), len((t or "").encode())) for i, t, _ in rows)
    assert token_counts.count_tokens(odd(spark).limit(0)).count() == 0
    # Pre-tokens too long for the shortcut and for a key, in many documents and in one.
    long = ["é" * 300, "x" * 5000, "y" * 257]
    wide = [(i, f"{long[0]} {long[1]}\n{long[i % 3]}", "s") for i in range(60)] + [(99, long[2] + "\n" * 300, "s")]
    assert by_id(token_counts.count_tokens(docs(spark, wide)), "n_tokens") == {i: (len(sp.encode(t)),) for i, t, _ in wide}
    assert {r["over_limit"] for r in token_counts.count_tokens(odd(spark)).where("doc_id = 3").collect()} == {True}


def fingerprint_by_hand(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(prints, budget=2):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= budget:
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randrange(0, 120))) for _ in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(100 + i, f"{rng.choice(base)} {rng.choice(words)}", "s") for i in range(60)] + [(300, "", "s"), (301, None, "s"), (302, "A b", "s")]
    prints = {i: fingerprint_by_hand(t) for i, t, _ in rows}
    want = linked(prints)
    got = simhash.simhash_groups(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash.simhash_groups(odd(spark)).count() == odd(spark).count() and simhash.simhash_groups(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("node_size, most, step", [(8, 1 << 19, 6), (4096, 1 << 19, 6), (16, 40, 5), (400, 3, 9)])
def test_trie_finds_every_link(spark, node_size, most, step):
    """Whatever the first cut and however deep large nodes are cut again, with many fingerprints that share their top bits."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    base[40:] &= np.uint64((1 << 30) - 1)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)
    values = np.unique(np.concatenate([base, base ^ flip(), base ^ flip() ^ flip(), base ^ flip() ^ flip() ^ flip()]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.hamming_links(df, node_size=node_size, most=most, step=step)).collect()}
    want = linked({int(v): int(v) & (1 << 64) - 1 for v in values.view(np.int64)})
    assert {v: roots.get(v, v) for v in want} == want


def windows_by_hand(text, items, size=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        n = min(size, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(words), len(hit), len(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(40)] + ["Ünter", "it's", "x-y"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 7, 10, 14, 25])))) for i in range(12)] + [(50, None), (51, "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11")]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choices(words, k=rng.randrange(30)))]
        if i % 3 == 0:
            parts += [rng.choice(items)[1] or "", " ".join(rng.choices(words, k=4))]
        rows.append((i, " ".join(parts).upper() if i % 2 else " ".join(parts), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs(spark, rows), bench), "n_words", "n_hit", "n_items")
    assert got == {i: windows_by_hand(t, items) for i, t, _ in rows}
    assert not decontaminate.contamination(docs(spark, rows), bench.limit(0)).where("contaminated").count()
    assert decontaminate.contamination(odd(spark), bench).count() == odd(spark).count()


def test_licenses(spark):
    notice = licenses.TEMPLATES["mit-grant"]
    rows = [(1, "Released under the MIT License. Under THE mit license!", "s"), (2, f"text before {notice} text after", "s"), (3, "CC-BY-NC cc by nc", "s"), (4, " ".join(notice.split()[:10]), "s"), (5, None, "s"), (None, "Apache License, Version 2.0", None)]
    got = by_id(licenses.scan_licenses(docs(spark, rows)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got[1] == (9, 2, 1, 5, "mit", "mit", 1.0)
    assert got[2][1:] == (0, None, None, "", "mit-grant", 1.0) and got[4][5:] == ("", 0.0)
    assert got[3][1:6] == (2, 0, 3, "cc-by-nc", "cc-by-nc") and got[5] == (0, 0, None, None, "", "", 0.0) and got[None][4] == "apache-2"
    assert licenses.scan_licenses(odd(spark)).count() == odd(spark).count() and licenses.scan_licenses(odd(spark).limit(0)).count() == 0


def licenses_by_hand(text, templates, threshold=0.8):
    """(labels, best containment) over every block of every template's length."""
    words, met, best = re.findall(r"[0-9a-z]+", text.lower()), set(), 0.0
    for label, template in templates:
        tokens = template.split()
        want = set(tokens)
        for at in range(max(1, len(words) - len(tokens) + 1)):
            share = len(want & set(words[at : at + len(tokens)])) / len(want)
            if share >= threshold - 1e-9:
                met.add(label)
                best = max(best, share)
    return ",".join(sorted(met)), best


def test_licenses_against_brute_force(spark):
    """Templates of 1 to 200 words, whole, thinned, stretched and cut, in texts of many blocks."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    templates = [(f"t{n}", " ".join(rng.choices(words if n < 100 else words + [f"x{i}" for i in range(150)], k=n))) for n in (1, 2, 5, 10, 40, 100, 200)] + [("t40", " ".join(rng.sample(words, 40)))]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts.append(" ".join(rng.choices(["plain", "prose", "of", *words[:8]], k=rng.randrange(60))))
            tokens = rng.choice(templates)[1].split()
            how = rng.randrange(4)
            if how == 1:
                tokens = [t for t in tokens if rng.random() < rng.choice([0.75, 0.85, 0.95])]
            elif how == 2:
                tokens = [x for t in tokens for x in ([t, "plain"] if rng.random() < 0.15 else [t])]
            elif how == 3:
                tokens = tokens[: int(len(tokens) * rng.choice([0.7, 0.79, 0.8, 0.9]))]
            parts.append(" ".join(tokens))
        rows.append((i, " ".join(parts), "s"))
    rows += [(100, " ".join([templates[6][1]] * 9), "s"), (101, templates[6][1], "s"), (102, " ".join(templates[4][1].split()[:39]), "s")]
    table = spark.createDataFrame([*templates, (None, "plain"), ("none", " ,"), templates[0]], "label string, text string")
    got = by_id(licenses.scan_licenses(docs(spark, rows), table), "labels", "score")
    for i, text, _ in rows:
        assert got[i] == pytest.approx(licenses_by_hand(text, templates)), i
    assert sum(bool(v[0]) for v in got.values()) > 20
    assert licenses.scan_licenses(docs(spark, rows), table.limit(0)).where("labels <> ''").count() == 0
    # More template words than the plan may hold, in all or in the prefixes alone: joined as tables, with the same result.
    for most in (0, 60):
        joined = licenses.scan_licenses(docs(spark, rows), table, most_words=most)
        assert by_id(joined, "labels", "score") == got
    assert licenses.scan_licenses(docs(spark, []), table, most_words=0).count() == 0


def labelled(spark, make, n=240):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfglmnprst", k=2)) * rng.randrange(1, 3) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        label = i % 2
        rows.append((i, make(rng, [rng.choice(words) for _ in range(rng.randrange(20, 200))], label), "s"))
        labels.append((i, label, label))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, cut):
    rows = scored.where("held_out").join(labels, "doc_id").select("score", label).collect()
    return sum((r["score"] >= cut) == (r[label] == 1) for r in rows) / len(rows)


def test_toxicity_held_out(spark):
    def make(rng, words, label):
        if label:
            words[rng.randrange(len(words))] = "grobian" + rng.choice(["", "s", "ish", "xx", "er"])
        return " ".join(words)

    df, labels = labelled(spark, make)
    scored = toxicity.score_toxicity(df, labels)
    assert accuracy(scored, labels, "toxic", 0.5) >= 0.9
    out = toxicity.score_toxicity(odd(spark), labels.limit(0))
    assert {r["predicted"] for r in out.collect()} == {0} and out.count() == odd(spark).count()
    assert {r["score"] for r in scored.sparkSession.createDataFrame([(1, "")], "doc_id long, text string").transform(lambda d: toxicity.score_toxicity(d, labels)).collect()} == {0.0}


def test_sample_holds_an_id_once(spark):
    """Many rows that share a labelled doc_id add one row to the training sample."""
    df, labels = labelled(spark, lambda rng, words, label: " ".join(words), n=40)
    more = df.unionByName(df.limit(1).crossJoin(spark.range(300).select("id")).drop("id"))
    both = [toxicity.labelled_sample(d, labels, "toxic", 1500, 6000) for d in (df, more)]
    assert both[0]["doc_id"].is_unique and both[0].equals(both[1])


def test_sample_of_odd_labels(spark):
    """Label rows that disagree, long documents as excerpts, candidates without a text, and no labels at all."""
    table = docs(spark, [(i, "word " * (4000 if i % 2 else 5), "s") for i in range(60)])
    rows = [(i, i % 2, i % 2) for i in range(60)] + [(i, 0, 0) for i in range(60)] + [(None, 1, 1), (1000, 1, 1)] + [(i, None, 7) for i in range(60)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(table, labels, "toxic", 1500, 3000)
    assert set(sample["label"]) == {0} and 2900 <= sample["text"].str.len().max() <= 3010
    assert sorted(sample["doc_id"]) == [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert sample.equals(toxicity.labelled_sample(table, labels, "toxic", 1500, 3000))
    one = toxicity.labelled_sample(table, spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(i, 1, 1) for i in range(100, 9000)], labels.schema), "toxic", 20, 3000)
    assert one["label"].value_counts().to_dict() == {0: 20, 1: 20}
    assert not len(toxicity.labelled_sample(table, labels.limit(0), "toxic", 10, 100))
    assert toxicity.score_toxicity(table.limit(0), labels).count() == 0


def test_quality_held_out(spark):
    df, labels = labelled(spark, lambda rng, words, label: " ".join(words if label else [w.upper() + "!!" for w in words]))
    scored = quality.score_quality(df, labels)
    assert accuracy(scored, labels, "quality", 0.3) >= 0.95
    assert quality.score_quality(odd(spark), labels).where("score between 0 and 1").count() == odd(spark).count()
    assert quality.score_quality(odd(spark).limit(0), labels).count() == 0
