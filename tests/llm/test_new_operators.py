"""Collocations, packing and spelling variants on small fixtures: against brute force, the library and odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import docs, odd
from tidewright.llm import collocations, packing, spelling

SF = "/root/testdata/sf0.001"


# Collocations.
def phrases_by_hand(rows, least, top=2000):
    """All counts in plain dictionaries, every rule as it is worded."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang][words[i : i + size]] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q in f if len(q) == 3 and f[q] >= least and len(p) == 2 and p in (q[:2], q[1:])]
            if any(100 * f[q] >= 50 * a for q in longer):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, totals[lang], -s))
    return sorted(out)


def texts(n=120, seed=5):
    rng = random.Random(seed)
    words = ["new", "york", "New", "city", "the", "of", "ü", "und", "a" * 80, *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) + rng.choice([" new york city", "", " the of"]) for _ in range(4)]
        rows.append((rng.choice(["en", "de", None]), rng.choice([".", "\n", "\t", "! ", "\r\n"]).join(parts)))
    return rows


def lang_docs(spark, rows):
    return spark.createDataFrame([(t, lang, i) for i, (lang, t) in enumerate(rows)], "text string, lang string, id long").repartition(3)


@pytest.mark.parametrize("options", [{}, {"most_sent": 4, "most_bytes": 8, "range_size": 60, "top": 7}])
def test_phrases_against_brute_force(spark, monkeypatch, options):
    """With all words sent, with most of them joined, and with keys dealt to many ranges: the same."""
    monkeypatch.setattr(collocations, "BLOCK", 300)
    rows = texts()
    got = collocations.mine_collocations(lang_docs(spark, rows), least=5, **options).collect()
    want = phrases_by_hand(rows, 5, options.get("top", 2000))
    assert len(want) > 10
    assert sorted(tuple(r) for r in got) == want


def test_phrases_odd_rows(spark):
    assert collocations.mine_collocations(lang_docs(spark, texts(1)).limit(0)).count() == 0
    rows = [(None, None), ("en", ""), ("en", "."), ("en", "one two"), ("en", "x y. " * 12), (None, "x y. " * 10), ("und", "x y")]
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.mine_collocations(lang_docs(spark, rows)).collect()}
    # A null language is und; only whole pieces count.
    assert got == {("en", "x y"): (12, 12, 12, 26, 1_000_000), ("und", "x y"): (11, 11, 11, 22, 1_000_000)}
    clash = lang_docs(spark, rows).withColumnsRenamed({"id": "n"})
    assert collocations.mine_collocations(clash).count() == 2


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, r = 9_999_999_999_999, 99_999_999_999_999, 12_345_678_901_234
    got = spark.createDataFrame([(a, left, r)], "a long, l long, r long").select(F.expr(collocations._score("l", "r"))).first()[0]
    assert got == 1000000 * a * a // (left * r)


def test_radix_sort_and_run_lengths():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3 << 16, 5000).astype(np.uint32), rng.integers(0, 1 << 32, 5000).astype(np.uint32) & np.uint32(0xF000F)]
    keys, sums = collocations.run_lengths(columns)
    want = Counter(zip(*(c.tolist() for c in columns), strict=True))
    assert list(zip(*(k.tolist() for k in keys), strict=True)) == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]
    packed = collocations.packed(keys)
    assert (np.sort(packed) == packed).all() and all((a == b).all() for a, b in zip(collocations.unpacked(packed.tobytes(), 2), keys, strict=True))
    assert len(collocations.run_lengths([np.empty(0, np.uint32)] * 2)[1]) == 0


# Packing.
def library_ids(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_model())
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END]


HARD = [
    "", " ", "plain words here, and there. ", "Don't stop: it's the dogs' and WE'LL go", "a.b. c.. d?! e ., f . g, . h", "É é ÉCOLE, naïve. Straße, ÷, × 5×5, x÷, y",
    "été, Å ﬁn no-break em \u0085 next", "<|endoftext|> and <|startoftext|>x <|ENDOFTEXT|>", "漢字, かな. 한국어! \U0001f600, ok", "tab\tnew\nline.\nend.", "$1,000.50, 3.5%. a1, b2.", "—, —. é—, …, end…. x",
    "x" * 300 + ", " + "ab" * 200, "İstanbul ΣΑΣ, ß. ǅ", "\x0b\x0c\r a\x1cb\x1f, c", "'s 's't 'll, 're.", ", start. , . ,, ..",
]


def test_ids_are_the_librarys():
    encode = packing.Encoder(packing.default_model())
    rng = random.Random(2)
    atoms = [w for t in HARD for w in re.split("( )", t) if w]
    cases = [*HARD, *("".join(rng.choice(atoms) for _ in range(rng.randrange(30))) for _ in range(300)), *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 800), 32, 46, 44])) for _ in range(60)) for _ in range(300))]
    for text in cases * 2:
        assert np.frombuffer(encode(text.encode()), encode.kind).tolist() == library_ids(text), text


def test_ids_with_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "MOST_KNOWN", 5)
    encode = packing.Encoder(packing.default_model())
    for text in HARD * 2:
        assert np.frombuffer(encode(text.encode()), encode.kind).tolist() == library_ids(text)
    assert len(encode.known) + len(encode.old) < 60


def held_together(rows, texts_of, window):
    """Every id in one piece, sequences without gaps, nothing to pad."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts_of)
    for doc_id, pieces in by_doc.items():
        ids, at = np.array(library_ids(texts_of[doc_id]), "<u4"), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and at & (at - 1) == 0


@pytest.mark.parametrize("shard", [600, 10**6])
def test_packs_every_id_once(spark, shard):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "star", "sea", f"w{i % 7}"]) for _ in range(rng.randrange(90))), "s") for i in range(60)]
    rows += [(60, None, "s"), (61, "", "s"), (62, "word " * 700, "s"), (63, rows[0][1], "s")]
    got = packing.pack_documents(docs(spark, rows).repartition(3), window=128, shard=shard).collect()
    held_together(got, {i: t for i, t, _ in rows}, 128)
    assert (len({r["sequence_id"] >> 32 for r in got}) > 1) == (shard == 600)
    assert sum(r["score"] is None for r in got) and any((r["score"] or 0) > 0 for r in got)


def test_packing_odd_rows(spark):
    assert packing.pack_documents(odd(spark).limit(0)).count() == 0
    got = packing.pack_documents(odd(spark).withColumnRenamed("n_chars", "offset")).collect()
    assert len([r for r in got if r["doc_id"] == 4 and r["start"] == 0]) == 2 and len([r for r in got if r["doc_id"] is None and r["start"] == 0]) == 2
    assert [(r["length"], r["doc_tokens"]) for r in got if r["doc_id"] in (1, 2)] == [(1, 1)] * 2
    long = [r for r in got if r["doc_id"] == 3]
    assert sum(r["length"] for r in long) == long[0]["doc_tokens"] > 100_000


def test_neighbours_by_bm25():
    """The index's scores and their order, against the formula for each pair; then what fills a window."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(3, 40, 30)
    made = [np.append(rng.choice(25, n, p=np.arange(1, 26) / 325), packing.END).astype(np.uint16) for n in sizes]
    df = np.zeros(50)
    for d in made:
        df[np.unique(d[:-1])] += 1
    idf = np.maximum(0, np.log((len(made) - df + 0.5) / (df + 0.5)))
    mean = float(np.mean(sizes))
    index = packing.Index(made, idf, mean)

    def weight(d, t):
        tf = int((made[d][:-1] == t).sum())
        return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[d] / mean))

    for q in range(len(made)):
        query = [t for t in np.unique(made[q][:-1]) if weight(q, t) > 0]
        np.testing.assert_allclose(index.scores(q), [sum(weight(d, t) for t in query) for d in range(len(made))], atol=1e-9)
    pieces = list(packing.fill_windows([len(d) for d in made], index, 64))
    first = [d for s, d, *_ in pieces if s == 0]
    used, want = {0}, [0]
    while sum(len(made[d]) for d in want) < 64:
        best = max((d for d in range(len(made)) if d not in used), key=lambda d: (round(index.scores(0)[d], 9), -d))
        want.append(best)
        used.add(best)
    assert first == want


def test_powers_need_no_padding():
    assert packing.powers(0) == [] and packing.powers(4096) == [4096] and packing.powers(13) == [8, 4, 1]
    out = list(packing.settled([(0, 0, 0, 8, 0, None), (1, 0, 8, 5, 0, None), (1, 1, 0, 6, 5, 0.5)], 8))
    assert [(p[0], p[1], p[2], p[3], p[4]) for p in out] == [(0, 0, 0, 8, 0), (1, 0, 8, 5, 0), (1, 1, 0, 3, 5), (2, 1, 3, 2, 0), (3, 1, 5, 1, 0)]


def test_packing_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held_together(packing.op12_packing(spark, SF).collect(), {r["doc_id"]: r["text"] for r in rows}, 4096)


# Spelling variants.
def variants_by_hand(rows, least=6, count=5, times=5, noise=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        around = sorted((-m, v) for v, m in words.items() if v != w and near(w, v))
        best = around[0] if around and -around[0][0] >= times * n else None
        form[w] = best and best[1]
        out[w] = (form[w], n, len(around), best and -best[0])
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def letters(n=300, seed=8):
    rng = random.Random(seed)
    bases = ["abcdefg", "bananas", "naïvely", "Élevage", "aaaaaaa", "stopping", "postings", "xxyyzz"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 30)):
            w = rng.choice(bases[: 1 + rng.randrange(len(bases))])
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice("abé")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ", ", "1", "漢"]).join(words)))
    return rows


@pytest.mark.parametrize(("noise", "times"), [(199, 5), (3, 2)])
def test_variants_against_brute_force(spark, noise, times):
    rows = letters()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(df, times=times, noise=noise).collect()}
    want = variants_by_hand(rows, times=times, noise=noise)
    assert got == want and any(v[0] for v in want.values()) and any(v[0] and v[0] != v[1] for v in want.values()) == (times == 2)


def test_long_words_compare_by_digest(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij") for _ in range(300))
    rows = [(1, f"{base} {base} {base[:64]} {base[:64]}"), (2, f"{base[:100]}{base[101:]} {base[:100]}k{base[101:]} {base[:65]}"), (3, "z" * 5000), (4, f"{'z' * 4999} {'z' * 4999}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(df, count=1, times=2, noise=10**9).collect()}
    assert got == variants_by_hand(rows, count=1, times=2, noise=10**9)
    assert got["z" * 5000][0] == "z" * 4999 and got[base][3] == 2 and got[base[:65]][0] == base[:64]
    with pytest.raises(ValueError, match="times"):
        spelling.group_variants(df, times=1)


def test_variants_odd_rows(spark):
    assert spelling.group_variants(odd(spark).limit(0)).count() == 0
    assert spelling.group_variants(docs(spark, [(1, None, "s"), (2, "", "s"), (3, "12 漢字 short", "s")])).count() == 0
    rows = [(i, "separate separate", "s") for i in range(40)] + [(100 + i, "seperate", "s") for i in range(6)] + [(7, "separate", "s")] * 2
    got = {r["word"]: r for r in spelling.group_variants(docs(spark, rows).withColumnRenamed("n_chars", "word")).collect()}
    assert got["seperate"]["form"] == got["seperate"]["root"] == "separate" and got["separate"]["form"] is None and got["separate"]["n"] >= 80


def test_powers_add_up(spark):
    """Words of the same letters share a key, and every removed letter leaves the key of what is left."""
    from pyspark.sql import functions as F

    words = spark.createDataFrame([(1, "stopping"), (2, "postings"), (3, "stoppin")], "id long, word string")
    met = {(r["word"], r["letter"]): (r["as_removal"], r["as_exchange"]) for r in spelling.met_letters(words).collect()}
    assert met[("stopping", "g")] == (True, False)
    assert met[("stopping", "p")] == (False, True) and met[("postings", "s")] == (False, True)
    assert words.select(spelling.power(F.lit("é"))).first()[0] == 233**5
