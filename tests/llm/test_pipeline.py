"""The pipeline's stages, each against its own operator's rule, on the small driver tables and on odd rows."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import check_tiff_rows, fingerprint_by_hand, linked
from tidewright.llm import quality, queries, token_counts, toxicity
from tidewright.llm.simhash import simhash_groups
from tidewright.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.written(stage("toxicity")(spark, docs, SF), "t")
    assert kept.count() == score_toxicity(docs, labels).where("predicted = 0").count()
    lines = corpus_pipeline.written(stage("line dedup")(spark, kept, SF), "t")
    assert lines.count() == kept.count() and lines.columns == docs.columns
    near = corpus_pipeline.written(stage("SimHash near-dedup")(spark, lines, SF), "t")
    groups = simhash_groups(lines)
    assert near.count() == groups.select("root").distinct().count()
    assert {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in groups.collect()}
    clean = corpus_pipeline.written(stage("benchmark decontamination")(spark, near, SF), "t")
    assert clean.columns == docs.columns and clean.count() <= near.count()
    mixed = stage("source mixing")(spark, clean, SF)
    assert mixed.count() == clean.count()


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = [(1, "one two three four", "a"), (2, "one two three four", "a"), (2, "one two three four", "a"), (None, "one two three four", "a"), (None, "five six seven eight", "a"), (None, "five six seven eight", "a"), (9, None, "a"), (10, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage("SimHash near-dedup")(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "five six seven eight"), (1, "one two three four"), (9, None)]
    empty = docs.limit(0)
    for name, _ in corpus_pipeline.STAGES:
        assert stage(name)(spark, empty, SF).count() == 0


def test_odd_rows_pass_every_stage(spark):
    """Nulls in every column, empty and repeated rows, one stage after the other; by broadcast and by shuffle alike."""
    rows = [(None, None, None, None, None), (1, None, None, "a", None), (2, "", "en", None, 0), (3, "a b c d e f", "en", "a", 11), (3, "a b c d e f", "en", "a", 11), (4, "x y z " * 5000, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(fn(spark, docs, SF), "t")
        assert docs.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3, 4]
    assert stage("source mixing")(spark, docs, SF).count() == 3


def test_rows_go_by_number(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.numbered(docs)
    assert rows.select("part", "row").distinct().count() == docs.count()
    some = corpus_pipeline.written(rows.where("doc_id % 3 = 0").select("part", "row"), "t")
    sent = corpus_pipeline.by_number(rows, some, "left_semi")
    assert "Broadcast" in sent._jdf.queryExecution().toString()
    monkeypatch.setattr(corpus_pipeline, "MOST_SENT", 0)
    for how, want in (("left_semi", "doc_id % 3 = 0"), ("left_anti", "doc_id % 3 <> 0")):
        got = corpus_pipeline.by_number(rows, some, how)
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.where(want).collect())


def test_queries_have_their_columns(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        order = sorted(got.columns)
        mine = sorted(tuple(map(repr, r)) for r in got.select(*[F.col(c) for c in order]).collect())
        theirs = sorted(tuple(map(repr, r)) for r in con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall())
        assert mine == theirs, name


def test_queries_without_sql(spark):
    """The registered queries that SQL can't express: every column of every row against the operators' brute-force versions."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held_out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, module, column, cut in (("op3_quality", quality, "quality", 0.3), ("op8_toxicity", toxicity, "toxic", 0.5)):
        got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
        assert set(got) == set(docs) and set(next(iter(got.values())).asDict()) == {"doc_id", "held_out", "score", "predicted"}
        sample = toxicity.labelled_sample(spark.read.parquet(f"{SF}/documents.parquet"), labels, column, module.SAMPLE, module.SAMPLE_CHARS)
        assert not any(held_out[i] for i in sample["doc_id"])
        fitted = module.train(sample["text"].tolist(), sample["label"].to_numpy())
        scorer = module.Scorer(fitted) if module is quality else module.Scorer(*fitted)
        for i, text in docs.items():
            # One text at a time; float sums of the training may differ from run to run in their last digits.
            assert got[i]["score"] == pytest.approx(scorer.score(text), abs=1e-3) and 0 <= got[i]["score"] <= 1
            assert (got[i]["held_out"], got[i]["predicted"]) == (held_out[i], int(got[i]["score"] >= cut))
    sp = token_counts.load(None)
    for r in queries.QUERIES["op5_token_counts"](spark, SF).collect():
        n = len(sp.encode(docs[r["doc_id"]] or ""))
        assert tuple(r[c] for c in ("n_bytes", "n_tokens", "over_limit")) == (len((docs[r["doc_id"]] or "").encode()), n, n > 4096)
    prints = {i: fingerprint_by_hand(t) for i, t in docs.items()}
    roots = linked(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op7_simhash"](spark, SF).collect()} == {i: (f"{prints[i]:016x}", roots[i]) for i in docs}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_tiff"](spark, SF).collect()}
    assert set(rows) == set(docs)
    check_tiff_rows(docs.items(), rows)
