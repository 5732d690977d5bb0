"""Co-training and the pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from docweave.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_co_training_separates_held_out_labels(spark, docs, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.with_quality(table, labels.where("doc_id % 4 <> 0"), "q")  # the rest is never learned from
    rest = scored.join(labels.where("doc_id % 4 = 0").select("doc_id", "quality", "toxic"), "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    right = rest.agg(F.avg((quality.kept("q") == good).cast("int"))).first()[0]
    clean = rest.where(good).agg(F.avg(quality.kept("q").cast("int"))).first()[0]
    assert right > 0.9 and clean > 0.97
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns  # labels of other documents: nothing is learned here
    assert quality.drop_rejected(none, labels).count() == 0
    assert quality.drop_rejected(docs, labels.where("false")).count() == docs.count()


def test_a_view_that_is_never_sure_teaches_nothing():
    rng = np.random.default_rng(1)
    n = 600
    y = (rng.random(n) < 0.5).astype(float)
    sure = (np.arange(n), y.astype(int), 2)
    noise = (np.arange(n), rng.integers(0, 4, n), 4)
    known = np.arange(n) < 400
    held = known & (np.arange(n) % 5 == 0)
    m = quality.co_train([sure, noise], y, known, held)
    w = m["combination"]
    assert abs(w[0]) > abs(w[1]) and np.ptp(m["weights"][1][:4]) < 4


def test_a_rare_class_is_learned_from_all_its_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 200)
    rng = np.random.default_rng(5)
    usual = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(usual, 40)) + (" venom spite" if i % 75 == 0 else "") for i in range(3000)]
    rows = [(i, t, "src", "en", len(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 7 > 0), int(i % 75 == 0)) for i in range(3000) if i % 150 or i % 4], "doc_id long, quality int, toxic int")
    got = quality.with_quality(table, labels, "q").select("doc_id", "q.toxic_score").collect()
    found = {r.doc_id for r in got if r.toxic_score >= 0.5}
    toxic = set(range(0, 3000, 75))  # the pool has only those without a label
    assert len(found & toxic) >= 0.9 * len(toxic) and len(found - toxic) < 0.01 * len(got), (len(found & toxic), len(found - toxic))
    assert quality.shares({(1, 0): 5000, (0, 1): 3, (0, 0): 90}, 200) == {(0, 1): 3, (0, 0): 90, (1, 0): 107}


def test_stages_keep_columns_and_take_effect(spark, docs):
    left = docs.where("doc_id is not null")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "jaccard_join", "benchmark_decontamination", "secret_scan", "bin_slack_packing"
    ]
    for name in list(steps)[:-1]:
        left = steps[name](spark, left, "/root/testdata/sf0.001")
        assert left.columns == docs.columns and left.dtypes == docs.dtypes
    ids = sorted(r.doc_id for r in left.select("doc_id").collect())
    assert ids == [1, 4, 5, 6, 7, *range(9, 19)]
    assert left.where("doc_id = 15").first().text == 'key [secret]" [secret] ok'
    assert steps["bin_slack_packing"](spark, left, SF).select("doc_id").distinct().count() == len(ids)


def test_every_operator_is_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert names == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_sql_twins(spark):
    con = check.connect(SF)
    for name in queries.ORACLES:
        assert check.compare(spark, con, SF, name).startswith("ok"), name


def test_labels_of_one_target_and_texts_of_any_kind(spark):
    """A label without toxicity teaches quality alone; null, empty and very long texts are scored by what was learned."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("toxic", F.lit(None).cast("int"))
    table = spark.read.parquet(f"{SF}/documents.parquet")
    one = table.limit(1)
    odd = one.withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit(None).cast("string"))
    odd = odd.union(one.withColumn("doc_id", F.lit(-2).cast("long")).withColumn("text", F.lit("")))
    odd = odd.union(one.withColumn("doc_id", F.lit(-3).cast("long")).withColumn("text", F.repeat(F.lit("word and word "), 100_000)))
    scored = quality.with_quality(table.union(odd), labels, "q").select("doc_id", "q.quality_score", "q.toxic_score")
    rows = {r.doc_id: r for r in scored.collect()}
    assert {r.toxic_score for r in rows.values()} == {0.0}
    assert len({round(r.quality_score, 3) for r in rows.values()}) > 20
    assert all(0 <= rows[i].quality_score <= 1 for i in (-1, -2, -3))
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    right = sum((rows[i].quality_score >= 0.5) == (q == 1) for i, q in known.items())
    assert right > 0.9 * len(known)
