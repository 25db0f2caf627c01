from __future__ import annotations

import random


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def test_stages_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    clean = [words(rng, 120) for _ in range(60)]
    passage = words(rng, 70)
    near = clean[1].split()
    near[60] = "edited"
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[0].replace(" ", "  ", 3)), (102, " ".join(near)), (103, "*** %%% $$$ &&& " * 50)]
    rows += [(110, words(rng, 40) + " " + passage), (111, passage + " " + words(rng, 40)), (112, None), (113, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in [*range(60), 100, 101, 102, 110, 111]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == docs.columns
    ids = {d for d, _ in rows}
    assert left["quality classifier"] == ids - {103}
    assert left["exact dedup"] == ids - {103, 100, 101, 113}
    assert left["SimHash near-dedup"] == ids - {103, 100, 101, 113, 102}
    assert left["substring dedup"] == left["SimHash near-dedup"] == left["packing"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "substring dedup")).collect()}
    assert len(texts[111].split()) < 70 and texts[110] == dict(rows)[110] and all(texts[i] == t for i, t in enumerate(clean))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == left["packing"]


def test_stages_on_odd_tables(spark, tmp_path, clashing):
    """Names that clash, null, repeated and large ids, and tables without rows."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    big = clashing.withColumn("doc_id", F.when(F.col("doc_id") == 9, 2**53 + 1).otherwise(F.col("doc_id"))).coalesce(1)
    for name, docs in (("full", big), ("none", big.limit(0))):
        now, before = docs, None
        for stage, f in corpus_pipeline.STAGES:
            f(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name / stage))
            before, now = now, spark.read.parquet(str(tmp_path / name / stage))
            assert stage == "packing" or now.columns == docs.columns
        if name == "none":
            assert now.count() == 0
        else:
            texts = {" ".join((r.text or "").split(" ")) for r in before.collect()}
            assert {"a b", "中文 текст ﷺ"} <= texts and 2**53 + 1 in {r.doc_id for r in now.collect()}
