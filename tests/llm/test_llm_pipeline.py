"""The pipeline's stages: each against what its operator says on the stage's own input."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from stayframe.llm import mixing
from stayframe.llm.common import read_table, written


def test_stages(spark, data_dir):
    docs = read_table(spark, data_dir, "documents").withColumn("text", F.expr("CASE WHEN doc_id = 3 THEN '12 34 ...' WHEN doc_id = 4 THEN NULL ELSE text END"))
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, data_dir), name)
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        seen[name] = (before, set(after))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen["language_id"][0] - seen["language_id"][1] == {3, 4}
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, data_dir, "labels").collect()}
    before, after = seen["quality_filter"]
    good, bad = ([i for i in before if labels.get(i) == q] for q in (1, 0))
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.3 * len(bad)
    assert seen["near_dedup"][1] < seen["near_dedup"][0]
    assert seen["mix"][1] == seen["mix"][0] and seen["encode"][1] == seen["encode"][0]
    assert docs.where("NOT lossless").count() == 0


def test_run_is_the_stages_in_order(spark, data_dir):
    out = cp.run(spark, data_dir)
    assert out.count() > 0 and "piece_ids" in out.columns
    assert 4 <= len(cp.STAGES) <= 5


def test_mixture_outlives_files(spark, data_dir, tmp_path):
    """The order read back from several files is the schedule, whatever order the rows came in."""
    docs = read_table(spark, data_dir, "documents")
    plan = mixing.mix_sources(docs, mixing.tempered_weights(docs)).select("doc_id", "mix_slot", "mix_rank").collect()
    schedule = [r["doc_id"] for r in sorted(plan, key=lambda r: (r["mix_slot"], r["mix_rank"]))]
    shuffled = written(cp.mix(spark, docs, data_dir).repartition(7, F.xxhash64("doc_id")), "shuffled")
    cp.encode(spark, shuffled, data_dir).repartition(5, F.xxhash64("doc_id", F.lit(1))).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "mix_slot", "mix_rank")
    assert len(out.inputFiles()) > 1
    assert [r["doc_id"] for r in out.orderBy(F.asc_nulls_last("mix_slot"), "mix_rank").collect()] == schedule


def odd_documents(spark):
    words = lambda k: " ".join(f"word{k}x{i} is here," for i in range(40))
    rows = [(1, words(1)), (2, words(1)), (3, words(3)), (3, words(3)), (4, None), (5, ""), (None, words(6)), (None, words(6)), (7, words(7)), (7, words(8)), (9, words(9) + " more")]
    full = [(i, t, "en", None if i == 9 else "a", None, 1, "x", 0.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept int, mix_slot string, score double")


def test_stages_on_odd_rows(spark, data_dir):
    """Repeated rows and ids, null ids, texts and sources, columns that clash with those used inside."""
    docs = odd_documents(spark)
    known = cp.language_id(spark, docs, data_dir)
    assert known.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in known.collect()) == [0, 0, 1, 2, 3, 3, 7, 7, 9]
    assert cp.quality_filter(spark, docs, data_dir).columns == docs.columns
    left = cp.near_dedup(spark, docs, data_dir)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 1, 3, 4, 5, 7, 7, 9]
    mixed = cp.mix(spark, docs, data_dir)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()
    out = cp.encode(spark, docs, data_dir)
    assert out.count() == docs.count() and out.where("NOT lossless").count() == 0 and out.where("doc_id = 4").first()["piece_ids"] is None


def test_stages_on_an_empty_table(spark, data_dir):
    docs = odd_documents(spark).limit(0)
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, data_dir), name)
        assert docs.count() == 0


def test_quality_stage_without_labels(spark, data_dir, tmp_path):
    spark.read.parquet(f"{data_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents(spark)
    assert cp.quality_filter(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_keep_columns_of_any_name_and_kind(spark, data_dir):
    """Dotted and quoted names, a map on repeated rows, nested values."""
    docs = odd_documents(spark).withColumns({"a.b": F.col("doc_id") * 2, "we`ird": F.lit("x"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "s": F.struct(F.lit(1).alias("p.q"))})
    now = docs
    for name, stage in cp.STAGES:
        now = written(stage(spark, now, data_dir), name)
        if name != cp.STAGES[-1][0]:
            assert now.columns == docs.columns
            assert all(r["a.b"] == (r["doc_id"] and 2 * r["doc_id"]) and r["m"] == {"k": r["doc_id"]} and r["we`ird"] == "x" for r in now.collect())
    assert now.count() > 0


def test_operators_keep_columns_of_any_name(spark, data_dir):
    from stayframe.llm import langid, pieces

    docs = odd_documents(spark).withColumns({"a.b": F.lit(2), "we`ird": F.create_map(F.lit("k"), F.lit(1))})
    found = langid.identify(docs, langid.train(docs)).collect()
    assert len(found) == docs.count() and all(r["a.b"] == 2 and r["we`ird"] == {"k": 1} for r in found)
    table = pieces.load()
    back = pieces.decode(pieces.encode(docs, table), table).collect()
    assert all(r["decoded"] == r["text"] and r["a.b"] == 2 and r["we`ird"] == {"k": 1} for r in back)
