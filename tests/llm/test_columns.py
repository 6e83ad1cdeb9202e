"""Columns of the caller pass through whatever their names, those that operators use inside too."""

from pyspark.sql import functions as F

from jobloom.llm import lm_scoring, mixing, near_dups, quality_model, quality_rules

from .odd import frame, rows

INSIDE = ("_m", "_base", "_more", "_cut", "_passes", "_rank", "_h", "_own", "_lang", "_row", "_key",
          "_first", "_copy", "_shard", "_id", "_known")


def table(spark):
    data = [r for r in rows(n=12, long_words=0)]
    return frame(spark, data).withColumns({c: F.lit("mine") for c in INSIDE})


def survive(df, names=INSIDE):
    got = df.select(*[F.col(f"`{c}`") for c in names]).distinct().collect()
    assert [tuple(r) for r in got] == [("mine",) * len(names)]


def test_quality_rules(spark):
    survive(quality_rules.apply_rules(table(spark)))
    assert quality_rules.keep_good(table(spark)).columns == table(spark).columns


def test_stop_words_judge_known_languages_only(spark):
    words = " ".join(f"slovo{i}" for i in range(60))
    df = spark.createDataFrame([(1, words, "cs"), (2, words, "en"), (3, words, None)],
                               "doc_id long, text string, lang string")
    assert [r.doc_id for r in quality_rules.keep_good(df).collect()] == [1]
    assert quality_rules.keep_good(df.drop("lang")).count() == 0


def test_mixing(spark):
    out = mixing.mix(table(spark))
    survive(out)
    assert out.columns == [*table(spark).columns, "size", "source_size", "target", "copies", "shards"]
    assert mixing.emit(table(spark)).columns == table(spark).columns


def test_quality_model(spark):
    docs = table(spark)
    good = docs.where("doc_id >= 100").select("doc_id")
    survive(quality_model.classify(docs, good, F.col("doc_id") % 5 == 1))


def test_one_of_each(spark):
    survive(near_dups.one_of_each(table(spark)))


def test_counts_above_32_bits_are_kept_whole(tmp_path):
    import numpy as np
    n = np.array([1, 5, (1 << 32) + 7], np.int64)
    lm_scoring._write(f"{tmp_path}/bigram-0.key", np.arange(3, dtype="<u8"))
    lm_scoring._write(f"{tmp_path}/bigram-0.n", n.astype("<u8"))
    lm_scoring._write(f"{tmp_path}/bigram-1.key", np.arange(3, dtype="<u8"))
    lm_scoring._write(f"{tmp_path}/bigram-1.n", np.array([1, 2, 3], "<u4"))
    shards = lm_scoring._Shards(str(tmp_path), "bigram", "n", "<u4")
    found, value = shards.look_up(np.array([0, 1, 0, 1]), np.array([2, 2, 1, 9], np.uint64))
    assert found.tolist() == [True, True, True, False] and value[:3].tolist() == [n[2], 3, 5]
