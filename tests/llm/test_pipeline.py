import pytest
from pyspark.sql import functions as F

from ironsieve.session import read_table
from tests.llm.test_jaccard_join import shingle_set

cp = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents").withColumn("extra", F.lit(1)).drop("extra")
    seen = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].columns == docs.columns
    good, unique, clean, plain, mix = (s.toPandas() for s in seen[1:])
    labels = read_table(spark, SF, "labels").toPandas().set_index("doc_id").quality
    kept = good.doc_id[good.doc_id.isin(labels.index)]
    assert labels[kept].mean() > 0.94
    sets = [(i, shingle_set(t, 5)) for i, t in zip(unique.doc_id, unique.text, strict=True)]
    gone = set(good.doc_id) - set(unique.doc_id)
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            assert not (a and 100 * len(a & b) >= 80 * len(a | b))
    assert gone and set(clean.doc_id) < set(unique.doc_id) and len(plain) == len(clean)
    assert not plain.text.str.contains(r'token = "[0-9a-f]{40}').any()
    assert (mix.taken > 0).all() and (mix.taken <= 2 * mix["size"]).all()


def test_repeated_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(2, text, "en", "s", 1), (2, text, "en", "s", 1), (1, text + " eight", "en", "s", 1), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (None, text, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in out) == ["2", "3", "None"] or sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "None"]


def test_hard_rows_pass_all_stages(spark, tmp_path):
    good = read_table(spark, SF, "documents").where("length(text) > 300").limit(12)
    names = ["component_id", "shard", "size", "score", "id", "taken"]  # columns that stages name, too
    hard = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (None, "word " * 40, "en", None, 200), (900_003, "x " * 200_000, "en", "s", 400_000), (900_003, "x " * 200_000, "en", "s", 400_000), (900_004, "😀 ☃", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = good.unionByName(hard)
    for n in names:
        docs = docs.withColumn(n, F.lit("own"))
    docs.write.parquet(f"{tmp_path}/whole")
    for name, seen in (("empty", spark.read.parquet(f"{tmp_path}/whole").limit(0)), ("full", spark.read.parquet(f"{tmp_path}/whole"))):
        for k, (_, stage) in enumerate(cp.STAGES):
            if k < 4:
                before = seen.count()
                stage(spark, seen, SF).write.parquet(f"{tmp_path}/{name}{k}")
                seen = spark.read.parquet(f"{tmp_path}/{name}{k}")
                assert seen.columns == docs.columns and seen.count() <= before
                assert seen.where("size != 'own' or id != 'own'").count() == 0
            else:
                assert (cp.mixing_stage(spark, seen.drop("size", "taken"), SF).count() > 0) == (name == "full")
