import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell import skew, storage


class FakeContext:
    applicationId = "app"

    def __init__(self, spark, **conf):
        self.conf = conf
        self._jvm, self._jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

    def getConf(self):
        return self.conf


def session(spark, **conf):
    return types.SimpleNamespace(sparkContext=FakeContext(spark, **{k.replace("_", "."): v for k, v in conf.items()}))


def test_a_cluster_has_to_name_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(session(spark, spark_master="spark://host:7077"))
    assert storage.shared_root(session(spark, spark_master="local[4]")).startswith("file:/tmp/")
    named = session(spark, spark_master="yarn", **{"spark.checkpoint.dir": "file:///shared/x/"})
    assert storage.shared_root(named) == "file:/shared/x/tidewell/app"


def test_a_path_without_scheme_goes_to_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.viewfs.mounttable.other.link./shared", "file:///tmp")
        conf.set("fs.defaultFS", "viewfs://other/")
        assert storage.qualified(spark, "/shared/x") == "viewfs://other/shared/x"
        assert storage.qualified(spark, "file:/shared/x") == "file:/shared/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_scratch_tables_go(spark):
    with storage.scratch():
        inner = storage.materialize(spark.range(5), "inner")
        assert storage.exists(spark, inner._stored_at) and inner.count() == 5
    assert not storage.exists(spark, inner._stored_at)
    kept = storage.materialize(spark.range(5), "kept")
    assert storage.exists(spark, kept._stored_at)
    storage.release(kept)


def test_batches_are_sliced():
    frames = [pd.DataFrame({"a": range(n)}) for n in (5, 0, 3)]
    assert [len(f) for f in storage.sliced(iter(frames), 2)] == [2, 2, 1, 2, 1]


def test_no_query_changes_the_session(spark):
    from tidewell.plans import catalog

    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    for name in ("ingest_extraction", "chunk_documents", "embed_documents", "statistics_sql_guarded"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).collect()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before


@pytest.mark.parametrize("bound", [0, 1 << 30])
def test_hot_and_null_keys_join_once(spark, monkeypatch, bound):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", bound)
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 1200).alias("k"), F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 2).alias("v"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w")).withColumn("name", F.concat(F.lit("n"), F.coalesce(F.col("k").cast("string"), F.lit("null")))).filter("k IS NULL OR k < 900")
    got = skew.attach(left, right, ["k"], "w", 3000)
    assert got.columns == ["k", "doc_id", "v", "name"] and got.count() == 3000
    assert got.filter("name IS NOT NULL AND name <> concat('n', coalesce(cast(k AS string), 'null'))").count() == 0
    assert got.filter("name IS NULL").count() == left.filter("k >= 900").count()
    named = right.filter("k IS NOT NULL").select("k", "name")
    assert skew.attach_counted(left, named, "k").filter("name IS NOT NULL").count() == left.filter("k < 900").count()


def test_tables_are_measured(spark):
    wide = spark.range(1000).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array_repeat(F.col("id"), 100).alias("a"), F.struct("id").alias("t"))
    size = wide.agg(F.sum(skew.row_bytes(wide))).first()[0]
    assert 1_800_000 < size < 2_200_000
    assert not skew.fits(wide, 1 << 20) and skew.fits(wide, 1 << 22) and skew.fits(wide.limit(0), 0)


def test_rows_without(spark):
    rows = spark.range(10).select("id", F.lit("x").alias("text"))
    assert skew.without(rows, spark.range(3, 8).toDF("gone"), "id").columns == ["id", "text"]
    assert sorted(r["id"] for r in skew.without(rows, spark.range(3, 8).toDF("gone"), "id").collect()) == [0, 1, 2, 8, 9]
