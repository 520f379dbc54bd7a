"""What the plans of the operators look like."""

from tests.llm import cases
from tidewell.llm import chat, decontaminate, sharding, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_stay_in_the_engine(spark):
    items = decontaminate.sketched(spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))
    talk = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (chat.op8_chat(talk), sharding.op3_sharding(cases.docs(spark)), decontaminate.candidates(cases.docs(spark), items)):
        assert not any(word in plan(df) for word in ("Python", "Pandas", "Arrow", "Cartesian", "BroadcastNestedLoop"))


def test_anchors_are_compared_without_a_pair_join(spark):
    distinct = spark.range(100).selectExpr("id fp")
    shape = plan(simhash.anchor_links(distinct))
    assert "Join" not in shape and "hashpartitioning(anchor" in shape


def test_only_needed_columns_are_read(spark, tmp_path):
    cases.docs(spark).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    shape = plan(simhash.fingerprints(docs))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shape
