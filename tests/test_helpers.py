"""Session sizing, scan spreading, bounded broadcasts and long selections."""

from pyspark.sql import functions as F

from fieldlab.operators import joins
from fieldlab.session import scale_settings
from fieldlab.sources.tables import balanced


def test_scale_settings():
    conf = scale_settings(100 * 10**12, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) > 16000
    assert conf["spark.sql.files.maxPartitionBytes"] == str(512 << 20)
    small = scale_settings(10**6, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"


def test_balanced_spreads_single_split(spark):
    df = spark.range(1000).coalesce(1)
    out = balanced(df, 4)
    assert out.rdd.getNumPartitions() == 4
    assert sorted(r[0] for r in out.collect()) == list(range(1000))
    wide = spark.range(100).repartition(8)
    assert balanced(wide, 4) is wide


def test_bounded_broadcast_only_small(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # only explicit hints broadcast
    try:
        facts = spark.range(1000)
        small, big = spark.range(10), spark.range(100)
        plan = lambda d: facts.join(d, "id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan(joins.bounded_broadcast(small, 10))
        assert "BroadcastHashJoin" not in plan(joins.bounded_broadcast(big, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_keep_values_long_list_uses_semi_join(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    wanted = [str(i) for i in range(0, 5000, 2)]          # 2,500 values > IN-list bound
    out = joins.keep_values(df, "k", wanted)
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2500
    short = joins.keep_values(df, "k", ["1", "2", "2"])
    assert short.count() == 2
