from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.plans import scale
from pathloom.plans.walk import capped_walk


def skewed(spark, n=600):
    """A third of the rows on one key, a third without a key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id").cast("string")))
    return spark.range(n).select(F.col("id"), key.alias("key"))


def test_attach_equals_a_plain_join(spark):
    fact = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3), ("unused", 4)], "key string, value int")
    want = sorted(fact.join(dim, "key", "left").select("id", "value").collect())
    for salts in (1, 8):
        assert sorted(scale.attach(fact, dim, ["key"], ["id"], salts=salts).select("id", "value").collect()) == want
        assert scale.attach(fact, dim, ["key"], ["id"], how="inner", salts=salts).count() == fact.join(dim, "key").count()


def test_hot_and_missing_keys_are_spread(spark):
    fact = skewed(spark, 6000)
    dim = fact.select("key").distinct().dropna().withColumn("value", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scale.attach(fact, dim, ["key"], ["id"], salts=64)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 1.5 * 6000 / 4


def test_ranks_do_not_depend_on_the_slices(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 - 100).alias("seq"))
    want = sorted(df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("seq"))).collect())
    for width in (1, 13, 1 << 17):
        got = scale.rank_in_group(df, ["g"], "seq", "rn", "n", width=width)
        assert sorted(got.select("g", "seq", "rn").collect()) == want
        assert {r.n for r in got.collect()} == {166, 167}


def test_rank_by_order_spans_partitions(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    want = sorted(df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc()))).collect())
    assert sorted(scale.rank_by_order(df, ["g"], [F.col("v").desc()], "rank").collect()) == want


def test_first_k_is_cut_down_before_the_shuffle(spark):
    plan = scale.first_k(skewed(spark), ["key"], [F.col("id")], 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def walk(spark, edges, cap, aliases=None):
    rows = [("s", a, i, b) for i, (a, b) in enumerate(edges)]
    seeds = spark.createDataFrame([("s", 0, "h")], "site string, pos long, url string")
    names = spark.createDataFrame(aliases, "site string, url string, alias string") if aliases else None
    visited, left = capped_walk(seeds, spark.createDataFrame(rows, "site string, src string, pos long, dst string"), cap, names)
    return [r.url for r in visited.orderBy("position").collect()], {r.site: r.left for r in left.collect()}


def test_walk_goes_level_by_level_and_stops_on_cycles(spark):
    edges = [("h", "b"), ("h", "a"), ("a", "c"), ("b", "d"), ("b", "h"), ("d", "a"), ("c", "h"), ("z", "y")]
    assert walk(spark, edges, 10) == (["h", "b", "a", "d", "c"], {})
    assert walk(spark, edges, None) == (["h", "b", "a", "d", "c"], {})
    assert walk(spark, edges, 3) == (["h", "b", "a"], {"s": 2})


def test_walk_counts_other_names_as_seen(spark):
    edges = [("h", "b"), ("b", "c"), ("h", "final"), ("b", "final2")]
    assert walk(spark, edges, 10, [("s", "b", "final2")])[0] == ["h", "b", "final", "c"]


def test_long_chains_are_compacted(spark):
    edges = [("h", "n0")] + [(f"n{i}", f"n{i + 1}") for i in range(11)]
    assert walk(spark, edges, 50)[0] == ["h"] + [f"n{i}" for i in range(12)]
