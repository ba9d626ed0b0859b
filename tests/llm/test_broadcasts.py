"""What grows with the input is joined by a shuffle, however small its files are."""

from loomfact.llm import common, sharding


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_directory_of_shards_is_not_broadcast(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(100 + id % 50 AS int)) AS text")
    out = sharding.shards(docs, 2_000)
    assert "Broadcast" not in _plan(out)
    got = out.groupBy("shard").agg({"n_bytes": "sum"}).collect()
    assert sum(r[1] for r in got) == 3000 * 100 + 60 * sum(range(50)) and max(r[1] for r in got) <= 2_000


def test_a_table_beyond_the_bound_is_not_broadcast_for_its_small_files(spark):
    rows = common.written(spark.range(2000).selectExpr("id % 7 AS k", "id AS v"), "rows")
    other = spark.range(7).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in _plan(other.join(common.maybe_broadcast(rows, 2000), "k"))
    large = other.join(common.maybe_broadcast(rows, 1999), "k")
    assert "Broadcast" not in _plan(large) and large.count() == 2000
