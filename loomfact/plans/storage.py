"""Scans, point reads, versions and usage statistics over stand-in tables.

A customer is a novel and an order a chapter (F done, P failed, O open; priority 5 is
excluded); events are usage events; conversations are chats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import store
from ..registry import Tables, query


def chapters(t: Tables) -> DataFrame:
    """novel, chapter (rank by date), order key, status, excluded flag and words (cents of the price)."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select(
        F.col("o_custkey").alias("novel"),
        rank.cast("long").alias("chapter"),
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"),
        F.startswith("o_orderpriority", F.lit("5")).alias("excluded"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("words"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


CHAPTERS = """chapters AS (
  SELECT o_custkey AS novel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS chapter, o_orderkey AS id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
         o_orderpriority LIKE '5%' AS excluded, CAST(round(o_totalprice * 100) AS BIGINT) AS words, strftime(o_orderdate, '%Y-%m-%d') AS day
  FROM orders)"""


@query(
    "list_novels",
    f"""WITH {CHAPTERS}, c AS (
  SELECT novel, count(*) FILTER (WHERE NOT excluded) AS total, count(*) FILTER (WHERE NOT excluded AND status = 'completed') AS done, max(day) AS last_day
  FROM chapters GROUP BY novel), e AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id)
SELECT c_custkey AS novel, c_name AS title, coalesce(total, 0) AS total, coalesce(done, 0) AS done,
       CASE WHEN coalesce(total, 0) = 0 THEN 0 ELSE (coalesce(done, 0) * 1000) // total END AS progress, coalesce(last_day, '') AS last_day,
       coalesce(strftime(last_seen, '%Y-%m-%d'), '') AS last_seen
FROM customer LEFT JOIN c ON c_custkey = c.novel LEFT JOIN e ON c_custkey = user_id""",
)
def list_novels(t: Tables) -> DataFrame:
    c = chapters(t).groupBy("novel").agg(
        F.count_if(~F.col("excluded")).alias("total"),
        F.count_if(~F.col("excluded") & (F.col("status") == "completed")).alias("done"),
        F.max("day").alias("last_day"),
    )
    seen = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    novels = t.customer.select(F.col("c_custkey").alias("novel"), F.col("c_name").alias("title"))
    out = novels.join(c, "novel", "left").join(seen, F.col("novel") == F.col("user_id"), "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    progress = F.when(total == 0, F.lit(0).cast("long")).otherwise(F.floor(done * 1000 / total).cast("long"))
    return out.select(
        "novel",
        "title",
        total.alias("total"),
        done.alias("done"),
        progress.alias("progress"),
        F.coalesce("last_day", F.lit("")).alias("last_day"),
        F.coalesce(F.date_format("last_seen", "yyyy-MM-dd"), F.lit("")).alias("last_seen"),
    )


@query("find_by_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS file_hash FROM documents WHERE sha256(coalesce(text, '')) = (SELECT max(sha256(coalesce(text, ''))) FROM documents)")
def find_by_hash(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"))
    return hashed.join(F.broadcast(hashed.agg(F.max("file_hash").alias("file_hash"))), "file_hash").select("doc_id", "file_hash")


@query("chapter_stats", f"WITH {CHAPTERS} SELECT novel, count(*) AS n, sum(words) AS words, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'failed') AS failed FROM chapters WHERE NOT excluded GROUP BY novel")
def chapter_stats(t: Tables) -> DataFrame:
    kept = chapters(t).where("not excluded")
    return kept.groupBy("novel").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.count_if(F.col("status") == "completed").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("analyzed_range", f"WITH {CHAPTERS} SELECT c_custkey AS novel, coalesce(min(chapter), 0) AS first, coalesce(max(chapter), 0) AS last FROM customer LEFT JOIN chapters ON novel = c_custkey AND status = 'completed' GROUP BY c_custkey")
def analyzed_range(t: Tables) -> DataFrame:
    done = chapters(t).where("status = 'completed'").groupBy("novel").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"))
    novels = t.customer.select(F.col("c_custkey").alias("novel")).join(done, "novel", "left")
    return novels.select("novel", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", F.lit(0)).alias("last"))


@query("failed_chapters", f"WITH {CHAPTERS} SELECT novel, chapter, id FROM chapters WHERE status = 'failed' AND NOT excluded")
def failed_chapters(t: Tables) -> DataFrame:
    return chapters(t).where("status = 'failed' and not excluded").select("novel", "chapter", "id")


@query(
    "set_excluded",
    f"WITH {CHAPTERS} SELECT novel, chapter, (CASE WHEN chapter IN (1, 2) THEN false ELSE excluded END) AS excluded, (CASE WHEN chapter IN (1, 2) AND excluded THEN 'pending' ELSE status END) AS status FROM chapters",
)
def set_excluded(t: Tables) -> DataFrame:
    """Restore chapters 1 and 2: the flag goes, and a restored chapter is open again."""
    listed = F.col("chapter").isin(1, 2)
    status = F.when(listed & F.col("excluded"), "pending").otherwise(F.col("status"))
    return chapters(t).select("novel", "chapter", F.when(listed, False).otherwise(F.col("excluded")).alias("excluded"), status.alias("status"))


@query("facts_join_chapters", f"WITH {CHAPTERS} SELECT novel, chapter, l_linenumber::BIGINT AS pos, l_suppkey AS person FROM chapters JOIN lineitem ON l_orderkey = id WHERE chapter BETWEEN 2 AND 4")
def facts_join_chapters(t: Tables) -> DataFrame:
    rows = chapters(t).where("chapter between 2 and 4").join(t.lineitem, F.col("l_orderkey") == F.col("id"))
    return rows.select("novel", "chapter", F.col("l_linenumber").cast("long").alias("pos"), F.col("l_suppkey").alias("person"))


@query(
    "earlier_names",
    f"WITH {CHAPTERS}, f AS (SELECT novel, chapter, l_partkey AS place FROM chapters JOIN lineitem ON l_orderkey = id) SELECT DISTINCT novel, place FROM f WHERE chapter < 3",
)
def earlier_names(t: Tables) -> DataFrame:
    rows = chapters(t).where("chapter < 3").join(t.lineitem, F.col("l_orderkey") == F.col("id"))
    return rows.select("novel", F.col("l_partkey").alias("place")).distinct()


@query(
    "task_costs",
    f"""WITH {CHAPTERS}, tasks AS (SELECT c_custkey AS novel, c_custkey % 5 + 1 AS lo, c_custkey % 5 + 1 + c_custkey % 7 AS hi FROM customer),
f AS (SELECT novel, chapter, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS cost, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM chapters JOIN lineitem ON l_orderkey = id GROUP BY novel, chapter)
SELECT tasks.novel, lo, hi, coalesce(sum(cost), 0)::BIGINT AS cost, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM tasks LEFT JOIN f ON f.novel = tasks.novel AND chapter BETWEEN lo AND hi GROUP BY ALL""",
)
def task_costs(t: Tables) -> DataFrame:
    """Cost of each task's range of chapters: a range condition on top of the novel's key."""
    facts = chapters(t).join(t.lineitem, F.col("l_orderkey") == F.col("id")).groupBy("novel", "chapter")
    facts = facts.agg(F.round(F.sum("l_extendedprice") * 100).cast("long").alias("cost"), F.sum("l_quantity").cast("long").alias("tokens"))
    key = F.col("c_custkey")
    tasks = t.customer.select(key.alias("novel"), (key % 5 + 1).alias("lo"), (key % 5 + 1 + key % 7).alias("hi"))
    near = [F.col("t.novel") == F.col("f.novel"), F.col("f.chapter").between(F.col("t.lo"), F.col("t.hi"))]
    both = tasks.alias("t").join(facts.alias("f"), near, "left").groupBy("t.novel", "lo", "hi")
    return both.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


@query("latest_version", f"WITH {CHAPTERS} SELECT novel, chapter AS version, id, words FROM chapters QUALIFY row_number() OVER (PARTITION BY novel ORDER BY chapter DESC) = 1")
def latest_version(t: Tables) -> DataFrame:
    return store.latest(chapters(t).select("novel", F.col("chapter").alias("version"), "id", "words"), ["novel"], "version")


@query(
    "rollback_version",
    f"WITH {CHAPTERS}, v AS (SELECT novel, chapter AS version, id FROM chapters) SELECT novel, version, id FROM v UNION ALL SELECT v.novel, m.n + 1, id FROM v JOIN (SELECT novel, max(version) AS n FROM v GROUP BY novel) m USING (novel) WHERE version = 1",
)
def rollback_version(t: Tables) -> DataFrame:
    return store.rollback(chapters(t).select("novel", F.col("chapter").alias("version"), "id"), "novel", F.lit(1))


@query("upsert_state", f"WITH {CHAPTERS}, n AS (SELECT novel, max(chapter) AS last FROM chapters WHERE status = 'completed' GROUP BY novel) SELECT c_custkey AS novel, coalesce(n.last, 0) AS last FROM customer LEFT JOIN n ON n.novel = c_custkey")
def upsert_state(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("novel"), F.lit(0).cast("long").alias("last"))
    new = chapters(t).where("status = 'completed'").groupBy("novel").agg(F.max("chapter").alias("last"))
    return store.upsert(old, new, ["novel"])


@query("cascade_delete", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(t: Tables) -> DataFrame:
    novels = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    gone = t.orders.join(novels, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.without(t.lineitem, gone, ["l_orderkey"]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("recent_messages", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def recent_messages(t: Tables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t.conversations.withColumn("k", place).where("k <= 4").select("conv_id", "turn", "role", "text")


@query("export_conversations", "SELECT conv_id, count(*) AS n, string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def export_conversations(t: Tables) -> DataFrame:
    line = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.col("text"))
    rows = t.conversations.where("role is not null and text is not null").withColumn("line", line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), body.alias("markdown"))


@query("event_stats", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def event_stats(t: Tables) -> DataFrame:
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    recent = t.events.join(now, F.col("ts") >= F.col("now") - F.expr("interval 7 days"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n"))


@query("daily_trend", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_trend(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("monthly_usage", "SELECT strftime(l_shipdate, '%Y_%m') AS month, CAST(sum(l_quantity) AS BIGINT) AS tokens, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cost FROM lineitem GROUP BY 1")
def monthly_usage(t: Tables) -> DataFrame:
    month = F.date_format("l_shipdate", "yyyy_MM").alias("month")
    return t.lineitem.groupBy(month).agg(F.sum("l_quantity").cast("long").alias("tokens"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cost"))


@query(
    "cost_detail",
    """SELECT l_orderkey AS chapter, CAST(sum(l_quantity) AS BIGINT) AS input_tokens, count(*) AS entities, count(*) FILTER (WHERE l_returnflag = 'R') AS truncated,
sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cost FROM lineitem GROUP BY l_orderkey""",
)
def cost_detail(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("chapter")).agg(
        F.sum("l_quantity").cast("long").alias("input_tokens"),
        F.count("*").alias("entities"),
        F.count_if(F.col("l_returnflag") == "R").alias("truncated"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cost"),
    )


@query("models_of_novels", "SELECT o_custkey AS novel, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS models, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS ms FROM orders GROUP BY o_custkey")
def models_of_novels(t: Tables) -> DataFrame:
    models = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")
    return t.orders.groupBy(F.col("o_custkey").alias("novel")).agg(models.alias("models"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("ms"))


@query("dictionary_top", "SELECT p_partkey AS name, p_type AS kind, p_size::BIGINT AS frequency FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) <= 5")
def dictionary_top(t: Tables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("p_size"), "p_partkey"))
    rows = t.part.withColumn("k", place).where("k <= 5")
    return rows.select(F.col("p_partkey").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("frequency"))


@query("dictionary_upsert", "SELECT p_brand || '/' || p_type AS name, p_size::BIGINT AS frequency, p_partkey AS place FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) = 1")
def dictionary_upsert(t: Tables) -> DataFrame:
    """Batch insert where the last row of a name wins."""
    rows = t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("name"), F.col("p_size").cast("long").alias("frequency"), F.col("p_partkey").alias("place"))
    return store.latest(rows, ["name"], "place")


@query("override_keys", "SELECT DISTINCT event_type AS override_type, user_id AS override_key FROM events")
def override_keys(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("override_type"), F.col("user_id").alias("override_key")).distinct()


@query("override_overlay", "SELECT c_custkey AS name, coalesce(e.nation, c_nationkey)::BIGINT AS parent FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) % 25 AS nation FROM events GROUP BY user_id) e ON e.user_id = c_custkey WHERE e.kind IS NULL OR e.kind <> 'error'")
def override_overlay(t: Tables) -> DataFrame:
    """The latest override of a name sets its parent; an error event deletes it."""
    last = t.events.groupBy(F.col("user_id").alias("name")).agg(F.max_by("event_type", "event_id").alias("kind"), (F.max("event_id") % 25).alias("nation"))
    change = last.select("name", F.when(F.col("kind") == "error", None).otherwise(F.col("nation")).alias("parent"))
    base = t.customer.select(F.col("c_custkey").alias("name"), F.col("c_nationkey").cast("long").alias("parent"))
    known = change.join(base.select("name"), "name", "left_semi")
    return store.overlay(base, known, ["name"], "parent")


@query("recover_stale", "SELECT o_orderkey AS task, CASE o_orderstatus WHEN 'P' THEN 'paused' ELSE o_orderstatus END AS status FROM orders")
def recover_stale(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "P", "paused").otherwise(F.col("o_orderstatus")).alias("status"))


@query("backfill_tasks", "SELECT c_custkey AS novel FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def backfill_tasks(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("novel")).join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("novel")), "novel", "left_anti")


@query(
    "hierarchy_diff",
    """WITH o AS (SELECT s_name AS child, 'N' || s_nationkey AS parent FROM supplier WHERE s_suppkey % 5 <> 0),
n AS (SELECT s_name AS child, 'N' || (CASE WHEN s_suppkey % 3 = 0 THEN (s_nationkey + 1) % 30 ELSE s_nationkey END) AS parent FROM supplier WHERE s_suppkey % 7 <> 0),
k AS (SELECT 'N' || n_nationkey AS name FROM nation)
SELECT coalesce(o.child, n.child) AS child, CASE WHEN o.parent IS NULL THEN 'added' WHEN n.parent IS NULL THEN 'removed' ELSE 'changed' END AS kind,
       coalesce(o.parent, '') AS old_parent, coalesce(n.parent, '') AS new_parent,
       n.parent IS NOT NULL AND n.parent IN (SELECT name FROM k) AND NOT (o.parent IS NOT NULL AND contains(o.child, o.parent)) AS auto_select
FROM o FULL JOIN n ON o.child = n.child WHERE o.parent IS DISTINCT FROM n.parent""",
)
def hierarchy_diff(t: Tables) -> DataFrame:
    name = lambda k: F.concat(F.lit("N"), k.cast("string"))
    moved = F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_nationkey") + 1) % 30).otherwise(F.col("s_nationkey"))
    old = t.supplier.where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("child"), name(F.col("s_nationkey")).alias("parent"))
    new = t.supplier.where("s_suppkey % 7 <> 0").select(F.col("s_name").alias("child"), name(moved).alias("parent"))
    known = t.nation.select(name(F.col("n_nationkey")).alias("name"))
    return store.parent_changes(old, new, known).fillna("", ["old_parent", "new_parent"])


@query("vote_apply", "SELECT s_nationkey::BIGINT AS child, p AS parent, sum(w)::BIGINT AS weight FROM (SELECT s_nationkey, s_suppkey % 4 AS p, 2 AS w FROM supplier UNION ALL SELECT c_nationkey, c_custkey % 4, 1 FROM customer) GROUP BY ALL")
def vote_apply(t: Tables) -> DataFrame:
    base = t.supplier.select(F.col("s_nationkey").cast("long").alias("child"), (F.col("s_suppkey") % 4).alias("parent"), F.lit(2).cast("long").alias("weight"))
    delta = t.customer.select(F.col("c_nationkey").cast("long").alias("child"), (F.col("c_custkey") % 4).alias("parent"), F.lit(1).cast("long").alias("weight"))
    return store.added_votes(base, delta, ["child", "parent"])
