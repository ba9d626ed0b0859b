"""Books, tasks, chats and documents of an index as keyed tables and logs, over stand-in tables.

Chapters are orders of a customer (see ``storage``); the log of a user's bookmarks and of
tasks is the events table, whose errors delete what they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records, store
from ..registry import Tables, query
from .storage import CHAPTERS, chapters


def _listed(value: str, *order: str) -> Column:
    """Values of a group joined by commas, by ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"].cast("string")), ",")


@query("list_chapters", f"WITH {CHAPTERS} SELECT novel, string_agg(chapter || ':' || status, ',' ORDER BY chapter) AS chapters FROM chapters WHERE NOT excluded GROUP BY novel")
def list_chapters(t: Tables) -> DataFrame:
    rows = chapters(t).where("not excluded").withColumn("line", F.concat_ws(":", F.col("chapter").cast("string"), "status"))
    return rows.groupBy("novel").agg(_listed("line", "chapter").alias("chapters"))


@query("chapter_contents", f"WITH {CHAPTERS} SELECT event_id, c.id, c.words FROM events JOIN chapters c ON c.novel = user_id AND c.chapter = event_id % 12 + 1")
def chapter_contents(t: Tables) -> DataFrame:
    """The chapter that each request names by (novel, number)."""
    asked = t.events.select("event_id", F.col("user_id").alias("novel"), (F.col("event_id") % 12 + 1).alias("chapter"))
    return asked.join(chapters(t).select("novel", "chapter", "id", "words"), ["novel", "chapter"]).select("event_id", "id", "words")


@query("bookmarks", "SELECT user_id AS novel, chapter, event_id FROM (SELECT *, event_id % 20 AS chapter FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, chapter ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def bookmarks(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("novel"), (F.col("event_id") % 20).alias("chapter"), "event_id", (F.col("event_type") == "error").alias("deleted"))
    return records.live(log, ["novel", "chapter"], "event_id", "deleted").select("novel", "chapter", "event_id")


@query("task_states", "SELECT user_id AS task, arg_max(event_type, event_id) AS status, min(event_id) AS created, max(event_id % 50) AS current, count(*) AS writes FROM events GROUP BY user_id")
def task_states(t: Tables) -> DataFrame:
    """State of each task from the log of its writes: the last status, the furthest progress."""
    log = t.events.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), (F.col("event_id") % 50).alias("progress"))
    return records.task_states(log)


@query("running_tasks", "SELECT o_custkey AS novel, max(o_orderkey) AS task FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def running_tasks(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("novel"), F.col("o_orderkey").alias("task"))
    return store.latest(rows, ["novel"], "task")


@query("tasks_of_novels", "SELECT o_orderkey AS task, o_orderstatus AS status, coalesce(c_name, '') AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def tasks_of_novels(t: Tables) -> DataFrame:
    """The fifty newest open tasks with the title of their novel, if there still is one."""
    titles = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"))
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P")).join(titles, "o_custkey", "left").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return rows.select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("status"), F.coalesce("title", F.lit("")).alias("title"))


@query("prescan_purged", "SELECT p_partkey AS name, p_brand AS novel, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) THEN 'done' ELSE 'none' END AS prescan FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_partkey % 10 = 0)")
def prescan_purged(t: Tables) -> DataFrame:
    """The dictionary without the novels that are purged, with the flag of the others."""
    gone = t.part.where("p_size = 1 and p_partkey % 10 = 0").select(F.col("p_brand").alias("novel"))
    done = t.part.where("p_size = 50").select(F.col("p_brand").alias("novel"), F.lit("done").alias("flag")).distinct()
    rows = store.without(t.part.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("novel")), gone, ["novel"])
    return rows.join(done, "novel", "left").select("name", "novel", F.coalesce("flag", F.lit("none")).alias("prescan"))


@query("layouts", "WITH l AS (SELECT user_id AS novel, event_id % 3 AS layer, event_type AS hash, event_id AS layout FROM events), h AS (SELECT user_id AS novel, arg_max(event_type, event_id) AS hash FROM events GROUP BY user_id) SELECT novel, layer, hash, max(layout) AS layout FROM l JOIN h USING (novel, hash) GROUP BY ALL")
def layouts(t: Tables) -> DataFrame:
    """Stored layouts that are still good: the last one of (novel, layer) under the novel's present hash."""
    rows = t.events.select(F.col("user_id").alias("novel"), (F.col("event_id") % 3).alias("layer"), F.col("event_type").alias("hash"), F.col("event_id").alias("layout"))
    now = rows.groupBy("novel").agg(F.max_by("hash", "layout").alias("hash"))
    return store.latest(rows.join(now, ["novel", "hash"], "left_semi"), ["novel", "layer", "hash"], "layout").select("novel", "layer", "hash", "layout")


@query("conversation_list", "SELECT conv_id, count(*) AS messages, max(turn) AS last, coalesce(left(arg_min(text, turn) FILTER (WHERE role = 'user'), 30), '') AS title FROM conversations GROUP BY conv_id")
def conversation_list(t: Tables) -> DataFrame:
    """Chats with their number of messages, last turn and the title that their first question gives."""
    asked = F.when(F.col("role") == "user", F.col("turn"))
    title = F.substring(F.min_by("text", asked), 1, 30)
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last"), F.coalesce(title, F.lit("")).alias("title"))


@query("messages_page", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5")
def messages_page(t: Tables) -> DataFrame:
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("k", k).where("k <= 5").select("conv_id", "turn", "role", "text")


@query("conversations_kept", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def conversations_kept(t: Tables) -> DataFrame:
    """Messages after the chats with a system message were deleted with all they hold."""
    gone = t.conversations.where("role = 'system'").select("conv_id")
    return store.without(t.conversations.select("conv_id", "turn"), gone, ["conv_id"])


@query("usage_total", "SELECT count(*) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'error')")
def usage_total(t: Tables) -> DataFrame:
    """How many usage events are left since the last one that cleared the log."""
    return records.since_cleared(t.events, "ts", F.col("event_type") == "error").agg(F.count("*").alias("total"))


@query("initial_snapshot", "WITH f AS (SELECT p_brand AS novel, l_partkey % 40 AS place, l_orderkey % 50 AS chapter, l_returnflag AS role, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT novel, place, count(*) AS freq, count(DISTINCT chapter) AS chapters, min(chapter) AS first, arg_min(role, (CASE role WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) * 1000000000 + pos) AS setting FROM f GROUP BY novel, place")
def initial_snapshot(t: Tables) -> DataFrame:
    """How often and in how many chapters each place occurs, and its first setting of the best role."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("novel"), (F.col("l_partkey") % 40).alias("place"), (F.col("l_orderkey") % 50).alias("chapter"), F.col("l_returnflag").alias("role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return records.first_snapshot(rows, ["novel", "place"], ("R", "A", "N"))


@query("snapshots_saved", "SELECT o_custkey AS novel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey AS tree, CASE o_orderstatus WHEN 'F' THEN 'auto' ELSE 'manual' END AS tag FROM orders")
def snapshots_saved(t: Tables) -> DataFrame:
    """Every snapshot with the version that it got when it was added to its novel's."""
    return records.versioned(t.orders.select(F.col("o_custkey").alias("novel"), F.col("o_orderkey").alias("tree"), F.when(F.col("o_orderstatus") == "F", "auto").otherwise("manual").alias("tag")), "novel", "tree")


@query("backup_skip", "SELECT c_custkey AS novel, 'old' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND NOT c_acctbal > 0")
def backup_skip(t: Tables) -> DataFrame:
    old, new = _novels(t)
    return records.imported(old, new, ["novel"], "skip")


@query("backup_overwrite", "SELECT c_custkey AS novel, 'new' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 <> 0")
def backup_overwrite(t: Tables) -> DataFrame:
    old, new = _novels(t)
    return records.imported(old, new, ["novel"], "overwrite")


def _novels(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customer.select(F.col("c_custkey").alias("novel"), "c_acctbal")
    return c.where("c_acctbal > 0").select("novel", F.lit("old").alias("origin")), c.where("novel % 3 = 0").select("novel", F.lit("new").alias("origin"))


@query("backup_preview", "SELECT count(*) AS novels, count(*) FILTER (WHERE c_acctbal > 0) AS conflicts FROM customer WHERE c_custkey % 3 = 0")
def backup_preview(t: Tables) -> DataFrame:
    old, new = _novels(t)
    return records.import_preview(old, new, ["novel"])


@query("index_documents", "SELECT doc_id, sha256(left(source || ' ' || lang, 500) || chr(10) || left(text, 1500)) AS hash FROM documents")
def index_documents(t: Tables) -> DataFrame:
    """What is embedded of a chapter: the beginning of its summary and of its text."""
    body = records.index_text(F.concat_ws(" ", "source", "lang"), F.col("text"))
    return t.documents.select("doc_id", F.sha2(body.cast("binary"), 256).alias("hash"))


@query(
    "index_entities",
    """WITH e AS (SELECT 'person' AS kind, l_suppkey AS name, l_orderkey AS chapter FROM lineitem UNION ALL SELECT 'place', l_partkey, l_orderkey FROM lineitem UNION ALL SELECT 'org', l_suppkey % 7, l_orderkey FROM lineitem)
SELECT kind, name, CASE WHEN kind = 'org' THEN min(chapter) ELSE max(chapter) END AS chapter FROM e GROUP BY kind, name""",
)
def index_entities(t: Tables) -> DataFrame:
    """Entity documents by (kind, name): of an organisation the first one stays, of the others the last."""
    one = lambda kind, name: t.lineitem.select(F.lit(kind).alias("kind"), name.alias("name"), F.col("l_orderkey").alias("chapter"))
    rows = one("person", F.col("l_suppkey")).union(one("place", F.col("l_partkey"))).union(one("org", F.col("l_suppkey") % 7))
    return records.entity_documents(rows, first_wins=("org",))


@query("zh_alternates", "WITH a AS (SELECT l_orderkey % 300 AS name, l_suppkey AS id, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)::BIGINT AS preferred FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT a.name, a.id, preferred, s_nationkey::BIGINT AS country FROM a JOIN supplier ON s_suppkey = a.id WHERE s_acctbal > 0")
def zh_alternates(t: Tables) -> DataFrame:
    """Alternate names of one language with their cities, once for each (name, city), preferred ones first."""
    names = t.lineitem.where("l_returnflag = 'R'").select((F.col("l_orderkey") % 300).alias("name"), F.col("l_suppkey").alias("id"), (F.col("l_linenumber") == 1).cast("long").alias("preferred"))
    cities = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("country"))
    return records.alternate_names(names, cities)


@query("name_variants", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), v AS (SELECT DISTINCT translate(name, 'aeiou', 'eioua') AS name FROM n) SELECT name, false AS added FROM n UNION ALL SELECT name, true FROM v WHERE name NOT IN (SELECT name FROM n)")
def name_variants(t: Tables) -> DataFrame:
    """Names and their spellings in other characters, where those are no names already."""
    return records.with_variants(t.part.select(F.col("p_name").alias("name")), "aeiou", "eioua")


@query("chapter_offsets", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS chapter FROM documents) SELECT doc_id, chapter::BIGINT AS chapter, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY chapter) - length(line) - 1)::BIGINT AS start FROM l")
def chapter_offsets(t: Tables) -> DataFrame:
    return records.offsets(t.documents, "doc_id", F.split("text", "\n"), gap=1)


@query("restored_contents", "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS chapter FROM documents) SELECT o_orderkey AS id, coalesce(md5(line), '') AS content FROM orders LEFT JOIN s ON s.doc_id = o_custkey AND s.chapter = o_orderkey % 5 + 1")
def restored_contents(t: Tables) -> DataFrame:
    """Chapters that were kept without their text get it back from the book, by number."""
    split = tx.lines(t.documents, "doc_id", "text").select("doc_id", (F.col("line_no") + 1).alias("chapter"), "line")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5 + 1).alias("chapter"))
    return rows.join(split, ["doc_id", "chapter"], "left").select("id", F.coalesce(F.md5(F.col("line").cast("binary")), F.lit("")).alias("content"))


@query(
    "facts_markdown",
    """WITH f AS (SELECT l_orderkey AS chapter, l_linenumber AS pos, coalesce(a.canonical, 's' || l_suppkey) AS person, l_returnflag AS action FROM lineitem LEFT JOIN (SELECT 's' || s_suppkey AS alias, 'n' || s_nationkey AS canonical FROM supplier WHERE s_suppkey % 4 = 0) a ON a.alias = 's' || l_suppkey)
SELECT chapter, '## ' || chapter || chr(10) || string_agg('- **' || person || '**: ' || action, chr(10) ORDER BY pos, '- **' || person || '**: ' || action) AS markdown FROM f GROUP BY chapter""",
)
def facts_markdown(t: Tables) -> DataFrame:
    """Each chapter's facts as Markdown, names resolved."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("person"), F.col("l_returnflag").alias("action"))
    alias = t.supplier.where("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("alias"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("canonical"))
    return records.facts_markdown(rows, alias)


@query("benchmark_history", "SELECT user_id AS model, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def benchmark_history(t: Tables) -> DataFrame:
    """The ten newest records of each model."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return t.events.withColumn("k", k).where("k <= 10").select(F.col("user_id").alias("model"), "event_id", "value")
