"""Hierarchy building, aliases, chapter splitting and streams over stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aliases, branching, hierarchy, split
from ..operators.graph import scratch
from ..registry import Tables, query
from ..streaming import incremental


def place_facts(t: Tables) -> DataFrame:
    """A brand's parts are a novel's places: child and parent are sizes, chapters the parts' orders."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("p_brand").alias("novel"),
        (F.col("l_orderkey") % 50).alias("chapter"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("child"),
        F.concat(F.lit("p"), (F.col("l_suppkey") % 12).cast("string")).alias("parent"),
        (F.col("l_returnflag") == "R").alias("peer"),
        F.concat("l_returnflag", "l_linestatus").alias("flag"),
    )


_FACTS = "x AS (SELECT p_brand AS novel, l_orderkey % 50 AS chapter, 'p' || (l_partkey % 40) AS child, 'p' || (l_suppkey % 12) AS parent, l_returnflag = 'R' AS peer, l_returnflag || l_linestatus AS flag FROM lineitem JOIN part ON l_partkey = p_partkey)"


def votes(t: Tables) -> DataFrame:
    f = place_facts(t)
    keys = ["novel", "child", "parent"]
    contains = f.where("flag in ('RF', 'AO')").select(*keys, F.when(F.col("peer"), "low").otherwise("high").alias("confidence"))
    settings = f.where("flag = 'AF'").select(*keys)
    return hierarchy.parent_votes(f, contains, settings, f.where("flag = 'NF'").select(*keys))


_VOTES = f"""{_FACTS}, c AS (SELECT novel, chapter, row_number() OVER (PARTITION BY novel ORDER BY chapter) - 1 AS i, count(*) OVER (PARTITION BY novel) AS n FROM (SELECT DISTINCT novel, chapter FROM x)),
v0 AS (SELECT novel, child, parent, (1 + 0.5 * i / n::DOUBLE) * CASE WHEN peer THEN 1 / 3::DOUBLE ELSE 1.0 END AS w FROM x JOIN c USING (novel, chapter)
  UNION ALL SELECT novel, child, parent, CASE WHEN peer THEN 1.0 ELSE 3.0 END FROM x WHERE flag IN ('RF', 'AO') UNION ALL SELECT novel, child, parent, 2.0 FROM x WHERE flag = 'AF'),
v1 AS (SELECT novel, child, parent, sum(w) AS w FROM v0 WHERE child <> parent GROUP BY ALL), b AS (SELECT DISTINCT novel, child, parent FROM x WHERE flag = 'NF'),
v AS (SELECT v1.novel, v1.child, v1.parent, w + CASE WHEN b.child IS NULL THEN 0 ELSE 1 END AS weight FROM v1 LEFT JOIN b USING (novel, child, parent))"""


@query("parent_votes", f"WITH {_VOTES} SELECT novel, child, parent, CAST(floor(weight * 1000 + 0.500001) AS BIGINT) AS weight FROM v")
def parent_votes(t: Tables) -> DataFrame:
    return votes(t).withColumn("weight", F.floor(F.col("weight") * 1000 + 0.500001).cast("long"))


@query("capped_votes", f"WITH {_VOTES}, n AS (SELECT novel, child, count(*) AS n FROM v GROUP BY ALL) SELECT novel, child, parent, CAST(floor(CASE WHEN parent = 'p0' AND n > 1 THEN least(weight, 2) ELSE weight END * 1000 + 0.500001) AS BIGINT) AS weight FROM v JOIN n USING (novel, child)")
def capped_votes(t: Tables) -> DataFrame:
    root = t.part.select(F.col("p_brand").alias("novel"), F.lit("p0").alias("root")).distinct()
    out = hierarchy.capped_root_votes(votes(t), root)
    return out.withColumn("weight", F.floor(F.col("weight") * 1000 + 0.500001).cast("long"))


@query("majority_parents", f"WITH {_FACTS}, n AS (SELECT novel, child, parent, count(*) AS weight FROM x WHERE child <> parent GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY novel, child ORDER BY weight DESC, parent) = 1")
def majority_parents(t: Tables) -> DataFrame:
    n = place_facts(t).where("child <> parent").groupBy("novel", "child", "parent").agg(F.count("*").alias("weight"))
    return hierarchy.majority_parents(n)


@query("synonym_votes", f"WITH {_FACTS}, n AS (SELECT novel, CASE child WHEN 'p11' THEN 'p1' WHEN 'p21' THEN 'p2' ELSE child END AS child, CASE parent WHEN 'p11' THEN 'p1' ELSE parent END AS parent FROM x) SELECT novel, child, parent, count(*) AS weight FROM n WHERE child <> parent GROUP BY ALL")
def synonym_votes(t: Tables) -> DataFrame:
    n = place_facts(t).groupBy("novel", "child", "parent").agg(F.count("*").alias("weight"))
    pairs = F.explode(F.array(F.struct(F.lit("p11").alias("variant"), F.lit("p1").alias("base")), F.struct(F.lit("p21").alias("variant"), F.lit("p2").alias("base"))))
    return hierarchy.synonyms_merged(n, t.part.select(F.col("p_brand").alias("novel")).distinct().select("novel", pairs.alias("p")).select("novel", "p.*"))


@query("name_containment", r"WITH n AS (SELECT DISTINCT lower(word) AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS word FROM benchmark)) SELECT a.name AS child, b.name AS parent FROM n a JOIN n b ON starts_with(a.name, b.name) AND a.name <> b.name QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY length(b.name) DESC) = 1")
def name_containment(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1))).alias("name"))
    return hierarchy.name_containment(words.select(F.lit(0).alias("novel"), F.lower("name").alias("name"))).select("child", "parent")


@query("arborescences_by_rounds")
def arborescences_by_rounds(t: Tables) -> DataFrame:
    """The same without a group a novel: cycles of all novels are contracted together, round by round."""
    roots = t.part.select(F.col("p_brand").alias("novel"), F.lit("p0").alias("root")).distinct()
    return branching.arborescences(votes(t), roots)


@query("arborescences")
def arborescences(t: Tables) -> DataFrame:
    roots = t.part.select(F.col("p_brand").alias("novel"), F.lit("p0").alias("root")).distinct()
    return hierarchy.arborescences(votes(t), roots)


@query("alias_maps")
def alias_maps(t: Tables) -> DataFrame:
    """Names are syllables of benchmark words; a novel is a passage."""
    words = t.benchmark.select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("first", "word"))
    pairs = words.select(F.col("item_id").alias("novel"), F.substring("word", 1, 3).alias("name"), F.substring("word", -2, 2).alias("alias"), "first")
    pairs = pairs.groupBy("novel", "name", "alias").agg(F.min("first").alias("first"), F.count("*").alias("chapters"))
    freq = pairs.groupBy("novel", "name").agg(F.sum("chapters").alias("freq"))
    return aliases.alias_maps(pairs, freq, freq.where("freq >= 4").select("novel", "name"))


@query(
    "fixed_chapters",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
e AS (SELECT *, floor((sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) / 2.0) / 2000) AS section FROM l),
g AS (SELECT doc_id, section, md5(string_agg(line, chr(10) ORDER BY k)) AS hash, count(*) AS n FROM e GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS chapter, hash FROM g""",
)
def fixed_chapters(t: Tables) -> DataFrame:
    out = split.split_fixed(t.documents, "doc_id", "text", 2000)
    return out.select("doc_id", "chapter", F.md5(F.col("content").cast("binary")).alias("hash"))


@query(
    "heading_chapters",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
h AS (SELECT *, regexp_matches(line, '^[A-Z][^ ]* [^ ]*\.$') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM h),
g AS (SELECT doc_id, section, coalesce(min(trim(line, ' ')) FILTER (WHERE head), '') AS title, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT head), '') AS content FROM s GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS chapter, title, md5(content) AS hash FROM g WHERE length(trim(content, ' ')) > 0 AND (section > 0 OR length(content) >= 100)""",
)
def heading_chapters(t: Tables) -> DataFrame:
    out = split.split_at(t.documents, "doc_id", "text", F.col("line").rlike(r"^[A-Z][^ ]* [^ ]*\.$"))
    return out.select("doc_id", "chapter", "title", F.md5(F.col("content").cast("binary")).alias("hash"))


@query("point_chapters", "WITH c AS (SELECT doc_id, text, unnest(list_sort(list_distinct([0] || list_filter([500, 1500], lambda p: p < length(text))))) AS a FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS chapter, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), length(text)) AS e FROM c) SELECT doc_id, chapter, md5(substr(text, a + 1, e - a)) AS hash FROM n")
def point_chapters(t: Tables) -> DataFrame:
    books = t.documents.select("doc_id", "text", F.array(F.lit(500), F.lit(1500)).alias("points"))
    out = split.split_points(books, "doc_id", "text", "points")
    return out.select("doc_id", "chapter", F.md5(F.col("content").cast("binary")).alias("hash"))


@query("split_books")
def split_books(t: Tables) -> DataFrame:
    out = split.split_books(t.documents.select("doc_id", "text"), "doc_id", "text")
    return out.groupBy("doc_id", "mode").agg(F.count("*").alias("chapters"))


@query("stream_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t: Tables) -> DataFrame:
    """Hourly windows of a stream over the events file; a run takes what is there."""
    spark = t.spark
    where = _scratch(t)
    stream = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    out = incremental.stream_to_table(incremental.windowed_counts(stream), f"{where}/table", f"{where}/checkpoint")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("stream_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest(t: Tables) -> DataFrame:
    """Latest event of each user from a log that a stream appends to."""
    where = _scratch(t)
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    incremental.run_available(stream, f"{where}/checkpoint", incremental.append_log(f"{where}/log"))
    log = t.spark.read.parquet(f"{where}/log").drop("batch", "version")
    return log.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("running_genre", "WITH d AS (SELECT source AS novel, doc_id AS chapter, lower(text) AS x FROM documents), h AS (SELECT novel, chapter, 'en' AS genre, contains(x, ' the ')::INT + contains(x, ' of ')::INT AS hit FROM d UNION ALL SELECT novel, chapter, 'fr', contains(x, ' le ')::INT + contains(x, ' des ')::INT FROM d), r AS (SELECT *, sum(hit) OVER (PARTITION BY novel, genre ORDER BY chapter) AS score FROM h), q AS (SELECT * FROM r WHERE score >= 5), f AS (SELECT novel, min(chapter) AS chapter FROM q GROUP BY novel) SELECT novel, chapter, genre FROM q JOIN f USING (novel, chapter) QUALIFY row_number() OVER (PARTITION BY novel ORDER BY score DESC, genre DESC) = 1")
def running_genre(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("source").alias("novel"), F.col("doc_id").alias("chapter"), "text")
    return incremental.genre_scores(d, {"en": (" the ", " of "), "fr": (" le ", " des ")})


def _scratch(t: Tables) -> str:
    return f"{scratch(t.spark)}/stream-{uuid.uuid4().hex}"
