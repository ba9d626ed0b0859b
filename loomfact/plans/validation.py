"""Validation passes, scenes and spatial constraints over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence, spatial, validate
from ..registry import Tables, query


def rows(t: Tables) -> DataFrame:
    """novel (order's clerk by number), chapter (order), names from supplier and part."""
    return t.lineitem.select(
        (F.col("l_orderkey") % 7).alias("novel"),
        F.col("l_orderkey").alias("chapter"),
        F.concat(F.lit("x"), (F.col("l_suppkey") % 60).cast("string")).alias("a"),
        F.concat(F.lit("x"), (F.col("l_partkey") % 60).cast("string")).alias("b"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("long").alias("q"),
        (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"),
    )


_R = "r AS (SELECT l_orderkey % 7 AS novel, l_orderkey AS chapter, 'x' || (l_suppkey % 60) AS a, 'x' || (l_partkey % 60) AS b, l_returnflag AS flag, l_linestatus AS status, l_quantity::BIGINT AS q, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem)"


@query("known_relations", f"WITH {_R}, p AS (SELECT DISTINCT chapter, a AS name FROM r WHERE flag <> 'N') SELECT novel, chapter, a AS person_a, b AS person_b FROM r WHERE a <> b AND (chapter, a) IN (SELECT (chapter, name) FROM p) AND (chapter, b) IN (SELECT (chapter, name) FROM p)")
def known_relations(t: Tables) -> DataFrame:
    r = rows(t)
    people = r.where("flag <> 'N'").select("novel", "chapter", F.col("a").alias("name"))
    return validate.known_relations(r.select("novel", "chapter", F.col("a").alias("person_a"), F.col("b").alias("person_b")), people)


@query("people_without_places", f"WITH {_R} SELECT novel, chapter, a AS name FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.chapter = r.chapter AND s.b = r.a)")
def people_without_places(t: Tables) -> DataFrame:
    r = rows(t)
    return validate.people_without_places(r.select("novel", "chapter", F.col("a").alias("name")), r.select("novel", "chapter", F.col("b").alias("name")))


@query("missing_people", f"WITH {_R}, p AS (SELECT DISTINCT novel, chapter, a AS name FROM r), n AS (SELECT DISTINCT novel, chapter, b AS name FROM r) SELECT novel, chapter, name FROM p UNION SELECT novel, chapter, name FROM n")
def missing_people(t: Tables) -> DataFrame:
    r = rows(t)
    return validate.with_missing_people(r.select("novel", "chapter", F.col("a").alias("name")).distinct(), r.select("novel", "chapter", F.col("b").alias("name")))


@query("referenced_places", f"WITH {_R}, p AS (SELECT DISTINCT novel, chapter, a AS name, b AS parent FROM r WHERE status = 'O') SELECT novel, chapter, name, parent, 'place' AS type FROM p UNION ALL SELECT DISTINCT novel, chapter, parent, '', 'inferred' FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.chapter = p.chapter AND q.name = p.parent)")
def referenced_places(t: Tables) -> DataFrame:
    places = rows(t).where("status = 'O'").select("novel", "chapter", F.col("a").alias("name"), F.col("b").alias("parent"), F.lit("place").alias("type")).distinct()
    return validate.referenced_places(places, F.lit("inferred")).fillna("", ["parent"])


@query("distinct_events", f"WITH {_R} SELECT novel, chapter, a AS summary, CASE WHEN flag IN ('A', 'R') THEN flag ELSE 'medium' END AS flag, pos FROM r QUALIFY row_number() OVER (PARTITION BY novel, chapter, a ORDER BY pos) = 1")
def distinct_events(t: Tables) -> DataFrame:
    events = rows(t).select("novel", "chapter", F.col("a").alias("summary"), "flag", "pos")
    return validate.distinct_events(events, "summary", "pos", {"flag": (("A", "R"), "medium")})


@query("merged_people", f"WITH {_R}, f AS (SELECT novel, chapter, a, b, min(pos) AS pos FROM r GROUP BY ALL) SELECT novel, chapter, a AS name, string_agg(b, ',' ORDER BY pos) AS aliases, coalesce((SELECT arg_min(s.flag, s.pos) FROM r s WHERE s.chapter = f.chapter AND s.a = f.a), '') AS appearance FROM f GROUP BY novel, chapter, a")
def merged_people(t: Tables) -> DataFrame:
    people = rows(t).select("novel", "chapter", F.col("a").alias("name"), F.array("b").alias("aliases"), F.col("flag").alias("appearance"), "pos")
    return validate.merged_people(people, "pos").withColumn("aliases", F.array_join("aliases", ","))


_PTS = "p AS (SELECT 'x' || k AS name, ((k * 37) % 101)::DOUBLE AS x, ((k * 53) % 97)::DOUBLE AS y, k % 5 AS rank FROM (SELECT DISTINCT s_suppkey % 60 AS k FROM supplier))"
_CON = "c AS (SELECT DISTINCT a AS source, b AS target, CASE flag WHEN 'A' THEN 'direction' WHEN 'N' THEN 'adjacent' ELSE 'contains' END AS relation_type, CASE WHEN status = 'O' THEN 'north' ELSE 'east' END AS value FROM r WHERE a <> b)"


def points(t: Tables) -> DataFrame:
    k = t.supplier.select((F.col("s_suppkey") % 60).alias("k")).distinct()
    return k.select(F.concat(F.lit("x"), F.col("k").cast("string")).alias("name"), ((F.col("k") * 37) % 101).cast("double").alias("x"), ((F.col("k") * 53) % 97).cast("double").alias("y"), (F.col("k") % 5).alias("rank"))


def constraints(t: Tables) -> DataFrame:
    kind = F.when(F.col("flag") == "A", "direction").when(F.col("flag") == "N", "adjacent").otherwise("contains")
    value = F.when(F.col("status") == "O", "north").otherwise("east")
    return rows(t).where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target"), kind.alias("relation_type"), value.alias("value")).distinct()


@query(
    "satisfied_constraints",
    f"""WITH {_R}, {_PTS}, {_CON} SELECT relation_type, count(*) AS n, count(*) FILTER (WHERE CASE relation_type WHEN 'direction' THEN (CASE value WHEN 'north' THEN s.y - t.y > 0 ELSE t.x - s.x > 0 END)
WHEN 'adjacent' THEN sqrt(pow(t.x - s.x, 2) + pow(t.y - s.y, 2)) <= 40 ELSE sqrt(pow(t.x - s.x, 2) + pow(t.y - s.y, 2)) <= 25 END) AS met FROM c JOIN p s ON s.name = source JOIN p t ON t.name = target GROUP BY relation_type""",
)
def satisfied_constraints(t: Tables) -> DataFrame:
    return spatial.satisfaction(constraints(t), points(t), 40.0, 25.0)


@query("direction_energy", f"WITH {_R}, {_PTS}, {_CON} SELECT value AS confidence, sum(pow(greatest(0.0, CASE value WHEN 'north' THEN t.y - s.y ELSE s.x - t.x END), 2))::BIGINT AS energy FROM c JOIN p s ON s.name = source JOIN p t ON t.name = target WHERE relation_type = 'direction' GROUP BY value")
def direction_energy(t: Tables) -> DataFrame:
    out = spatial.direction_energy(constraints(t).withColumn("confidence", F.col("value")), points(t))
    return out.withColumn("energy", F.col("energy").cast("long"))


@query(
    "clean_spatial",
    f"""WITH {_R}, {_PTS}, j AS (SELECT CASE WHEN flag = 'R' AND s.rank > t.rank THEN b ELSE a END AS source, CASE WHEN flag = 'R' AND s.rank > t.rank THEN a ELSE b END AS target, CASE flag WHEN 'R' THEN 'contains' ELSE 'near' END AS relation_type, status AS value, least(1.0, greatest(0.0, (q - 10) / 30.0)) AS score, chapter * 1000000000 + pos AS pos FROM r JOIN p s ON s.name = a JOIN p t ON t.name = b WHERE a <> b AND flag <> 'N')
SELECT source, target, relation_type, value, CAST(round(score * 1000) AS BIGINT) AS score FROM j QUALIFY row_number() OVER (PARTITION BY source, target, relation_type ORDER BY pos) = 1""",
)
def clean_spatial(t: Tables) -> DataFrame:
    kind = F.when(F.col("flag") == "R", "contains").when(F.col("flag") == "A", "near").otherwise("none")
    rel = rows(t).select(F.col("a").alias("source"), F.col("b").alias("target"), kind.alias("relation_type"), F.col("status").alias("value"), ((F.col("q") - 10) / 30.0).alias("score"), (F.col("chapter") * 1000000000 + F.col("pos")).alias("pos"))
    out = validate.clean_spatial(rel, points(t), ("contains", "near"), "pos")
    return out.withColumn("score", F.round(F.col("score") * 1000).cast("long"))


@query(
    "clear_directions",
    f"""WITH {_R}, d AS (SELECT a AS source, b AS target, CASE WHEN status = 'O' THEN 'north' ELSE 'south' END AS value, q, chapter * 1000000000 + pos AS pos FROM r WHERE a <> b),
e AS (SELECT *, least(source, target) AS x, greatest(source, target) AS y, CASE WHEN source > target THEN (CASE value WHEN 'north' THEN 'south' ELSE 'north' END) ELSE value END AS dir FROM d),
m AS (SELECT x, y, dir AS best FROM e QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY q DESC, pos) = 1) SELECT source, target, value, q, pos FROM e JOIN m USING (x, y) WHERE dir = best""",
)
def clear_directions(t: Tables) -> DataFrame:
    value = F.when(F.col("status") == "O", "north").otherwise("south")
    rel = rows(t).where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target"), value.alias("value"), "q", (F.col("chapter") * 1000000000 + F.col("pos")).alias("pos"))
    return spatial.without_contradictions(rel, "q", "pos")


@query("roads")
def roads(t: Tables) -> DataFrame:
    return spatial.roads(points(t).withColumn("layer", F.col("rank")), "layer")


def paragraphs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "text"))


_SCORE = r"""g AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para FROM documents),
h AS (SELECT *, (substr(regexp_replace(t, '^\s+', ''), 1, 1) IN ('"', '“', '「', '『'))::INT AS d FROM g),
k AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, sum(d) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS f, lag(t) OVER (PARTITION BY doc_id ORDER BY para) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS n FROM h),
s AS (SELECT doc_id, para, t, CASE WHEN n = 1 THEN 0 ELSE (CASE WHEN regexp_matches(lower(t), '^(the next|later|that (night|evening|morning)|meanwhile|once)') THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(lower(t), '^(in|at) the ') THEN 2 ELSE 0 END)
 + (CASE WHEN b >= 2 AND f = 0 THEN 3 ELSE 0 END) + (CASE WHEN coalesce(b, 0) = 0 AND f >= 2 THEN 2 ELSE 0 END) + (CASE WHEN length(l) < 15 THEN 2 ELSE 0 END) END AS score FROM k)"""


@query("scene_scores", f"WITH {_SCORE} SELECT doc_id, para, score FROM s")
def scene_scores(t: Tables) -> DataFrame:
    return validate.scene_scores(paragraphs(t), "doc_id", "para", "text").withColumn("para", F.col("para").cast("long"))


@query("scenes")
def scenes(t: Tables) -> DataFrame:
    p = paragraphs(t)
    breaks = sequence.kept_by_spacing(validate.scene_scores(p, "doc_id", "para", "text"), ["doc_id"], "para", "score", 2.0, 3, 4.0, 2)
    return validate.scenes(breaks, p, "doc_id", "para", "text")
