"""Entity profiles, timeline, factions and map views over stand-in tables.

An order's lines are a chapter's facts: the supplier is a person, the part a place or an
item, the return flag a role and the status an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import profile as pf
from ..registry import Tables, query


def facts(t: Tables) -> DataFrame:
    pos = F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("chapter"),
        pos.alias("pos"),
        F.col("l_suppkey").alias("person"),
        F.col("l_partkey").alias("place"),
        F.col("l_returnflag").alias("role"),
        F.col("l_linestatus").alias("action"),
        F.col("l_quantity").cast("long").alias("weight"),
    )


FACTS = "f AS (SELECT l_orderkey AS chapter, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey AS pos, l_suppkey AS person, l_partkey AS place, l_returnflag AS role, l_linestatus AS action, l_quantity::BIGINT AS weight FROM lineitem)"


@query(
    "entity_list",
    f"""WITH {FACTS}, m AS (SELECT person AS name, 'person' AS kind, chapter FROM f UNION ALL SELECT place, 'place', chapter FROM f UNION ALL SELECT weight, 'item', chapter FROM f),
n AS (SELECT name, kind, count(DISTINCT chapter) AS n, min(chapter) AS first FROM m GROUP BY ALL)
SELECT name, kind, n AS chapters, first, count(*) OVER (PARTITION BY name) AS kinds FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, list_position(['person', 'place', 'item'], kind)) = 1""",
)
def entity_list(t: Tables) -> DataFrame:
    f = facts(t)
    kinds = [f.select(F.col(c).alias("name"), F.lit(k).alias("kind"), "chapter") for c, k in (("person", "person"), ("place", "place"), ("weight", "item"))]
    return pf.entity_list(kinds[0].union(kinds[1]).union(kinds[2]), ["person", "place", "item"])


@query("merged_appearances", f"WITH {FACTS} SELECT place, role, min(chapter) AS first, string_agg(chapter::VARCHAR, ',' ORDER BY chapter) AS chapters FROM f GROUP BY place, role")
def merged_appearances(t: Tables) -> DataFrame:
    return pf.merged_descriptions(facts(t), "place", "role", "chapter")


@query(
    "place_info",
    f"""WITH {FACTS}, g AS (SELECT *, CASE WHEN action = 'O' THEN person END AS parent FROM f)
SELECT place, arg_min(role, chapter * 1000000000 + pos) AS kind, coalesce(arg_min(parent, chapter * 1000000000 + pos), -1) AS parent, (list(role ORDER BY list_position(['A', 'N', 'R'], role)))[1] AS role, count(DISTINCT chapter) AS mentions FROM g GROUP BY place""",
)
def place_info(t: Tables) -> DataFrame:
    f = facts(t).withColumn("parent", F.when(F.col("action") == "O", F.col("person"))).withColumn("kind", F.col("role"))
    return pf.place_info(f, "place", "kind", "parent", "role", ["A", "N", "R"], "chapter", "pos").fillna(-1, ["parent"])


@query("place_visitors", f"WITH {FACTS} SELECT place, person, count(DISTINCT chapter) AS chapters, min(chapter) AS first, count(DISTINCT chapter) >= 3 AS resident FROM f GROUP BY ALL")
def place_visitors(t: Tables) -> DataFrame:
    return pf.visitors(facts(t), "place", "person", "chapter")


@query("co_items", f"WITH {FACTS}, r AS (SELECT DISTINCT chapter, place FROM f) SELECT x.place, count(DISTINCT y.place) AS co_items FROM r x JOIN r y ON x.chapter = y.chapter AND x.place <> y.place GROUP BY x.place")
def co_items(t: Tables) -> DataFrame:
    return pf.co_items(facts(t), "place", "chapter")


@query(
    "best_constraints",
    f"WITH {FACTS} SELECT person, place, role, weight, chapter FROM f QUALIFY row_number() OVER (PARTITION BY person, place ORDER BY weight DESC, chapter, pos) = 1",
)
def best_constraints(t: Tables) -> DataFrame:
    return pf.best_of(facts(t), ["person", "place"], F.col("weight"), "chapter", "pos").select("person", "place", "role", "weight", "chapter")


@query(
    "trajectories",
    f"""WITH {FACTS}, o AS (SELECT person, place, chapter, min(pos) AS pos FROM f GROUP BY ALL), m AS (SELECT person FROM o GROUP BY person HAVING count(DISTINCT place) >= 2)
SELECT person, row_number() OVER (PARTITION BY person ORDER BY chapter, pos, place) AS step, place, chapter FROM o WHERE person IN (SELECT person FROM m)""",
)
def trajectories(t: Tables) -> DataFrame:
    return pf.trajectories(facts(t), "person", "place", "chapter", "pos")


@query(
    "timeline",
    """WITH a AS (SELECT l_orderkey AS chapter, 0 AS source, l_linenumber::BIGINT AS pos, 'event' AS kind, l_partkey || ':' || l_suppkey AS text, CASE WHEN l_returnflag = 'R' THEN 'high' ELSE 'medium' END AS importance, l_quantity::BIGINT % 8 AS cast_ FROM lineitem
UNION ALL SELECT o_orderkey, 1, 0, 'order', o_orderstatus, 'low', 0 FROM orders)
SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY source, pos, text) AS place, kind, text, CASE WHEN cast_ >= 5 THEN 'high' ELSE importance END AS importance FROM a""",
)
def timeline(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("chapter"),
        F.col("l_linenumber").cast("long").alias("pos"),
        F.lit("event").alias("kind"),
        F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("text"),
        F.when(F.col("l_returnflag") == "R", "high").otherwise("medium").alias("importance"),
        (F.col("l_quantity").cast("long") % 8).alias("cast"),
    )
    orders = t.orders.select(F.col("o_orderkey").alias("chapter"), F.lit(0).cast("long").alias("pos"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("text"), F.lit("low").alias("importance"), F.lit(0).cast("long").alias("cast"))
    return pf.timeline([lines, orders])


@query(
    "memberships",
    f"""WITH {FACTS}, g AS (SELECT *, place % 20 AS org, CASE WHEN weight % 2 = 0 THEN role END AS r FROM f) SELECT org, person, arg_max(action, chapter * 1000000000 + pos) AS action, coalesce(arg_max(r, chapter * 1000000000 + pos), '') AS role, min(chapter) AS since FROM g GROUP BY org, person""",
)
def memberships(t: Tables) -> DataFrame:
    f = facts(t).withColumn("org", F.col("place") % 20).withColumn("role", F.when(F.col("weight") % 2 == 0, F.col("role")))
    return pf.memberships(f, "org", "person", "role", "action", "chapter", "pos").fillna("", ["role"])


@query(
    "item_holders",
    f"""WITH {FACTS} SELECT place AS item, arg_max(CASE WHEN role = 'R' THEN '' WHEN role = 'A' THEN (weight + 100)::VARCHAR ELSE person::VARCHAR END, chapter * 1000000000 + pos) AS holder, count(*) AS events FROM f GROUP BY place""",
)
def item_holders(t: Tables) -> DataFrame:
    f = facts(t).select(F.col("place").alias("item"), F.col("person").cast("string").alias("actor"), (F.col("weight") + 100).cast("string").alias("recipient"), "role", "chapter", "pos")
    return pf.last_holders(f, "item", "actor", "recipient", "role", "chapter", "pos", ("A",), ("R",))


@query(
    "relation_gaps",
    f"""WITH {FACTS}, r AS (SELECT DISTINCT chapter, person AS p FROM f), w AS (SELECT x.p AS a, y.p AS b, count(*) AS weight FROM r x JOIN r y ON x.chapter = y.chapter AND x.p < y.p GROUP BY ALL),
n AS (SELECT person, count(*) AS n FROM f GROUP BY person), k AS (SELECT DISTINCT least(person, place % 100 + 1) AS a, greatest(person, place % 100 + 1) AS b FROM f WHERE action = 'F' AND role = 'R')
SELECT w.a, w.b, (weight * (x.n + y.n))::BIGINT AS priority FROM w JOIN n x ON x.person = w.a JOIN n y ON y.person = w.b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = w.a AND k.b = w.b) ORDER BY priority DESC, a, b LIMIT 200""",
)
def relation_gaps(t: Tables) -> DataFrame:
    f = facts(t)
    other = F.col("place") % 100 + 1
    known = f.where("action = 'F' and role = 'R'").select(F.least("person", other).alias("a"), F.greatest("person", other).alias("b"))
    mentions = f.groupBy(F.col("person").alias("name")).agg(F.count("*").alias("n"))
    return pf.gaps(graph.pair_edges(f, "chapter", "person"), known, mentions, 200)


_DIR = "d AS (SELECT person % 300 AS a, place % 3000 AS b, CASE action WHEN 'O' THEN 'north' ELSE 'east' END AS v, max(weight % 3 + 1) AS c FROM f WHERE person % 300 <> place % 3000 GROUP BY ALL)"


@query(
    "transitive_directions",
    f"""WITH {FACTS}, {_DIR}, x AS (SELECT p.a, q.b, p.v, max(least(p.c, q.c) - 1) AS c FROM d p JOIN d q ON p.b = q.a AND p.v = q.v AND p.a <> q.b WHERE least(p.c, q.c) - 1 >= 1 GROUP BY ALL)
SELECT a, b, v, c FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.a = x.a AND d.b = x.b) AND NOT EXISTS (SELECT 1 FROM d WHERE d.a = x.b AND d.b = x.a)""",
)
def transitive_directions(t: Tables) -> DataFrame:
    f = facts(t).where("person % 300 <> place % 3000")
    rows = f.select((F.col("person") % 300).alias("a"), (F.col("place") % 3000).alias("b"), F.when(F.col("action") == "O", "north").otherwise("east").alias("v"), (F.col("weight") % 3 + 1).alias("c"))
    return pf.transitive(rows, "a", "b", "v", "c")


@query(
    "dominant_relations",
    f"""WITH {FACTS}, n AS (SELECT person, place % 50 AS other, role, count(*) AS n, min(chapter * 1000000000 + pos) AS seen FROM f GROUP BY ALL)
SELECT person, other, role, n, sum(n) OVER (PARTITION BY person, other)::BIGINT AS mentions FROM n QUALIFY row_number() OVER (PARTITION BY person, other ORDER BY (role = 'R' AND n >= 3) DESC, n DESC, seen) = 1""",
)
def dominant_relations(t: Tables) -> DataFrame:
    f = facts(t).withColumn("other", F.col("place") % 50).withColumn("order", F.col("chapter") * 1000000000 + F.col("pos"))
    return pf.dominant_relations(f, ["person", "other"], "role", "order", ("R",))


@query("category_stats", f"WITH {FACTS} SELECT 'person' AS kind, count(DISTINCT person) AS n FROM f UNION ALL SELECT 'place', count(DISTINCT place) FROM f UNION ALL SELECT 'role/' || role, count(DISTINCT place) FROM f GROUP BY role")
def category_stats(t: Tables) -> DataFrame:
    f = facts(t)
    one = lambda k: f.agg(F.countDistinct(k).alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("person").union(one("place")).union(f.groupBy("role").agg(F.countDistinct("place").alias("n")).select(F.concat(F.lit("role/"), "role"), "n"))


@query("spatial_summary", f"WITH {FACTS} SELECT person, place, role, string_agg(DISTINCT chapter::VARCHAR, ',' ORDER BY chapter::VARCHAR) AS chapters, count(DISTINCT chapter) AS n FROM f WHERE person = 7 OR place = 7 GROUP BY ALL")
def spatial_summary(t: Tables) -> DataFrame:
    g = facts(t).where("person = 7 or place = 7").groupBy("person", "place", "role").agg(F.array_sort(F.collect_set(F.col("chapter").cast("string"))).alias("c"))
    return g.select("person", "place", "role", F.array_join("c", ",").alias("chapters"), F.size("c").cast("long").alias("n"))
