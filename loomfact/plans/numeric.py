"""Costs, geography, relation types and name rules over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import numbers as nu
from ..operators.store import first_rows
from ..registry import Tables, query

_PRICES = [("MEDIUM-1", 3.0), ("SMALL-1", 2.0), ("LARGE-1", 5.0)]


@query(
    "model_prices",
    "SELECT p_partkey, CASE WHEN p_type = 'MEDIUM-1' THEN 3.0 WHEN p_type = 'SMALL-1' THEN 2.0 WHEN p_type = 'LARGE-1' THEN 5.0 WHEN starts_with(p_type, 'MEDIUM') THEN 3.0 WHEN starts_with(p_type, 'SMALL') THEN 2.0 WHEN starts_with(p_type, 'LARGE') THEN 5.0 ELSE 1.0 END::DOUBLE AS price FROM part",
)
def model_prices(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", nu.ordered_prefix(F.col("p_type"), _PRICES, 1.0).alias("price"))


@query("cost_estimates", "SELECT source, n AS chapters, w AS words, CAST(floor(w * 1.5) AS BIGINT) + n * 47000 AS tokens, CAST(floor((CAST(floor(w * 1.5) AS BIGINT) + n * 47000) * 0.5 + n * 4000 * 1.5) AS BIGINT) AS micros FROM (SELECT source, count(*) AS n, sum(length(text))::BIGINT AS w FROM documents GROUP BY source)")
def cost_estimates(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count("*").alias("chapters"), F.sum(F.char_length("text")).alias("words"))
    n, w = F.col("chapters"), F.col("words")
    return g.select("source", "chapters", "words", nu.estimated_tokens(n, w).alias("tokens"), nu.estimated_cost_micros(n, w, 0.5, 1.5).alias("micros"))


@query("context_limits", "SELECT p_partkey, CAST(2 + floor(least(greatest((p_partkey * 100 - 8192) / (131072 - 8192), 0.0), 1.0) * 38) AS BIGINT) AS most FROM part")
def context_limits(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", nu.scaled_limit(F.col("p_partkey") * 100, 2, 40).alias("most"))


def towns(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), ((k * 37) % 130 - 65).cast("double").alias("lat"), ((k * 91) % 340 - 170).cast("double").alias("lng"))


_TOWNS = "t AS (SELECT s_suppkey AS id, ((s_suppkey * 37) % 130 - 65)::DOUBLE AS lat, ((s_suppkey * 91) % 340 - 170)::DOUBLE AS lng FROM supplier)"


@query(
    "town_distances",
    f"WITH {_TOWNS} SELECT x.id AS a, y.id AS b, CAST(round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lng - x.lng) / 2), 2))))) AS BIGINT) AS km FROM t x JOIN t y ON y.id = x.id + 1",
)
def town_distances(t: Tables) -> DataFrame:
    x, y = towns(t).alias("x"), towns(t).alias("y")
    km = nu.haversine_km(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng"))
    return x.join(y, F.col("y.id") == F.col("x.id") + 1).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(km).cast("long").alias("km"))


@query("largest_cluster", f"WITH {_TOWNS} SELECT CAST(floor(lat / 30) AS BIGINT) AS a, CAST(floor(lng / 30) AS BIGINT) AS b, count(*) AS n FROM t GROUP BY ALL ORDER BY n DESC, a, b LIMIT 1")
def largest_cluster(t: Tables) -> DataFrame:
    return nu.largest_cluster(towns(t), "lat", "lng").select("a", "b", "n")


@query(
    "projected_towns",
    f"""WITH {_TOWNS}, f AS (SELECT id, radians(lng) AS mx, ln(tan(0.7853981633974483 + radians(lat) / 2)) AS my FROM t), b AS (SELECT min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1 FROM f),
s AS (SELECT *, least((1000.0 - 100) / (x1 - x0), (800.0 - 100) / (y1 - y0)) AS k FROM b) SELECT id, CAST(round(50 + (mx - x0) * k) AS BIGINT) AS x, CAST(round(50 + (y1 - my) * k) AS BIGINT) AS y FROM f, s""",
)
def projected_towns(t: Tables) -> DataFrame:
    out = nu.projected(towns(t), "lat", "lng", 1000.0, 800.0, 50.0)
    return out.select("id", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


@query("layout_keys", "SELECT o_orderkey, substr(md5(o_orderkey || ':' || o_custkey || ':1000:800'), 1, 16) AS key FROM orders")
def layout_keys(t: Tables) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return t.orders.select("o_orderkey", nu.range_key(s("o_orderkey"), s("o_custkey"), F.lit("1000"), F.lit("800")).alias("key"))


@query("marker_sizes", "SELECT o_custkey AS place, least(greatest(10 + 2 * count(*) + 5 * (3 - o_custkey % 5), 15), 60)::BIGINT AS radius FROM orders GROUP BY o_custkey")
def marker_sizes(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("place")).agg(F.count("*").alias("n"))
    return n.select("place", nu.marker_radius(F.col("n"), F.col("place") % 5).cast("long").alias("radius"))


@query("best_entries", "SELECT s_nationkey::BIGINT AS nation, s_suppkey AS id FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_acctbal DESC, s_suppkey) = 1")
def best_entries(t: Tables) -> DataFrame:
    """Best gazetteer entry of a name: rank of its feature, then size."""
    best = first_rows(t.supplier, ["s_nationkey"], F.col("s_suppkey") % 3, -F.col("s_acctbal"), "s_suppkey")
    return best.select(F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").alias("id"))


@query(
    "error_classes",
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(props), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(props), 'rate limit|429|quota') THEN 'rate_limit' WHEN regexp_matches(lower(props), 'json|parse|decode') THEN 'parse' WHEN regexp_matches(lower(props), 'connect|network|refused') THEN 'connection' ELSE 'unknown' END AS kind FROM events) GROUP BY kind",
)
def error_classes(t: Tables) -> DataFrame:
    return t.events.groupBy(nu.error_class(F.col("props")).alias("kind")).agg(F.count("*").alias("n"))


@query("props_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def props_values(t: Tables) -> DataFrame:
    """Lenient JSON: a value of the wrong shape is null and does not take its neighbours along."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return t.events.select("event_id", k.alias("k")).where("k is not null")


@query("clamped_names", "SELECT p_partkey, substr(trim(string_split(trim(p_name), ',')[1]), 1, 8) AS name FROM part")
def clamped_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", nm.clamped(F.col("p_name"), 8).alias("name"))


@query("relation_types_of_texts", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(x, 'father') OR contains(x, 'mother') THEN 'parent' WHEN contains(x, 'brother') OR contains(x, 'sister') THEN 'sibling' WHEN contains(x, 'enemy') THEN 'enemy' WHEN contains(x, 'friend') THEN 'friend' WHEN contains(x, 'master') THEN 'teacher' ELSE 'none' END AS kind FROM (SELECT lower(trim(text)) AS x FROM conversations)) GROUP BY kind")
def relation_types_of_texts(t: Tables) -> DataFrame:
    kind = nm.relation_type(F.col("text"))
    known = F.when(kind.isin("parent", "sibling", "enemy", "friend", "teacher"), kind).otherwise("none")
    return t.conversations.groupBy(known.alias("kind")).agg(F.count("*").alias("n"))
