"""Relation graphs and place trees over stand-in tables.

Suppliers of an order are the persons of a chapter; region > nation > supplier is the tree
of places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import communities, evaluate, graph, tree
from ..registry import Tables, query


@query(
    "relation_graph",
    "WITH r AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem) SELECT x.p AS a, y.p AS b, count(*) AS weight FROM r x JOIN r y ON x.c = y.c AND x.p < y.p GROUP BY ALL HAVING count(*) >= 2",
)
def relation_graph(t: Tables) -> DataFrame:
    return graph.pair_edges(t.lineitem, "l_orderkey", "l_partkey").where("weight >= 2")


_REL = "r AS (SELECT least(l_suppkey, l_partkey % 100 + 1) AS a, greatest(l_suppkey, l_partkey % 100 + 1) AS b, l_returnflag || l_linestatus AS kind, l_orderkey AS c, l_orderkey * 100 + l_linenumber AS o FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1)"


def relations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("p"),
        (F.col("l_partkey") % 100 + 1).alias("q"),
        F.concat("l_returnflag", "l_linestatus").alias("kind"),
        F.col("l_orderkey").alias("c"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"),
    )


@query(
    "relation_types",
    f"""WITH {_REL}, k AS (SELECT a, b, kind, count(*) AS n, min(o) AS seen FROM r GROUP BY ALL),
p AS (SELECT a, b, arg_max(kind, n * 10000000000 - seen) AS "primary", count(*) AS kinds, sum(n)::BIGINT AS mentions FROM k GROUP BY a, b),
w AS (SELECT a, b, count(DISTINCT c) AS weight FROM r GROUP BY a, b) SELECT * FROM p JOIN w USING (a, b)""",
)
def relation_types(t: Tables) -> DataFrame:
    return graph.typed_edges(relations(t), "p", "q", "kind", "c", "o")


@query(
    "graph_nodes",
    f"WITH {_REL}, w AS (SELECT a, b, count(DISTINCT c) AS weight FROM r GROUP BY a, b) SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT a AS node, weight FROM w UNION ALL SELECT b, weight FROM w) GROUP BY node",
)
def graph_nodes(t: Tables) -> DataFrame:
    return graph.nodes(graph.typed_edges(relations(t), "p", "q", "kind", "c", "o"))


@query(
    "graph_filtered",
    f"WITH {_REL}, w AS (SELECT a, b, count(DISTINCT c) AS weight FROM r GROUP BY a, b), s AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 0) SELECT a, b, weight FROM w WHERE weight >= 2 AND a IN (SELECT node FROM s) AND b IN (SELECT node FROM s)",
)
def graph_filtered(t: Tables) -> DataFrame:
    shown = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return graph.filtered(graph.typed_edges(relations(t), "p", "q", "kind", "c", "o").select("a", "b", "weight"), shown, 2)


def _sparse(t: Tables) -> DataFrame:
    """A graph of customers: each order ties its customer to the one that its number points at."""
    a, b = F.col("o_custkey"), F.col("o_orderkey") % 1500 + 1
    return t.orders.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


_SPARSE = "s AS (SELECT DISTINCT least(o_custkey, o_orderkey % 1500 + 1) AS a, greatest(o_custkey, o_orderkey % 1500 + 1) AS b FROM orders WHERE o_custkey <> o_orderkey % 1500 + 1), e AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s)"


@query("person_components", f"WITH RECURSIVE {_SPARSE}, r(node, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.node WHERE r.m < e.b) SELECT node, min(m) AS component FROM r GROUP BY node")
def person_components(t: Tables) -> DataFrame:
    return graph.components(_sparse(t))


@query("person_communities")
def person_communities(t: Tables) -> DataFrame:
    """Communities of the persons by modularity; a relation counts once."""
    return communities.communities(_sparse(t).withColumn("weight", F.lit(1.0)))


@query("shortest_paths", f"WITH RECURSIVE {_SPARSE}, w(node, steps) USING KEY (node) AS (SELECT min(a), 0::BIGINT FROM e UNION SELECT e.b, min(steps) + 1 FROM w JOIN e ON e.a = w.node WHERE e.b NOT IN (SELECT node FROM recurring.w) GROUP BY e.b) SELECT node, steps FROM w")
def shortest_paths(t: Tables) -> DataFrame:
    edges = _sparse(t)
    start = edges.agg(F.min("a")).first()[0]
    return graph.shortest_paths(edges, start).select("node", "steps")


def places(t: Tables) -> DataFrame:
    """region > nation > supplier, customer as (child, parent)."""
    n = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    s = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"))
    c = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    return n.union(s).union(c)


_PLACES = "p AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
_WALK = f"{_PLACES}, w(node, up, depth) AS (SELECT child, parent, 1 FROM p UNION ALL SELECT w.node, p.parent, w.depth + 1 FROM w JOIN p ON w.up = p.child WHERE w.depth < 20)"


@query("place_roots", f"WITH {_PLACES} SELECT DISTINCT parent AS node FROM p WHERE parent NOT IN (SELECT child FROM p)")
def place_roots(t: Tables) -> DataFrame:
    return tree.roots(places(t))


@query(
    "place_depths",
    f"WITH RECURSIVE {_WALK} SELECT node, arg_max(up, depth) AS root, max(depth)::BIGINT AS depth FROM w GROUP BY node UNION ALL SELECT DISTINCT parent, parent, 0 FROM p WHERE parent NOT IN (SELECT child FROM p)",
)
def place_depths(t: Tables) -> DataFrame:
    return tree.lifted(places(t))


@query("place_chains", f"WITH RECURSIVE {_WALK} SELECT node, string_agg(up, ' > ' ORDER BY depth) AS chain, count(*) AS length FROM w GROUP BY node")
def place_chains(t: Tables) -> DataFrame:
    return tree.chains(places(t))


@query(
    "place_order",
    f"WITH RECURSIVE {_WALK} SELECT node, string_agg(up, ' > ' ORDER BY depth DESC) || ' > ' || node AS path, count(*) AS depth FROM w GROUP BY node UNION ALL SELECT DISTINCT parent, parent, 0 FROM p WHERE parent NOT IN (SELECT child FROM p)",
)
def place_order(t: Tables) -> DataFrame:
    return tree.depth_first(places(t))


@query("uber_root", f"WITH {_PLACES} SELECT parent, count(*) AS n FROM p WHERE parent NOT IN (SELECT child FROM p) GROUP BY parent ORDER BY n DESC, parent LIMIT 1")
def uber_root(t: Tables) -> DataFrame:
    return tree.uber_root(places(t))


@query(
    "hierarchy_health",
    f"""WITH RECURSIVE {_WALK}, d AS (SELECT node, max(depth) AS depth FROM w GROUP BY node UNION ALL SELECT DISTINCT parent, 0 FROM p WHERE parent NOT IN (SELECT child FROM p)),
k AS (SELECT parent, count(*) AS n FROM p GROUP BY parent ORDER BY n DESC, parent LIMIT 1)
SELECT (SELECT max(depth) FROM d)::BIGINT AS max_depth, (SELECT sum(depth) FROM d)::BIGINT AS sum_depth, (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM d WHERE depth = 0) AS roots, 0::BIGINT AS looped,
       k.n AS max_children, k.parent AS busiest, 0::BIGINT AS inversions FROM k""",
)
def hierarchy_health(t: Tables) -> DataFrame:
    edges = places(t)
    named = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    rank = named.select("node", F.instr(F.lit("rnsc"), F.substring("node", 1, 1)).alias("rank"))
    return tree.health(edges, rank)


def gold(t: Tables) -> DataFrame:
    s = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"), F.when(F.col("s_suppkey") % 6 == 0, (F.col("s_nationkey") + 1) % 25).otherwise(F.col("s_nationkey")).alias("k"))
    return s.select("child", F.concat(F.lit("n"), F.col("k").cast("string")).alias("parent"))


@query(
    "topology_scores",
    f"""WITH {_PLACES}, g AS (SELECT 's' || s_suppkey AS child, 'n' || (CASE WHEN s_suppkey % 6 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END) AS want FROM supplier),
q AS (SELECT child, parent FROM p WHERE NOT (child LIKE 's%0')), n AS (SELECT count(*) AS gold, count(q.parent) AS covered, count(*) FILTER (WHERE q.parent = want) AS "right" FROM g LEFT JOIN q USING (child))
SELECT gold, covered, "right", "right" * 10000 // covered AS "precision", "right" * 10000 // gold AS recall, (gold - covered) * 10000 // gold AS orphans FROM n""",
)
def topology_scores(t: Tables) -> DataFrame:
    return evaluate.parent_scores(places(t).where("not child like 's%0'"), gold(t))


@query(
    "common_parents",
    """WITH v AS (SELECT l_suppkey AS child, l_partkey % 30 + 1 AS parent, count(*) AS weight FROM lineitem GROUP BY ALL), q AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
j AS (SELECT a, b, x.parent, x.weight + y.weight AS w FROM q JOIN v x ON x.child = a JOIN v y ON y.child = b AND y.parent = x.parent WHERE x.parent <> a AND x.parent <> b)
SELECT a, b, parent, w FROM j QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY w DESC, parent) = 1""",
)
def common_parents(t: Tables) -> DataFrame:
    votes = t.lineitem.groupBy(F.col("l_suppkey").alias("child"), (F.col("l_partkey") % 30 + 1).alias("parent")).agg(F.count("*").alias("weight"))
    return tree.common_parents(votes, t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")))


@query(
    "lifted_phantoms",
    f"""WITH {_PLACES}, f AS (SELECT 'c' || o_custkey AS node, count(*) AS freq FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
n AS (SELECT parent, count(*) AS n FROM p GROUP BY parent), h AS (SELECT n.parent, n.n, up.parent AS grand FROM n JOIN p up ON up.child = n.parent LEFT JOIN f ON f.node = n.parent WHERE coalesce(freq, 0) <= 3 AND n >= 5 AND n >= 3 * greatest(coalesce(freq, 0), 1)),
o AS (SELECT p.child, h.grand, h.n, coalesce(f.freq, 0) AS freq, row_number() OVER (PARTITION BY p.parent ORDER BY coalesce(f.freq, 0), p.child) AS k FROM p JOIN h ON p.parent = h.parent LEFT JOIN f ON f.node = p.child),
m AS (SELECT child, grand FROM o WHERE k <= n - 3 AND freq <= 1) SELECT p.child, coalesce(m.grand, p.parent) AS parent FROM p LEFT JOIN m USING (child)""",
)
def lifted_phantoms(t: Tables) -> DataFrame:
    freq = t.orders.where("o_orderstatus = 'P'").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node")).agg(F.count("*").alias("freq"))
    return tree.lifted_phantoms(places(t), freq)


@query(
    "layer_propagation",
    f"WITH RECURSIVE {_WALK}, a AS (SELECT node, arg_max(up, depth) AS root FROM w GROUP BY node) SELECT node, root AS layer FROM a UNION ALL SELECT DISTINCT parent, parent FROM p WHERE parent NOT IN (SELECT child FROM p)",
)
def layer_propagation(t: Tables) -> DataFrame:
    edges = places(t)
    tops = tree.roots(edges).select("node", F.col("node").alias("layer"))
    return tree.propagated(edges, tops)


@query(
    "label_agreement",
    """WITH r AS (SELECT quality AS a, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS b FROM labels), c AS (SELECT a, b, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT sum(n)::BIGINT AS n, sum(CASE WHEN a = b THEN n ELSE 0 END)::BIGINT AS same FROM c), h AS (SELECT sum(x.n * y.n)::BIGINT AS chance FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON x.a = y.b)
SELECT n, same, chance, CAST(floor((same / n - chance / (n::DOUBLE * n)) / (1 - chance / (n::DOUBLE * n)) * 10000) AS BIGINT) AS kappa FROM s, h""",
)
def label_agreement(t: Tables) -> DataFrame:
    second = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return evaluate.kappa(t.labels.select(F.col("quality").alias("x"), second.alias("y")), "x", "y")


@query("label_shares", "SELECT toxic, count(quality) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 1) * 10000 // count(quality) AS share FROM labels GROUP BY toxic")
def label_shares(t: Tables) -> DataFrame:
    return evaluate.label_ratio(t.labels, "toxic", F.col("quality") == 1)


@query("bootstrap_quality")
def bootstrap_quality(t: Tables) -> DataFrame:
    return evaluate.bootstrap(t.labels, "quality", "toxic")


@query("quality_by_stratum", "SELECT quality, count(toxic) AS nodes, count(*) FILTER (WHERE toxic <> 0) AS errors, ((count(toxic) - count(*) FILTER (WHERE toxic <> 0)) * 10000 // count(toxic))::BIGINT AS overall FROM labels WHERE toxic IS NOT NULL GROUP BY quality")
def quality_by_stratum(t: Tables) -> DataFrame:
    return evaluate.strata(t.labels, "quality", "toxic")


@query("resample_sizes", "SELECT r.round, (SELECT count(toxic) FROM labels) AS nodes FROM (SELECT unnest(range(10000)) AS round) r")
def resample_sizes(t: Tables) -> DataFrame:
    """Every resample has as many nodes as there are flags."""
    return evaluate.resampled(t.labels, "quality", "toxic").select("round", "nodes")
