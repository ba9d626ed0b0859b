"""Conflicts, timelines and scene flow over stand-in tables.

A user's events are a relation's or a person's history; an order's lines are the facts of
a chapter; conversations are scenes whose place is the role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence as seq
from ..registry import Tables, query


def history(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("event_id").alias("id"))


E = "e AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id AS id FROM events)"


@query(
    "stage_runs",
    f"""WITH {E}, a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY event_id) AS details FROM b GROUP BY user_id, run""",
)
def stage_runs(t: Tables) -> DataFrame:
    return seq.stage_runs(history(t), ["user_id"], ["event_id"], "event_type", "id")


@query(
    "ability_regressions",
    f"""WITH {E}, a AS (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS between_ FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT x.user_id, x.event_type, x.between_, max(y.event_id) AS since, x.event_id AS "at", max(y.n) AS m, x.n FROM a x JOIN a y ON x.user_id = y.user_id AND x.event_type = y.event_type AND y.n < x.n GROUP BY ALL)
SELECT user_id, event_type, between_ AS "between", since, "at" FROM b WHERE m <= n - 2 AND between_ <> event_type""",
)
def ability_regressions(t: Tables) -> DataFrame:
    return seq.regressions(history(t), ["user_id"], ["event_id"], "event_type")


@query(
    "relation_flips",
    f"""WITH {E}, a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id, event_id AS at, before, event_type FROM a WHERE (before = 'error' AND event_type IN ('purchase', 'signup')) OR (before IN ('purchase', 'signup') AND event_type = 'error')""",
)
def relation_flips(t: Tables) -> DataFrame:
    """Error is hostile, purchase and signup are family."""
    kind = F.col("event_type")
    return seq.flips(history(t), ["user_id"], ["event_id"], "event_type", kind == "error", kind.isin("purchase", "signup"))


@query("relation_changes", f"WITH {E}, a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e) SELECT user_id, event_id AS at, coalesce(before, '') AS before, event_type FROM a WHERE before IS DISTINCT FROM event_type")
def relation_changes(t: Tables) -> DataFrame:
    return seq.changes(history(t), ["user_id"], ["event_id"], "event_type").fillna("", ["before"])


@query("first_appearances", "SELECT l_suppkey AS person, min(l_orderkey) AS first, count(DISTINCT l_orderkey) AS chapters FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 3")
def first_appearances(t: Tables) -> DataFrame:
    return seq.first_appearances(t.lineitem.select(F.col("l_suppkey").alias("person"), "l_orderkey"), ["person"], "l_orderkey", 3)


@query("death_continuity", f"WITH {E}, d AS (SELECT user_id, min(event_id) AS ended FROM e WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, ended, min(event_id) AS again FROM e JOIN d USING (user_id) WHERE event_id > ended GROUP BY ALL")
def death_continuity(t: Tables) -> DataFrame:
    return seq.after_end(history(t), ["user_id"], "event_id", F.col("event_type") == "error")


@query(
    "location_minorities",
    """WITH n AS (SELECT l_suppkey AS place, l_shipmode AS parent, count(*) AS n, min(l_orderkey) AS seen FROM (SELECT l_suppkey, l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL),
m AS (SELECT *, first_value(parent) OVER (PARTITION BY place ORDER BY n DESC, seen) AS most FROM n) SELECT place, parent, most, n FROM m WHERE parent <> most AND n >= 2""",
)
def location_minorities(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("place"), F.concat("l_returnflag", "l_linestatus").alias("parent"), "l_orderkey")
    return seq.minorities(rows, "place", "parent", "l_orderkey")


_PLACES = "r AS (SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, CASE l_linestatus WHEN 'O' THEN 'north' ELSE 'south' END AS dir, l_quantity::BIGINT % 5 AS rank, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40)"


def places(t: Tables) -> DataFrame:
    a, b = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    rows = t.lineitem.where(a != b)
    direction = F.when(F.col("l_linestatus") == "O", "north").otherwise("south")
    return rows.select(a.alias("a"), b.alias("b"), direction.alias("dir"), (F.col("l_quantity").cast("long") % 5).alias("rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@query(
    "direction_conflicts",
    f"""WITH {_PLACES}, n AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b THEN (CASE dir WHEN 'north' THEN 'south' ELSE 'north' END) ELSE dir END AS dir, min(id) AS first, count(*) AS n FROM r GROUP BY ALL)
SELECT x.a, x.b, x.dir, x.first, x.n, y.dir AS other, y.first AS other_first, y.n AS other_n FROM n x JOIN n y ON x.a = y.a AND x.b = y.b AND x.dir = 'north' AND y.dir = 'south'""",
)
def direction_conflicts(t: Tables) -> DataFrame:
    return seq.opposites(places(t), "a", "b", "dir", "id", {"north": "south", "south": "north"})


@query(
    "distance_conflicts",
    f"""WITH {_PLACES}, n AS (SELECT least(a, b) AS a, greatest(a, b) AS b, rank, min(id) AS seen FROM r GROUP BY ALL)
SELECT x.a, x.b, x.rank AS one, y.rank AS two, abs(x.rank - y.rank) AS gap FROM n x JOIN n y ON x.a = y.a AND x.b = y.b AND (x.seen < y.seen OR (x.seen = y.seen AND x.rank < y.rank)) AND abs(x.rank - y.rank) >= 2""",
)
def distance_conflicts(t: Tables) -> DataFrame:
    return seq.distance_gaps(places(t), "a", "b", "rank", "id")


@query("scene_transitions", 'SELECT a AS "from", b AS "to", count(*) AS n FROM (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b <> a GROUP BY ALL')
def scene_transitions(t: Tables) -> DataFrame:
    return seq.transitions(t.conversations, ["conv_id"], ["turn"], "role")


_MOVES = """m AS (SELECT a AS f, b AS t, count(*) AS n FROM (SELECT l_suppkey % 60 AS a, lead(l_suppkey % 60) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b <> a GROUP BY ALL)"""


def moves(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 60).alias("place"))
    return seq.transitions(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "place")


@query("sibling_places", f"WITH {_MOVES} SELECT x.f AS a, x.t AS b, (x.n + y.n)::BIGINT AS n FROM m x JOIN m y ON x.f = y.t AND x.t = y.f AND x.f < x.t WHERE x.n + y.n >= 3")
def sibling_places(t: Tables) -> DataFrame:
    return seq.siblings(moves(t))


@query("hub_places", f"WITH {_MOVES}, s AS (SELECT x.f AS a, x.t AS b FROM m x JOIN m y ON x.f = y.t AND x.t = y.f) SELECT a AS place, count(*) AS neighbours FROM s GROUP BY a HAVING count(*) >= 4")
def hub_places(t: Tables) -> DataFrame:
    return seq.hubs(moves(t))


@query("volume_as_of", "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, coalesce(e.event_id, -1) AS volume FROM orders ASOF LEFT JOIN (SELECT user_id, ts - INTERVAL 25 YEAR AS at, max(event_id) AS event_id FROM events GROUP BY ALL) e ON o_custkey = user_id AND o_orderdate >= e.at")
def volume_as_of(t: Tables) -> DataFrame:
    """The last marker at or before each order; markers are a user's events 25 years back."""
    marks = t.events.select(F.col("user_id").alias("o_custkey"), (F.col("ts") - F.expr("interval 25 years")).alias("at"), F.col("event_id").alias("volume"))
    left = t.orders.select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return seq.as_of(left, marks, ["o_custkey"], "at", "volume").select("o_custkey", "o_orderkey", "day", F.coalesce("volume", F.lit(-1)).alias("volume"))


@query("increasing_numbers", "WITH a AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS number FROM orders), b AS (SELECT *, max(number) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a) SELECT o_custkey, o_orderkey, number FROM b WHERE top IS NULL OR number > top")
def increasing_numbers(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("number"))
    return seq.increasing(rows, ["o_custkey"], ["o_orderkey"], "number")


@query(
    "merged_turns",
    """WITH a AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a)
SELECT conv_id, min(turn) AS first, min(role) AS label, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM b GROUP BY conv_id, run""",
)
def merged_turns(t: Tables) -> DataFrame:
    return seq.merged_adjacent(t.conversations, ["conv_id"], "turn", F.col("role"), "text")


@query(
    "contiguous_ranges",
    """WITH a AS (SELECT l_orderkey, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS k, l_partkey % 50 + 10 * l_linenumber AS s, l_partkey % 50 + 10 * l_linenumber + l_suppkey % 17 AS e FROM lineitem),
b AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a)
SELECT l_orderkey, k, CASE WHEN m IS NULL THEN 0 ELSE m + 1 END AS "begin", greatest(e, CASE WHEN m IS NULL THEN 0 ELSE m + 1 END) AS "end" FROM b""",
)
def contiguous_ranges(t: Tables) -> DataFrame:
    start = F.col("l_partkey") % 50 + 10 * F.col("l_linenumber")
    rows = t.lineitem.select("l_orderkey", (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("k"), start.alias("s"), (start + F.col("l_suppkey") % 17).alias("e"))
    return seq.contiguous(rows, "l_orderkey", "k", "s", "e")


@query("break_points")
def break_points(t: Tables) -> DataFrame:
    """Breaks of a chapter's paragraphs by score; the spacing rule depends on the last break kept."""
    rows = t.events.select("user_id", F.row_number().over(_by_user()).alias("para"), (F.col("event_id") % 11).cast("double").alias("score"))
    return seq.kept_by_spacing(rows, ["user_id"], "para", "score", 5.0, 3, 7.0, 2)


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")
