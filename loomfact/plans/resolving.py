"""Repairs of a tree of places, operation logs, evaluation against gold, and rules over texts, on stand-in tables.

The tree is region > nation > supplier and customer (see ``graphs``); another one has the
parts as a heap, where place k lies in place k / 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals, resolve, split
from ..registry import Tables, query
from .graphs import _PLACES, gold, places
from .narrative import _HEAP, _heap

_RANKS = "k AS (SELECT p_partkey AS node, p_size % 7 AS rank FROM part)"
_TEXT = "cast(p_partkey AS VARCHAR)"


def _ranks(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 7).alias("rank"))


def _text_edges(t: Tables) -> DataFrame:
    return _heap(t).select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"))


@query("continents", f"WITH RECURSIVE {_HEAP}, {_RANKS}, w(node, up, k) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT w.node, e.parent, k + 1 FROM w JOIN e ON e.child = w.up WHERE w.up NOT IN (SELECT node FROM k WHERE rank = 0)) SELECT node, up AS continent FROM w WHERE up IN (SELECT node FROM k WHERE rank = 0)")
def continents(t: Tables) -> DataFrame:
    return resolve.continents(_heap(t), _ranks(t))


@query("contained_flipped", f"WITH x AS (SELECT p_name AS child, p_type AS parent FROM part UNION ALL SELECT left(p_type, 4), p_type FROM part) SELECT CASE WHEN starts_with(parent, child) AND parent <> child THEN parent ELSE child END AS child, CASE WHEN starts_with(parent, child) AND parent <> child THEN child ELSE parent END AS parent FROM x")
def contained_flipped(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_name").alias("child"), F.col("p_type").alias("parent")).union(t.part.select(F.substring("p_type", 1, 4), "p_type"))
    return resolve.contained_flipped(rows)


@query("without_inversions", f"WITH {_HEAP}, {_RANKS}, b AS (SELECT DISTINCT e.parent AS node FROM e JOIN k c ON c.node = e.child JOIN k p ON p.node = e.parent WHERE p.rank > c.rank) SELECT child, parent FROM e WHERE child NOT IN (SELECT node FROM b)")
def without_inversions(t: Tables) -> DataFrame:
    return resolve.without_inversions(_heap(t), _ranks(t))


@query("place_tiers", f"WITH RECURSIVE {_HEAP}, {_RANKS}, w(node, tier) AS (SELECT node, rank FROM k WHERE node NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, greatest(k.rank, tier + 1) FROM w JOIN e ON e.parent = w.node JOIN k ON k.node = e.child) SELECT node, tier::BIGINT AS tier FROM w WHERE node IN (SELECT child FROM e)")
def place_tiers(t: Tables) -> DataFrame:
    return resolve.tiers(_heap(t), _ranks(t)).select("node", F.col("tier").cast("long").alias("tier"))


@query(
    "acyclic_places",
    """WITH r AS (SELECT p_partkey AS child, p_partkey // 10 AS g, p_size, min(p_partkey) OVER (PARTITION BY p_partkey // 10) AS lo, max(p_partkey) OVER (PARTITION BY p_partkey // 10) AS hi FROM part),
m AS (SELECT g, arg_min(child, p_size::BIGINT * 100000000 + child) AS c FROM r GROUP BY g) SELECT child, CASE WHEN child = c THEN 0 WHEN child = hi THEN lo ELSE child + 1 END AS parent FROM r JOIN m USING (g)""",
)
def acyclic_places(t: Tables) -> DataFrame:
    """All parts in rings of ten (the first and last of fewer), which lose their weakest edge; its child goes below the top."""
    k, ring = F.col("p_partkey"), Window.partitionBy(F.floor(F.col("p_partkey") / 10))
    following = F.when(k == F.max(k).over(ring), F.min(k).over(ring)).otherwise(k + 1)
    text = lambda c: F.lpad(c.cast("string"), 12, "0")
    edges = t.part.select(text(k).alias("child"), text(following).alias("parent"), F.col("p_size").alias("weight"))
    return resolve.acyclic(edges, edges, "0").select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent"))


@query("novel_eras", "WITH h AS (SELECT source AS novel, max(contains(text, ' the ')::INT) + max(contains(text, ' of ')::INT) AS a, max(contains(text, ' und ')::INT) + max(contains(text, ' der ')::INT) AS b FROM documents GROUP BY 1) SELECT novel, CASE WHEN b >= 2 THEN 'ming' WHEN a >= 2 THEN 'song' ELSE 'other' END AS era FROM h")
def novel_eras(t: Tables) -> DataFrame:
    names = t.documents.select(F.col("source").alias("novel"), F.col("text").alias("name"))
    return resolve.first_era(names, (("ming", (" und ", " der ")), ("song", (" the ", " of "))), "other")


@query("prior_votes", "WITH v AS (SELECT p_brand AS novel, 'p' || p_partkey % 40 AS child, 'p' || p_partkey % 7 AS parent, count(*) AS weight FROM part GROUP BY ALL), r AS (SELECT DISTINCT p_brand AS novel, 'p1' AS child, 'p0' AS parent, 15 AS weight FROM part WHERE p_brand LIKE '%1') SELECT novel, child, parent, sum(weight)::BIGINT AS weight FROM (SELECT * FROM v UNION ALL SELECT * FROM r) GROUP BY ALL")
def prior_votes(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    votes = t.part.groupBy(F.col("p_brand").alias("novel"), F.concat(F.lit("p"), (p % 40).cast("string")).alias("child"), F.concat(F.lit("p"), (p % 7).cast("string")).alias("parent")).agg(F.count("*").alias("weight"))
    novels = t.part.select(F.col("p_brand").alias("novel"), F.substring("p_brand", -1, 1).alias("title")).distinct()
    return resolve.with_priors(votes, novels, t.spark.createDataFrame([("1", "p1", "p0", 15)], "title string, child string, parent string, weight long"))


@query("caught_orphans", "WITH o AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT DISTINCT left(p_name, p_size % 5 + 1) AS name FROM part) SELECT o.name AS child, coalesce(arg_max(p.name, length(p.name)), 'top') AS parent FROM o LEFT JOIN p ON starts_with(o.name, p.name) AND o.name <> p.name GROUP BY o.name")
def caught_orphans(t: Tables) -> DataFrame:
    placed = t.part.select(F.substring(F.col("p_name"), F.lit(1), F.col("p_size") % 5 + 1).alias("name"))
    return resolve.caught(t.part.select(F.col("p_name").alias("name")), placed, "top")


@query("safe_moves", f"WITH RECURSIVE {_HEAP}, m AS (SELECT DISTINCT l_partkey % 500 + 1 AS child, l_suppkey AS parent FROM lineitem), w(child, parent, up) AS (SELECT child, parent, parent FROM m UNION ALL SELECT w.child, w.parent, e.parent FROM w JOIN e ON e.child = w.up) SELECT child, parent FROM m WHERE child <> parent AND (child, parent) NOT IN (SELECT child, parent FROM w WHERE up = child AND child <> parent)")
def safe_moves(t: Tables) -> DataFrame:
    moves = t.lineitem.select((F.col("l_partkey") % 500 + 1).alias("child"), F.col("l_suppkey").alias("parent")).distinct()
    return resolve.safe_moves(_heap(t), moves)


@query("applied_changes", f"WITH {_PLACES}, c AS (SELECT 's' || s_suppkey AS child, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'n' || s_suppkey % 25 END AS new, s_acctbal > 0 AS selected FROM supplier), b AS (SELECT coalesce(p.child, c.child) AS child, CASE WHEN c.child IS NOT NULL THEN c.new ELSE p.parent END AS parent FROM p FULL JOIN (SELECT * FROM c WHERE selected) c ON c.child = p.child) SELECT * FROM b WHERE parent IS NOT NULL")
def applied_changes(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    changes = t.supplier.select(F.concat(F.lit("s"), s.cast("string")).alias("child"), F.when(s % 4 != 0, F.concat(F.lit("n"), (s % 25).cast("string"))).alias("parent"), (F.col("s_acctbal") > 0).alias("selected"))
    return resolve.applied(places(t), changes)


@query("subtrees", f"WITH RECURSIVE {_PLACES}, t AS (SELECT child FROM p WHERE parent NOT IN (SELECT child FROM p)), w(node, subtree) AS (SELECT child, child FROM t UNION ALL SELECT p.child, w.subtree FROM w JOIN p ON p.parent = w.node) SELECT * FROM w")
def subtrees(t: Tables) -> DataFrame:
    return resolve.subtrees(places(t))


@query("depth_histogram", f"WITH RECURSIVE {_HEAP}, w(node, depth) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT e.child, depth + 1 FROM w JOIN e ON e.parent = w.node) SELECT depth, count(*) AS nodes FROM w GROUP BY depth")
def depth_histogram(t: Tables) -> DataFrame:
    return resolve.depth_histogram(_heap(t))


@query(
    "chain_accuracy",
    f"""WITH RECURSIVE {_HEAP}, q AS (SELECT child, CASE WHEN child % 7 = 0 THEN 1 ELSE parent END AS said FROM e), l AS (SELECT child AS node FROM e WHERE child NOT IN (SELECT parent FROM e)),
w(node, spot, length, agree, clean) AS (SELECT node, node, 0::BIGINT, 0::BIGINT, true FROM l UNION ALL SELECT w.node, e.parent, length + 1, agree + (clean AND said = e.parent)::INT, clean AND said = e.parent FROM w JOIN e ON e.child = w.spot JOIN q ON q.child = w.spot)
SELECT node, max(length) AS length, max(agree) AS agree FROM w GROUP BY node""",
)
def chain_accuracy(t: Tables) -> DataFrame:
    said = _heap(t).select("child", F.when(F.col("child") % 7 == 0, F.lit(1)).otherwise(F.col("parent")).alias("parent"))
    return resolve.chain_accuracy(said, _heap(t))


@query(
    "node_errors",
    f"""WITH {_HEAP}, {_RANKS}, n AS (SELECT parent AS node, count(*) AS kids FROM e GROUP BY 1), x AS (SELECT k.node, k.rank, p.rank AS above, coalesce(kids, 0) AS kids, p_type, p_name FROM k JOIN part ON p_partkey = k.node LEFT JOIN e ON e.child = k.node LEFT JOIN k p ON p.node = e.parent LEFT JOIN n ON n.node = k.node)
SELECT node, concat_ws(',', CASE WHEN above IS NULL THEN 'no_parent' END, CASE WHEN above > rank THEN 'tier_inversion' END, CASE WHEN kids > 1 AND rank >= 5 THEN 'site_with_children' END, CASE WHEN starts_with(p_type, 'STANDARD') AND rank < 2 THEN 'type_mismatch' END) AS errors FROM x WHERE above IS NULL OR above > rank OR (kids > 1 AND rank >= 5) OR (starts_with(p_type, 'STANDARD') AND rank < 2)""",
)
def node_errors(t: Tables) -> DataFrame:
    """Names of the rules that a place breaks."""
    kids = _heap(t).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    above = _heap(t).join(_ranks(t).select(F.col("node").alias("parent"), F.col("rank").alias("above")), "parent").select(F.col("child").alias("node"), "above")
    kind = t.part.select(F.col("p_partkey").alias("node"), "p_type")
    nodes = _ranks(t).join(kind, "node").join(above, "node", "left").join(kids, "node", "left")
    rules = {
        "no_parent": F.col("above").isNull(),
        "tier_inversion": F.col("above") > F.col("rank"),
        "site_with_children": (F.col("kids") > 1) & (F.col("rank") >= 5),
        "type_mismatch": F.startswith("p_type", F.lit("STANDARD")) & (F.col("rank") < 2),
    }
    return resolve.node_errors(nodes, rules)


@query("gold_counts", f"WITH {_PLACES}, g AS (SELECT 's' || s_suppkey AS child, 'n' || (CASE WHEN s_suppkey % 6 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END) AS want FROM supplier), q AS (SELECT child, parent FROM p WHERE NOT (child LIKE 's%0')) SELECT CASE WHEN parent IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' WHEN parent = want THEN 'right' ELSE 'wrong_parent' END AS kind, count(*) AS n FROM q FULL JOIN g USING (child) GROUP BY 1")
def gold_counts(t: Tables) -> DataFrame:
    return resolve.gold_counts(places(t).where("not child like 's%0'"), gold(t))


@query(
    "fix_plan",
    """WITH o AS (SELECT s_name AS node, 'n' || s_nationkey AS parent, s_suppkey % 4 AS tier FROM supplier WHERE s_suppkey % 9 <> 0), g AS (SELECT s_name AS node, 'n' || (s_nationkey + (s_suppkey % 5 = 0)::INT) AS parent, s_suppkey % 3 AS tier FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT node, 'delete' AS step, '' AS value FROM o WHERE node NOT IN (SELECT node FROM g) UNION ALL SELECT node, 'add', parent FROM g WHERE node NOT IN (SELECT node FROM o)
UNION ALL SELECT node, 'retier', g.tier::VARCHAR FROM o JOIN g USING (node) WHERE o.tier <> g.tier UNION ALL SELECT node, 'reparent', g.parent FROM o JOIN g USING (node) WHERE o.parent <> g.parent""",
)
def fix_plan(t: Tables) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    own = t.supplier.where(s % 9 != 0).select(F.col("s_name").alias("node"), F.concat(F.lit("n"), n.cast("string")).alias("parent"), (s % 4).alias("tier"))
    want = t.supplier.where(s % 7 != 0).select(F.col("s_name").alias("node"), F.concat(F.lit("n"), (n + (s % 5 == 0).cast("int")).cast("string")).alias("parent"), (s % 3).alias("tier"))
    return resolve.fix_plan(own, want)


@query("operation_state", "SELECT user_id AS place, event_type AS kind, arg_max(event_id % 100, event_id) AS value FROM events GROUP BY 1, 2")
def operation_state(t: Tables) -> DataFrame:
    """What the log of operations on places comes to."""
    log = t.events.select(F.col("user_id").alias("place"), F.col("event_type").alias("kind"), "event_id", (F.col("event_id") % 100).alias("value"))
    return resolve.state_from_log(log, ["place", "kind"], "event_id")


@query("travel_axis", "WITH m AS (SELECT (l_suppkey % 11 - 5) AS dx, (l_partkey % 7 - 2) AS dy FROM lineitem), s AS (SELECT sum(dx)::BIGINT AS dx, sum(dy)::BIGINT AS dy FROM m) SELECT dx, dy, CASE WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'east' ELSE 'west' END ELSE CASE WHEN dy >= 0 THEN 'north' ELSE 'south' END END AS axis FROM s")
def travel_axis(t: Tables) -> DataFrame:
    return resolve.axis(t.lineitem.select((F.col("l_suppkey") % 11 - 5).alias("dx"), (F.col("l_partkey") % 7 - 2).alias("dy")))


@query("efficiency", "SELECT o_orderpriority AS model, count(*) AS chapters, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS ms, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS slowest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def efficiency(t: Tables) -> DataFrame:
    ms = F.round(F.col("o_totalprice") * 100).cast("long")
    return t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("chapters"), F.sum(ms).alias("ms"), F.max(ms).alias("slowest"))


@query("live_timing", "SELECT o_custkey AS task, count(*) AS done, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT // count(*) AS mean_ms, (sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT // count(*)) * (30 - count(*)) AS eta_ms FROM orders GROUP BY 1")
def live_timing(t: Tables) -> DataFrame:
    """Mean time of a chapter and what is left of thirty chapters."""
    ms = F.round(F.col("o_totalprice") * 100).cast("long")
    g = t.orders.groupBy(F.col("o_custkey").alias("task")).agg(F.count("*").alias("done"), F.sum(ms).alias("ms"))
    mean = F.expr("ms div done")
    return g.select("task", "done", mean.alias("mean_ms"), (mean * (30 - F.col("done"))).alias("eta_ms"))


_LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)), 1) - 1 AS line_no, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10))) AS line FROM documents)"


@query(
    "heuristic_titles",
    rf"""WITH RECURSIVE {_LINES}, x AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS title, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
y AS (SELECT *, coalesce(lag(title) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS before FROM x),
c AS (SELECT *, start + length(line) + 1 AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM y WHERE before = '' AND length(title) BETWEEN 1 AND 30 AND NOT regexp_matches(title, '[,;:!?]') AND NOT regexp_matches(title, '^[0-9]+$') AND regexp_matches(title, '[\pL\pN]')
      AND NOT regexp_matches(replace(title, ' ', ''), '(?i)https?://|www\.|\.com|\.cn|\.net|\.org|\.txt')),
w(doc_id, k, stop, kept) AS (SELECT doc_id, k, stop, true FROM c WHERE k = 1 UNION ALL SELECT c.doc_id, c.k, CASE WHEN c.start - w.stop >= 500 THEN c.stop ELSE w.stop END, c.start - w.stop >= 500 FROM w JOIN c ON c.doc_id = w.doc_id AND c.k = w.k + 1)
SELECT doc_id, line_no, title FROM w JOIN c USING (doc_id, k) WHERE kept QUALIFY count(*) OVER (PARTITION BY doc_id) > 1""",
)
def heuristic_titles(t: Tables) -> DataFrame:
    """Short lines of the documents, whose paragraphs are set apart by blank lines."""
    books = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return split.heuristic_titles(books, "doc_id", "text", ",;:!?")


@query("title_words", r"SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(string_split(text, chr(10))[1], '^[A-Za-z]+ ?[0-9]* ?', ''), '[A-Za-z]{3,}')) AS word FROM documents)")
def title_words(t: Tables) -> DataFrame:
    """Words of titles (first lines) without their number and what stands before it."""
    rest = F.regexp_replace(F.split("text", "\n")[0], "^[A-Za-z]+ ?[0-9]* ?", "")
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all(rest, F.lit("([A-Za-z]{3,})"), F.lit(1))).alias("word")).distinct()


@query("segments", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN 3 WHEN length(text) > 2000 THEN 2 ELSE 1 END::BIGINT AS parts, length(text) AS chars FROM documents")
def segments(t: Tables) -> DataFrame:
    """Into how many parts a chapter goes to the model."""
    n = F.char_length("text")
    return t.documents.select("doc_id", F.when(n > 4000, 3).when(n > 2000, 2).otherwise(1).cast("long").alias("parts"), n.cast("long").alias("chars"))


#: Modes and dialogue of the stand-in texts.
_MODES = {"capital": "^T[a-z]", "separator": "^[A-Z][a-z]{0,4}[.!?]$"}


@query(
    "text_genres",
    rf"""WITH d AS (SELECT doc_id, length(text) AS size, string_split(text, chr(10)) AS ls, list_filter(list_transform(string_split(left(text, 50000), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, size, len(s) AS n, CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: left(x, 1) IN ('D', 'É'))) / len(s) ELSE 0 END AS dialogue, CASE WHEN len(s) > 0 THEN list_sum(list_transform(s, lambda x: length(x))) / len(s) ELSE 0 END AS mean,
      len(list_filter(ls, lambda x: regexp_matches(x, '^T[a-z]'))) AS h1, len(list_filter(ls, lambda x: regexp_matches(x, '^[A-Z][a-z]{{0,4}}[.!?]$'))) AS h2 FROM d),
g AS (SELECT *, dialogue < 0.01 AND h1 < 2 AND h2 < 2 AS quiet FROM f)
SELECT doc_id, CASE WHEN dialogue > 0.05 THEN 'novel' WHEN mean < 50 AND n > 100 AND size < 50000 AND quiet THEN 'poetry' WHEN size < 30000 AND quiet THEN 'essay' WHEN h2 >= 3 AND size < 200000 THEN 'short_collection' ELSE 'unknown' END AS genre,
       CASE WHEN dialogue > 0.05 THEN 0.9 WHEN mean < 50 AND n > 100 AND size < 50000 AND quiet THEN 0.85 WHEN size < 30000 AND quiet THEN 0.8 WHEN h2 >= 3 AND size < 200000 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM g""",
)
def text_genres(t: Tables) -> DataFrame:
    return split.text_genre(split.genre_features(t.documents, "doc_id", "text", _MODES, "DÉ"), "doc_id")


_BOOKS = "b AS (SELECT c_nationkey AS book, string_agg(n_name || CASE WHEN c_acctbal < 500 THEN ' ' || n_regionkey ELSE '' END || '(' || c_custkey || ')', chr(10) ORDER BY c_custkey) AS text FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)"


@query("paginated_books", rf"WITH {_BOOKS}, l AS (SELECT book, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM b), m AS (SELECT book, k, trim(regexp_extract(line, '^(.{{1,20}})\((\d+)\)\s*$', 1)) AS title FROM l WHERE regexp_matches(line, '^.{{1,20}}\(\d+\)\s*$')), n AS (SELECT book, title, count(*) AS n, min(k) AS seen FROM m GROUP BY ALL) SELECT book, arg_max(title, n * 1000000 - seen) AS title, max(n) AS hits FROM n GROUP BY book HAVING sum(n) >= 5 AND max(n) * 100 >= sum(n) * 80")
def paginated_books(t: Tables) -> DataFrame:
    """A nation's customers as the numbered pages of its book; some stand under another title."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat("n_name", F.when(F.col("c_acctbal") < 500, F.concat(F.lit(" "), F.col("n_regionkey").cast("string"))).otherwise(""), F.lit("("), F.col("c_custkey").cast("string"), F.lit(")"))
    pages = F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line"))))
    books = c.groupBy(F.col("c_nationkey").alias("book")).agg(F.array_join(F.transform(pages, lambda x: x["line"]), "\n").alias("text"))
    return split.paginated(books, "book", "text")


@query("geo_types", "WITH s AS (SELECT s_nationkey AS novel, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 5000) AS hit FROM supplier GROUP BY 1) SELECT novel, CASE WHEN hit * 100 >= n * 20 THEN 'realistic' WHEN hit * 100 >= n * 15 THEN 'mixed' ELSE 'fantasy' END AS kind FROM s")
def geo_types(t: Tables) -> DataFrame:
    """Whether a novel's places are real, by the share of them that a gazetteer knows as notable."""
    g = t.supplier.groupBy(F.col("s_nationkey").alias("novel")).agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 5000).alias("hit"))
    kind = F.when(F.col("hit") * 100 >= F.col("n") * 20, "realistic").when(F.col("hit") * 100 >= F.col("n") * 15, "mixed").otherwise("fantasy")
    return g.select("novel", kind.alias("kind"))


@query("chapter_entities", "SELECT DISTINCT chapter, kind, name FROM (SELECT l_orderkey AS chapter, 'person' AS kind, 's' || l_suppkey AS name FROM lineitem UNION ALL SELECT l_orderkey, 'place', 'p' || l_partkey FROM lineitem UNION ALL SELECT l_orderkey, 'person', 'n' || s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)")
def chapter_entities(t: Tables) -> DataFrame:
    """All names of a chapter, with other names of its persons."""
    li = t.lineitem
    named = lambda kind, mark, c: li.select(F.col("l_orderkey").alias("chapter"), F.lit(kind).alias("kind"), F.concat(F.lit(mark), F.col(c).cast("string")).alias("name"))
    other = li.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", F.lit("person"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    return named("person", "s", "l_suppkey").union(named("place", "p", "l_partkey")).union(other).distinct()


@query("usable_splits", "WITH g AS (SELECT o_custkey AS book, count(*) AS chapters, max(floor(o_totalprice / 8)) AS most, sum(floor(o_totalprice / 8)) AS total, count(*) FILTER (WHERE floor(o_totalprice / 8) BETWEEN 2000 AND 20000) AS usual FROM orders GROUP BY 1), u AS (SELECT *, (chapters >= 3 AND most <= 50000) OR (chapters >= 2 AND total <= 80000) OR (chapters >= 5 AND usual * 5 >= chapters * 4) AS usable FROM g) SELECT book, chapters, usable, CASE WHEN usable THEN '' WHEN chapters = 1 THEN CASE WHEN total > 50000 THEN 'single_huge_chapter' ELSE 'single_chapter_small' END WHEN chapters = 2 AND total > 80000 THEN 'only_2_chapters' WHEN most > 50000 THEN 'oversized_chapter' WHEN chapters < 3 THEN 'too_few_chapters' ELSE 'other' END AS reason FROM u")
def usable_splits(t: Tables) -> DataFrame:
    """Customers as books, their orders as chapters of so many words."""
    words = F.floor(F.col("o_totalprice") / 8)
    return split.usable(t.orders.select(F.col("o_custkey").alias("book"), words.alias("words")), "book", "words")


#: The parts as one path, each below the one before it: as deep as there are parts.
_LINE = "e AS (SELECT p_partkey AS child, p_partkey - 1 AS parent FROM part WHERE p_partkey > 0)"


def _line(t: Tables) -> DataFrame:
    return t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") - 1).alias("parent"))


@query("line_tour", "SELECT p_partkey AS node, p_partkey AS depth, p_partkey AS enter, 2 * (SELECT count(*) FROM part) - 1 - p_partkey AS leave FROM part")
def line_tour(t: Tables) -> DataFrame:
    return intervals.numbered(_line(t)).select("node", "depth", "enter", "leave")


@query("line_continents", f"WITH {_LINE}, {_RANKS} SELECT child AS node, max(k.node) AS continent FROM e JOIN k ON k.rank = 0 AND k.node < e.child GROUP BY child")
def line_continents(t: Tables) -> DataFrame:
    return resolve.continents(_line(t), _ranks(t))


@query("line_accuracy", f"WITH {_LINE}, d AS (SELECT max(p_partkey) AS last FROM part), c AS (SELECT max(child) AS parted FROM e WHERE child % 997 = 5) SELECT last AS node, last AS length, coalesce(last - parted, last) AS agree FROM d, c")
def line_accuracy(t: Tables) -> DataFrame:
    said = _line(t).withColumn("parent", F.when(F.col("child") % 997 == 5, F.lit(0)).otherwise(F.col("parent")))
    return resolve.chain_accuracy(said, _line(t))


_ASKED = "q AS (SELECT DISTINCT l_partkey AS a, l_partkey * 7 % (SELECT count(*) FROM part) AS b FROM lineitem)"


def _asked(t: Tables) -> DataFrame:
    n = t.part.agg(F.count("*").alias("n"))
    return t.lineitem.select("l_partkey").distinct().join(F.broadcast(n)).select(F.col("l_partkey").alias("a"), (F.col("l_partkey") * 7 % F.col("n")).alias("b"))  # one row


@query(
    "common_ancestors",
    f"""WITH RECURSIVE {_HEAP}, {_ASKED}, w(a, b, x, y) AS (SELECT a, b, a, b FROM q UNION ALL SELECT a, b, CASE WHEN x > y THEN x // 2 ELSE x END, CASE WHEN y > x THEN y // 2 ELSE y END FROM w WHERE x <> y)
SELECT a, b, x AS ancestor, length(bin(x)) - 1 AS depth FROM w WHERE x = y AND x > 0""",
)
def common_ancestors(t: Tables) -> DataFrame:
    return intervals.common_ancestors(_asked(t), intervals.numbered(_heap(t)))


@query("line_common_ancestors", f"WITH {_ASKED} SELECT a, b, least(a, b) AS ancestor, least(a, b) AS depth FROM q")
def line_common_ancestors(t: Tables) -> DataFrame:
    return intervals.common_ancestors(_asked(t), intervals.numbered(_line(t)))


@query("line_ancestor_tests", f"WITH {_ASKED} SELECT a, b, a <= b AS above FROM q")
def line_ancestor_tests(t: Tables) -> DataFrame:
    return intervals.above_or_same(_asked(t), intervals.numbered(_line(t)))


@query("settled_moves")
def settled_moves(t: Tables) -> DataFrame:
    """Places moved in order, one for each supplier; every tenth asks to go below a child of its own."""
    n = t.part.agg(F.count("*").alias("n"))
    k = F.col("s_suppkey")
    child = k * 13 % F.col("n") + 1
    rows = t.supplier.join(F.broadcast(n)).select(k.alias("seq"), child.alias("child"), F.when(k % 10 == 0, child * 2 + 1).otherwise(F.col("s_nationkey") + 1).alias("parent"))  # one row
    return intervals.settled(_heap(t), rows)[0]
