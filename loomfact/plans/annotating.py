"""Annotations over stand-in tables: scenes' events, digests, centroids, renames, hints, roles and icons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import annotate, facts, resolve, scenes
from ..registry import Tables, query
from .narrative import _AT, _LIST, NAMES, mentions, names


@query(
    "filled_locations",
    "WITH l AS (SELECT l_orderkey AS chapter, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS spot, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS place FROM lineitem) SELECT chapter, spot, coalesce(last_value(place IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY spot ROWS UNBOUNDED PRECEDING), 0) AS place FROM l",
)
def filled_locations(t: Tables) -> DataFrame:
    """Paragraphs without a place take the one before."""
    spot = F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    rows = t.lineitem.select(F.col("l_orderkey").alias("chapter"), spot.alias("spot"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("place"))
    return annotate.filled_forward(rows, "chapter", "spot", "place").select("chapter", "spot", F.coalesce("place", F.lit(0)).alias("place"))


@query(
    "scene_events",
    f"""WITH e AS (SELECT l_orderkey AS chapter, {_AT} AS event, l_suppkey % 10 AS member FROM lineitem WHERE l_linestatus = 'O'), s AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber::BIGINT AS scene, l_suppkey % 10 AS member FROM lineitem WHERE l_linestatus = 'F')
SELECT chapter, scene, event FROM (SELECT DISTINCT chapter, scene, event FROM e JOIN s USING (chapter, member)) QUALIFY row_number() OVER (PARTITION BY chapter, scene ORDER BY event) <= 5""",
)
def scene_events(t: Tables) -> DataFrame:
    """The first five events whose people occur in a scene."""
    m = mentions(t).withColumn("member", F.col("person") % 10)
    events = m.where("state = 'O'").select("chapter", F.col("pos").alias("event"), "member")
    scenes = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").cast("long").alias("scene"), (F.col("l_suppkey") % 10).alias("member")).distinct()
    return resolve.first_n(events.join(scenes, ["chapter", "member"]).select("chapter", "scene", "event").distinct(), ["chapter", "scene"], 5, "event")


@query("report_names", "WITH m AS (SELECT 'person' AS kind, l_suppkey AS name, l_orderkey AS chapter FROM lineitem UNION ALL SELECT 'place', l_partkey, l_orderkey FROM lineitem UNION ALL SELECT 'org', l_suppkey % 40, l_orderkey FROM lineitem) SELECT kind, name, count(DISTINCT chapter) AS chapters FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(DISTINCT chapter) DESC, name) <= CASE kind WHEN 'org' THEN 20 ELSE 50 END")
def report_names(t: Tables) -> DataFrame:
    """The names that a report holds, most chapters first."""
    m = mentions(t)
    rows = m.select(F.lit("person").alias("kind"), F.col("person").alias("name"), "chapter").union(m.select(F.lit("place"), "place", "chapter")).union(m.select(F.lit("org"), F.col("person") % 40, "chapter"))
    return annotate.top_by_chapters(rows, {"person": 50, "place": 50, "org": 20})


@query(
    "checked_relations",
    """WITH a AS (SELECT s_suppkey AS alias, s_nationkey::BIGINT AS canonical FROM supplier WHERE s_suppkey % 3 = 0), r AS (SELECT l_orderkey AS chapter, coalesce(x.canonical, l_suppkey) AS a, coalesce(y.canonical, l_partkey % 25) AS b, min(l_returnflag) AS kind FROM lineitem LEFT JOIN a x ON x.alias = l_suppkey LEFT JOIN a y ON y.alias = l_partkey % 25 GROUP BY 1, 2, 3 HAVING a <> b),
t AS (SELECT *, (kind <> lag(kind) OVER (PARTITION BY a, b ORDER BY chapter))::INT AS turn FROM r), n AS (SELECT a, b, kind, count(*) AS n, min(chapter) AS first, sum(turn) AS turns FROM t GROUP BY a, b, kind),
g AS (SELECT a, b, count(*) AS kinds, coalesce(sum(turns), 0) AS turns, arg_max(kind, n * 10000000 - first) AS main FROM n GROUP BY a, b) SELECT a, b, chapter, CASE WHEN kinds > 2 OR turns > 1 THEN main ELSE kind END AS kind FROM r JOIN g USING (a, b)""",
)
def checked_relations(t: Tables) -> DataFrame:
    """Relations of a profile without those with itself, then settled."""
    alias = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("alias"), F.col("s_nationkey").cast("long").alias("canonical"))
    rows = mentions(t).select("chapter", F.col("person").alias("a"), (F.col("place") % 25).alias("b"), "kind")
    stages = facts.without_self(rows, alias, "a", "b").groupBy("a", "b", "chapter").agg(F.min("kind").alias("kind"))
    return facts.settled_relations(stages, ["a", "b"])


@query(
    "chapter_centroids",
    """WITH v AS (SELECT l_orderkey % 500 * 3 AS chapter, l_partkey % 90 AS x, l_suppkey % 70 AS y FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_orderkey % 1500 AS chapter FROM lineitem),
n AS (SELECT c.chapter, abs(v.chapter - c.chapter) AS width, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, count(*) AS n FROM c JOIN v ON abs(v.chapter - c.chapter) <= 5 GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY width) = 1""",
)
def chapter_centroids(t: Tables) -> DataFrame:
    visits = t.lineitem.where("l_returnflag = 'R'").select((F.col("l_orderkey") % 500 * 3).alias("chapter"), (F.col("l_partkey") % 90).alias("x"), (F.col("l_suppkey") % 70).alias("y"))
    return annotate.centroids(visits, t.lineitem.select((F.col("l_orderkey") % 1500).alias("chapter")))


@query("split_places", "SELECT DISTINCT p_brand AS chapter, left(trim(w), 20) AS place FROM (SELECT p_brand, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) WHERE trim(w) <> '' AND length(w) > 2")
def split_places(t: Tables) -> DataFrame:
    """Places of a chapter, lists taken apart, clamped, once each and without those that name nothing."""
    rows = t.part.select(F.col("p_brand").alias("chapter"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w"))
    return rows.where(F.char_length("w") > 2).select("chapter", nm.clamped(F.col("w")).alias("place")).where("place <> ''").distinct()


@query("disambiguated_places", f"WITH n AS (SELECT DISTINCT p_brand AS chapter, {_LIST}[p_partkey % {len(NAMES)} + 1] AS name FROM part), q AS (SELECT p_brand AS chapter, {_LIST}[p_partkey % {len(NAMES)} + 1] AS name, min(p_type) AS parent FROM part WHERE p_size > 20 GROUP BY 1, 2) SELECT n.chapter, n.name, CASE WHEN parent IS NOT NULL AND (n.name IN ('夹道', '角门', '后门', '正房', '书房', '花园', '皇宫', '山洞') OR (length(n.name) <= 2 AND length(translate(n.name, '{nm.ARCHITECTURE}', '')) = 0)) THEN parent || '·' || n.name ELSE n.name END AS new FROM n LEFT JOIN q ON q.chapter = n.chapter AND q.name = n.name")
def disambiguated_places(t: Tables) -> DataFrame:
    named = names(t).join(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chapter"), "p_type", "p_size"), "id")
    parents = named.where("p_size > 20").groupBy("chapter", "name").agg(F.min("p_type").alias("parent"))
    return annotate.disambiguated(named.select("chapter", "name").distinct(), nm.is_homonym_prone(F.col("name")), parents)


#: Characters and their directions, in order of precedence.
DIRECTIONS = (("东", "east"), ("西", "west"), ("南", "south"), ("北", "north"))
PLACES = (("东海", "east"), ("西方", ""), ("东方西山", "west"), ("南北湖", "south"), ("长安", ""), ("北京", "north"))


@query("direction_hints", f"SELECT p_partkey AS id, [{', '.join(repr(d) for _, d in PLACES)}][p_partkey % {len(PLACES)} + 1] AS hint FROM part")
def direction_hints(t: Tables) -> DataFrame:
    """Directions that names of places hint at, but for names such as 东方."""
    name = F.get(F.array(*(F.lit(n) for n, _ in PLACES)), (F.col("p_partkey") % len(PLACES)).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), F.coalesce(annotate.direction_hint(name, DIRECTIONS, "方"), F.lit("")).alias("hint"))


_PARAGRAPHS = "p AS (SELECT doc_id AS scene, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS text FROM documents)"


def paragraphs(t: Tables) -> DataFrame:
    """scene, order and text of each line of the documents."""
    return t.documents.select(F.col("doc_id").alias("scene"), F.posexplode(F.split("text", "\n")).alias("order", "text"))


#: Persons of a scene: what its language's small words stand in for.
_PERSONS = ("the", "und", "les", "que", "ing", "er")


@query(
    "scene_roles",
    f"""WITH {_PARAGRAPHS}, c AS (SELECT doc_id AS scene, unnest({list(_PERSONS)}) AS name FROM documents),
n AS (SELECT scene, name, text, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, name)) - 1 END AS n FROM c LEFT JOIN p USING (scene)),
g AS (SELECT scene, name, sum(n)::BIGINT AS mentions, count(*) FILTER (WHERE n > 0) AS p, count(*) FILTER (WHERE n > 0 AND left(text, 1) IN ('D', 'T')) AS d FROM n GROUP BY ALL),
r AS (SELECT scene, name, mentions, CASE WHEN p >= 3 OR d > 0 THEN 1 WHEN p >= 2 THEN 2 ELSE 3 END AS w FROM g)
SELECT scene, name, mentions, ['lead', 'supporting', 'mentioned'][w] AS role, row_number() OVER (PARTITION BY scene ORDER BY w, mentions DESC, name) AS place FROM r""",
)
def scene_roles(t: Tables) -> DataFrame:
    present = t.documents.select(F.col("doc_id").alias("scene"), F.explode(F.array(*map(F.lit, _PERSONS))).alias("name"))
    return scenes.character_roles(paragraphs(t), present, ("D", "T"), ("lead", "supporting", "mentioned"))


@query("key_dialogue", f"WITH {_PARAGRAPHS} SELECT scene, row_number() OVER w AS rank, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS line FROM p WHERE left(text, 1) IN ('D', 'T', 'É') AND length(text) >= 8 WINDOW w AS (PARTITION BY scene ORDER BY length(text) DESC, k) QUALIFY row_number() OVER w <= 2")
def key_dialogue(t: Tables) -> DataFrame:
    """The two longest lines of dialogue of each text, which begin with one of some letters here."""
    return scenes.key_dialogue(paragraphs(t), "scene", "order", "text", ("D", "T", "É"))


_TONES = (("battle", "[kx]h?[aeo]"), ("sad", "un|[mp]ort"), ("happy", "[jg]o[iy]|lich"), ("tense", "ough|eint"))


@query(
    "tones",
    f"WITH c AS (SELECT doc_id, {', '.join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in _TONES)} FROM documents) SELECT doc_id, CASE WHEN greatest(battle, sad, happy, tense) < 3 OR battle IS NULL THEN '平静' WHEN battle = greatest(battle, sad, happy, tense) THEN 'battle' WHEN sad = greatest(sad, happy, tense) THEN 'sad' WHEN happy >= tense THEN 'happy' ELSE 'tense' END AS tone FROM c",
)
def tones(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scenes.tone(F.col("text"), _TONES).alias("tone"))


@query("normalised_fields", "SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN p_type ELSE '' END AS kind FROM part")
def normalised_fields(t: Tables) -> DataFrame:
    """Fields under one of several names."""
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("category")))).when(k == 1, F.to_json(F.struct(F.col("p_name").alias("name")))).otherwise(F.to_json(F.struct(F.col("p_name").alias("label"))))
    rows = t.part.select(F.col("p_partkey").alias("id"), raw.alias("j"))
    return rows.select("id", annotate.first_field(F.col("j"), "name", "title", "label").alias("name"), F.coalesce(annotate.first_field(F.col("j"), "type", "category"), F.lit("")).alias("kind"))


@query("place_icons", "SELECT p_partkey AS id, CASE WHEN contains(p_type, 'STEEL') THEN 'city' WHEN contains(p_type, 'BRASS') THEN 'temple' WHEN contains(p_type, 'TIN') THEN 'mountain' ELSE 'generic' END AS icon, CASE WHEN contains(p_name, 'blue') THEN 'sky' WHEN contains(p_name, 'red') THEN 'underworld' ELSE 'overworld' END AS layer FROM part")
def place_icons(t: Tables) -> DataFrame:
    """Icons and layers by the first keyword of a table."""
    icon = annotate.first_keyword(F.col("p_type"), (("STEEL", "city"), ("BRASS", "temple"), ("TIN", "mountain")), "generic")
    layer = annotate.first_keyword(F.col("p_name"), (("blue", "sky"), ("red", "underworld")), "overworld")
    return t.part.select(F.col("p_partkey").alias("id"), icon.alias("icon"), layer.alias("layer"))


@query("map_scales", "WITH g AS (SELECT s_nationkey::BIGINT AS novel, min(s_suppkey % 6) AS tier, count(*) AS n FROM supplier GROUP BY 1) SELECT novel, CASE WHEN n < 3 THEN greatest(tier, 3) ELSE tier END AS scale FROM g")
def map_scales(t: Tables) -> DataFrame:
    """The scale of a map: its highest tier, but of a small one no more than a region."""
    g = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("novel")).agg(F.min(F.col("s_suppkey") % 6).alias("tier"), F.count("*").alias("n"))
    return g.select("novel", F.when(F.col("n") < 3, F.greatest("tier", F.lit(3))).otherwise(F.col("tier")).alias("scale"))


@query("unassigned_places", "SELECT DISTINCT l_partkey AS place FROM lineitem WHERE l_returnflag = 'N' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def unassigned_places(t: Tables) -> DataFrame:
    """Places of the overworld that no statement puts anywhere."""
    put = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("place"))
    known = t.part.where("p_size > 5").select(F.col("p_partkey").alias("place"))
    return t.lineitem.where("l_returnflag = 'N'").select(F.col("l_partkey").alias("place")).distinct().join(put, "place", "left_anti").join(known, "place", "left_semi")
