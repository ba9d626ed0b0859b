"""Facts as JSON, exports and imports, numbers and name classes, over stand-in tables.

An order is a chapter whose lines are the elements of its fact; the JSON is made here, so
that the readers have something to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonrepair, numbers
from ..functions import names as nm
from ..functions import text as tx
from ..operators import facts as fa
from ..operators import profile, tree
from ..registry import Tables, query
from ..sources import facts, readers, writers
from .graphs import _PLACES, places

_LINES = "l AS (SELECT l_orderkey AS chapter, l_suppkey AS s, l_partkey AS p, l_linenumber AS n, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) - 1 AS pos FROM lineitem)"


def fact_json(t: Tables) -> DataFrame:
    """novel, chapter and fact (JSON) of each order; elements in the order of its lines."""
    order = ("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")

    def one(x: Column, k: str) -> Column:
        s, p, flag = F.concat(F.lit("s"), x["l_suppkey"].cast("string")), F.concat(F.lit("p"), x["l_partkey"].cast("string")), x["l_returnflag"]
        skill = F.when(x["l_linenumber"] % 2 == 0, F.to_json(F.struct(F.lit("武功").alias("dimension"), p.alias("name")))).otherwise(p)
        return {
            "r": F.struct(s.alias("person_a"), p.alias("person_b"), flag.alias("relation_type"), F.when(flag == "A", False).alias("is_new")),
            "c": F.struct(s.alias("name"), F.array(skill).alias("abilities_gained")),
            "l": F.struct(p.alias("name")),
            "e": F.struct(F.concat_ws(" ", s, flag).alias("summary"), F.when(flag == "R", "high").alias("importance")),
        }[k]

    #  Plain columns are shuffled, elements made of them afterwards.
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("chapter")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("xs"))
    part = lambda k: F.transform("xs", lambda x: one(x, k))
    doc = F.struct(part("r").alias("relationships"), part("c").alias("characters"), part("l").alias("locations"), part("e").alias("events"))
    return g.select(F.lit(1).alias("novel"), "chapter", F.to_json(doc).alias("fact"))


@query("fact_relations", f"WITH {_LINES} SELECT chapter, pos, 's' || s AS person_a, 'p' || p AS person_b, f AS relation_type, f <> 'A' AS is_new FROM l")
def fact_relations(t: Tables) -> DataFrame:
    """Relations out of the facts' JSON; what is not stated as old is new."""
    rows = facts.elements(fact_json(t), "fact", "relationships")
    return rows.select("chapter", F.col("pos").cast("long").alias("pos"), "person_a", "person_b", "relation_type", "is_new")


@query("fact_events", f"WITH {_LINES} SELECT chapter, pos, 's' || s || ' ' || f AS summary, CASE f WHEN 'R' THEN 'high' ELSE 'medium' END AS importance FROM l")
def fact_events(t: Tables) -> DataFrame:
    rows = facts.elements(fact_json(t), "fact", "events")
    return rows.select("chapter", F.col("pos").cast("long").alias("pos"), "summary", "importance")


@query("fact_mentions", f"WITH {_LINES} SELECT chapter, kind, name, count(*) AS n FROM (SELECT chapter, 'person' AS kind, 's' || s AS name FROM l UNION ALL SELECT chapter, 'place', 'p' || p FROM l) GROUP BY ALL")
def fact_mentions(t: Tables) -> DataFrame:
    """Entities of all arrays of the facts' JSON."""
    return facts.mentions(fact_json(t), "fact").groupBy("chapter", "kind", "name").agg(F.count("*").alias("n"))


@query("fact_abilities", f"WITH {_LINES} SELECT chapter, 's' || s AS person, CASE WHEN n % 2 = 0 THEN '武功' ELSE '技能' END AS dimension, 'p' || p AS name FROM l")
def fact_abilities(t: Tables) -> DataFrame:
    """Abilities that are objects or plain strings, which are skills."""
    return facts.abilities(fact_json(t), "fact").select("chapter", "person", "dimension", "name")


@query("fact_summaries", f"WITH {_LINES} SELECT chapter, string_agg('s' || s, ', ' ORDER BY pos) || ' | ' || string_agg('p' || p, ', ' ORDER BY pos) || ' | ' || string_agg('s' || s || ' ' || f, ', ' ORDER BY pos) AS summary FROM l GROUP BY chapter")
def fact_summaries(t: Tables) -> DataFrame:
    return fact_json(t).select("chapter", facts.summary(F.col("fact")).alias("summary"))


@query("repaired_json", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{\"a\": \"' || p_name || '\", \"b\": 1}' WHEN 1 THEN '{\"a\": \"' || p_name || '\"}' WHEN 2 THEN '{\"a\": [1, 2]}' WHEN 3 THEN '{\"a\": \"' || p_name || '\"}' ELSE '' END AS json FROM part")
def repaired_json(t: Tables) -> DataFrame:
    """Objects whole, inside a fence, with open brackets, cut off inside a string, and none at all."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    raw = (
        F.when(k == 0, F.concat(F.lit('Here: {"a": "'), name, F.lit('", "b": 1} done')))
        .when(k == 1, F.concat(F.lit('```json\n{"a": "'), name, F.lit('"}\n```')))
        .when(k == 2, F.lit('{"a": [1, 2'))
        .when(k == 3, F.concat(F.lit('{"a": "'), name))
        .otherwise(F.lit("no object"))
    )
    return t.part.select(F.col("p_partkey").alias("id"), F.coalesce(jsonrepair.extract_json(raw), F.lit("")).alias("json"))


@query("thoughts_removed", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'answer ' || turn WHEN 1 THEN 'begin' ELSE 'a' || turn END AS answer FROM conversations")
def thoughts_removed(t: Tables) -> DataFrame:
    n = F.col("turn").cast("string")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>\n answer "), n)).when(F.col("turn") % 3 == 1, F.concat(F.lit("begin <think>"), "text")).otherwise(F.concat(F.lit("a"), n))
    return t.conversations.select("conv_id", "turn", tx.thinking_removed(F.coalesce(raw, F.lit(""))).alias("answer"))


@query("cited_chapters", "SELECT p_partkey AS id, CASE WHEN p_size % 30 = p_size % 7 THEN (p_size % 30)::VARCHAR WHEN p_size % 30 < p_size % 7 THEN (p_size % 30) || ',' || (p_size % 7) ELSE (p_size % 7) || ',' || (p_size % 30) END AS chapters FROM part")
def cited_chapters(t: Tables) -> DataFrame:
    """Chapters that an answer names, once each and in order."""
    a, b = (F.col("p_size") % 30).cast("string"), (F.col("p_size") % 7).cast("string")
    answer = F.concat(F.lit("见第"), a, F.lit("章，第 "), b, F.lit(" 章，第"), a, F.lit("章"))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(F.transform(tx.cited_chapters(answer), lambda x: x.cast("string")), ",").alias("chapters"))


#: Numbers and distances in words with their values (-1 where there is none).
NUMBERS = (("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("一百零五", 105), ("两千三百", 2300), ("九千九百九十九", 9999), ("42", 42), ("无", None))
DISTANCES = (("三日", 120.0), ("十二里", 6.0), ("5公里", 5.0), ("很远", 200.0), ("附近", 5.0), ("一百天", 400.0), ("不知", None))


def _case(column: str, table: tuple[tuple[str, object], ...]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {-1 if v is None else v}" for i, (_, v) in enumerate(table)) + " END"


def _pick(column: Column, table: tuple[tuple[str, object], ...]) -> Column:
    return F.get(F.array(*(F.lit(x) for x, _ in table)), column.cast("int"))


@query("numbers_in_words", f"SELECT p_partkey AS id, {_case(f'(p_partkey % {len(NUMBERS)})', NUMBERS)}::BIGINT AS value, {_case(f'(p_partkey % {len(DISTANCES)})', DISTANCES)}::DOUBLE AS km FROM part")
def numbers_in_words(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    number, distance = _pick(k % len(NUMBERS), NUMBERS), _pick(k % len(DISTANCES), DISTANCES)
    return t.part.select(k.alias("id"), F.coalesce(numbers.chinese_number(number), F.lit(-1)).cast("long").alias("value"), F.coalesce(numbers.distance_km(distance), F.lit(-1)).cast("double").alias("km"))


#: Names with what the rules say: place type, rank, generic place, generic person, alias safety, nickname, all Chinese.
CLASSED = (
    ("大唐国", "kingdom", 1, "", "", 2, False, True),
    ("并州", "region", 2, "", "", 2, False, True),
    ("少林寺", "building", 5, "", "", 2, False, True),
    ("一座山", "site", 4, "quantity", "", 2, False, True),
    ("东边", "", 0, "direction", "", 2, False, True),
    ("王氏", "", 0, "", "surname_only", 2, False, True),
    ("众人", "", 0, "", "listed", 0, False, True),
    ("李老爷", "", 0, "", "", 1, True, True),
    ("小红", "", 0, "", "", 2, True, True),
    ("那边的小房子外面", "", 0, "too_long", "phrase", 1, False, True),
    ("abc", "", 0, "", "", 2, False, False),
)


@query("name_classes", "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {r}, '{g}', '{q}', {a}, {n}, {c})" for i, (_, t, r, g, q, a, n, c) in enumerate(CLASSED)) + f") AS v(k, place_type, rank, place, person, safety, nickname, chinese)) SELECT p_partkey AS id, place_type, rank::BIGINT AS rank, place, person, safety::BIGINT AS safety, nickname, chinese FROM part JOIN c ON k = p_partkey % {len(CLASSED)}")
def name_classes(t: Tables) -> DataFrame:
    name = F.get(F.array(*(F.lit(c[0]) for c in CLASSED)), (F.col("p_partkey") % len(CLASSED)).cast("int"))
    n = F.col("name")
    return t.part.select(F.col("p_partkey").alias("id"), name.alias("name")).select(
        "id",
        F.coalesce(nm.suffix_of(n, 1), F.lit("")).alias("place_type"),
        F.coalesce(nm.suffix_of(n, 2), F.lit(0)).cast("long").alias("rank"),
        F.coalesce(nm.is_generic_place(n), F.lit("")).alias("place"),
        F.coalesce(nm.is_generic_person(n), F.lit("")).alias("person"),
        nm.alias_safety(n).cast("long").alias("safety"),
        nm.is_nickname(n).alias("nickname"),
        nm.only_cjk(n).alias("chinese"),
    )


@query("relation_classes", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'parent' WHEN 1 THEN 'enemy' WHEN 2 THEN 'friend' ELSE 'xyz' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'family' WHEN 1 THEN 'hostile' WHEN 2 THEN 'social' ELSE 'other' END AS class FROM part")
def relation_classes(t: Tables) -> DataFrame:
    raw = F.get(F.array(*(F.lit(x) for x in ("Father", "his enemy", " friend ", "xyz"))), (F.col("p_partkey") % 4).cast("int"))
    kind = nm.relation_type(raw)
    return t.part.select(F.col("p_partkey").alias("id"), kind.alias("kind"), nm.relation_class(kind).alias("class"))


@query("exported_novels", "SELECT n_nationkey::BIGINT AS novel, count(s_suppkey) AS suppliers, coalesce(sum(s_suppkey), 0)::BIGINT AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def exported_novels(t: Tables) -> DataFrame:
    """What an export of all novels says, read back from its JSON."""
    novels = t.nation.select(F.col("n_nationkey").cast("long").alias("novel"), F.col("n_name").alias("title"))
    suppliers = t.supplier.select(F.col("s_nationkey").cast("long").alias("novel"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    docs = writers.exported(novels, "novel", suppliers=suppliers)
    back = writers.imported(docs, "doc", "suppliers", "id long, name string", "novel").groupBy("novel").agg(F.sum("id").alias("total"))
    counts = writers.import_counts(docs, "doc", "novel", "suppliers")
    return counts.join(back, "novel", "left").select("novel", F.col("suppliers").cast("long").alias("suppliers"), F.coalesce("total", F.lit(0)).alias("total"))


@query("markdown_sections", "SELECT s_nationkey::BIGINT AS novel, string_agg('## ' || s_name || chr(10) || chr(10) || 'a' || chr(92) || '|' || s_suppkey, chr(10) || chr(10) ORDER BY s_suppkey) AS markdown FROM supplier GROUP BY 1")
def markdown_sections(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_nationkey").cast("long").alias("novel"), "s_suppkey", "s_name", F.concat(F.lit("a|"), F.col("s_suppkey").cast("string")).alias("body"))
    return writers.markdown(rows, "novel", "s_suppkey", "s_name", "body")


@query("gazetteer_matches", "WITH n AS (SELECT p_name AS name, p_partkey AS id, p_size AS population, p_brand AS code FROM part UNION SELECT p_type, p_partkey, p_size, p_brand FROM part) SELECT name, arg_min(id, (CASE WHEN code LIKE '%1' THEN 0 ELSE 1 END) * 1000000000000 - population * 1000000 + id) AS id FROM n GROUP BY name")
def gazetteer_matches(t: Tables) -> DataFrame:
    """Each name's best entry by feature, inhabitants and id, main and alternate names alike."""
    code = F.when(F.col("p_brand").like("%1"), "PPLC").otherwise("PPL")
    entries = t.part.select(F.col("p_partkey").alias("geonameid"), F.col("p_name").alias("name"), F.col("p_type").alias("alternatenames"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"), F.col("p_size").cast("long").alias("population"), code.alias("feature_code"))
    lookup = readers.gazetteer_names(entries)
    return readers.resolved_names(lookup.select(F.col("lookup").alias("name")), lookup, {"PPLC": 0, "PPL": 1}).select("name", F.col("geonameid").alias("id"))


@query("resolved_mentions", "SELECT l_orderkey AS chapter, coalesce(s_nationkey::BIGINT, l_suppkey) AS person, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 2 = 0 GROUP BY ALL")
def resolved_mentions(t: Tables) -> DataFrame:
    alias = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("alias"), F.col("s_nationkey").cast("long").alias("canonical"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("chapter"), F.col("l_suppkey").alias("person"))
    return profile.resolved(rows, "person", alias).groupBy("chapter", "person").agg(F.count("*").alias("n"))


@query("new_books", "SELECT md5(text) AS file_hash, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def new_books(t: Tables) -> DataFrame:
    """Files whose text is not known yet, once each."""
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("file_hash"), "text")
    found = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.lit("").alias("title"), F.lit("").alias("author"), "file_hash", "text")
    return readers.new_books(found, d.where("doc_id % 2 = 0")).select("file_hash", F.col("path").cast("long").alias("doc_id"))


@query("cycle_edges", f"WITH {_PLACES}, x AS (SELECT child, parent FROM p UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1) % 3 FROM region WHERE r_regionkey < 3) SELECT child, parent FROM x WHERE child IN ('r0', 'r1', 'r2')")
def cycle_edges(t: Tables) -> DataFrame:
    """Edges on cycles, after three regions were made to lie in each other."""
    ring = t.region.where("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 3).cast("string")).alias("parent"))
    return tree.on_cycles(places(t).union(ring))


@query("keyword_chapters", "SELECT word, doc_id FROM (SELECT DISTINCT word, doc_id FROM documents JOIN (VALUES ('the'), ('und'), ('que')) AS v(word) ON contains(lower(text), word)) QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id) <= 5")
def keyword_chapters(t: Tables) -> DataFrame:
    """The first five chapters that hold each of up to three keywords."""
    words = F.array(*(F.lit(w) for w in ("the", "und", "que")))
    hit = t.documents.select("doc_id", F.explode(F.filter(words, lambda w: F.contains(F.lower("text"), w))).alias("word"))
    return fa.scenes_of(hit.select(F.col("word").alias("entity"), F.col("doc_id").alias("scene"), F.lit("word").alias("role")), ("word",), 5).select(F.col("entity").alias("word"), F.col("scene").alias("doc_id"))
