"""Chapter facts: schema, lenient parsing and exploded views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrays of a fact and the fields of their elements; a field is a string unless stated otherwise.
ARRAYS = {
    "characters": "name string, new_aliases array<string>, appearance string, locations_in_chapter array<string>",
    "relationships": "person_a string, person_b string, relation_type string, is_new boolean, previous_type string, evidence string",
    "locations": "name string, type string, parent string, peers array<string>, description string, role string",
    "spatial_relationships": "source string, target string, relation_type string, value string, confidence string, distance_class string, confidence_score double",
    "item_events": "item_name string, item_type string, action string, actor string, recipient string, description string",
    "org_events": "org_name string, org_type string, member string, role string, action string, description string",
    "events": "summary string, type string, importance string, participants array<string>, location string",
    "new_concepts": "name string, category string, definition string, related array<string>",
}
#: What an element takes where its field is missing or null.
DEFAULTS = {"relationships": {"is_new": True}, "events": {"importance": "medium"}, "spatial_relationships": {"confidence": "medium", "value": "", "distance_class": ""}, "org_events": {"action": "其他"}}


def elements(facts: DataFrame, json: str, array: str) -> DataFrame:
    """novel, chapter, pos and the fields of each element of an array of the facts' JSON.

    Elements are parsed one by one, so an element of the wrong shape is null fields and
    takes no other along. Missing arrays give no rows.
    """
    raw = F.from_json(F.get_json_object(json, f"$.{array}"), "array<string>")
    rows = facts.select("novel", "chapter", F.posexplode(raw).alias("pos", "raw"))
    parsed = rows.withColumn("e", F.from_json("raw", ", ".join(f"{f.strip().split(' ')[0]} {f.strip().split(' ', 1)[1]}" for f in _fields(ARRAYS[array]))))
    fill = DEFAULTS.get(array, {})
    names = [f.strip().split(" ")[0] for f in _fields(ARRAYS[array])]
    cols = [F.coalesce(F.col(f"e.{n}"), F.lit(fill[n])).alias(n) if n in fill else F.col(f"e.{n}").alias(n) for n in names]
    return parsed.select("novel", "chapter", "pos", *cols)


def _fields(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def abilities(facts: DataFrame, json: str) -> DataFrame:
    """novel, chapter, person, dimension and name of gained abilities; a plain string is a skill by that name."""
    raw = F.from_json(F.get_json_object(json, "$.characters"), "array<string>")
    rows = facts.select("novel", "chapter", F.posexplode(raw).alias("pos", "c"))
    own = F.from_json(F.get_json_object("c", "$.abilities_gained"), "array<string>")
    one = rows.select("novel", "chapter", F.get_json_object("c", "$.name").alias("person"), F.explode(own).alias("a"))
    object_ = F.startswith(F.trim("a"), F.lit("{"))
    name = F.when(object_, F.get_json_object("a", "$.name")).otherwise(F.col("a"))
    dimension = F.when(object_, F.coalesce(F.get_json_object("a", "$.dimension"), F.lit("技能"))).otherwise(F.lit("技能"))
    return one.select("novel", "chapter", "person", dimension.alias("dimension"), name.alias("name"))


def mentions(facts: DataFrame, json: str) -> DataFrame:
    """(novel, chapter, pos, kind, name) of all entities of all arrays."""
    parts = [("characters", "person", "name"), ("locations", "place", "name"), ("item_events", "item", "item_name"), ("org_events", "org", "org_name"), ("new_concepts", "concept", "name")]
    #  One pass: all arrays' elements in one list, each with its array.
    raw = lambda array: F.coalesce(F.from_json(F.get_json_object(json, f"$.{array}"), "array<string>"), F.array().cast("array<string>"))
    listed = lambda array, kind: F.transform(raw(array), lambda x, i: F.struct(i.alias("pos"), F.lit(kind).alias("kind"), x.alias("raw")))
    rows = facts.select("novel", "chapter", F.inline(F.concat(*(listed(array, kind) for array, kind, _ in parts))))
    name = F.coalesce(*(F.when(F.col("kind") == kind, F.from_json("raw", ARRAYS[array])[field]) for array, kind, field in parts))
    return rows.select("novel", "chapter", "pos", "kind", name.alias("name")).where("name <> ''")


def summary(fact: Column) -> Column:
    """One line of a fact's people, places and events."""
    names = lambda a, f: F.array_join(F.transform(F.from_json(F.get_json_object(fact, f"$.{a}"), f"array<struct<{f}:string>>"), lambda x: x[f]), ", ")
    return F.concat_ws(" | ", names("characters", "name"), names("locations", "name"), names("events", "summary"))
