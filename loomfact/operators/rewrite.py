"""Validation of whole chapter facts as one chain of passes over nested arrays.

A row is a chapter: characters, relationships, locations, spatial, events as arrays of
structs. Each pass is a projection over the row's own arrays, so the chain has no shuffle
and no join, whatever the number of chapters; work within a row is bounded by its cast.
What renames something makes one map for the chapter, which a single projection applies to
every place that refers to the name.

Predicates and word lists are arguments of :class:`Checks`. Null arrays count as empty;
null fields of names as empty names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARACTER = "struct<name:string,aliases:array<string>,appearance:string,places:array<string>>"
RELATION = "struct<person_a:string,person_b:string,relation_type:string>"
LOCATION = "struct<name:string,type:string,parent:string,role:string>"
SPATIAL = "struct<source:string,target:string,relation_type:string>"
EVENT = "struct<summary:string,type:string,importance:string,participants:array<string>,location:string>"
ARRAYS = {"characters": CHARACTER, "relationships": RELATION, "locations": LOCATION, "spatial": SPATIAL, "events": EVENT}

#: Letters behind a person's name that make it the name of a place.
PLACE_LETTERS = "国省市县镇村区域界地洲岛山河湖海洋城池寺庙观殿阁楼台塔"
#: Most letters of a name and of an alias.
NAME_LENGTH, ALIAS_LENGTH = 20, 6


@dataclass(frozen=True)
class Checks:
    """Rules over single names and values."""

    clamp: Callable[[Column], Column] = lambda c: F.substring(F.trim(c), 1, NAME_LENGTH)
    corrections: dict[str, str] = field(default_factory=dict)
    no_person: Callable[[Column], Column] = lambda c: F.lit(False)
    #: Persons of general names that are kept, and named after the chapter's setting.
    general: tuple[str, ...] = ()
    no_place: Callable[[Column], Column] = lambda c: F.lit(False)
    #: Places whose names many buildings share.
    shared: Callable[[Column], Column] = lambda c: F.lit(False)
    spatial_kinds: tuple[str, ...] = ("contains", "adjacent", "direction", "distance", "in_between", "separated_by", "terrain", "cluster")
    event_types: tuple[tuple[str, ...], str] = ((), "")
    importance: tuple[tuple[str, ...], str] = (("high", "medium", "low"), "medium")
    place_type: Callable[[Column], Column] = lambda c: F.lit("")


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _names(array: str, *fields: str) -> Column:
    """All values of some fields (strings or arrays of strings) of an array's elements."""
    return F.array_distinct(F.concat(*(_field(array, f) for f in fields)))


def _field(array: str, name: str) -> Column:
    own = F.transform(array, lambda x: x[name])
    return F.flatten(own) if name in ("aliases", "places", "participants") else own


def _person(name: Column) -> Column:
    return F.struct(name.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("appearance"), F.array().cast("array<string>").alias("places")).cast(CHARACTER)


def _merged(characters: Column | str, name_of: Callable[[Column], Column], more: Callable[[Column, Column], Column] | None = None, plain: Column | None = None) -> Column:
    """One element for each name (by ``name_of`` an element), in order: fields of equal names united, the first appearance.

    Most chapters have no two equal names; their elements are taken as they are, without a search for each name.
    (``plain`` tells that ``name_of`` is each element's own name, if it is not always.)
    """

    def one(name: Column) -> Column:
        own = F.filter(characters, lambda c: name_of(c) == name)
        aliases = F.array_distinct(F.flatten(F.transform(own, lambda c: c["aliases"])))
        aliases = more(aliases, F.filter(F.transform(own, lambda c: c["name"]), lambda n: n != name)) if more else aliases
        looks = F.filter(F.transform(own, lambda c: c["appearance"]), lambda a: a != "")
        return F.struct(name.alias("name"), F.filter(aliases, lambda a: a != name).alias("aliases") if more else aliases.alias("aliases"), F.coalesce(F.get(looks, F.lit(0)), F.lit("")).alias("appearance"), F.array_distinct(F.flatten(F.transform(own, lambda c: c["places"]))).alias("places")).cast(CHARACTER)

    def alone(c: Column) -> Column:
        aliases = F.array_distinct(c["aliases"])
        return F.struct(c["name"].alias("name"), F.filter(aliases, lambda a: a != c["name"]).alias("aliases") if more else aliases.alias("aliases"), c["appearance"].alias("appearance"), F.array_distinct(c["places"]).alias("places")).cast(CHARACTER)

    names = F.transform(characters, name_of)
    once = (F.size(F.array_distinct(names)) == F.size(names)) & (F.lit(True) if plain is None else plain)
    return F.when(once, F.transform(characters, alone)).otherwise(F.transform(F.array_distinct(names), one))


def _map() -> Column:
    return F.create_map().cast("map<string,string>")


def _get(m: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), key)


def filled(facts: DataFrame) -> DataFrame:
    """Arrays without nulls in names, lists and the array itself."""

    def whole(x: Column, kind: str) -> Column:
        fields = [f.split(":", 1) for f in kind[7:-1].replace("array<string>", "array").split(",")]
        own = [(F.coalesce(x[n], F.array().cast("array<string>")) if t == "array" else _text(x[n]) if n not in ("parent", "role") else x[n]).alias(n) for n, t in fields]
        return F.struct(*own).cast(kind)

    def of(array: str, kind: str) -> Column:
        return F.coalesce(F.transform(F.filter(array, lambda x: x.isNotNull()), lambda x: whole(x, kind)), _empty(kind))

    return facts.withColumns({a: of(a, k) for a, k in ARRAYS.items()})


def _characters(checks: Checks) -> list[Callable[[DataFrame], DataFrame]]:
    corrections = F.create_map(*(F.lit(x) for kv in checks.corrections.items() for x in kv)).cast("map<string,string>") if checks.corrections else _map()

    def named(d: DataFrame) -> DataFrame:
        """Names clamped and corrected; empty and general ones go; equal ones become one."""
        clean = F.transform("characters", lambda c: c.withField("name", _get(corrections, checks.clamp(c["name"]))))
        kept = F.filter(clean, lambda c: (c["name"] != "") & (c["name"].isin(*checks.general) | ~F.coalesce(checks.no_person(c["name"]), F.lit(False))))
        return d.withColumn("characters", kept).withColumn("characters", _merged("characters", lambda c: c["name"]))

    def aliased(d: DataFrame) -> DataFrame:
        """A character that another one lists as an alias goes into that one; links are taken in order, and followed."""
        names = F.transform("characters", lambda c: c["name"])
        pairs = F.flatten(F.transform("characters", lambda c: F.transform(F.filter(c["aliases"], lambda a: F.array_contains(names, a) & (a != c["name"])), lambda a: F.struct(a.alias("from"), c["name"].alias("to")))))
        free = lambda kept, p: ~F.exists(kept, lambda k: (k["from"] == p["from"]) | (k["from"] == p["to"]))
        d = d.withColumn("__p", pairs).withColumn("__p", F.aggregate("__p", F.slice("__p", 1, 0), lambda kept, p: F.when(free(kept, p), F.concat(kept, F.array(p))).otherwise(kept)))
        #  Later links first, so that an earlier one ends where its keeper went.
        ends = F.aggregate(F.reverse("__p"), _map(), lambda m, p: F.map_concat(m, F.create_map(p["from"], _get(m, p["to"]))))
        d = d.withColumn("__m", ends)
        #  Keepers come first in their groups, so their own fields lead.
        by = F.concat(F.filter("characters", lambda c: F.try_element_at(F.col("__m"), c["name"]).isNull()), F.filter("characters", lambda c: F.try_element_at(F.col("__m"), c["name"]).isNotNull()))
        no_link = F.size("__p") == 0
        d = d.withColumn("characters", F.when(no_link, F.col("characters")).otherwise(by))
        d = d.withColumn("characters", _merged("characters", lambda c: _get(F.col("__m"), c["name"]), lambda aliases, gone: F.array_distinct(F.concat(aliases, gone)), no_link))
        return d.drop("__p", "__m")

    def clean(d: DataFrame) -> DataFrame:
        """Aliases that are or hold another character's name, or are too long, go."""
        names = F.transform("characters", lambda c: c["name"])

        def fits(a: Column, owner: Column) -> Column:
            other = F.exists(names, lambda n: (n != owner) & ((n == a) | ((F.char_length(n) >= 2) & F.contains(a, n))))
            return (a != "") & (F.char_length(a) <= ALIAS_LENGTH) & ~other

        return d.withColumn("characters", F.transform("characters", lambda c: c.withField("aliases", F.filter(c["aliases"], lambda a: fits(a, c["name"])))))

    return [named, aliased, clean]


def _others(checks: Checks) -> list[Callable[[DataFrame], DataFrame]]:
    def relationships(d: DataFrame) -> DataFrame:
        """Relations of two different characters, known by name or alias."""
        known = _names("characters", "name", "aliases")
        clean = F.transform("relationships", lambda r: r.withField("person_a", F.trim(r["person_a"])).withField("person_b", F.trim(r["person_b"])))
        return d.withColumn("__k", known).withColumn("relationships", F.filter(clean, lambda r: (r["person_a"] != r["person_b"]) & F.array_contains("__k", r["person_a"]) & F.array_contains("__k", r["person_b"]))).drop("__k")

    def locations(d: DataFrame) -> DataFrame:
        """Names clamped; empty ones, such as name no place and repeats go; a place does not lie in itself."""
        clean = F.transform("locations", lambda x: x.withField("name", checks.clamp(x["name"])).withField("parent", F.nullif(checks.clamp(_text(x["parent"])), F.lit(""))))
        clean = F.transform(clean, lambda x: x.withField("parent", F.when(x["parent"] != x["name"], x["parent"])))
        kept = F.filter(clean, lambda x: (x["name"] != "") & ~F.coalesce(checks.no_place(x["name"]), F.lit(False)))
        d = d.withColumn("locations", kept)
        first = F.filter("locations", lambda x, i: F.array_position(F.transform("locations", lambda y: y["name"]), x["name"]) == i + 1)
        return d.withColumn("locations", first)

    def spatial(d: DataFrame) -> DataFrame:
        """Relations of known kinds between two different places of the chapter, once each."""
        known = _names("locations", "name")
        clean = F.transform("spatial", lambda s: s.withField("source", checks.clamp(s["source"])).withField("target", checks.clamp(s["target"])))
        kept = F.filter(clean, lambda s: s["relation_type"].isin(*checks.spatial_kinds) & (s["source"] != s["target"]) & F.array_contains("__k", s["source"]) & F.array_contains("__k", s["target"]))
        return d.withColumn("__k", known).withColumn("spatial", F.array_distinct(kept)).drop("__k")

    def events(d: DataFrame) -> DataFrame:
        """Events with a summary, the first of equal ones; values outside their lists become the default."""
        held = lambda c, allowed: F.when(c.isin(*allowed[0]), c).otherwise(allowed[1]) if allowed[0] else c
        clean = F.transform("events", lambda e: e.withField("summary", F.trim(e["summary"])).withField("type", held(e["type"], checks.event_types)).withField("importance", held(e["importance"], checks.importance)))
        d = d.withColumn("events", F.filter(clean, lambda e: e["summary"] != ""))
        return d.withColumn("events", F.filter("events", lambda e, i: F.array_position(F.transform("events", lambda y: y["summary"]), e["summary"]) == i + 1))

    def parents(d: DataFrame) -> DataFrame:
        """Parents that places name become places themselves."""
        lost = F.array_except(F.filter(F.transform("locations", lambda x: x["parent"]), lambda p: p.isNotNull()), _names("locations", "name"))
        more = F.transform(lost, lambda n: F.struct(n.alias("name"), checks.place_type(n).alias("type"), F.lit(None).cast("string").alias("parent"), F.lit("referenced").alias("role")).cast(LOCATION))
        return d.withColumn("locations", F.concat("locations", more))

    def persons(d: DataFrame) -> DataFrame:
        """Characters that are places of the chapter go."""
        return d.withColumn("__k", _names("locations", "name")).withColumn("characters", F.filter("characters", lambda c: ~F.array_contains("__k", c["name"]))).drop("__k")

    def participants(d: DataFrame) -> DataFrame:
        """Events without participants take the names and aliases that their summary holds, longer ones first, places' names not."""
        sized = lambda names: F.transform(F.sort_array(F.transform(names, lambda n: F.struct((-F.char_length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])
        behind = lambda text, n: F.substring(text, F.instr(text, n) + F.char_length(n), F.lit(1))
        named = lambda text: F.filter("__k", lambda n: F.contains(text, n) & ~behind(text, n).rlike(f"[{PLACE_LETTERS}]"))
        known = F.filter(_names("characters", "name", "aliases"), lambda n: n != "")
        return d.withColumn("__k", sized(known)).withColumn("events", F.transform("events", lambda e: e.withField("participants", F.when(F.size(e["participants"]) == 0, named(e["summary"])).otherwise(e["participants"])))).drop("__k")

    def places_of_events(d: DataFrame) -> DataFrame:
        """Events without a place take the longest that their summary names."""
        sized = F.transform(F.sort_array(F.transform(_names("locations", "name"), lambda n: F.struct((-F.char_length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])
        first = lambda text: F.coalesce(F.get(F.filter("__k", lambda n: F.contains(text, n)), F.lit(0)), F.lit(""))
        return d.withColumn("__k", sized).withColumn("events", F.transform("events", lambda e: e.withField("location", F.when(e["location"] == "", first(e["summary"])).otherwise(e["location"])))).drop("__k")

    def missing(source: str, *fields: str) -> Callable[[DataFrame], DataFrame]:
        def add(d: DataFrame) -> DataFrame:
            """Persons that something refers to and no character is named after become characters; names of places do not."""
            lost = F.array_except(F.filter(_names(source, *fields), lambda n: n != ""), F.array_union(_names("characters", "name", "aliases"), _names("locations", "name")))
            return d.withColumn("characters", F.concat("characters", F.transform(lost, _person)))

        return add

    return [relationships, locations, spatial, events, parents, persons, participants, places_of_events, missing("events", "participants"), missing("relationships", "person_a", "person_b")]


def renamed_places(d: DataFrame, renames: Column) -> DataFrame:
    """The chapter with its places renamed by a map, in all that refers to them."""
    d = d.withColumn("__m", renames)
    m = F.col("__m")
    return d.withColumns({
        "locations": F.transform("locations", lambda x: x.withField("name", _get(m, x["name"])).withField("parent", F.when(x["parent"].isNotNull(), _get(m, x["parent"])))),
        "characters": F.transform("characters", lambda c: c.withField("places", F.transform(c["places"], lambda p: _get(m, p)))),
        "events": F.transform("events", lambda e: e.withField("location", _get(m, e["location"]))),
        "spatial": F.transform("spatial", lambda s: s.withField("source", _get(m, s["source"])).withField("target", _get(m, s["target"]))),
    }).drop("__m")


def renamed_persons(d: DataFrame, renames: Column) -> DataFrame:
    """The chapter with its persons renamed by a map, in all that refers to them."""
    d = d.withColumn("__m", renames)
    m = F.col("__m")
    return d.withColumns({
        "characters": F.transform("characters", lambda c: c.withField("name", _get(m, c["name"]))),
        "relationships": F.transform("relationships", lambda r: r.withField("person_a", _get(m, r["person_a"])).withField("person_b", _get(m, r["person_b"]))),
        "events": F.transform("events", lambda e: e.withField("participants", F.transform(e["participants"], lambda p: _get(m, p)))),
    }).drop("__m")


def shared_place_names(checks: Checks) -> Column:
    """Map of the chapter's places of shared names to the names with their parents in front."""
    own = F.filter("locations", lambda x: x["parent"].isNotNull() & F.coalesce(checks.shared(x["name"]), F.lit(False)))
    return F.map_from_entries(F.transform(own, lambda x: F.struct(x["name"], F.concat_ws("·", x["parent"], x["name"]))))


def general_person_names(checks: Checks) -> Column:
    """Map of the chapter's persons of general names to the names with its setting in front: a setting, else a place with a parent, else the first."""
    first = lambda test: F.get(F.transform(F.filter("locations", test), lambda x: x["name"]), F.lit(0))
    setting = F.coalesce(first(lambda x: x["role"] == "setting"), first(lambda x: x["parent"].isNotNull()), first(lambda x: F.lit(True)))
    own = F.filter("characters", lambda c: c["name"].isin(*checks.general) & setting.isNotNull())
    return F.map_from_entries(F.transform(own, lambda c: F.struct(c["name"], F.concat_ws("·", setting, c["name"]))))


def validated(facts: DataFrame, checks: Checks) -> DataFrame:
    """The chapters after all passes, in order; other columns stay as they are."""
    out = filled(facts)
    for step in (*_characters(checks), *_others(checks)):
        out = step(out)
    out = renamed_places(out, shared_place_names(checks))
    return renamed_persons(out, general_person_names(checks))
