"""All names in all texts: an Aho-Corasick automaton in one pass over each text.

The automaton of all names goes to every worker and finds every occurrence of every name,
of several words or inside others, whatever their number. Names are dealt into shards of a
bounded size by a hash, counted beforehand; there is one pass over the texts for each
shard (one, for up to some hundred thousand names), so no automaton outgrows a worker and
texts are never shuffled. Names are compared as they are, letter by letter.

Null and empty names are passed over; a null text holds no name.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: Bytes of the names of one automaton, and found rows of a batch.
SHARD_BYTES = 8 << 20
BATCH = 1 << 16


@lru_cache(maxsize=2)
def _automaton(token: str, names: Broadcast) -> Any:
    """One automaton for each worker and shard."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for n in names.value:
        out.add_word(n, n)
    out.make_automaton()
    return out


def _shards(names: DataFrame) -> list[list[str]]:
    """The distinct names in lists of bounded bytes."""
    own = names.select(F.col("name").cast("string").alias("name")).where("name <> ''").distinct()
    size = own.agg(F.sum(F.octet_length("name") + 64)).first()[0]
    if not size:
        return []
    n = -(-size // SHARD_BYTES)
    shard = F.pmod(F.xxhash64("name"), F.lit(n))
    lists = ([r[0] for r in own.where(shard == k).collect()] for k in range(n))  # at most about SHARD_BYTES each
    return [names for names in lists if names]


def _scan(docs: DataFrame, key: str, text: str, names: DataFrame, places: bool) -> DataFrame:
    """key, name and, with ``places``, at (from 0) of all occurrences, else each name of a text once."""
    spark = docs.sparkSession
    base = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    fields = [base.schema[key]]
    schema = StructType(fields).add("name", "string")
    schema = schema.add("at", "long") if places else schema
    out = spark.createDataFrame([], schema)
    for shard in _shards(names):
        token, held = uuid.uuid4().hex, spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], token: str = token, held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            found = _automaton(token, held)

            def made(b: pa.RecordBatch, rows: list[int], hits: list[str], at: list[int]) -> pa.RecordBatch:
                cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())]
                return pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.int64())] if places else cols, names=schema.names)

            for b in batches:
                rows, hits, at = [], [], []
                for i in range(b.num_rows):
                    t = b.column(1)[i].as_py()
                    if not t:
                        continue
                    if places:
                        for end, name in found.iter(t):
                            rows.append(i), hits.append(name), at.append(end - len(name) + 1)
                    else:
                        once = {name for _, name in found.iter(t)}
                        hits += once
                        rows += [i] * len(once)
                    if len(rows) > BATCH:
                        yield made(b, rows, hits, at)
                        rows, hits, at = [], [], []
                yield made(b, rows, hits, at)

        out = out.unionByName(base.mapInArrow(run, schema))
    return out


def occurrences(names: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, name and at (from 0) of every occurrence of every name, overlapping ones too."""
    return _scan(docs, key, text, names, True)


def contained(names: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and name of all names that occur anywhere in a text, once for each row of ``docs``."""
    return _scan(docs, key, text, names, False)


def _tops(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, __text and __top of each text: places (from 0) of names in order and the longest one's end at each, as pairs of 32 bits.

    There is one pass for each shard of names, in which a row's places are merged with those that it brings: nothing is shuffled.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(key), F.col(text).cast("string").alias("__text"), F.lit(b"").alias("__top"))
    for shard in _shards(names):
        token, held = uuid.uuid4().hex, spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], token: str = token, held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            found = _automaton(token, held)
            for b in batches:
                tops = []
                for t, before in zip(b.column(1), b.column(2), strict=True):
                    #  Ends come in order, so the last name from a place is its longest.
                    ends = {end - len(name) + 1: end + 1 for end, name in found.iter(t.as_py() or "")}
                    for at, end in np.frombuffer(before.as_py(), np.int32).reshape(-1, 2).tolist():
                        ends[at] = max(end, ends.get(at, 0))
                    tops.append(np.array(sorted(ends.items()), np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tops, pa.binary())], names=b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def _kept(top: bytes) -> Iterator[tuple[int, int]]:
    """Place and end of the names that do not overlap, from the left."""
    last = 0
    for at, end in np.frombuffer(top, np.int32).reshape(-1, 2).tolist():
        if at >= last:
            last = end
            yield at, end


def longest(names: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, name and at of occurrences that do not overlap: from the left, the longest name at each place.

    All is found within a row, so nothing is shuffled, and keys need not be unique.
    """
    found = _tops(docs, key, text, names)
    schema = StructType([found.schema[key]]).add("name", "string").add("at", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (t, top) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                t, kept = t.as_py(), list(_kept(top.as_py()))
                for k in range(0, len(kept), BATCH):
                    part = kept[k : k + BATCH]
                    own = b.column(0).take(pa.array([i] * len(part), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, pa.array([t[x:y] for x, y in part], pa.string()), pa.array([x for x, _ in part], pa.int64())], names=schema.names)

    return found.mapInArrow(run, schema)


def longest_counts(names: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, name and n, how often each name stands in the key's texts as in :func:`longest`.

    They are counted within a row; what is shuffled is one row for each text, its names in an array.
    """
    found = _tops(docs, key, text, names)
    schema = StructType([found.schema[key]]).add("name", ArrayType(StringType())).add("n", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, n = [], []
            for t, top in zip(b.column(1), b.column(2), strict=True):
                t = t.as_py()
                own = Counter(t[x:y] for x, y in _kept(top.as_py()))
                names.append(list(own)), n.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.list_(pa.string())), pa.array(n, pa.list_(pa.int64()))], names=schema.names)

    rows = found.mapInArrow(run, schema).where(F.size("name") > 0).repartition(key)
    each = rows.select(key, F.explode(F.arrays_zip("name", "n")).alias("x")).select(key, "x.name", "x.n")
    return each.groupBy(key, "name").agg(F.sum("n").alias("n"))


def ungrounded(entities: DataFrame, docs: DataFrame, text: str, novel: str | None = None, least: int = 2) -> DataFrame:
    """Names of entities (name, alias; one row for each form) of which no form occurs in their novel's texts.

    Only forms of ``least`` letters and more are looked for; entities without such a form
    stay, as nothing can be told of them. With ``novel`` both tables have that column, and
    an entity is looked for in its own novel only.
    """
    forms = entities.where(F.char_length("alias") >= least)
    by = [novel] if novel else []
    own = docs.select(*by, F.col(text).alias("__t")) if novel else docs.select(F.lit(0).alias("__k"), F.col(text).alias("__t"))
    key = novel or "__k"
    seen = contained(forms.select(F.col("alias").alias("name")), own, key, "__t").select(*by, F.col("name").alias("alias")).distinct()
    grounded = forms.join(seen, [*by, "alias"], "left_semi").select(*by, "name").distinct()
    return forms.select(*by, "name").distinct().join(grounded, [*by, "name"], "left_anti")


def asked_entities(questions: DataFrame, key: str, text: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, name and place (from 1) of the entities that a question names, by their canonical names.

    ``names`` has all names and aliases, ``aliases`` (alias, canonical) those that stand for
    another. Longer names come first, and an entity stands where its longest form does.
    """
    found = contained(names, questions, key, text)
    own = aliases.select(F.col("alias").alias("name"), "canonical")
    named = found.join(own, "name", "left").select(key, "name", F.coalesce("canonical", "name").alias("canonical"))
    first = named.groupBy(key, "canonical").agg(F.min(F.struct(-F.char_length("name"), F.col("name"))).alias("__o"))
    place = F.row_number().over(W.partitionBy(key).orderBy("__o", "canonical"))
    return first.select(key, F.col("canonical").alias("name"), place.cast("long").alias("place"))

