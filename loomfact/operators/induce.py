"""Heading patterns from marked lines: a regular expression induced from examples, then tried on the whole book.

A line falls into tokens of one class: numerals, digits, white space, marks, Latin words,
single Han characters. Tokens at the same place of all marked lines make one part of the
pattern: numbers are always a class, equal tokens themselves, different Han characters
a class that known sequences complete (上, 中 become 上中下), different Latin words any word.
The first place whose tokens are of different classes ends the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .split import MODES

#: Numerals, sequences that complete a class, marks that open a heading.
NUMERALS = "零〇一二两三四五六七八九十百千万"
SEQUENCES = ("上中下", "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥", "春夏秋冬", "东南西北", "前后", "左右", "内外")
OPENING = "(（[【〖"
#: Different characters up to which one of a sequence stands for all of it.
FEW = 3

_HAN = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"
_TOKENS = rf"(?U)([{NUMERALS}]+|\d+|\s+|[^\w\s{NUMERALS}]+|[a-zA-Z]+|[{_HAN}])"
_NUMBER = rf"[{NUMERALS}\d]+"


def _kind(token: Column) -> Column:
    tests = (("number", rf"(?U)^[{NUMERALS}\d]"), ("space", r"(?U)^\s"), ("word", "^[a-zA-Z]"), ("han", rf"^[{_HAN}]$"))
    return F.coalesce(*(F.when(token.rlike(p), F.lit(name)) for name, p in tests), F.lit("mark"))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}#&~-])", r"\\$1")


def _completed(chars: Column, sequences: tuple[str, ...]) -> Column:
    out = chars
    for s in sequences:
        whole = F.array(*map(F.lit, s))
        shared = F.size(F.array_intersect(chars, whole))
        out = F.when((shared > 0) & ((F.size(chars) <= FEW) | ((shared >= 2) & (shared == F.size(chars)))), F.array_union(out, whole)).otherwise(out)
    return F.array_join(F.array_sort(out), "")


def _patterns(marked: DataFrame, key: str, sequences: tuple[str, ...]) -> DataFrame:
    """key, brackets (whether opening marks were taken away), pattern and how many different first tokens the lines have."""
    both = marked.select(key, F.explode(F.array(F.struct(F.lit(False).alias("brackets"), F.col("line").alias("l")), F.struct(F.lit(True).alias("brackets"), F.ltrim("line", F.lit(OPENING)).alias("l")))).alias("v"))
    tokens = both.select(key, "v.brackets", F.regexp_extract_all("v.l", F.lit(_TOKENS), F.lit(1)).alias("ts"))
    shortest = tokens.groupBy(key, "brackets").agg(F.min(F.size("ts")).alias("least"), F.count_distinct(F.get("ts", F.lit(0))).alias("firsts"))
    placed = tokens.select(key, "brackets", F.posexplode("ts").alias("col", "t"))
    columns = placed.groupBy(key, "brackets", "col").agg(F.collect_set("t").alias("values"), F.collect_set(_kind(F.col("t"))).alias("kinds"))
    one, kind = F.size("values") == 1, F.get("kinds", F.lit(0))
    part = (
        F.when(F.size("kinds") > 1, F.lit(None))
        .when(kind == "number", F.lit(_NUMBER))
        .when(one & (kind == "space"), F.lit(r"\s+"))
        .when(one, _quoted(F.get("values", F.lit(0))))
        .when(kind == "han", F.concat(F.lit("["), _quoted(_completed(F.col("values"), sequences)), F.lit("]")))
        .when(kind == "word", F.lit("[a-zA-Z]+"))
    )
    parts = columns.select(key, "brackets", "col", part.alias("part")).join(shortest, [key, "brackets"]).where(F.col("col") < F.col("least"))
    g = parts.groupBy(key, "brackets", "firsts").agg(F.array_sort(F.collect_list(F.struct("col", "part"))).alias("ps"), F.min(F.when(F.col("part").isNull(), F.col("col"))).alias("stop"))
    kept = F.filter("ps", lambda p: F.col("stop").isNull() | (p["col"] < F.col("stop")))
    return g.select(key, "brackets", "firsts", F.concat(F.lit("^"), F.array_join(F.transform(kept, lambda p: p["part"]), "")).alias("pattern"))


def induced(marked: DataFrame, lines: DataFrame, key: str, modes: dict[str, str] = MODES, sequences: tuple[str, ...] = SEQUENCES) -> DataFrame:
    """key, pattern and hits for books whose marked lines (key, line) have a common form that no mode covers.

    At least two lines are marked. Opening brackets are left away where the lines then
    begin more alike. All marked lines fit the pattern, and two lines of the book
    (``lines``: key, line) at least.
    """
    own = marked.select(key, strip("line").alias("line")).where("line <> ''")
    bare = F.ltrim("line", F.lit(OPENING))
    covers = [F.bool_and(c.rlike(p)).alias(f"m{i}{j}") for i, p in enumerate(modes.values()) for j, c in enumerate((F.col("line"), bare))]
    state = own.groupBy(key).agg(F.count("*").alias("n"), *covers)
    covered = F.lit(False)
    for c in state.columns[2:]:
        covered = covered | F.col(c)
    free = state.where((F.col("n") >= 2) & ~covered).select(key)
    found = _patterns(own.join(free, key, "left_semi"), key, sequences)
    #  The bracketless form counts if it has fewer different beginnings.
    best = found.groupBy(key).agg(F.min_by(F.struct("brackets", "pattern"), F.struct("firsts", F.col("brackets").cast("int"))).alias("b")).select(key, "b.*").where("pattern <> '^'")
    tested = own.join(best, key).groupBy(key, "pattern").agg(F.bool_and(F.rlike(F.when(F.col("brackets"), bare).otherwise(F.col("line")), F.col("pattern"))).alias("all")).where("all")
    hits = lines.select(key, "line").join(tested.select(key, "pattern"), key).where(F.rlike(F.col("line"), F.col("pattern"))).groupBy(key, "pattern").agg(F.count("*").alias("hits"))
    return hits.where("hits >= 2")
