"""Column expressions over texts: lines, dialogue, noise, snippets, n-grams, classes.

Patterns carry the Unicode flag where white space is meant, as Java's is ASCII otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that open a line of dialogue.
QUOTES = '"“「『'
#: Kinds of noise lines: pattern and confidence in percent, the strongest first.
NOISE = (
    ("url", r"(?i)(https?://|www\.|\.(com|net|org)\b)", 90),
    ("promo", r"(?i)(licensed under|all rights reserved|subscribe|sign up)", 85),
    ("contact", r"(?i)[a-z0-9_.]+@[a-z0-9]+\.[a-z]", 85),
    ("template", r"^\s*[\w%]+(\s*\|\s*[\w%.,]+){2,}\s*\.?\s*$", 80),
    ("decoration", r"^[\s*=#~_-]{3,}$", 70),
)


def strip(c: Column) -> Column:
    """Python's strip: all Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0) and line of each line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def is_dialogue(line: Column) -> Column:
    return F.substring(strip(line), 1, 1).isin(*QUOTES)


def dialogue_share(text: Column) -> Column:
    """Lines that open with a quote, of the lines that are not empty, in parts of 10000."""
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    spoken = F.filter(filled, is_dialogue)
    return F.when(F.size(filled) == 0, 0).otherwise(F.floor(F.size(spoken) * 10000 / F.size(filled))).cast("long")


def noise_kind(line: Column) -> Column:
    """The first kind of noise that a line is, null for none."""
    out = None
    for kind, pattern, _ in NOISE:
        out = F.when(line.rlike(pattern), kind) if out is None else out.when(line.rlike(pattern), kind)
    return out


def noise_confidence(line: Column) -> Column:
    """The confidence of the first kind of noise that a line is, null for none; each pattern is tried once at most."""
    out = None
    for _, pattern, confidence in NOISE:
        out = F.when(line.rlike(pattern), confidence) if out is None else out.when(line.rlike(pattern), confidence)
    return out


def cleaned(df: DataFrame, key: str, text: str, least: int = 80) -> DataFrame:
    """``df`` with the lines of at least ``least`` percent confidence taken out; row by row, without a shuffle."""
    keep = F.filter(F.split(text, "\n"), lambda x: F.coalesce(noise_confidence(x) < least, F.lit(True)))
    return df.withColumn("removed", (F.size(F.split(text, "\n")) - F.size(keep)).cast("long")).withColumn(text, F.array_join(keep, "\n"))


def snippet(text: Column, needle: Column, around: int = 50) -> Column:
    """The text around the first place of ``needle`` regardless of case, with dots where it is cut."""
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + F.char_length(needle) + around, F.char_length(text) + 1)
    body = F.substring(text, start, end - start)
    return F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end <= F.char_length(text), "...").otherwise(""))


def occurrences(text: Column, name: Column) -> Column:
    """How often ``name`` occurs, without overlaps."""
    return F.floor((F.char_length(text) - F.char_length(F.replace(text, name, F.lit("")))) / F.char_length(name)).cast("long")


def grams(df: DataFrame, key: str, text: str, pattern: str, low: int, high: int) -> DataFrame:
    """Character n-grams of ``low`` to ``high`` inside runs of ``pattern``, with counts and documents.

    Grams are made within the row and counted twice: per row first, so the shuffle carries one row
    for each gram and document part and not one for each place.
    """
    run = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).alias("run"))
    size = run.select(key, "run", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).where(F.char_length("run") >= F.col("n"))
    at = size.select(key, "run", "n", F.explode(F.sequence(F.lit(1), F.char_length("run") - F.col("n") + 1)).alias("at"))
    return at.select(key, F.substring(F.col("run"), F.col("at"), F.col("n")).alias("gram"))


def section_class(title: Column, text: Column, place: Column, total: Column) -> Column:
    """Ordered rules for sections that are no story: title, publishing words, short prologue, boundary title, criticism, short boundary."""
    words = lambda ws: sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in ws), F.lit(0))
    size, edge = F.char_length(text), (place <= 2) | (place > total - 2)
    return (
        F.when(F.lower(title).rlike("^(preface|foreword|appendix|copyright|postscript)"), "title")
        .when(words(("licensed", "isbn", "edition", "publisher")) >= 2, "publishing")
        .when((place == 1) & (size < 200), "short_prologue")
        .when(edge & F.lower(title).rlike("author|acknowledg"), "boundary_title")
        .when(words(("critic", "scholar", "translation")) >= 3, "criticism")
        .when(edge & (size < 300), "short_boundary")
        .otherwise("story")
    )


def paragraphs_restored(text: Column) -> Column:
    """Long texts with few line feeds get one after each sentence mark that a space follows."""
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    flat = (F.char_length(text) >= 1000) & (breaks * 2000 < F.char_length(text))
    return F.when(flat, F.regexp_replace(text, r"([.!?。！？])[ 　]+", "$1\n")).otherwise(text)


def numbered(text: Column) -> Column:
    """Each line with its number in front."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def thinking_removed(text: Column) -> Column:
    """Without closed ``<think>`` blocks and an open one at the end."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def cited_chapters(text: Column, pattern: str = r"第\s*(\d+)\s*章") -> Column:
    """Distinct chapter numbers that a text names, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))))
