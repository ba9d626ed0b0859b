"""Splitting books into chapters: by heading patterns, given points or size, book by book in columns.

The best pattern of a book is chosen by counts and evenness; lines are numbered, headings
start a running chapter number, and chapters are put together again. All of it is keyed by the
book, so a plan has one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import is_url_like
from ..functions.text import strip

#: Heading patterns by name, whole lines; white space is Unicode's.
MODES = {
    "chapter_cn": r"(?U)^\s*第\s*[0-9零一二两三四五六七八九十百千]+\s*[章回节].{0,40}$",
    "volume_cn": r"(?U)^\s*[卷部]\s*[0-9一二三四五六七八九十]+.{0,40}$",
    "chapter_en": r"(?iU)^\s*(chapter|part|book)\s+([0-9]+|[ivxlc]+)\b.{0,60}$",
    "numbered": r"(?U)^\s*[0-9]{1,4}[.、]\s*\S.{0,40}$",
    "separator": r"^\s*[*=-]{3,}\s*$",
}
FIXED_SIZE = 8000


def _lines(books: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return books.select(key, *more, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def scores(books: DataFrame, key: str, text: str, modes: dict[str, str] = MODES) -> DataFrame:
    """(key, mode, hits, score): hits times the evenness of the gaps between them."""
    lines = _lines(books, key, text)
    hits = None
    for name, pattern in modes.items():
        one = lines.where(F.col("line").rlike(pattern)).select(key, "line_no", F.lit(name).alias("mode"))
        hits = one if hits is None else hits.union(one)
    w = W.partitionBy(key, "mode").orderBy("line_no")
    gaps = hits.withColumn("gap", F.lead("line_no").over(w) - F.col("line_no"))
    g = gaps.groupBy(key, "mode").agg(F.count("*").alias("hits"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    even = F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean") / 2)).otherwise(0.0)
    return g.select(key, "mode", "hits", (F.col("hits") * even).alias("score"))


def chosen_mode(books: DataFrame, key: str, text: str, modes: dict[str, str] = MODES, least: int = 2) -> DataFrame:
    """The mode of each book with the highest score, the first of the table on a tie; books without one are left out."""
    order = F.array_position(F.array(*(F.lit(m) for m in modes)), F.col("mode"))
    s = scores(books, key, text, modes).where(F.col("hits") >= least)
    return s.groupBy(key).agg(F.max_by("mode", F.struct("score", "hits", -order)).alias("mode"))


def split_at(books: DataFrame, key: str, text: str, heading: Column, prologue: int = 100, more: tuple[str, ...] = ()) -> DataFrame:
    """Chapters (key, chapter, title, content) where ``heading`` (a condition on line and ``more``) starts one.

    What stands before the first heading is a prologue if it is long enough; chapters
    without text are left out.
    """
    w = W.partitionBy(key).orderBy("line_no")
    lines = _lines(books, key, text, *more).withColumn("head", heading).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    parts = lines.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "head"))).alias("ls"))
    body = F.array_join(F.transform(F.filter("ls", lambda x: ~x["head"]), lambda x: x["line"]), "\n")
    title = F.get(F.transform(F.filter("ls", lambda x: x["head"]), lambda x: strip(x["line"])), F.lit(0))
    parts = parts.select(key, "section", F.coalesce(title, F.lit("")).alias("title"), body.alias("content"))
    kept = parts.where((F.char_length(F.trim("content")) > 0) & ((F.col("section") > 0) | (F.char_length("content") >= prologue)))
    return kept.select(key, F.row_number().over(W.partitionBy(key).orderBy("section")).cast("long").alias("chapter"), "title", "content")


def split_fixed(books: DataFrame, key: str, text: str, size: int = FIXED_SIZE) -> DataFrame:
    """Chapters of about ``size`` characters, cut at the line end nearest to each multiple of it."""
    lines = _lines(books, key, text)
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    at = lines.withColumn("end", F.sum(F.char_length("line") + 1).over(w))
    at = at.withColumn("section", F.floor((F.col("end") - F.char_length("line") / 2) / size))
    g = at.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    g = g.withColumn("chapter", F.row_number().over(W.partitionBy(key).orderBy("section")).cast("long"))
    return g.select(key, "chapter", F.lit("").alias("title"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


def split_points(books: DataFrame, key: str, text: str, points: str) -> DataFrame:
    """Chapters cut at given offsets (an array column, from 0); the title is a short first line."""
    size = F.char_length(text)
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(points, lambda p: (p > 0) & (p < size)))))
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(size))
    #  Only the parts leave the row, so a book is not copied for each of them.
    parts = F.zip_with(cuts, ends, lambda a, e: F.substring(F.col(text), a + 1, e - a))
    rows = books.select(key, F.posexplode(parts).alias("i", "content"))
    first = F.trim(F.split("content", "\n")[0])
    return rows.select(key, (F.col("i") + 1).cast("long").alias("chapter"), F.when(F.char_length(first) <= 40, first).otherwise("").alias("title"), "content")


def split_books(books: DataFrame, key: str, text: str, pattern: str | None = None, modes: dict[str, str] = MODES) -> DataFrame:
    """Chapters of every book: by ``pattern`` if given, else by its best mode, else by size."""
    if pattern is not None:
        return split_at(books, key, text, F.col("line").rlike(pattern)).withColumn("mode", F.lit("custom"))
    with_mode = books.select(key, text).join(chosen_mode(books, key, text, modes), key, "left")
    heading = F.coalesce(*(F.when(F.col("mode") == name, F.col("line").rlike(p)) for name, p in modes.items()), F.lit(False))
    found = split_at(with_mode.where("mode is not null"), key, text, heading, more=("mode",))
    by_size = split_fixed(with_mode.where("mode is null"), key, text).withColumn("mode", F.lit("fixed"))
    return found.join(chosen_mode(books, key, text, modes), key).unionByName(by_size)


#: Characters of a book that its genre is told from.
GENRE_SAMPLE = 50_000
#: Marks of running text.
BODY_MARKS = "。，；：！？…、》）」』】"
#: Marks that begin a line of dialogue.
DIALOGUE_MARKS = '"「'
SEPARATOR = "separator"


def genre_features(books: DataFrame, key: str, text: str, modes: dict[str, str] = MODES, dialogue: str = DIALOGUE_MARKS) -> DataFrame:
    """key, size, share of lines of dialogue, number and mean length of paragraphs, modes with two hits, separators.

    Dialogue and paragraphs are told from the first GENRE_SAMPLE characters, as the rule says; hits from the whole book.
    """
    sample = F.filter(F.transform(F.split(F.substring(text, 1, GENRE_SAMPLE), "\n"), strip), lambda x: x != "")
    lines = F.split(text, "\n")
    matching = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    hits = [matching(p) for p in modes.values()]
    rows = books.select(key, F.char_length(text).alias("size"), sample.alias("__s"), sum((F.when(h >= 2, 1).otherwise(0) for h in hits), F.lit(0)).alias("modes"), (hits[list(modes).index(SEPARATOR)] if SEPARATOR in modes else F.lit(0)).alias("separators"))
    said = F.size(F.filter("__s", lambda x: x.rlike(f"^[{dialogue}]")))
    n = F.size("__s")
    mean = F.when(n > 0, F.aggregate("__s", F.lit(0), lambda a, x: a + F.char_length(x)) / n).otherwise(0.0)
    return rows.select(key, "size", F.when(n > 0, said / n).otherwise(0.0).alias("dialogue"), n.alias("paragraphs"), mean.alias("mean"), "modes", "separators")


def text_genre(features: DataFrame, key: str) -> DataFrame:
    """key, genre and confidence by :func:`genre_features`; the first rule that holds."""
    c = F.col
    quiet = (c("dialogue") < 0.01) & (c("modes") == 0)
    rules = (
        ("novel", 0.9, c("dialogue") > 0.05),
        ("poetry", 0.85, (c("mean") < 50) & (c("paragraphs") > 100) & (c("size") < 50_000) & quiet),
        ("essay", 0.8, (c("size") < 30_000) & quiet),
        ("short_collection", 0.7, (c("separators") >= 3) & (c("size") < 200_000)),
    )
    pick = lambda k: F.coalesce(*(F.when(r[2], F.lit(r[k])) for r in rules), F.lit(("unknown", 0.5)[k]))
    return features.select(key, pick(0).alias("genre"), pick(1).alias("confidence"))


def paginated(books: DataFrame, key: str, text: str, least: int = 5, percent: int = 80) -> DataFrame:
    """key, title and hits of books whose lines ``title(number)`` have one title in most of their places.

    At least ``least`` such lines, ``percent`` of them with one title; the one seen first on a tie.
    """
    rows = books.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^.{1,20}\(\d+\)\s*$"))
    titles = rows.select(key, "line_no", strip(F.regexp_extract("line", r"^(.{1,20})\(\d+\)\s*$", 1)).alias("title"))
    n = titles.groupBy(key, "title").agg(F.count("*").alias("n"), F.min("line_no").alias("seen"))
    g = n.groupBy(key).agg(F.max_by("title", F.struct("n", -F.col("seen"))).alias("title"), F.max("n").alias("hits"), F.sum("n").alias("total"))
    return g.where((F.col("total") >= least) & (F.col("hits") * 100 >= F.col("total") * percent)).select(key, "title", "hits")


def heuristic_titles(books: DataFrame, key: str, text: str, marks: str = BODY_MARKS, most: int = 30, apart: int = 500) -> DataFrame:
    """key, line_no and title: short lines behind a blank line that read like titles, ``apart`` characters from the one before.

    A title has at most ``most`` characters, none of ``marks``, a letter or digit, not
    digits alone, and is no address. Of two that are too close the earlier one stays.
    Books with fewer than two titles have no row. Of the lines only short ones travel with
    their text; a fold over a book's candidates chooses the titles.
    """
    title = strip("line")
    fits = (title != "") & (F.char_length(title) <= most) & ~title.rlike(f"[{marks}]") & ~title.rlike(r"(?U)^\d+$") & ~is_url_like(title) & title.rlike(r"(?U)[\p{L}\p{N}]")
    lines = _lines(books, key, text).select(key, "line_no", (F.char_length("line") + 1).cast("long").alias("size"), (title == "").alias("blank"), F.when(fits, title).alias("title"))
    w = W.partitionBy(key).orderBy("line_no")
    placed = lines.withColumn("stop", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("free", F.coalesce(F.lag("blank").over(w), F.lit(True)))
    found = placed.where(F.col("title").isNotNull() & F.col("free")).select(key, F.struct("line_no", "title", (F.col("stop") - F.col("size")).alias("start"), "stop").alias("c"))
    books_of = found.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cs")).where(F.size("cs") > 1)
    far = lambda kept, c: (F.size(kept) == 0) | (c["start"] - F.element_at(kept, -1)["stop"] >= apart)
    kept = F.aggregate("cs", F.slice("cs", 1, 0), lambda kept, c: F.when(far(kept, c), F.concat(kept, F.array(c))).otherwise(kept))
    return books_of.select(key, kept.alias("k")).where(F.size("k") > 1).select(key, F.explode("k").alias("t")).select(key, F.col("t.line_no").cast("long").alias("line_no"), "t.title")


def usable(chapters: DataFrame, key: str, words: str) -> DataFrame:
    """key, chapters, whether the split is usable, and why not.

    Usable: three chapters, none too long; or two of a short book; or five, four fifths of
    them of a usual size.
    """
    w = F.col(words)
    g = chapters.groupBy(key).agg(F.count("*").alias("chapters"), F.max(w).alias("most"), F.sum(w).alias("total"), F.count_if(w.between(2000, 20_000)).alias("usual"))
    n, long, big = F.col("chapters"), F.col("most") > 50_000, F.col("total") > 80_000
    good = ((n >= 3) & ~long) | ((n >= 2) & ~big) | ((n >= 5) & (F.col("usual") * 5 >= n * 4))
    why = F.when(n == 1, F.when(F.col("total") > 50_000, "single_huge_chapter").otherwise("single_chapter_small")).when((n == 2) & big, "only_2_chapters").when(long, "oversized_chapter").when(n < 3, "too_few_chapters").otherwise("other")
    return g.select(key, "chapters", good.alias("usable"), F.when(good, "").otherwise(why).alias("reason"))
