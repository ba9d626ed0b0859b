"""Column expressions for costs, distances, numbers in words and map projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the cost model's constants
TOKENS_PER_CHAR = 1.5
OVERHEAD_TOKENS = 47_000
OUTPUT_TOKENS = 4_000
CNY_PER_USD = 7.2
# ----
EARTH_KM = 6371.0


def ordered_prefix(value: Column, table: list[tuple[str, float]], default: float) -> Column:
    """The entry of ``value`` itself, else of the first key whose part before a dash starts it, else the default."""
    out = None
    for k, v in table:
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    for k, v in table:
        out = out.when(F.startswith(value, F.lit(k.split("-")[0])), v)
    return out.otherwise(F.lit(default))


def estimated_tokens(chapters: Column, words: Column) -> Column:
    """Input tokens: the text's, and the overhead of each chapter."""
    return F.floor(words * TOKENS_PER_CHAR).cast("long") + chapters * OVERHEAD_TOKENS


def estimated_cost_micros(chapters: Column, words: Column, in_price: float, out_price: float) -> Column:
    """Cost in millionths of a dollar; prices are dollars a million tokens."""
    return F.floor(estimated_tokens(chapters, words) * in_price + chapters * OUTPUT_TOKENS * out_price).cast("long")


def scaled_limit(context: Column, low: int, high: int, from_context: int = 8192, to_context: int = 131072) -> Column:
    """A limit that grows linearly with the context window between two sizes."""
    part = F.least(F.greatest((context - from_context) / (to_context - from_context), F.lit(0.0)), F.lit(1.0))
    return (low + F.floor(part * (high - low))).cast("long")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def projected(points: DataFrame, lat: str, lng: str, width: float, height: float, padding: float) -> DataFrame:
    """Mercator coordinates fitted into a canvas with one scale; the bounds are one aggregated row."""
    flat = points.withColumn("__x", F.radians(lng)).withColumn("__y", mercator_y(F.col(lat)))
    box = flat.agg(F.min("__x").alias("x0"), F.max("__x").alias("x1"), F.min("__y").alias("y0"), F.max("__y").alias("y1"))
    span = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1e-9))
    scale = F.least((width - 2 * padding) / span("x0", "x1"), (height - 2 * padding) / span("y0", "y1"))
    both = flat.join(F.broadcast(box)).withColumn("__s", scale)  # one row
    return both.withColumn("x", padding + (F.col("__x") - F.col("x0")) * F.col("__s")).withColumn("y", padding + (F.col("y1") - F.col("__y")) * F.col("__s")).drop("__x", "__y", "__s", "x0", "x1", "y0", "y1")


def largest_cluster(points: DataFrame, lat: str, lng: str, cell: int = 30) -> DataFrame:
    """Mean of the grid cell with most points; the cell is the floor, also of negative degrees."""
    g = points.groupBy(F.floor(F.col(lat) / cell).alias("a"), F.floor(F.col(lng) / cell).alias("b")).agg(F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(lng).alias("lng"))
    return g.orderBy(F.desc("n"), "a", "b").limit(1)


def chinese_number(text: Column) -> Column:
    """Value of a number below 10000 in Chinese digits or Arabic ones, null for anything else.

    Folds the characters: a digit waits for its unit, a unit multiplies what waits (one if nothing does).
    """
    digits = "零一二三四五六七八九"
    units = {"十": 10, "百": 100, "千": 1000}
    chars = F.slice(F.split(F.replace(text, F.lit("两"), F.lit("二")), "", -1), F.lit(1), F.char_length(text))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("wait"), F.lit(False).alias("has"))

    def step(s: Column, c: Column) -> Column:
        digit = F.instr(F.lit(digits), c) - 1
        unit = F.coalesce(*(F.when(c == k, v) for k, v in units.items()), F.lit(0))
        worth = F.when(s["has"], s["wait"]).otherwise(1)
        return (
            F.when(unit > 0, F.struct((s["total"] + worth * unit).alias("total"), F.lit(0).alias("wait"), F.lit(False).alias("has")))
            .otherwise(F.struct(s["total"].alias("total"), digit.alias("wait"), (digit > 0).alias("has")))
        )

    word = F.aggregate(chars, start, step, lambda s: s["total"] + s["wait"])
    return F.when(text.rlike("^[0-9]+$"), text.cast("int")).when(text.rlike("^[零一二两三四五六七八九十百千]+$"), word)


def distance_km(text: Column, day_km: float = 40.0, li_km: float = 0.5, most: float = 400.0) -> Column:
    """A distance in words: days of travel, li, kilometres or a keyword; clamped."""
    number = lambda p: chinese_number(F.regexp_extract(text, p, 1))
    n = "([0-9]+|[零一二两三四五六七八九十百千]+)"
    value = (
        F.when(text.rlike(f"{n}(日|天)"), number(f"{n}(日|天)") * day_km)
        .when(text.rlike(f"{n}(公里|千米|km)"), number(f"{n}(公里|千米|km)") * 1.0)
        .when(text.rlike(f"{n}里"), number(f"{n}里") * li_km)
        .when(F.contains(text, F.lit("远")), F.lit(most / 2))
        .when(F.contains(text, F.lit("近")), F.lit(5.0))
    )
    return F.when(value.isNotNull(), F.least(value, F.lit(most)))


def range_key(start: Column, end: Column, width: Column, height: Column) -> Column:
    """First 16 hex digits of the MD5 of a layout's parameters."""
    return F.substring(F.md5(F.concat_ws(":", start, end, width, height).cast("binary")), 1, 16)


def marker_radius(mentions: Column, level: Column) -> Column:
    return F.least(F.greatest(10 + 2 * mentions + 5 * (3 - level), F.lit(15)), F.lit(60))


def error_class(message: Column) -> Column:
    """Ordered classes of error messages."""
    low = F.lower(message)
    return (
        F.when(low.rlike("timeout|timed out"), "timeout")
        .when(low.rlike("rate limit|429|quota"), "rate_limit")
        .when(low.rlike("json|parse|decode"), "parse")
        .when(low.rlike("connect|network|refused"), "connection")
        .otherwise("unknown")
    )
