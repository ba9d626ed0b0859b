"""Secret scan of whole texts, with DataFrame operations only.

Three patterns give the base spans. The method adds spans of high entropy: long runs
of key characters that hold letters and digits are classed (hexadecimal, upper case
with digits, mixed), a window slides over each with counts that change by one character
in and one out, and windows whose Shannon entropy reaches the class's threshold join
to spans. Runs on the allow-list and spans inside a base span are left out. Positions
are code points, ends exclusive. Each row is scanned on its own; nothing is shuffled.

Defined cases: null text counts as empty; an empty list of spans is the empty string;
rows that repeat are scanned each; extra columns are ignored by :func:`scan` and kept
by :func:`redacted`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the base patterns, as the contract gives them
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# ---- equal to the matches above of sufficient length, as a run that is too short holds none that is long enough
LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
LONG_HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Class of a candidate, its pattern and the least bits of entropy of a window.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 2.95), ("upper", r"^[A-Z0-9]+$", 3.45), ("mixed", r"", 3.85))
#: Candidates that are no secrets: UUIDs, placeholders, content hashes with their prefix.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|x{6,}|0{8,}",
    r"^sha(1|256|384|512)[-_=]",
)
#: Words and numbers joined by dashes, underscores or slashes are no secrets: in others, letters and digits touch somewhere, or there is a plus.
#: No group stands under a star here, as such a group costs the regex engine a stack frame each time.
MINGLED = r"[A-Za-z][0-9]|[0-9][A-Za-z]|\+"
#: Elements of an array, and characters of a candidate, that one fold takes.
PIECE = 128
RUN = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(xs: Column, size: int, overlap: int = 0) -> Column:
    """Consecutive pieces of an array, each with up to ``overlap`` elements of the one before in front."""
    cuts = lambda all_of: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_of)), F.lit(size))
    part = lambda all_of, at: F.slice(all_of, F.greatest(F.lit(1), at - overlap), size + F.least(F.lit(overlap), at - 1))
    return _let(xs, lambda all_of: F.transform(cuts(all_of), lambda at: part(all_of, at)))


def _running(xs: Column, own: Callable[[Column], Column], combine: Callable[[Column, Column], Column], given: Callable[[Column, Column], Column], kind: str) -> Column:
    """The arrays ``given(before, x)`` of all elements of ``xs``, joined; ``before`` combines the numbers ``own`` of the elements before.

    A fold copies its state at each step, arrays too, so one fold over all would take time
    with the square of their number. Each piece of ``xs`` is folded on its own instead,
    from what the pieces before it come to.
    """
    none, numbers = F.expr(f"cast(array() as array<{kind}>)"), F.expr("cast(array() as array<int>)")

    def joined(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: combine(n, own(x))))
        add = lambda s, t: F.struct(combine(s["at"], t).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        before = F.aggregate(totals, F.struct(F.lit(0).alias("at"), numbers.alias("out")), add, lambda s: s["out"])
        one = lambda s, x: F.struct(combine(s["at"], own(x)).alias("at"), F.concat(s["out"], given(s["at"], x)).alias("out"))
        fold = lambda z: F.aggregate(z["piece"], F.struct(z["before"].alias("at"), none.alias("out")), one, lambda s: s["out"])
        return F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), before.alias("before")), fold))

    return _let(_pieces(xs, PIECE), joined)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, value) of the pattern's matches, left to right."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    length = lambda x: x["gap"] + F.char_length(x["found"])

    def given(at: Column, x: Column) -> Column:
        return F.array(F.struct((at + x["gap"]).alias("start"), (at + length(x)).alias("end"), x["value"].alias("value")))

    return _running(rows, length, lambda a, b: a + b, given, "struct<start:int,end:int,value:string>")


def _when(text: Column, hint: str, found: Column) -> Column:
    """``found`` only where the cheaper ``hint`` matches at all."""
    return F.when(text.rlike(hint), found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def _entropy_runs(value: Column, threshold: Column) -> Column:
    """Array of (start, end) within ``value`` where windows of high entropy join.

    The fold keeps the counts of the window's characters and the sum of c * log2(c) over
    them; a step takes one character in and one out and so changes two terms of the sum.
    It starts anew for each piece of ``value``, a window before the piece's own windows,
    and runs that touch across pieces join afterwards.
    """
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    chars = F.slice(F.split(value, "", -1), F.lit(1), F.char_length(value))
    places = F.transform(chars, lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    leaving = lambda p: F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(p, F.lit(1), F.size(p) - WINDOW))

    def step(s: Column, x: Column) -> Column:
        gone = F.when(x["leave"] < 0, F.lit(0)).otherwise(F.get(s["counts"], x["leave"]))
        less = F.when(gone > 0, F.get(terms, gone - 1) - F.get(terms, gone)).otherwise(F.lit(0.0))
        had = F.get(s["counts"], x["enter"]) - (x["leave"] == x["enter"]).cast("int")
        total = s["sum"] + less + F.get(terms, had + 1) - F.get(terms, had)
        counts = F.transform(s["counts"], lambda c, k: c + (k == x["enter"]).cast("int") - (k == x["leave"]).cast("int"))
        end = s["at"] + 1
        hit = (end >= s["first"]) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= s["least"])
        apart = hit & ((s["to"] == 0) | (s["to"] < end - WINDOW))
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            end.alias("at"),
            F.when(apart, end - WINDOW).otherwise(s["from"]).alias("from"),
            F.when(hit, end).otherwise(s["to"]).alias("to"),
            F.when(apart, opened(s)).otherwise(s["out"]).alias("out"),
            s["first"].alias("first"),
            s["least"].alias("least"),
        )

    def opened(s: Column) -> Column:
        one = F.struct(s["from"].alias("start"), s["to"].alias("end"))
        return F.when(s["to"] > 0, F.concat(s["out"], F.array(one))).otherwise(s["out"])

    def of_piece(p: Column, k: Column, least: Column) -> Column:
        """Runs of the windows that end in piece ``k``, which has WINDOW characters of the one before in front."""
        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.greatest(F.lit(0), k * RUN - WINDOW).alias("at"),
            F.lit(0).alias("from"),
            F.lit(0).alias("to"),
            none.alias("out"),
            F.greatest(F.lit(WINDOW), k * RUN).alias("first"),
            least.alias("least"),
        )
        return F.aggregate(F.arrays_zip(p.alias("enter"), leaving(p).alias("leave")), start, step, opened)

    def joined(runs: Column) -> Column:
        begins = F.filter(runs, lambda x, i: (i == 0) | (F.get(runs, i - 1)["end"] < x["start"]))
        ends = F.filter(runs, lambda x, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["start"] > x["end"]))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b["start"].alias("start"), e["end"].alias("end")))

    runs = _let(threshold, lambda least: F.flatten(F.transform(_pieces(places, RUN, WINDOW), lambda p, k: of_piece(p, k, least))))
    return _let(runs, joined)


def _entropy(text: Column) -> Column:
    def wanted(c: Column) -> Column:
        v = c["value"]
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & v.rlike(MINGLED) & ~reduce(lambda a, b: a | b, [v.rlike(p) for p in ALLOWED])

    def threshold(v: Column) -> Column:
        (_, hexa, low), (_, upper, mid), (_, _, high) = CLASSES
        return F.when(v.rlike(hexa), low).when(v.rlike(upper), mid).otherwise(high)

    def spans(c: Column) -> Column:
        runs = _entropy_runs(c["value"], threshold(c["value"]))
        return F.transform(runs, lambda r: F.struct((c["start"] + r["start"]).alias("start"), (c["start"] + r["end"]).alias("end")))

    found = _when(text, CANDIDATE, _matches(text, CANDIDATE, 0))
    return F.flatten(F.transform(F.filter(found, wanted), spans))


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with arrays ``__lf_base`` and ``__lf_all`` of (start, rank, end) by start and kind."""
    assign = F.filter(_matches(text, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= ASSIGN_CHARS)
    kinds = [
        _when(text, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", assign),
        _when(text, LONG_ACCESS, _matches(text, LONG_ACCESS, 0)),
        _when(text, LONG_HEX, _matches(text, LONG_HEX, 0)),
    ]
    base = F.array_sort(F.concat(*(_ranked(k, i) for i, k in enumerate(kinds))))
    found = docs.withColumns({"__lf_base": base, "__lf_more": _ranked(_entropy(text), 3)})

    kind = "struct<start:int,rank:int,end:int>"
    base_end = lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(F.lit(0))

    def outside(end: Column, x: Column) -> Column:
        return F.when((x["rank"] < 3) | (x["end"] > end), F.array(x)).otherwise(F.expr(f"cast(array() as array<{kind}>)"))

    #  By start and kind, every base span that could hold an added one comes before it.
    every = _running(F.array_sort(F.concat("__lf_base", "__lf_more")), base_end, F.greatest, outside, kind)
    return found.withColumn("__lf_all", F.when(F.size("__lf_more") > 0, every).otherwise(F.col("__lf_base"))).drop("__lf_more")


def _listed(spans: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_spans(rows, F.col("text")).drop("text")
    count = lambda i: F.size(F.filter("__lf_all", lambda x: x["rank"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return rows.select(
        "doc_id",
        *(count(i) for i in range(4)),
        F.sha2(_listed("__lf_base").cast("binary"), 256).alias("base_sha256"),
        _listed("__lf_all").alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, base or added, replaced by ``mark``; n_chars follows where there is one."""
    spans = with_spans(docs, F.coalesce("text", F.lit("")))
    kind = "struct<start:int,end:int>"

    def given(at: Column, x: Column) -> Column:
        """The clear part before a span that no span before reaches."""
        apart = (x["start"] > at) | ((x["start"] == at) & (at == 0))
        return F.when(apart, F.array(F.struct(at.alias("start"), x["start"].alias("end")))).otherwise(F.expr(f"cast(array() as array<{kind}>)"))

    def rest(chars: Column) -> Column:
        """The clear parts, with the mark between them and before what follows the last span."""
        clear = _running(F.col("__lf_all"), lambda x: x["end"], F.greatest, given, kind)
        parts = F.transform(clear, lambda g: F.array_join(F.slice(chars, g["start"] + 1, g["end"] - g["start"]), ""))
        last = F.array_max(F.transform("__lf_all", lambda x: x["end"]))
        return F.array_join(F.concat(parts, F.array(F.array_join(F.slice(chars, last + 1, F.size(chars)), ""))), mark)

    text = F.when(F.size("__lf_all") > 0, _let(F.split("text", "", -1), rest)).otherwise(F.col("text"))
    out = spans.withColumn("text", text).drop("__lf_base", "__lf_all")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
