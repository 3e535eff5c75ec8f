"""Secret scans (operator 8), in DataFrame functions only.

Base patterns give spans of three kinds. Further spans come from entropy: runs of token characters
are candidates; a window slides over each, the count of every character in it is kept as one
character enters and one leaves, and the sum of c * log2(c), so the Shannon entropy, changes by
those two counts alone. Each character class has its own window and threshold. Plain words, numbers
and other allowed forms are suppressed, as is an entropy span that another span covers whole; one
that reaches beyond base spans stays beside them.

Rows: null or empty text has no spans; a null id is kept; repeated rows each give a row; an empty
table gives an empty table; extra columns are ignored. Spans count code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # the group whose length counts
    least: int


#: Fixed patterns: matches are leftmost and don't overlap; those with a short group are dropped afterwards.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    Kind("hex", r"([0-9a-f]{16,})", 1, 16),  # a shorter run is never part of another match
)


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``run``; a window of ``width`` characters with at least ``bits`` of entropy is hot."""

    name: str
    run: str
    width: int
    bits: float


CLASSES = (
    CharClass("hex", r"[0-9A-Fa-f]{24,}", 24, 3.2),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)

#: Candidates of these forms are no secrets: words in one case or with a capital, numbers, words joined by hyphens or underscores, UUIDs.
ALLOWED = (r"^[a-z]+$", r"^[A-Z]+$", r"^[A-Z][a-z]+$", r"^[0-9]+$", r"^[A-Za-z]+([_/-][A-Za-z]+)+$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")

_SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _found(text: Column, pattern: str, group: int) -> Column:
    """start, end and value of every match. Lengths of what is between matches and of matches add up to the places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("match"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.char_length(p["gap"])
        end = begin + F.coalesce(F.char_length(p["match"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), F.coalesce(p["value"], F.lit("")).alias("value")))
        return F.struct(end.alias("at"), F.when(p["match"].isNotNull(), F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda s: s["out"])).otherwise(none)


def base_spans(text: Column, ordinal: int, kind: Kind) -> Column:
    found = F.filter(_found(text, kind.pattern, kind.group), lambda m: F.char_length(m["value"]) >= kind.least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(ordinal).alias("ord"), F.lit(kind.name).alias("kind"), m["end"].alias("end")))


#: Counts of the 96 printable characters as numbers of _BITS bits, _SLOTS of them in a long.
_BITS, _SLOTS, _FIRST = 6, 10, 32
_LONGS = -(-96 // _SLOTS)
#: c * log2(c) for every count that a window can hold.
_TERMS = tuple(c * math.log2(c) if c else 0.0 for c in range(1 << _BITS))


def hot_range(value: Column, width: int, bits: float) -> Column:
    """First and last place of windows with at least ``bits`` of entropy in a string of printable ASCII, as struct(first, last); first is -1 if there is none.

    The state holds the counts by character, packed into a few longs, and the sum of c * log2(c); a
    step changes both by the character that enters and the one that leaves, so a string takes time in
    proportion to its length. ``width`` is at most 63. The characters are bound to a lambda's
    variable, as Spark would evaluate an expression again at each place.
    """
    if not 0 < width < 1 << _BITS:
        raise ValueError(f"a window has 1 to {(1 << _BITS) - 1} characters")
    none = F.lit(0).cast("long")
    state = F.struct(F.array_repeat(none, _LONGS).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    shifted = lambda kind, x, by: F.call_function(kind, x, by)
    terms = F.array(*map(F.lit, _TERMS))

    def place(c: Column) -> Column:
        return F.struct(F.floor(c / _SLOTS).cast("int").alias("long"), (c % _SLOTS * _BITS).alias("shift"))

    def ranges(codes: Column) -> Column:
        pairs = F.transform(codes, lambda c, i: F.struct(place(c).alias("into"), F.when(i >= width, place(F.get(codes, i - width))).alias("out")))
        return F.aggregate(pairs, state, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    def count(s: Column, p: Column) -> Column:
        return shifted("shiftright", F.get(s["counts"], p["long"]), p["shift"]).bitwiseAND((1 << _BITS) - 1).cast("int")

    def changed(s: Column, p: Column, by: int) -> Column:
        """Term and counts after one more or one less of a character."""
        n = count(s, p)
        unit = shifted("shiftleft", F.lit(by).cast("long"), p["shift"])
        counts = F.transform(s["counts"], lambda x, k: F.when(k == p["long"], x + unit).otherwise(x))
        return F.struct(counts.alias("counts"), (s["total"] + F.get(terms, n + by) - F.get(terms, n)).alias("total"))

    def step(s: Column, p: Column) -> Column:
        """The one that leaves goes first, so that no count passes the width."""
        left = F.when(p["out"].isNull(), F.struct(s["counts"].alias("counts"), s["total"].alias("total"))).otherwise(changed(s, p["out"], -1))
        new = F.get(F.transform(F.array(left), lambda x: changed(x, p["into"], 1)), F.lit(0))

        def moved(n: Column) -> Column:
            hot = (s["at"] >= width - 1) & (math.log2(width) - n["total"] / width >= bits - 1e-9)
            begin = s["at"] - (width - 1)
            return F.struct(n["counts"].alias("counts"), n["total"].alias("total"), (s["at"] + 1).alias("at"), F.when(hot & (s["first"] < 0), begin).otherwise(s["first"]).alias("first"), F.when(hot, begin).otherwise(s["last"]).alias("last"))

        return F.get(F.transform(F.array(new), moved), F.lit(0))

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c) - _FIRST)
    return F.get(F.transform(F.array(codes), ranges), F.lit(0))


def entropy_spans(text: Column, ordinal: int, kind: CharClass) -> Column:
    """Spans of a class: from the first hot window's start to the last one's end, in each candidate that isn't allowed."""
    allowed = lambda v: F.coalesce(*[F.when(v.rlike(p), True) for p in ALLOWED], F.lit(False))
    found = F.filter(_found(text, kind.run, 0), lambda m: ~allowed(m["value"]))
    ranges = F.transform(found, lambda m: F.struct(m["start"].alias("start"), hot_range(m["value"], kind.width, kind.bits).alias("hot")))
    hot = F.filter(ranges, lambda r: r["hot"]["first"] >= 0)
    return F.transform(hot, lambda r: F.struct((r["start"] + r["hot"]["first"]).alias("start"), F.lit(ordinal).alias("ord"), F.lit("entropy").alias("kind"), (r["start"] + r["hot"]["last"] + kind.width).alias("end")))


def with_spans(docs: DataFrame, text_col: str = "text", base_col: str = "_base", spans_col: str = "_spans") -> DataFrame:
    """``docs`` with two more columns, arrays of (start, ord, kind, end) by start, then kind: base spans, and all spans.

    An entropy span is left out if a base span, or a span of an earlier class, covers all of it; spans may overlap.
    """
    names = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = F.concat(*[base_spans(text, k, kind) for k, kind in enumerate(KINDS)])
    d = docs.withColumn(base_col, F.array_sort(base).cast(_SPANS))
    d = d.withColumns({f"_entropy{k}": entropy_spans(text, len(KINDS), c).cast(_SPANS) for k, c in enumerate(CLASSES)})
    beyond = lambda spans: lambda x: ~F.exists(spans, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))
    more = base_col
    for k in range(len(CLASSES)):
        d = d.withColumn(f"_all{k}", F.when(F.size(f"_entropy{k}") > 0, F.concat(more, F.filter(f"_entropy{k}", beyond(more)))).otherwise(F.col(more)))
        more = f"_all{k}"
    return d.withColumn(spans_col, F.array_sort(more)).select(*[f"`{n}`" for n in names if n not in (base_col, spans_col)], base_col, spans_col)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and spans of each row of ``docs``."""
    return with_spans(id_and_text(docs, id_col, text_col), "text", "base", "spans")


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``."""
    d = secret_spans(docs, id_col, text_col)
    of = lambda name: lambda s: s["kind"] == name
    counts = [F.size(F.filter("base", of(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def masked(text: str = "text", spans: str = "spans", mask: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["at"]
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(apart, piece).otherwise(s["out"]).alias("out"))

    rebuilt = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(F.col(text))
