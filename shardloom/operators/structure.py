"""Structure of regulation-style texts: headings, their levels, sections and chunks, as joins and windows by document.

``docs`` has doc_id and text. Offsets count characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shardloom.functions.lineage import cut
from shardloom.functions.text import ANY_SPACE, GLUE, blank, demoted, markdown_plain, numeral, short_hash, stripped, without_headings
from shardloom.operators.chunking import balanced_groups, even_parts, paragraphs

_DIGITS = "0-9０-９"
_NUMERALS = "0-9０-９一二三四五六七八九十百千〇"

# Types of headings in the order in which they are tried, the start of a line that makes one, and its usual level.
RULES = (
    ("appendix", "^附則", 1),
    ("japanese_chapter", f"^第[{_NUMERALS}]+章", 1),
    ("japanese_article", f"^第[{_NUMERALS}]+条", 2),
    ("japanese_section", f"^第[{_NUMERALS}]+項", 3),
    ("decimal_number", f"^[{_DIGITS}]+\\.[{_DIGITS}]+", 3),
    ("numeric_dot", f"^[{_DIGITS}]{{1,2}}[.)．](?![{_DIGITS}])", 4),
    ("numeric_paren", f"^[（(][{_DIGITS}]+[)）]", 4),
    ("japanese_paren", "^[（(][一二三四五六七八九十〇]+[)）]", 4),
    ("roman", "^([IVX]{1,5}[.)]\\s|[Ⅰ-Ⅻ]\\s)", 4),
    ("alpha", "^[A-Z][.)]\\s", 4),
    ("circle_bullet", "^○\\s*\\S", 5),
    ("bullet", "^[•・\\-]\\s", 5),
)
NAMES = tuple(r[0] for r in RULES)
HINTS = {r[0]: r[2] for r in RULES}
PRIORITIES = {r[0]: len(RULES) - k for k, r in enumerate(RULES)}
_STARTS = "(" + "|".join(p.replace("^", "", 1) for _, p, _ in RULES) + ")"
STRONG = f"^(附則|第[{_NUMERALS}]+[章条])"
MAX_DEPTH = 4


@dataclass(frozen=True)
class Weights:
    """Fixed values of the scores."""

    least_score: float = 3.0
    longest_line: int = 80
    outer_gap: float = 0.8
    containment: float = 5.0
    sequence: float = 2.5
    coverage: float = 1.5
    frequency: float = 0.7
    priority: float = 0.5
    preferred: float = 2.0
    head_zone: float = 0.15
    open_tail: float = 0.4
    raw_items: float = 0.4


def by_type(values: dict[str, int], default: int, c: Column | str = "marker_type") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(c == name, F.lit(v)).otherwise(out)
    return out


def heading_type(line: Column) -> Column:
    """Name of the first rule that a line starts by, or null; most lines start by none, which one test tells."""
    return F.when(line.rlike("^" + _STARTS), F.coalesce(*[F.when(line.rlike(pattern), F.lit(name)) for name, pattern, _ in RULES]))


def marker_value(kind: Column, line: Column) -> Column:
    """Number of a heading, null if it has none that is an integer above zero."""
    named = numeral(F.regexp_extract(line, f"[{_NUMERALS}]+", 0))
    leading = numeral(F.regexp_extract(line, f"^[{_DIGITS}]+", 0))
    inner = numeral(F.regexp_extract(line, f"^[（(]([{_NUMERALS}]+)[)）]", 1))
    return F.when(kind.isin("appendix", "japanese_chapter", "japanese_article", "japanese_section"), named).when(kind.isin("decimal_number", "numeric_dot"), leading).when(kind.isin("numeric_paren", "japanese_paren"), inner)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, start_char, previous_blank, text_length."""
    d = docs.select("doc_id", F.char_length("text").alias("text_length"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    d = d.withColumns({"_size": F.char_length("line") + 1, "_blank": blank(F.col("line"))})
    start = F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return d.withColumns({"start_char": start, "previous_blank": F.coalesce(F.lag("_blank").over(w), F.lit(False))}).drop("_size", "_blank")


def blank_before_headings(docs: DataFrame) -> DataFrame:
    """doc_id, text with an empty line before each chapter, article or appendix line that follows a line with text."""
    d = lines(docs)
    strong = F.col("line").rlike(STRONG) & (F.col("line_no") > 0) & ~F.col("previous_blank")
    made = F.when(strong, F.concat(F.lit("\n"), "line")).otherwise(F.col("line"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", made.alias("line"))))
    return d.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


# What follows a chapter or article number that is only referred to, and characters between which a sentence goes on.
REFERENCE = f"(各号|第[{_NUMERALS}]+項|の[{_NUMERALS}]+|及び|並びに|又は|若しくは|[にをはがとや等のへもで])"
RUNNING = "぀-ゟ゠-ヿ㐀-䶿一-鿿0-9０-９ｦ-ﾟㇰ-ㇿ"
INLINE_ITEM = f"([{_DIGITS}]{{1,2}}[.)．](?![{_DIGITS}])|[（(][{_DIGITS}]+[)）]|[（(][一二三四五六七八九十〇]+[)）])"
_MARKER = f"(附則|第[{_NUMERALS}]+[章条])"


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _right_stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"{ANY_SPACE}+\\z", "")


def split_embedded_headings(rows: Column) -> Column:
    """Lines in which a chapter, article or appendix starts inside, unless it is only referred to, as two lines."""

    def one(line: Column) -> Column:
        at = F.regexp_instr(line, F.lit(_MARKER))
        rest = F.substring(line, at, F.char_length(line))
        before = _right_stripped(F.substring(line, F.lit(1), at - 1))
        cut_here = (at > 1) & ~rest.rlike(f"^{_MARKER}{REFERENCE}")
        return F.when(cut_here, F.filter(F.array(before, rest), lambda x: x != "")).otherwise(F.array(line))

    return F.flatten(F.transform(rows, one))


def split_embedded_items(rows: Column) -> Column:
    """Lines in which items of an enumeration follow a sentence or word, unless they are only referred to, as a line for each."""

    def one(line: Column) -> Column:
        parts = F.arrays_zip(F.split(line, INLINE_ITEM, -1).alias("gap"), F.concat(F.regexp_extract_all(line, F.lit(INLINE_ITEM), F.lit(0)), F.array(F.lit(""))).alias("item"))

        def step(s: Column, p: Column) -> Column:
            text = F.concat(s["text"], p["gap"])
            ends = (p["item"] != "") & text.rlike(f"[{RUNNING}、，。．.！？!?]\\z") & ~F.concat(p["after"], F.lit("")).rlike(f"^{REFERENCE}")
            return F.struct(F.concat(text, F.when(ends, F.lit("\n")).otherwise(F.lit("")), p["item"]).alias("text"))

        def folded(ps: Column) -> Column:
            following = F.transform(ps, lambda p, k: F.struct(p["gap"].alias("gap"), p["item"].alias("item"), F.concat(F.coalesce(F.get(ps, k + 1)["gap"], F.lit("")), F.coalesce(F.get(ps, k + 1)["item"], F.lit(""))).alias("after")))
            return F.aggregate(following, F.struct(F.lit("").alias("text")), step, lambda s: s["text"])

        def lines_of(text: Column) -> Column:
            found = F.split(text, "\n")
            n = F.size(found)
            return F.when(n > 1, F.filter(F.transform(found, lambda x, k: F.when(k < n - 1, _right_stripped(x)).otherwise(x)), lambda x: x != "")).otherwise(F.array(line))

        return F.when(line.rlike(INLINE_ITEM), _bound(_bound(parts, folded), lines_of)).otherwise(F.array(line))

    return F.flatten(F.transform(rows, one))


def with_blanks_before_headings(rows: Column) -> Column:
    return _bound(rows, lambda ls: F.flatten(F.transform(ls, lambda x, k: F.when((k > 0) & x.rlike(f"^{ANY_SPACE}*{_MARKER}") & (stripped(F.get(ls, k - 1)) != ""), F.array(F.lit(""), x)).otherwise(F.array(x)))))


def without_blanks_after_headings(rows: Column) -> Column:
    """An empty line between a heading and a line of Japanese text that isn't one goes."""

    def kept(ls: Column) -> Column:
        flags = F.transform(ls, lambda x, k: F.struct(x.alias("x"), F.get(ls, k - 1).alias("above"), F.get(ls, k + 1).alias("under")))
        gone = lambda r: (r["x"] == "") & F.coalesce(r["above"].rlike(f"^{_STARTS}") & r["above"].rlike(f"[{GLUE}]\\z") & r["under"].rlike(f"^[{GLUE}]") & ~r["under"].rlike(f"^{_STARTS}"), F.lit(False))
        return F.transform(F.filter(flags, lambda r: ~gone(r)), lambda r: r["x"])

    return _bound(rows, kept)


def joined_soft_breaks(text: Column) -> Column:
    """Single line breaks inside a sentence go, unless a heading or item starts the next line."""
    return F.regexp_replace(text, f"\n(?<=[{RUNNING}、，]\n)(?!{_STARTS})(?=[{RUNNING}])", "")


def repaired(docs: DataFrame, inline: bool = True) -> DataFrame:
    """doc_id, text with lines as structure needs them: embedded headings and items on lines of their own (``inline``), blank lines before chapters and articles and none between items or after headings, broken sentences joined."""
    rows = F.split("text", "\n")
    if inline:
        rows = split_embedded_items(split_embedded_headings(rows))
    text = joined_soft_breaks(F.array_join(without_blanks_after_headings(with_blanks_before_headings(rows)), "\n"))
    return closed_enumerations(docs.select("doc_id", text.alias("text")))


def closed_enumerations(docs: DataFrame) -> DataFrame:
    """doc_id, text without blank lines between items of one enumeration whose numbers follow each other."""
    d = lines(docs).withColumn("item", heading_type(F.ltrim("line"))).withColumn("value", marker_value(F.col("item"), F.ltrim("line")))
    blank = stripped(F.col("line")) == ""
    full = F.when(~blank, F.struct("item", "value"))
    before, after = (Window.partitionBy("doc_id").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("line_no", F.desc("line_no")))
    d = d.withColumns({"_blank": blank, "_before": F.last(full, ignorenulls=True).over(before), "_after": F.last(full, ignorenulls=True).over(after)})
    numbered = F.col("_before.item").isin("numeric_dot", "numeric_paren", "japanese_paren")
    gap = F.coalesce(F.col("_blank") & numbered & (F.col("_before.item") == F.col("_after.item")) & (F.col("_after.value") == F.col("_before.value") + 1), F.lit(False))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return d.where(~gap).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def candidates(docs: DataFrame, w: Weights = Weights()) -> DataFrame:
    """doc_id, start_char, heading, marker_type, value, score, text_length: lines that can be headings."""
    d = lines(docs).withColumn("heading", F.regexp_replace("line", r"^[\s　]+", "")).where("heading <> ''")
    d = d.withColumn("marker_type", heading_type(F.col("heading"))).where("marker_type IS NOT NULL")
    n, h, t = F.char_length("heading"), F.col("heading"), F.col("marker_type")
    stops = n - F.char_length(F.translate("heading", "。．", ""))
    score = (
        F.lit(4.0)
        + F.col("previous_blank").cast("double")
        + (n <= 40).cast("double")
        + F.when(t.isin("japanese_chapter", "japanese_article", "appendix"), 4.0).when(t == "japanese_section", 2.0).otherwise(0.0)
        + F.when(h.rlike("[（(][^）)\n]{1,30}[）)]"), 2.0).otherwise(0.0)
        + (~h.rlike("[。.．]$")).cast("double")
        - F.when(n > 60, 2.0).otherwise(0.0)
        - F.when(stops >= 2, 2.0).otherwise(0.0)
        - F.when(h.rlike(r"https?://|@\w+\."), 3.0).otherwise(0.0)
    )
    d = d.where((n <= w.longest_line) | h.rlike(STRONG)).withColumn("score", score).where(F.col("score") >= w.least_score)
    return d.select("doc_id", "start_char", "heading", "marker_type", marker_value(t, h).alias("value"), "score", "text_length")


def with_sequence_bonus(cands: DataFrame) -> DataFrame:
    """Candidates with ``bonus``: 2 if the number is one more than the one before of its type, 0.5 if it starts again at 1."""
    before = F.lag("value").over(Window.partitionBy("doc_id", "marker_type").orderBy("start_char"))
    numbered = cands.where("value IS NOT NULL").withColumn("_before", before)
    bonus = F.when(F.col("value") == F.col("_before") + 1, 2.0).when((F.col("value") == 1) & (F.col("_before") >= 1), 0.5).otherwise(0.0)
    return numbered.withColumn("bonus", bonus).drop("_before").unionByName(cands.where("value IS NULL").withColumn("bonus", F.lit(0.0)))


def _sequence(value: Column, before: Column, short: float) -> Column:
    """Share of steps of one, a new start at 1 counting half; ``short`` with fewer than two numbers. An aggregate over rows with a number."""
    steps = F.sum(F.when(value == before + 1, 1.0).when((value == 1) & before.isNotNull(), 0.5).otherwise(0.0))
    n = F.count(value)
    return F.when(n < 2, F.lit(short)).otherwise(F.coalesce(steps, F.lit(0.0)) / (n - 1))


def group_stats(cands: DataFrame) -> DataFrame:
    """doc_id, marker_type, n, first_char, average_gap, sequence, priority, text_length: what a document's headings of a type are like."""
    w = Window.partitionBy("doc_id", "marker_type").orderBy("start_char")
    numbers = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = cands.withColumns({"_gap": F.col("start_char") - F.lag("start_char").over(w), "_before": numbers})
    return d.groupBy("doc_id", "marker_type").agg(
        F.count("*").alias("n"),
        F.min("start_char").alias("first_char"),
        F.coalesce(F.avg("_gap"), F.first("text_length").cast("double")).alias("average_gap"),
        _sequence(F.col("value"), F.col("_before"), 0.5).alias("sequence"),
        F.first("text_length").alias("text_length"),
    ).withColumn("priority", by_type(PRIORITIES, 1))


def _last_of_types(*scope: str) -> Column:
    """Array of (type, at): the last heading of each type before a row of its scope, by one running window."""
    before = Window.partitionBy(*scope).orderBy("start_char").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.struct(F.lit(name).alias("type"), F.max(F.when(F.col("marker_type") == name, F.col("start_char"))).over(before).alias("at")) for name in NAMES]
    return F.filter(F.array(*last), lambda x: x["at"].isNotNull() & (x["type"] != F.col("marker_type")))


def containment(cands: DataFrame, stats: DataFrame, w: Weights = Weights()) -> DataFrame:
    """doc_id, marker_type, containment, reset: how far headings of a type hold those of types with smaller gaps between them.

    A sweep over each document's headings: the interval a heading lies in begins at the last heading of the
    outer type before it, and it is the first of its type there if that one comes after the type's last number.
    """
    numbered = F.max(F.when(F.col("value").isNotNull(), F.col("start_char"))).over(Window.partitionBy("doc_id", "marker_type").orderBy("start_char").rowsBetween(Window.unboundedPreceding, -1))
    swept = cands.select("doc_id", "start_char", F.col("marker_type"), "value", _last_of_types("doc_id").alias("outer"), F.coalesce(numbered, F.lit(-1)).alias("before"))
    met = swept.select("doc_id", F.col("marker_type").alias("b"), "value", "before", F.explode("outer").alias("x")).select("doc_id", F.col("x.type").alias("a"), "b", F.coalesce((F.col("value") == 1) & (F.col("x.at") > F.col("before")), F.lit(False)).cast("int").alias("starts"))
    pairs = met.groupBy("doc_id", "a", "b").agg(F.count("*").alias("held"), F.sum("starts").alias("starts"))
    gaps = lambda side: stats.select("doc_id", F.col("marker_type").alias(side), F.col("average_gap").alias(f"{side}_gap"), F.col("n").alias(f"{side}_n"))
    ordered = gaps("a").join(gaps("b"), "doc_id").where((F.col("a") != F.col("b")) & (F.col("a_gap") > F.col("b_gap") * w.outer_gap))  # types of a document, few
    scored = ordered.join(pairs, ["doc_id", "a", "b"], "left").withColumn("mean", F.coalesce("held", F.lit(0)) / F.col("a_n"))
    by_outer = scored.groupBy("doc_id", "a").agg(
        F.coalesce(F.avg(F.when(F.col("mean") >= 1, F.least(F.lit(1.0), F.col("mean") / 4.0))), F.lit(0.0)).alias("containment"),
        (F.coalesce(F.sum("starts"), F.lit(0)) / F.first("a_n")).alias("reset"),
    )
    named = by_outer.withColumnRenamed("a", "marker_type")
    return stats.select("doc_id", "marker_type").join(named, ["doc_id", "marker_type"], "left").fillna(0.0, ["containment", "reset"])


ENUMERATIONS = ("numeric_dot", "numeric_paren", "japanese_paren")


def raw_signals(docs: DataFrame, cands: DataFrame, w: Weights = Weights()) -> DataFrame:
    """``cands`` with ``raw``: whether a heading's section by inferred levels holds two lines of one enumeration, of an inner kind, whose numbers follow each other or start anew.

    Lines too long to be headings count here. The nearest end of such a pair that begins after a heading is a
    running minimum from a document's end, which is under the section's end if the pair is inside.
    """
    tree = section_tree(cands.join(inferred_levels(cands, w).select("doc_id", "marker_type", "level"), ["doc_id", "marker_type"]))
    text = F.ltrim("line")
    items = lines(docs).withColumn("kind", heading_type(text)).where(F.col("kind").isin(*ENUMERATIONS)).withColumn("value", marker_value(F.col("kind"), text)).where("value IS NOT NULL")
    following = F.lead(F.struct("start_char", "value")).over(Window.partitionBy("doc_id", "kind").orderBy("start_char"))
    pairs = items.withColumn("next", following).where("next.value = value + 1 OR next.value = 1").select("doc_id", "start_char", F.col("next.start_char").alias("pair_end"), F.lit(None).cast("int").alias("end_char"))
    outer = tree.where(by_type(HINTS, 4) < HINTS["numeric_dot"]).select("doc_id", "start_char", F.lit(None).cast("int").alias("pair_end"), F.col("end_char").cast("int").alias("end_char"))
    after = Window.partitionBy("doc_id").orderBy(F.desc("start_char")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = pairs.unionByName(outer).withColumn("nearest", F.min("pair_end").over(after)).where("end_char IS NOT NULL AND nearest < end_char")
    return cands.join(met.select("doc_id", "start_char", F.lit(True).alias("raw")), ["doc_id", "start_char"], "left").withColumn("raw", F.coalesce("raw", F.lit(False)))


def inferred_levels(cands: DataFrame, w: Weights = Weights(), least: int = 2) -> DataFrame:
    """doc_id, marker_type, outer_score, level: types ranked by how much they look like outer ones; rare types have their usual level."""
    stats = group_stats(cands)
    d = stats.join(containment(cands, stats, w), ["doc_id", "marker_type"])
    gap = F.least(F.col("average_gap") / F.greatest(F.col("text_length"), F.lit(1)) * 10.0, F.lit(2.0))
    outer = F.col("containment") * 4.0 + F.col("reset") * 3.0 + F.col("sequence") + F.col("priority") / 13.0 * 1.5 + gap
    d = d.withColumn("outer_score", F.when(F.col("n") >= least, outer))
    rank = F.row_number().over(Window.partitionBy("doc_id", F.col("outer_score").isNull()).orderBy(F.desc("outer_score"), "first_char"))
    level = F.least(F.lit(MAX_DEPTH), F.when(F.col("outer_score").isNotNull(), rank).otherwise(by_type(HINTS, 4)))
    return d.select("doc_id", "marker_type", "outer_score", level.alias("level"))


def section_tree(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, start_char, level, text_length) with end_char and parent_start.

    A section ends at the next one of its level or above; its parent is the nearest before it of a
    level above, found among the last ones of each level.
    """
    # running windows from either end: a frame that reaches to the end is worked out anew for each row
    after = Window.partitionBy("doc_id").orderBy(F.desc("start_char")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("doc_id").orderBy("start_char").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda k: F.min(F.when(F.col("level") <= k, F.col("start_char"))).over(after)
    last = lambda k: F.max(F.when(F.col("level") == k, F.col("start_char"))).over(before)
    d = nodes.withColumns({f"_next{k}": upto(k) for k in range(1, MAX_DEPTH + 1)} | {f"_last{k}": last(k) for k in range(1, MAX_DEPTH)})
    end, parent = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in range(1, MAX_DEPTH + 1):
        end = F.when(F.col("level") == k, F.col(f"_next{k}")).otherwise(end)
        if k > 1:
            above = [F.coalesce(F.col(f"_last{j}"), F.lit(-1)) for j in range(1, k)]
            nearest = F.greatest(*above) if len(above) > 1 else above[0]
            parent = F.when(F.col("level") == k, F.nullif(nearest, F.lit(-1))).otherwise(parent)
    out = d.withColumns({"end_char": F.coalesce(end, F.col("text_length")), "parent_start": parent})
    return out.drop(*[c for c in d.columns if c.startswith("_")])


def _scope_scores(active: DataFrame, w: Weights, tail: bool) -> DataFrame:
    """doc_id, scope_start, marker_type, type_score, first_char for every type of each scope."""
    scope = ["doc_id", "scope_start"]
    by = Window.partitionBy(*scope, "marker_type").orderBy("start_char")
    d = active.withColumn("_before", F.last("value", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    types = d.groupBy(*scope, "marker_type").agg(
        F.count("*").alias("n"),
        F.min("start_char").alias("first_char"),
        F.max("start_char").alias("last_char"),
        F.first("scope_end").alias("scope_end"),
        F.first("preferred").alias("preferred"),
        _sequence(F.col("value"), F.col("_before"), 0.0).alias("sequence"),
    )
    size = F.greatest(F.col("scope_end") - F.col("scope_start"), F.lit(1))
    head = F.col("first_char") <= F.col("scope_start") + size * w.head_zone
    types = types.withColumns({"_size": size, "_head": head, "total": F.sum("n").over(Window.partitionBy(*scope))})

    # intervals between neighbours of a type; one alone at the head of its scope, and the last, reach to the scope's end
    nexts = F.lead("start_char").over(by)
    spans = active.withColumn("_next", nexts).join(types.select(*scope, "marker_type", "n", "_head"), [*scope, "marker_type"])
    weight = F.when(F.col("_next").isNotNull(), 1.0).when((F.col("n") == 1) & F.col("_head"), 1.0).when((F.col("n") > 1) & F.lit(tail), w.open_tail)
    spans = spans.select(*scope, F.col("marker_type").alias("outer"), F.col("start_char").alias("a"), weight.alias("weight"), "raw").where("weight IS NOT NULL")
    # a number that follows the one before of its type is inside every span that both are in: those that begin before the earlier
    number = F.when(F.col("value").isNotNull(), F.struct("start_char", "value"))
    swept = active.select(*scope, "marker_type", "value", F.last(number, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), _last_of_types(*scope).alias("outer"))
    steps = swept.where("value = before.value + 1").select(*scope, F.explode(F.filter("outer", lambda x: x["at"] < F.col("before.start_char"))).alias("x"))
    hits = steps.select(*scope, F.col("x.type").alias("outer"), F.col("x.at").alias("a")).distinct().withColumn("hit", F.lit(1.0))
    judged = spans.join(hits, [*scope, "outer", "a"], "left").withColumn("hit", F.coalesce("hit", F.when(F.col("raw"), w.raw_items), F.lit(0.0)))
    counted = judged.where((F.col("weight") >= 1) | (F.col("hit") > 0)).groupBy(*scope, F.col("outer").alias("marker_type")).agg((F.sum(F.col("weight") * F.col("hit")) / F.sum("weight")).alias("inside"))

    d = types.join(counted, [*scope, "marker_type"], "left")
    coverage = F.when(F.col("n") >= 2, (F.col("last_char") - F.col("first_char")) / F.col("_size")).otherwise(F.when(F.col("_head"), 1.0).otherwise(0.3))
    score = (
        F.coalesce("inside", F.lit(0.0)) * w.containment
        + F.col("sequence") * w.sequence
        + coverage * w.coverage
        + F.log(F.lit(1.0) + F.col("n")) / F.log(F.greatest(F.col("total"), F.lit(2)).cast("double")) * w.frequency
        + by_type(PRIORITIES, 0) / 13.0 * w.priority
        + F.when(F.col("marker_type") == F.col("preferred"), w.preferred).otherwise(0.0)
    )
    return d.select(*scope, "marker_type", score.alias("type_score"), "first_char")


def scope_levels(cands: DataFrame, w: Weights = Weights(), tail: bool = True, docs: DataFrame | None = None) -> DataFrame:
    """Candidates that get a level (1 to 4), with it: in each scope the best type and those of its usual level are chosen, and the stretches between them are the scopes of the next round.

    Candidates before the first chosen one of their scope, and those left after the last round, get none.
    With ``docs`` raw_signals() count where no headings are inside.
    """
    known = cands.withColumn("raw", F.lit(False)) if docs is None else raw_signals(docs, cands, w)
    active = known.withColumns({"scope_start": F.lit(0), "scope_end": F.col("text_length"), "preferred": F.lit(None).cast("string")})
    done = None
    for level in range(1, MAX_DEPTH + 1):
        if level == 1:
            active = cut(active)  # a round uses it several times; later ones read what their round before wrote
        scope = ["doc_id", "scope_start"]
        scored = _scope_scores(active, w, tail).withColumn("hint", by_type(HINTS, 4))
        best = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("type_score"), "first_char"))).where("_r = 1 AND type_score > 0").select(*scope, F.col("hint").alias("best_hint"))
        judged = scored.join(best, scope).withColumn("chosen", (F.col("hint") == F.col("best_hint")) & (F.col("type_score") > 0))
        inner = F.when(~F.col("chosen") & (F.col("hint") > F.col("best_hint")) & (F.col("type_score") > 0), F.struct("type_score", (-F.col("first_char")).alias("early"), "marker_type"))
        following = F.max(inner).over(Window.partitionBy(*scope))["marker_type"]
        judged = judged.withColumn("following", following).select(*scope, "marker_type", "chosen", "following")
        marked = active.join(judged, [*scope, "marker_type"])
        by = Window.partitionBy(*scope).orderBy("start_char")
        back = Window.partitionBy(*scope).orderBy(F.desc("start_char")).rowsBetween(Window.unboundedPreceding, -1)
        chosen_at = F.when(F.col("chosen"), F.col("start_char"))
        marked = marked.withColumns({"_from": F.last(chosen_at, ignorenulls=True).over(by), "_to": F.coalesce(F.last(chosen_at, ignorenulls=True).over(back), F.col("scope_end"))})
        marked = cut(marked)
        here = marked.where("chosen").select(*cands.columns, F.lit(level).alias("level"))
        done = here if done is None else done.unionByName(here)
        active = marked.where("NOT chosen AND _from IS NOT NULL").select(*cands.columns, "raw", F.col("_from").alias("scope_start"), F.col("_to").alias("scope_end"), F.col("following").alias("preferred"))
    return done


def sections(docs: DataFrame, w: Weights = Weights(), tail: bool = True) -> DataFrame:
    """doc_id, node_id, parent_start, start_char, end_char, level, role, marker_type, heading of every section."""
    found = cut(candidates(docs, w))
    tree = section_tree(cut(scope_levels(found, w, tail, docs if tail else None)))
    node = short_hash("sec_", F.concat_ws("|", F.col("start_char").cast("string"), "heading"))
    role = F.when(F.col("level") == 1, "parent").when(F.col("level") == 2, "child").otherwise("grandchild")
    return tree.withColumns({"node_id": node, "role": role})


def decorated(heading: Column, level: Column, kind: Column) -> Column:
    mark = F.when((level == 1) | (kind == "appendix"), "## ").when(level == 2, "### ").when(level == 3, "#### ").otherwise("- ")
    return F.concat(mark, heading)


def nested_levels(items: Column) -> Column:
    """Depth (0 is the outermost) of each item of an array of (type, value) in order, by a stack.

    An item that continues the innermost enumeration stays in it; a 1 opens an inner one; one that
    continues an outer enumeration closes those inside; anything else opens an inner one.
    """
    pair = "struct<type:string,value:int>"
    start = F.struct(F.array().cast(f"array<{pair}>").alias("stack"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        stack = s["stack"]
        n = F.size(stack)
        here = F.struct(x["type"].alias("type"), x["value"].cast("int").alias("value"))
        continues = lambda e: F.coalesce((e["type"] == x["type"]) & (e["value"] + 1 == x["value"]), F.lit(False))
        outer = F.array_max(F.transform(F.slice(stack, 1, F.greatest(n - 1, F.lit(0))), lambda e, k: F.when(continues(e), k)))
        depth = F.when(n == 0, 0).when(continues(F.get(stack, n - 1)), n - 1).when(x["value"] == 1, n).otherwise(F.coalesce(outer, n)).cast("int")
        return F.struct(F.concat(F.slice(stack, F.lit(1), depth), F.array(here)).alias("stack"), F.concat(s["out"], F.array(depth)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def split_at_blocks(text: Column, mark: str, most: int) -> Column:
    """Parts of at most ``most`` characters cut before lines that start by ``mark``, in groups of nearly equal size, each after the lines before the first such line; evenly where that can't be."""

    def made(pieces: Column) -> Column:
        opens = F.get(pieces, F.lit(0)).startswith(mark)
        lead = F.when(opens, F.lit("")).otherwise(F.get(pieces, F.lit(0)))
        prefix = F.when(stripped(lead) != "", F.concat(_right_stripped(lead), F.lit("\n"))).otherwise(F.lit(""))
        blocks = F.transform(F.when(opens, pieces).otherwise(F.slice(pieces, 2, F.size(pieces))), stripped)
        room = F.lit(most) - F.char_length(prefix)
        return F.struct(prefix.alias("prefix"), blocks.alias("blocks"), room.alias("room"))

    def grouped(m: Column) -> Column:
        sizes = F.transform(m["blocks"], lambda x: (F.char_length(x) + 1).cast("long"))
        numbered = F.arrays_zip(m["blocks"].alias("text"), balanced_groups(sizes, F.greatest(m["room"], F.lit(1))).alias("group"))
        return F.when((F.size(m["blocks"]) > 0) & (m["room"] > 0), _bound(numbered, lambda bs: F.transform(F.sequence(F.lit(0).cast("long"), F.array_max(F.transform(bs, lambda x: x["group"]))), lambda g: F.concat(m["prefix"], F.array_join(F.transform(F.filter(bs, lambda x: x["group"] == g), lambda x: x["text"]), "\n")))))

    return F.coalesce(_bound(_bound(F.split(text, f"(?m)^(?={mark})", -1), made), grouped), even_parts(stripped(text), most))


_LONG = 60


def _heading_line(heading: Column, level: Column, kind: Column) -> Column:
    """A heading as an ancestor's line; a long one by its marker alone."""
    marker = F.regexp_extract(heading, f"^{_STARTS}", 0)
    return decorated(F.when((F.char_length(heading) > _LONG) & (marker != ""), marker).otherwise(heading), level, kind)


def structure_chunks(docs: DataFrame, most: int = 1000, markdown: bool = True, least: int = 10, w: Weights = Weights(), tail: bool = True, repair: bool = True, two_levels: bool = False, builder: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """doc_id, chunk_index, chunk_id, role, level, path_text, parent_chunk_id, child_chunk_id, grandchild_chunk_id, chunk_text.

    A section's chunk is its lines with headings and items marked by level, after a line for the
    document's title and each section above; too long ones are split at the sections inside. A section
    of the second level needs ``least`` characters and two lines of body, or one where a sibling of its
    type has two. Where at most one such is in a chapter, the chapter stands for it; so does a
    section for its only block of items. A document without headings gives its paragraphs, with the
    role fallback. With ``two_levels`` chapters and their sections are all chunks, without lines above them,
    items stay inside, and no ids of a hierarchy are given.
    ``builder`` maps columns of a chunk (chunk_id, root_title, path_text, role, level, start_char, split_index, split_total)
    to those that it is to have beside doc_id, chunk_index, chunk_text and the ids of the hierarchy.
    """
    fixed = cut(repaired(docs) if repair else docs.select("doc_id", "text"))
    nodes = cut(sections(fixed, w, tail))
    rows = lines(fixed).select("doc_id", "line_no", "line", "start_char")
    first = F.min(F.when(stripped(F.col("line")) != "", F.struct("line_no", stripped(F.col("line")).alias("t"))))["t"]
    titles = rows.groupBy("doc_id").agg(F.coalesce(first, F.lit("document")).alias("title"))
    titles = cut(titles.withColumn("title_line", F.when(heading_type(F.col("title")).isNull(), F.concat(F.lit("# "), "title"))))
    by = Window.partitionBy("doc_id").orderBy("line_no")
    own = nodes.select("doc_id", "start_char", "node_id", "heading", "level", "marker_type", "end_char")
    at = lambda k: F.last(F.when(F.col("level") == k, F.struct("node_id", "end_char", "heading", "marker_type")), ignorenulls=True).over(by)
    placed = rows.join(own, ["doc_id", "start_char"], "left").withColumns({"_one": at(1), "_two": at(2)})
    inside = lambda c: F.when(F.col(c)["end_char"] > F.col("start_char"), F.col(c))
    placed = placed.withColumns({"one": inside("_one"), "two": inside("_two")}).drop("_one", "_two")
    # items inside a section of the second level, nested by a stack
    text = F.ltrim("line")
    kind = F.when(F.col("two").isNotNull() & F.coalesce(F.col("level") != 2, F.lit(True)), heading_type(text))
    value = marker_value(kind, text)
    item = F.when((by_type(HINTS, 0, kind) > 2) & value.isNotNull(), F.struct(kind.alias("type"), value.cast("int").alias("value")))
    placed = cut(placed.withColumn("item", item))
    ordered = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("line_no", "item"))))
    folded = placed.where("two IS NOT NULL AND item IS NOT NULL").groupBy("doc_id", F.col("two.node_id").alias("node_id")).agg(ordered.alias("items"))
    depths = folded.select("doc_id", F.explode(F.arrays_zip(F.transform("items", lambda x: x["line_no"]).alias("line_no"), nested_levels(F.transform("items", lambda x: x["item"])).alias("depth"))).alias("x")).select("doc_id", "x.line_no", "x.depth")
    placed = placed.join(depths, ["doc_id", "line_no"], "left")
    mark = F.when(F.col("depth") == 0, F.concat(F.lit("#### "), text)).when(F.col("depth") > 0, F.concat(F.lit("- "), text))
    mark = F.coalesce(mark, F.when(F.col("heading").isNotNull() & (F.col("two").isNull() | (F.col("level") <= 2)), decorated(F.col("heading"), F.col("level"), F.col("marker_type"))), F.col("line"))
    placed = placed.withColumn("shown", mark if markdown else F.col("line")).withColumn("opens", F.coalesce(F.col("depth") == 0, F.lit(False)))

    whole = stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "shown"))), lambda x: x["shown"]), "\n"))
    body_lines = F.count(F.when(stripped(F.col("shown")) != "", 1)) - 1

    # in a chapter its own text and sections follow each other without blank lines between
    blank, section = stripped(F.col("line")) == "", F.col("heading").isNotNull()
    loose_line = F.when(~blank, F.struct((section & ((F.col("level") == 2) | F.col("two").isNull())).alias("starts"), (section & F.col("two").isNull()).alias("leads")))
    under = F.last(loose_line, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1))["starts"]
    over = F.last(loose_line, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))["leads"]
    placed = cut(placed.withColumn("apart", blank & (F.coalesce(under, F.lit(False)) | F.coalesce(over, F.lit(False)))))

    def bodies(c: str) -> DataFrame:
        return placed.where(F.col(c).isNotNull() & (~F.col("apart") if c == "one" else F.lit(True))).groupBy("doc_id", F.col(f"{c}.node_id").alias("node_id")).agg(whole.alias("body"), body_lines.alias("body_lines"))

    head = lambda c, prefix: [F.col("node_id").alias(f"{prefix}_id"), F.col("heading").alias(f"{prefix}_heading"), F.col("level").alias(f"{prefix}_level"), F.col("marker_type").alias(f"{prefix}_type"), F.col("start_char").alias(f"{prefix}_start")]
    ones, twos = nodes.where("level = 1"), nodes.where("level = 2")
    two = twos.select("doc_id", "parent_start", *head(twos, "two")).join(bodies("two").withColumnRenamed("node_id", "two_id"), ["doc_id", "two_id"])
    # blocks of items of each section of the second level
    block = Window.partitionBy("doc_id", "two.node_id").orderBy("line_no")
    numbered = placed.where("two IS NOT NULL").withColumn("block", F.sum(F.col("opens").cast("int")).over(block)).where("block > 0")
    blocks = numbered.groupBy("doc_id", F.col("two.node_id").alias("two_id"), "block").agg(whole.alias("block_text"), F.min(F.struct("line_no", "line"))["line"].alias("block_heading"), F.min("start_char").alias("block_start")).where(F.char_length("block_text") >= least)
    blocks = cut(blocks.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "two_id").orderBy("block")) - 1))
    counts = blocks.groupBy("doc_id", "two_id").agg(F.count("*").alias("n_blocks"))
    two = two.join(counts, ["doc_id", "two_id"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    rich = F.max((F.col("body_lines") >= 2).cast("int")).over(Window.partitionBy("doc_id", "parent_start", "two_type")) == 1
    two = two.withColumn("emits", (F.char_length("body") >= least) & ((F.col("body_lines") >= 2) | ((F.col("body_lines") == 1) & F.col("parent_start").isNotNull() & rich)))
    family = Window.partitionBy("doc_id", "parent_start")
    merged = F.col("parent_start").isNotNull() & (F.sum(F.col("emits").cast("int")).over(family) <= 1)
    two = cut(two.withColumns({"merged": merged, "many": F.max("n_blocks").over(family) >= 2}))
    one = ones.select("doc_id", *head(ones, "one")).join(bodies("one").withColumnRenamed("node_id", "one_id"), ["doc_id", "one_id"]).withColumnRenamed("body", "text").drop("body_lines")
    flags = two.where("parent_start IS NOT NULL").groupBy("doc_id", F.col("parent_start").alias("one_start")).agg(F.first("merged").alias("merged"), F.first("many").alias("many"))
    one = one.join(flags, ["doc_id", "one_start"], "left").withColumns({"merged": F.coalesce("merged", F.lit(True)), "many": F.coalesce("many", F.lit(False))})
    above = ones.select("doc_id", F.col("start_char").alias("parent_start"), *[c for c in head(ones, "one")][:4])
    two = two.join(above, ["doc_id", "parent_start"], "left")

    named = lambda c: F.concat(F.lit("chunk_"), c)
    up_one = _heading_line(F.col("one_heading"), F.col("one_level"), F.col("one_type"))
    up_two = _heading_line(F.col("two_heading"), F.col("two_level"), F.col("two_type"))
    null = F.lit(None).cast("string")

    def chunk(d: DataFrame, role: str, start: str, base: Column, path: list, above: list, parent: Column, child: Column, grandchild: Column, body: str, block: Column) -> DataFrame:
        lead = F.concat_ws("\n", "title_line", *above) if markdown and not two_levels else F.lit("")
        if two_levels:
            parent = child = grandchild = null
        d = d.join(titles, "doc_id")
        return d.select("doc_id", "title", F.col(start).cast("int").alias("start_char"), F.lit(role).alias("role"), block.alias("block"), base.alias("base_id"), F.concat_ws(" > ", "title", *path).alias("path_text"), parent.alias("parent_chunk_id"), child.alias("child_chunk_id"), grandchild.alias("grandchild_chunk_id"), lead.alias("lead"), F.col(body).alias("body"))

    no_block = F.lit(-1)
    base = named(F.col("one_id"))
    every = chunk(one.where(F.char_length("text") >= least), "parent", "one_start", base, ["one_heading"], [], base, F.when(F.col("merged"), base), F.when(F.col("merged") & ~F.col("many"), base), "text", no_block)
    base, up = named(F.col("two_id")), F.coalesce(named(F.col("one_id")), named(F.col("two_id")))
    every = every.unionByName(chunk(two.where("emits" if two_levels else "emits AND NOT merged"), "child", "two_start", base, ["one_heading", "two_heading"], [up_one], up, base, F.when(F.col("n_blocks") <= 1, base), "body", no_block))
    small = two.where("n_blocks >= 2").select("doc_id", *[c for c in two.columns if c.startswith(("one_", "two_"))])
    third = short_hash("chunk_sec_", F.concat_ws("|", "two_id", F.col("no").cast("string"), F.substring("block_heading", 1, 80)))
    every = every if two_levels else every.unionByName(chunk(blocks.join(small, ["doc_id", "two_id"]), "grandchild", "block_start", third, ["one_heading", "two_heading", "block_heading"], [up_one, up_two], F.coalesce(named(F.col("one_id")), third), named(F.col("two_id")), third, "block_text", F.col("no")))
    bare = fixed.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    loose = paragraphs(bare).withColumn("text", stripped(F.col("text"))).where(F.char_length("text") >= least)
    base = named(short_hash("sec_", F.concat_ws("|", F.col("start_char").cast("string"), F.substring("text", 1, 40))))
    every = every.unionByName(chunk(loose, "fallback", "start_char", base, [], [], base, base, base, "text", no_block))

    room = F.greatest(F.lit(most) - F.when(F.col("lead") != "", F.char_length("lead") + 1).otherwise(0), F.lit(1))
    assembled = F.concat(F.when(F.col("lead") != "", F.concat("lead", F.lit("\n"))).otherwise(F.lit("")), "body")
    by_size = F.when(F.char_length("assembled") <= most, F.array("assembled")).when(F.col("role").isin("parent", "fallback"), split_at_blocks(F.col("assembled"), "### ", most)).when(F.col("role") == "child", split_at_blocks(F.col("assembled"), "#### ", most))
    front = F.when(F.col("lead") != "", F.concat("lead", F.lit("\n"))).otherwise(F.lit(""))
    with_lead = _bound(front, lambda f: F.transform(_even_in(F.col("body"), room), lambda p: F.concat(f, p)))
    parts = every.withColumn("assembled", assembled).withColumn("parts", F.coalesce(by_size, with_lead)).select("*", F.posexplode("parts").alias("part", "chunk_text"))
    level = F.when(F.col("role") == "child", 2).when(F.col("role") == "grandchild", 3).otherwise(1)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char", "level", "block", "part")) - 1
    chunk_id = F.when(F.size("parts") > 1, F.concat("base_id", F.lit("_p"), F.col("part").cast("string"))).otherwise(F.col("base_id"))
    parts = parts.withColumn("level", level)
    if builder:
        known = {"chunk_id": chunk_id, "root_title": F.col("title"), "split_index": F.col("part"), "split_total": F.size("parts")} | {k: F.col(k) for k in ("path_text", "role", "level", "start_char")}
        return parts.select("doc_id", index.alias("chunk_index"), "chunk_text", *[v.alias(k) for k, v in builder(known).items()], "parent_chunk_id", "child_chunk_id", "grandchild_chunk_id")
    return parts.select("doc_id", index.alias("chunk_index"), chunk_id.alias("chunk_id"), "role", "level", "path_text", "parent_chunk_id", "child_chunk_id", "grandchild_chunk_id", "chunk_text")


def _even_in(c: Column, most: Column) -> Column:
    """even_parts() with a limit that differs by row."""

    def cut_in(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(p["size"] / p["most"]).cast("int") - 1)
        width = F.ceil(p["size"] / F.ceil(p["size"] / p["most"])).cast("int")
        return F.transform(F.when(p["size"] > 0, starts).otherwise(F.array().cast("array<int>")), lambda i: F.substring(p["text"], i * width + 1, width))

    whole = _bound(c, lambda t: F.struct(t.alias("text"), F.char_length(t).alias("size"), most.alias("most")))
    return F.filter(_bound(whole, cut_in), lambda p: stripped(p) != "")


def with_vector_texts(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the texts that are embedded: the whole in plain form, and for sections under the first level their own part."""
    c = chunks.withColumn("chunk_text", demoted(F.col("chunk_text")))
    full, local = markdown_plain(F.col("chunk_text")), markdown_plain(without_headings(F.col("chunk_text")))
    own = F.array(F.struct(F.lit("full_context_plain").alias("name"), full.alias("text")))
    both = F.concat(own, F.array(F.struct(F.lit("local_context_plain").alias("name"), local.alias("text"))))
    return c.withColumn("vector_texts", F.when((F.col("level") >= 2) & (local != full) & (local != ""), both).otherwise(own))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """role, level, chunks, chars: what the chunks of all documents are."""
    return chunks.groupBy("role", "level").agg(F.count("*").alias("chunks"), F.sum(F.char_length("chunk_text")).alias("chars"))
