"""The second chunker: sections that fit are chunks with all they hold, larger ones groups of their sections, each group after the section's own lines.

Works on lines and headings by joins and windows, as the structure operators do: sizes of sections are differences
of offsets, so no text is copied for a section that isn't a chunk, and each line is in one chunk at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shardloom.functions.lineage import cut
from shardloom.functions.text import ANY_SPACE, SPACES, blank, numeral, short_hash, stripped
from shardloom.operators import structure as st
from shardloom.operators.chunking import balanced_groups, even_parts, paragraphs

_N = "0-9一二三四五六七八九十百千〇"
_DIGITS = "0-9０-９"

# Types of headings in the order in which they are tried, the start of a line that makes one, its usual level, and how far out it is taken to be.
RULES = (
    ("appendix", "^附則", 1, 11),
    ("japanese_chapter", f"^第[{_N}]+章", 1, 10),
    ("japanese_article", f"^第[{_N}]+条", 2, 9),
    ("japanese_section", f"^第[{_N}]+項", 3, 8),
    ("decimal_number", f"^[{_DIGITS}]+\\.[{_DIGITS}]+", 3, 7),
    ("numeric_dot", f"^[{_DIGITS}]+[.)．]\\s", 4, 6),
    ("numeric_paren", f"^[（(][{_DIGITS}]+[)）]", 4, 5),
    ("japanese_paren", "^[（(][一二三四五六七八九十〇]+[)）]", 4, 5),
    ("roman", "^([IVX]{1,5}[.)]\\s|[Ⅰ-Ⅻ]\\s)", 4, 4),
    ("alpha", "^[A-Z][.)]\\s", 4, 3),
    ("circle_bullet", "^○\\s*\\S", 5, 3),
    ("bullet", "^[•・\\-]\\s", 5, 2),
)
STARTS = "(" + "|".join(p.replace("^", "", 1) for _, p, _, _ in RULES) + ")"
HINTS = {r[0]: r[2] for r in RULES}
PRIORITIES = {r[0]: r[3] for r in RULES}

# Phrases that refer to a rule, and a chapter or article that begins after a full stop.
REFERENCE = "|".join((
    f"[^\\s。、]{{1,20}}(法|規則|条例|規程)第[{_N}]+[条章項号]?",
    "(前|本|次|各|当該|同)(条|項|号|章)",
    f"第[{_N}]+条(各号|第[{_N}]+項|に基づ|の規定|を準用|の定め|により|について|に従|に違)",
))
EMBEDDED = f"(?s)^(.*?[。．])(第[{_N}]+[章条]([（(][^）)\n]{{0,20}}[）)])?)(.*)\\z"
STRONG = f"^(附則|第[{_N}]+[章条])"
LONGEST_HEADING, LEAST_SCORE, LEAST_OF_TYPE, LEAST_TEXT = 80, 3.0, 2, 10
STRATEGY = "structure_aware_v2"


def prepared(docs: DataFrame, told: Callable[[Column], Column] = lambda t: F.struct(t.alias("text"))) -> DataFrame:
    """doc_id and what ``told`` makes a row of, the text: line ends and wide spaces unified, no spaces at line ends, the first chapter or article after a full stop on a line of its own, a blank line before each, one blank line at most. Null is empty."""
    text = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), F.lit("　"), F.lit(" "))
    ends = lambda x: F.lit(SPACES).contains(F.substring(x, -1, 1))  # noqa: E731  a test that few lines pass
    rows = F.transform(F.split(text, "\n"), lambda x: F.when(ends(x), F.regexp_replace(x, f"{ANY_SPACE}+\\z", "")).otherwise(x))

    def apart(line: Column) -> Column:
        refers = F.substring(F.regexp_extract(line, EMBEDDED, 4), 1, 40).rlike(REFERENCE)
        lead = F.regexp_extract(line, EMBEDDED, 1)
        split = F.array(lead, F.substring(line, F.char_length(lead) + 1, F.char_length(line)))
        return F.when(line.rlike(EMBEDDED) & ~refers, split).otherwise(F.array(line))

    def blanks(ls: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            strong = stripped(x).rlike(STRONG) & ~x.rlike(REFERENCE) & (k > 0) & (stripped(F.get(ls, k - 1)) != "")
            return F.when(strong, F.array(F.lit(""), x)).otherwise(F.array(x))

        return F.flatten(F.transform(ls, one))

    def remade(t: Column) -> Column:
        made = F.array_join(st._bound(F.flatten(F.transform(F.split(t, "\n"), apart)), blanks), "\n")
        return F.when(t.contains("第") | t.contains("附則"), made).otherwise(t)  # other texts have no line that changes

    made = F.regexp_replace(st._bound(F.array_join(rows, "\n"), remade), "\n{3,}", "\n\n")
    return docs.select("doc_id", F.inline(F.transform(F.array(made), told)))  # a generator, so that filters above don't make the text again


def _value(kind: Column, heading: Column) -> Column:
    """Number of a heading; zero counts where the marker is digits alone."""
    digits = F.translate(F.regexp_extract(heading, f"^[（(]?([{_DIGITS}]+)", 1), "０１２３４５６７８９", "0123456789")
    named = numeral(F.regexp_extract(heading, f"^第([{_N}]+)", 1))
    kanji = numeral(F.regexp_extract(heading, "^[（(]([一二三四五六七八九十〇]+)", 1))
    plain = F.when(digits.rlike("^[0-9]{1,9}$"), digits.try_cast("int"))
    return F.when(kind.isin("japanese_chapter", "japanese_article", "japanese_section"), named).when(kind.isin("decimal_number", "numeric_dot", "numeric_paren"), plain).when(kind == "japanese_paren", kanji)


def scored(rows: DataFrame) -> DataFrame:
    """doc_id, start_char, heading, marker_type, value, score, indent, line_length, text_length of st.lines(): lines that can be headings. Indented ones and those that refer to a rule score less."""
    d = rows.withColumn("heading", F.regexp_replace("line", f"^{ANY_SPACE}+", "")).where(F.col("heading").rlike(f"^{STARTS}"))  # one test for most lines
    kind = F.coalesce(*[F.when(F.col("heading").rlike(pattern), F.lit(name)) for name, pattern, _, _ in RULES])
    n, h, t = F.char_length("heading"), F.col("heading"), F.col("marker_type")
    indent = F.char_length("line") - n
    stops = n - F.char_length(F.translate("heading", "。．", ""))
    score = (
        F.lit(3.0)
        + F.col("previous_blank").cast("double")
        + (n <= 40).cast("double")
        + F.when(t.isin("japanese_chapter", "japanese_article", "appendix"), 4.0).when(t == "japanese_section", 2.0).otherwise(0.0)
        + F.when(h.rlike("[（(][^）)\n]{1,30}[）)]"), 2.0).otherwise(0.0)
        + (~h.rlike("[。.．]\\z")).cast("double")
        + F.when(indent == 0, 1.0).when(indent <= 2, 0.5).otherwise(0.0)
        - F.when(h.rlike(REFERENCE), 4.0).otherwise(0.0)
        - F.when(n > 60, 2.0).otherwise(0.0)
        - F.when(stops >= 2, 2.0).otherwise(0.0)
        - F.when(h.rlike(r"https?://|@\w+\."), 3.0).otherwise(0.0)
    )
    d = d.withColumn("marker_type", kind).where((t.isNotNull()) & (n > 0) & (n <= LONGEST_HEADING))
    d = d.select("doc_id", "start_char", "heading", "marker_type", _value(t, h).alias("value"), score.alias("score"), indent.alias("indent"), n.alias("line_length"), "text_length")
    return d.where(F.col("score") >= LEAST_SCORE)


def statistics(candidates: DataFrame) -> DataFrame:
    """doc_id, marker_type, n, first_char, average_gap, median_gap, average_indent, average_line_length, sequence, shallow_indent, priority, text_length. A type that occurs once has the text's length as its gap."""
    w = Window.partitionBy("doc_id", "marker_type").orderBy("start_char")
    d = candidates.withColumn("gap", F.col("start_char") - F.lag("start_char").over(w))
    more = d.groupBy("doc_id", "marker_type").agg(
        F.coalesce(F.percentile("gap", F.lit(0.5)), F.first("text_length").cast("double")).alias("median_gap"),
        F.avg("indent").alias("average_indent"),
        F.avg("line_length").alias("average_line_length"),
        F.greatest(F.lit(0.0), 1.0 - F.avg("indent") / 10.0).alias("shallow_indent"),
    )
    return st.group_stats(candidates).withColumn("priority", st.by_type(PRIORITIES, 1)).join(more, ["doc_id", "marker_type"])


def leveled(candidates: DataFrame) -> DataFrame:
    """doc_id, marker_type, level, confidence, reason: types in the order of how far out they are.

    The score adds what a type holds, how often an inner type starts anew in it, its sequence, indent,
    the rules' order and gaps (of 6,000 characters at most). Types that occur once have their usual level and
    the score 0. ``reason`` has what went into it with four decimals; the confidence is made of these.
    """
    s = statistics(candidates)
    both = s.join(st.containment(candidates, s), ["doc_id", "marker_type"])
    score = F.col("containment") * 4.0 + F.col("reset") * 3.0 + F.col("sequence") + F.col("shallow_indent") * 1.5 + F.col("priority") / 12.0 * 1.5 + F.least(F.col("average_gap") / 3000.0, F.lit(2.0))
    d = both.withColumn("outer", F.when(F.col("n") >= LEAST_OF_TYPE, score))
    rank = F.row_number().over(Window.partitionBy("doc_id", F.col("outer").isNull()).orderBy(F.desc("outer"), "first_char"))
    level = F.least(F.lit(st.MAX_DEPTH), F.when(F.col("outer").isNotNull(), rank).otherwise(st.by_type(HINTS, 4)))
    part = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 4)
    reason = F.struct(part("outer").alias("type_outer_score"), part("containment").alias("containment_score"), part("reset").alias("reset_score"), part("sequence").alias("sequence_score"), part("shallow_indent").alias("shallow_indent_score"), F.col("priority").alias("fallback_priority"), F.col("outer").isNull().alias("fallback_used"))
    sure = F.col("reason.containment_score") * 0.4 + F.col("reason.sequence_score") * 0.3 + F.col("reason.reset_score") * 0.2 + F.col("reason.shallow_indent_score") * 0.1
    d = d.select("doc_id", "marker_type", level.cast("int").alias("level"), reason.alias("reason"))
    return d.select("doc_id", "marker_type", "level", F.bround(F.least(F.lit(1.0), sure), 4).alias("confidence"), "reason")


def tree(rows: DataFrame) -> DataFrame:
    """Sections of st.lines(): scored() and leveled(), end_char, parent_start, ``above`` (start_char and heading of each section that one lies in) and ``has_inner``."""
    c = cut(scored(rows))
    nodes = st.section_tree(c.join(leveled(c), ["doc_id", "marker_type"]))
    by = Window.partitionBy("doc_id").orderBy("start_char")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    last = {f"_{k}": F.last(F.when(F.col("level") == k, F.struct("start_char", "end_char", "heading")), ignorenulls=True).over(before) for k in range(1, st.MAX_DEPTH)}
    open_ones = F.array(*[F.when((F.col("level") > k) & (F.col(f"_{k}")["end_char"] > F.col("start_char")), F.col(f"_{k}")) for k in range(1, st.MAX_DEPTH)])
    above = F.transform(F.filter(open_ones, lambda x: x.isNotNull()), lambda x: F.struct(x["start_char"].alias("start_char"), x["heading"].alias("heading")))
    inner = F.coalesce(F.lead("level").over(by) > F.col("level"), F.lit(False))
    return nodes.withColumns(last).withColumns({"above": above, "has_inner": inner}).drop(*last)


def _sized(nodes: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """``nodes`` with ``size`` (characters of a section without white space at its ends), ``room`` (what ``most`` leaves beside its own lines) and ``form``.

    A section is whole if it fits, parts if it is too long and has none inside, groups if it has, and open if its own
    lines leave no room: then its sections are chunks as if it weren't there. Sections in others than open ones have no form.
    """
    ends = placed.where("line <> ''").groupBy("doc_id", F.col("segment").alias("start_char")).agg(F.max(F.col("at") + F.char_length("line")).alias("text_end"))
    by = Window.partitionBy("doc_id").orderBy("start_char")
    d = cut(nodes.join(ends, ["doc_id", "start_char"]))
    stop = d.select("doc_id", F.col("start_char").alias("end_char"), F.lag("text_end").over(by).alias("last_end"))
    final = F.max("text_end").over(Window.partitionBy("doc_id"))
    d = d.withColumn("final", final).join(stop, ["doc_id", "end_char"], "left")
    first = F.col("start_char") + F.col("indent")
    d = d.withColumns({"size": F.coalesce("last_end", "final") - first, "room": F.lit(most) - (F.col("text_end") - first + 1)})
    form = F.when(F.col("size") <= most, "whole").when(~F.col("has_inner"), "parts").when(F.col("room") > 0, "groups").otherwise("open")
    d = d.withColumn("form", form)
    covered = F.max(F.when(F.col("form") != "open", F.col("end_char"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("form", F.when(F.coalesce(covered, F.lit(0)) <= F.col("start_char"), F.col("form"))).drop("final", "last_end", "text_end")


def metadata(c: dict[str, Column]) -> dict[str, Column]:
    """The nineteen columns of a chunk. A builder of one's own takes the same columns (parent_id, root_title, level, heading, ... as columns of the chunk) and returns others."""
    role = F.when(c["heading_type"] == "paragraph", "fallback").when(c["level"] == 1, "parent").when(c["level"] == 2, "main").otherwise("child")
    return {
        "chunk_id": c["chunk_id"],
        "parent_id": c["parent_id"],
        "root_id": short_hash("doc_", c["root_title"]),
        "children_ids": F.array().cast("array<string>"),
        "level": c["level"],
        "chunk_role": role,
        "heading": c["heading"],
        "heading_type": c["heading_type"],
        "path": c["path"],
        "path_text": F.array_join(c["path"], " > "),
        "ordinal": c["ordinal"],
        "start_char": c["start_char"],
        "end_char": c["end_char"],
        "source_type": F.lit("txt"),
        "chunking_strategy": F.lit(STRATEGY),
        "structure_confidence": c["confidence"],
        "inference_reason": c["reason"],
        "split_index": c["split_index"],
        "split_total": c["split_total"],
    }


_KNOWN = ("parent_id", "level", "heading", "heading_type", "path", "ordinal", "start_char", "end_char", "confidence", "reason")


def structure_chunks_v2(docs: DataFrame, most: int = 1000, builder: Callable[[dict[str, Column]], dict[str, Column]] = metadata) -> DataFrame:
    """doc_id, chunk_index, chunk_text and the columns of ``builder``.

    A section that fits is one chunk with everything inside. A larger one gives its sections in groups of
    nearly equal size (_s0, _s1, ...), each after its own lines; sections too long for the room are split evenly, as is
    a section without others (_p0, _p1, ...). Text before the first heading and sections of under ten characters give
    none. Documents without headings give paragraphs, those without any chunk their text or (empty), blank and null texts nothing.
    """
    # most texts have no line that begins as a heading does: their lines are never rows
    may = lambda t: t.rlike(f"(^|\n){ANY_SPACE}*+{STARTS}").alias("may")
    title = lambda t: stripped(F.substring_index(F.ltrim(t, F.lit(SPACES)), "\n", 1)).alias("root_title")
    told = prepared(docs, lambda t: F.struct(t.alias("text"), title(t), may(t), blank(t).alias("blank")))
    fixed = cut(told.where("NOT blank AND doc_id IS NOT NULL").drop("blank"))
    known, titles = fixed.where("may").drop("may"), fixed.where("may").groupBy("doc_id").agg(F.min("root_title").alias("root_title"))
    rows = st.lines(known)
    nodes = cut(tree(rows))
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    heads = nodes.select("doc_id", "start_char", F.lit(True).alias("opens"))
    segment = F.last(F.when(F.col("opens"), F.col("start_char")), ignorenulls=True).over(by_line)
    lines = rows.join(heads, ["doc_id", "start_char"], "left").withColumn("segment", segment)
    lines = cut(lines.select("doc_id", "line_no", "line", F.col("start_char").alias("at"), "segment"))
    sized = cut(_sized(nodes, lines.where("segment IS NOT NULL"), most))

    # the chunk that each line's section goes to, and the part of it: the section itself or one directly inside
    by = Window.partitionBy("doc_id").orderBy("start_char")
    owner = F.last(F.when(F.col("form") != "open", F.struct("start_char", "end_char", "form")), ignorenulls=True).over(by)
    owned = sized.withColumn("o", owner).where("o.end_char > start_char").withColumn("owner", F.col("o.start_char"))
    unit = F.last(F.when((F.col("o.form") == "groups") & (F.col("parent_start") == F.col("owner")), F.col("start_char")), ignorenulls=True)
    units = owned.select("doc_id", "owner", F.col("start_char").alias("segment"), F.coalesce(unit.over(Window.partitionBy("doc_id", "owner").orderBy("start_char")), F.lit(-1)).alias("unit"))
    joined = stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"))
    texts = lines.join(units, ["doc_id", "segment"]).groupBy("doc_id", "owner", "unit").agg(joined.alias("text"))
    texts = texts.groupBy("doc_id", F.col("owner").alias("start_char")).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda x: x["text"]).alias("texts"))
    section = lambda start, heading: short_hash("chunk_sec_", F.concat_ws("|", start.cast("string"), heading))
    root = section(F.lit(0), F.col("root_title"))
    up = F.get("above", F.size("above") - 1)
    made = sized.where((F.col("form") != "open") & (F.col("size") >= LEAST_TEXT)).join(texts, ["doc_id", "start_char"]).join(titles, "doc_id").select(
        "doc_id", "root_title", "texts", "form", "room", section(F.col("start_char"), F.col("heading")).alias("base_id"),
        F.when(F.size("above") > 0, section(up["start_char"], up["heading"])).otherwise(root).alias("parent_id"), "level", "heading", F.col("marker_type").alias("heading_type"),
        F.concat(F.array("root_title"), F.transform("above", lambda x: x["heading"]), F.array("heading")).alias("path"), F.col("value").alias("ordinal"), "start_char", "end_char", "confidence", F.to_json("reason").alias("reason"))

    other = fixed.where("NOT may").drop("may")
    bare = other.unionByName(known.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti"))
    loose = paragraphs(bare, keep=("root_title",)).where(F.char_length(stripped(F.col("text"))) >= LEAST_TEXT).select(
        "doc_id", "root_title", F.array(stripped(F.col("text"))).alias("texts"), F.lit("parts").alias("form"), F.lit(most).alias("room"), section(F.col("start_char"), F.substring("text", 1, 40)).alias("base_id"),
        root.alias("parent_id"), F.lit(1).alias("level"), F.lit("").alias("heading"), F.lit("paragraph").alias("heading_type"), F.array(F.col("root_title"), F.lit("")).alias("path"), F.col("paragraph").alias("ordinal"),
        F.col("start_char").cast("int").alias("start_char"), (F.col("start_char") + F.char_length("text")).cast("int").alias("end_char"), F.lit(0.3).alias("confidence"), F.lit('{"fallback":"paragraph"}').alias("reason"))
    made = cut(made.unionByName(loose))

    firsts = nodes.groupBy("doc_id").agg(F.min("start_char").alias("first_char"))
    small = other.where(~F.exists(F.split("text", r"\n{2,}"), lambda p: F.char_length(stripped(p)) >= LEAST_TEXT))
    none = known.join(made.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(small).join(firsts, "doc_id", "left")
    lead = stripped(F.substring("text", F.lit(1), F.coalesce("first_char", F.char_length("text"))))
    alone = none.select("doc_id", "root_title", F.array(F.when(lead == "", "(empty)").otherwise(lead)).alias("texts"), F.lit("whole").alias("form"), F.lit(most).alias("room"), root.alias("base_id"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.col("root_title").alias("heading"), F.lit("document_root").alias("heading_type"), F.array("root_title").alias("path"), F.lit(None).cast("int").alias("ordinal"),
        F.lit(0).alias("start_char"), F.char_length("text").alias("end_char"), F.lit(1.0).alias("confidence"), F.lit("{}").alias("reason"))
    every = made.unionByName(alone)

    own = F.get("texts", F.lit(0))
    parts = F.when(F.col("form") == "whole", F.array(own)).otherwise(even_parts(own, most))
    counted = st._bound(parts, lambda ps: F.transform(ps, lambda x: F.struct(x.alias("text"), F.size(ps).alias("total"))))
    simple = every.where("form <> 'groups'").select("*", F.posexplode(counted).alias("split_index", "part"))
    simple = simple.withColumns({"split_total": F.col("part.total"), "chunk_text": F.col("part.text")}).drop("part")
    items = F.flatten(F.transform(F.slice("texts", F.lit(2), F.size("texts")), lambda x: even_parts(x, F.col("room"))))
    grouped = every.where("form = 'groups'").withColumn("items", items)
    numbered = F.arrays_zip(F.col("items").alias("item"), balanced_groups(F.transform("items", lambda x: (F.char_length(x) + 1).cast("long")), F.col("room")).alias("group"))
    grouped = grouped.withColumn("numbered", numbered)
    bodies = grouped.select("doc_id", "start_char", F.posexplode("numbered").alias("at", "x")).groupBy("doc_id", "start_char", F.col("x.group").cast("int").alias("split_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x.item"))), lambda x: x["item"]), "\n").alias("body"))
    total = (F.array_max(F.transform("numbered", lambda x: x["group"])) + 1).cast("int")
    grouped = grouped.withColumns({"split_total": total, "lead": own}).drop("items", "numbered").join(bodies, ["doc_id", "start_char"])
    grouped = grouped.withColumn("chunk_text", stripped(F.concat("lead", F.lit("\n"), "body"))).drop("lead", "body")
    out = simple.unionByName(grouped)
    mark = F.when(F.col("form") == "groups", "_s").otherwise("_p")
    chunk_id = F.when(F.col("split_total") > 1, F.concat("base_id", mark, F.col("split_index").cast("string"))).otherwise(F.col("base_id"))
    columns = builder({"chunk_id": chunk_id, "root_title": F.col("root_title"), "split_index": F.col("split_index"), "split_total": F.col("split_total")} | {k: F.col(k) for k in _KNOWN})
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char", "split_index")) - 1
    return out.select("doc_id", index.alias("chunk_index"), "chunk_text", *[v.alias(k) for k, v in columns.items()])


def level_report(chunks: DataFrame) -> DataFrame:
    """heading_type, level, chunk_role, chunks, chars, confidence (mean), fallback_used: what the chunks of all documents are."""
    used = F.coalesce(F.get_json_object("inference_reason", "$.fallback_used") == "true", F.lit(False))
    return chunks.groupBy("heading_type", "level", "chunk_role").agg(F.count("*").alias("chunks"), F.sum(F.char_length("chunk_text")).alias("chars"), F.round(F.avg("structure_confidence"), 4).alias("confidence"), F.max(used).alias("fallback_used"))


def printed_tree(docs: DataFrame) -> DataFrame:
    """doc_id, start_char, line: each section as an indented line with its level and type."""
    fixed = cut(prepared(docs).where(stripped(F.col("text")) != ""))
    depth = F.size("above") + 1
    label = F.concat(F.repeat(F.lit("  "), depth), F.lit("[L"), F.col("level").cast("string"), F.lit(":"), "marker_type", F.lit("] "), F.substring("heading", 1, 60))
    return tree(st.lines(fixed)).select("doc_id", "start_char", label.alias("line"))
