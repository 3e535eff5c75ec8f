"""Text functions as Column expressions: normalising, ids, cells, Markdown and numerals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters between which Japanese text has no inner space or line break.
GLUE = r"぀-ゟ゠-ヿ㐀-䶿一-鿿0-9０-９ｦ-ﾟㇰ-ㇿ、-〃〈-】《》【】（）［］｛｝・·"
KEEP_BREAK_AFTER = r"。.．,、!?！？)）」』…"
ZERO_WIDTH = "​‌‍⁠﻿"
#: White space that Python's str.isspace() knows, besides space, U+3000, line feed, return and tab.
OTHER_SPACES = r"\x0b\x0c\x1c-\x1f\x85   -     "
BLANKS = r"[ \t　\x0b\x0c\r\x1c-\x1f\x85   -     ]"
ANY_SPACE = r"[\s\x1c-\x1f\x85　   -     ]"


SPACES = "".join(chr(c) for c in range(1 << 16) if re.match(ANY_SPACE, chr(c), re.ASCII))


def stripped(c: Column) -> Column:
    """Without white space at both ends, as Python's str.strip()."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """Whether nothing but white space is in a text: the first other character ends the search."""
    return ~c.rlike(f"[^{ANY_SPACE[1:]}")


_OTHERS = "".join(chr(c) for c in range(1 << 16) if re.match(f"[{OTHER_SPACES}]", chr(c)))


def unified_spaces(c: Column) -> Column:
    """Zero-width characters go, unusual white space becomes a space."""
    return F.translate(c, _OTHERS + ZERO_WIDTH, " " * len(_OTHERS))


def closed_spaces(c: Column) -> Column:
    """Without spaces between glue characters. Numbers in between are glue themselves, so one pass of the look-around rule reaches the fixed point."""
    return F.regexp_replace(c, f"(?![!-~])(?={BLANKS})(?<=[{GLUE}\n]){BLANKS}+(?=[{GLUE}\n])", "")  # the rare test first


def joined_breaks(c: Column) -> Column:
    """Without single line breaks between glue characters, but after punctuation."""
    return F.regexp_replace(c, f"\n(?<=[{GLUE}]\n)(?<![{KEEP_BREAK_AFTER}]\n)(?!\n)(?=[{GLUE}])", "")


def normalised(c: Column) -> Column:
    c = F.regexp_replace(unified_spaces(c), "[ \t]{2,}|\t", " ")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return stripped(joined_breaks(closed_spaces(c)))


def doc_key(source: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(source, 256), 1, 16)


def short_hash(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 8))


def record_key(chunk_id: Column, variant: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(variant, "[^0-9A-Za-z_.-]+", "_"), "^_+|_+$", "")
    return F.concat(chunk_id, F.lit("::vector::"), F.when(safe == "", F.lit("vector")).otherwise(safe))


def upload_source(path: Column) -> Column:
    return F.concat(F.lit("uploaded/"), F.element_at(F.split(path, "/"), -1))


def query_tokens(q: Column) -> Column:
    """One lower-cased token, or none for a blank query."""
    t = F.lower(stripped(F.coalesce(q, F.lit(""))))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))


def snippet(c: Column, most: int = 800) -> Column:
    t = stripped(F.translate(c, "\r\n", "  "))
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def truncated(c: Column, most: int = 1200) -> Column:
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("…(truncated)")))


def _lines(c: Column, change) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), change), "\n")


def markdown_plain(c: Column) -> Column:
    """Search text of Markdown: without heading, list and quote marks, backticks and emphasis."""

    def line(s: Column) -> Column:
        for pattern in (r"^\s{0,3}#{1,6}\s+", r"^\s*[-*+]\s+", r"^\s*>\s?"):
            s = F.regexp_replace(s, pattern, "")
        for mark in ("`", "**", "__"):
            s = F.replace(s, F.lit(mark), F.lit(""))
        return s

    return stripped(_lines(c, line))


def without_headings(c: Column) -> Column:
    return stripped(F.array_join(F.filter(F.split(c, "\n"), lambda s: ~s.rlike(r"^\s*#{1,2}\s+")), "\n"))


def demoted(c: Column) -> Column:
    """Fourth-level headings become list items where the text has no list item."""
    return F.when(c.rlike("(?m)^- "), c).otherwise(F.regexp_replace(c, "(?m)^#### ", "- "))


def without_prefixes(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^(?:#{1,4}|-) ", "")


def with_input_prefix(c: Column, kind: Column) -> Column:
    """Prefix that the embedding model expects for documents and for queries."""
    return F.when(kind == "document", F.concat(F.lit("文章: "), c)).when(kind == "query", F.concat(F.lit("クエリ: "), c)).otherwise(c)


def numeral(c: Column) -> Column:
    """Integer of ASCII, full-width or kanji digits up to 千; zero, mixed and unknown forms give null."""
    ascii_digits = F.translate(c, "０１２３４５６７８９", "0123456789")
    plain = F.when(ascii_digits.rlike("^[0-9]{1,9}$"), ascii_digits.try_cast("int"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("now"))

    def step(s: Column, ch: Column) -> Column:
        value = F.coalesce(*[F.when(ch == k, F.lit(v)) for k, v in zip("一二三四五六七八九", range(1, 10), strict=True)])
        unit = F.coalesce(*[F.when(ch == k, F.lit(v)) for k, v in (("十", 10), ("百", 100), ("千", 1000))])
        scaled = F.struct((s["sum"] + F.when(s["now"] == 0, 1).otherwise(s["now"]) * unit).alias("sum"), F.lit(0).alias("now"))
        return F.when(unit.isNotNull(), scaled).when(value.isNotNull(), F.struct(s["sum"].alias("sum"), value.alias("now")))

    kanji = F.aggregate(F.split(c, ""), zero, step, lambda s: s["sum"] + s["now"])
    return F.when(plain.isNotNull(), F.nullif(plain, F.lit(0))).when(c.rlike("^[一二三四五六七八九十百千]+$"), F.nullif(kanji, F.lit(0)))
