"""Fill-in-middle transformation (operator 11) by Arrow-batched pandas UDFs.

A text is cut into units: white space with the word after it, or white space alone at the end. Two
numbers from a digest of the document's id choose where a prefix and a middle end; a third says
whether the text stays plain, a fourth which of two orders the marked parts take. Unit ends are held as
one compact array of offsets a text, so time and memory are in proportion to it, and every choice depends on the
row alone: there is no shuffle, and a task that is run again gives the same rows.

Rows: a null text is taken for an empty one, and both stay plain, as do texts that hold a marker;
a null id is hashed like an empty one; repeated rows each give a row, the same one; an empty table gives
an empty table; extra columns are ignored, whatever their names. Very long texts are cut whole.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, id_and_text

UNIT = regex.compile(rf"{SPACES}*{WORD}|{SPACES}+")
FORMED = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Markers:
    """Marks of the parts. All begin by one character that is nowhere else in them, so that no other mark can arise where parts and marks meet."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        all_ = (self.prefix, self.suffix, self.middle)
        if not all(all_) or any(m[0] != all_[0][0] or m[0] in m[1:] for m in all_):
            raise ValueError("markers begin by one character that is nowhere else in them")
        if any(a.startswith(b) for k, a in enumerate(all_) for j, b in enumerate(all_) if j != k):
            raise ValueError("no marker begins by another")

    def inside(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


def unit_ends(text: str) -> array:
    """Offset of each unit's end, after a first 0, in code points."""
    return array("Q", [0, *(m.end() for m in UNIT.finditer(text))])


def choices(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers under 2**32 from a digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(doc_id: int | None, text: str | None, seed: int, percent: int, spm_percent: int, markers: Markers) -> tuple:
    """The values of FORMED for a text."""
    text = text or ""
    ends = unit_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = choices(doc_id, seed)
    if not text or markers.inside(text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[a], ends[b]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{markers.suffix}{suffix}{markers.prefix}{prefix}{markers.middle}{middle}"
    return n, "psm", a, b - a, f"{markers.prefix}{prefix}{markers.suffix}{suffix}{markers.middle}{middle}"


def restore(output: str, form: str, markers: Markers = Markers()) -> str:
    """The exact text again: no part holds a marker, and none can arise where parts meet."""
    if form == "plain":
        return output
    head, middle = output.split(markers.middle)
    if form == "spm":
        suffix, prefix = head[len(markers.suffix) :].split(markers.prefix)
    else:
        prefix, suffix = head[len(markers.prefix) :].split(markers.suffix)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, markers: Markers = Markers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: ``percent`` of the documents rearranged, of these ``spm_percent`` with the suffix first."""

    @F.pandas_udf(FORMED)
    def formed(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(None if pd.isna(i) else int(i), t, seed, percent, spm_percent, markers) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # ids as text: a null among numbers would turn them into floating-point ones
    rows = id_and_text(docs, id_col, text_col).select("doc_id", formed(F.col("doc_id").cast("string"), "text").alias("f"))
    return rows.select("doc_id", "f.*")


def restored(formed: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``formed`` with ``restored``: the exact text from output and form alone."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f, markers) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return formed.withColumn("restored", back("output", "form"))


def digests(formed: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``formed`` with output_sha256 and restored_sha256 in place of the texts."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def hashed(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda t: hashlib.sha256(t.encode("utf-8")).hexdigest()
        return pd.DataFrame([(sha(o), sha(restore(o, f, markers))) for o, f in zip(outputs, forms, strict=True)], columns=["output_sha256", "restored_sha256"])

    names = [c for c in formed.columns if c != "output"]
    return formed.withColumn("_sha", hashed("output", "form")).select(*names, "_sha.*")
