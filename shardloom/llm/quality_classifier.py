"""Quality classifier (operator 9): a generalised additive model with pairwise interactions.

Features are measured once per whole text in Arrow batches and written to the shared folder, a few
numbers a row. The model is fitted in numpy on a bounded sample of labelled rows: boosting goes
around the features in turn and adds a shallow tree's values to the feature's lookup table, then
does the same over pairs of features. A score is the sum of table entries at a text's bins.

Labels are never features; nor are language, source or id.

Rows: null or empty text has all features 0 and is scored like others; a null id is kept and is never in
the sample; repeated rows each give a row; an empty table gives an empty table; without labels of
both classes the score is the share of good labels (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, id_and_text, in_slices, staged

FEATURES = ("log_words", "capitals", "symbols", "exclamations", "pipes", "digits", "distinct_words", "word_echo", "top_word", "word_length", "repeated_lines", "line_words", "stops", "long_words", "wide_bytes", "repeated_pairs")
_ZEROS = (0.0,) * len(FEATURES)
#: Rows of the fit, about and at most, taken by a hash.
SAMPLE_ROWS = 40_000


def features_of(text: str | None) -> tuple[float, ...]:
    """Numbers that describe a whole text; time and memory are in proportion to it."""
    if not text:
        return _ZEROS
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return _ZEROS
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(chars[65:91].sum() + chars[97:123].sum())
    inside = max(1, sum(map(len, words)))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [s for s in raw.split(b"\n") if s.strip()]
    symbols = int(sum(chars[b] for b in b"#*$%&<>"))
    return (
        float(np.log1p(n)),
        int(chars[65:91].sum()) / max(1, letters),
        symbols / n,
        int(chars[33]) / n,
        int(chars[124]) / n,
        int(chars[48:58].sum()) / inside,
        len(counts) / n,
        echo / n,
        max(counts.values()) / n,
        inside / n,
        1 - len(set(lines)) / len(lines),
        min(1000.0, n / len(lines)),
        int(chars[46] + chars[44]) / n,
        sum(len(w) > 24 for w in words) / n,
        int(chars[128:].sum()) / inside,
        1 - pairs / (n - 1) if n > 1 else 0.0,
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and a column for each of FEATURES. One pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((f, pa.float64()) for f in FEATURES)])

    def run(batches):
        for batch in in_slices(batches):
            (texts,) = columns_of(batch, "text")
            x = np.array([features_of(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], schema=schema)

    return id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{f} double" for f in FEATURES))


class AdditiveModel:
    """Bin edges, a table per feature and a table per pair; picklable and small."""

    def __init__(self, bins: int = 48, coarse: int = 12, pairs: int = 8, rounds: int = 250, rate: float = 0.08):
        self.bins, self.coarse, self.n_pairs, self.rounds, self.rate = bins, coarse, pairs, rounds, rate

    def _grid(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 5.0) -> np.ndarray:
        """A shallow tree over ordered bins by gradient and hessian sums: the best cut is taken until there are enough leaves. Gives a value per bin."""
        spans, (cg, ch) = [(0, len(g))], (np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)]))
        score = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        while len(spans) < leaves:
            best, at = 1e-9, None
            for s, (a, b) in enumerate(spans):
                if b - a > 1:
                    cuts = np.arange(a + 1, b)
                    gain = score(a, cuts) + score(cuts, b) - score(a, b)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, at = gain[k], (s, int(cuts[k]))
            if at is None:
                break
            a, b = spans[at[0]]
            spans[at[0] : at[0] + 1] = [(a, at[1]), (at[1], b)]
        out = np.zeros(len(g))
        for a, b in spans:
            out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.edges, self.coarse_edges = self._edges(x, self.bins) if len(x) else [np.zeros(0)] * x.shape[1], self._edges(x, self.coarse) if len(x) else [np.zeros(0)] * x.shape[1]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if len(y) == 0 or y.min() == y.max():
            return self
        grid, wide = self._grid(x, self.edges), self._grid(x, self.coarse_edges)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, table in enumerate(self.tables):
                if len(table) > 1:
                    p = 1 / (1 + np.exp(-f))
                    step = self.rate * self._tree(np.bincount(grid[:, k], p - y, len(table)), np.bincount(grid[:, k], p * (1 - p), len(table)))
                    table += step
                    f += step[grid[:, k]]
        self._fit_pairs(wide, y, f)
        return self

    def _fit_pairs(self, wide: np.ndarray, y: np.ndarray, f: np.ndarray) -> None:
        """Pairs with the most left to explain, by the gain of one table step each, then boosted in turn."""
        sizes = [len(e) + 1 for e in self.coarse_edges]
        cells = lambda i, j: wide[:, i] * sizes[j] + wide[:, j]
        p = 1 / (1 + np.exp(-f))

        def sums(c: np.ndarray, n: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.bincount(c, p - y, n), np.bincount(c, p * (1 - p), n)

        gains = []
        for i, j in combinations(range(len(sizes)), 2):
            if sizes[i] > 1 and sizes[j] > 1:
                g, h = sums(cells(i, j), sizes[i] * sizes[j], p)
                gains.append((float((g * g / (h + 5.0)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros(sizes[i] * sizes[j]) for i, j in self.pairs]
        for _ in range(self.rounds // 4):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                c = cells(i, j)
                g, h = sums(c, len(table), 1 / (1 + np.exp(-f)))
                g2, h2 = g.reshape(sizes[i], sizes[j]), h.reshape(sizes[i], sizes[j])
                rows = self._tree(g2.sum(1), h2.sum(1), leaves=2)  # a tree of two levels: a cut of one feature, then of the other in each half
                step = np.zeros_like(g2)
                for value in np.unique(rows):
                    half = rows == value
                    step[half] = self._tree(g2[half].sum(0), h2[half].sum(0), leaves=2)
                step = self.rate * step.ravel()
                table += step
                f += step[c]

    def score(self, x: np.ndarray) -> np.ndarray:
        grid, wide = self._grid(x, self.edges), self._grid(x, self.coarse_edges)
        f = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            f += table[grid[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            f += table[wide[:, i] * (len(self.coarse_edges[j]) + 1) + wide[:, j]]
        return 1 / (1 + np.exp(-f))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


HASHES = 1 << 56


def sample_below(rows: int, sample_rows: int) -> int:
    """Hashes under this number make a sample of a little less than ``sample_rows`` of ``rows`` rows; above 0 up to 10**20 rows."""
    return HASHES * 97 * sample_rows // (100 * rows)


def fit(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fits on distinct labelled rows that aren't held out, ``sample_rows`` of them at most by a hash of id and features.

    A document with several labels counts as good if most are. Only the sample reaches the driver.
    """
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("_label"))
    train = measured.where(~held_out()).join(known, "doc_id")
    train = train.select("doc_id", "_label", *FEATURES).distinct()  # repeated rows count once, so that no id can fill the sample
    n = train.count()
    if n > sample_rows:  # a share by hash, a little under the limit, so that no task has to sort or gather what others chose
        train = train.where(F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(HASHES)) < sample_below(n, sample_rows))
    rows = train.select("doc_id", "_label", *FEATURES).toArrow().sort_by([("doc_id", "ascending"), *((f, "ascending") for f in FEATURES)])
    columns = [rows.column(f).to_numpy() for f in FEATURES]
    return AdditiveModel().fit(np.stack(columns, axis=1) if len(rows) else np.zeros((0, len(FEATURES))), rows.column("_label").to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and text_hash to tell rows with one id apart, for each row of ``docs``."""
    measured = staged(measure(docs, id_col, text_col), "quality-features")
    model = measured.sparkSession.sparkContext.broadcast(fit(measured, labels, sample_rows))

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), batch.column("text_hash")], names=["doc_id", "held_out", "score", "predicted", "text_hash"])

    return measured.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, text_hash long")


def good_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that quality_scores() predicts 1 for, with all their columns.

    Texts are measured again beside the model: a verdict that came by a join would shuffle every text.
    """
    measured = staged(measure(docs, id_col, text_col), "quality-features")
    model = measured.sparkSession.sparkContext.broadcast(fit(measured, labels, sample_rows))

    def good(texts: pa.Array) -> pa.Array:
        x = [features_of(t) for at in range(0, len(texts), 512) for t in texts.slice(at, 512).to_pylist()]  # as in in_slices()
        return pa.array(model.value.score(np.array(x, np.float64).reshape(-1, len(FEATURES))) >= 0.5)

    return docs.where(F.arrow_udf(good, "boolean")(F.col(f"`{text_col}`").cast("string")))
