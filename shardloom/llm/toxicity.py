"""Toxicity (operator 13): a factorization machine over hashed terms.

A text's terms are its words (runs of letters and digits, lower-cased) and their beginnings of
PREFIXES bytes, hashed into BUCKETS; each distinct bucket counts once, with value ``scale / sqrt(n)`` for
a text with ``n`` buckets that the machine knows. The machine scores a weight per bucket plus the product of the factors of every pair of
buckets, in time linear in ``n``, so that words that harm only together weigh only together. It is
fitted in numpy on a bounded sample of labelled rows and sent to all tasks: its size is fixed.

Labels are never features; nor are language, source or id. The score is the probability of label 1.

Rows: null or empty text has no terms and the score of the bias alone; a null id is kept and is never
in the sample; repeated rows each give a row and count once in the sample; an empty table gives an
empty table; without labels of both classes every score is the share of label 1 (0 without labels);
extra columns are ignored, whatever their names. A very long text is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, staged

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 8)
#: The fit's sample of labelled rows, taken by a hash: about so many rows and bytes of text at most.
SAMPLE_ROWS = 24_000
SAMPLE_BYTES = 64 << 20
#: Bytes that are hashed at a time, so that memory stays in proportion to this, not to a batch.
BLOCK_BYTES = 1 << 20
HASHES = 1 << 56

_LETTERS = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


_held_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, at least ``n`` of each; made once a worker."""
    if not _held_powers or len(_held_powers[0][0]) < n:
        _held_powers[:] = [_new_powers(max(n, BLOCK_BYTES))]
    return _held_powers[0]


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * int(_BASE)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) % np.uint64(BUCKETS)


def _hashed(raw: bytes, owners: np.ndarray) -> np.ndarray:
    """Distinct (owner << 18 | bucket) of a block; ``owners`` says which text each byte belongs to. Words end where the owner changes."""
    b = np.frombuffer(raw, np.uint8)
    inside = _LETTERS[b]
    edge = np.empty(len(b) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = (inside[1:] != inside[:-1]) | (owners[1:] != owners[:-1])
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    word = inside[starts]
    starts, ends = starts[word], ends[word]
    if not len(starts):
        return np.zeros(0, np.int64)
    up, down = _powers(len(b))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
        of = lambda s, e: (sums[e] - sums[s]) * down[s]
        found = [(owners[starts].astype(np.int64) << 18) | _mixed(of(starts, ends), 0).astype(np.int64)]
        for n in PREFIXES:
            s = starts[ends - starts >= n]
            found.append((owners[s].astype(np.int64) << 18) | _mixed(of(s, s + n), n).astype(np.int64))
    return np.unique(np.concatenate(found))


def _pieces(raw: bytes) -> list[bytes]:
    """``raw`` in pieces of about BLOCK_BYTES, cut where a word ends; a longer word stays whole."""
    if len(raw) <= BLOCK_BYTES:
        return [raw]
    gaps = np.flatnonzero(~_LETTERS[np.frombuffer(raw, np.uint8)])
    out, begin = [], 0
    while len(raw) - begin > BLOCK_BYTES:
        k = np.searchsorted(gaps, begin + BLOCK_BYTES, side="right") - 1
        if k < 0 or gaps[k] <= begin:
            k = np.searchsorted(gaps, begin + BLOCK_BYTES)
            if k == len(gaps):
                break
        out.append(raw[begin : gaps[k]])
        begin = int(gaps[k])
    return [*out, raw[begin:]]


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts, one after another and rising in each, and where each text's begin (one more entry than texts)."""
    parts: list[np.ndarray] = []
    block: list[bytes] = []
    owners: list[int] = []
    held, cut = 0, False

    def flush() -> None:
        nonlocal held
        if held:
            parts.append(_hashed(b"".join(block), np.repeat(np.array(owners, np.int64), [len(r) for r in block])))
        block.clear()
        owners.clear()
        held = 0

    for k, text in enumerate(texts):
        pieces = _pieces(text.lower().encode("utf-8", "surrogatepass")) if text else []
        cut = cut or len(pieces) > 1
        for raw in pieces:
            if held + len(raw) > BLOCK_BYTES:
                flush()
            block.append(raw)
            owners.append(k)
            held += len(raw)
    flush()
    keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if cut:
        keys = np.unique(keys)
    return (keys & (BUCKETS - 1)).astype(np.int32), np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << 18)


class FactorizationMachine:
    """score = sigmoid(bias + sum of w[i] x[i] + sum over pairs of <v[i], v[j]> x[i] x[j]); picklable, of fixed size.

    Buckets that fewer than ``least`` texts have, or that label 1 has about as often as chance would (less than
    ``z`` standard deviations off), have no parameters; a pair is learned where both of its terms have. AdaGrad in batches of texts learns the rest.
    """

    def __init__(self, factors: int = 8, passes: int = 20, rate: float = 0.1, ridge: float = 1e-4, least: int = 5, z: float = 4.0, scale: float = 3.0, batch: int = 256, seed: int = 13):
        self.factors, self.passes, self.rate, self.ridge, self.least, self.z, self.scale, self.batch, self.seed = factors, passes, rate, ridge, least, z, scale, batch, seed
        self.bias, self.place = 0.0, np.full(BUCKETS, -1, np.int32)
        self.w, self.v = np.zeros(0, np.float32), np.zeros((0, factors), np.float32)

    def screen(self, seen: np.ndarray, bad: np.ndarray, texts: int, toxic: int) -> FactorizationMachine:
        """Chooses the buckets that have parameters, from how many texts and toxic texts have each bucket."""
        share = toxic / texts if texts else 0.0
        self.bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (-60.0, 60.0)[share == 1]
        spread = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / max(1, texts)), 1e-9))
        used = np.flatnonzero((seen >= self.least) & (np.abs(bad - seen * share) >= self.z * spread)) if 0 < share < 1 else np.zeros(0, np.int64)
        self.place[used] = np.arange(len(used), dtype=np.int32)
        return self

    def places(self, buckets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known buckets, and where each text's begin."""
        at = self.place[buckets]
        known = at >= 0
        return at[known], np.concatenate([[0], np.cumsum(known)])[starts]

    def _values(self, starts: np.ndarray) -> np.ndarray:
        return (self.scale / np.sqrt(np.maximum(np.diff(starts), 1))).astype(np.float32)

    @staticmethod
    def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of the rows of each text; 0 for texts without any."""
        out = np.zeros((len(starts) - 1, *x.shape[1:]), np.float64)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            out[some] = np.add.reduceat(x, starts[some], axis=0, dtype=np.float64)
        return out

    def _raw(self, at: np.ndarray, starts: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.v[at]
        total = self._sums(v, starts) * value[:, None]
        squares = self._sums((v * v).sum(1), starts) * value**2
        return self.bias + self._sums(self.w[at], starts) * value + 0.5 * ((total * total).sum(1) - squares), total, v

    def fit(self, buckets: np.ndarray, starts: np.ndarray, y: np.ndarray) -> FactorizationMachine:
        """screen() and train() on texts' buckets."""
        seen, bad = np.bincount(buckets, minlength=BUCKETS), np.bincount(buckets, np.repeat(y, np.diff(starts)), minlength=BUCKETS)
        self.screen(seen, bad, len(y), int(y.sum()))
        return self.train(*self.places(buckets, starts), y)

    def train(self, at: np.ndarray, starts: np.ndarray, y: np.ndarray) -> FactorizationMachine:
        """Learns the parameters from the places of texts' buckets."""
        size = int(self.place.max()) + 1
        rng = np.random.default_rng(self.seed)
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, self.factors)).astype(np.float32)
        if not size:
            return self
        gw, gv, gb = np.full(size, 1e-4, np.float32), np.full((size, self.factors), 1e-4, np.float32), 1.0
        value = self._values(starts)
        for _ in range(self.passes):
            order = rng.permutation(len(y))
            for a in range(0, len(y), self.batch):
                rows = order[a : a + self.batch]
                sizes = starts[rows + 1] - starts[rows]
                own = np.concatenate([[0], np.cumsum(sizes)])
                idx = at[np.repeat(starts[rows] - own[:-1], sizes) + np.arange(own[-1])]
                raw, total, v = self._raw(idx, own, value[rows])
                g = ((1 / (1 + np.exp(-raw)) - y[rows]) / len(rows) * 16).astype(np.float32)
                x = np.repeat(value[rows], sizes)
                ge = np.repeat(g, sizes) * x
                grad = ge[:, None] * (np.repeat(total.astype(np.float32), sizes, axis=0) - v * x[:, None])
                by = np.argsort(idx, kind="stable")
                first = np.flatnonzero(np.diff(idx[by], prepend=-1))
                touched = idx[by][first]
                dw = np.add.reduceat(ge[by], first) + self.ridge * self.w[touched]
                dv = np.add.reduceat(grad[by], first, axis=0) + self.ridge * self.v[touched]
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                self.w[touched] -= self.rate * dw / np.sqrt(gw[touched])
                self.v[touched] -= self.rate * dv / np.sqrt(gv[touched])
                db = float(g.sum())
                gb += db * db
                self.bias -= self.rate * db / gb**0.5
        return self

    def score(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at, starts = self.places(buckets, starts)
        raw, _, _ = self._raw(at, starts, self._values(starts))
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(rows: int, size: int, sample_rows: int, sample_bytes: int) -> int:
    """Hashes under this number make a sample of about so many rows and bytes at most."""
    return min(HASHES, HASHES * sample_rows // max(1, rows), HASHES * sample_bytes // max(1, size))


def fit(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> FactorizationMachine:
    """Fits on distinct labelled rows (doc_id, text) that aren't held out, by a hash of both. The driver sees counts by bucket and, of the sample, those terms that have parameters.

    A document with several labels counts as toxic if at least half are.
    """
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("_label"))
    known = staged(known, "toxicity-labels")
    train = rows.where(~held_out())
    n, size = train.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    below = _share(n, size, sample_rows, sample_bytes)
    taken = train.withColumn("_hash", F.xxhash64("doc_id", "text")).where(F.pmod("_hash", F.lit(HASHES)) < below).join(known, "doc_id").select("doc_id", "_hash", "text", "_label")

    def terms(batches):
        for batch in batches:
            buckets, starts = terms_of(batch.column("text").to_pylist())
            held = [buckets[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_hash"), batch.column("_label"), pa.array(held, pa.binary())], names=["doc_id", "_hash", "_label", "terms"])

    def counts(batches):
        seen, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t, label in zip(batch.column("terms").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                b = np.frombuffer(t, np.int32)
                seen[b] += 1
                bad[b] += label
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some]), pa.array(bad[some])], names=["bucket", "seen", "bad"])

    sample = staged(taken.mapInArrow(terms, "doc_id long, _hash long, _label int, terms binary").dropDuplicates(["doc_id", "_hash"]), "toxicity-sample")
    texts, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    each = sample.select("terms", "_label").mapInArrow(counts, "bucket int, seen long, bad long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).toArrow()  # BUCKETS rows at most
    seen, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    seen[each.column("bucket").to_numpy()], bad[each.column("bucket").to_numpy()] = each.column("seen").to_numpy(), each.column("bad").to_numpy()
    machine = FactorizationMachine().screen(seen, bad, texts, toxic)

    def placed(batches):
        for batch in batches:
            held = [machine.places(b := np.frombuffer(t, np.int32), np.array([0, len(b)]))[0].tobytes() for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_hash"), batch.column("_label"), pa.array(held, pa.binary())], names=["doc_id", "_hash", "_label", "places"])

    rows = sample.mapInArrow(placed, "doc_id long, _hash long, _label int, places binary").toArrow().sort_by([("doc_id", "ascending"), ("_hash", "ascending")])
    own = [np.frombuffer(t, np.int32) for t in rows.column("places").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in own], dtype=np.int64)]).astype(np.int64)
    return machine.train(np.concatenate(own) if own else np.zeros(0, np.int32), starts, rows.column("_label").to_numpy().astype(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; the second pass over the texts has no shuffle."""
    rows = id_and_text(docs, id_col, text_col)
    machine = rows.sparkSession.sparkContext.broadcast(fit(rows, labels, sample_rows, sample_bytes))

    def run(batches):
        for batch in batches:
            score = machine.value.score(*terms_of(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
