"""Language-model scoring (operator 2): a log-bilinear model trained with noise-contrastive estimation.

The model predicts the class of the next token from the ``order`` tokens before it: their vectors,
each weighted by position, add up to a query vector, whose product with a class's vector plus that
class's bias is its score. The ``own`` most frequent tokens are classes of their own; all others fall
into ``spelled`` classes by the hash of their last three bytes, which tells of language and form.
Within such a class a token has its smoothed share of the class's counts, and tokens never seen have
one token's share together, so probabilities over all tokens, known or not, sum to one. Scores are
normalised exactly: products of matrices give all classes' scores at each token.

Work and what it gathers grow with the corpus: token counts cover every training token and are
summed by a shuffle; every training token is used once in training, in shards of about
``shard_tokens``; each shard's parameters (a fixed number) are averaged by a shuffle in each round.
Only the ``head`` most frequent tokens, a fixed number, are sent to all tasks; counts of rarer
tokens are joined.

Rows: null or empty text has the end token alone; a null id counts as training text (its remainder
isn't 1); repeated rows each count and each give a row; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, most_frequent, partitions_for, staged

END = b"\n"  # no word holds it


@dataclass(frozen=True)
class Settings:
    head: int = 1 << 17
    own: int = 512
    spelled: int = 256
    order: int = 8
    dim: int = 16
    noise: int = 128  # noise tokens drawn for a batch, shared by its rows
    noise_ratio: float = 32.0  # noise tokens a data token is held against
    batch: int = 8192
    rounds: int = 2  # each has its own share of the training documents
    rate: float = 0.7  # of the first round; half of it in the second, a third in the third
    calm: float = 1.0  # what a parameter's sum of squared gradients starts from; the larger, the smaller the first steps
    shard_tokens: int = 2_000_000


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words_of_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, as lower_words_of() finds them, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, lengths = parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at a text's ends leaves empty ones
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(lengths)
    return words.filter(full), before[ends] - before[ends - lengths]


def token_counts(docs: DataFrame) -> DataFrame:
    """word, c over all rows of ``docs``. Tasks add up what they can hold before the shuffle; the end token is a line feed."""

    def run(batches):
        held: list[pa.Table] = []
        docs_seen = 0

        def flush():
            got = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            held.clear()
            for part in got.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches(max_chunksize=50_000):
                yield part

        for batch in in_slices(batches, 2048):
            found = words_of_batch(batch.column("text"))[0].value_counts()
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            docs_seen += batch.num_rows
            if sum(x.num_rows for x in held) > 1_000_000:
                yield from flush()
        if docs_seen:
            held.append(pa.table({"word": pa.array([END.decode()]), "n": pa.array([docs_seen], pa.int64())}))
            yield from flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Ranks(dict):
    def __missing__(self, word):
        return -1


def spelling(word: bytes, spelled: int) -> int:
    return zlib.crc32(word[-3:]) % spelled


class Head:
    """The most frequent tokens, most frequent first, with counts, and what is known of the classes; sent to all tasks.

    ``by_spelling``: for each spelled class the count and the number of all tokens spelled so.
    """

    def __init__(self, words: list[str], counts: np.ndarray, total: int, distinct: int, by_spelling: dict[int, tuple[int, int]], s: Settings):
        self.rank = Ranks((w.encode(), i) for i, w in enumerate(words))
        self.log_count = np.log10(counts + 0.5)
        self.own, self.spelled = min(s.own, len(words)), s.spelled
        # the class at each rank; the last entry stands for rank -1
        self.classes = np.array([*range(self.own), *(self.own + spelling(w.encode(), s.spelled) for w in words[self.own :]), 0], np.uint16)
        self.total, self.distinct = total, distinct
        c, v = np.zeros(s.spelled), np.zeros(s.spelled)
        for k, (n, different) in by_spelling.items():
            c[k], v[k] = n, different
        for w, n in zip(words[: self.own], counts[: self.own].tolist(), strict=True):
            k = spelling(w.encode(), s.spelled)
            c[k], v[k] = c[k] - n, v[k] - 1
        self.within = c + 0.5 * (v + 1)
        self.log_within = np.log10(self.within)
        share = np.concatenate([counts[: self.own] + 0.5, self.within])
        self.share = share / share.sum()


def read_tokens(docs: DataFrame, head) -> DataFrame:
    """What scoring and training need of each text; ``head`` is a broadcast Head. Rare tokens go along with their counts in the text."""
    fields = [("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("head_log", pa.float64()), ("tail_log", pa.float64()), ("classes", pa.binary()), ("rare", pa.list_(pa.string())), ("rare_n", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        h = head.value
        for batch in in_slices(batches, 2048):
            words, n_words = words_of_batch(batch.column("text"))
            found = words.dictionary_encode()
            distinct = [*found.dictionary.cast(pa.binary()).to_pylist(), END]
            rank = np.fromiter(map(h.rank.__getitem__, distinct), np.int64, len(distinct))
            known = rank >= 0
            classes = h.classes[rank]
            classes[~known] = [h.own + spelling(distinct[i], h.spelled) for i in np.flatnonzero(~known).tolist()]
            log = np.where(known, h.log_count[rank] if len(h.log_count) else 0.0, 0.0)
            tail = np.where(classes >= h.own, log - h.log_within[np.maximum(classes, h.own) - h.own], 0.0)
            # the words of each text and its end, as places in ``distinct``
            ends = np.cumsum(n_words + 1)
            starts, is_word = ends - n_words - 1, np.ones(int(ends[-1]), bool)
            is_word[ends - 1] = False
            token = np.full(int(ends[-1]), len(distinct) - 1, np.int64)
            token[is_word] = found.indices.to_numpy()
            at = np.flatnonzero(~known.take(token))
            row = np.repeat(np.arange(batch.num_rows), n_words + 1)
            rare, times = np.unique(row[at] * len(distinct) + token[at], return_counts=True)
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rare // len(distinct), minlength=batch.num_rows))]).astype(np.int32))
            names = pa.concat_arrays([found.dictionary, pa.array([END.decode()])]).take(pa.array(rare % len(distinct)))
            held = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32)), pa.py_buffer(classes.astype("<u2").take(token))])
            sums = lambda x, token=token, starts=starts: pa.array(np.add.reduceat(x.take(token), starts))
            columns = [pa.array(np.arange(key, key + batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(n_words + 1), sums(known.astype(np.int64)), sums(log), sums(tail), held, pa.ListArray.from_arrays(lists, names), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))]
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kind = "key long, doc_id long, held_out boolean, n_tokens long, known long, head_log double, tail_log double, classes binary, rare array<string>, rare_n array<int>"
    return docs.withColumn("held_out", held_out()).select("doc_id", "held_out", "text").mapInArrow(run, kind)


class LogBilinear:
    """Parameters and their products. Row ``k`` of the context vectors stands before a text."""

    def __init__(self, share: np.ndarray, dim: int, order: int, seed: int = 7):
        k = len(share)
        rng = np.random.default_rng(seed)
        self.k, self.dim, self.order, self.share = k, dim, order, share
        self.out = (rng.standard_normal((k, dim)) * 0.1).astype(np.float32)
        self.context = (rng.standard_normal((k + 1, dim)) * 0.1).astype(np.float32)
        self.place = np.repeat((np.arange(1, order + 1) ** -0.5)[:, None], dim, axis=1).astype(np.float32)
        self.bias = np.log(share).astype(np.float32)

    _PARTS = ("out", "context", "place", "bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self._PARTS])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self._PARTS:
            now = getattr(self, p)
            setattr(self, p, flat[at : at + now.size].reshape(now.shape).astype(np.float32))
            at += now.size

    @staticmethod
    def joined(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The classes of all texts one after the other, and each one's place in its text."""
        lengths = np.array([len(c) for c in classes], np.int64)
        t = np.concatenate(classes).astype(np.int32) if classes else np.zeros(0, np.int32)
        return t, (np.arange(len(t)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)

    def before(self, t: np.ndarray, place: np.ndarray, pick: np.ndarray) -> list[np.ndarray]:
        """For each distance, nearest first, the classes so far before the picked ones."""
        return [np.where(place[pick] > j, t[np.maximum(pick - j - 1, 0)], self.k) for j in range(self.order)]

    def query(self, before: list[np.ndarray]) -> np.ndarray:
        q = np.zeros((len(before[0]), self.dim), np.float32)
        for c, p in zip(before, self.place, strict=True):
            q += self.context.take(c, axis=0) * p
        return q

    def train(self, classes: list[np.ndarray], s: Settings, seed: int) -> int:
        """One pass of noise-contrastive estimation with adaptive steps over the shard's texts."""
        t, place = self.joined(classes)
        rng = np.random.default_rng(seed)
        shuffled = rng.permutation(len(t))
        cumulative = np.cumsum(self.share)
        log_noise = np.log(self.share).astype(np.float32) + np.float32(math.log(s.noise_ratio))
        square = {p: np.full_like(getattr(self, p), s.calm) for p in self._PARTS}
        weight = np.float32(s.noise_ratio / s.noise)
        cells, room = cells_of(self.k + 1, self.dim), np.empty((min(s.batch, len(t)), s.noise), np.float32)
        for a in range(0, len(shuffled), s.batch):
            pick = shuffled[a : a + s.batch]
            b_t, before = t.take(pick), self.before(t, place, pick)
            drawn = np.searchsorted(cumulative, rng.random(s.noise) * cumulative[-1]).clip(0, self.k - 1)
            o, o_noise = self.out.take(b_t, axis=0), self.out.take(drawn, axis=0)
            q = self.query(before)
            g_data = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", q, o) + self.bias[b_t] - log_noise[b_t]))) - 1
            g_noise = room[: len(pick)]
            to, less = np.ascontiguousarray(-o_noise.T), self.bias[drawn] - log_noise[drawn]
            for at in range(0, len(pick), 512):  # a part stays in the cache from product to share
                part = np.matmul(q[at : at + 512], to, out=g_noise[at : at + 512])
                part -= less
                np.exp(part, out=part)
                part += 1
                np.divide(weight, part, out=part)
            d_q = g_data[:, None] * o + g_noise @ o_noise
            wide = d_q.astype(np.float64)
            by_class = [sum_rows(cells, c, wide).astype(np.float32) for c in before]
            grads = {
                "out": (sum_rows(cells, b_t, g_data[:, None] * q) + sum_rows(cells, drawn, g_noise.T @ q))[: self.k].astype(np.float32),
                "context": sum(x * p for x, p in zip(by_class, self.place, strict=True)),
                "place": np.stack([np.einsum("ij,ij->j", x, self.context) for x in by_class]),
                "bias": (np.bincount(b_t, g_data, self.k) + np.bincount(drawn, g_noise.sum(0), self.k)).astype(np.float32),
            }
            for p, g in grads.items():
                g /= np.float32(len(pick) ** 0.5)
                square[p] += g * g
                getattr(self, p)[...] -= np.float32(s.rate * (0.1 if p == "place" else 1)) * g / np.sqrt(square[p])
        return len(t)

    def log_probs(self, classes: list[np.ndarray], batch: int = 256) -> np.ndarray:
        """Natural log probability of each class after those before it, normalised over all classes."""
        t, place = self.joined(classes)
        out = np.empty(len(t), np.float64)
        to, room = np.ascontiguousarray(self.out.T), np.empty((batch, self.k), np.float32)
        most = self.bias.max()
        weights = np.exp(self.bias - most)  # of the classes' powers, so that biases needn't be added to each score
        wide = float(np.abs(to).max())
        for start in range(0, len(t), 1 << 14):
            pick = np.arange(start, min(len(t), start + (1 << 14)))
            q, own = self.query(self.before(t, place, pick)), t[start : start + len(pick)]
            sums, top = np.empty(len(pick), np.float32), np.zeros(len(pick), np.float32)
            large = (np.abs(q) @ np.ones(self.dim, np.float32)).max() * wide > 80  # only then could a power pass what single precision holds
            for a in range(0, len(pick), batch):
                x = q[a : a + batch]
                scores = np.matmul(x, to, out=room[: len(x)])
                if large:
                    scores += self.bias - most
                    top[a : a + batch] = scores.max(1)
                    scores -= top[a : a + batch, None]
                np.exp(scores, out=scores)
                sums[a : a + batch] = scores.sum(1) if large else scores @ weights
            out[pick] = np.einsum("ij,ij->i", q, self.out.take(own, axis=0)) + (self.bias.take(own) - most).astype(np.float64) - top - np.log(sums.astype(np.float64))
        return out


def cells_of(n: int, d: int) -> np.ndarray:
    """The numbers of the cells of each row of an array of n rows."""
    return np.arange(n * d).reshape(n, d)


def sum_rows(cells: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An array like ``cells`` (see cells_of) with ``values`` added up by row."""
    return np.bincount(cells.take(rows, axis=0).ravel(), values.ravel(), cells.size).reshape(cells.shape)


def trained(tokens: DataFrame, head: Head, s: Settings) -> LogBilinear:
    """A model that has seen every training token of ``tokens`` once, a share of the documents in each round."""
    model = LogBilinear(head.share, s.dim, s.order)
    sc = tokens.sparkSession.sparkContext
    shards = partitions_for(head.total, s.rounds * s.shard_tokens)
    for r in range(s.rounds if head.total else 0):
        now = sc.broadcast(model)

        def run(batches, now=now, r=r):
            from pyspark import TaskContext

            classes = [np.frombuffer(x, "<u2") for batch in batches for x in batch.column("classes").to_pylist()]
            if not classes:
                return
            own = LogBilinear(now.value.share, s.dim, s.order)
            own.load(now.value.flat())
            n = own.train(classes, replace(s, rate=s.rate / (r + 1)), seed=TaskContext.get().partitionId() * 31 + r)
            flat = own.flat()
            for a in range(0, len(flat), 50_000):
                part = flat[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part.astype(np.float64) * n), pa.array(np.full(len(part), float(n)))], names=["i", "v", "w"])

        share = tokens.where(~F.col("held_out") & (F.pmod(F.xxhash64("key"), F.lit(s.rounds)) == r)).select("classes")
        sums = share.repartition(shards).mapInArrow(run, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
        got = sums.toArrow()  # as many rows as the model has parameters
        if got.num_rows:
            flat = np.empty(got.num_rows)
            flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
            model.load(flat)
    return model


def learned(d: DataFrame, s: Settings) -> tuple[DataFrame, Head, DataFrame, LogBilinear]:
    """Counts, head, tokens of every text, and the trained model; ``d``: doc_id, text."""
    counts = staged(token_counts(d.where(~held_out())), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = sorted(((-c, w) for w, c in most_frequent(counts, "c", s.head).select("word", "c").toArrow().to_pandas().itertuples(index=False)))
    kind = (F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % s.spelled).cast("int")
    by_spelling = {r["kind"]: (r["c"], r["v"]) for r in counts.groupBy(kind.alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}  # a row per spelled class
    head = Head([w for _, w in top], -np.array([c for c, _ in top], np.float64), total, distinct, by_spelling, s)
    tokens = staged(read_tokens(d, d.sparkSession.sparkContext.broadcast(head)), "lm-tokens")
    return counts, head, tokens, trained(tokens, head, s)


def lm_scores(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    d = id_and_text(docs, id_col, text_col)
    counts, head, tokens, fitted = learned(d, settings)
    model = d.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        for batch in batches:
            texts = batch.column("classes").to_pylist()
            place = {x: i for i, x in enumerate(dict.fromkeys(texts))}  # texts alike in their classes are scored once a batch
            classes = [np.frombuffer(x, "<u2") for x in place]
            lp = model.value.log_probs(classes) / math.log(10)
            starts = np.concatenate([[0], np.cumsum([len(c) for c in classes])[:-1]]).astype(np.int64)
            sums = np.add.reduceat(lp, starts) if len(classes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(sums[[place[x] for x in texts]])], names=[*plain, "class_log"])

    plain = ["key", "doc_id", "held_out", "n_tokens", "known", "head_log", "tail_log"]
    scored = tokens.select(*plain, "classes").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, known long, head_log double, tail_log double, class_log double")
    rare = tokens.select("key", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    rare = rare.join(counts, "word", "left").groupBy("key").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    every = math.log10(head.total + 0.5 * (head.distinct + 1))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(head.total)).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * every).alias("base_score"),
        (F.col("class_log") + F.col("tail_log") + rare_log).alias("score"),
    )
