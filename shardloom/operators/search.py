"""Retrieval: top-k by vector distance, keyword search and scores within a query."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shardloom.functions.lineage import cut


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, summed from left to right."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit_length(v: Column) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(x))


#: Distinct questions and records that meet in one task, at most about; what a task holds doesn't grow with the tables.
CELL_QUESTIONS, CELL_RECORDS = 2048, 16384
_HITS = "vector_id long, record_id long, distance double"


def _whole(v: Column) -> Column:
    """Whether a vector has components, none of them null."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), F.lit(False))


def _distinct_vectors(questions: DataFrame, question_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Questions as query_id, v with each vector's id, and (i, v) of each distinct vector: questions with the same vector have the same hits."""
    q = questions.select(F.col(question_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where(_whole(F.col("v")))
    keyed = cut(q.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256)))
    each = keyed.groupBy("key").agg(F.min("query_id").alias("i"), F.first("v").alias("v"))
    each = cut(each.withColumn("i", F.monotonically_increasing_id()))
    return keyed.join(each.select("key", F.col("i").alias("vector_id")), "key").select("query_id", "vector_id"), each.select("i", "v")


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, distance) of the ``k`` nearest rows of y for each of x, by exact distance and id. Exact distances are taken for all within the error of the k-th rough one, so all ties."""
    x2, y2 = (x * x).sum(1), (y * y).sum(1)
    rough = y2[None, :] - 2 * (x @ y.T)
    n = min(len(y), k)
    last = np.partition(rough, n - 1, axis=1)[:, n - 1]
    # rough and exact distances are each off by less than this share of the squared lengths
    off = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (x2 + y2.max())
    row, near = np.nonzero(~(rough > (last + 2 * off)[:, None]))  # also all that don't compare
    exact = np.empty(len(row))
    for a in range(0, len(row), 16384):
        diff = x[row[a : a + 16384]] - y[near[a : a + 16384]]
        exact[a : a + 16384] = np.cumsum(diff * diff, axis=1)[:, -1]  # left to right
    found = ids[near]
    order = np.lexsort((found, exact, row))
    row, found, exact = row[order], found[order], exact[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], found[first], exact[first]


def vector_top_k(questions: DataFrame, records: DataFrame, k: int, question_id: str = "query_id", record_id: str = "record_id", vector: str = "embedding", block: int = CELL_RECORDS) -> DataFrame:
    """query_id, record_id, distance, rank: the ``k`` nearest records of every question by squared distance.

    Questions of one vector are searched once. Distinct vectors and records are dealt by hashes into groups of about ``block``, questions of ``CELL_QUESTIONS`` at most, and
    each pair of groups is a task's work, so pairs grow with both tables but no task's memory does. In a
    pair exact differences are taken for all records whose rough distance is within its error of the k-th, so all ties;
    k rows a vector are kept by distance and record_id, and a ranked window with a limit merges them. A question meets
    records of its vector's length only. k <= 0 gives nothing.
    """
    if k <= 0:
        return questions.sparkSession.createDataFrame([], "query_id long, record_id long, distance double, rank int")
    asked, q = _distinct_vectors(questions, question_id, vector)
    r = cut(records.select(F.col(record_id).cast("long").alias("i"), F.col(vector).alias("v")).where(_whole(F.col("v"))))
    parts_q, parts_r = max(1, -(-q.count() // min(block, CELL_QUESTIONS))), max(1, -(-r.count() // block))
    dealt = lambda d, own, n, other, m, is_q: d.select(F.size("v").alias("length"), F.pmod(F.xxhash64("i"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(is_q).alias("asks"), "i", F.col("v").cast("array<double>").alias("v"))
    cells = dealt(q, "a", parts_q, "b", parts_r, True).unionByName(dealt(r, "b", parts_r, "a", parts_q, False))

    def met(t: pa.Table) -> pa.Table:
        qs, rs = t.filter(t.column("asks")), t.filter(pc.invert(t.column("asks")))
        out = []
        if qs.num_rows and rs.num_rows:
            x, y, q_ids, r_ids = _matrix(qs), _matrix(rs), qs.column("i").to_numpy(), rs.column("i").to_numpy()
            step = max(1, (1 << 22) // len(y))  # 32 MB of rough distances
            for a in range(0, len(x), step):
                row, ids, exact = _nearest(x[a : a + step], y, r_ids, k)
                out.append(pa.table({"vector_id": q_ids[a : a + step][row], "record_id": ids, "distance": exact}))
        return pa.concat_tables(out) if out else pa.table({"vector_id": pa.array([], pa.int64()), "record_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    return _ranked(cells.groupBy("length", "a", "b").applyInArrow(met, _HITS), asked, k)


def _ranked(hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each vector, for every question that has it."""
    w = Window.partitionBy("vector_id").orderBy("distance", "record_id")
    best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return asked.join(best, "vector_id").select("query_id", "record_id", "distance", "rank")


def balls(records: DataFrame, record_id: str = "record_id", vector: str = "embedding", block: int = 512, pivots: int = 4096, seed: int = 5) -> DataFrame:
    """ball, length, n, centre, radius, ids, block: vectors of one length near one pivot, at most ``block`` of them a row, around their mean.

    Pivots are a bounded sample by a hash, about one for each ``block`` vectors while these are under ``pivots``;
    where more vectors are near one, a hash deals them over several balls, so no group is unbounded.
    """
    v = records.select(F.col(record_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    n = v.count()
    share = min(1.0, min(pivots, max(1, n // block)) / max(1, n))
    chosen = v.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * pivots).select("v").toArrow().column("v").to_pylist()
    by_length = {k: np.array([p for p in chosen if len(p) == k]) for k in {len(p) for p in chosen}}
    sent = records.sparkSession.sparkContext.broadcast(by_length)

    def near(batches):
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            out = np.full(len(vectors), -1, np.int32)
            for length in {len(x) for x in vectors} & sent.value.keys():
                p, own = sent.value[length], np.array([k for k, x in enumerate(vectors) if len(x) == length])
                for a in range(0, len(own), 256):
                    x = np.array([vectors[k] for k in own[a : a + 256]])
                    out[own[a : a + 256]] = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("v"), pa.array([len(x) for x in vectors], pa.int32()), pa.array(out)], names=["i", "v", "length", "pivot"])

    dealt = cut(v.mapInArrow(near, "i long, v array<double>, length int, pivot int"))
    sizes = dealt.groupBy("length", "pivot").agg(F.ceil(F.count("*") / block).alias("parts"))
    parted = dealt.join(sizes, ["length", "pivot"]).withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")))

    def made(t: pa.Table) -> pa.Table:
        x = np.array(t.column("v").to_pylist(), "<f8")
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max()) * (1 + 1e-9)
        key = [t.column(c)[0].as_py() for c in ("length", "pivot", "part")]
        return pa.table({"ball": [":".join(map(str, key))], "length": pa.array([key[0]], pa.int32()), "n": pa.array([len(x)], pa.int32()), "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [radius], "ids": pa.array([t.column("i").to_pylist()], pa.list_(pa.int64())), "block": pa.array([x.tobytes()], pa.binary())})

    return parted.groupBy("length", "pivot", "part").applyInArrow(made, "ball string, length int, n int, centre binary, radius double, ids array<long>, block binary")


def _comparable(df: DataFrame, vector: str) -> DataFrame:
    return df.where(_whole(F.col(vector)) & F.forall(F.col(vector), lambda x: ~F.isnan(x)))


def _ball_cells(q: DataFrame, held: DataFrame, of_balls: list[str], run: Callable[[pa.Table, pa.Table, np.ndarray], dict], schema: str) -> DataFrame:
    """What ``run`` makes of each pair of a group of questions (i, v and more) and a group of balls, both of bounded size, with the distances between vectors and centres."""
    sizes = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts_q, parts_b = max(1, -(-q.count() // CELL_QUESTIONS)), max(1, -(-(sizes[0] if "block" in of_balls else sizes[1]) // CELL_RECORDS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = q.select(F.size("v").alias("length"), F.pmod(F.xxhash64("i"), F.lit(parts_q)).cast("int").alias("a"), spread(parts_b).alias("b"), *q.columns)
    own = held.select("length", spread(parts_q).alias("a"), F.pmod(F.xxhash64("ball"), F.lit(parts_b)).cast("int").alias("b"), *of_balls)
    names = [f.split()[0] for f in schema.split(", ")]

    def met(t: pa.Table) -> pa.Table:
        asked = pc.is_valid(t.column("i"))
        qs, bs = t.filter(asked), t.filter(pc.invert(asked))
        out = {}
        if qs.num_rows and bs.num_rows:
            x, c = _matrix(qs), np.frombuffer(b"".join(bs.column("centre").to_pylist()), "<f8").reshape(bs.num_rows, -1)
            out = run(qs, bs, np.concatenate([np.sqrt(((c[None, :, :] - x[a : a + 16, None, :]) ** 2).sum(2)) for a in range(0, len(x), 16)]))
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        return pa.table({n: pa.array(out.get(n, []), kinds[f.split()[1]]) for n, f in zip(names, schema.split(", "), strict=True)})

    return asks.unionByName(own, allowMissingColumns=True).groupBy("length", "a", "b").applyInArrow(met, schema)


def _bounded(q: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """``q`` (i, v) with ``most``: the farthest side of as many of the nearest balls as hold k vectors, infinite where all hold fewer."""

    def nearest(qs: pa.Table, bs: pa.Table, d: np.ndarray) -> dict:
        n, r, ids = bs.column("n").to_numpy(), bs.column("radius").to_numpy(), qs.column("i").to_numpy()
        high = d * (1 + 1e-9) + r[None, :]
        order = np.argsort(high, axis=1, kind="stable")[:, :k]  # a ball holds one at least
        sums = n[order].cumsum(1)
        row, at = np.nonzero(sums - n[order] < k)
        return {"i": ids[row], "high": high[row, order[row, at]], "n": n[order[row, at]]}

    sides = cut(_ball_cells(q, held, ["centre", "radius", "n"], nearest, "i long, high double, n int"))
    enough = sides.withColumn("_sum", F.sum("n").over(Window.partitionBy("i").orderBy("high").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_sum") >= k).groupBy("i").agg(F.min("high").alias("most"))
    return cut(q.join(enough, "i", "left").withColumn("most", F.coalesce("most", F.lit(float("inf")))))


def _reach(qs: pa.Table, bs: pa.Table, d: np.ndarray) -> np.ndarray:
    """Which balls can hold a hit of which question."""
    return d * (1 - 1e-9) - bs.column("radius").to_numpy()[None, :] <= qs.column("most").to_numpy()[:, None]


def balls_to_read(questions: DataFrame, held: DataFrame, k: int, question_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, q, ball: the balls that can hold one of the ``k`` nearest vectors of a question.

    The k-th distance is at most the farthest side of as many of the nearest balls as hold k vectors; by the triangle inequality
    balls whose near side is beyond it can't matter. Only centres and radii are read, in groups of questions and of balls.
    """
    asked, q = _distinct_vectors(_comparable(questions, vector), question_id, vector)

    def wanted(qs: pa.Table, bs: pa.Table, d: np.ndarray) -> dict:
        row, ball = np.nonzero(_reach(qs, bs, d))
        return {"i": qs.column("i").to_numpy()[row], "ball": bs.column("ball").take(pa.array(ball)).to_pylist()}

    pairs = _ball_cells(_bounded(q, held, k), held, ["ball", "centre", "radius", "n"], wanted, "i long, ball string")
    return pairs.join(q, "i").join(asked.withColumnRenamed("vector_id", "i"), "i").select("query_id", F.col("v").alias("q"), "ball")


def vector_top_k_pruned(questions: DataFrame, records: DataFrame, k: int, question_id: str = "query_id", record_id: str = "record_id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """The rows of vector_top_k(), exactly, comparing questions with the vectors of balls_to_read() only; for records that are searched often or lie in clusters.

    Groups of questions meet groups of balls, both of bounded size, and in each pair questions near each other read the balls that one of them can need.
    """
    if k <= 0:
        return vector_top_k(questions, records, k)
    held = cut(balls(records, record_id, vector, block))
    asked, q = _distinct_vectors(_comparable(questions, vector), question_id, vector)

    def read(qs: pa.Table, bs: pa.Table, d: np.ndarray) -> dict:
        need, x, ids = _reach(qs, bs, d), _matrix(qs), qs.column("i").to_numpy()
        blocks = [np.frombuffer(b, "<f8").reshape(-1, x.shape[1]) for b in bs.column("block").to_pylist()]
        records = [np.array(r, np.int64) for r in bs.column("ids").to_pylist()]
        out = []
        near = np.argsort(d.argmin(1), kind="stable")
        for a in range(0, len(near), 64):
            some = near[a : a + 64]
            if len(balls := np.nonzero(need[some].any(0))[0]):
                row, found, exact = _nearest(x[some], np.concatenate([blocks[b] for b in balls]), np.concatenate([records[b] for b in balls]), k)
                out.append((ids[some][row], found, exact))
        return dict(zip(("vector_id", "record_id", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {}

    return _ranked(_ball_cells(_bounded(q, held, k), held, ["ball", "centre", "radius", "n", "ids", "block"], read, _HITS), asked, k)


def normalised(score: Column, *by: str) -> Column:
    """Scores of a query brought to 0..1; where all are equal each is 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high <= low, F.lit(1.0)).otherwise((score - low) / (high - low))


def scored_hits(hits: DataFrame) -> DataFrame:
    """Vector hits with raw similarity 1 / (1 + min(100, d)), that normalised within the query, and the final score."""
    raw = 1.0 / (1.0 + F.least(F.lit(100.0), F.col("distance")))
    d = hits.withColumn("vector_score_raw", raw).withColumn("vector_score_norm", normalised(F.col("vector_score_raw"), "query_id"))
    return d.withColumns({"keyword_score_raw": F.lit(0.0), "keyword_score_norm": F.lit(0.0), "final_score": F.col("vector_score_norm"), "retrieval_type": F.lit("vector")})


def occurrences(doc: Column, token: Column) -> Column:
    """Non-overlapping occurrences of a token."""
    return F.when(F.char_length(token) > 0, (F.char_length(doc) - F.char_length(F.replace(doc, token, F.lit("")))) / F.char_length(token)).otherwise(0).cast("long")


#: Tokens looked for in one reading of the texts, about; only some 50 bytes of a token go to the tasks, whatever its length.
PASS_TOKENS = 1 << 18
_WIDTHS = (32, 16, 8, 4, 2, 1)  # a token is found by its first characters, as many as the widest of these that it has
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_PIECE = 1 << 20  # characters that are hashed together
_TABLE: dict = {}  # what this worker made of the last broadcast


def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(_PIECE + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c = (c + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    return c ^ (c >> np.uint64(29))


def _sums(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[: len(codes)], dtype=np.uint64)])


def _sketches(tokens: DataFrame) -> DataFrame:
    """token, key, length, width, head: what tasks need to find a token. The key is 16 bytes of a SHA-256, which tells tokens apart."""

    def run(batches):
        powers = _powers()[0]
        for batch in batches:
            heads, widths, lengths = [], [], []
            for t in batch.column("token").to_pylist():
                width = next(w for w in _WIDTHS if w <= len(t))
                heads.append(int(_sums(_codes(t[:width]), powers)[-1].view(np.int64)))
                widths.append(width)
                lengths.append(len(t))
            keys = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] for t in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(keys, pa.binary()), pa.array(lengths, pa.int32()), pa.array(widths, pa.int32()), pa.array(heads, pa.int64())], names=["token", "key", "length", "width", "head"])

    return tokens.select("token").mapInArrow(run, "token string, key binary, length int, width int, head long")


def _in_text(text: str, sums: np.ndarray, start: int, inverse: np.ndarray, by_width: dict) -> dict:
    """Key and number of non-overlapping occurrences of the tokens in one text, whose hashes are sums from ``start`` on."""
    found: dict = {}
    for width, (heads, groups, seen) in by_width.items():
        n = len(text) - width + 1
        if n <= 0:
            continue
        at = (sums[start + width : start + width + n] - sums[start : start + n]) * inverse[start : start + n]
        maybe = np.nonzero(seen[(at >> np.uint64(40)).astype(np.int64)])[0]
        place = np.searchsorted(heads, at[maybe]).clip(0, len(heads) - 1)
        for p, g in zip(*(x[heads[place] == at[maybe]].tolist() for x in (maybe, place)), strict=True):
            for length, keys in groups[g].items():
                if p + length <= len(text) and (key := hashlib.sha256(text[p : p + length].encode("utf-8", "surrogatepass")).digest()[:16]) in keys:
                    count, end = found.get(key, (0, -1))
                    if p >= end:
                        found[key] = (count + 1, p + length)
    return found


def _hits_of(documents: DataFrame, sketches: pa.Table) -> DataFrame:
    """doc_id, key, n for some tokens: hashes of all windows of a text, whose cost doesn't grow with the tokens, and a digest where a token's first characters are met."""
    sent = documents.sparkSession.sparkContext.broadcast({c: sketches.column(c).to_pylist() for c in ("key", "length", "width", "head")})
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _TABLE:
            made: dict = {}
            for key, length, width, head in zip(*(sent.value[c] for c in ("key", "length", "width", "head")), strict=True):
                made.setdefault(width, {}).setdefault(head & (1 << 64) - 1, {}).setdefault(length, set()).add(key)
            table = {}
            for width, by_head in made.items():
                heads = np.array(sorted(by_head), np.uint64)
                seen = np.zeros(1 << 24, bool)
                seen[(heads >> np.uint64(40)).astype(np.int64)] = True
                table[width] = (heads, [by_head[h] for h in heads.tolist()], seen)
            _TABLE.clear()
            _TABLE[name] = (table, _powers())
        table, (powers, inverse) = _TABLE[name]

        def counted(texts: list) -> list:
            joined = "".join(t for _, t in texts)
            if len(joined) > len(inverse) - 1:  # one long text
                powers_, inverse_ = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(joined), p[1])])) for p in (powers, inverse))
            else:
                powers_, inverse_ = powers, inverse
            sums, start, out = _sums(_codes(joined), powers_), 0, []
            for doc_id, text in texts:
                out += [(doc_id, key, count) for key, (count, _) in _in_text(text, sums, start, inverse_, table).items()]
                start += len(text)
            return out

        for batch in batches:
            held, size, out = [], 0, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("document_lower").to_pylist(), strict=True):
                if text:
                    if held and size + len(text) > _PIECE:
                        out += counted(held)
                        held, size = [], 0
                    held.append((doc_id, text))
                    size += len(text)
            out += counted(held) if held else []
            for a in range(0, len(out), 4096):
                ids, found, n = zip(*out[a : a + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "key", "n"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "document_lower").mapInArrow(run, "doc_id long, key binary, n long")


def _token_hits(documents: DataFrame, tokens: DataFrame, most_chars: int = PASS_TOKENS) -> DataFrame:
    """doc_id, token, n: how often each distinct token (a column of ``tokens``) occurs in each document that holds it, without overlaps.

    Tokens are dealt by a hash over as many readings of the texts as keep each at about ``most_chars`` tokens of some 50 bytes,
    so what goes through the driver for one doesn't grow with the tokens.
    """
    known = cut(_sketches(tokens.select("token").where("token <> ''").distinct()))
    groups = max(1, -(-known.count() // most_chars))
    whole = documents.sparkSession.createDataFrame([], "doc_id long, key binary, n long")
    for g in range(groups):
        own = known.where(F.pmod(F.xxhash64("token"), F.lit(groups)) == g) if groups > 1 else known
        if (sketches := own.select("key", "length", "width", "head").toArrow()).num_rows:
            whole = whole.unionByName(_hits_of(documents, sketches))
        if g % 16 == 15:  # plans stay short
            whole = cut(whole)
    return whole.join(known.select("key", "token"), "key").select("doc_id", "token", "n")


def keyword_search(questions: DataFrame, documents: DataFrame, k: int, weight: float = 1.0, head: int = 32, most_chars: int = PASS_TOKENS) -> DataFrame:
    """query_id, doc_id, rank, keyword_score_raw, keyword_score_norm, final_score.

    ``questions``: query_id, tokens; ``documents``: doc_id, document_lower. A document is a candidate
    if it contains a token; a query without any is asked again with the first ``head`` characters of
    its first token, whose hits score 0, as no document has a whole token. Scores are normalised after
    the cut. A repeated token counts as often as it is given. ``most_chars``: as _token_hits().
    Queries asked again with one head share its best ``k`` documents, so pairs don't grow with the square of such a group.
    """
    q = questions.where(F.size("tokens") > 0)
    asked = q.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    hits = cut(_token_hits(documents, asked, most_chars))
    found = hits.join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("times")).cast("double").alias("keyword_score_raw"))
    found = cut(found)
    empty = q.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.substring(F.element_at("tokens", 1), 1, head).alias("token"))
    first = F.row_number().over(Window.partitionBy("token").orderBy("doc_id"))
    heads = _token_hits(documents, empty, most_chars).withColumn("_r", first).where(F.col("_r") <= k).drop("_r")
    again = heads.join(empty, "token").select("query_id", "doc_id", F.lit(0.0).alias("keyword_score_raw"))
    both = found.unionByName(again)
    w = Window.partitionBy("query_id").orderBy(F.desc("keyword_score_raw"), "doc_id")
    ranked = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("keyword_score_norm", normalised(F.col("keyword_score_raw"), "query_id"))
    return ranked.withColumn("final_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("keyword_score_norm") * weight)))


def hit_summary(hits: DataFrame, most: int = 8) -> DataFrame:
    """query_id, n_hits, and the first hits as text, for reports."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", F.col("record_id").cast("string"), F.round("final_score", 6).cast("string")).alias("hit")))), 1, most)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_join(F.transform(first, lambda x: x["hit"]), " ").alias("preview"))
