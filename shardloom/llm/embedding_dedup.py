"""Near-duplicate embeddings by NN-descent (operator 6).

Equal vectors are one class first. A graph of neighbours over the classes starts from random
hyperplane buckets and is refined: each round a class's neighbours, in both directions, meet each
other and keep the most similar. Only neighbours with a cosine of at least 2 * threshold ** 2 - 1 are
kept, which is the least that two links of one class have between them. A class whose whole list is
over the threshold is saturated: links may be missing from it, so components that hold such classes
are compared in blocks, within and between each other unless their centres are too far apart. An audit
holds a hashed set of classes against all others; while a lower bound of the share that a class of any
kind has of its links is under ``recall``, the search is repeated from other buckets and added, and in
the end all classes are compared in blocks.

Vectors travel as Arrow batches; a task never holds more than a class's lists or two blocks.

Rows: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors
link with those of the same length only; rows with a null id link with nothing; rows that share an id
are one node, and each of them has its own links counted; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import columns_of, partitions_for, staged
from .components import components

_log = logging.getLogger(__name__)

BLOCK = 256
CODE = 24  # planes whose sides tell which vectors go into one block


def normalised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, unit, digest: the vector at length 1 as doubles in bytes, and a digest of it; nulls if it can't be compared."""

    def run(batches):
        for batch in batches:
            ids, rows = columns_of(batch, "vec_id", "v")
            out = []
            for v in rows:
                if not v or any(x is None for x in v):
                    out.append(None)
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all() or not (top := np.abs(x).max()):
                    out.append(None)
                    continue
                x = x / top
                out.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
            digests = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in out]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], names=["vec_id", "unit", "digest"])

    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return v.mapInArrow(run, "vec_id long, unit binary, digest binary")


def _stacked(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def _buckets(units: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """id, bucket: one bucket in each of several tables of random hyperplanes, for vectors of one length each."""

    def run(batches):
        for batch in batches:
            ids, rows = columns_of(batch, "id", "unit")
            for size in sorted({len(r) for r in rows}):
                some = [k for k, r in enumerate(rows) if len(r) == size]
                x = _stacked([rows[k] for k in some])
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, size]).standard_normal((bits, x.shape[1]))
                    key = ((x @ planes.T > 0) @ (1 << np.arange(bits))).astype(np.int64) + (t << 32) + (size << 40)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in some], pa.int64()), pa.array(key)], names=["id", "bucket"])

    return units.select("id", "unit").mapInArrow(run, "id long, bucket long")


def _meetings(around: DataFrame, units: DataFrame, parts: int, floor: float) -> DataFrame:
    """a, b, cos (a < b) of neighbours of one class, one of the two edges being new: ``around`` has id, other, new.

    Each class's neighbours are multiplied at once; a pair is given only if it is better than the last
    of a full list of one of them, ``worst`` in ``units``.
    """
    rows = around.join(units.select(F.col("id").alias("other"), "unit", "worst"), "other").select("id", "other", "new", "unit", "worst").repartition(parts, "id").sortWithinPartitions("id")

    def run(batches):
        now, others, news, vectors, worsts = None, [], [], [], []

        def met():
            if len(others) > 1:
                found = []
                for size in {len(v) for v in vectors}:
                    some = np.array([k for k, v in enumerate(vectors) if len(v) == size])
                    x = _stacked([vectors[k] for k in some])
                    cos = x @ x.T
                    new, worst = np.array([news[k] for k in some]), np.array([worsts[k] for k in some])
                    better = (cos >= floor) & (cos > np.minimum(worst[:, None], worst[None, :]))
                    i, j = np.nonzero(np.triu(better & (new[:, None] | new[None, :]), 1))
                    ids = np.array([others[k] for k in some], np.int64)
                    found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), cos[i, j]))
                a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(a):
                    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["a", "b", "cos"])
            return None

        for batch in batches:
            for i, other, new, unit, worst in zip(*columns_of(batch, "id", "other", "new", "unit", "worst"), strict=True):
                if i != now:
                    if (out := met()) is not None:
                        yield out
                    now, others, news, vectors, worsts = i, [], [], [], []
                others.append(other)
                news.append(new)
                worsts.append(worst)
                vectors.append(unit)
        if (out := met()) is not None:
            yield out

    met = rows.mapInArrow(run, "a long, b long, cos double")
    return met.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """id, other, cos, r: each class's ``k`` most similar neighbours, ranked."""
    sides = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "cos").union(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "cos"))
    return sides.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), F.xxhash64("other")))).where(F.col("r") <= k)


def neighbour_graph(units: DataFrame, n: int, threshold: float, k: int, rounds: int, seed: int) -> DataFrame:
    """id, other, cos: lists of at most ``k`` neighbours, refined until hardly any changes."""
    parts = partitions_for(n, 4000)
    floor = 2 * threshold**2 - 1
    bits = max(1, int(np.ceil(np.log2(max(2, n / 16)))))
    # within a bucket a class meets the next few by a hash, so a bucket gives edges in proportion to it; a large one is dealt over several
    placed = _buckets(units, 8, bits, seed)
    shares = placed.groupBy("bucket").agg(F.ceil(F.count("*") / 1000).cast("int").alias("shares"))
    placed = placed.join(shares, "bucket").withColumn("share", F.pmod(F.xxhash64("id", "bucket"), F.col("shares")))
    w = Window.partitionBy("bucket", "share").orderBy(F.xxhash64("id", "share"), "id")
    nexts = placed.select("id", F.array(*[F.lead("id", j).over(w) for j in range(1, k + 1)]).alias("others"))
    start = nexts.select("id", F.explode("others").alias("other")).where("other IS NOT NULL").distinct()
    # at first only a class's own vector is new: it meets the neighbours from its buckets, which don't meet each other
    own = start.select("id", "other", F.lit(False).alias("new")).union(units.select("id", F.col("id").alias("other"), F.lit(True)))
    graph = staged(_lists(_meetings(own, units.withColumn("worst", F.lit(-2.0)), parts, floor), k), "graph")
    fresh = graph.select("id", "other")
    for _ in range(rounds):
        flagged = graph.join(fresh.withColumn("new", F.lit(True)), ["id", "other"], "left").select("id", "other", F.coalesce("new", F.lit(False)).alias("new"))
        # of the classes that point to one, k are taken in, new ones first; one that isn't still meets the others through its own list
        back = flagged.select(F.col("other").alias("id"), F.col("id").alias("other"), "new")
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("new"), F.xxhash64("other", "id")))).where(F.col("r") <= k).drop("r")
        around = flagged.union(back).groupBy("id", "other").agg(F.max("new").alias("new"))
        old = graph.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cos")
        full = graph.where(F.col("r") == k).select("id", F.col("cos").alias("worst"))
        known = units.join(full, "id", "left").select("id", "unit", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
        both = _meetings(around, known, parts, floor).union(old).groupBy("a", "b").agg(F.max("cos").alias("cos"))
        new = staged(_lists(both, k), "graph")
        fresh = staged(new.select("id", "other").join(graph.select("id", "other"), ["id", "other"], "left_anti"), "fresh")
        graph = new
        if fresh.count() <= 0.001 * k * n:
            break
    return graph


def _coded(members: DataFrame) -> DataFrame:
    """``members`` (id, component, weight, unit) with ``code``: on which side of each of CODE random planes a vector lies."""

    def run(batches):
        for batch in batches:
            rows = batch.column("unit").to_pylist()
            codes = np.zeros(len(rows), np.int64)
            for size in {len(r) for r in rows}:
                some = [k for k, r in enumerate(rows) if len(r) == size]
                planes = np.random.default_rng([97, size]).standard_normal((CODE, size // 8))
                codes[some] = (_stacked([rows[k] for k in some]) @ planes.T > 0) @ (1 << np.arange(CODE))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=[*batch.schema.names, "code"])

    return members.select("id", "component", "weight", "unit").mapInArrow(run, "id long, component long, weight long, unit binary, code long")


def _packed(members: DataFrame) -> DataFrame:
    """no, component, centre, radius, ids, weights, units: members (id, component, weight, unit) in blocks of about BLOCK classes of one component and length.

    ``centre`` is at length 1 and no class of the block is further from it than the angle ``radius``.
    """
    by = ["component", "size"]
    sized = _coded(members).withColumn("size", F.octet_length("unit"))
    # cells of vectors on the same side of as many planes as the component has blocks; a cell that is too full is dealt by a hash
    planes = sized.groupBy(*by).agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK))).cast("int").alias("bits"))
    celled = sized.join(planes, by).withColumn("cell", F.col("code") % F.pow(F.lit(2.0), F.least(F.lit(CODE), F.col("bits"))).cast("long")).drop("bits", "code")
    by.append("cell")
    blocks = celled.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = celled.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    grouped = dealt.groupBy(*by, "block").agg(F.collect_list(F.struct("id", "weight", "unit")).alias("rows"))
    lists = grouped.select(F.monotonically_increasing_id().alias("no"), "component", F.col("rows.id").alias("ids"), F.col("rows.weight").alias("weights"), F.col("rows.unit").alias("units"))

    def run(batches):
        for batch in batches:
            centres, radii = [], []
            for units in batch.column("units").to_pylist():
                x = _stacked(units)
                centre = x.sum(0)
                length = np.sqrt(centre @ centre)
                centre = centre / length if length > 1e-6 else x[0]
                centres.append(centre.astype("<f8").tobytes())
                radii.append(float(np.arccos(np.clip(x @ centre, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centres, pa.binary()), pa.array(radii, pa.float64())], names=[*batch.schema.names, "centre", "radius"])

    shape = "no long, component long, ids array<long>, weights array<long>, units array<binary>, centre binary, radius double"
    return staged(lists.mapInArrow(run, shape), "vector-blocks")


def _block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """i, j (i <= j) of the blocks whose centres and radii allow a link; centres meet as lists of 1024."""
    lists = blocks.select("no", "centre", "radius").groupBy(F.octet_length("centre").alias("size"), F.pmod(F.xxhash64("no"), F.lit(partitions_for(blocks.count(), 1024))).alias("deal")).agg(F.collect_list(F.struct("no", "centre", "radius")).alias("x")).select("size", "deal", "x")
    other = lists.select(F.col("size").alias("size2"), F.col("deal").alias("deal2"), F.col("x").alias("y"))
    most = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6  # arccos of a cosine near 1 is off by up to some 1e-8

    def run(batches):
        for batch in batches:
            for x, y, same in zip(*columns_of(batch, "x", "y", "same"), strict=True):
                no, no2 = np.array([r["no"] for r in x], np.int64), np.array([r["no"] for r in y], np.int64)
                apart = np.arccos(np.clip(_stacked([r["centre"] for r in x]) @ _stacked([r["centre"] for r in y]).T, -1, 1))
                near = apart <= most + np.array([r["radius"] for r in x])[:, None] + np.array([r["radius"] for r in y])[None, :]
                a, b = np.nonzero(near)
                i, j = np.minimum(no[a], no2[b]), np.maximum(no[a], no2[b])
                # lists meet once, and a list meets itself, where each pair but those of one block comes twice
                once = (no[a] <= no2[b]) if same else np.ones(len(a), bool)
                yield pa.RecordBatch.from_arrays([pa.array(i[once]), pa.array(j[once])], names=["i", "j"])

    return lists.join(other, (F.col("size") == F.col("size2")) & (F.col("deal") <= F.col("deal2"))).select("x", "y", (F.col("deal") == F.col("deal2")).alias("same")).mapInArrow(run, "i long, j long")


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links the least row that links lead to; the number of rows for columns without any."""
    none = linked.shape[0]
    rows, columns = np.arange(none), np.full(linked.shape[1], none)
    while True:
        columns = np.where(linked, rows[:, None], none).min(0)
        new = np.minimum(rows, np.where(linked, columns[None, :], none).min(1))
        if (new == rows).all():
            return rows, columns
        rows = new


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """id, linked, classes, root: what each class of ``members`` (id, component, weight, unit) links with, in parts to be summed.

    Every pair of members is compared but those of blocks whose centres are too far apart for any
    link, so the result is exact. Pairs of blocks are products of matrices. ``linked`` counts rows and
    ``classes`` classes; the pairs id, root join the same classes as the links do, in proportion to rows.
    """
    blocks = _packed(members)
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = staged(_block_pairs(blocks, threshold), "vector-block-pairs").repartition(n)
    side = lambda k, at: blocks.select(F.col("no").alias(at), *[F.col(c).alias(f"{c}{k}") for c in ("ids", "weights", "units")])
    size = blocks.agg(F.sum(F.size("ids") * F.octet_length(F.get("units", F.lit(0))))).first()[0] or 0
    sent = F.broadcast if size < 64 << 20 else (lambda d: d)
    met = pairs.join(sent(side(1, "i")), "i").join(sent(side(2, "j")), "j")

    def run(batches):
        for batch in batches:
            for i, j, ids, weights, units, ids2, weights2, units2 in zip(*columns_of(batch, "i", "j", "ids1", "weights1", "units1", "ids2", "weights2", "units2"), strict=True):
                linked = _stacked(units) @ _stacked(units2).T >= threshold
                if i == j:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                own = linked | np.eye(len(ids), dtype=bool) if i == j else linked
                rows, columns = _roots(own)
                names, names2 = np.array(ids, np.int64), np.array(ids2, np.int64)
                some, some2 = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                parts = [(names[some], (linked @ np.array(weights2, np.int64))[some], linked.sum(1)[some], names[rows[some]])]
                if i != j:
                    parts.append((names2[some2], (linked.T @ np.array(weights, np.int64))[some2], linked.sum(0)[some2], names[columns[some2]]))
                for part in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in part], names=["id", "linked", "classes", "root"])

    return staged(met.mapInArrow(run, "id long, linked long, classes long, root long"), "vector-compared")


def _lower(total: float, m: int) -> float:
    """A lower bound, one-sided at about 95 %, of the mean of ``m`` shares of 0 to 1 (Wilson's, which holds for shares between as their variance is smaller)."""
    if not m:
        return 0.0
    z, p = 1.645, total / m
    return (p + z * z / (2 * m) - z * np.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)


def audited_recall(units: DataFrame, counted: DataFrame, n: int, threshold: float, queries: int, least: int = 200, most: int = 12_800) -> float:
    """A lower bound of the share of its links that a class has in ``counted`` (id, classes); the least over all and over classes with few, some and many links.

    Classes chosen by hash are held against every row and each counts the same, whatever its links or
    their copies. About ``queries`` are taken first, then more, until every kind seen has ``least`` of
    them or about ``most`` are taken, so what an audit costs grows with the table only; a kind too rare
    to have ``least`` among them counts among all, and where all links found are of fewer classes than
    that, their mean share is given. Where all classes are taken, shares are no estimate.
    """
    parts = max(1, n // queries)
    part = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts))
    sums: dict[int, tuple[float, int]] = {}
    at, step = 0, 1
    while at < parts and at * queries < most and (not at or any(m < least for _, m in sums.values())):
        step = min(step, parts - at)
        for kind, total, m in _audited(units, counted, threshold, units.where((part >= at) & (part < at + step))):
            held = sums.get(kind, (0.0, 0))
            sums[kind] = (held[0] + total, held[1] + m)
        at += step
        step = at
    if at >= parts:
        return min((total / m for total, m in sums.values()), default=1.0)
    total, m = (sum(x) for x in zip(*sums.values(), strict=True)) if sums else (0, 0)
    if m < least:  # hardly any class has links at all
        return total / m if m else 1.0
    return min(_lower(*x) for x in [(total, m), *(x for x in sums.values() if x[1] >= least)])


def _audited(units: DataFrame, counted: DataFrame, threshold: float, asked: DataFrame) -> list[tuple[int, float, int]]:
    """For each kind of class (few, some, many links): its number, the sum of shares found, and how many classes."""
    chosen = asked.select("id", "unit").collect()
    if not chosen:
        return []
    sent = units.sparkSession.sparkContext.broadcast([(r.id, bytes(r.unit)) for r in chosen])

    def run(batches):
        for batch in batches:
            ids, rows = columns_of(batch, "id", "unit")
            for size in {len(r) for r in rows}:
                asked = [(i, u) for i, u in sent.value if len(u) == size]
                some = [k for k, r in enumerate(rows) if len(r) == size]
                own = np.array([ids[k] for k in some])
                x = _stacked([rows[k] for k in some]).T
                for a in range(0, len(asked), 1000):
                    names = np.array([i for i, _ in asked[a : a + 1000]])
                    linked = (_stacked([u for _, u in asked[a : a + 1000]]) @ x >= threshold) & (names[:, None] != own[None, :])
                    total = linked.sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(names[total > 0]), pa.array(total[total > 0].astype(np.int64))], names=["id", "true"])

    true = units.select("id", "unit").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    share = F.least(F.lit(1.0), F.coalesce("classes", F.lit(0)) / F.col("true"))
    kind = F.when(F.col("true") <= 2, 0).when(F.col("true") <= 10, 1).otherwise(2)
    found = true.join(counted.select("id", "classes"), "id", "left").select(kind.alias("kind"), share.alias("share"))
    return [tuple(r) for r in found.groupBy("kind").agg(F.sum("share"), F.count("*")).collect()]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 10, rounds: int = 4, recall: float = 0.98, searches: int = 4, audit_queries: int = 400, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``.

    Links are pairs with a cosine of at least ``threshold`` in double precision. ``searches`` is how
    often the search is started at most until the audit is content, whose figure is logged; where it never is, all
    rows are compared in blocks, which is exact and grows with the square of the table.
    """
    rows = staged(normalised(vectors, id_col, vector_col), "vectors")
    usable = rows.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # ids that stand for several vectors would be mixed up: a class is named by its place in the digests instead
    named = staged(classes.withColumn("name", F.monotonically_increasing_id()), "vector-classes")
    firsts = usable.groupBy("digest").agg(F.first("unit").alias("unit"))
    units = staged(named.join(firsts, "digest").select(F.col("name").alias("id"), F.col("id").alias("vec_id"), "weight", "unit"), "units")
    n = units.count()
    edges = None
    for s in range(searches):
        graph = neighbour_graph(units, n, threshold, k, rounds, seed=s)
        edges = graph if edges is None else edges.union(graph)
        links = staged(edges.where(F.col("cos") >= threshold).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "vector-links")
        joined = components(links)
        sides = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
        listed = sides.join(units.select(F.col("id").alias("other"), "weight"), "other").groupBy("id").agg(F.sum("weight").alias("linked"), F.count("*").alias("classes"))
        saturated = listed.where(F.col("classes") >= k).join(joined, F.col("id") == F.col("node")).select("component").distinct()
        members = joined.join(saturated, "component").join(units, F.col("node") == F.col("id")).select("id", "component", "weight", "unit")
        whole = compared(members, threshold)
        dense = whole.groupBy("id").agg(F.sum("linked").alias("dense"), F.sum("classes").alias("dense_classes"))
        # a class that is compared has all its links within those compared, as lists of others aren't full
        counted = staged(listed.join(dense, "id", "left").select("id", F.coalesce("dense", "linked").alias("linked"), F.coalesce("dense_classes", "classes").alias("classes")), "vector-counts")
        links = links.union(whole.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
        share = audited_recall(units, counted, n, threshold, audit_queries)
        _log.info("search %d finds at least %.4f of a class's links", s + 1, share)
        if share >= recall:
            break
    if share < recall:
        _log.warning("recall %.4f is under %.4f: all classes are compared", share, recall)
        whole = compared(units.select("id", F.lit(0).cast("long").alias("component"), "weight", "unit"), threshold)
        counted = staged(whole.groupBy("id").agg(F.sum("linked").alias("linked")), "vector-counts")
        links = whole.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    # back from classes to rows: components of ids, as rows that share an id are one node
    same = usable.join(named.select("digest", F.col("id").alias("first")), "digest").select(F.col("vec_id").alias("a"), F.col("first").alias("b")).where("a <> b")
    ids = units.select("id", "vec_id")
    between = links.join(ids.withColumnRenamed("vec_id", "va"), F.col("a") == F.col("id")).drop("id").join(ids.withColumnRenamed("vec_id", "vb"), F.col("b") == F.col("id")).select(F.col("va").alias("a"), F.col("vb").alias("b"))
    every = components(between.union(same))
    out = rows.join(named.select("digest", "name", "weight"), "digest", "left").join(counted.withColumnRenamed("id", "name"), "name", "left").join(every, F.col("vec_id") == F.col("node"), "left")
    n_links = F.when(F.col("vec_id").isNotNull() & F.col("name").isNotNull(), F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
