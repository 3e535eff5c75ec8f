"""N-gram Jaccard join (operator 5): sets of shingles are joined by a prefix tree.

1. Every text becomes the set of hashes of its n-word shingles; equal sets are one class, which the
   smallest id stands for. Tasks also report shingles that several of their distinct sets hold.
2. Shingles are ordered alike everywhere: those not known to be frequent by hash, then frequent
   ones, rarest first. At most ``FREQUENT`` of them are sent to all tasks, whatever the input; which
   are known changes the work, never the result. A class's prefix is its first shingles in this
   order, so many that two classes that link share ``shared(n)`` of them.
3. Shingles that few classes have in their prefixes give pairs, of which those stay that are given
   often enough. Where many share one, they are first held against one class of the group (the one
   with the fewest rare shingles), so that a large group of copies costs as many pairs as it has
   members; then, wherever a group still holds classes of different components, all pairs across
   components follow, each at its first such shingle.
4. Pairs are verified exactly: the sets to be held against one class are stored in a prefix tree,
   and the class's set traverses it. Sets with a common beginning share their overlap; a subtree is
   left when what remains in it and in the traversing set can't reach the needed overlap.

What is shuffled is shingles of prefixes and sets of candidates. Bitmaps of a fixed size keep away most
of what has no partner before the shuffle; a full bitmap lets everything through.

Rows: null or empty text and text without words has an empty set and links with nothing; with fewer
words than a shingle the whole sequence is one shingle. Rows with a null id get no component and
link with nothing. Rows that share an id are one node, which has the links of all of them. An empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, id_and_text, in_slices, lower_words_of, most_frequent, staged
from .components import components

#: Frequent shingles sent to all tasks: 12 bytes each.
FREQUENT = 1 << 20
MEMBERS = 128  # sets in one prefix tree
SMALL = 64  # classes that share a prefix shingle and are paired all at once
WIDE = 512  # classes outside a group's largest component from which on the group is split by second shingles
PART = 512  # classes of a group that one task holds the others against
_BITS = 27  # of a bitmap, as a power of two: 16 MB


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int = 3) -> np.ndarray:
    """Rising distinct 64-bit hashes of the shingles of a whole text."""
    words = lower_words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    size = min(n, len(words))
    count = len(words) - size + 1
    x = np.full(count, size, np.uint64)
    for k in range(size):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + count])
    return np.unique(x)


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of these sizes that link: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def shared(n):
    """How many shingles of their prefixes two classes that link share at least, by the smaller one's size.

    Two at least: different sets that link share more than that, as sets of one or two shingles have none to spare.
    """
    return max(2, 1 + min(3, n // 50))


def bitmap(values: DataFrame, c: Column) -> np.ndarray:
    """Bits of the numbers in ``c`` modulo 2 ** _BITS, of a fixed size whatever the table's."""
    at = F.pmod(c, F.lit(1 << _BITS)) + 1
    parts = values.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    for k, bits in zip(*columns_of(parts.toArrow(), "k", "bits"), strict=True):
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) & ((1 << _BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class PrefixTree:
    """Rising arrays in a tree whose edges hold runs; values that begin alike share edges.

    A node is (run, shortest rest, longest rest, children, members that end here); rests are counted after the run.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.sets = sets
        self.root = self._node(order, 0, 0)

    def _node(self, members: list[int], start: int, end: int):
        """members share everything before ``end``; the node's run is [start, end)."""
        here = [m for m in members if len(self.sets[m]) == end]
        children, group = [], []
        for m in members:
            if len(self.sets[m]) > end:
                if group and self.sets[group[0]][end] != self.sets[m][end]:
                    children.append(self._edge(group, end))
                    group = []
                group.append(m)
        if group:
            children.append(self._edge(group, end))
        sizes = [len(self.sets[m]) for m in members]
        return (self.sets[members[0]][start:end] if members else None), min(sizes, default=0), max(sizes, default=0), children, here

    def _edge(self, group: list[int], start: int):
        first, last = self.sets[group[0]], self.sets[group[-1]]  # in order, so what these two share all share
        n = min(len(first), len(last), min(len(self.sets[m]) for m in group))
        differ = np.flatnonzero(first[start:n] != last[start:n])
        return self._node(group, start, start + int(differ[0]) if len(differ) else n)

    def links(self, probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(member, overlap) of every set that links with ``probe``."""
        found, size = [], len(probe)
        stack = [(self.root, 0, 0)]
        while stack:
            (run, short, long, children, here), overlap, at = stack.pop()
            end = at
            if run is not None and len(run):
                where = np.searchsorted(probe, run)
                overlap += int((probe[np.minimum(where, size - 1)] == run).sum())
                end = at + len(run)
                left = size - int(np.searchsorted(probe, run[-1], side="right"))
            else:
                left = size
            if overlap + min(left, long - end) < needed(size, short, percent):
                continue
            for m in here:
                if overlap >= needed(size, len(self.sets[m]), percent):
                    found.append((m, overlap))
            stack += [(c, overlap, end) for c in children]
        return found


def _sets(d: DataFrame, n: int) -> DataFrame:
    """For each text doc_id, n_shingles, digest; and for each shingle that two or more distinct sets of a task hold, shingle, n_sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("shingle", pa.int64()), ("n_sets", pa.int64())])

    def run(batches):
        counts: Counter[int] = Counter()
        seen: set[bytes] = set()
        waiting: list[np.ndarray] = []
        size = 0

        def add():
            if waiting:
                every = np.concatenate(waiting)
                waiting.clear()
                every.sort()  # in place; only what occurs again is copied
                values, again = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
                counts.update(dict(zip(values.tolist(), (again + 1).tolist(), strict=True)))

        for batch in in_slices(batches):
            out = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                s = shingle_set(text, n)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                out.append((doc_id, len(s), digest, None, None))
                if digest and digest not in seen:
                    seen.add(digest)
                    waiting.append(s)
                    size += len(s)
            if size > 4_000_000:
                add()
                seen.clear()
                size = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        add()
        if counts:
            none = lambda t: pa.nulls(len(counts), t)
            keys = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(keys), pa.array(list(counts.values()), pa.int64())], schema=schema)

    return d.mapInArrow(run, "doc_id long, n_shingles long, digest binary, shingle long, n_sets long")


class Frequent:
    """Order of the frequent shingles: 0 for others. A small filter spares most searches."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by_key = np.argsort(shingles)
        self.keys, self.counts = shingles[by_key], counts[by_key]
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[(self.keys >> np.uint64(40)).astype(np.int64)] = True

    def rank(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        some = np.flatnonzero(self.maybe[(s >> np.uint64(40)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, s[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == s[some], self.counts[at], 0)
        return out


_MARKS = 2048


def marks(s: np.ndarray) -> np.ndarray:
    """Bits that the low bits of a set's shingles hit, as 64-bit integers."""
    hit = np.zeros(_MARKS, np.uint8)
    hit[(s & np.uint64(_MARKS - 1)).astype(np.int64)] = 1
    return np.packbits(hit, bitorder="little").view("<i8")


def can_link(x: str, y: str, percent: int) -> Column:
    """Whether marks leave room for a link: each bit that only one set hits stands for at least one shingle that the other lacks."""
    lacks = lambda p, q: F.aggregate(F.zip_with(f"{p}.marks", f"{q}.marks", lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda t, c: t + c)
    most = F.least(F.col(f"{x}.n") - lacks(x, y), F.col(f"{y}.n") - lacks(y, x))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _marked(sets: DataFrame) -> DataFrame:
    """id, n, marks of ``sets``."""

    def run(batches):
        for batch in in_slices(batches):
            made = [np.frombuffer(x, "<u8") for x in batch.column("set").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in made], pa.int32()), pa.array([marks(s) for s in made], pa.list_(pa.int64()))], names=["id", "n", "marks"])

    return sets.mapInArrow(run, "id long, n int, marks array<long>")


def _prefixes(d: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """doc_id, digest, n, rare, prefix of every text with an id and words; ``frequent`` is a broadcast Frequent."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("rare", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        order = frequent.value
        for batch in in_slices(batches):
            out = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                s = shingle_set(text, n)
                if doc_id is None or not len(s):
                    continue
                rank = order.rank(s)
                size = min(len(s), len(s) - -(-percent * len(s) // 100) + shared(len(s)))
                plain = np.flatnonzero(rank == 0)
                if len(plain) >= size:
                    prefix = s[plain[:size]]
                else:
                    prefix = s[np.argsort(rank, kind="stable")[:size]]
                out.append((doc_id, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), len(plain), prefix.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return d.mapInArrow(run, "doc_id long, digest binary, n int, rare int, prefix array<long>")


def _listed(prefixes: DataFrame, wanted) -> DataFrame:
    """shingle, id, n, rare, pos of the prefix shingles that are in ``wanted``, a broadcast bitmap."""
    schema = pa.schema([("shingle", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            values, ends = prefix.flatten().to_numpy(), np.cumsum(prefix.value_lengths().to_numpy(zero_copy_only=False))
            lengths = np.diff(ends, prepend=0)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            pos = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
            keep = in_bitmap(wanted.value, values)
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), batch.column("doc_id").take(row), batch.column("n").take(row), batch.column("rare").take(row), pa.array(pos[keep].astype(np.int32))], schema=schema)

    return prefixes.select("doc_id", "n", "rare", "prefix").mapInArrow(run, "shingle long, id long, n int, rare int, pos int")


def _members(d: DataFrame, n: int, wanted) -> DataFrame:
    """id, set of the texts whose ids are in ``wanted``, a broadcast bitmap."""

    def run(batches):
        for batch in in_slices(batches):
            ids = batch.column("doc_id")
            keep = np.flatnonzero(in_bitmap(wanted.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))
            texts = batch.column("text").take(pa.array(keep)).to_pylist()
            made = [shingle_set(t, n).astype("<u8").tobytes() for t in texts]
            full = [k for k, s in enumerate(made) if s]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep[full])), pa.array([made[k] for k in full], pa.binary())], names=["id", "set"])

    return d.mapInArrow(run, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of those distinct ``pairs`` whose sets link. ``sets``: id, set (rising 64-bit integers as bytes).

    Members of a class that many pairs name are dealt over several trees.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("trees"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("trees")).cast("int").alias("tree"))
    member = dealt.join(sets, F.col("b") == F.col("id")).select("a", "tree", F.lit(1).alias("kind"), "b", "set")
    probe = dealt.select("a", "tree").distinct().join(sets, F.col("a") == F.col("id")).select("a", "tree", F.lit(0).alias("kind"), F.col("a").alias("b"), "set")
    rows = member.unionByName(probe).repartition("a", "tree").sortWithinPartitions("a", "tree", "kind")

    def run(batches):
        now, probes, ids, held = None, [], [], []

        def found():
            if not (held and probes):
                return None
            tree = PrefixTree(held)
            got = sorted({ids[m] for p in probes for m, _ in tree.links(p, percent)})
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(got), pa.int64()), pa.array(got, pa.int64())], names=["a", "b"]) if got else None

        for batch in in_slices(batches):
            for a, tree, kind, b, raw in zip(*columns_of(batch, "a", "tree", "kind", "b", "set"), strict=True):
                if (a, tree) != now or len(held) >= 2 * MEMBERS:
                    if (out := found()) is not None:
                        yield out
                    ids, held = [], []
                    if (a, tree) != now:
                        now, probes = (a, tree), []
                values = np.frombuffer(raw, "<u8")
                if kind:
                    ids.append(b)
                    held.append(values)
                else:
                    probes.append(values)
        if (out := found()) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long")


def _open_groups(members: DataFrame, by: list[str]) -> DataFrame:
    """For groups of ``members`` (..., id, c) that hold several components: how many members, the component with the most of them, and how many others."""
    sizes = members.groupBy(*by, "c").agg(F.count("*").alias("k"))
    groups = sizes.groupBy(*by).agg(F.sum("k").alias("members"), F.max(F.struct("k", "c")).alias("top"))
    return groups.where("members > top.k").select(*by, F.col("top.c").alias("main"), "members", (F.col("members") - F.col("top.k")).alias("others"))


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90, small: int = SMALL, wide: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_class for each row of ``docs``.

    Two texts link when 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest id that links reach. n_class is how many rows have the same set.
    """
    spark = docs.sparkSession
    d = id_and_text(docs, id_col, text_col)
    first = staged(_sets(d, n), "shingle-sets")
    own = first.where("shingle IS NULL").select("doc_id", "n_shingles", "digest")
    classes = staged(own.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_class")), "shingle-classes")
    known = first.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n_sets").alias("n_sets"))
    top = most_frequent(staged(known, "shingle-counts"), "n_sets", FREQUENT).toArrow()
    send = spark.sparkContext.broadcast
    frequent = send(Frequent(top.column("shingle").to_numpy().view(np.uint64), top.column("n_sets").to_numpy()))

    prefixes = _prefixes(d, n, percent, frequent).join(classes.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    prefixes = staged(prefixes.drop("digest"), "shingle-prefixes")
    twice_there = prefixes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count().where("count > 1")
    listed = staged(_listed(prefixes, send(bitmap(twice_there, F.col("shingle")))), "shingle-listed")
    groups = listed.groupBy("shingle").agg(F.count("*").alias("members"), F.min(F.struct("rare", "id", "n")).alias("hub")).where("members > 1")
    near = listed.join(groups, "shingle").select("shingle", "id", "n", "pos", "members", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    near = staged(near, "shingle-groups")

    sizes_fit = lambda x, y: (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))
    few, many = near.where(F.col("members") <= small), near.where(F.col("members") > small)
    x, y = few.select("shingle", "id", "n").alias("x"), few.select("shingle", "id", "n").alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & sizes_fit(F.col("x.n"), F.col("y.n")))
    often = F.count("*") >= F.greatest(F.lit(2), 1 + F.least(F.lit(3), F.floor(F.min(F.least("x.n", "y.n")) / 50)))
    pairs = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(often.alias("often")).where("often").select("a", "b")
    # a pair that shares a crowded shingle is met among the crowded ones below, so it needn't be given often here
    crowded = staged(many.select("id").distinct(), "shingle-crowded")
    pairs = staged(pairs, "shingle-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowded)
    sets = staged(_members(d, n, send(bitmap(ids, F.col("id")))), "shingle-members")  # a few more than wanted, which nothing below asks for
    marked = staged(_marked(sets.join(crowded, "id", "left_semi")), "shingle-marks")
    of = lambda side: marked.select(F.col("id").alias(side), F.struct("n", "marks").alias(side[0]))
    to_hub = many.where((F.col("id") != F.col("hub")) & sizes_fit(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a_id"), F.col("id").alias("b_id")).distinct()
    to_hub = to_hub.join(of("a_id"), "a_id").join(of("b_id"), "b_id").where(can_link("a", "b", percent)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    pairs = staged(pairs.union(to_hub).distinct(), "shingle-pairs")
    links = staged(verified(pairs, sets, percent), "shingle-links")
    joined = components(links)

    labelled = many.join(joined, F.col("id") == F.col("node"), "left").select("shingle", "id", "n", F.coalesce("component", "id").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "shingle")))
    own_keys = many.groupBy("id").agg(F.transform(ordered, lambda k: k["shingle"]).alias("keys"))
    rest = labelled.join(_open_groups(labelled, ["shingle"]), "shingle").join(own_keys, "id")
    before = F.slice("keys", F.lit(1), F.array_position("keys", F.col("shingle")).cast("int") - 1)
    rest = staged(rest.select("shingle", F.lit(None).cast("long").alias("second"), "id", "n", "c", before.alias("before"), "main", "members", "others"), "shingle-rest")
    # classes that link share a second shingle of their prefixes, by which groups with many others are split
    partners = near.select("id", F.col("shingle").alias("second"))
    split = rest.where(F.col("others") > wide).drop("second", "main", "members", "others").join(partners, "id").where("shingle <> second")
    split = split.join(_open_groups(split, ["shingle", "second"]), ["shingle", "second"]).select(rest.columns)
    rest = staged(rest.where(F.col("others") <= wide).unionByName(split).join(marked.select("id", "marks"), "id"), "shingle-rest")
    # a group's largest component needn't meet itself: all others go to each part of the group, which are dealt by a hash
    salts = F.ceil(F.col("members") / PART).cast("int")
    x = rest.where("c <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).alias("x")
    y = rest.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).alias("y")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("shingle", "second", "salt")]
    once = (F.col("y.c") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    across = x.join(y, same[0] & same[1] & same[2] & once & (F.col("x.c") != F.col("y.c")) & sizes_fit(F.col("x.n"), F.col("y.n")) & ~F.arrays_overlap("x.before", "y.before") & can_link("x", "y", percent))
    across = across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = verified(staged(across, "shingle-pairs"), sets, percent)
    twice = own.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    shared = own.join(twice, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    every = components(links.union(more).union(shared))

    named = classes.join(every, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"), "n_class")
    out = own.join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.when(F.col("digest").isNotNull(), F.coalesce("n_class", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("n_class"))
