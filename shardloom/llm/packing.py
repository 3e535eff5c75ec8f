"""Best-fit packing into sequences of several permitted lengths (operator 7).

Texts longer than the longest length are cut into pieces, all others are one piece, so every token
is packed. Pieces are dealt by a hash over shards of about ``shard_pieces`` pieces, as many as the
input needs, and each shard is packed alone: pieces, longest first, go to the open bin that they
leave least room in; where none has room, a bin of the least-cost length is opened, by what that
length costs for each token it can be expected to hold. In the end each bin is downsized to the
shortest permitted length that holds its contents.

Rows: null or empty text has no tokens and no piece, and isn't in the result; a null id is packed
like others; repeated rows are each packed; an empty table gives an empty table; extra columns are
ignored. text_key, the MD5 digest of a row's text, says which text a piece belongs to where rows share an
id or have none; sequences() goes by it, so each placed piece comes back once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_and_text, partitions_for, staged


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths, rising, and what a sequence costs besides its length, in tokens."""

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    overhead: int = 64

    def cost(self, length: int) -> float:
        """Attention makes long sequences dearer than in proportion."""
        return self.overhead + length * (1 + length / (8 * self.permitted[-1]))

    def least(self, tokens: int) -> int:
        return self.permitted[bisect_left(self.permitted, tokens)]


def opening(size: int, smaller: list[int], lengths: Lengths) -> int:
    """The length to open for a piece of ``size`` tokens: the least cost per token expected in it.

    ``smaller`` holds how many tokens of pieces still to come are at most as long as each permitted
    length; room is expected to be filled as far as such pieces go around.
    """
    best, cheapest = lengths.permitted[-1], float("inf")
    for k, length in enumerate(lengths.permitted):
        if length >= size:
            room = length - size
            fits = sum(1 for x in lengths.permitted[: k + 1] if x <= room)
            filled = min(room, smaller[fits]) if room else 0
            cost = lengths.cost(length) / (size + filled)
            if cost < cheapest:
                best, cheapest = length, cost
    return best


def pack(sizes: list[int], lengths: Lengths) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, which must be falling; and each bin's length after downsizing."""
    bins, offsets, used, room = [0] * len(sizes), [0] * len(sizes), [], []
    open_bins: list[tuple[int, int]] = []  # (room, bin), rising
    bounds = [0, *lengths.permitted]
    smaller = [0] * (len(bounds))  # tokens still to come in pieces of at most bounds[k]
    for s in sizes:
        for k in range(bisect_left(bounds, s), len(bounds)):
            smaller[k] += s
    for i, s in enumerate(sizes):
        for k in range(bisect_left(bounds, s), len(bounds)):
            smaller[k] -= s
        at = bisect_left(open_bins, (s, -1))
        if at < len(open_bins):
            _, b = open_bins.pop(at)
        else:
            b = len(used)
            used.append(0)
            room.append(opening(s, smaller, lengths))
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        room[b] -= s
        if room[b] > 0:
            insort(open_bins, (room[b], b))
    return bins, offsets, [lengths.least(u) for u in used]


def word_tokens(text: str = "text") -> Column:
    """Number of words, the default size of a text; another count can be passed as a column."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def best_fit(docs: DataFrame, lengths: Lengths = Lengths(), size: Column | None = None, shard_pieces: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, piece, n_tokens, bin, bin_offset, bin_length: where each piece of each text lies.

    ``size``: tokens of a text, as a column over doc_id and text; the number of its words if not
    given. ``bin`` names a sequence by shard and number.
    """
    return best_fit_of(id_and_text(docs, id_col, text_col).select("doc_id", F.md5("text").alias("text_key"), (word_tokens() if size is None else size).cast("long").alias("size")), lengths, shard_pieces)


def best_fit_tokens(docs: DataFrame, tokenizer_json: str, lengths: Lengths = Lengths(), shard_pieces: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lean: bool = False) -> DataFrame:
    """best_fit() of texts by the number of their tokens, as operator 4 writes them; ``lean`` as in token_sizes()."""
    from .token_output import token_sizes

    return best_fit_of(token_sizes(docs, tokenizer_json, id_col, text_col, lean), lengths, shard_pieces)


def best_fit_of(sized: DataFrame, lengths: Lengths = Lengths(), shard_pieces: int = 20_000) -> DataFrame:
    """best_fit() of doc_id, text_key, size."""
    longest = lengths.permitted[-1]
    sized = staged(sized.where("size > 0"), "packing-sizes")
    pieces = sized.select("doc_id", "text_key", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / longest).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "text_key", "piece", F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("long").alias("n_tokens"))
    total = sized.agg(F.coalesce(F.sum(F.floor((F.col("size") - 1) / longest) + 1), F.lit(0))).first()[0]
    shards = partitions_for(int(total), shard_pieces)
    # whole rows are hashed with a number from their place, as many may share an id and a size
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("text_key", "ascending"), ("piece", "ascending")])
        bins, offsets, made = pack(rows.column("n_tokens").to_pylist(), lengths)
        shard = rows.column("shard")[0].as_py()
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "text_key": rows.column("text_key"),
                "piece": rows.column("piece"),
                "n_tokens": rows.column("n_tokens"),
                "bin": pa.array([(shard << 32) | b for b in bins], pa.int64()),
                "bin_offset": pa.array(offsets, pa.int64()),
                "bin_length": pa.array([made[b] for b in bins], pa.int64()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, text_key string, piece int, n_tokens long, bin long, bin_offset long, bin_length long")


def sequences(placed: DataFrame, docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", longest: int = Lengths().permitted[-1]) -> DataFrame:
    """bin, bin_length, ids: the token ids of each sequence, from where best_fit_tokens() put the pieces of ``docs``.

    A sequence has one or more pieces and at most ``longest`` ids, so a group is bounded. Pieces meet their text by
    its digest, and each text is taken once however many rows repeat it, so no placed piece is lost or doubled.
    """
    from .token_output import token_ids

    keyed = docs.select(F.md5(F.col(f"`{text_col}`").cast("string")).alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text")).where("_key IS NOT NULL").dropDuplicates(["_key"])
    ids = token_ids(keyed, tokenizer_json, None, "_text").where(F.size("ids") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / longest).cast("int"))
    pieces = ids.select("text_key", F.posexplode(F.transform(starts, lambda k: F.slice("ids", k * longest + 1, F.lit(longest)))).alias("piece", "part"))
    held = F.array_sort(F.collect_list(F.struct("bin_offset", "part")))
    return placed.join(pieces, ["text_key", "piece"]).groupBy("bin", "bin_length").agg(F.flatten(F.transform(held, lambda x: x["part"])).alias("ids"))
