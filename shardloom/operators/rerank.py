"""Reranking over the chunk hierarchy as chains of windows that are all partitioned by query.

Rows: query_id, pos (place in the list), chunk_id, score, role, parent_key, child_key. Ties follow
``pos``, which each step renews: rows without a key first, then groups by their first member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

LEAST_HITS = 4
DIVISOR = 10


def _placed(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def _by_group(df: DataFrame, key: str) -> DataFrame:
    first = F.min("pos").over(Window.partitionBy("query_id", key))
    return _placed(df.withColumn("_first", first), F.col(key).isNotNull(), F.when(F.col(key).isNotNull(), F.col("_first")), "pos").drop("_first")


def deduplicated(df: DataFrame) -> DataFrame:
    """The best row of each chunk at the place of the chunk's first; rows without a chunk id all stay, at the end."""
    named = F.coalesce(F.col("chunk_id"), F.lit("")) != ""
    w = Window.partitionBy("query_id", "chunk_id")
    d = df.withColumns({"_named": named, "_best": F.row_number().over(w.orderBy(F.desc("score"), "pos")), "_first": F.min("pos").over(w)})
    return _placed(d.where(~F.col("_named") | (F.col("_best") == 1)), ~F.col("_named"), F.when(F.col("_named"), F.col("_first")), "pos").drop("_named", "_best", "_first")


def dropped_below(df: DataFrame, key: str, keep: str, drop: tuple[str, ...]) -> DataFrame:
    """Without rows of ``drop`` roles that score under their group's best ``keep`` row."""
    anchor = F.max(F.when(F.col("role") == keep, F.col("score"))).over(Window.partitionBy("query_id", key))
    d = df.withColumn("_anchor", F.when(F.col(key).isNotNull(), anchor))
    gone = F.coalesce(F.col("role").isin(*drop) & (F.col("score") < F.col("_anchor")), F.lit(False))
    return _by_group(d.where(~gone).drop("_anchor"), key)


def promoted(df: DataFrame, key: str, giver: str, taker: str, least: int) -> DataFrame:
    """Where a group has a ``taker`` and enough ``giver`` rows, the best taker gets the givers' best score if it is higher, and the givers go."""
    w = Window.partitionBy("query_id", key)
    takes = F.col("role") == taker
    d = df.withColumns(
        {
            "_best": F.max(F.when(F.col("role") == giver, F.col("score"))).over(w),
            "_givers": F.count(F.when(F.col("role") == giver, 1)).over(w),
            "_takers": F.count(F.when(takes, 1)).over(w),
            "_place": F.row_number().over(Window.partitionBy("query_id", key, takes).orderBy(F.desc("score"), "pos")),
        }
    )
    acts = F.coalesce(F.col(key).isNotNull() & (F.col("_takers") > 0) & (F.col("_givers") >= least), F.lit(False))
    d = d.withColumn("_acts", acts).where(~(F.col("_acts") & F.coalesce(F.col("role") == giver, F.lit(False))))
    score = F.when(F.col("_acts") & takes & (F.col("_place") == 1), F.greatest("score", "_best")).otherwise(F.col("score"))
    return _by_group(d.withColumn("score", score).drop("_best", "_givers", "_takers", "_place", "_acts"), key)


def orphans_to_parents(df: DataFrame) -> DataFrame:
    """Grandchildren left without a child give their best score to the best parent of the same key and go; without such a parent they stay, at the end.

    If a query has a grandchild with a parent key, its grandchildren without one go too.
    """
    orphan = F.coalesce(F.col("role") == "grandchild", F.lit(False))
    keyed = orphan & (F.coalesce(F.col("parent_key"), F.lit("")) != "")
    by_key, by_query = Window.partitionBy("query_id", "parent_key"), Window.partitionBy("query_id")
    parent = F.coalesce((F.col("role") == "parent") & F.col("parent_key").isNotNull(), F.lit(False))
    d = df.withColumns(
        {
            "_any": F.max(keyed.cast("int")).over(by_query),
            "_best": F.max(F.when(keyed, F.col("score"))).over(by_key),
            "_parents": F.count(F.when(parent, 1)).over(by_key),
            "_place": F.row_number().over(Window.partitionBy("query_id", "parent_key", parent).orderBy(F.desc("score"), "pos")),
            "_first": F.min(F.when(keyed, F.col("pos"))).over(by_key),
        }
    )
    stays = ~orphan | (F.col("_any") == 0) | (keyed & (F.col("_parents") == 0))
    score = F.when(parent & (F.col("_place") == 1) & F.col("_best").isNotNull(), F.greatest("score", "_best")).otherwise(F.col("score"))
    late = orphan & (F.col("_any") == 1)
    d = d.where(stays).withColumn("score", score)
    return _placed(d, late, F.when(late, F.col("_first")), "pos").drop("_any", "_best", "_parents", "_place", "_first")


def cut(df: DataFrame, top_k: Column) -> DataFrame:
    """The best max(4, top_k // 10) rows, or all if there are fewer, with rank and effective_top_k."""
    w = Window.partitionBy("query_id")
    wanted = F.greatest(F.lit(LEAST_HITS), F.floor(top_k / DIVISOR).cast("int"))
    d = df.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "pos")), "_left": F.count("*").over(w)})
    d = d.withColumn("effective_top_k", F.least(wanted, F.col("_left").cast("int")))
    return d.where("rank <= effective_top_k").drop("_left")


def identity(df: DataFrame, top_k: int) -> DataFrame:
    """The list as it is; the effective top_k is the one asked for."""
    return df.withColumns({"rank": F.col("pos"), "effective_top_k": F.lit(top_k)})


def hierarchical(df: DataFrame, top_k: int, cut_at_average: bool = True) -> DataFrame:
    """Duplicates and weaker descendants go, scores move up the hierarchy, rows at or under the average go (with ``cut_at_average``, as does merging children into parents), and the best stay.

    Queries with fewer than four hits are left as they are.
    """
    w = Window.partitionBy("query_id")
    d = df.withColumns({"_n": F.count("*").over(w), "_average": F.avg("score").over(w)})
    few = d.where(F.col("_n") < LEAST_HITS).withColumns({"rank": F.col("pos"), "effective_top_k": F.col("_n").cast("int")}).drop("_n", "_average")
    m = deduplicated(d.where(F.col("_n") >= LEAST_HITS))
    m = dropped_below(m, "parent_key", "parent", ("child", "grandchild"))
    m = dropped_below(m, "child_key", "child", ("grandchild",))
    m = orphans_to_parents(promoted(m, "child_key", "grandchild", "child", 1))
    if cut_at_average:
        m = promoted(m.where(F.col("score") > F.col("_average")), "parent_key", "child", "parent", 2)
    return cut(m.drop("_n", "_average"), F.lit(top_k)).unionByName(few)
