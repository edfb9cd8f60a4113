"""Ranking inside groups that may be too large for one task.

A window over a whole group sorts that group in one task. Both functions here first count rows
per small slice of the group, so the only whole-group windows run over slice counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sliced_rank(df: DataFrame, group: list[str], slice_of: Column, order: list[Column],
                rank: str = "rank", size: str = "size") -> DataFrame:
    """Add the 0-based rank in each group and the group's size.

    ``slice_of`` cuts a group into consecutive pieces: it must never decrease along ``order``.
    """
    rows = df.withColumn("_slice", slice_of)
    counts = rows.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    offsets = counts.select(
        *group, "_slice",
        F.sum("_n").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_n").over(whole).alias(size), "_n")
    place = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    return (rows.withColumn("_place", place)
            .join(offsets, [*group, "_slice"])
            .withColumn(rank, F.col("_upto") - F.col("_n") + F.col("_place") - 1)
            .drop("_slice", "_place", "_upto", "_n"))


def first_within_quota(df: DataFrame, group: str, quota: str, slots: list[Column], order: list[Column]) -> DataFrame:
    """The first ``quota`` rows of each group, by ``order``; the quota is the same in all rows of a group.

    ``slots`` are keys from coarse to fine, never NULL, that together never decrease along ``order`` (for
    instance hour, second, block of ids). Rows are counted per slot. Going from coarse to fine gives each
    group the slot where its quota runs out; earlier slots pass whole, later ones are dropped, and only
    rows within one finest slot are ever sorted. The result is that of one row_number over the group.
    """
    names = [f"_slot{i}" for i in range(len(slots))]
    rows = df.withColumns(dict(zip(names, slots)))
    # The quota is a key here, not a maximum, so that no use of the counts changes what is counted and all
    # of them share one shuffle.
    counts = rows.groupBy(group, F.col(quota).alias("_quota"), *names).agg(F.count("*").alias("_n"))
    inside = counts
    for depth in range(1, len(names) + 1):
        prefix = names[:depth]
        level = inside.groupBy(group, "_quota", *prefix).agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(group).orderBy(prefix[-1])
                                .rowsBetween(Window.unboundedPreceding, 0))
        cut = (level.withColumn("_before", upto - F.col("_n"))
               .where((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") >= F.col("_quota")))
               .select(group, *prefix, (F.col("_quota") - F.col("_before")).alias("_left")))
        if depth < len(names):
            inside = counts.drop("_quota").join(cut, [group, *prefix]).withColumnRenamed("_left", "_quota")
    slot = F.struct(*names)
    cuts = cut.select(group, slot.alias("_cut"), "_left")
    reachable = (rows.where(F.col(quota) > 0).join(cuts, group, "left")
                 .where(F.col("_cut").isNull() | (slot <= F.col("_cut"))))
    place = F.row_number().over(Window.partitionBy(group, *names).orderBy(*order))
    return (reachable.withColumn("_place", place)
            .where(F.col("_cut").isNull() | (slot < F.col("_cut")) | (F.col("_place") <= F.col("_left")))
            .drop(*names, "_cut", "_left", "_place"))
