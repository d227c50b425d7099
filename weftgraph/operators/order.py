"""Places of rows in a total order, and the first rows of many groups, without a task that holds a whole group.

``places`` sorts by range: each task sorts a slice of the order, the slices' sizes (one number per slice) are summed up
in order, and a row's place is the rows of all earlier slices plus its place within its own. ``group_places`` does the
same for places within groups, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: The bits of a row's number within its task in ``monotonically_increasing_id``.
_WITHIN = 33


def _slices(df: DataFrame, order: Sequence[Column | str], slices: int | None) -> DataFrame:
    n = slices or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    return written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", at))


def places(df: DataFrame, *order: Column | str, name: str = "place", slices: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place (from 0) in the order over all rows. Rows that tie keep some order among each other.

    Null keys sort as the order says (Spark: first when ascending). An empty table stays empty. A table whose rows are
    mostly one key needs a further column in ``order`` to be cut evenly.
    """
    d = _slices(df, order, slices).withColumn("__slice", F.shiftrightunsigned("__at", _WITHIN).cast("int"))
    sizes = d.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    # One row per slice: their running sum is a matter of the number of slices, not of rows.
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).drop("__n")
    own = F.col("__at").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return d.join(F.broadcast(before), "__slice").withColumn(name, F.col("__before") + own).drop("__slice", "__at", "__before")


def group_places(df: DataFrame, group: Sequence[str], *order: Column | str, name: str = "place", slices: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place (from 0) in the order within its group; null group keys are one group.

    Groups follow each other in one order over all rows, cut into slices like any other; a row's place in its group is its
    place less that of the group's first row.
    """
    g = [F.col(f"`{c}`") for c in group]
    d = written(places(df, *g, *order, name="__place", slices=slices))
    keys = [f"__g{i}" for i in range(len(group))]
    # The groups' starts are written first, so that the join's both sides are dealt anew and a hot group's rows are split.
    starts = written(d.groupBy(*[c.alias(k) for c, k in zip(g, keys)]).agg(F.min("__place").alias("__first")))
    match = reduce(lambda x, y: x & y, (d[f"`{c}`"].eqNullSafe(starts[k]) for c, k in zip(group, keys)))
    return d.join(starts, match).withColumn(name, F.col("__place") - F.col("__first")).drop("__place", "__first", *keys)


def top(df: DataFrame, group: Sequence[str], k: int, *order: Column | str, name: str = "rank", lanes: int = 64) -> DataFrame:
    """The first ``k`` rows of each group with their rank (from 1): the first ``k`` of each of ``lanes`` parts, then of those.

    No task holds a group: a part has a ``lanes``-th of it, and what remains of a group is ``lanes`` times ``k`` rows.
    Rows are dealt to parts by their content, so that equal rows meet and a retry deals them the same way.
    """
    lane = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and t != "variant"]), F.lit(lanes))
    part = Window.partitionBy(*[F.col(f"`{c}`") for c in group], "__lane").orderBy(*order)
    d = df.withColumn("__lane", lane).withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= k).drop("__lane", "__r")
    return d.withColumn(name, F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in group]).orderBy(*order))).where(F.col(name) <= k)
