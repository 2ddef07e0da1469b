"""Ranks, running totals and exact quantiles without a one-task window.

A window with no partition, or partitioned by a two-valued label, puts all rows on one task.
Here the order column is cut into ranges of about equal row numbers; totals per range give each
range its start, and a window inside (group, range) does the rest. Heavy ties do no harm, as the
callers group equal values into one row first.

The ordered table is read three times (cuts, totals, rows). It is narrow and usually counted
already, so it is written once and what produced it runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.sources.scratch import written

CUT_ERROR = 0.01


def range_cuts(df: DataFrame, order: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` values that cut the order column into even ranges."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(order, shares, min(CUT_ERROR, 0.25 / buckets))))


def with_ranges(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Add ``_range``, rising with the order column."""
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numeric = df.withColumn("_order", F.col(order).cast("double"))
    cuts = range_cuts(numeric, "_order", buckets)
    if not cuts:
        return df.withColumn("_range", F.lit(0.0))
    edges = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=edges, inputCol="_order", outputCol="_range").transform(
        numeric).drop("_order")


def running_totals(df: DataFrame, order: str, totals: dict[str, Column], by: Sequence[str] = (),
                   descending: bool = False, tie: str | None = None,
                   buckets: int | None = None, stored: bool = False,
                   keep_range: bool = False) -> DataFrame:
    """Add inclusive running totals of ``totals`` along ``order`` within each ``by`` group.

    Rows that tie need ``tie`` as a second key; otherwise the order must be unique per group.
    Pass narrow rows; ``stored`` says that ``df`` is a written table already,
    ``keep_range`` leaves the range number in ``_range``.
    """
    ranged = with_ranges(df if stored else written(df, "ordered"), order, buckets)
    keys = [*by, "_range"]

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    # One row per (group, range): small, and the only thing a per-group window sees.
    sums = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    ahead = W.partitionBy(*(by or [F.lit(0)])).orderBy(direction("_range")).rowsBetween(
        W.unboundedPreceding, -1)
    starts = sums.select(*keys, *[
        F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_start_{n}") for n in totals])
    within = W.partitionBy(*keys).orderBy(
        direction(order), *([F.col(tie).asc()] if tie else [])).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    joined = join_groups(ranged, starts, keys)
    return joined.withColumns({
        n: F.sum(c).over(within) + F.col(f"_start_{n}") for n, c in totals.items()
    }).drop(*[f"_start_{n}" for n in totals], *([] if keep_range else ["_range"]))


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join that also matches NULL group keys."""
    renamed = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                            *[c for c in groups.columns if c not in keys])
    match = F.lit(True)
    for i, key in enumerate(keys):
        same = F.col(key).eqNullSafe(F.col(f"_k_{key}"))
        match = same if i == 0 else match & same
    return rows.join(renamed, match).drop(*[f"_k_{k}" for k in keys])


def position_in_order(df: DataFrame, order: str, tie: str, by: Sequence[str] = (),
                      position: str = "position", buckets: int | None = None) -> DataFrame:
    """1-based position of each row in its group; ``order, tie`` must be unique in the group."""
    return running_totals(df, order, {position: F.lit(1)}, by, tie=tie, buckets=buckets)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., value, n``: equal values become one row before anything is ordered."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.count("*").alias("n")))


def ranks_of_counts(counts: DataFrame, value: str, by: Sequence[str] = (),
                    buckets: int | None = None, stored: bool = False) -> DataFrame:
    """``by..., value, n, avg_rank`` from ``by..., value, n``, ties sharing their mean rank."""
    upto = running_totals(counts, value, {"upto": F.col("n")}, by, buckets=buckets, stored=stored)
    return upto.select(*by, value, "n",
                       (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("avg_rank"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (),
                  buckets: int | None = None) -> DataFrame:
    """The same from rows."""
    return ranks_of_counts(value_counts(df, value, by), value, by, buckets)


def quantiles_of_counts(counts: DataFrame, value: str, shares: dict[str, float],
                        by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Exact quantiles per group, linear between neighbours, from a written table of
    ``by..., value, n``."""
    upto = running_totals(counts, value, {"upto": F.col("n")}, by, buckets=buckets, stored=True)
    if by:
        sizes = counts.groupBy(*by).agg(F.sum("n").alias("_rows"))
        upto = join_groups(upto, sizes, by)
    else:
        upto = upto.withColumn("_rows", counts.agg(F.sum("n")).scalar())
    number = F.col(value).cast("double")
    cells = []
    for name, share in shares.items():
        spot = F.lit(float(share)) * (F.col("_rows") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(spot), number))
        high = F.min(F.when(F.col("upto") > F.ceil(spot), number))
        part = F.max(spot - F.floor(spot))
        cells.append((low + (high - low) * part).alias(name))
    return upto.groupBy(*by).agg(*cells)


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """The same from rows."""
    counts = written(value_counts(df, value, by), "value-counts")
    return quantiles_of_counts(counts, value, shares, by, buckets)
