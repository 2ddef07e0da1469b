"""Train/test splits and folds that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.operators.ordering import position_in_order

# Fixed value: 0.2 of the 32-bit hash range, in hex.
TEST_BELOW = "33333333"
TEST = "test"
TRAIN = "train"
VALIDATION = "validation"


def seeded_hash(id_column: Column, seed: object) -> Column:
    return F.md5(F.concat(id_column.cast("string"), F.lit(f":{seed}")))


def hash_number(id_column: Column, seed: object, digits: int = 13) -> Column:
    """The first hex digits of the seeded hash as a number a double holds exactly."""
    return F.conv(F.substring(seeded_hash(id_column, seed), 1, digits), 16, 10).cast("bigint")


def hash_threshold(test_size: float) -> str:
    """Upper end of the hash range that holds ``test_size`` of all ids."""
    if test_size == 0.2:
        return TEST_BELOW
    return format(min(int(test_size * 2**32), 2**32 - 1), "08x")


def split_column(id_column: Column, seed: int = 42, test_size: float = 0.2) -> Column:
    """``test`` for about ``test_size`` of the ids, ``train`` for the rest."""
    head = F.substring(seeded_hash(id_column, seed), 1, 8)
    return F.when(head < hash_threshold(test_size), TEST).otherwise(TRAIN)


def with_split(df: DataFrame, seed: int = 42, test_size: float = 0.2) -> DataFrame:
    return df.withColumn("split", split_column(F.col("id"), seed, test_size))


def with_three_way_split(df: DataFrame, seed: int = 42, test_size: float = 0.2,
                         validation_size: float = 0.1) -> DataFrame:
    """``train``, ``validation`` and ``test`` by one hash: the test rows are those of
    ``with_split``, so a model tuned on the validation rows is still scored on unseen ones."""
    head = F.substring(seeded_hash(F.col("id"), seed), 1, 8)
    return df.withColumn("split", F.when(head < hash_threshold(test_size), TEST).when(
        head < hash_threshold(test_size + validation_size), VALIDATION).otherwise(TRAIN))


def scope_rows(df: DataFrame, scope: str) -> DataFrame:
    """``test``: the held-out rows of a split table; ``all``: every row."""
    if scope == "all":
        return df
    if scope == TEST:
        return df.filter(F.col("split") == TEST)
    raise ValueError(f"unknown scope {scope!r}")


def first_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order: a repeatable sample for a trial run."""
    return (df.withColumn("_order", seeded_hash(F.col("id"), seed))
            .orderBy("_order", "id").limit(n).drop("_order"))


def exact_split(df: DataFrame, seed: int = 42, test_size: float = 0.2) -> DataFrame:
    """Exactly ceil(``test_size`` x n) test rows: those first in seeded order.

    The order is a bucketed running count, so no task ever holds the whole table.
    """
    keyed = df.withColumn("_hash", hash_number(F.col("id"), seed))
    placed = position_in_order(keyed.select("id", "_hash"), "_hash", tie="id", position="_place")
    wanted = F.ceil(F.lit(test_size) * df.agg(F.count("*")).scalar())
    marked = placed.select(
        "id", F.when(F.col("_place") <= wanted, TEST).otherwise(TRAIN).alias("split"))
    return df.join(marked, "id")


def fold_of_place(place: Column, before: Column, size: Column, k: int) -> Column:
    """Fold of the ``place``-th row (from 0) of a class when classes lie one after another.

    Dealing all rows out in turn gives fold f, of the class occupying positions
    [before, before+size), as many rows as that range has positions equal to f modulo k. The
    class fills its folds in order, each up to its share.
    """

    def share_up_to(fold: int) -> Column:
        """Rows of the class dealt to folds 0..fold."""
        parts = []
        for f in range(fold + 1):
            upper = F.floor((before + size - 1 - f) / F.lit(k))
            lower = F.floor((before - 1 - f) / F.lit(k))
            parts.append(upper - lower)
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    fold = F.lit(k - 1)
    for f in range(k - 2, -1, -1):
        fold = F.when(place < share_up_to(f), F.lit(f)).otherwise(fold)
    return fold.cast("int")


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """``id, fold`` with equal class shares: in id order, or shuffled when a seed is given."""
    if seed is None:
        keyed = df.select("id", label, F.col("id").alias("_key"))
    else:
        keyed = df.select("id", label, hash_number(F.col("id"), seed).alias("_key"))
    placed = position_in_order(keyed, "_key", tie="id", by=[label], position="_place")
    # One row per class value: sizes, and the rows of the classes that come before it. Classes
    # are taken in the order in which they first occur.
    earlier = W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    before = (keyed.groupBy(label).agg(F.count("*").alias("_size"), F.min("id").alias("_first"))
              .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))))
    fold = fold_of_place(F.col("_place") - 1, F.col("_before"), F.col("_size"), k)
    return placed.join(before, label).select("id", label, fold.alias("fold"))


def hash_folds(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds without any shuffle, stratified in expectation: the choice for very large tables."""
    return df.withColumn("fold", F.pmod(hash_number(F.col("id"), seed), F.lit(k)).cast("int"))
