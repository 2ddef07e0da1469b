"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is in a document if the document's set of ``n``-word shingles holds ``percent`` % of the
item's. Everything is built of SQL functions.

1. Of a document only the shingles that occur in some item can count. They are found by a join with
   the items' shingles, which Spark broadcasts only if their written size allows it.
2. What is left of a document and the items get MinHash signatures of ``SLOTS`` values, and both
   are put into size classes by powers of two. For two classes, containment implies a least Jaccard
   similarity ``c / (u / q + 1 - c)`` with ``u`` the largest document and ``q`` the smallest item,
   so each pair of classes has its own bands: the longest rows that still lose fewer than
   ``MISSED`` of such pairs.
3. If even single-slot bands lose more (the document holds far more than the item, as when it
   carries many items), the pairs of the two classes are counted exactly over shared shingles.
4. Candidates are checked on the full sets: ``100 x shared >= percent x item``.

Items and documents of fewer than ``n`` words have one shingle of all their words. NULL and empty
texts, and rows without an id, contain nothing and are contained in nothing. Repeated rows count
once; rows that share an id are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.sources.scratch import written

SLOTS = 64
MISSED = 1e-4
ROW_COUNTS = (4, 2, 1)
MOST_CLASSES = 24


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingles(tokens: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words; of all words if there are fewer; none of none."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
        lambda i: F.xxhash64(*[F.element_at(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, runs).when(
        F.size(tokens) > 0, F.array(F.xxhash64(F.array_join(tokens, " "))))


def _exploded(frame: DataFrame, id_col: str, text_col: str, name: str, n: int) -> DataFrame:
    """One row ``name, s`` per shingle of every row with an id."""
    # The words are a column of their own, or they would be cut anew for every shingle.
    cut = frame.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias(name), words(F.col(text_col)).alias("words"))
    return cut.select(name, F.explode(shingles(F.col("words"), n)).alias("s"))


def signature(elements: Column, slots: int = SLOTS) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda seed: F.array_min(
        F.transform(elements, lambda x: F.xxhash64(x, seed))))


def size_class(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double"))).cast("int")


def rows_per_band(item_class: int, doc_class: int, percent: int, slots: int = SLOTS) -> int:
    """The longest band rows that keep the pairs of two classes; 0 if none does."""
    c, q, u = percent / 100, 2.0 ** item_class, 2.0 ** (doc_class + 1)
    least = min(1.0, c / (u / q + 1 - c))
    for rows in ROW_COUNTS:
        if (1 - least ** rows) ** (slots // rows) <= MISSED:
            return rows
    return 0


def banded(frame: DataFrame, classes_rows: Column) -> DataFrame:
    """``id, doc_class, band code`` for each (document class, rows per band) of ``classes_rows``."""
    each = frame.withColumn("use", F.explode(classes_rows))
    rows = F.col("use.rows")
    codes = F.transform(
        F.sequence(F.lit(0), (F.lit(SLOTS) / rows).cast("int") - 1),
        lambda band: F.xxhash64(band, rows, F.slice(F.col("signature"), band * rows + 1, rows)))
    return each.select("id", F.col("use.doc_class").alias("doc_class"),
                       F.explode(codes).alias("code"))


def _uses(pairs: dict[int, list[tuple[int, int]]], class_col: str) -> Column:
    """The (document class, rows) list of each row's class, as a literal per class."""
    out = None
    for size, uses in sorted(pairs.items()):
        listed = F.array(*[F.struct(F.lit(d).alias("doc_class"), F.lit(r).alias("rows"))
                           for d, r in uses])
        chosen = F.col(class_col) == size
        out = F.when(chosen, listed) if out is None else out.when(chosen, listed)
    return out


def contained(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80,
              id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every contained item."""
    parts = _exploded(items, item_id, item_text, "item_id", n).distinct()
    parts = written(parts, "item-shingles")
    wanted = written(parts.select("s").distinct(), "wanted")
    hits = _exploded(docs, id_col, text_col, "doc_id", n).join(wanted, "s", "left_semi")
    left = hits.groupBy("doc_id").agg(F.collect_set("s").alias("x"))
    left = written(left.select(
        F.col("doc_id").alias("id"), "x", size_class(F.size("x")).alias("size_class")), "left")
    whole = written(parts.groupBy("item_id").agg(F.collect_set("s").alias("q")).select(
        F.col("item_id").alias("id"), "q", size_class(F.size("q")).alias("size_class")), "items")
    item_classes = [r[0] for r in whole.select("size_class").distinct().collect()]
    doc_classes = [r[0] for r in left.select("size_class").distinct().collect()]

    by_item: dict[int, list[tuple[int, int]]] = {}
    by_doc: dict[int, list[tuple[int, int]]] = {}
    exact: list[Column] = []
    for q in item_classes:
        for d in doc_classes:
            if 2.0 ** (d + 1) * 100 < percent * 2.0 ** q:
                continue
            rows = rows_per_band(q, d, percent)
            if not rows:
                exact.append((F.col("item_class") == q) & (F.col("doc_class") == d))
                continue
            by_item.setdefault(q, []).append((d, rows))
            if (d, rows) not in by_doc.setdefault(d, []):
                by_doc[d].append((d, rows))

    pairs = left.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    if by_item:
        sides = []
        for frame, elements, uses in ((left, "x", by_doc), (whole, "q", by_item)):
            sides.append(banded(
                frame.where(F.col("size_class").isin(list(uses))).withColumn(
                    "signature", signature(F.col(elements))), _uses(uses, "size_class")))
        found = sides[0].withColumnRenamed("id", "doc_id").join(
            sides[1].withColumnRenamed("id", "item_id"), ["doc_class", "code"])
        pairs = found.select("doc_id", "item_id").distinct()
    if exact:
        any_ = exact[0]
        for one in exact[1:]:
            any_ = any_ | one
        shared = left.select(
            F.col("id").alias("doc_id"), F.col("size_class").alias("doc_class"),
            F.explode("x").alias("s")).join(
            parts.join(whole.select(F.col("id").alias("item_id"),
                                    F.col("size_class").alias("item_class")), "item_id"), "s")
        pairs = pairs.union(
            shared.where(any_).select("doc_id", "item_id").distinct())
    checked = pairs.join(whole.select(F.col("id").alias("item_id"), "q"), "item_id").join(
        left.select(F.col("id").alias("doc_id"), "x"), "doc_id")
    n_shared = F.size(F.array_intersect("x", "q")).cast("bigint")
    return checked.select(
        "doc_id", "item_id", n_shared.alias("n_shared"),
        F.size("q").cast("bigint").alias("n_item")
    ).where(F.col("n_shared") * 100 >= F.col("n_item") * percent).withColumn(
        "containment", F.col("n_shared") / F.col("n_item"))


def without_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item. Rows without an id stay."""
    gone = contained(docs, items, n, percent, id_col, text_col).select(
        F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
