"""A Merkle manifest of a dataset: a hash per row, a root per group, a root over the groups.

A leaf is the hash of a row's fields. Within a group, leaves stand in the order of their ids;
while several nodes remain, every ``ARITY`` consecutive ones (the last run may be shorter, even
one) become the hash of their digests written side by side. What remains is the group's subroot;
the subroots, in the order of the group names (NULL first), are folded likewise into the root.

Method: ``BLOCK`` consecutive nodes, aligned to a power of the arity, are one row that keeps each
level as one string of concatenated hex digests. A parent is the hash of a fixed-width substring
of the level below, so three levels need one shuffle of digests. The roots of the blocks are the
nodes of the next round. A proof is what flanks a node in its run, cut out of the same strings,
followed by the proof of the block.

Scale: rows are numbered by range partitioning with offsets per partition, so a group of any size
is spread evenly; ties in the id are spread by their digests. A block holds 512 nodes whatever the
size of its group. Texts are read once and never shuffled. Every round is a written table.

Any column may be NULL: it hashes as ``-``. Rows without an id come first in their group, rows
that share an id stand in the order of their digests, equal rows are leaves of their own. An empty
table has an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.operators.ordering import join_groups
from gazette.sources.scratch import written

# Eight nodes make a parent; a digest is 64 hex digits.
ARITY, DIGEST = 8, 64
STEPS = 3
BLOCK = ARITY ** STEPS
RUN = ARITY * DIGEST
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hash of the values in turn: ``-`` for NULL, else byte count, colon, value."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                          F.lit("-"))

    return digest(F.concat(*[part(v) for v in values]))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the segments beside its path give."""
    return F.aggregate(proof, leaf, lambda node, at: digest(
        F.concat(at["before"], node, at["after"])))


def proof_text(proof: Column) -> Column:
    """All sibling digests, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda at: F.concat(at["before"], at["after"])), "")


def _numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, counted from 0 in the order of ``by, order`` within ``by``, and ``n``, the
    rows of the group."""
    ranged = written(rows.repartitionByRange(*by, *order).withColumn(
        "part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("size"))
    # One row per partition and group.
    group = W.partitionBy(*(by or [F.lit(0)]))
    ahead = group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "part",
                           F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"),
                           F.sum("size").over(group).alias("n"))
    inside = W.partitionBy(*by, "part").orderBy(*order)
    placed = ranged.withColumn("place", F.row_number().over(inside))
    return join_groups(placed, starts, [*by, "part"]).withColumn(
        "pos", F.col("start") + F.col("place") - 1).drop("part", "start", "place")


def _blocks(nodes: DataFrame, by: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``by, block, n, members, levels`` from ``by, pos, n, hash`` and what members carry.

    ``levels`` holds one string per level, the nodes of the block itself first; its last one is
    the block's root.
    """
    member = F.struct("pos", "hash", *carry)
    rows = nodes.groupBy(*by, F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("level0", F.array_join(F.col("members.hash"), ""))
    for step in range(STEPS):
        # A level is folded while the whole group still has several nodes in it.
        rows = rows.withColumn(f"level{step + 1}", F.when(
            F.ceil(F.col("n") / F.lit(ARITY ** step)) > 1, _parents(f"level{step}")))
    names = [f"level{i}" for i in range(STEPS + 1)]
    return rows.withColumn("levels", F.array_compact(F.array(*names))).drop(*names)


def _parents(level: str) -> Column:
    """The digests of a level's runs, side by side."""
    runs = F.sequence(F.lit(0), F.expr(f"(length({level}) - 1) div {RUN}"))
    return F.array_join(F.transform(runs, lambda i: digest(F.substring(
        F.col(level), i * RUN + 1, F.lit(RUN)))), "")


def _segments(levels: Column, pos: Column) -> Column:
    """What flanks the node at ``pos`` and its parents inside a block, level by level."""
    local = pos % BLOCK

    def at(level: Column, step: Column) -> Column:
        place = F.floor(local / F.pow(F.lit(float(ARITY)), step)).cast("int")
        start, within = F.floor(place / ARITY).cast("int") * RUN, (place % ARITY) * DIGEST
        return F.struct(
            F.substring(level, start + 1, within).alias("before"),
            F.substring(level, start + within + DIGEST + 1, F.lit(RUN - DIGEST) - within)
            .alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def _proven(kept: Sequence[str]) -> Column:
    """The members of a block with their proofs."""
    return F.transform("members", lambda m: F.struct(
        m["pos"].alias("pos"), m["hash"].alias("hash"), *[m[c].alias(c) for c in kept],
        F.concat(_segments(F.col("levels"), m["pos"]), F.col("upper")).alias("proof")))


def _tree(nodes: DataFrame, by: Sequence[str], carry: Sequence[str]
          ) -> tuple[DataFrame, DataFrame]:
    """(a row per node with ``hash, proof`` and what it carries; ``by, subroot``)."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds, kept = [], list(carry)
    while True:
        blocks = written(_blocks(nodes, by, kept), "blocks")
        rounds.append((blocks, kept))
        if largest <= BLOCK:
            break
        largest, kept = -(-largest // BLOCK), []
        nodes = blocks.select(*by, F.col("block").alias("pos"),
                              F.ceil(F.col("n") / F.lit(BLOCK)).cast("bigint").alias("n"),
                              F.element_at("levels", -1).alias("hash"))
    roots = rounds[-1][0].select(*by, F.element_at("levels", -1).alias("subroot"))
    paths = None
    for blocks, kept in reversed(rounds):
        if paths is None:
            blocks = blocks.withColumn("upper", F.array().cast(
                "array<struct<before:string,after:string>>"))
        else:
            upper = paths.select(*by, F.col("pos").alias("block"), F.col("proof").alias("upper"))
            blocks = join_groups(blocks, upper, [*by, "block"])
        paths = blocks.select(*by, F.explode(_proven(kept)).alias("m")).select(*by, "m.*")
    return paths, roots


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             leaf_col: str = "leaf", carry: Sequence[str] = ()) -> DataFrame:
    """``id_col, group_col, leaf_col, carry..., proof, subroot, root`` for every row.

    ``proof`` is an array of ``before, after``: the digests that flank the path from the leaf to
    the root, level by level. ``leaves`` should be a narrow table: it is read twice.
    """
    rows = leaves.select(F.col(group_col).alias("grp"), F.col(id_col).cast("bigint").alias("id"),
                         F.col(leaf_col).alias("hash"),
                         *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    kept = ["id", *[f"carry_{i}" for i in range(len(carry))]]
    own, subroots = _tree(_numbered(rows, ["grp"], ["id", "hash"]), ["grp"], kept)
    subroots = written(subroots.withColumnRenamed("subroot", "hash"), "subroots")
    tops, root = _tree(_numbered(subroots, [], ["grp"]), [], ["grp"])
    tops = written(tops.select("grp", F.col("hash").alias("subroot"), F.col("proof").alias("rest"),
                               root.select("subroot").scalar().alias("root")), "subroots")
    return join_groups(own, tops, ["grp"]).select(
        F.col("id").alias(id_col), F.col("grp").alias(group_col), F.col("hash").alias(leaf_col),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
        F.concat("proof", "rest").alias("proof"), "subroot", "root")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tampering_check(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
                    text_col: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Proofs of every row, checked against rows of which some were altered after hashing.

    Where 3 divides the CRC-32 of the id, the text's A-Z are lower-cased (a NULL stays). The root
    is then recomputed from the row as it is now and the siblings of the manifest. ``verified``
    is false exactly where the alteration changed the row.
    """
    values = [F.col(f) for f in fields]
    altered = [lower_ascii(v) if f == text_col else v for f, v in zip(fields, values, strict=True)]
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    leaves = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(group_col).alias("lang"),
        leaf_digest(values).alias("leaf"), F.when(hit, leaf_digest(altered)).alias("now")),
        "leaves")
    rows = manifest(leaves, carry=["now"])
    again = folded(F.coalesce("now", "leaf"), F.col("proof"))
    return rows.select(
        F.col("doc_id").alias(id_col), "leaf", "subroot", "root",
        digest(proof_text(F.col("proof"))).alias("proof_sha256"),
        again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
