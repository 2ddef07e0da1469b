"""Near-duplicate documents: SuperMinHash signatures, banding, exact checks, components.

1. A document is the set of 64-bit hashes of its distinct shingles of ``n`` words. Equal sets are
   one class from here on, so thousands of exact copies cost one row each.
2. SuperMinHash: every element draws a random permutation of the ``SIZE`` slots step by step and
   offers rank ``step + random`` to the slot it draws; a slot keeps its least offer. The ranks of an
   element are correlated, which lowers the variance, and a document stops as soon as no later step
   can lower any slot.
3. ``BANDS`` groups of slots are hashed to buckets. With 32 bands of 5, a pair at similarity 0.8
   shares no bucket with probability 0.000003.
4. Links of a bucket are searched without its pairs. In the first round every class is checked with
   one other, the most typical member of one of its buckets by the signatures. In later rounds every
   class offers, in each of its buckets, the most similar member of another component, and the
   ``OFFERS`` best of all its buckets are checked. A large bucket is cut into chunks, anew in every
   round, and a class looks into its own chunk only; the largest component there waits for the
   others' offers. So offers grow with classes, not with pairs. Rounds go on until they add no link.
5. Then nothing is left to chance offers: every pair of different components that shares a bucket
   and looks alike by its signatures is compared on the full sets, inside blocks. The sets go to the
   classes of a block that have such a partner there, pairs never become rows, and a block gives at
   most one link less than it has components.
6. Every link is confirmed on the full sets. Components of the links are the groups.

Documents with equal ids are one vertex. A document without words (NULL, empty or blank text)
links with nothing, nor does one without an id. Fewer words than ``n`` make one shingle of all.
Ties break by id; the result does not depend on the partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.llm.common import (
    GOLDEN, WordHashes, id_text, in_blocks, mix, over_blocks, shingle_hashes,
    small_batches, with_results)
from gazette.llm.components import components
from gazette.shipping import ship_package
from gazette.sources.scratch import written

BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
# Signatures that agree in fewer slots than this share of the similarity are not checked: five
# standard deviations of 160 slots below the threshold, at 0.8; a pair at 0.8 exactly is missed with
# probability 0.0000014 by plain binomial variance.
SLACK = 0.8
BLOCK = 1024
CENTRAL_BANDS = 8
OFFERS = 4
# Elements of a set that are ranked at a time.
ELEMENTS = 1 << 12
# Entries of the lists of a block's shingles that are counted at a time.
POSTINGS = 1 << 20


def shingle_set(hashes: WordHashes, text: str, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(hashes.words(text)), n))


def superminhash(x: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The signature of a non-empty set of distinct 64-bit hashes.

    Elements are worked off some thousand at a time, each with its own permutation of the slots,
    so memory does not grow with the set. No rank of a step is below its number: a chunk is done
    once every slot is.
    """
    least = np.full(size, np.inf)
    for start in range(0, len(x), ELEMENTS):
        _lower(least, x[start:start + ELEMENTS], size)
    return least


def _lower(least: np.ndarray, x: np.ndarray, size: int) -> None:
    slots = np.tile(np.arange(size, dtype=np.int16), (len(x), 1))
    every = np.arange(len(x))
    with np.errstate(over="ignore"):
        for step in range(size):
            if least.max() <= step:
                break
            z = mix(x + np.uint64(step + 1) * GOLDEN)
            rank = step + (z >> np.uint64(32)).astype(np.float64) / 2.0 ** 32
            drawn = step + (((z & np.uint64(0xFFFFFFFF)) * np.uint64(size - step))
                            >> np.uint64(32)).astype(np.int64)
            slot = slots[every, drawn]
            slots[every, drawn] = slots[:, step]
            np.minimum.at(least, slot, rank)


def band_codes(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = signature.view(np.uint64).reshape(BANDS, ROWS)
        code = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            code = mix(code * GOLDEN + bits[:, k])
    return code.view(np.int64)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, bands, slots`` per row; no words: NULL hashes."""
    hashes = WordHashes()

    def work(texts: list[str]) -> dict[str, list]:
        from xxhash import xxh3_128_digest

        out = {"n_shingles": [], "h1": [], "h2": [], "bands": [], "slots": []}
        for text in texts:
            x = shingle_set(hashes, text, n)
            out["n_shingles"].append(len(x))
            if not len(x):
                for name in ("h1", "h2", "bands", "slots"):
                    out[name].append(None)
                continue
            digest = xxh3_128_digest(x.tobytes())
            signature = superminhash(x)
            out["h1"].append(int.from_bytes(digest[:8], "little", signed=True))
            out["h2"].append(int.from_bytes(digest[8:], "little", signed=True))
            out["bands"].append(band_codes(signature))
            out["slots"].append(
                (mix(signature.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).tobytes())
        return out

    return with_results(docs, work, "n_shingles bigint, h1 bigint, h2 bigint, "
                        "bands array<bigint>, slots binary", keep=["doc_id"])


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of documents whose full shingle sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    hashes = WordHashes()

    def work(texts: list[str]) -> dict[str, list]:
        return {"x": [shingle_set(hashes, t, n).view(np.int64) for t in texts]}

    sets = written(with_results(
        docs.join(ids, "doc_id", "left_semi"), work, "x array<bigint>", keep=["doc_id"]), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("x").alias("y")), "b").join(
        sets.select(F.col("doc_id").alias("a"), "x"), "a")

    def run(batches):
        from gazette.llm.common import slices

        for part in slices(batches, 64):
            x, y = part.column("x"), part.column("y")
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = p.values.to_numpy(), q.values.to_numpy()
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    ship_package(both.sparkSession)
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _central_pairs(members: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Each class with the most typical member of one of its buckets, the one most like it.

    Of a large bucket every chunk has its own. Looks into the first ``CENTRAL_BANDS`` bands.
    """
    some = members.where(F.col("band") < CENTRAL_BANDS).select("bucket", "rep")
    own = in_blocks(some, ["bucket"], "rep", block).where("lo = hi").join(slots, "rep")
    found = over_blocks(own, ["bucket", "lo"], _central, "rep bigint, hub bigint, same bigint")
    best = found.groupBy("rep").agg(F.max(F.struct("same", "hub")).alias("best"))
    return best.select(F.least("rep", "best.hub").alias("a"),
                       F.greatest("rep", "best.hub").alias("b")).distinct()


def _central(group: pa.Table) -> dict[str, np.ndarray] | None:
    rep = group.column("rep").to_numpy()
    slots = np.frombuffer(b"".join(group.column("slots").to_pylist()), np.uint8)
    slots = slots.reshape(len(rep), -1)
    if len(rep) < 2:
        return None
    # How many members agree with each member, summed over the slots.
    typical = np.zeros(len(rep))
    for column in slots.T:
        typical += np.bincount(column, minlength=256)[column]
    at = np.lexsort((rep, -typical))[0]
    others = np.arange(len(rep)) != at
    return {"rep": rep[others], "hub": np.full(others.sum(), rep[at]),
            "same": (slots[others] == slots[at]).sum(1)}


def _nearest_pairs(members: DataFrame, slots: DataFrame, least: float, block: int, turn: int
                   ) -> DataFrame:
    """The best offers of each class: partners in other components that share a bucket.

    Pairs that meet in no chunk of this round are left to later ones, and to ``_rest``.
    """
    mixed = members.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    open_ = members.join(mixed, "bucket", "left_semi").select("bucket", "rep", "component")
    dealt = in_blocks(open_, ["bucket"], "rep", block, salt=17 + turn, own=True).join(slots, "rep")
    offers = over_blocks(dealt, ["bucket", "lo"], _nearest(least),
                         "rep bigint, hub bigint, same bigint")
    once = offers.groupBy("rep", "hub").agg(F.max("same").alias("same"))
    place = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("same"), "hub"))
    return once.withColumn("place", place).where(F.col("place") <= OFFERS).select(
        F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _nearest(least: float):
    """For each row of a block the row of another component whose signature agrees most.

    Not for the block's largest component: of any pair across components one side is another's.
    """

    def work(group: pa.Table) -> dict[str, np.ndarray] | None:
        rep = group.column("rep").to_numpy()
        component = group.column("component").to_numpy()
        if len(rep) < 2:
            return None
        slots = np.frombuffer(b"".join(group.column("slots").to_pylist()), np.uint8)
        slots = slots.reshape(len(rep), -1)
        best, partner = np.full(len(rep), -1), np.zeros(len(rep), np.int64)
        found, many = np.unique(component, return_counts=True)
        for i in np.flatnonzero(component != found[many.argmax()]):
            same = (slots == slots[i]).sum(1)
            same[component == component[i]] = -1
            partner[i] = same.argmax()
            best[i] = same[partner[i]]
        good = best >= least * slots.shape[1]
        return {"rep": rep[good], "hub": rep[partner[good]], "same": best[good]}

    return work


def _alike(least: float):
    """The rows of a block that have a partner in another component with a similar signature.

    Of two chunks only pairs between them count, the others meet in a block of one chunk. Given all
    bands of the rows, a pair counts in the first bucket it shares only.
    """

    def work(group: pa.Table) -> dict[str, np.ndarray] | None:
        rep = group.column("rep").to_numpy()
        component, chunk = group.column("component").to_numpy(), group.column("chunk").to_numpy()
        lo, hi, band = (group.column(c)[0].as_py() for c in ("lo", "hi", "band"))
        slots = np.frombuffer(b"".join(group.column("slots").to_pylist()), np.uint8)
        slots = slots.reshape(len(rep), -1)
        bands = None
        if "bands" in group.column_names:
            bands = np.array(group.column("bands").to_pylist(), np.int64)
        good = np.zeros(len(rep), bool)
        for i in np.flatnonzero(chunk == lo):
            other = (component != component[i]) & (chunk == hi)
            other[other] = (slots[other] == slots[i]).sum(1) >= least * slots.shape[1]
            if bands is not None and other.any():
                equal = bands[other] == bands[i]
                other[other] = equal[:, band] & ~equal[:, :band].any(1)
            if other.any():
                good[i] = True
                good |= other
        if not good.any():
            return None
        rep, at = np.unique(rep[good], return_index=True)
        fill = np.ones(len(rep), np.int64)
        return {"bucket": fill * group.column("bucket")[0].as_py(), "band": fill * band,
                "lo": fill * lo, "hi": fill * hi, "chunk": chunk[good][at].astype(np.int64),
                "rep": rep, "component": component[good][at]}

    return work


def _linked(percent: int):
    """Links between the components of a block, by full sets; each joins two of its components."""

    def work(group: pa.Table) -> dict[str, np.ndarray] | None:
        rep = group.column("rep").to_numpy()
        component = group.column("component").to_numpy().copy()
        chunk = group.column("chunk").to_numpy()
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        sets = group.column("x").combine_chunks()
        size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(rep), dtype=np.int32), size)
        first = np.cumsum(size) - size
        # Shingles as small numbers, and the rows that hold each of them, in a row.
        values = sets.flatten().to_numpy()
        order = np.argsort(values)
        holders = row[order]
        values = values[order]
        code = np.empty(len(values), np.int32)
        code[order] = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]), dtype=np.int32)
        del values, order, row
        many = np.bincount(code)
        begin = np.cumsum(many) - many
        a, b = [], []
        for i in np.flatnonzero(chunk == lo):
            other = (component != component[i]) & (chunk == hi)
            if not other.any():
                continue
            same = np.zeros(len(rep), np.int64)
            mine = code[first[i]:first[i] + size[i]]
            mine = mine[many[mine] > 1]
            step = max(1, POSTINGS // len(rep))
            for at in range(0, len(mine), step):
                some = mine[at:at + step]
                m = many[some]
                place = np.repeat(begin[some] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                same += np.bincount(holders[place], minlength=len(rep))
            near = other & (100 * same >= percent * (size + size[i] - same))
            for j in np.flatnonzero(near):
                if component[j] != component[i]:
                    a.append(min(rep[i], rep[j]))
                    b.append(max(rep[i], rep[j]))
                    component[component == component[j]] = component[i]
        return {"a": np.array(a, np.int64), "b": np.array(b, np.int64)} if a else None

    return work


def _rest(members: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int,
          block: int) -> DataFrame:
    """Links ``a, b`` among all alike pairs of different components that share a bucket."""
    mixed = members.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    keys, least = ["bucket", "lo", "hi"], SLACK * percent / 100
    listed = ("bucket bigint, band bigint, lo bigint, hi bigint, chunk bigint, rep bigint, "
              "component bigint")
    dealt = in_blocks(members.join(mixed, "bucket", "left_semi"), ["bucket"], "rep", block)
    some = written(over_blocks(dealt.join(classes.select("rep", "slots"), "rep"), keys,
                               _alike(least), listed), "alike")
    some = written(over_blocks(some.join(classes.select("rep", "slots", "bands"), "rep"), keys,
                               _alike(least), listed), "alike-once")
    hashes = WordHashes()

    def work(texts: list[str]) -> dict[str, list]:
        return {"x": [shingle_set(hashes, t, n).view(np.int64) for t in texts]}

    sets = with_results(texts.join(some.select(F.col("rep").alias("doc_id")).distinct(), "doc_id",
                                   "left_semi"), work, "x array<bigint>", keep=["doc_id"])
    return over_blocks(some.join(sets.withColumnRenamed("doc_id", "rep"), "rep"), keys,
                       _linked(percent), "a bigint, b bigint")


def groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
           text_col: str = "text", block: int = BLOCK
           ) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Links documents whose Jaccard similarity of shingle sets is ``percent`` / 100 or more.
    """
    texts = id_text(docs, id_col, text_col)
    with small_batches(docs.sparkSession):
        rows = written(signed(texts, n), "signatures")
    key = ["h1", "h2"]
    sound = rows.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(sound.groupBy(*key).agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
        F.first("slots").alias("slots")), "classes")
    # Classes whose smallest ids coincide (one id with two texts) are one vertex.
    links = written(_buckets(classes), "buckets")
    members = links.withColumn("component", F.col("rep"))
    slots = classes.groupBy("rep").agg(F.first("slots").alias("slots"))
    found: DataFrame | None = None
    tried: DataFrame | None = None
    turn = 0
    while True:
        if tried is None:
            pairs = _central_pairs(members, slots, block)
        else:
            pairs = _nearest_pairs(members, slots, SLACK * percent / 100, block, turn).join(
                tried, ["a", "b"], "left_anti")
            turn += 1
        pairs = written(pairs, "pairs")
        with small_batches(docs.sparkSession):
            new = written(confirmed(pairs, texts, n, percent), "links")
        if tried is not None and new.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        found = new if found is None else found.union(new)
        group = components(found).withColumnRenamed("node", "rep")
        members = written(links.join(group, "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")), "members")
    with small_batches(docs.sparkSession):
        new = written(_rest(members, classes, texts, n, percent, block), "links")
    if not new.isEmpty():
        found = new if found is None else found.union(new)
        group = components(found).withColumnRenamed("node", "rep")
    by_class = classes.select(*key, "rep").join(group, "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component_id"))
    out = rows.select(F.col("doc_id"), "n_shingles", *[
        F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in key]).join(
        by_class, key, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _buckets(classes: DataFrame) -> DataFrame:
    """``band, bucket, rep`` of the buckets that hold at least two classes."""
    every = classes.select("rep", F.posexplode("bands").alias("band", "bucket")).distinct()
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return every.join(shared.select("bucket"), "bucket", "left_semi")


def without_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and all rows without an id."""
    gone = groups(docs, n, percent, id_col, text_col).where("NOT kept").select(
        F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
