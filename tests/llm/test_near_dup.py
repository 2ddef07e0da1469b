from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest

from gazette.llm import decontamination, embeddings, near_dup
from gazette.llm.common import in_blocks, mix
from gazette.llm.components import components
from odd import no_documents, odd_documents


def shingle_sets(rows, n):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        runs = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        if i is not None:
            out[i] = runs
    return out


def plain_groups(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def copies():
    """A chain of drifting copies, groups of near and exact copies, and singles."""
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(10_000)
    rows, i = [], 100
    for size, changes in ((40, 3), (12, 9), (25, 0), (1, 0), (1, 0), (6, 1)):
        text = [word() for _ in range(120)]
        for k in range(size):
            if changes == 9:  # each drifts on from the one before
                text = list(text)
            own = list(text)
            for _ in range(changes if changes < 9 else 4):
                own[rng.randrange(len(own))] = word()
            if changes == 9:
                text = own
            rows.append((i, " ".join(own).upper() if k % 7 == 3 else " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize(("n", "block"), [(2, 8), (5, 1024)])
def test_groups_equal_brute_force(spark, n, block):
    rows = copies()
    docs = odd_documents(spark, rows)
    got = {r.doc_id: r for r in near_dup.groups(
        docs, n, block=block).where("doc_id IS NOT NULL").collect()}
    every = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = shingle_sets(every, n)
    want = plain_groups(sets, 80)
    for i, r in got.items():
        assert (r.component_id, r.n_shingles, r.kept) == (want[i], len(sets[i]), want[i] == i)
    assert set(got) == set(want)


def test_true_pairs_are_found_among_many_slightly_less_similar(spark):
    """Hundreds of classes at 0.75 to 0.79 around pairs at 0.80 to 0.85."""
    rng = random.Random(11)
    base = ["b%d" % k for k in range(5 * 17 * 17 + 4)]

    def text(i, spots, tail, like=None, kept=0):
        """The base with an own word at each spot, or the word of another text."""
        out = list(base)
        for k, spot in enumerate(spots):
            out[5 * (17 * k + spot) + 2] = f"own{like if k < kept else i}x{k}"
        return i, " ".join(out + [f"tail{i}x{k}" for k in range(tail)])

    # Any two of these share at most one spot.
    spots = {100 + 17 * x + y: [(x + y * k) % 17 for k in range(17)]
             for x in range(17) for y in range(17)}
    rows = [text(i, s, 5) for i, s in spots.items()]
    for i in range(100, 380, 14):
        rows.append(text(1000 + i, spots[i][:4] + [rng.randrange(17) for _ in range(13)], 55, i, 4))
    number: dict = {}
    sets = {i: {number.setdefault(x, len(number)) for x in s}
            for i, s in shingle_sets(rows, 5).items()}
    same = [(len(sets[a] & sets[b]), len(sets[a]) + len(sets[b])) for a, b in combinations(sets, 2)]
    assert sum(0.75 <= x / (y - x) < 0.8 for x, y in same) > 40_000
    assert sum(0.8 <= x / (y - x) < 0.85 for x, y in same) >= 20
    want = plain_groups(sets, 80)
    got = {r.doc_id: r.component_id for r in near_dup.groups(
        odd_documents(spark, rows), block=64).where("doc_id >= 100").collect()}
    assert len(set(want.values())) > 200
    assert got == want


def test_rows_with_sets_pass_to_python_in_small_batches(spark, monkeypatch):
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, near_dup.written

    def noted(df, label):
        seen.setdefault(label, set()).add(int(spark.conf.get(name)))
        return write(df, label)

    monkeypatch.setattr(near_dup, "written", noted)
    usual = spark.conf.get(name)
    near_dup.groups(odd_documents(spark, copies()))
    assert all(max(seen[label]) <= 1024 for label in ("signatures", "sets", "links"))
    assert spark.conf.get(name) == usual


def test_copies_leave_and_rows_without_id_stay(spark):
    kept = near_dup.without_copies(odd_documents(spark, copies()))
    ids = [r.doc_id for r in kept.collect()]
    assert 6 not in ids and ids.count(5) == 2 and ids.count(None) == 2
    assert near_dup.groups(no_documents(spark)).count() == 0


def test_superminhash_estimates_with_less_variance():
    rng = np.random.default_rng(3)
    gap = []
    for _ in range(200):
        x = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
        y = np.concatenate([x[6:], mix(x[:6])])
        gap.append((near_dup.superminhash(x) == near_dup.superminhash(y)).mean() - 54 / 66)
    assert abs(np.mean(gap)) < 0.01
    assert np.std(gap) < np.sqrt(54 / 66 * 12 / 66 / near_dup.SIZE)


def test_few_pairs_at_the_threshold_are_refused_by_their_signatures():
    least = int(np.ceil(near_dup.SLACK * 0.8 * near_dup.SIZE))
    missed = sum(math.comb(near_dup.SIZE, k) * 0.8 ** k * 0.2 ** (near_dup.SIZE - k)
                 for k in range(least))
    assert missed < 5e-6


def test_blocks_let_every_pair_meet(spark):
    rows = spark.range(50).selectExpr("id", "id % 2 AS b")
    met = set()
    for r in in_blocks(rows, ["b"], "id", 6).groupBy("b", "lo", "hi").agg(
            {"id": "collect_list"}).collect():
        assert len(r[3]) <= 30
        met |= {tuple(sorted(p)) for p in combinations(r[3], 2)}
    assert met == {(a, b) for a, b in combinations(range(50), 2) if a % 2 == b % 2}


def test_a_class_makes_one_offer_a_bucket_however_large(spark):
    """Classes 0 to 299 of one bucket: 0 to 199 are one component, the others are alone."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, near_dup.SIZE).astype(np.uint8)
    members, slots = [], []
    for i in range(300):
        own = base.copy()
        own[rng.permutation(near_dup.SIZE)[:8]] ^= 1
        members.append((7, 0, i, 0 if i < 200 else i))
        slots.append((i, bytearray(own.tobytes())))
    members = spark.createDataFrame(members, "bucket bigint, band int, rep bigint, component bigint")
    slots = spark.createDataFrame(slots, "rep bigint, slots binary")
    seen = []
    for turn in (0, 1):
        pairs = near_dup._nearest_pairs(members, slots, 0.5, 16, turn).collect()
        asked = {(r.a, r.b) for r in pairs}
        # Of 19 chunks every row looked into one; the large component only answers.
        assert len(asked) <= 100 and all(b >= 200 for _, b in asked)
        assert {b for _, b in asked} | {a for a, _ in asked} >= set(range(200, 300))
        seen.append(asked)
    assert seen[0] != seen[1]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(50)] + [
        (7, 7), (None, 3), (200, 201), (201, 200)] + [
        (300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(60)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {}
    for a, b in links:
        if a is not None and a != b:
            parent.setdefault(a, a)
            parent.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in parent and b in parent and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert got == parent


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = [[int(i), (centres[i % 6] + rng.normal(size=24) * 0.12).tolist()] for i in range(150)]
    rows += [[150 + k, rows[0][1]] for k in range(5)] + [[160 + k, rng.normal(size=24).tolist()]
                                                         for k in range(40)]
    odd = [[300, None], [301, [0.0] * 24], [302, [float("nan")] * 24], [303, []],
           [304, [1.0, None, 2.0]], [305, [float("inf")] * 24], [306, [1e200] * 3],
           [307, [2e200] * 3], [None, rows[0][1]], [308, [1.0] * 24]]
    frame = spark.createDataFrame(
        [(i, v, "x", 1) for i, v in rows + odd],
        "vec_id bigint, embedding array<double>, rep string, weight int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, block=16).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i, _ in rows)
    assert 0.98 * near.sum() <= found <= near.sum()
    for k, (i, _) in enumerate(rows):
        assert got[i].n_links <= near[k].sum()
    assert all(got[150 + k].n_links == got[0].n_links for k in range(5))
    for i in (300, 301, 302, 303, 304, 305, 308, None):
        assert got[i].n_links == 0 and got[i].kept
    assert got[306].n_links == 1 and got[307].component_id == 306 and not got[307].kept
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_items_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(400)
    items = [(k, " ".join(word() for _ in range(rng.choice((3, 9, 14, 40, 90))))) for k in range(60)]
    items += [(60, items[0][1]), (61, None), (62, ""), (None, "x y z")]
    rows = []
    for i in range(100, 160):
        text = [word() for _ in range(rng.choice((30, 300, 3000)))]
        for k in rng.sample(range(60), rng.choice((0, 1, 2, 30))):
            cut = items[k][1].split()
            if len(cut) > 12 and rng.random() < 0.5:
                cut[rng.randrange(len(cut))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = cut
        rows.append((i, " ".join(text)))
    rows.append((160, items[0][1].upper()))
    docs = odd_documents(spark, rows)
    bench = spark.createDataFrame([(k, t, "x", "y") for k, t in items],
                                  "item_id bigint, text string, doc_id string, x string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item)
           for r in decontamination.contained(docs, bench).collect()}
    d, q = shingle_sets(rows, 5), shingle_sets(items, 5)
    want = {(i, k): (len(d[i] & q[k]), len(q[k])) for i in d for k in q
            if q[k] and 100 * len(d[i] & q[k]) >= 80 * len(q[k])}
    assert got == want and len(want) > 100
    left = decontamination.without_items(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - len({i for i, _ in want})
    assert decontamination.contained(no_documents(spark), bench).count() == 0
    assert decontamination.contained(docs, bench.limit(0)).count() == 0


def test_signatures_of_large_sets_do_not_depend_on_the_chunks(monkeypatch):
    import tracemalloc

    x = np.unique(np.random.default_rng(5).integers(0, 2**63, 300_000, dtype=np.uint64))
    small = x[:9000]
    whole = near_dup.superminhash(small)
    for size in (1, 7, 4096, 9000):
        monkeypatch.setattr(near_dup, "ELEMENTS", size)
        assert (near_dup.superminhash(small[:500]) == near_dup.superminhash(
            small[:500][::-1])).all()
    monkeypatch.setattr(near_dup, "ELEMENTS", 9000)
    assert (near_dup.superminhash(small) == whole).all()
    monkeypatch.setattr(near_dup, "ELEMENTS", 4096)
    tracemalloc.start()
    near_dup.superminhash(x)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
