from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from gazette.llm import merkle
from odd import SCHEMA, no_documents, odd_documents


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc):
    def part(value):
        if value is None:
            return "-"
        text = str(value)
        return f"{len(text.encode())}:{text}"

    return h("".join(part(doc[f]) for f in merkle.FIELDS))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i:i + 8])) for i in range(0, len(below), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out.append((level[start:at], level[at + 1:start + 8]))
        at //= 8
    return out


def brute(docs):
    """The rows of the contract, one after another."""
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        own = [d for d in docs if d["lang"] == lang]
        own.sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf_of(d)))
        groups.append((own, levels_of([leaf_of(d) for d in own])))
    top = levels_of([levels[-1][0] for _, levels in groups])
    rows = []
    for g, (own, levels) in enumerate(groups):
        for i, doc in enumerate(own):
            steps = path(levels, i) + path(top, g)
            now = dict(doc)
            if doc["doc_id"] is not None and zlib.crc32(str(doc["doc_id"]).encode()) % 3 == 0 \
                    and doc["text"] is not None:
                now["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in doc["text"])
            node = leaf_of(now)
            for before, after in steps:
                node = h("".join(before) + node + "".join(after))
            rows.append((doc["doc_id"], leaf_of(doc), levels[-1][0], top[-1][0],
                         h("".join("".join(b + a) for b, a in steps)), node, node == top[-1][0]))
    return sorted(rows, key=repr)


def check(frame):
    docs = [r.asDict() for r in frame.collect()]
    got = [tuple(r) for r in merkle.tampering_check(frame).collect()]
    assert sorted(got, key=repr) == brute(docs)
    return got


@pytest.mark.parametrize("n", [1, 8, 9, 64, 513])
def test_sizes_around_powers(spark, n):
    frame = spark.createDataFrame([(i * 3 - 5, f"Text {i} É", "en", "s", i) for i in range(n)],
                                  "doc_id bigint, text string, lang string, source string, "
                                  "n_chars bigint")
    check(frame)


def test_many_groups_ties_and_large_trees(spark):
    random.seed(3)
    langs = [None, "de", "én", "zz", "Z"] + [f"l{i}" for i in range(12)]
    rows = [(random.randrange(4000), random.choice(["Aa", "b", None, ""]),
             "en" if i % 2 else random.choice(langs), random.choice([None, "s", "Ü"]),
             random.choice([None, i])) for i in range(5000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, "
                                        "n_chars bigint")
    got = check(frame)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows_and_none(spark):
    check(odd_documents(spark))
    assert merkle.tampering_check(no_documents(spark)).collect() == []
    nulls = spark.createDataFrame([(None,) * 11] * 3, SCHEMA)
    check(nulls)


def test_a_proof_convicts_a_changed_row(spark):
    frame = odd_documents(spark).select(
        "doc_id", "lang", merkle.leaf_digest([merkle.F.col("doc_id"), merkle.F.col("text")])
        .alias("leaf"))
    rows = merkle.manifest(frame)
    good = merkle.folded(merkle.F.col("leaf"), merkle.F.col("proof"))
    bad = merkle.folded(merkle.digest(merkle.F.lit("x")), merkle.F.col("proof"))
    out = rows.select((good == merkle.F.col("root")).alias("a"),
                      (bad == merkle.F.col("root")).alias("b")).collect()
    assert all(r.a and not r.b for r in out)
