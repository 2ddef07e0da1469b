from __future__ import annotations

import random
import re
from collections import Counter

from gazette.llm import phrases as P
from odd import no_documents, odd_documents

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    """The contract, word by word; docs are (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang, tuple(words[i:i + k])] += 1
    wanted = {key: c for key, c in f.items() if len(key[1]) > 1 and c >= least}
    held = {}
    for (lang, words), c in wanted.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    held[lang, words[i:j]] = max(c, held.get((lang, words[i:j]), 0))
    rows = {}
    for (lang, words), a in wanted.items():
        if held.get((lang, words), 0) >= a:
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k)
                         for k in range(1, len(words)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[
            lang, words[:cut]], f[lang, words[cut:]]))
    out = []
    for lang, own in rows.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def check(frame, least, top=2000):
    got = sorted(tuple(r) for r in P.collocations(frame, least, top).collect())
    want = brute([(r.lang, r.text) for r in frame.select("lang", "text").collect()], least, top)
    assert got == want
    return got


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_equals_brute_force_on_random_words(spark):
    random.seed(2)
    vocabulary = ["a", "b", "c", "dé", "É", "Zz", "x.y", "\x1c", "it's", " ", "ſ"]
    passage = "the quick brown fox jumps over the lazy dog while nobody is looking at it"
    rows = []
    for i in range(300):
        words = random.choices(vocabulary, weights=range(1, 12), k=random.randrange(40))
        text = "".join(w + random.choice([" ", " ", "  ", "\t", ", ", "\n", "! "]) for w in words)
        if i % 5 == 0:
            text += passage
        if i % 7 == 0:
            text += ". " + passage[10:44] + "\r\x0b"
        rows.append((random.choice(["en", "fr", None, "und"]), text))
    frame = frame_of(spark, rows).repartition(7)
    assert len(check(frame, 5)) > 100
    check(frame, 12, top=9)


def test_loops_and_very_frequent_words(spark):
    frame = frame_of(spark, [("en", "a a a a a a a a " * 30), ("en", "b a b a b a b a " * 20),
                             ("de", "ja " * 500), (None, None), ("en", "")])
    check(frame, 10)
    check(frame, 1)


def test_rare_pairs_may_share_a_bit(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_BITS", 64)
    monkeypatch.setattr(P, "LEAST_BITS", 64)
    random.seed(3)
    rows = [("en", " ".join(random.choices("abcdefghijklmnop", k=30))) for _ in range(200)]
    check(frame_of(spark, rows), 20)


def test_small_buffers_give_the_same(spark, monkeypatch):
    random.seed(4)
    rows = [(f"l{i % 90}", "go on and on and on, go on") for i in range(900)]
    check(frame_of(spark, rows), 10)
    assert list(P._by_language(iter([]))) == []


def test_odd_rows_and_none(spark):
    check(odd_documents(spark), 2)
    check(no_documents(spark), 2)


def test_paths_are_maximal(spark):
    words = "one two three four five six seven eight nine ten"
    tables = P.count_phrases(frame_of(spark, [("en", words)] * 3 + [("en", words[:28])] * 2), 1)
    compact = P.paths(tables[4], tables[3])
    assert sorted((" ".join(r.words), r.f) for r in compact.collect()) == [
        ("one two three four five six", 5), ("three four five six seven eight nine ten", 3)]
