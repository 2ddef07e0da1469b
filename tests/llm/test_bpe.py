from __future__ import annotations

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gazette.llm import bpe
from odd import no_documents, odd_documents

PATH = P.path("byte_bpe_50k.tiktoken")
RAW = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RAW, P.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_library_would(text):
    own = bpe.codec(RAW, P.PATTERN)
    text = text.encode("utf-8", "replace").decode()
    ids = own.encode([text])[0].tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_pieces_and_odd_spaces(codec):
    random.seed(5)
    texts = ["a" * 5000, "ab" * 9000, " " * 3000 + "x", "é" * 3000, "1" * 4000, "thering" * 2000,
             "x" * (bpe.LONG_PIECE + 1), "\x1c\x85 ᠎​ <|endoftext|> it's"]
    texts += ["".join(random.choice("abé\n\t 1日'") for _ in range(200)) for _ in range(50)]
    assert [x.tolist() for x in codec.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_pair_table_holds_every_split(codec):
    some = random.Random(1).sample(sorted(RANKS), 300)
    for token in some:
        for at in range(1, len(token)):
            a, b = RANKS.get(token[:at]), RANKS.get(token[at:])
            if a is not None and b is not None:
                import numpy as np
                assert codec.pairs.look_up(np.array([a]), np.array([b]))[0] == RANKS[token]


def test_round_trip_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(rows) == 10
    for r in rows:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert list(r.ids) == LIBRARY.encode_ordinary(r.text or "")
    assert bpe.digests(docs, PATH, P.PATTERN).count() == 10
    assert bpe.digests(no_documents(spark), PATH, P.PATTERN).count() == 0
