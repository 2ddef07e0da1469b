"""Byte-level BPE: encode texts into token ids and decode ids into bytes.

A text is cut by a pattern; each distinct piece is encoded once per task. Pieces that are tokens
take their id. The others are put, by length classes, into padded matrices of byte tokens: in
every round each row merges its leftmost pair of lowest rank, ranks come from an open-addressing
hash table of pairs, rows close their gap, and rows without a pair leave the matrix.

A piece of more than ``LONG_PIECE`` bytes would need as many rounds over as wide a row, so it is
merged in the same order with a heap of its pairs instead; its result is the same.

NULL and empty texts have no tokens. Ids are ranks. Characters that UTF-8 cannot hold become
question marks, as nothing else can be decoded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import with_results
from gazette.shipping import ship_package

NONE = np.int64(1 << 40)
LONG_PIECE = 2048
# Kept by a worker process as long as it lives, beside whatever later stages need.
CACHED_PIECES = 100_000
_LOADED: dict[str, "Codec"] = {}


class PairTable:
    """(left id, right id) -> id of the merged token, as two flat arrays probed linearly."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where the pair is no token. Padding (-1) never matches."""
        keys = (left << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            open_, slot = open_[go], slot[go]
        return out


class Codec:
    """A vocabulary of byte strings with ranks, and the pattern that cuts texts."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import regex

        pairs = (line.split() for line in ranks_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.cut = regex.compile(pattern).findall
        self.bytes_of = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                a, b = get(token[:at]), get(token[at:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.pairs = PairTable(keys, np.array(merged, np.int64))
        self.cache: dict[str, bytes] = {}

    # ---- encoding

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self.cut(text) for text in texts]
        if len(self.cache) > CACHED_PIECES:
            self.cache = {}
        new = list(set().union(*cut) - self.cache.keys())
        raw = [piece.encode("utf-8", "replace") for piece in new]
        self.cache.update(zip(new, self.encode_pieces(raw), strict=True))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), "<u4") for pieces in cut]

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(piece)
            elif piece:
                classes.setdefault(len(piece).bit_length(), []).append(i)
        for width, members in classes.items():
            step = max(1, (1 << 20) >> width)
            for at in range(0, len(members), step):
                self._merge_rows(pieces, members[at:at + step], out)
        return out

    def _merge_rows(self, every_piece: Sequence[bytes], chosen: Sequence[int],
                    out: list[bytes]) -> None:
        pieces = [every_piece[i] for i in chosen]
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        rows = np.full((len(pieces), width), -1, np.int64)
        inside = np.arange(width) < lengths[:, None]
        rows[inside] = self.bytes_of[np.frombuffer(b"".join(pieces), np.uint8)]
        flat = self.pairs.look_up(rows[:, :-1].ravel(), rows[:, 1:].ravel())
        ranks = flat.reshape(len(pieces), width - 1)
        owner = np.array(chosen)
        while len(owner):
            at = ranks.argmin(1)
            every = np.arange(len(owner))
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                ended = rows[done]
                ids = ended[ended >= 0].astype("<u4").tobytes()
                ends = (4 * np.cumsum((ended >= 0).sum(1))).tolist()
                for i, a, b in zip(owner[done].tolist(), [0, *ends], ends):
                    out[i] = ids[a:b]
                go = ~done
                rows, ranks, owner, at, best = rows[go], ranks[go], owner[go], at[go], best[go]
                if not len(owner):
                    break
                every = np.arange(len(owner))
            rows[every, at] = best
            rows = self._close_gap(rows, at + 1, -1)
            ranks = self._close_gap(ranks, at, NONE)
            # Only the pairs beside the new token change.
            right = at < ranks.shape[1]
            ranks[every[right], at[right]] = self.pairs.look_up(
                rows[every[right], at[right]], rows[every[right], at[right] + 1])
            left = at > 0
            ranks[every[left], at[left] - 1] = self.pairs.look_up(
                rows[every[left], at[left] - 1], rows[every[left], at[left]])

    @staticmethod
    def _close_gap(matrix: np.ndarray, gone: np.ndarray, fill) -> np.ndarray:
        """Drop one column per row; rows get one shorter, the common width with them."""
        keep = np.ones(matrix.shape, bool)
        keep[np.arange(len(matrix)), gone] = False
        closed = matrix[keep].reshape(len(matrix), -1)
        return closed if closed.shape[1] else np.full((len(matrix), 1), fill, np.int64)

    def _merge_long(self, piece: bytes) -> bytes:
        ids = self.bytes_of[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.look_up(ids[:-1].copy(), ids[1:].copy())
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < NONE]
        heapq.heapify(heap)
        current = dict((i, r) for r, i in heap)
        tokens, get = self.tokens, self.ranks.get

        def renew(i: int) -> None:
            j = after[i]
            rank = get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None
            if rank is None:
                current.pop(i, None)
            else:
                current[i] = rank
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if current.get(i) != rank or ids[i] < 0:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            current.pop(j, None)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # ---- decoding

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary, built once per Python process."""
    key = hashlib.sha1(ranks_file + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Codec(ranks_file, pattern)
    return _LOADED[key]


def sent(spark: SparkSession, ranks_path: str):
    """The vocabulary file, read on the driver and broadcast (under 1 MB for 50,000 tokens)."""
    with open(ranks_path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
           out_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus the array of ids of each text. NULL text: no ids."""
    ranks = sent(docs.sparkSession, ranks_path)

    def work(texts: list[str]) -> dict[str, list]:
        return {out_col: [ids.astype(np.int32)
                          for ids in codec(ranks.value, pattern).encode(texts)]}

    return with_results(docs.drop(out_col), work, f"`{out_col}` array<int>", text_col)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
           out_col: str = "decoded") -> DataFrame:
    """All columns of ``rows`` plus the bytes of each array of ids. NULL ids: no bytes."""
    ranks = sent(rows.sparkSession, ranks_path)
    schema = rows.drop(out_col).schema.add(out_col, "binary")
    at = rows.drop(out_col).columns.index(ids_col)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from gazette.llm.common import slices

        target = to_arrow_schema(schema)
        for part in slices(batches):
            own = codec(ranks.value, pattern)
            raw = [own.decode(ids or ()) for ids in part.column(at).to_pylist()]
            columns = [*part.columns, pa.array(raw, target.field(out_col).type)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    ship_package(rows.sparkSession)
    return rows.drop(out_col).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, its ids decoded again.

    Both directions run in the same pass, so the ids of a long text never leave their task.
    """
    ranks = sent(docs.sparkSession, ranks_path)

    def work(texts: list[str]) -> dict[str, list]:
        own = codec(ranks.value, pattern)
        ids = own.encode(texts)
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(own.decode(x.tolist())).hexdigest() for x in ids],
        }

    rows = docs.select(F.col("doc_id"), F.col("text"))
    return with_results(rows, work,
                        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                        keep=["doc_id"])
