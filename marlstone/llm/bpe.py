"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are cut by the tokenizer's pattern. The distinct pieces of a slice are put
into padded matrices by length; in every round each row merges its leftmost pair
of least rank, ranks come from a hashed table of pairs, and the matrix is
compacted by one column. Rows without a pair left are taken out.

Edge cases: a null or empty text has no tokens and decodes to no bytes. Repeated
rows are encoded each. Other columns of the input are left as they are; the
result columns take the names given. No text is cut short: pieces of any length
are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import give_back, slices

NO_PAIR = np.int32(2**31 - 1)
#: Pieces longer than this are merged one by one, all safe occurrences of a pair in a round.
WIDEST = 128
#: Cells of a matrix, and pieces that a task remembers.
CELLS, MEMO = 1_000_000, 200_000
#: Characters of texts encoded at once.
SLICE = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Codec:
    """The pair table of a vocabulary and the matrix encoder over it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_size = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._hash(np.fromiter(pairs, dtype=np.uint64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs)))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Fill an open-addressing table at a load of an eighth at most."""
        self.bits = max(10, int(len(keys) * 8 - 1).bit_length())
        self.slot_key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.slot_value = np.full(1 << self.bits, NO_PAIR)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] == np.uint64(2**64 - 1)
            self.slot_key[at[free]] = keys[free]  # of several keys on a slot, one stays
            put = self.slot_key[at] == keys
            self.slot_value[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NO_PAIR where they make no token; negative ids are padding."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).astype(np.uint64)
        at = self._slot(keys)
        seen = self.slot_key[at]
        out = np.where(seen == keys, self.slot_value[at], NO_PAIR)
        more = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            seen = self.slot_key[at[more]]
            hit = seen == keys[more]
            out[more[hit]] = self.slot_value[at[more[hit]]]
            more = more[~hit & (seen != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = NO_PAIR
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each piece has."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # numbers of pieces, their counts of ids, the ids
        by_width: dict[int, list[int]] = {}
        whole: list[int] = []
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                whole.append(i)
            elif len(piece) > WIDEST:
                ids = self._encode_long(self.byte_ids[np.frombuffer(piece, dtype=np.uint8)])
                found.append((np.array([i]), np.array([len(ids)]), ids))
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        if whole:
            found.append((np.array(whole), np.ones(len(whole), np.int64), np.array([self.ranks[pieces[i]] for i in whole], np.int32)))
        for width, rows in by_width.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                found += self._encode_matrix([pieces[i] for i in rows[k : k + step]], np.array(rows[k : k + step]), width)
        own, size, flat = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(own)
        at = (np.cumsum(size) - size)[order]
        size = size[order]
        return flat[_ranges(at, size)], size

    def _encode_matrix(self, pieces: list[bytes], own: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge the leftmost pair of least rank of every row, round by round; yields rows as they end."""
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(own), width - 1)
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            best = ranks[np.arange(len(own)), at] if ranks.shape[1] else np.full(len(own), NO_PAIR)
            over = best == NO_PAIR
            if over.any():
                ended = ids[over]
                yield own[over], length[over], ended[np.arange(ended.shape[1]) < length[over][:, None]]
                go = ~over
                ids, ranks, own, length, at, best = ids[go], ranks[go], own[go], length[go], at[go], best[go]
                if not len(own):
                    return
            line = np.arange(len(own))
            ids[line, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(own), -1)
            length = length - 1
            keep = np.ones(ranks.shape, dtype=bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(own), -1)
            right = np.flatnonzero(at < ids.shape[1] - 1)
            ranks[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])

    def _encode_long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long piece. A round merges the occurrences of the least pair from the left, up to the first
        whose new neighbours make a lower pair: that one would be next if each were merged alone."""
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NO_PAIR:
            at = np.flatnonzero(ranks == best)
            first = np.concatenate(([True], np.diff(at) > 1))
            run_start = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            at = at[(at - run_start) % 2 == 0]  # occurrences that overlap: every other one
            before = np.concatenate(([np.int32(-1)], ids))[at]
            before[1:][np.diff(at) == 2] = best
            after = np.concatenate((ids, [np.int32(-1), np.int32(-1)]))[at + 2]
            new = np.full(len(at), best, dtype=np.int32)
            lower = (self.pair_ranks(before, new) < best) | (self.pair_ranks(new, after) < best)
            at = at[: int(lower.argmax()) + 1] if lower.any() else at
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids[at] = best
            ids = ids[keep]
            spot = at - np.arange(len(at))
            keep = np.ones(len(ranks), dtype=bool)
            keep[at] = False
            ranks = ranks[keep]
            for side in (spot - 1, spot):
                side = side[(side >= 0) & (side < len(ranks))]
                ranks[side] = self.pair_ranks(ids[side], ids[side + 1])
        return ids

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each text's ids, gathered from the tokens' bytes."""
        flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int64)
        size = self.token_size[flat]
        out = self.token_bytes[_ranges(self.token_start[flat], size)].tobytes()
        cut = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *map(len, ids)])].tolist()
        return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start..start+size-1 of each row, one row after the other."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


class Memo(dict):
    """Numbers pieces in the order they come; ``new`` holds those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k


class Encoder:
    """Encodes texts and remembers a bounded number of pieces."""

    def __init__(self, codec: Codec, pattern: str):
        self.codec, self.find = codec, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.memo = Memo()
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.forget()
        number = self.memo.__getitem__
        cut = [np.fromiter(map(number, pieces), dtype=np.int64, count=len(pieces)) for pieces in map(self.find, texts)]
        if self.memo.new:
            flat, size = self.codec.encode_pieces([p.encode() for p in self.memo.new])
            start = len(self.flat) + np.cumsum(size) - size
            self.flat, self.start, self.size = (np.concatenate(x) for x in ((self.flat, flat), (self.start, start), (self.size, size)))
            self.memo.new = []
        return [self.flat[_ranges(self.start[k], self.size[k])] for k in cut]


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def _encoder(content: Broadcast, pattern: str) -> Encoder:
    """The encoder of this worker, built once for a vocabulary."""
    key = (hashlib.sha256(content.value).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Codec(read_ranks(content.value)), pattern)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, vocabulary_path: str) -> Broadcast:
    """A vocabulary file, bounded by its own size (under 1 MB here), read by the driver and sent to the workers."""
    with open(vocabulary_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, text_col: str, vocabulary_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """``df`` with the ids of its texts as an array of integers."""
    content = _vocabulary(df, vocabulary_path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(content, pattern)
        for batch in texts:
            yield pd.Series([ids for _, part in slices(batch, SLICE) for ids in encoder.encode(part)], dtype=object)
        encoder.forget()
        give_back()

    return df.withColumn(ids_col, ids_of(F.col(text_col)))


def decode(df: DataFrame, ids_col: str, vocabulary_path: str, pattern: str, bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids; null ids make no bytes."""
    content = _vocabulary(df, vocabulary_path)

    @F.pandas_udf(T.BinaryType())
    def bytes_of(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _encoder(content, pattern).codec
        for batch in ids:
            yield pd.Series(codec.decode([np.asarray([] if x is None else x, dtype=np.int32) for x in batch]) if len(batch) else [], dtype=object)

    return df.withColumn(bytes_col, bytes_of(F.col(ids_col)))


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass over the table; per row the id, the count of tokens and the digests
    of the ids (little-endian unsigned 32-bit) and of the decoded bytes. Nothing is shuffled."""
    content = _vocabulary(df, vocabulary_path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(content, pattern)
        for batch in texts:
            rows = []
            for _, part in slices(batch, SLICE):
                coded = encoder.encode(part)
                rows += [(len(ids), _sha256(ids.astype("<u4").tobytes()), _sha256(text)) for ids, text in zip(coded, encoder.codec.decode(coded), strict=True)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.forget()
        give_back()

    return df.select(F.col(id_col).alias("_id"), digests(F.col(text_col)).alias("_digests")).select(F.col("_id").alias(id_col), "_digests.*")
