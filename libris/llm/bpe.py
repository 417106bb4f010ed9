"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from libris.llm.common import Numbered, Ragged, Remembered, by_parts, strings

#: The characters of Unicode's White_Space property, what ``\s`` means in patterns.
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A match of the usual patterns never crosses the place between a character that isn't
#: white space and white space, so a text can be cut there before the pattern is applied.
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


class RankQueue:
    """Sequence positions by the rank of the merge that could happen there.

    A bucket per rank; three levels of 64-bit words tell which buckets have
    entries, so that find-first-set gives the lowest rank.  Entries are not taken
    out when a neighbouring merge changes a position: they are stale and skipped.
    """

    def __init__(self, ranks: int):
        if ranks > 1 << 18:
            raise ValueError("three levels of 64 bits hold 262144 ranks")
        self.buckets: list[array | None] = [None] * ranks
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def fill(self, rank: int, positions: array) -> None:
        """Makes ``positions`` the bucket of a rank that has none."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, array] | None:
        """The lowest rank that has entries, and these in no order."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket = self.buckets[rank]
        self.buckets[rank] = None
        return rank, bucket


class ByteBPE:
    """Encoder and decoder for a file of ranks: a line per token, its base64 and its rank.

    ``pattern`` cuts texts into pieces that are encoded separately.  A token's
    id is its rank; there are no special tokens.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_kept: int = 60_000):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must have a rank")
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.end = self.size  # stands between pieces and merges with nothing
        self.width = self.size + 1
        #: left id * width + right id -> id of the merge
        self.merges: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left * self.width + right] = rank
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)] + [self.end], np.int32)
        pairs = self.byte_ids[:, None].astype(np.int64) * self.width + self.byte_ids[None, :]
        self.first_rank = np.array([self.merges.get(x, -1) for x in pairs.ravel().tolist()], np.int32).reshape(257, 257)
        keys = np.array(list(self.merges), np.int64)
        order = np.argsort(keys)
        self.keys, self.results = keys[order], np.array(list(self.merges.values()), np.int32)[order]
        self.kept = Remembered(self._chunks, most_kept)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """The merges of many pairs, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.results[at], np.int32(-1))

    def merge(self, pieces: Sequence[bytes], wide: int = 40) -> Ragged:
        """The ids of every piece.

        All pieces lie in one linked sequence with ends between them and share one
        queue, so its lowest rank is the lowest of every piece that has an entry
        there.  A merge's pair is looked up by its ids, which is the same as by its
        bytes.  A bucket with entries of ``wide`` pieces has one of each merged at once;
        others are merged in turn, until a merge makes a pair of no higher rank.
        So each piece sees its merges in the order lowest rank first, leftmost first.
        """
        if not pieces:
            return Ragged.empty()
        sizes = np.array([len(x) for x in pieces])
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        raw = np.full(n, 256, np.int16)
        inside = np.ones(n, bool)
        inside[ends] = False
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
        rank_of = np.append(self.first_rank[raw[:-1], raw[1:]], np.int32(-1))
        ids_of = self.byte_ids[raw]
        after_of = np.arange(1, n + 1, dtype=np.int32)
        before_of = np.arange(-1, n - 1, dtype=np.int32)
        del raw, inside
        queue = RankQueue(self.size)
        order = np.argsort(rank_of, kind="stable")
        order = order[int(np.searchsorted(rank_of[order], 0)) :]
        if len(order):
            of = rank_of[order]
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for rank, a, b in zip(of[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
                queue.fill(rank, array("i", order[a:b].astype(np.int32).tobytes()))
        del order
        ids, rank_at, after, before = (memoryview(x) for x in (ids_of, rank_of, after_of, before_of))
        find, width, buckets, fill, size = self.merges.get, self.width, queue.buckets, queue.fill, self.size
        while (lowest := queue.pop()) is not None:
            rank, bucket = lowest
            several = False
            if len(bucket) >= wide:
                i = np.unique(np.frombuffer(bucket, np.int32))
                i = i[rank_of[i] == rank]  # without the stale ones
                piece = piece_of[i]
                leftmost = np.ones(len(i), bool)
                leftmost[1:] = piece[1:] != piece[:-1]
                several = int(leftmost.sum()) >= wide
                bucket = memoryview(i)
            if several:
                if not leftmost.all():
                    fill(rank, array("i", i[~leftmost].tobytes()))
                    i = i[leftmost]
                j = after_of[i]
                k = after_of[j]
                ids_of[i], ids_of[j] = rank, -1
                rank_of[j] = -1
                after_of[i] = k
                before_of[k] = i
                h = before_of[i]
                h = h[h >= 0]
                new_i = self._find(rank * width + ids_of[k].astype(np.int64))
                new_h = self._find(ids_of[h].astype(np.int64) * width + rank)
                rank_of[i], rank_of[h] = new_i, new_h
                ranks, places = np.concatenate([new_i, new_h]), np.concatenate([i, h])
                on = ranks >= 0
                for r, p in zip(ranks[on].tolist(), places[on].tolist(), strict=True):
                    if (other := buckets[r]) is None:
                        fill(r, array("i", (p,)))
                    else:
                        other.append(p)
                continue
            else:
                bucket = sorted(bucket)
            for at, i in enumerate(bucket):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                ids[i] = rank
                ids[j] = -1
                rank_at[j] = -1
                after[i] = k
                before[k] = i
                rank_at[i] = new = find(rank * width + ids[k], -1)
                least = size
                if new >= 0:
                    if (other := buckets[new]) is None:
                        fill(new, array("i", (i,)))
                    else:
                        other.append(i)
                    least = new
                h = before[i]
                if h >= 0:
                    rank_at[h] = new = find(ids[h] * width + rank, -1)
                    if new >= 0:
                        if (other := buckets[new]) is None:
                            fill(new, array("i", (h,)))
                        else:
                            other.append(h)
                        if new < least:
                            least = new
                if least <= rank:
                    if len(rest := bucket[at + 1 :]):
                        if buckets[rank] is None:
                            fill(rank, array("i", rest))
                        else:
                            buckets[rank].extend(rest)
                    break
        alive = ids_of >= 0
        real = alive & (ids_of != self.end)
        return Ragged(ids_of[real], np.bincount(piece_of[real], minlength=len(pieces)))

    def _chunks(self, chunks: Sequence[str]) -> Ragged:
        """The ids of each chunk; all their pieces go through the queue together."""
        pieces = Numbered()
        found = [[pieces[x] for x in self.pattern.findall(c)] for c in chunks]
        raw = [x.encode() for x in pieces]
        whole = np.array([self.ranks.get(x, -1) for x in raw], np.int32)
        parts = np.flatnonzero(whole < 0)
        merged: list[Ragged] = [Ragged(whole[whole >= 0], np.ones(int((whole >= 0).sum()), np.int64))]
        start, most = 0, 1 << 19
        while start < len(parts):
            stop, size = start, 0
            while stop < len(parts) and (size < most or stop == start):
                size += len(raw[parts[stop]])
                stop += 1
            merged.append(self.merge([raw[p] for p in parts[start:stop].tolist()]))
            start = stop
        by_piece = np.empty(len(raw), np.int64)
        by_piece[whole >= 0] = np.arange(len(raw) - len(parts))
        by_piece[parts] = np.arange(len(raw) - len(parts), len(raw))
        counts = np.array([len(x) for x in found], np.int64)
        if not len(raw):
            return Ragged(np.zeros(0, np.int32), counts * 0)
        return Ragged.joined(merged).grouped(by_piece[np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))], counts)

    def encode_all(self, texts: Sequence[str]) -> Ragged:
        """The ids of each text."""
        return self.kept.encoded(map(_CHUNK.findall, texts))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text]).flat.tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> list[bytes]:
    """The tokens by id, all that decoding needs."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per worker process and vocabulary."""
    return ByteBPE.from_file(path, pattern)


def encoded(text: str | Column, path: str, pattern: str) -> Column:
    """Column of token ids (array of int) of a text column; null counts as the empty text.

    ``path`` must be readable on every executor: it is a file of a package installed there.
    Texts of any length are encoded whole; what is remembered of them is bounded
    (:class:`libris.llm.common.Remembered`), and a batch is worked through in parts of about 2 MB.
    """

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path, pattern)

        def work(part: pa.Array) -> pa.Array:
            ids = bpe.encode_all(strings(part))
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ids.counts)].astype(np.int32)), pa.array(ids.flat))

        return by_parts(column, pa.list_(pa.int32()), work)

    # called deterministic it would be computed again for every use of the column
    return encode.asNondeterministic()(text)


def decoded(ids: str | Column, path: str) -> Column:
    """Column of the bytes that a column of token ids stands for; null gives null, an unknown id is an error."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        token = vocabulary(path).__getitem__
        rows = (v.values.to_numpy() if v.is_valid else None for v in column)
        return pa.array((None if x is None else b"".join(map(token, x.tolist())) for x in rows), pa.binary(), size=len(column))

    return decode(ids)
