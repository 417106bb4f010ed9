"""What the operators share: checkpoints, column names, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libris.checkpoints import checkpointed, deleted, shared_folder

__all__ = ["OWN", "Numbered", "Ragged", "Remembered", "by_parts", "checkpointed", "deleted", "parts", "shared_folder", "slices", "smallest", "strings", "table", "without"]

#: Columns that an operator adds while it works start with this, so that they
#: can't clash with columns of the input.
OWN = "__libris_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(rows: DataFrame, order: str, most: int, n: int) -> DataFrame:
    """The ``most`` rows of the smallest hashes in column ``order`` (uniform over all longs), of ``n`` rows in all.

    Rows are first filtered by a threshold that leaves about twice as many, so that
    tasks don't each pass on their own smallest ones; if chance leaves too few, all are looked at.
    """
    wanted = 2 * most + 1000
    if n > wanted:
        below = rows.where(F.col(order) < -(1 << 63) + (1 << 64) * wanted // n)
        if below.count() >= most:
            rows = below
    return rows.orderBy(order, *[c for c in rows.columns if c != order]).limit(most)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names in any case)."""
    gone = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def strings(column: pa.Array) -> list[str]:
    """The column's texts, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def parts(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[pa.Array]:
    """A text column cut into pieces of about ``most_bytes``; no text is cut."""
    for batch in slices([pa.RecordBatch.from_arrays([column], ["x"])], "x", most_bytes):
        yield batch.column(0)


def by_parts(column: pa.Array, kind: pa.DataType, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What ``work`` gives for a column, done in :func:`parts`, so that its lists and arrays are those of one part only."""
    done = [work(part) for part in parts(column)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one text column holds about ``most_bytes`` in each.

    No row is cut: a text that is longer than that is alone in its batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


@dataclass
class Ragged:
    """Rows of ids, one after the other."""

    flat: np.ndarray
    counts: np.ndarray

    @staticmethod
    def empty() -> Ragged:
        return Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))

    @staticmethod
    def joined(parts: Sequence[Ragged]) -> Ragged:
        return Ragged(np.concatenate([p.flat for p in parts]), np.concatenate([p.counts for p in parts]))

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the given rows, flat."""
        n = self.counts[rows]
        first = (np.cumsum(self.counts) - self.counts)[rows]
        shift = np.repeat(first - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(len(shift))]

    def grouped(self, rows: np.ndarray, sizes: np.ndarray) -> Ragged:
        """Longer rows, made of the rows of these numbers: the first ``sizes[0]`` of them, and so on."""
        ends = np.r_[0, np.cumsum(self.counts[rows])]
        return Ragged(self.take(rows), np.diff(ends[np.r_[0, np.cumsum(sizes)]]))


class _Kept(Numbered):
    """Numbers of keys of up to ``longest`` characters; longer ones are numbered -1, -2, ... in ``long``."""

    def __init__(self, longest: int):
        super().__init__()
        self.longest, self.long = longest, Numbered()

    def __missing__(self, key: str) -> int:
        return super().__missing__(key) if len(key) <= self.longest else ~self.long[key]


class Remembered:
    """Ids of chunks of text; those of short chunks seen lately are kept.

    A text is a row of chunk numbers, so that the text's own ids are gathered from
    what is kept without a step per id.  Kept are chunks of at most ``longest`` characters: once there are
    ``most``, they become the elder ones, of which only those met again are kept on.  So at most twice as many
    are held, besides those of the last call.  A longer chunk is encoded once a call.
    """

    def __init__(self, encode: Callable[[list[str]], Ragged], most: int, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.numbers, self.ids = _Kept(longest), Ragged.empty()
        self.elder, self.elder_ids = _Kept(longest), Ragged.empty()

    def _known(self, chunks: list[str]) -> Ragged:
        """The ids of new chunks, of which some are among the elder ones."""
        if not self.elder:
            return self.encode(chunks)
        at = np.fromiter((self.elder.get(c, -1) for c in chunks), np.int64, len(chunks))
        old = at >= 0
        ids = Ragged.joined([self.elder_ids.grouped(at[old], np.ones(int(old.sum()), np.int64)), self.encode([c for c, x in zip(chunks, old.tolist(), strict=True) if not x])])
        place = np.empty(len(chunks), np.int64)
        place[old] = np.arange(int(old.sum()))
        place[~old] = np.arange(int(old.sum()), len(chunks))
        return ids.grouped(place, np.ones(len(chunks), np.int64))

    def encoded(self, chunked: Iterable[Iterable[str]]) -> Ragged:
        """The ids of texts that are given by their chunks."""
        if len(self.numbers) > self.most:
            self.elder, self.elder_ids = self.numbers, self.ids
            self.numbers, self.ids = _Kept(self.longest), Ragged.empty()
        had = len(self.numbers)
        number = self.numbers.__getitem__
        rows = [np.fromiter(map(number, chunks), np.int32) for chunks in chunked]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        del rows
        self.ids = Ragged.joined([self.ids, self._known(list(islice(self.numbers, had, None)))])
        ids = self.ids
        if self.numbers.long:
            ids = Ragged.joined([ids, self.encode(list(self.numbers.long))])
            flat = np.where(flat < 0, len(self.numbers) + ~flat, flat)
            self.numbers.long = Numbered()
        return ids.grouped(flat, sizes)
