"""Packing of tokenised documents into sequences: cutting stock by column generation."""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libris.llm.common import OWN, Numbered, Ragged, Remembered, by_parts, checkpointed, slices, strings

#: Python's white space that the tokenizer doesn't take for white space.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


def _is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1, whose small letters are the same for Python and the tokenizer."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordCache:
    """Ids of texts by a tokenizer that drops white space and treats words between it separately.

    The tokenizer also parts letters from what isn't one, so a word's full stops and
    commas at its end are encoded for themselves; it makes letters small, which is done
    before where all are of Latin-1.  A text with control characters that only Python takes
    for white space is encoded as a whole.
    """

    def __init__(self, path: str, most_kept: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept = Remembered(self._words, most_kept)

    def _words(self, words: list[str]) -> Ragged:
        bare = Numbered()
        used: list[int] = []
        sizes: list[int] = []
        for w in words:
            if w[-1:] in ".," and (core := w.rstrip(".,")) and core[-1].lower().isalpha():
                used += (bare[core], bare[w[len(core) :]])
                sizes.append(2)
            else:
                used.append(bare[w])
                sizes.append(1)
        distinct = list(bare)
        found: list[list[int]] = []
        for start in range(0, len(distinct), 20_000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(distinct[start : start + 20_000], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = Ragged(np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts)
        return ids.grouped(np.array(used, np.int64), np.array(sizes, np.int64))

    def encode_all(self, texts: Sequence[str]) -> Ragged:
        return self.kept.encoded([t] if any(c in t for c in _ODD_SPACE) else (t.lower() if _is_latin(t) else t).split() for t in texts)


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    return WordCache(path)


def token_counts(text: str | Column, path: str) -> Column:
    """Column of the numbers of ids of a text column; null counts as the empty text."""

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        return by_parts(column, pa.int64(), lambda part: pa.array(_cache(path).encode_all(strings(part)).counts, pa.int64()))

    return count(text)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """(id_col, start, length, doc_tokens, ids): each document's ids and ``end_id``, cut at multiples of ``capacity``.

    ids are binary, little-endian unsigned 32-bit.  A null text counts as empty, so
    it gives one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            encoded = _cache(path).encode_all(strings(batch.column("text")))
            end = np.array([end_id], "<u4").tobytes()
            raw_all, at = encoded.flat.astype("<u4").tobytes(), 0
            for ident, count in zip(batch.column("id").to_pylist(), encoded.counts.tolist(), strict=True):
                raw = raw_all[4 * at : 4 * (at + count)] + end
                at += count
                n = count + 1
                rows += [(ident, s, min(capacity, n - s), n, raw[4 * s : 4 * (s + capacity)]) for s in range(0, n, capacity)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, "start", "length", "doc_tokens", "ids"])

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, f"`{id_col}` long, start long, length long, doc_tokens long, ids binary")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int = 4) -> list[tuple[float, np.ndarray]]:
    """Valuable multisets of sizes that fit, the best one first: value and how often each size is in it.

    One table of best values by room; of the multisets that hold a given size the
    best follows from it, and the ``most`` best of these are returned.
    """
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if n := upto[w]:
            got = best[w - sizes[:n]] + values[:n]
            k = got.argmax()
            if got[k] > best[w] + 1e-12:
                best[w], choice[w] = got[k], k
    with_size = values + best[capacity - sizes]
    out = []
    for first in np.argsort(-with_size, kind="stable")[:most].tolist():
        taken = np.zeros(len(sizes), np.int64)
        taken[first] = 1
        w = capacity - int(sizes[first])
        while w > 0:
            if choice[w] < 0:
                w -= 1
            else:
                taken[choice[w]] += 1
                w -= int(sizes[choice[w]])
        out.append((float(with_size[first]), taken))
    return out


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often the linear program uses them, so that demand is met exactly.

    The master keeps a basis of patterns, at first those of one size each.  Its dual
    values price sizes, the knapsack finds the patterns of the best prices, and each
    that is still priced over 1 replaces one of the basis.  Ends when no price is
    over 1 + gap, which bounds the distance from the optimum by gap, or after
    ``most`` knapsacks; either way the plan holds.
    """
    fit = capacity // sizes
    basis = np.diag(fit).astype(float)
    inverse = np.diag(1 / fit)
    used = demand / fit
    for step in range(most):
        found = knapsack(sizes, inverse.sum(axis=0), capacity)
        if found[0][0] <= 1 + gap:
            break
        for _, column in found:
            if inverse.sum(axis=0) @ column <= 1 + gap:
                continue
            move = inverse @ column
            up = move > 1e-9
            ratio = np.full(len(used), np.inf)
            ratio[up] = used[up] / move[up]
            r = int(ratio.argmin())
            amount = ratio[r]
            used = np.maximum(used - amount * move, 0)
            used[r] = amount
            basis[:, r] = column
            pivot = inverse[r] / move[r]
            inverse -= np.outer(move, pivot)
            inverse[r] = pivot
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64), used


@dataclass(frozen=True)
class Plan:
    """Where the items of each size class go, by their rank in the class.

    Row i of the arrays: items of class ``of[i]`` from rank ``rank[i]`` on go to the
    sequences from ``sequence[i]`` on, ``each[i]`` to one, at slots from ``slot[i]`` on.
    Rows are sorted by class and rank.
    """

    of: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    slot: np.ndarray
    sequences: int

    def place(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of items."""
        wide = np.int64(1) << 48
        i = np.searchsorted(self.of * wide + self.rank, classes * wide + ranks, side="right") - 1
        k = ranks - self.rank[i]
        return self.sequence[i] + k // self.each[i], self.slot[i] + k % self.each[i]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """A plan for ``counts`` items of each size (1 to capacity).

    The linear program's patterns are used as often as its solution says, rounded
    down; the few items left (at most as many as fit the patterns once each) are
    packed best fit, largest first.
    """
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[s] for s in sizes.tolist()], np.int64)
    bins: list[tuple[dict[int, int], int]] = []  # sizes in a sequence, number of such sequences
    if len(sizes):
        patterns, used = column_generation(sizes, demand.astype(float), capacity)
        left = demand.copy()
        for k in np.argsort(-used, kind="stable").tolist():
            a = patterns[k]
            on = a > 0
            n = min(int(used[k] + 1e-6), int((left[on] // a[on]).min()) if on.any() else 0)
            if n > 0:
                left -= n * a
                bins.append(({int(s): int(x) for s, x in zip(sizes[on], a[on], strict=True)}, n))
        open_bins: list[list[int]] = []
        room: list[int] = []
        for s, n in zip(sizes[::-1].tolist(), left[::-1].tolist(), strict=True):
            for _ in range(n):
                fits = [(r, i) for i, r in enumerate(room) if r >= s]
                if fits:
                    i = min(fits)[1]
                    open_bins[i].append(s)
                    room[i] -= s
                else:
                    open_bins.append([s])
                    room.append(capacity - s)
        bins += [(dict(x), n) for x, n in ((Counter(dict(k)), n) for k, n in Counter(tuple(sorted(Counter(b).items())) for b in open_bins).items())]
    rows, next_rank, sequence = [], Counter(), 0
    for content, n in bins:
        slot = 0
        for s, a in sorted(content.items(), reverse=True):
            rows.append((s, next_rank[s], sequence, a, slot))
            next_rank[s] += n * a
            slot += a
        sequence += n
    rows.sort()
    of, rank, seq, each, slot = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    return Plan(of, rank, seq, each, slot, sequence)


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = 4096, unit: int = 16, bucket_rows: int = 4_000) -> DataFrame:
    """``cut`` (from :func:`pieces`, with any further columns) with ``sequence_id`` and ``offset`` for each piece.

    Lengths are counted in units of ``unit`` ids, rounded up; pieces of up to half a unit are
    bundled, as many of one length as a unit holds.  So the histogram has few
    classes whatever the input: it alone goes to the driver, and
    the plan made of it comes back.  A piece finds its place by its rank in its
    class, an order by (hash bucket, id, start): buckets are counted, their counts
    summed up within a class, and pieces ranked within their bucket, so that a class
    with a third of all pieces still is many tasks; rows are numbered for that, so
    an id with a third of all rows is dealt out as well.  Offsets are gapless from 0.
    An empty input gives an empty result.
    """
    row = f"{OWN}row"
    columns = cut.columns
    cut = checkpointed(cut.withColumn(row, F.monotonically_increasing_id()))
    n = cut.count()
    half = unit // 2
    item = F.when(F.col("length") <= half, F.col("length")).otherwise(half + F.ceil(F.col("length") / unit)).cast("long")
    hashed = F.xxhash64(id_col, "start", row)
    items = cut.withColumn("item", item).withColumn("bucket", F.pmod(hashed, F.lit(max(1, -(-n // bucket_rows)))))
    counted = items.groupBy("item", "bucket").agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    histogram = {r["item"]: r["n"] for r in counted.groupBy("item").agg(F.sum("n").alias("n")).collect()}
    # short pieces: how many of a length make a bundle, and the first bundle among the items of one unit
    per, first, bundles = np.ones(half + 2, np.int64), np.zeros(half + 2, np.int64), 0
    for length in range(1, half + 2):
        per[length] = unit // length if length <= half else 1
        first[length] = bundles
        bundles += -(-histogram.get(length, 0) // int(per[length]))
    made = plan({k - half: v for k, v in histogram.items() if k > half + 1} | ({1: bundles} if bundles else {}), capacity // unit)
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("item").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("item", "bucket").orderBy(id_col, "start", "length", "doc_tokens", row))
    ranked = items.withColumn("own", own).join(before, ["item", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    @F.arrow_udf("struct<sequence:long,slot:long>")
    def place(classes: pa.Array, ranks: pa.Array) -> pa.Array:
        item, rank = classes.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        short = np.minimum(item, half + 1)
        sequence, slot = made.place(np.maximum(item - half, 1), first[short] * (item <= half + 1) + rank // per[short])
        slot = slot * unit + rank % per[short]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(slot)], names=["sequence", "slot"])

    placed = ranked.withColumn("place", place("item", "rank")).withColumn("sequence_id", F.col("place.sequence")).withColumn("slot", F.col("place.slot"))
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).select(*[F.col(f"`{c}`") for c in columns], "sequence_id", "offset")
