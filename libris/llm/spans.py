"""Removal of repeated spans: what line dedup and substring dedup share.

A *segmenter* cuts a text into pieces that joined give the text again and names
spans of consecutive pieces with a 96-bit digest each.  A span is repeated if a
document with a smaller id has it too, or if it occurs earlier in its own
document.  The pieces that any repeated span covers are removed.

Plan: spans -> (digest, id) -> smallest id of each digest (partial sums before
the shuffle) -> join back on the digest, where a hot digest is an ordinary skewed
join -> marks by document and text -> one join with the documents.  No group of
equal spans is ever gathered; the marks of a row are no more than its text's spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from libris.llm.common import OWN, slices, without


@dataclass(frozen=True)
class Segments:
    """A text's pieces, as the byte at which each begins and the text's end, and its spans: first piece, last piece, digest."""

    cuts: list[int]
    first: list[int]
    last: list[int]
    keys: list[bytes]

    def __len__(self) -> int:
        return len(self.cuts) - 1


#: A text in UTF-8 -> its segments.
Segmenter = Callable[[bytes], Segments]

_SPANS = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("id", pa.int64()), ("own", pa.int64()), ("place", pa.int64())])
#: place = first piece << SHIFT | pieces after it
SHIFT = 24
_TURN = 0x2545F491


def digests(normal: Iterable[bytes]) -> list[bytes]:
    """The first 12 bytes of XXH3's 128 bits of each normal form."""
    return [x[:12] for x in map(xxhash.xxh3_128_digest, normal)]


def line_cuts(pieces: list[bytes]) -> list[int]:
    """Where pieces that are given with their separators begin, and the end."""
    return list(accumulate(map(len, pieces), initial=0))


def local_spans(found: Segments) -> tuple[dict[bytes, int], list[tuple[int, int]]]:
    """A text's spans at their first places, and the places of their repeats."""
    first: dict[bytes, int] = {}
    again = []
    for a, b, key in zip(found.first, found.last, found.keys, strict=True):
        place = a << SHIFT | (b - a)
        if first.setdefault(key, place) != place:
            again.append((a, b))
    return first, again


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _emit(segment: Segmenter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.dtype([("k1", "<i8"), ("k2", "<i4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            keys: list[bytes] = []
            places: list[int] = []
            counts = []
            for raw in _raw(batch.column("text")):
                first, _ = local_spans(segment(raw))
                keys += first.keys()
                places += first.values()
                counts.append(len(first))
            if keys:
                k = np.frombuffer(b"".join(keys), kind)
                ids, own = (pa.array(np.repeat(batch.column(x).to_numpy(zero_copy_only=False), counts), pa.int64()) for x in ("id", "own"))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k["k1"])), pa.array(np.ascontiguousarray(k["k2"])), ids, own, pa.array(places, pa.int64())], schema=_SPANS)

    return run


def clean(raw: bytes, segment: Segmenter, marks: Iterable[int]) -> tuple[bytes, int, int]:
    """The text without the spans at the marked places and its own repeats; its pieces; the pieces removed."""
    found = segment(raw)
    covered = local_spans(found)[1] + [(p >> SHIFT, (p >> SHIFT) + (p & (1 << SHIFT) - 1)) for p in marks]
    if not covered:
        return raw, len(found), 0
    edge = np.zeros(len(found) + 1, np.int64)
    at = np.array(covered)
    np.add.at(edge, at[:, 0], 1)
    np.add.at(edge, at[:, 1] + 1, -1)
    keep = np.cumsum(edge)[:-1] == 0
    cuts = found.cuts
    return b"".join([raw[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(keep).tolist()]), len(found), int((~keep).sum())


def remove_repeats(docs: DataFrame, segment: Segmenter, id_col: str, text_col: str, n_pieces: str, n_removed: str) -> DataFrame:
    """``docs`` with repeated spans taken out of ``text_col`` and two counts added.

    Order of occurrence is the id, then the place in the text.  Rows whose id is
    null are kept as they are and hide no other occurrence; rows that share an id
    count as one document, so a span that two of them hold stays in both.  A null
    text stays null with counts 0.  Input columns named like the two counts are
    replaced.  Every other column is kept.
    """
    docs = without(docs, n_pieces, n_removed)
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    spans = (
        docs.select(ident.alias("id"), F.xxhash64(text).alias("own"), text.alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(_emit(segment), "k1 long, k2 int, id long, own long, place long")
    )
    first = spans.groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    # the key is changed on both sides: the join then deals the spans itself, and a hot
    # digest is a skewed partition that adaptive execution splits
    turned = F.col("k1").bitwiseXOR(F.lit(_TURN).cast("long"))
    marks = (
        spans.select(turned.alias("key"), "k2", "id", "own", "place")
        .join(first.select(turned.alias("key"), "k2", "lo"), ["key", "k2"])
        .where("id > lo")
        # a set: rows of one id and one text have the same places
        .groupBy(F.col("id").alias(f"{OWN}id"), F.col("own").alias(f"{OWN}own"))
        .agg(F.collect_set("place").alias(f"{OWN}marks"))
    )
    marked = docs.join(marks, (ident == F.col(f"{OWN}id")) & (F.xxhash64(text) == F.col(f"{OWN}own")), "left").drop(f"{OWN}id", f"{OWN}own")
    schema = T.StructType([*docs.schema.fields, T.StructField(n_pieces, T.LongType()), T.StructField(n_removed, T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            texts, counts, removed = [], [], []
            all_marks = batch.column(batch.num_columns - 1).to_pylist()
            for raw, has_id, places in zip(_raw(batch.column(text_col)), batch.column(id_col).is_valid().to_pylist(), all_marks, strict=True):
                if raw is None:
                    out: tuple[bytes | None, int, int] = (None, 0, 0)
                elif has_id:
                    out = clean(raw, segment, places or ())
                else:
                    out = (raw, len(segment(raw)), 0)
                texts.append(out[0])
                counts.append(out[1])
                removed.append(out[2])
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])}
            if any(removed):
                columns[text_col] = pa.array(texts, pa.binary()).cast(batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, n_pieces, n_removed])

    return marked.mapInArrow(apply, schema)
