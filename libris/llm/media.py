"""Media columns: baseline JPEGs in a binary column, their dimensions and thumbnail hashes."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from libris.llm import jpeg
from libris.llm.common import by_parts

_READ = "struct<width:int,height:int,thumbnail_dhash:string,thumbnail_xxh64:string,payload:binary,error:string>"
#: Bytes of images that are decoded together.
_TOGETHER = 1 << 20


def padded(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of 192 bytes; null counts as empty."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % jpeg.UNIT if raw else jpeg.UNIT)


def stored_text(text: str | Column) -> Column:
    """Column of JPEGs, each holding a whole text of a column exactly (see :func:`libris.llm.jpeg.stored`).

    Null counts as the empty text, which is 192 spaces; a text of any length is one image.
    """

    @F.arrow_udf("binary")
    def store(column: pa.Array) -> pa.Array:
        return by_parts(column, pa.binary(), lambda part: pa.array((jpeg.stored(padded(x)) for x in part.to_pylist()), pa.binary(), size=len(part)))

    # called deterministic it would be computed again for every use of the column
    return store.asNondeterministic()(text)


def read_images(images: list[bytes | None]) -> list[tuple]:
    """(width, height, dhash, xxh64, payload, error) of each image; nulls for null, an error for what can't be read."""
    out: list[tuple] = [(None,) * 6] * len(images)
    groups: dict[tuple, list[int]] = defaultdict(list)
    heads: dict[int, jpeg.Header] = {}
    for i, data in enumerate(images):
        if data is None:
            continue
        try:
            heads[i] = jpeg.parse(data)
            # those without restart markers aren't pooled: their segments differ in length
            groups[(heads[i].layout(), heads[i].interval or -i - 1)].append(i)
        except ValueError as error:
            out[i] = (None, None, None, None, None, str(error))

    def read(group: list[int]) -> None:
        try:
            found = jpeg.coefficients([images[i] for i in group], [heads[i] for i in group])
        except ValueError as error:
            if len(group) > 1:  # one damaged image mustn't spoil the others
                for i in group:
                    read([i])
            else:
                out[group[0]] = (None, None, None, None, None, str(error))
            return
        for i, coefs in zip(group, found, strict=True):
            out[i] = (heads[i].width, heads[i].height, *jpeg.hashes(jpeg.thumbnail(heads[i], coefs)), jpeg.payload(heads[i], coefs), None)

    for members in groups.values():
        part: list[int] = []
        size = 0
        for i in members:
            part.append(i)
            size += len(images[i])
            if size >= _TOGETHER:
                read(part)
                part, size = [], 0
        if part:
            read(part)
    return out


def image_features(media: str | Column) -> Column:
    """Column of structs read from a column of baseline JPEGs.

    width and height in pixels; the hashes of a luminance thumbnail that has a
    sample per 8 x 8 block, made of DC coefficients only; the payload of images
    that :func:`stored_text` wrote; error for what is no baseline JPEG of one scan,
    the rest being null then.  Null gives a struct of nulls.
    """

    kinds = {"width": pa.int32(), "height": pa.int32(), "thumbnail_dhash": pa.string(), "thumbnail_xxh64": pa.string(), "payload": pa.binary(), "error": pa.string()}

    def work(part: pa.Array) -> pa.Array:
        rows = read_images(part.to_pylist())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    @F.arrow_udf(_READ)
    def read(column: pa.Array) -> pa.Array:
        return by_parts(column, pa.struct(list(kinds.items())), work)

    return read.asNondeterministic()(media)
