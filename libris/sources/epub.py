"""E-book packages: ZIP -> container -> package document -> one row."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from libris.functions.text import blank_to_null, normalize_isbn
from libris.schema import PACKAGE_FIELDS

_SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in PACKAGE_FIELDS], T.StructField("source_path", T.StringType()), T.StructField("error", T.StringType())])
_CONTAINER = "META-INF/container.xml"
#: Elements whose last text counts.
_LAST = {"dc:title": "title", "dc:publisher": "publisher", "dc:date": "publish_date", "dc:language": "language", "dc:description": "description"}


def normal_isbn(text: str) -> str:
    return re.sub("[^0-9Xx]", "", text).upper()


def isbn_like(text: str) -> bool:
    return len(re.sub("[^0-9]", "", text)) in (10, 13)


class _Reader:
    """Calls back for each element with its attributes and the first run of text after its start tag."""

    def __init__(self, data: bytes):
        self.data = data
        self.open: list[tuple[str, dict[str, str]]] = []
        self.pending: list[str] | None = None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        """An element begins."""

    def text(self, name: str, attributes: dict[str, str], text: str) -> None:
        """An element's first text, trimmed and not empty."""

    def _flush(self) -> None:
        if self.pending is not None and self.open:
            text = "".join(self.pending).strip()
            if text:
                self.text(*self.open[-1], text)
        self.pending = None

    def run(self) -> None:
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.UseForeignDTD(True)  # an undefined entity then is skipped, not fatal

        def begin(name: str, attributes: dict[str, str]) -> None:
            self._flush()
            self.open.append((name, attributes))
            self.pending = []
            self.start(name, attributes)

        def end(_: str) -> None:
            self._flush()
            self.open.pop()

        def characters(text: str) -> None:
            if self.pending is not None:
                self.pending.append(text)

        def skipped(_: str, __: bool) -> None:
            self.pending = None  # text that can't be resolved counts as empty

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.SkippedEntityHandler = begin, end, characters, skipped
        parser.Parse(self.data, True)


class _Container(_Reader):
    found: str | None = None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if self.found is None and name.rpartition(":")[2] == "rootfile" and "full-path" in attributes:
            self.found = attributes["full-path"]


class _Package(_Reader):
    def __init__(self, data: bytes):
        super().__init__(data)
        self.fields: dict[str, str] = {}
        self.creators: list[str] = []
        self.cover_id: str | None = None
        self.cover_by_id: str | None = None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name.rpartition(":")[2] == "meta":
            content = attributes.get("content")
            kind = attributes.get("name")
            if content is not None and kind == "calibre:series":
                self.fields["series_name"] = content
            elif content is not None and kind == "calibre:series_index":
                self.fields["series_position"] = content
            elif content is not None and kind == "cover":
                self.cover_id = content
        elif name.rpartition(":")[2] == "item" and "href" in attributes:
            if "cover-image" in attributes.get("properties", "").split():
                self.fields["cover_image_path"] = attributes["href"]
            elif self.cover_id is not None and attributes.get("id") == self.cover_id:
                self.cover_by_id = self.cover_by_id or attributes["href"]

    def text(self, name: str, attributes: dict[str, str], text: str) -> None:
        if name in _LAST:
            self.fields[_LAST[name]] = text
        elif name == "dc:creator":
            self.creators.append(text)
        elif name == "dc:identifier":
            scheme = attributes.get("opf:scheme", attributes.get("scheme", ""))
            if "isbn" not in self.fields and (scheme.lower() == "isbn" or isbn_like(text)):
                self.fields["isbn"] = normal_isbn(text)
        elif name == "meta" and attributes.get("property") == "belongs-to-collection":
            self.fields["series_name"] = text
        elif name == "meta" and attributes.get("property") == "group-position":
            self.fields["series_position"] = text


def parse_package(data: bytes) -> dict[str, str | None]:
    """The fields of one package; ValueError if it can't be read.

    Of title, publisher, date, language and description the last text counts, of
    identifiers the first that is an ISBN by its scheme or its number of digits;
    creators are joined in order.  Series and cover come from either generation of
    metadata.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = set(archive.namelist())
            if _CONTAINER not in names:
                raise ValueError("the container is missing")
            container = _Container(archive.read(_CONTAINER))
            try:
                container.run()
            except expat.ExpatError:
                container.found = None
            if container.found is None:
                raise ValueError("the container names no package document")
            if ".." in container.found:
                raise ValueError("the package document's path leaves the archive")
            if container.found not in names:
                raise ValueError("the package document is missing")
            package = _Package(archive.read(container.found))
    except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as error:
        raise ValueError(f"not a readable archive: {error}") from None
    try:
        package.run()
    except expat.ExpatError as error:
        raise ValueError(f"the package document is not well formed: {error}") from None
    out: dict[str, str | None] = {c: package.fields.get(c) for c in PACKAGE_FIELDS}
    out["authors"] = ", ".join(package.creators) or None
    out["cover_image_path"] = out["cover_image_path"] or package.cover_by_id
    return out


def parse_packages(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, content) as package fields, source_path and error (null where all went well).

    One file is one row, so a task holds a few files at a time whatever the number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    row = {**parse_package(bytes(content)), "error": None}
                except ValueError as error:
                    row = {**dict.fromkeys(PACKAGE_FIELDS), "error": str(error)}
                rows.append({**row, "source_path": path})
            yield pd.DataFrame(rows, columns=_SCHEMA.names).astype(object)

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def write_package(title: str | None, authors: Sequence[str], isbn: str | None = None, series_name: str | None = None, series_position: str | None = None) -> bytes:
    """A package that :func:`parse_package` reads, its texts escaped for XML."""
    quote = lambda x: escape(x, {'"': "&quot;"})
    parts = [f"<dc:title>{escape(title)}</dc:title>"] if title is not None else []
    parts += [f"<dc:creator>{escape(a)}</dc:creator>" for a in authors]
    parts += [f'<dc:identifier opf:scheme="ISBN">{escape(isbn)}</dc:identifier>'] if isbn is not None else []
    series = {"calibre:series": series_name, "calibre:series_index": series_position}
    parts += [f'<meta name="{n}" content="{quote(v)}"/>' for n, v in series.items() if v is not None]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(_CONTAINER, '<?xml version="1.0"?><container><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        archive.writestr("content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata>{"".join(parts)}</metadata></package>')
    return out.getvalue()


def write_packages(rows: DataFrame) -> DataFrame:
    """(path, content): a package for each row (path, title, authors as an array, isbn, series_name, series_position)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [write_package(t, [x for x in a if x is not None] if a is not None else [], i, s, p) for t, a, i, s, p in zip(b["title"], b["authors"], b["isbn"], b["series_name"], b["series_position"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": made})

    return rows.select("path", "title", "authors", "isbn", "series_name", "series_position").mapInPandas(run, "path string, content binary")


def check_folder(folder: str) -> None:
    """Raises unless ``folder`` is a folder of a local file system; other stores are checked by Spark."""
    if "://" not in folder and not os.path.isdir(folder):
        raise NotADirectoryError(folder) if os.path.exists(folder) else FileNotFoundError(folder)


def list_files(folder: str) -> tuple[list[str], int]:
    """Local packages below ``folder`` by name in any case, links not followed, and the number of other files.

    Spark's own listing passes over names that begin with ``.`` or ``_``.
    """
    found, others = [], 0
    for top, _, names in os.walk(folder, followlinks=False):
        for name in names:
            path = os.path.join(top, name)
            if os.path.islink(path) or not os.path.isfile(path):
                continue
            if fnmatch.fnmatch(name.lower(), "*.epub"):
                found.append(os.path.realpath(path))
            else:
                others += 1
    return sorted(found), others


def as_editions(parsed: DataFrame) -> DataFrame:
    """Packages that could be read, as new editions: owned, unlinked, not enriched; an ISBN in normal form or null."""
    none = F.lit(None)
    good = parsed.where(F.col("error").isNull()).drop("error").withColumn("isbn", blank_to_null(normalize_isbn("isbn")))
    return good.withColumns({"work_id": none.cast("long"), "owned": F.lit(1).cast("long"), "enriched_at": none.cast("string"), "enrichment_attempted": F.lit(0).cast("long")})


def scan(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(packages as :func:`parse_packages` gives them, number of other files) of a folder and all below it."""
    check_folder(folder)
    if "://" in folder:
        every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        others = every.select("path").where(~F.lower("path").endswith(".epub")).count()
        return parse_packages(every.where(F.lower("path").endswith(".epub"))), others
    paths, others = list_files(folder)
    if not paths:
        return spark.createDataFrame([], _SCHEMA), others
    files = spark.read.format("binaryFile").load(paths).withColumn("path", F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B"))))
    return parse_packages(files), others
