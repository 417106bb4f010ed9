"""One package after the other: what is read of it, and what is an error."""

import io
import zipfile

import pytest

from libris.sources.epub import parse_package, write_package

HEAD = '<?xml version="1.0" encoding="utf-8"?>'
NAMES = 'xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"'


def container(path="content.opf"):
    return f'{HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{path}" media-type="application/oebps-package+xml"/></rootfiles></container>'


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def read(metadata="", manifest="", path="content.opf", version="2.0", extra=None, lead=""):
    opf = f'{lead}{HEAD}<package version="{version}" {NAMES}><metadata>{metadata}</metadata><manifest>{manifest}</manifest><spine/></package>'
    return parse_package(archive({"META-INF/container.xml": container(path), path: opf, **(extra or {})}))


TITLE, CREATOR = "<dc:title>Dune</dc:title>", "<dc:creator>Frank Herbert</dc:creator>"


@pytest.mark.parametrize(
    ("metadata", "field", "want"),
    [
        (TITLE, "title", "Dune"),
        ("", "title", None),
        ("<dc:title/>", "title", None),
        ("<dc:title></dc:title>", "title", None),
        ("<dc:title> \n\t </dc:title>", "title", None),
        ("<dc:title>  Dune \n</dc:title>", "title", "Dune"),
        ("<dc:title>Война и мир — 戦争と平和</dc:title>", "title", "Война и мир — 戦争と平和"),
        ("<dc:title>Fish &amp; Chips &lt;1&gt; &quot;q&quot; &#233;</dc:title>", "title", 'Fish & Chips <1> "q" é'),
        ("", "authors", None),
        (CREATOR, "authors", "Frank Herbert"),
        (CREATOR + "<dc:creator>Brian Herbert</dc:creator>", "authors", "Frank Herbert, Brian Herbert"),
        ('<dc:creator opf:role="aut">Herbert, Frank</dc:creator><dc:creator>X</dc:creator>', "authors", "Herbert, Frank, X"),
        ("<dc:creator> </dc:creator>" + CREATOR, "authors", "Frank Herbert"),
        ('<dc:identifier opf:scheme="ISBN">0-441-01359-7</dc:identifier>', "isbn", "0441013597"),
        ('<dc:identifier opf:scheme="ISBN">978-0-441-01359-3</dc:identifier>', "isbn", "9780441013593"),
        ('<dc:identifier scheme="ISBN">9780441013593</dc:identifier>', "isbn", "9780441013593"),
        ('<dc:identifier opf:scheme="isbn">080442957x</dc:identifier>', "isbn", "080442957X"),
        ("<dc:identifier>urn:isbn:9780441013593</dc:identifier>", "isbn", "9780441013593"),
        ("<dc:identifier>urn:uuid:12345678-aaaa-bbbb-cccc-1234567890ab</dc:identifier>", "isbn", None),
        ('<dc:identifier>abc</dc:identifier><dc:identifier opf:scheme="ISBN">9780441013593</dc:identifier><dc:identifier opf:scheme="ISBN">9780441013000</dc:identifier>', "isbn", "9780441013593"),
        ("<dc:publisher>Ace</dc:publisher>", "publisher", "Ace"),
        ("<dc:date>1965</dc:date>", "publish_date", "1965"),
        ("<dc:date>1965-08-01T00:00:00+00:00</dc:date>", "publish_date", "1965-08-01T00:00:00+00:00"),
        ("<dc:language>en-US</dc:language>", "language", "en-US"),
        ("<dc:language>jpn</dc:language>", "language", "jpn"),
        (f"<dc:description>{'x' * 200_000}</dc:description>", "description", "x" * 200_000),
        ('<meta name="calibre:series" content="Dune"/><meta name="calibre:series_index" content="1.5"/>', "series_position", "1.5"),
        ('<meta name="calibre:series" content="Dune"/><meta name="calibre:series_index" content="3.0"/>', "series_position", "3.0"),
        ('<meta name="calibre:series" content="Tom &amp; Co"/>', "series_name", "Tom & Co"),
        ('<meta property="belongs-to-collection" id="c">Dune</meta><meta refines="#c" property="group-position">2</meta>', "series_name", "Dune"),
        ('<meta property="belongs-to-collection" id="c">Dune</meta><meta refines="#c" property="group-position">2</meta>', "series_position", "2"),
    ],
)
def test_fields(metadata, field, want):
    assert read(metadata)[field] == want


@pytest.mark.parametrize("path", ["content.opf", "OEBPS/content.opf", "a/b/c/package.opf"])
def test_package_documents_anywhere(path):
    got = read(TITLE + CREATOR, path=path, extra={"OEBPS/ch1.xhtml": "<html/>", "OEBPS/css/a.css": "x", "mimetype": "application/epub+zip"})
    assert (got["title"], got["authors"]) == ("Dune", "Frank Herbert")


def test_covers():
    item = '<item id="c1" href="img/cover.jpg" media-type="image/jpeg"/>'
    assert read('<meta name="cover" content="c1"/>', item)["cover_image_path"] == "img/cover.jpg"
    assert read("", '<item id="x" href="cover.png" properties="cover-image"/>', version="3.0")["cover_image_path"] == "cover.png"
    assert read(TITLE, item)["cover_image_path"] is None
    # the metadata comes first; a cover named after the manifest isn't looked for
    opf = f'{HEAD}<package {NAMES}><manifest>{item}</manifest><metadata><meta name="cover" content="c1"/></metadata></package>'
    assert parse_package(archive({"META-INF/container.xml": container(), "content.opf": opf}))["cover_image_path"] is None


def test_byte_order_mark():
    assert read(TITLE, lead="﻿")["title"] == "Dune"


@pytest.mark.parametrize(
    "data",
    [
        b"",
        b"PK\x03\x04 cut short",
        b"plain text",
        archive({"readme.txt": "no book"}),
        archive({"META-INF/container.xml": container("lost.opf")}),
        archive({"META-INF/container.xml": "<container><rootfiles>", "content.opf": "<package/>"}),
        archive({"META-INF/container.xml": "<container/>", "content.opf": "<package/>"}),
        archive({"META-INF/container.xml": container(), "content.opf": "<package><metadata></package>"}),
        archive({"META-INF/container.xml": container("../content.opf"), "../content.opf": "<package/>"}),
        write_package("Dune", ["Frank Herbert"])[:-30],
    ],
)
def test_errors(data):
    with pytest.raises(ValueError):
        parse_package(data)
