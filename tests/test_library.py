import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from libris import cli, report
from libris.operators import ownership, series
from libris.plans.library import Library
from libris.schema import EDITIONS, WANTS, check_priority, check_source, validated_wants
from libris.sources import epub, http
from libris.streaming.rescan import watch

CONTAINER = '<?xml version="1.0"?><container><rootfiles><rootfile full-path="{}" media-type="application/oebps-package+xml"/></rootfiles></container>'
NOW = "2024-05-01T00:00:00Z"


def package(metadata="", manifest="", path="content.opf", raw=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER.format(path))
        z.writestr(path, raw or f'<?xml version="1.0"?><package xmlns:dc="d" xmlns:opf="o"><metadata>{metadata}</metadata><manifest>{manifest}</manifest></package>')
    return out.getvalue()


def book(title, author, isbn=None, series_name=None, position=None):
    m = f"<dc:title>{title}</dc:title><dc:creator>{author}</dc:creator>"
    m += f'<dc:identifier opf:scheme="ISBN">{isbn}</dc:identifier>' if isbn else ""
    m += f'<meta name="calibre:series" content="{series_name}"/><meta name="calibre:series_index" content="{position}"/>' if series_name else ""
    return package(m)


def test_package_fields():
    got = epub.parse_package(
        package(
            "<dc:title>First</dc:title><dc:title> Tom &amp; Jerry </dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:identifier>uuid-x</dc:identifier>"
            "<dc:identifier>urn:isbn:978-0-441-01359-3</dc:identifier><dc:publisher> </dc:publisher><meta property='belongs-to-collection'>S</meta><meta property='group-position'>2</meta><meta name='cover' content='c'/>",
            "<item id='c' href='cover.jpg'/>",
        )
    )
    assert (got["title"], got["authors"], got["isbn"], got["publisher"], got["series_name"], got["series_position"], got["cover_image_path"]) == ("Tom & Jerry", "A, B", "9780441013593", None, "S", "2", "cover.jpg")
    assert epub.parse_package(package("<dc:title>x</dc:title>", "<item properties='nav cover-image' href='a.png'/>", "a/b.opf"))["cover_image_path"] == "a.png"
    assert epub.parse_package(package(raw=b"\xef\xbb\xbf<package xmlns:dc='d'><dc:title>bom</dc:title></package>"))["title"] == "bom"


@pytest.mark.parametrize("data", [b"", b"no zip", package(path="../x.opf"), package(raw="<package><unclosed>")])
def test_damaged_packages(data):
    with pytest.raises(ValueError):
        epub.parse_package(data)


OWNED = [
    ("Dune", "Frank Herbert", "9780441013593", "Dune Chronicles", 1),
    ("The Name of the Wind", "Patrick Rothfuss", "9780756404079", "Kingkiller Chronicle", 1),
    ("The Way of Kings", "Brandon Sanderson", "9780765326355", "The Stormlight Archive", 1),
    ("Project Hail Mary", "Andy Weir", "9780593135204", None, None),
    ("The Lies of Locke Lamora", "Scott Lynch", "9780553588941", "Gentleman Bastard", 1),
]
LISTED = [
    ("Dune", "Frank Herbert", "9780441013593"), ("Dune", "Frank Herbert", "9780441013570"), ("The Name of the Wind", "Patrick Rothfuss", "9780756404079"),
    ("Words of Radiance", "Brandon Sanderson", "9780765326362"), ("The Final Empire", "Brandon Sanderson", "9780765350381"), ("Project Hail Mary", "Andy Weir", "9780593135204"),
    ("The Martian", "Andy Weir", "9780804139021"), ("Red Rising", "Pierce Brown", "9780345539786"), ("The Lies of Locke Lamora", "Scott Lynch", "9780553588958"),
    ("Mistborn: The Final Empire", "Brandon Sanderson", "9780765350381"), ("The Blade Itself", "Joe Abercrombie", "9780316387316"), ("Rhythm of War", "Brandon Sanderson", "9780765326386"),
]


def test_end_to_end(spark, tmp_path):
    books = tmp_path / "books" / "_deep"
    books.mkdir(parents=True)
    for i, b in enumerate(OWNED):
        (books / f"{i}.EPUB").write_bytes(book(*b))
    (books / "bad.epub").write_bytes(b"x")
    (books / "note.txt").write_text("x")
    lib = Library(spark, str(tmp_path / "lib"), clock=lambda: NOW)
    done = lib.scan(str(tmp_path / "books"))
    assert (done["scanned"], done["inserted"], done["skipped_non_epub"], len(done["errors"])) == (6, 5, 1, 1)
    assert lib.scan(str(tmp_path / "books"))["inserted"] == 0
    assert lib.editions.where("work_id is not null").count() == lib.works.count() == 5
    path = tmp_path / "list.csv"
    with path.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Book Id", "Title", "Author", "ISBN", "ISBN13", "Exclusive Shelf"])
        w.writerows([[i, t, a, '=""', f'="{n}"', "to-read"] for i, (t, a, n) in enumerate(LISTED)])
        w.writerow([99, "Other", "Shelf", "", "", "read"])
    assert lib.import_export(str(path)) == {"imported": 7, "skipped_owned": 5, "skipped_rows": 1}
    grabbed = [r.asDict() for r in lib.grab().collect()]
    assert [r["title"] for r in grabbed] == ["Mistborn: The Final Empire", "Red Rising", "Rhythm of War", "The Blade Itself", "The Martian", "Words of Radiance"]
    assert json.loads(report.grab(grabbed, "json"))[0]["title"].startswith("Mistborn")
    assert report.grab(grabbed, "csv").splitlines()[0] == "priority,title,author,isbn13,source,notes" and report.grab([], "text") == ""
    assert lib.stats().first()["grab_count"] == 6 and lib.stats().first()["want_goodreads_csv"] == 6
    assert [r.title for r in lib.search("Hobitt").collect()] == [] and lib.search("Dnue").first().title == "Dune"
    code, out = cli.run(cli.parser().parse_args(["series"]), lib)
    assert code == 0 and "Series: Dune Chronicles\n  1 [owned]" in out
    assert cli.run(cli.parser().parse_args(["want", "add", "Dune", "--author", "Frank Herbert"]), lib) == (0, "Owned already.\n")
    assert lib.add_want("New One", None, "978-0-00-000000-2", 9) == "inserted" and lib.find_want("978-0000000002").count() == 1
    assert lib.add_want("new one") == "updated" and lib.list_wants("manual").first()["isbn13"] == "9780000000002"
    assert lib.remove_want(lib.list_wants("manual").first()["id"]) and not lib.remove_want(12345)
    text = tmp_path / "list.txt"
    text.write_text("# comment\n\n1. Emma by Jane Austen\nEmma by Jane Austen\nUlysses\n")
    assert lib.import_text(str(text)) == {"imported": 3, "skipped_owned": 0, "skipped_rows": 0} and lib.list_wants("text_file").count() == 2


def editions(spark, rows):
    base = dict.fromkeys(EDITIONS.names) | {"owned": 1, "enrichment_attempted": 0}
    return spark.createDataFrame([tuple((base | {"id": i, "source_path": f"/{i}"} | r)[c] for c in EDITIONS.names) for i, r in enumerate(rows, 1)], EDITIONS)


def wants(spark, rows):
    base = dict.fromkeys(WANTS.names) | {"source": "manual", "added_at": NOW, "priority": 5}
    return spark.createDataFrame([tuple((base | {"id": i} | r)[c] for c in WANTS.names) for i, r in enumerate(rows, 1)], WANTS)


def test_two_ways_of_work_ownership(spark):
    e = editions(spark, [{"title": "Aaa", "authors": "Xxx", "isbn": "1", "work_id": 7, "owned": 0}, {"title": "Zzz", "authors": "Qqq", "isbn": "2", "work_id": 7}, {"title": "Kkk", "authors": "Lll", "isbn": "3-3", "work_id": 8}])
    w = wants(spark, [{"title": "Mmm", "author": "Nnn", "isbn13": "1"}, {"title": "Ooo", "author": "Ppp", "isbn13": "33"}])
    assert [r.id for r in ownership.owned_by_work_on_import(w, e).collect()] == [1]
    assert [r.id for r in ownership.owned_by_work_on_grab(w, e).collect()] == [2]
    assert [r.title for r in ownership.grab_list(w, e).collect()] == ["Mmm"]


@pytest.mark.parametrize(
    ("positions", "expected", "non_numeric"),
    [
        (["1", "3"], [("1", True), ("2", False), ("3", True)], False),
        (["1"], [("1", True)], False),
        (["1.0", "2.6"], [("1", True), ("2.6", True)], False),
        (["1", "2.5"], [("1", True), ("2.5", True)], False),
        (["1.5", "3.5"], [("1.5", True), ("2", False), ("3.5", True)], False),
        (["Book Two", "Book One"], [("Book One", True), ("Book Two", True)], True),
        ([None, None], [], True),
        (["1", "1", None], [("1", True), ("1", True)], False),
        (["nan", "2"], [("2", True), ("nan", True)], True),
    ],
)
def test_series(spark, positions, expected, non_numeric):
    view = series.series_views(editions(spark, [{"series_name": "S", "series_position": p} for p in positions])).first()
    assert ([(e.position, e.owned) for e in view.entries], view.non_numeric) == (expected, non_numeric)


def test_validation(spark):
    with pytest.raises(ValueError):
        check_source("nowhere")
    with pytest.raises(ValueError):
        check_priority(11)
    with pytest.raises(Exception, match="unknown source"):
        validated_wants(wants(spark, [{"title": "x", "source": "nowhere"}])).collect()


ANSWERS = {
    "https://c/api/books?bibkeys=ISBN:111&format=json&jscmd=data": (200, json.dumps({"ISBN:111": {"title": "T", "publishers": [{"name": "P"}], "description": {"value": "D"}, "works": [{"key": "/works/1"}]}})),
    "https://c/api/books?bibkeys=ISBN:222&format=json&jscmd=data": (200, "{}"),
    "https://v/books/v1/volumes?q=isbn:222": (200, json.dumps({"totalItems": 1, "items": [{"volumeInfo": {"authors": ["A", "B"], "industryIdentifiers": [{"type": "ISBN_10", "identifier": "x"}, {"type": "ISBN_13", "identifier": "9780000000002"}]}}]})),
    "https://c/api/books?bibkeys=ISBN:333&format=json&jscmd=data": (200, "{}"),
    "https://v/books/v1/volumes?q=isbn:333": (200, '{"totalItems": 0}'),
    "https://c/search.json?title=Lost&author=Me%20Too": (200, json.dumps({"docs": [{"isbn": ["12", "9780000000444"]}]})),
    "https://c/search/authors.json?q=Ann": (200, json.dumps({"docs": [{"key": "OL1A"}]})),
    "https://c/authors/OL1A/works.json?limit=50&offset=0": (200, json.dumps({"entries": [{"title": "One", "key": "/w/1"}, {"key": "/w/2"}]})),
    "https://c/authors/OL1A/works.json?limit=50&offset=50": (200, '{"entries": []}'),
    "https://c/people/me/books/want-to-read.json?page=1": (200, json.dumps({"numFound": 2, "reading_log_entries": [{"work": {"title": "R", "key": "/w/r", "author_names": ["X"]}}]})),
    "https://c/people/me/books/want-to-read.json?page=2": (200, json.dumps({"numFound": 2, "reading_log_entries": [{"work": {"title": "Q", "key": "/w/q", "author_names": []}}]})),
    "https://c/search.json?q=Saga&fields=title,author_name,isbn,series,series_number,key&limit=50": (200, json.dumps({"docs": [{"title": "Saga 2", "author_name": ["Z"], "isbn": ["9-1"], "series": ["The SAGA"]}, {"title": "No", "series": []}]})),
}


def answer(url):
    return ANSWERS.get(url, (500, ""))


def test_services(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), answer, "https://c", "https://v", clock=lambda: NOW)
    lib.store.commit({"editions": editions(spark, [
        {"isbn": "111", "work_id": 2}, {"isbn": "222", "title": "Kept"}, {"isbn": "333"}, {"isbn": "555"}, {"title": "Lost", "authors": "Me Too"}, {"title": "Nobody"},
        {"series_name": "Saga", "series_position": "1", "enrichment_attempted": 1},
    ]), "works": spark.createDataFrame([(1, "t", "a", "/works/1", NOW), (2, "t", "a", None, NOW)], lib.works.schema)})
    assert lib.enrich() == {"enriched": 2, "unknown": 1, "failed": 2, "no_isbn": 1}
    got = {r.id: r for r in lib.editions.collect()}
    assert (got[1].title, got[1].publisher, got[1].description, got[1].work_id, got[1].enriched_at) == ("T", "P", "D", 1, NOW)
    assert (got[2].title, got[2].authors, got[3].enrichment_attempted, got[3].enriched_at, got[4].enrichment_attempted, got[5].isbn) == ("Kept", "A, B", 1, None, 0, "9780000000444")
    assert [r.id for r in lib.works.collect()] == [1]
    assert lib.follow("Ann") == ("added", {"imported": 1, "skipped_owned": 0, "skipped_rows": 0})
    assert lib.follow("ANN")[0] == "duplicate" and not lib.unfollow("ann") and lib.sync()["imported"] == 1 and lib.unfollow("Ann")
    assert lib.import_reading_list("me")["imported"] == 2
    with pytest.raises(http.ServiceError):
        http.reading_list(lambda u: (404, ""), "nobody")
    assert lib.fill_series()["imported"] == 1
    assert lib.list_wants("series_fill").first()["priority"] == 7 and lib.list_wants().count() == 4
    assert lib.add_want("Lost", "Me Too") == "skipped_owned"


def test_watch(spark, tmp_path):
    from libris.store import Store

    books = tmp_path / "books"
    books.mkdir()
    (books / "a.epub").write_bytes(book("A", "B"))
    store = Store(spark, str(tmp_path / "lib"))
    for _ in range(2):
        watch(spark, str(books), store, str(tmp_path / "seen")).awaitTermination()
    assert store.table("editions").count() == 1


def test_watch_links_and_has_no_empty_isbn(spark, tmp_path):
    from libris.store import Store

    books = tmp_path / "books"
    books.mkdir()
    for i, b in enumerate([("A", "B", "n/a"), ("Other Thing", "C", "none"), ("Dune", "Frank Herbert", "9780441013593"), ("Dune", "F. Herbert", "978-0441013593")]):
        (books / f"{i}.epub").write_bytes(book(*b))
    store = Store(spark, str(tmp_path / "lib"))
    watch(spark, str(books), store, str(tmp_path / "seen")).awaitTermination()
    rows = {r.title + r.authors: r for r in store.table("editions").collect()}
    assert rows["AB"].isbn is None and rows["Other ThingC"].isbn is None and rows["AB"].work_id != rows["Other ThingC"].work_id
    assert rows["DuneFrank Herbert"].work_id == rows["DuneF. Herbert"].work_id and store.table("works").count() == 3


def test_written_packages_are_read(spark):
    rows = spark.createDataFrame([("/a", 'x <&> "y"', ["A & B", None], "9780441013593", 'S "1"', "2")], "path string, title string, authors array<string>, isbn string, series_name string, series_position string")
    got = epub.parse_packages(epub.write_packages(rows)).first()
    assert (got.title, got.authors, got.isbn, got.series_name, got.series_position, got.error) == ('x <&> "y"', "A & B", "9780441013593", 'S "1"', "2", None)


def test_paging_that_does_not_end_is_an_error(monkeypatch):
    monkeypatch.setattr(http, "MOST_PAGES", 3)
    more = json.dumps({"numFound": 10**6, "reading_log_entries": [{"work": {"title": "x", "key": "k"}}], "entries": [{"title": "x", "key": "k"}]})
    with pytest.raises(http.ServiceError, match="pages"):
        http.reading_list(lambda u: (200, more), "me")
    with pytest.raises(http.ServiceError, match="pages"):
        http.author_works(lambda u: (200, more), "OL1")


def test_two_empty_answers_of_grab(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), clock=lambda: NOW)
    grab = cli.parser().parse_args(["grab"])
    assert cli.run(grab, lib) == (0, "Want list is empty.\n")
    lib.store.commit({"want_list": wants(spark, [{"title": "Dune", "author": "Frank Herbert"}]), "editions": editions(spark, [{"title": "Dune", "authors": "Frank Herbert"}])})
    assert cli.run(grab, lib) == (0, "All wanted books are already owned.\n")
    assert cli.run(cli.parser().parse_args(["grab", "--output", "json"]), lib) == (0, "[]")


def test_lists_trim_all_white_space(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("\t\n\tDune by Frank Herbert\t\n1. \u00a0Emma\n\u2003# comment\n")
    from libris.sources.lists import read_lines

    assert [(r.title, r.author) for r in read_lines(spark, str(path)).orderBy("line").collect()] == [("Dune", "Frank Herbert"), ("Emma", None)]


def test_one_of_two_writers_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from libris.publish import publish

    for n in range(5):
        with ThreadPoolExecutor(6) as pool:
            done = list(pool.map(lambda k, n=n: publish(spark, f"{tmp_path}/p/{n}", f"writer {k}"), range(6)))
        assert done.count(True) == 1 and (tmp_path / "p" / str(n)).read_text() == f"writer {done.index(True)}"
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if not x.name.endswith(".crc")) == list("01234")


def test_store_is_atomic(spark, tmp_path):
    from libris.store import Store

    store = Store(spark, str(tmp_path / "lib"))
    store.commit({"want_list": wants(spark, [{"title": "x"}])})
    before = store.table("want_list")
    store.commit({"want_list": before.where(F.lit(False))})
    assert before.count() == 1 and store.table("want_list").count() == 0
