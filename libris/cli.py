"""Command line: ``python -m libris.cli --library FOLDER COMMAND ...``"""

from __future__ import annotations

import argparse
import sys
import urllib.error
import urllib.request
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from libris import report
from libris.plans.library import Library
from libris.schema import DEFAULT_PRIORITY


def session() -> SparkSession:
    return SparkSession.builder.appName("libris").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def get(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=30) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="libris")
    p.add_argument("--library", default=str(Path.home() / ".local/share/libris"))
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("scan").add_argument("path")
    commands.add_parser("list")
    commands.add_parser("search").add_argument("query")
    commands.add_parser("info").add_argument("id", type=int)
    commands.add_parser("enrich")
    want = commands.add_parser("want").add_subparsers(dest="action", required=True)
    imp = want.add_parser("import").add_subparsers(dest="kind", required=True)
    export = imp.add_parser("goodreads")
    export.add_argument("path")
    export.add_argument("--all-shelves", action="store_true")
    imp.add_parser("openlibrary").add_argument("user")
    imp.add_parser("text").add_argument("path")
    add = want.add_parser("add")
    add.add_argument("title")
    add.add_argument("--author")
    add.add_argument("--isbn")
    add.add_argument("--priority", type=int, default=DEFAULT_PRIORITY)
    add.add_argument("--notes")
    want.add_parser("list").add_argument("--source")
    want.add_parser("enrich")
    want.add_parser("remove").add_argument("id", type=int)
    grab = commands.add_parser("grab")
    grab.add_argument("--output", default="text")
    grab.add_argument("--min-priority", type=int)
    commands.add_parser("stats")
    fol = commands.add_parser("follow").add_subparsers(dest="action", required=True)
    fol.add_parser("add").add_argument("name")
    fol.add_parser("remove").add_argument("name")
    fol.add_parser("list")
    fol.add_parser("sync")
    ser = commands.add_parser("series").add_subparsers(dest="action")
    ser.add_parser("fill")
    ser.add_parser("list").add_argument("--output", default="text")
    return p


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(args: argparse.Namespace, lib: Library) -> tuple[int, str]:
    """Exit code and output of one command."""
    c = args.command
    if c == "scan":
        done = lib.scan(args.path)
        lines = [f"Scanned {done['scanned']} packages, added {done['inserted']}, passed over {done['skipped_non_epub']} other files."]
        return 0, "\n".join([*lines, *(f"{e['source_path']}: {e['error']}" for e in done["errors"])]) + "\n"
    if c == "list":
        return 0, report.listing(_rows(lib.list()), ("id", "title", "authors", "isbn"))
    if c == "search":
        found = _rows(lib.search(args.query))
        return 0, "".join(f"{r['score']:.2f}  {r['title'] or '(none)'}  {r['authors'] or '(none)'}\n" for r in found) or "No matches.\n"
    if c == "info":
        row = lib.info(args.id)
        return (0, report.details(row)) if row else (1, f"No edition {args.id}.\n")
    if c == "enrich":
        return 0, "".join(f"{k}: {n}\n" for k, n in sorted(lib.enrich().items()))
    if c == "want":
        if args.action == "import":
            done = {"goodreads": lambda: lib.import_export(args.path, args.all_shelves), "openlibrary": lambda: lib.import_reading_list(args.user), "text": lambda: lib.import_text(args.path)}[args.kind]()
            return 0, f"Imported {done['imported']}, owned already {done['skipped_owned']}, skipped {done['skipped_rows']}.\n"
        if args.action == "add":
            said = {"inserted": "Added.", "skipped_owned": "Owned already.", "updated": "On the want list already."}
            return 0, said[lib.add_want(args.title, args.author, args.isbn, args.priority, args.notes)] + "\n"
        if args.action == "list":
            return 0, report.listing(_rows(lib.list_wants(args.source)), ("id", "priority", "title", "author", "isbn13", "source"))
        if args.action == "enrich":
            found, eligible = lib.enrich_wants()
            return 0, f"Found {found} of {eligible}.\n"
        return (0, "Removed.\n") if lib.remove_want(args.id) else (1, f"No want {args.id}.\n")
    if c == "grab":
        form = report.check_format(args.output)
        rows = _rows(lib.grab(args.min_priority))
        if rows or form != "text":
            return 0, report.grab(rows, form)
        return 0, "Want list is empty.\n" if lib.wants.isEmpty() else "All wanted books are already owned.\n"
    if c == "stats":
        return 0, report.details(_rows(lib.stats())[0])
    if c == "follow":
        if args.action == "add":
            status, done = lib.follow(args.name)
            said = {"added": f"Following; queued {done['imported']}.", "duplicate": "Followed already.", "not_found": "No such author."}
            return int(status == "not_found"), said[status] + "\n"
        if args.action == "remove":
            return (0, "Removed.\n") if lib.unfollow(args.name) else (1, "Not followed.\n")
        if args.action == "sync":
            return 0, f"Queued {lib.sync()['imported']}.\n"
        return 0, report.listing(_rows(lib.list_authors()), ("name", "ol_key", "last_synced"))
    if args.action == "fill":
        return 0, f"Queued {lib.fill_series()['imported']}.\n"
    return 0, report.series(_rows(lib.series()), getattr(args, "output", "text"))


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        code, out = run(args, Library(session(), args.library, get))
    except (ValueError, OSError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    sys.stdout.write(out)
    return code


if __name__ == "__main__":
    sys.exit(main())
