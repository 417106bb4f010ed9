"""Reports of small results as text, JSON and CSV."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns and their order in the grab list's forms.
GRAB_TEXT = ("Priority", "Title", "Author", "ISBN13", "Source")
GRAB_JSON = ("title", "author", "isbn13", "priority", "source", "notes")
GRAB_CSV = ("priority", "title", "author", "isbn13", "source", "notes")
FORMATS = ("text", "json", "csv")


def _csv(header: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue()


def grab_text(rows: Sequence[Mapping]) -> str:
    """An aligned table; nothing for no rows."""
    if not rows:
        return ""
    cells = [["(none)" if r[c.lower()] is None else str(r[c.lower()]) for c in GRAB_TEXT] for r in rows]
    width = [max(len(h), *(len(c[i]) for c in cells)) for i, h in enumerate(GRAB_TEXT)]
    line = lambda c: "  ".join(x.ljust(w) for x, w in zip(c, width, strict=True)).rstrip()
    return "\n".join([line(GRAB_TEXT), line(["-" * w for w in width]), *map(line, cells)]) + "\n"


def grab_json(rows: Sequence[Mapping]) -> str:
    return json.dumps([{c: r[c] for c in GRAB_JSON} for r in rows], indent=2, ensure_ascii=False)


def grab_csv(rows: Sequence[Mapping]) -> str:
    return _csv(GRAB_CSV, [[r[c] for c in GRAB_CSV] for r in rows])


def grab(rows: Sequence[Mapping], form: str) -> str:
    return {"text": grab_text, "json": grab_json, "csv": grab_csv}[check_format(form)](rows)


def series_text(views: Sequence[Mapping]) -> str:
    if not views:
        return "No series found in library.\n"
    out = []
    for v in views:
        out.append(f"Series: {v['series_name']}" + (" (non-numeric positions)" if v["non_numeric"] else ""))
        out += [f"  {e['position']} {'[owned]' if e['owned'] else '[MISSING]'}" for e in v["entries"]]
    return "\n".join(out) + "\n"


def series_json(views: Sequence[Mapping]) -> str:
    shaped = [{"series_name": v["series_name"], "entries": [{"series_name": e["series_name"], "position": e["position"], "owned": e["owned"]} for e in v["entries"]], "non_numeric": v["non_numeric"]} for v in views]
    return json.dumps(shaped, indent=2, ensure_ascii=False)


def series_csv(views: Sequence[Mapping]) -> str:
    return _csv(("series_name", "position", "owned"), [(e["series_name"], e["position"], int(e["owned"])) for v in views for e in v["entries"]])


def series(views: Sequence[Mapping], form: str) -> str:
    return {"text": series_text, "json": series_json, "csv": series_csv}[check_format(form)](views)


def check_format(form: str) -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown output {form!r}; known are {', '.join(FORMATS)}")
    return form


def details(row: Mapping) -> str:
    """The fields of a row that hold something, one to a line."""
    return "".join(f"{k}: {v}\n" for k, v in row.items() if v is not None)


def listing(rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    return "".join("  ".join("(none)" if r[c] is None else str(r[c]) for c in columns) + "\n" for r in rows)


def csv_line(*columns: str | Column) -> Column:
    """A native column with one CSV line per row: cells quoted where they must be, null as nothing."""

    def cell(c: str | Column) -> Column:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(s.rlike('[",\r\n]'), quoted).otherwise(s), F.lit(""))

    return F.concat_ws(",", *map(cell, columns))
