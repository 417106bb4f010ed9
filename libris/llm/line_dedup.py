"""Line dedup over overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from libris.llm.spans import Segmenter, Segments, digests, line_cuts, remove_repeats

#: White space that doesn't count at a line's ends.
EDGE = b" \t\r\f\v"


def line_windows(width: int = 3) -> Segmenter:
    """Pieces: lines with their line feeds.  Spans: every ``width`` consecutive lines that aren't blank."""

    def segment(raw: bytes) -> Segments:
        pieces = raw.split(b"\n")
        bare = [x.strip(EDGE) for x in pieces]
        at = [i for i, x in enumerate(bare) if x]
        full = [bare[i] for i in at]
        spans = digests(map(b"\n".join, zip(*(full[k:] for k in range(width)), strict=False)))
        return Segments(line_cuts([x + b"\n" for x in pieces[:-1]] + pieces[-1:]), at[: len(spans)], at[width - 1 :], spans)

    return segment


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` without lines that a repeated window of ``width`` lines covers.

    A window is ``width`` consecutive lines, blank ones passed over; lines are
    compared without white space at their ends.  Of equal windows the first in
    order of (id, place) stays and every later one covers its lines, blank lines
    between them included; covered lines are removed.  A line survives at least
    once: the first occurrence of a window loses a line only to a still earlier
    window that holds it.  Texts of fewer lines have no window and stay.  Adds
    ``n_lines`` (of the text as it was) and ``n_removed``; for nulls, repeated
    ids and clashing names see :func:`libris.llm.spans.remove_repeats`.
    """
    return remove_repeats(docs, line_windows(width), id_col, text_col, "n_lines", "n_removed")
