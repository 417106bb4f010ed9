"""Substring dedup over sliding runs of sentences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from libris.llm.spans import Segmenter, Segments, digests, remove_repeats

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def sentence_ends(raw: bytes, starts: np.ndarray, ends: np.ndarray, shortest: int, longest: int) -> np.ndarray:
    """The last word of every sentence, of words that lie at these bytes."""
    b = np.frombuffer(raw, np.uint8)
    stops = _STOP[b[ends - 1]]
    if b"\n" in raw:
        feeds = np.flatnonzero(b == 10)
        stops[:-1] |= np.searchsorted(feeds, starts[1:]) > np.searchsorted(feeds, ends[:-1])
    stops[-1] = True
    at = np.flatnonzero(stops)
    whole = np.diff(at, prepend=-1) >= shortest
    whole[-1] = True
    at = at[whole]
    parts = -(-np.diff(at, prepend=-1) // longest)
    left = np.repeat(np.cumsum(parts), parts) - 1 - np.arange(parts.sum())  # parts of the same sentence that follow
    return np.repeat(at, parts) - longest * left


def sentence_runs(sentences: int = 3, shortest: int = 5, longest: int = 12) -> Segmenter:
    """Pieces: sentences with the white space after them.  Spans: every run of ``sentences`` consecutive ones.

    A word is what stands between ASCII white space.  A sentence ends with a word that
    ends in . ! or ?, or before a line feed.  One of under ``shortest`` words ("No. 5", "Is.")
    is the beginning of the next sentence; one of over ``longest`` words is
    several, cut from its end on, the first having the rest.  Both depend on the sentence alone,
    so equal passages are cut alike once their first sentence, fused with
    what stands before it, has ended.  Words are compared, white space isn't.
    """

    def segment(raw: bytes) -> Segments:
        words = raw.split()
        if not words:
            return Segments([0], [], [], [])
        blank = _SPACE[np.frombuffer(raw, np.uint8)]
        change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        edges = np.r_[[] if blank[0] else [0], change, [] if blank[-1] else [len(raw)]].astype(np.int64)
        starts, ends = edges[::2], edges[1::2]
        last = sentence_ends(raw, starts, ends, shortest, longest)
        first = np.r_[0, last[:-1] + 1]
        cuts = [0, *starts[first[1:]].tolist(), len(raw)]
        n = len(last) - sentences + 1
        if n < 1:
            return Segments(cuts, [], [], [])
        normal = b" ".join(words)
        size = ends - starts
        stop = np.cumsum(size + 1) - 1
        runs = zip((stop - size)[first[:n]].tolist(), stop[last[sentences - 1 :]].tolist(), strict=True)
        return Segments(cuts, list(range(n)), list(range(sentences - 1, len(last))), digests([normal[a:z] for a, z in runs]))

    return segment


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3, shortest: int = 5, longest: int = 12) -> DataFrame:
    """``docs`` without the sentences that a repeated run of sentences covers.

    Every run of ``sentences`` consecutive sentences (see :func:`sentence_runs`) is hashed.
    Of equal runs the first in order of (id, place) stays; the sentences of every later one go,
    with the white space after them.  A passage of over 50 words that ends with a sentence is
    found wherever it starts: under ``shortest`` words at its end and under ``longest`` at its start
    can belong to sentences of the text around it, and what is between holds a run; only where
    most of its sentences are shorter than ``shortest`` can it be missed.  Texts too short
    for a run stay.  Adds ``n_sentences`` (of the text as it was, 0 if it has no word) and ``n_removed``;
    for nulls, repeated ids and clashing names see :func:`libris.llm.spans.remove_repeats`.
    """
    return remove_repeats(docs, sentence_runs(sentences, shortest, longest), id_col, text_col, "n_sentences", "n_removed")
