"""Jaro-Winkler similarity of titles and authors, and joins by it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The same work from this score on, a search hit from that on.
SAME_WORK = 0.85
SEARCH_HIT = 0.72
#: Authors must be closer than this for titles alone to count.
SAME_AUTHOR = 0.9
_BLOCK = 8192
#: Strings of either side whose bounds are computed at once.
_TILE = 1024


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points by row, from 1 on and padded with 0, and the lengths."""
    n = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out = np.zeros((len(texts), max(1, int(n.max(initial=0)))), np.uint8 if flat.max(initial=0) < 255 else np.int32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat + 1
    return out, n


def _jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    a, la = _codes(left)
    b, lb = _codes(right)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    widest = int(window.max(initial=0))
    free = b != 0
    hit = np.zeros(a.shape, bool)
    place = np.arange(b.shape[1])
    rows = np.arange(len(left))
    for i in range(a.shape[1]):
        lo, hi = max(0, i - widest), min(b.shape[1], i + widest + 1)
        if lo >= hi:
            break
        near = (b[:, lo:hi] == a[:, i : i + 1]) & free[:, lo:hi]
        near &= np.abs(place[lo:hi] - i)[None, :] <= window[:, None]
        j = near.argmax(axis=1)
        found = near[rows, j]
        hit[:, i] = found
        free[rows[found], lo + j[found]] = False
    taken = (b != 0) & ~free
    m = hit.sum(axis=1)
    most = int(m.max(initial=0))
    in_a = np.take_along_axis(a, np.argsort(~hit, axis=1, kind="stable")[:, :most], axis=1)
    in_b = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable")[:, :most], axis=1)
    moved = ((in_a != in_b) & (np.arange(most)[None, :] < m[:, None])).sum(axis=1) // 2
    safe = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / safe) / 3, 0.0)
    jaro = np.where((la == 0) & (lb == 0), 1.0, jaro)
    w = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod((a[:, :w] == b[:, :w]) & (a[:, :w] != 0), axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of many pairs, by characters: scale 0.1, at most four of a common prefix, boosted above 0.7 only.

    Two empty strings are equal (1), one empty string is like nothing (0).
    """
    out = np.empty(len(left))
    order = sorted(range(len(left)), key=lambda i: (max(len(left[i]), len(right[i]))))  # rows of a block are padded to its longest
    for s in range(0, len(order), _BLOCK):
        at = order[s : s + _BLOCK]
        out[at] = _jaro_winkler([left[i] for i in at], [right[i] for i in at])
    return out


def similarity(title_a: list[str], author_a: list[str], title_b: list[str], author_b: list[str]) -> np.ndarray:
    """The larger of the similarity of "title author" and, where authors are over 0.9 alike, of the titles."""
    joint = jaro_winkler([f"{t} {a}" for t, a in zip(title_a, author_a, strict=True)], [f"{t} {a}" for t, a in zip(title_b, author_b, strict=True)])
    alike = np.flatnonzero(jaro_winkler(author_a, author_b) > SAME_AUTHOR).tolist()
    if alike:
        joint[alike] = np.maximum(joint[alike], jaro_winkler([title_a[i] for i in alike], [title_b[i] for i in alike]))
    return joint


def search_scores(titles: list[str], authors: list[str], query: str) -> np.ndarray:
    """The best of: title, author, "title author" and any word of the title against the query."""
    q = [query] * len(titles)
    best = np.maximum(np.maximum(jaro_winkler(titles, q), jaro_winkler(authors, q)), jaro_winkler([f"{t} {a}" for t, a in zip(titles, authors, strict=True)], q))
    words = [t.split() for t in titles]
    flat = [w for x in words for w in x]
    if flat:
        rows = np.repeat(np.arange(len(titles)), [len(x) for x in words])
        np.maximum.at(best, rows, jaro_winkler(flat, [query] * len(flat)))
    return best


def _texts(x: pa.Array) -> list[str]:
    return [v or "" for v in x.to_pylist()]


def _scored(score: Callable[..., np.ndarray], *columns: Column | str) -> Column:
    """A column of scores, computed by batches; nulls count as empty."""

    # an Arrow function can only be made where there is a session
    @F.arrow_udf("double")
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array(score(*map(_texts, arrays)), pa.float64())

    return run(*columns)


def jaro_winkler_score(a: Column | str, b: Column | str) -> Column:
    return _scored(jaro_winkler, a, b)


def book_similarity(title_a: Column | str, author_a: Column | str, title_b: Column | str, author_b: Column | str) -> Column:
    return _scored(similarity, title_a, author_a, title_b, author_b)


def search_score(title: Column | str, author: Column | str, query: str) -> Column:
    return _scored(lambda t, a: search_scores(t, a, query), title, author)


class _Strings:
    """Distinct strings, prepared for upper bounds of their similarity."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        codes, self.length = _codes(texts)
        codes = codes.astype(np.int64)
        head = np.zeros((len(texts), 4), np.int64)
        head[:, : codes.shape[1]] = codes[:, :4]
        self.head = head
        # a token is a character with the number of its occurrence, so that common tokens are common characters
        order = np.sort(codes, axis=1)
        place = np.arange(order.shape[1])
        begins = np.ones(order.shape, bool)
        begins[:, 1:] = order[:, 1:] != order[:, :-1]
        nth = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
        self.row, at = np.nonzero(order)
        self.token = (order[self.row, at] << 32) + nth[self.row, at]

    def only(self, vocabulary: np.ndarray) -> None:
        """Forgets other tokens and numbers these."""
        known = np.isin(self.token, vocabulary)
        self.row, self.token = self.row[known], np.searchsorted(vocabulary, self.token[known])

    def matrix(self, start: int, stop: int, tokens: int) -> np.ndarray:
        """1 where a string has a token, else 0."""
        a, z = np.searchsorted(self.row, (start, stop))
        out = np.zeros((stop - start, tokens), np.float32)
        out[self.row[a:z] - start, self.token[a:z]] = 1
        return out


def _near(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs whose Jaro-Winkler similarity is ``least`` or more, by tiles.

    The number of common characters bounds the similarity from above and is a
    product of matrices; only pairs whose bound is high enough are scored.
    """
    a, b = _Strings(left), _Strings(right)
    vocabulary = np.intersect1d(a.token, b.token)
    a.only(vocabulary)
    b.only(vocabulary)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(left), _TILE):
        i_to = min(i + _TILE, len(left))
        rows = a.matrix(i, i_to, len(vocabulary))
        la = np.maximum(a.length[i:i_to], 1)[:, None].astype(np.float32)
        for j in range(0, len(right), _TILE):
            j_to = min(j + _TILE, len(right))
            common = rows @ b.matrix(j, j_to, len(vocabulary)).T
            lb = np.maximum(b.length[j:j_to], 1)[None, :].astype(np.float32)
            jaro = (common / la + common / lb + 1) / 3
            jaro[(a.length[i:i_to] == 0)[:, None] & (b.length[j:j_to] == 0)[None, :]] = 1
            prefix = np.zeros(jaro.shape, np.float32)
            same = np.ones(jaro.shape, bool)
            for k in range(4):
                x, y = a.head[i:i_to, k, None], b.head[None, j:j_to, k]
                same &= (x == y) & (x != 0)
                prefix += same
            x, y = np.nonzero(jaro + 0.1 * prefix * (1 - jaro) >= least - 1e-4)  # single precision
            if len(x):
                found.append((x + i, y + j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    score = jaro_winkler([left[x] for x in i.tolist()], [right[x] for x in j.tolist()])
    keep = score >= least
    return i[keep], j[keep], score[keep]


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct texts and the place of each text among them."""
    place: dict[str, int] = {}
    at = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
    return list(place), at


def near_books(left: tuple[list[str], list[str]], right: tuple[list[str], list[str]], least: float = SAME_WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs of (titles, authors) whose :func:`similarity` is ``least`` or more.

    Distinct titles and distinct authors are compared once each.
    """
    joint = [[f"{t} {a}" for t, a in zip(*side, strict=True)] for side in (left, right)]
    n = len(joint[1])
    i, j, score = _near(joint[0], joint[1], least)
    at, best = [i * n + j], [score]
    (ta, ta_at), (aa, aa_at), (tb, tb_at), (ab, ab_at) = (_numbered(x) for x in (*left, *right))
    x, y, alike = _near(aa, ab, SAME_AUTHOR)
    authors = (x * len(ab) + y)[alike > SAME_AUTHOR]
    if len(authors):
        with_a, with_b = _places(ta_at, len(ta)), _places(tb_at, len(tb))
        for x, y, s in zip(*(v.tolist() for v in _near(ta, tb, least)), strict=True):
            own, other = with_a[x], with_b[y]
            fits = np.isin(aa_at[own][:, None] * len(ab) + ab_at[other][None, :], authors)
            at.append((own[:, None] * n + other[None, :])[fits])
            best.append(np.full(len(at[-1]), s))
    pairs, inverse = np.unique(np.concatenate(at), return_inverse=True)
    out = np.zeros(len(pairs))
    np.maximum.at(out, inverse, np.concatenate(best))
    return pairs // max(n, 1), pairs % max(n, 1), out


def _places(at: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(at, kind="stable")
    return np.split(order, np.cumsum(np.bincount(at, minlength=n))[:-1])


def _size(*lengths: Column) -> Column:
    return F.floor(F.log2(sum(lengths[1:], lengths[0]) + 1)).cast("int")


def _by_cells(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``work`` gives for each cell of distinct rows of both sides, which have a ``size``.

    Rows meet whose sizes (powers of two of their length) are at most two apart. Lengths are
    few, so the rows of one size are dealt to a grid of cells, twice as many as there are cores: each side goes
    to one row, or one column, of the grid.  A pair of rows meets in one cell at most.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    grid = math.ceil(math.sqrt(2 * cores))
    keys = ["size", "row", "column"]

    def dealt(df: DataFrame, own: str, every: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.lit(grid)).cast("int")
        return df.withColumn(own, mine).withColumn(every, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))

    # a number of its own, so that few bytes of keys aren't put together into one task
    near = dealt(left, "row", "column").withColumn("size", F.explode(F.sequence(F.col("size") - 2, F.col("size") + 2))).repartition(2 * cores, *keys)
    return near.groupBy(*keys).cogroup(dealt(right, "column", "row").repartition(2 * cores, *keys).groupBy(*keys)).applyInArrow(work, schema)


def _checked(least: float) -> None:
    if least < SAME_WORK:
        raise ValueError("lengths within a factor of four are only certain from 0.85 on")


def _books(df: DataFrame) -> DataFrame:
    t, a = F.coalesce("title", F.lit("")), F.coalesce("author", F.lit(""))
    distinct = df.select(t.alias("title"), a.alias("author")).distinct()
    return distinct.withColumn("size", _size(F.length("title"), F.length("author")))


def similar_pairs(left: DataFrame, right: DataFrame, least: float = SAME_WORK) -> DataFrame:
    """(left_title, left_author, right_title, right_author, score) for distinct pairs of a score of ``least`` or more.

    Both sides have title and author; nulls count as empty.  No pair is lost: with a
    common prefix of four a score of 0.85 still needs lengths within a factor of
    four, and :func:`near_books` finds all within a cell.
    """
    _checked(least)
    names = ("left_title", "left_author", "right_title", "right_author")

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [(t.column("title").to_pylist(), t.column("author").to_pylist()) for t in (a, b)]
        i, j, score = near_books(*sides, least)
        columns = [pa.array([x[k] for k in at.tolist()], pa.string()) for side, at in zip(sides, (i, j), strict=True) for x in side]
        return pa.table([*columns, pa.array(score, pa.float64())], names=[*names, "score"])

    return _by_cells(_books(left), _books(right), work, ", ".join(f"{x} string" for x in names) + ", score double")


def with_similar(left: DataFrame, right: DataFrame, least: float = SAME_WORK) -> DataFrame:
    """(title, author) of ``left`` that have a partner in :func:`similar_pairs`."""
    _checked(least)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [(t.column("title").to_pylist(), t.column("author").to_pylist()) for t in (a, b)]
        return a.select(["title", "author"]).take(pa.array(np.unique(near_books(*sides, least)[0]), pa.int64()))

    return _by_cells(_books(left), _books(right), work, "title string, author string").distinct()


def near_strings(left: DataFrame, right: DataFrame, least: float = SAME_WORK) -> DataFrame:
    """(left, right, score) for distinct strings of one column each whose Jaro-Winkler similarity is ``least`` or more.

    The same plan as :func:`similar_pairs`, for single strings.
    """
    _checked(least)

    def keys(df: DataFrame) -> DataFrame:
        return df.select(F.coalesce(F.col(df.columns[0]), F.lit("")).alias("x")).distinct().withColumn("size", _size(F.length("x")))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = a.column("x").to_pylist(), b.column("x").to_pylist()
        i, j, score = _near(x, y, least)
        return pa.table([pa.array([x[k] for k in i.tolist()], pa.string()), pa.array([y[k] for k in j.tolist()], pa.string()), pa.array(score, pa.float64())], names=["left", "right", "score"])

    return _by_cells(keys(left), keys(right), work, "left string, right string, score double")
