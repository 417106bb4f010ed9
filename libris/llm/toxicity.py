"""Toxicity by compression distance: zstandard with a toxic and an ordinary dictionary."""

from __future__ import annotations

import functools
import math
import random
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libris.llm.common import Numbered, by_parts, smallest, strings

#: Punctuation that doesn't count at a word's ends.
_EDGE = ".,;:!?|#*%$&\"'()[]{}<>-_"
#: Lengths of word beginnings that stand for inflected forms.
_STEMS = (4, 5)
#: Letters of a word's beginning that are written large, all others being small.
_MARKED = 3
_FOLDS = 3


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries and the calibration.

    A window is compressed with the ordinary dictionary alone and with the toxic
    one put behind it (in the first case as many zero bytes): what both hold compresses alike, at
    the same distance, and the difference of a window's two lengths is what toxic
    content saves.
    """

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    window: int = 8


def marked(text: str) -> list[str]:
    """The text's words in small letters but for their first ones, without punctuation before them.

    So a dictionary's word only matches where a word begins, not the same letters within another.
    """
    return [w[:_MARKED].upper() + w[_MARKED:] for x in text.lower().split() if (w := x.lstrip(_EDGE))]


@functools.lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # without entropy tables a literal costs a byte, and with a minimum match of five
    # bytes chance matches are rare
    params = zstandard.ZstdCompressionParameters.from_level(
        12, source_size=64, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=5, strategy=zstandard.STRATEGY_BTLAZY2
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def savings(text: str, model: Model) -> tuple[int, int, int]:
    """The largest and the summed saving of the text's windows, and their number.

    Every word is in a window.  A window that saves is compared with the two that
    overlap half of it: a toxic word saves in one of them as well, a chance does not.
    """
    words = marked(text)
    step, half = model.window, model.window // 2
    toxic, ordinary = _compressor(model.ordinary + model.toxic).compress, _compressor(model.ordinary + bytes(len(model.toxic))).compress

    def saved(a: int) -> int:
        w = f" {' '.join(words[max(0, a) : max(0, a + step)])} ".encode("utf-8", "surrogatepass")
        return len(ordinary(w)) - len(toxic(w))

    most = total = 0
    for a in range(0, len(words), step):
        if (d := saved(a)) > 0:
            d = min(d, max(saved(a - half), saved(a + half)))
            if d > 0:
                most = max(most, d)
                total += d
    return most, total, -(-len(words) // step)


def features(found: tuple[int, int, int]) -> list[float]:
    most, total, windows = found
    step = lambda a, b: (min(max(most, a), b) - a) / (b - a)
    return [1.0, step(0, 3), step(3, 6), step(6, 12), math.log1p(total), math.log1p(windows) / 4, total / (windows + 5)]


_CONSTANT = (0.0,) * 6


def score(text: str, model: Model) -> float:
    z = sum(w * x for w, x in zip(model.weights, features(savings(text, model)), strict=True))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@dataclass(frozen=True)
class _Counts:
    """Of some texts: their number and words, and for each word (and word beginning) its contexts and texts.

    A context is a pair of neighbours, so copies of a text add none.
    """

    texts: int
    words: int
    contexts: np.ndarray
    holders: np.ndarray


def _distinct(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many values of ``low`` (under 2^40) each key has."""
    both = np.sort(key.astype(np.uint64) << np.uint64(40) | low.astype(np.uint64))
    first = np.r_[True, both[1:] != both[:-1]] if len(both) else np.zeros(0, bool)
    return np.bincount((both[first] >> np.uint64(40)).astype(np.int64))


def _counts(parts: dict[tuple[int, int], list[str]]) -> tuple[dict[tuple[int, int], _Counts], list[str], set[str]]:
    """Counts of each part's texts, what they count, and which of that are whole words."""
    tokens = Numbered()
    number = tokens.__getitem__
    read = {}
    for key, texts in parts.items():
        rows = [np.fromiter(map(number, t.lower().split()), np.int64) for t in texts]
        read[key] = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    words = [x.strip(_EDGE) for x in tokens]
    names = Numbered()
    forms = np.array([[names[w] if w else -1, *(names[w[:k]] if len(w) > k else -1 for k in _STEMS)] for w in words], np.int64).reshape(-1, 1 + len(_STEMS))
    out = {}
    for key, (token, row) in read.items():
        real = forms[token, 0] >= 0
        token, row = token[real], row[real]
        word = forms[token, 0]
        inside = row[1:] == row[:-1]  # no neighbour: 0, all others from 1 on
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:] = np.where(inside, word[:-1] + 1, 0)
        after[:-1] = np.where(inside, word[1:] + 1, 0)
        pair = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)
        form = forms[token]
        at, kind = np.nonzero(form >= 0)
        found = form[at, kind]
        out[key] = _Counts(len(parts[key]), len(word), _distinct(found, pair[at]), _distinct(found, row[at]))
    return out, list(names), set(words)


def _sum(parts: Sequence[_Counts], keys: int) -> _Counts:
    wide = lambda x: np.pad(x, (0, keys - len(x)))
    return _Counts(sum(p.texts for p in parts), sum(p.words for p in parts), sum((wide(p.contexts) for p in parts), np.zeros(keys, np.int64)), sum((wide(p.holders) for p in parts), np.zeros(keys, np.int64)))


def _trained(samples: list[bytes], size: int, seed: int, k: int = 64, d: int = 6) -> bytes:
    """A dictionary that zstandard trains on samples, in an order that mixes them; few samples are one as they are."""
    random.Random(seed).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, f=20, accel=1, split_point=1.0, level=12).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(
    toxic: _Counts, ordinary: _Counts, names: Sequence[str], whole: set[str], ratio: float = 8.0, least: int = 4, share: float = 0.008, common: int = 50_000, most: int = 100, ordinary_bytes: int = 65536, toxic_bytes: int = 16384
) -> tuple[bytes, bytes]:
    """The two dictionaries, trained by zstandard on what is taken from toxic and from ordinary texts.

    Whole texts teach its trainer the language, not what is toxic in them.  So of
    toxic texts it gets the words and word beginnings that ``least`` texts (or ``share`` of them)
    and as many contexts hold and that are ``ratio`` times as frequent there as in ordinary texts, each as often as it has
    contexts; of ordinary texts the ``common`` words with the most contexts, each at most ``most`` times.
    """
    floor = max(least, share * toxic.texts)
    telling = (
        (np.minimum(toxic.contexts, toxic.holders) >= floor)
        & (toxic.contexts * (ordinary.words + 1) > ratio * (ordinary.contexts + 0.5) * (toxic.words + 1))
        & (toxic.holders * (ordinary.texts + 1) > ratio * (ordinary.holders + 0.5) * (toxic.texts + 1))
    )

    def samples(at: np.ndarray, times: np.ndarray) -> list[bytes]:
        return [x for i, n in zip(at.tolist(), times.tolist(), strict=True) for x in [f" {' '.join(marked(names[i]))} ".encode("utf-8", "surrogatepass")] * n]

    at = np.flatnonzero(telling)
    frequent = [i for i in np.argsort(-ordinary.contexts, kind="stable")[:common].tolist() if ordinary.contexts[i] and names[i] in whole]
    frequent = np.array(frequent, np.int64)
    of_toxic = _trained(samples(at, toxic.contexts[at]), toxic_bytes, 3) if len(at) else b""
    return of_toxic, _trained(samples(frequent, np.minimum(ordinary.contexts[frequent], most)), ordinary_bytes, 4)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a small penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(rows: Sequence[tuple[str, int, int]], toxic_share: float, window: int = 8) -> Model:
    """A model from (text, label, place in a shuffled order).

    Savings for the calibration are out of fold: those of every third row come from
    dictionaries trained without it.  ``toxic_share`` is that of all labelled rows.  If one label is
    missing from a fold or all of them, every score is 0 (no toxic row) or 1.
    """
    parts: dict[tuple[int, int], list[str]] = defaultdict(list)
    for t, y, k in rows:
        parts[k % _FOLDS, y].append(t)
    if len(parts) < 2 * _FOLDS:
        return Model(b"", b"", (40.0 if rows and all(y for _, y, _ in rows) else -40.0, *_CONSTANT), window)
    counts, names, whole = _counts(parts)

    def made(folds: Sequence[int], weights: tuple[float, ...]) -> Model:
        toxic, ordinary = (_sum([counts[f, y] for f in folds], len(names)) for y in (1, 0))
        return Model(*train_dictionaries(toxic, ordinary, names, whole), weights, window)

    x, y = [], []
    for f in range(_FOLDS):
        draft = made([g for g in range(_FOLDS) if g != f], (0.0, *_CONSTANT))
        for label in (0, 1):
            x += [features(savings(t, draft)) for t in parts[f, label]]
            y += [label] * len(parts[f, label])
    y = np.array(y, float)
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    return made(range(_FOLDS), calibrate(np.array(x), y, weight))


def held_out(id_col: str | Column) -> Column:
    """Whether the id's text has a CRC-32 of remainder 1 by 3; such rows are never learnt from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = 1500, most_chars: int = 50_000) -> Model:
    """A model from at most ``each`` toxic and 2 * ``each`` ordinary labelled rows that aren't held out.

    The rows are those of the smallest hashes of the id, so the same for any
    partitioning; rows of over ``most_chars`` characters aren't learnt from.  Ids
    chosen from the labels are a table of bounded size, so joining it with ``docs``
    by broadcast never moves texts other than those.  An id with several labels
    counts as toxic if any is; of several texts of an id the first in order is taken.
    """
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    n, n_toxic = given.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    hashed = given.withColumn("h", F.xxhash64("id", F.lit(8)))
    chosen = [r for y, most, of in ((1, each, n_toxic), (0, 2 * each, n - n_toxic)) for r in smallest(hashed.where(F.col("y") == y), "h", most, of).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.id, r.y, k) for k, r in enumerate(chosen)], "id long, y int, k int")
    given_texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).where(F.length("t") <= most_chars)
    texts = given_texts.join(F.broadcast(ids), "id").groupBy("id", "y", "k").agg(F.min("t").alias("t")).collect()
    return fit([(r.t, r.y, r.k) for r in sorted(texts, key=lambda r: r.k)], n_toxic / n if n else 0.0)


def toxicity(text: str | Column, model: Model) -> Column:
    """Column of scores from 0 to 1 of a text column; null counts as the empty text."""

    @F.arrow_udf("double")
    def judge(column: pa.Array) -> pa.Array:
        return by_parts(column, pa.float64(), lambda part: pa.array([score(x, model) for x in strings(part)], pa.float64()))

    return judge(text)
