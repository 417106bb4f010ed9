"""URL filters: rules of host and path, and boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libris.llm import gbdt
from libris.llm.common import without


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, and paths that start with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(text: str) -> list[Rule]:
    """Rules from lines such as ``block example.com/en/``."""
    out = []
    for line in text.splitlines():
        if line.strip():
            verdict, place = line.split()
            host, slash, path = place.partition("/")
            if verdict not in ("allow", "block"):
                raise ValueError(f"allow or block is expected: {line!r}")
            out.append(Rule(verdict, host.lower(), slash + path))
    return out


def host(url: str | Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null without ``://``: empty."""
    after = _after(url)
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str | Column) -> Column:
    """What stands between the host and the next ``?``, ``#`` or the end; null without ``://``: empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", c)
    return F.when(at > 0, F.substring(c, at + 3, F.length(c)))


def match(host_col: Column, path_col: Column, given: Sequence[Rule]) -> Column:
    """The name of the longest rule that fits, or null.  Of equally long ones the first stands."""
    out = F.lit(None).cast("string")
    for _, r in sorted(enumerate(given), key=lambda x: (len(x[1].name), -x[0])):
        on_host = (host_col == r.host) | F.endswith(host_col, F.lit(f".{r.host}"))
        out = F.when(on_host & F.startswith(path_col, F.lit(r.path)), F.lit(r.name)).otherwise(out)
    return out


_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^A-Za-z0-9]+")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def parts(url: str | None) -> tuple[str, str, str]:
    """Host, path and query of a URL as text, by the same rule as the columns."""
    _, found, after = (url or "").partition("://")
    if not found:
        return "", "", (url or "")
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", after, re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2], m[3] or ""


def lexical(url: str | None) -> list[float]:
    """Length, depth, digit ratio, entropy and parameter counts."""
    h, p, q = parts(url)
    text = url or ""
    segments = [x for x in p.split("/") if x]
    words = [w for w in _WORD.split(h) if w]
    return [
        float(len(text)),
        float(len(h)),
        float(len(p)),
        float(len(segments)),
        float(h.count(".")),
        len(_DIGITS.findall(text)) / max(1, len(text)),
        len(_DIGITS.findall(h)) / max(1, len(h)),
        entropy(text),
        entropy(h),
        float(q.count("&") + 1 if q else 0),
        float(len(q)),
        float("#" in text),
        float(text.startswith("https")),
        float(h.count("-")),
        float(max(map(len, words), default=0)),
        float(len(segments[0]) if segments else 0),
    ]


def suffixes(url: str | None) -> list[str]:
    """What suffix statistics are kept of: the last one and two labels of the host, and the last with the first path segment."""
    h, p, _ = parts(url)
    labels = h.split(".")
    first = p.split("/")[1] if p.count("/") > 1 else ""
    return [labels[-1], ".".join(labels[-2:]), f"{labels[-1]}/{first}"]


@dataclass(frozen=True)
class Model:
    """Trees, and for each kind of suffix the smoothed share of blocked URLs."""

    trees: gbdt.Trees
    share: float
    statistics: tuple[dict[str, tuple[int, int]], ...]

    def features(self, urls: Sequence[str | None], own: Sequence[int] | None = None) -> np.ndarray:
        """A row per URL.  ``own``: the labels of training rows, which then don't count for themselves."""
        rows = []
        for i, url in enumerate(urls):
            row = lexical(url)
            for held, key in zip(self.statistics, suffixes(url), strict=True):
                n, blocked = held.get(key, (0, 0))
                if own is not None:
                    n, blocked = n - 1, blocked - own[i]
                row += [(blocked + 8 * self.share) / (n + 8), math.log1p(max(n, 0))]
            rows.append(row)
        return np.array(rows, np.float64).reshape(len(urls), -1)

    def probability(self, urls: Sequence[str | None]) -> np.ndarray:
        return self.trees.probability(self.features(urls)) if len(urls) else np.zeros(0)


def fit(urls: Sequence[str | None], blocked: Sequence[int]) -> Model:
    """Trees on lexical features and suffix statistics of labelled URLs; without any, all is allowed."""
    if not len(urls):
        return Model(gbdt.Trees(-5.0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1))), 0.0, ({}, {}, {}))
    statistics: tuple[dict, ...] = ({}, {}, {})
    for url, y in zip(urls, blocked, strict=True):
        for held, key in zip(statistics, suffixes(url), strict=True):
            n, k = held.get(key, (0, 0))
            held[key] = (n + 1, k + y)
    share = sum(blocked) / len(blocked)
    draft = Model(gbdt.Trees(0.0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1))), share, statistics)
    trees = gbdt.train(draft.features(urls, blocked), np.array(blocked, float))
    return Model(trees, share, statistics)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = 20_000) -> Model:
    """A model from labelled URLs: at most ``most`` distinct ones, those of the smallest hashes.

    The label is 1 for blocked; a URL with several labels counts as blocked if any says so.
    A threshold on the hash leaves about twice as many, so only these are shuffled; should
    it leave too few, all are looked at.
    """
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(F.xxhash64(url_col).alias("h"), F.col(url_col).alias("url"), F.col(label_col).alias("y"))
    n, wanted = rows.agg(F.approx_count_distinct("h")).first()[0], 2 * most + 1000

    def least(some: DataFrame) -> list:
        return some.groupBy("h", "url").agg((F.max("y") > 0).cast("int").alias("y")).orderBy("h", "url").limit(most).collect()

    chosen = least(rows if n <= wanted else rows.where(F.col("h") < -(1 << 63) + (1 << 64) * wanted // n))
    if len(chosen) < most and n > wanted:
        chosen = least(rows)
    return fit([r.url for r in chosen], [r.y for r in chosen])


def blocked(url: str | Column, model: Model) -> Column:
    """Column of the probability that a URL is to be blocked."""

    @F.arrow_udf("double")
    def judge(column: pa.Array) -> pa.Array:
        return pa.array(model.probability(column.to_pylist()), pa.float64())

    return judge(url)


def filter_urls(pages: DataFrame, given: Sequence[Rule], url_col: str = "url", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``probability`` and ``verdict``.

    The longest rule that fits decides, of equally long ones the first given; where none does, the model blocks URLs of a
    probability of at least ``threshold``.  ``labelled`` (url, blocked) trains the
    model; by default the URLs that rules decide are the labelled ones, so that the model carries
    the rules on to URLs that look alike and knows nothing else.  Null and
    malformed URLs have an empty host and path and go to the model.  Input columns
    named like the new ones are replaced.
    """
    base = without(pages, "host", "path", "rule", "probability", "verdict")
    judged = base.withColumn("host", host(f"`{url_col}`")).withColumn("path", path(f"`{url_col}`"))
    judged = judged.withColumn("rule", match(F.col("host"), F.col("path"), given))
    by_rule = F.lit(None).cast("string")
    for r in reversed(given):
        by_rule = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(by_rule)
    if labelled is None:
        labelled = judged.where(F.col("rule").isNotNull()).select(F.col(f"`{url_col}`").alias("url"), (by_rule == "block").cast("int").alias("blocked"))
    model = train(labelled)
    judged = judged.withColumn("probability", blocked(f"`{url_col}`", model))
    return judged.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))
