"""Token counts kept up to date by deltas."""

from __future__ import annotations

import base64
import functools
import json
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from libris.llm.bpe import tokenizer
from libris.llm.common import by_parts, strings
from libris.publish import publish

#: What totals are kept by, and what is totalled.
KEYS = ("source", "lang", "tokenizer")
TOTALS = ("documents", "tokens")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


#: Where the library's matcher and merges would take too deep a stack or too long.
_LONG_RUN = re.compile(r"\s{1000}|\S{1000}")


@functools.lru_cache(maxsize=4)
def _library(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_bpe_counts(text: str | Column, path: str, pattern: str) -> Column:
    """Column of the numbers of byte-level BPE tokens (long) of a text column; null counts as the empty text.

    Texts that hold a run of 1,000 characters or more with or without white space, on which the
    tokenizer library can fail, are counted by :class:`libris.llm.bpe.ByteBPE`, which gives the same ids for any length.
    """

    def count(t: str) -> int:
        return int(tokenizer(path, pattern).encode_all([t]).counts[0]) if _LONG_RUN.search(t) else len(_library(path, pattern).encode_ordinary(t))

    @F.arrow_udf("long")
    def counts(column: pa.Array) -> pa.Array:
        return by_parts(column, pa.int64(), lambda part: pa.array([count(t) for t in strings(part)], pa.int64()))

    return counts(text)


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows for changes (change, source, lang, tokenizer, tokens, old_source, old_lang, old_tokens).

    ``insert`` adds a document and its tokens, ``delete`` takes them away, ``revise``
    takes away what was counted at the old place and adds the new count; a change
    of any other kind is an error.  Null counts are 0, null keys a group of their own.
    """
    kind = F.col("change")
    known = kind.isin("insert", "delete", "revise")
    checked = F.when(known, kind).otherwise(F.raise_error(F.concat(F.lit("not a change: "), F.coalesce(kind, F.lit("null")))).cast("string"))
    n, old = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    one = F.lit(1).cast("long")
    sign = F.when(F.col("kind") == "delete", -one).otherwise(one)
    new = F.struct("source", "lang", "tokenizer", sign.alias("documents"), (sign * n).alias("tokens"))
    gone = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer", (-one).alias("documents"), (-old).alias("tokens"))
    both = F.when(F.col("kind") == "revise", F.array(new, gone)).otherwise(F.array(new))
    return changes.withColumn("kind", checked).select(F.inline(both))


class Rollup:
    """Totals by source, language and tokenizer version, in a folder that all machines share.

    A batch of changes is one commit: its changes are summed up (before and after
    the shuffle) and written aside; then a small file under the batch's name says where. Of
    several writers of one name exactly one makes that file, so a batch counts once and as a whole.  A batch of a
    name that is there already changes nothing, whatever it holds.  Totals are the sum
    of all batches; :meth:`compact` folds batches into a base that also remembers their
    names.  One writer at a time may compact; commits may run at once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join([self.folder, *parts]))

    def _base(self) -> str | None:
        """The folder of the base that counts."""
        at = self._at("base")
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return self.spark.read.json(f"{self.folder}/base/{max(numbers)}", schema="data string").first()["data"] if numbers else None

    def _open(self) -> DataFrame:
        """(name, data) of batches that aren't folded into the base."""
        schema = "name string, data string"
        if not (self._fs.exists(self._at("batch")) and len(self._fs.listStatus(self._at("batch")))):
            return self.spark.createDataFrame([], schema)
        made = self.spark.read.json(f"{self.folder}/batch", schema=schema)
        return made.join(self._folded(), "name", "left_anti")

    def _folded(self) -> DataFrame:
        base = self._base()
        return self.spark.read.parquet(f"{self.folder}/{base}/names") if base else self.spark.createDataFrame([], "name string")

    def committed(self) -> set[str]:
        """Names of the batches that count."""
        return {r["name"] for r in self._folded().union(self._open().select("name")).collect()}

    def _marker(self, name: str) -> str:
        return quote(name, safe="").replace("%", "=")  # readers may decode percent signs

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Adds a batch; False if one of that name is there."""
        if self._fs.exists(self._at("batch", self._marker(name))) or not self._folded().where(F.col("name") == name).isEmpty():
            return False
        data = f"data/{uuid.uuid4().hex}"
        signed(changes).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).write.parquet(f"{self.folder}/{data}")
        done = publish(self.spark, f"{self.folder}/batch/{self._marker(name)}", json.dumps({"name": name, "data": data}))
        if not done:
            self._fs.delete(self._at(data), True)
        return done

    def _sum(self, batches: list[str], base: str | None) -> DataFrame:
        paths = [f"{self.folder}/{x}" for x in batches] + ([f"{self.folder}/{base}/totals"] if base else [])
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens), without groups that hold nothing any more."""
        summed = self._sum([r["data"] for r in self._open().collect()], self._base())
        return summed.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Folds all batches into a new base; batches and bases before it are deleted."""
        base, batches = self._base(), self._open().collect()
        to = f"data/{uuid.uuid4().hex}"
        self._sum([r["data"] for r in batches], base).write.parquet(f"{self.folder}/{to}/totals")
        names = self.spark.createDataFrame([(r["name"],) for r in batches], "name string")
        self._folded().union(names).write.parquet(f"{self.folder}/{to}/names")
        at = self._at("base")
        number = max((int(s.getPath().getName()) for s in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0
        if not publish(self.spark, f"{self.folder}/base/{number + 1}", json.dumps({"data": to})):
            self._fs.delete(self._at(to), True)
            raise RuntimeError("another writer compacted meanwhile")
        for r in batches:
            self._fs.delete(self._at("batch", self._marker(r["name"])), False)
            self._fs.delete(self._at(r["data"]), True)
        if base:
            self._fs.delete(self._at("base", str(number)), False)
            self._fs.delete(self._at(base), True)
