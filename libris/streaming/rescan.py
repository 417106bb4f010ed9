"""Packages taken in as they appear: the streaming form of a repeated scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from libris.checkpoints import checkpointed
from libris.plans.library import now, take_in
from libris.sources.epub import parse_packages
from libris.store import Store

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, clock=now, **trigger: object) -> StreamingQuery:
    """Inserts each new package of a folder once and links it to a work, as a scan does.

    The checkpoint remembers the files seen, the path the rows inserted, so a batch that is
    run again changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(folder)

    def take(batch: DataFrame, _: int) -> None:
        take_in(store, checkpointed(parse_packages(batch)), clock())

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
