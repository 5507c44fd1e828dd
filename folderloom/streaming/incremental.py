"""Folder ingestion as a stream: new files only, a few per trigger, resumable.

The stream's checkpoint remembers which files were seen and takes the place of a pause file: a
stopped or failed query goes on where it was. A batch that is run again overwrites its own run, and
the ledger keeps files that were committed by a batch run from being imported twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from folderloom.plans.ingest import EXTENSIONS, Options, ingest_files
from folderloom.plans.store import Store
from folderloom.sources import files as file_source


BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(store: Store, root: str, checkpoint: str, fmt: str = "csv", options: Options | None = None,
                  files_per_trigger: int = 1000, interval: str | None = None, **kw):
    """Start the stream. Without ``interval`` it takes all files that are there and ends; with it,
    it looks again after each pause. ``files_per_trigger`` bounds one batch."""
    options = options or Options(**kw)
    if fmt not in ("csv", "json", "workbook"):
        raise ValueError("archives are imported by batch runs")
    extensions = EXTENSIONS[fmt]

    def query_id() -> str:
        # Spark keeps it in the checkpoint from the first batch on: another checkpoint, or an emptied one, has another id.
        return json.loads(store.spark.read.text(f"{checkpoint}/metadata", wholetext=True).head()[0])["id"]

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        listed = file_source.described(batch, root, extensions)
        found = file_source.scan_files(store.spark, root, extensions, listed=listed)
        ingest_files(store, root, found, fmt, options, run=f"stream-{query_id()}-{batch_id}")

    source = (
        store.spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(root)
    )
    writer = source.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
