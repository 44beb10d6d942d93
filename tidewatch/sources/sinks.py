"""Writers for the audit table and labels, and the form that any other sink has."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from tidewatch import schemas
from tidewatch.session import freeing

# Fixed value: rows per audit file.
ROWS_PER_FILE = 200_000
# Hadoop's local file system writes a checksum file beside each file and starts a chmod process for each of the two, which
# takes longer than all else for small files. Files of the audit table go without it; their pages have checksums of their
# own. Other file systems are not concerned.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Sink(Protocol):
    """Where scored rows go. A batch may come again under its id and must then replace what it wrote."""

    def write(self, rows: DataFrame, batch_id: int) -> None: ...


@dataclass(frozen=True)
class AuditSink:
    """The audit table by day and batch."""

    path: str

    def write(self, rows: DataFrame, batch_id: int) -> None:
        write_audit(rows, self.path, batch=batch_id)


def write_audit(records: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE,
                files_per_day: int | None = None, batch: int | None = None) -> None:
    """Append by day. One busy day spreads over `files_per_day` tasks (by default one per shuffle partition).

    With `batch` the rows lie under day and batch, and writing a batch again replaces it.
    """
    spread = files_per_day or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64("transaction_id"), F.lit(spread))
    rows = records.select(*schemas.AUDIT.fieldNames()).repartition("dt", lane)
    if batch is None:
        writer = rows.write.partitionBy("dt").mode("append")
    else:
        writer = (rows.withColumn("batch", F.lit(batch)).write.partitionBy("dt", "batch").mode("overwrite")
                  .option("partitionOverwriteMode", "dynamic"))
    with freeing(records.sparkSession):
        writer.options(**PLAIN_FILES).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select(*schemas.LABEL.fieldNames()).write.mode("append").parquet(path)
