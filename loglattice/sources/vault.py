"""Raw vault: every payload verbatim, partitioned by source and day, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions.ids import parse_vault_uri
from loglattice.session import BROADCAST_MAX_ROWS, fits_broadcast

# Files that one batch leaves per source and day at most.
VAULT_PIECES = 32
LAYOUT = r"/([^/]+)/(\d{4}-\d{2}-\d{2})/([^/]+)\.raw$"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)


def write_raw_vault(events: DataFrame, path: str) -> None:
    """Append events whose trace id is not stored yet.

    Only the days between the first and the last of the batch are read of the stored side. Rows
    are dealt by source, day and a piece of the trace id, so a source and day get few files, and a
    hot source still spreads over ``VAULT_PIECES`` tasks.
    """
    spark = events.sparkSession
    rows = events.withColumn("received_date", F.to_date("received_at"))
    if _exists(spark, path):
        first, last = rows.agg(F.min("received_date"), F.max("received_date")).first()
        stored = spark.read.parquet(path).select("source_id", "received_date", "trace_id")
        stored = stored.filter(F.col("received_date").between(F.lit(first), F.lit(last)))
        rows = rows.join(stored, ["source_id", "received_date", "trace_id"], "left_anti")
    piece = F.pmod(F.xxhash64("trace_id"), F.lit(VAULT_PIECES))
    rows.repartition("source_id", "received_date", piece).write.partitionBy("source_id", "received_date").mode("append").parquet(path)


def read_raw_vault(spark: SparkSession, path: str, source_id: str | None = None, day: str | None = None, trace_id: str | None = None) -> DataFrame:
    """Stored events; source and day prune partitions, the trace id is pushed to the scan."""
    df = spark.read.parquet(path)
    for name, value in (("source_id", source_id), ("received_date", day), ("trace_id", trace_id)):
        if value:
            df = df.filter(F.col(name) == value)
    return df


def read_raw_by_uri(spark: SparkSession, path: str, uris: DataFrame, uri: str = "storage_uri") -> DataFrame:
    """Stored events for a frame of vault addresses."""
    keys = uris.select(parse_vault_uri(F.col(uri)).alias("k")).select("k.source_id", F.col("k.received_date").cast("date").alias("received_date"), "k.trace_id")
    return spark.read.parquet(path).join(keys.distinct(), ["source_id", "received_date", "trace_id"], "left_semi")


ADDRESS = ["source_id", "received_date", "trace_id"]


def _addressed(rows: DataFrame) -> DataFrame:
    """Rows with the day that is part of their address, if they tell when they arrived."""
    arrived = [c for c in ("received_at", "created_at") if c in rows.columns]
    if "received_date" in rows.columns or not arrived:
        return rows
    return rows.withColumn("received_date", F.to_date(arrived[0]))


def fetch_raw(raw: DataFrame, wanted: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Raw rows of the events in ``wanted``: trace_id, and where known source_id and arrival (received_at or created_at).

    Source and day are part of the join, so of a stored vault only the partitions of wanted events are
    read. Addresses proven few are broadcast and payloads do not move; more of them first prune
    partitions by their sources and days, then meet what is left by shuffle.
    """
    rows, keys = _addressed(raw), _addressed(wanted)
    address = [c for c in ADDRESS if c in keys.columns and c in rows.columns]
    # Spark prunes partitions by a joined side only where that side is filtered by a comparison; this one holds for all ids.
    keys = keys.filter(F.col("trace_id") >= "").select(*address).distinct()
    if fits_broadcast(keys, max_rows):
        found = rows.join(F.broadcast(keys), address, "left_semi")
    else:
        partitions = address[:-1]
        days = keys.select(*partitions).distinct()
        pruned = rows.join(F.broadcast(days), partitions, "left_semi") if partitions and fits_broadcast(days, max_rows) else rows
        found = pruned.join(keys, address, "left_semi")
    return found.select(*raw.columns)


def read_legacy_vault(spark: SparkSession, path: str) -> DataFrame:
    """One-file-per-event layout ``<source>/<day>/<trace>.raw``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.raw").load(path)
    return files.select(
        F.regexp_extract("path", LAYOUT, 1).alias("source_id"), F.to_date(F.regexp_extract("path", LAYOUT, 2)).alias("received_date"),
        F.regexp_extract("path", LAYOUT, 3).alias("trace_id"), F.col("content").alias("payload"), F.col("length").alias("byte_length"),
    )
