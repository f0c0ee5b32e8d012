"""Envelope columns of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions.ids import assign_trace_id, byte_length, digest, storage_uri
from loglattice.functions.text import decode_payload

RAW_INDEX = [
    "trace_id", "source_id", "received_at", "transport", "peer", "byte_length", "digest", "storage_uri",
    "expires_at", "job_id", "session_id",
]

# Columns that tell where a line stood: of its file (batch and stream readers), or the source's own number.
POSITION = ["file_path", "block_start", "position", "seq", "offset"]
# File and number in it say all; what else a reader adds (its order of this run) is no part of the identity.
IN_FILE = ["file_path", "line_no"]


def place_of(columns: list[str]) -> list[str]:
    """Which of the columns identify the place of a line."""
    return IN_FILE if set(IN_FILE) <= set(columns) else [c for c in POSITION if c in columns]


def build_raw_events(lines: DataFrame, transport: str = "batch_api", identity: list[str] | None = None) -> DataFrame:
    """Raw events from lines with ``source_id``, ``received_at`` and ``line`` or ``payload``.

    Missing envelope columns become null; a missing trace id is derived from ``identity``. Without
    ``identity`` that is the source, the line and whatever tells where it stood (file and line number,
    else ``POSITION``), so equal lines of one file stay different events and a line that is read again
    is the same event; a frame that has none of these is refused.
    """
    df = lines
    if "payload" not in df.columns:
        df = df.withColumn("payload", F.encode(F.col("line"), "UTF-8"))
    if "line" not in df.columns:
        df = df.withColumn("line", decode_payload(F.col("payload")))
    for name in ("peer", "job_id", "session_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    if "expires_at" not in df.columns:
        df = df.withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    if "transport" not in df.columns:
        df = df.withColumn("transport", F.lit(transport))
    if "trace_id" not in df.columns:
        place = place_of(df.columns)
        if not identity and not place:
            raise ValueError(f"lines have no trace_id and no position: pass identity, or one of {', '.join(POSITION)}")
        keys = identity or ["source_id", *place, "line"]
        df = df.withColumn("trace_id", assign_trace_id(F.col("received_at"), *[F.col(k) for k in keys]))
    return df.withColumns(
        {
            "digest": digest(F.col("payload")),
            "byte_length": byte_length(F.col("payload")),
            "storage_uri": storage_uri(F.col("source_id"), F.col("received_at"), F.col("trace_id")),
        }
    )


def build_raw_index(events: DataFrame) -> DataFrame:
    """Index row per event, without the payload."""
    return events.select(*RAW_INDEX)


def source_last_seen(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources with the latest arrival time; sources without events keep what they had."""
    seen = events.groupBy("source_id").agg(F.max("received_at").alias("_seen"))
    joined = sources.join(seen, "source_id", "left")
    before = F.col("last_seen_at") if "last_seen_at" in sources.columns else F.lit(None)
    return joined.withColumn("last_seen_at", F.coalesce(F.col("_seen"), before)).drop("_seen")
