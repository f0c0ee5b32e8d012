"""Log lines from text files, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.functions.text import decode_payload, trim_space
from loglattice.operators.ranking import number_rows
from loglattice.session import cut_lineage, lookup_join


def _clean(df: DataFrame, blank: bool = False) -> DataFrame:
    """Valid text, trimmed; lines that are blank are dropped unless ``blank``. Undecodable bytes are dropped too."""
    decoded = decode_payload(F.col("value"))
    # Only marks of undecodable bytes go, not those that were in valid text.
    text = F.when(F.is_valid_utf8("value"), decoded).otherwise(F.replace(decoded, F.lit("\ufffd"), F.lit("")))
    cleaned = df.withColumn("line", trim_space(text)).drop("value")
    return cleaned if blank else cleaned.filter(F.col("line") != "")


# A row of the table of splits has three numbers, so many of them may be broadcast.
SPLITS_MAX_ROWS = 4_000_000
FILE_BITS = 40


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, the number of a line in its file from 0, and ``seq``, which orders lines by file and number.

    ``lines`` are all rows of a text scan, blank ones too, with ``file_path`` and ``block_start``. A first pass
    counts the rows of every split (file, block, task), reading no text; sums over the splits of a file give the
    number of each split's first line. So a line keeps its number when files are added or splits differ. Both
    passes must plan the same splits; where they do not, the job fails and may be run again.
    """
    row = F.monotonically_increasing_id()
    task = F.shiftright(F.col("_row"), 33)
    split = F.xxhash64("file_path", "block_start", task)
    tagged = lines.withColumn("_row", row)
    counts = cut_lineage(tagged.groupBy("file_path", "block_start", task.alias("_task")).agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_rows")))
    files = number_rows(counts.select("file_path").distinct(), [], ["file_path"], "_file")
    before = Window.partitionBy("file_path").orderBy("block_start", "_task").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(files, "file_path")
    splits = placed.select(F.xxhash64("file_path", "block_start", "_task").alias("_split"), "_from", "_rows", "_base", F.col("_file").cast("long").alias("_file"))
    joined = lookup_join(tagged.withColumn("_split", split), cut_lineage(splits), "_split", max_rows=SPLITS_MAX_ROWS)
    inside = F.col("_row") - F.col("_from")
    moved = F.raise_error(F.lit("splits changed between two passes over the same files; run the job again"))
    number = F.when((inside >= 0) & (inside < F.col("_rows")), F.col("_base") + inside).otherwise(moved).cast("long")
    numbered = joined.withColumn("line_no", number)
    seq = F.shiftleft(F.col("_file") - 1, FILE_BITS) + F.col("line_no")
    return numbered.withColumn("seq", seq).drop("_row", "_split", "_from", "_rows", "_base", "_file", "block_start")


def read_log_lines(spark: SparkSession, path: str, source_id: str | None = None, job_id: str | None = None) -> DataFrame:
    """One row per non-blank line with its file, its number in the file (``line_no``) and a sequence ``seq`` by file and number.

    CSV, JSON lines and plain text are all read as lines. File and number identify a line however the
    files are split and whatever lies beside them; files count as unchanging (a file with another
    modification time holds new lines).
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
    )
    return _clean(number_lines(raw)).withColumns({"source_id": F.lit(source_id), "job_id": F.lit(job_id)})


def job_event_total(lines: DataFrame, key: str | None = None) -> DataFrame:
    """Number of non-blank lines, overall or per key."""
    kept = lines.filter(trim_space(F.col("line")) != "")
    total = F.count(F.lit(1)).alias("total_events")
    return kept.groupBy(key).agg(total) if key else kept.agg(total)


def session_event_total(events: DataFrame, key: str) -> DataFrame:
    """Number of submitted strings per session; blank ones count as well."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("total_events"))


def stream_log_lines(spark: SparkSession, path: str, max_files: int = 64, blank: bool = False) -> DataFrame:
    """The same lines as a stream; ``max_files`` per trigger is the back-pressure knob.

    Streams cannot number rows: the pipeline numbers the lines of each micro-batch. For the numbers (and
    so the ids) of the batch reader it has to see blank lines too; with ``blank`` they stay, as empty texts.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    return _clean(raw, blank)
