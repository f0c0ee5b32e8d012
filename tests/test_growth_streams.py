"""Tasks of micro-batches must not grow with their input."""

import glob

from loglattice.plans import q_faults
from loglattice.session import tasks_for
from loglattice.streaming.pipeline import stream_dedupe
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_tasks_of_a_micro_batch_grow_with_its_scan(spark):
    rows = spark.range(0, 1000, 1, 40).select((F.col("id") % 500).cast("string").alias("trace_id"), F.repeat(F.lit("x"), 100).alias("payload"))
    once = stream_dedupe(rows, [], tasks_for(rows))
    assert once.rdd.getNumPartitions() == tasks_for(rows) == 320 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert once.count() == once.select("trace_id").distinct().count() == 500


def test_files_of_a_stream_grow_with_the_table(spark):
    path, share = q_faults._many_doc_files(spark, SF, 2)
    files = glob.glob(f"{path}/in/*.txt".removeprefix("file:"))
    assert share > 1 and share < len(files) <= 2 * share
    assert spark.read.text(f"{path}/in").count() >= spark.read.parquet(f"{SF}/documents.parquet").count()
