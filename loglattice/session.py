"""Session helpers: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count a side may have before it is broadcast by hint.
BROADCAST_MAX_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; make one only in local mode where none is set (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is None:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loglattice-ckpt-"))
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once into the shared checkpoint folder; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: later passes read only the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Tasks made of one scan task: its rows stand in few row groups, and grow many times over as lines.
TASKS_PER_SPLIT = 8


def tasks_for(df: DataFrame) -> int:
    """A number of tasks that uses all cores and grows with the scan of ``df``."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, TASKS_PER_SPLIT * df.rdd.getNumPartitions())


def settle(column: Column) -> Column:
    """Keep filters on a costly column above the projection that computes it.

    The optimiser pushes a filter below a projection by copying the expression into it, which
    would run all parsing again for every test of its result. It leaves projections that hold a
    non-deterministic term alone; this one is always true.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when the frame is proven to hold at most ``max_rows`` rows (reads one row more)."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    max_rows: int = BROADCAST_MAX_ROWS,
    salts: int = 1,
) -> DataFrame:
    """Join a large fact side to a lookup of unknown size.

    A lookup proven small is broadcast, so a hot key on the fact side never moves. A larger
    one meets the facts in a sort-merge join, named as such, for Spark's size estimate would let
    it broadcast millions of narrow rows through the driver; the partition of a hot key is split
    by Spark's adaptive skew join. With ``salts`` the lookup is replicated as often and joined on
    (keys, salt), where adaptive execution is off. ``how`` must be ``left``, ``inner``, ``left_semi``
    or ``left_anti``; in all four every fact row meets each lookup row at exactly one salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(lookup, max_rows):
        return facts.join(F.broadcast(lookup), keys, how)
    if salts == 1:
        return facts.join(lookup.hint("merge"), keys, how)
    # Any salt is right: each lookup row stands at all of them. Row numbers also split rows that agree in all columns.
    salted_facts = facts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    salted_lookup = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_facts.join(salted_lookup.hint("merge"), [*keys, "_salt"], how).drop("_salt")
