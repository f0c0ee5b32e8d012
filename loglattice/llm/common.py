"""Shared text columns and a join that stands hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A key with more than 1 / HOT_SHARE of all rows counts as hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. A text without other letters takes the cheap path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_key(column: Column) -> Column:
    """A non-null text for any id: null and the text 'null' stay apart."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, share: int = HOT_SHARE) -> DataFrame:
    """Left join ``facts`` (one row per non-null ``key``, with the number of ``rows`` it has) to ``rows``.

    A key with more than 1/``share`` of all rows would fill one task of a shuffled join. There are
    fewer than ``share`` such keys whatever the input, so their facts are broadcast; all others
    meet by shuffle in groups of a bounded share. Both inputs are read twice: pass written tables.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.filter(F.col(weight) * share > total)
    cold = facts.filter(F.col(weight) * share <= total)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    names = [*rows.columns, *[c for c in facts.columns if c != key]]
    by_hot = marked.filter(F.col("_hot")).select(*names)
    by_shuffle = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(cold, key, "left").select(*names)
    return by_hot.unionByName(by_shuffle)
