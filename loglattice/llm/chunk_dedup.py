"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (after a sentence mark or a line end, once 256
characters have passed), so equal stretches give equal chunks wherever they stand. Every distinct
chunk gets a verified identifier: its 64-bit hash, and a rank among the texts that share that hash.
Documents are then compared by their ordered identifier lists, a few bytes per kilobyte of text;
chunk texts travel once, after map-side removal of repeats, to verify the identifiers.

Defined results: null text equals empty text (empty list of chunks). Rows with equal text and equal
id are told apart by position, one of them stays. Null ids lose against any id; a group with only
null ids keeps one row and its keep_id is null. An empty table gives an empty table. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import ascii_lower, attach, id_key, whole
from loglattice.session import cut_lineage

SHORTEST, LONGEST = 256, 4096
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST - 2}}}?(?:[.!?]\s|\n|\z)|.{{1,{LONGEST}}}"


def chunks_of(text: Column) -> Column:
    """Content-defined chunks in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def hash64(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = hash64) -> DataFrame:
    """One row per document: ``id``, ``row`` (position), ``sha256`` of the normalised text, ``recipe``.

    Equal recipes mean equal normalised texts. ``digest`` may be any 64-bit hash, however weak.
    """
    texts = docs.select(F.col(id_col).alias("id"), ascii_lower(whole(F.col(text_col))).alias("norm"))
    cut = texts.select("id", "norm", chunks_of(F.col("norm")).alias("chunks"))
    rows = cut_lineage(
        cut.select(
            "id", F.monotonically_increasing_id().alias("row"), F.sha2("norm", 256).alias("sha256"), F.transform("chunks", digest).alias("recipe")
        )
    )
    each = cut.select("id", "norm", F.posexplode("chunks").alias("place", "chunk"))
    known = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("hash"), "chunk").groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n"))
    clashing = cut_lineage(known.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash"))
    if clashing.isEmpty():
        return rows.withColumn("recipe", F.struct(F.col("recipe").alias("hashes"), F.array().cast("array<struct<place:int,rank:int>>").alias("ranks")))
    order = Window.partitionBy("hash").orderBy("chunk")
    ranked = known.join(clashing, "hash", "left_semi").withColumn("rank", F.row_number().over(order) - 1).filter("rank > 0")
    placed = each.withColumn("hash", digest(F.col("chunk"))).join(ranked.select("hash", "chunk", "rank"), ["hash", "chunk"])
    marks = (
        placed.select(id_key(F.col("id")).alias("_id"), F.sha2("norm", 256).alias("sha256"), F.struct("place", "rank").alias("mark"))
        .distinct().groupBy("_id", "sha256").agg(F.sort_array(F.collect_list("mark")).alias("ranks"))
    )
    keyed = rows.withColumn("_id", id_key(F.col("id"))).join(marks, ["_id", "sha256"], "left")
    ranks = F.coalesce("ranks", F.array().cast("array<struct<place:int,rank:int>>"))
    return cut_lineage(keyed.select("id", "row", "sha256", F.struct(F.col("recipe").alias("hashes"), ranks.alias("ranks")).alias("recipe")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = hash64) -> DataFrame:
    """Per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays. Groups of any size are counted with map-side
    sums, and the verdict of a hot group reaches its rows by broadcast (see :func:`attach`).
    """
    rows = chunk_recipes(docs, id_col, text_col, digest)
    groups = cut_lineage(
        rows.groupBy("recipe").agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    )
    joined = attach(rows, groups, "recipe", "group_size")
    return joined.select(
        F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), F.col("group_size").cast("long"),
        (F.col("row") == F.col("last.row")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that :func:`exact_dedup` keeps, with all their columns; one row of equal (id, text)."""
    verdict = exact_dedup(docs, id_col, text_col).filter("kept").select(id_key(F.col(id_col)).alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumns({"__id": id_key(F.col(id_col)), "__sha": F.sha2(ascii_lower(whole(F.col(text_col))), 256)})
    return keyed.join(verdict, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).drop("__id", "__sha")
