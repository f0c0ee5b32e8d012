"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a weight and a ramp: its share of the mix changes linearly over training time
t in [0, 1]. Targets are filled like water: a source stops at ``MAX_REPEAT`` times its size, what
it cannot take is shared again by weight. The documents of a source, in a keyed order, form a
stream of words that is passed over up to twice; a document's training position is the time at
which the integrated ramp of its source has demanded the words before it (the inverse of a
quadratic). Documents are then range-sorted by position.

Defined results: null texts have size 0; a size 0 takes nothing and has no position. Null is a
source of its own and the last one; null ids are ordered like an empty text. Rows that agree in id
and size may exchange their results. The last document a target reaches is taken in part, so a
source's taken words are its target without the fraction. Empty input gives an empty table. Other
columns, whatever their names, are not read (:func:`mix` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import WORD, attach, id_key, whole, word_count
from loglattice.operators.ranking import number_rows
from loglattice.session import cut_lineage

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MAX_REPEAT = 1.5, 2
# Relative weight at t = 0 and at t = 1, by rank; each pair sums to 2, so a ramp integrates to 1.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
# Rows that one bucket of a source's stream should hold at most on average.
BUCKET_ROWS = 100_000


def cycle(values: tuple, rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(rank, F.lit(len(values))).cast("int"))


def targets(sources: DataFrame, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to sources with ``source_size`` and ``weight``: min(max_repeat * size, level * weight).

    The level is found by repeated sums over the sources; it only rises, and a round that caps no
    further source ends the search.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.col("source_size") * float(max_repeat)
    while total:
        capped = full < F.lit(level) * F.col("weight")
        used, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(capped, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).first()
        following = (total_share * total - used) / open_weight if open_weight else level
        if following <= level:
            break
        level = following
    return sources.withColumn("target", F.when(full < F.lit(level) * F.col("weight"), full).otherwise(F.lit(level) * F.col("weight")))


def position(words_before: Column, target: Column, rank: Column) -> Column:
    """Training time at which the source's demand reaches ``words_before``."""
    share, at_start = words_before / target, cycle(tuple(r[0] for r in RAMPS), rank)
    slope = cycle(tuple(r[1] - r[0] for r in RAMPS), rank)
    return F.when(slope == 0, share).otherwise((F.sqrt(at_start * at_start + slope * share * F.lit(2.0)) - at_start) / slope)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id, key columns, size, source_size, target, and per pass the words taken and the position.

    A hot source is cut into buckets of its keyed order; buckets are summed first, and each task
    adds only the words before its own bucket.
    """
    text = whole(F.col(text_col))
    keyed = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"), word_count(text).alias("size"), id_key(F.col(source_col)).alias("_source"), F.sha2(text, 256).alias("_sha"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_order"),
        )
    )
    sizes = keyed.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    # 'n' (null) sorts before 'v...': put it last.
    ordered = number_rows(cut_lineage(sizes), [], [F.expr("_source = 'n'").asc(), F.col("_source").asc()], "_rank")
    sources = cut_lineage(targets(ordered.withColumn("_rank", F.col("_rank") - 1).withColumn("weight", cycle(WEIGHTS, F.col("_rank")))))
    rows = sources.agg(F.sum("_rows")).first()[0] or 0
    digits = max(3, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    placed = attach(keyed, sources, "_source", "_rows").withColumn("_bucket", F.substring("_order", 1, digits))
    sums = placed.groupBy("_rank", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_rank", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_rank", "_bucket").orderBy("_order", "id", "size", "_sha").rowsBetween(Window.unboundedPreceding, -1)
    streamed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(shifts, ["_rank", "_bucket"])
    streamed = streamed.withColumn("_before", F.col("_inside") + F.col("_shift"))
    limit = F.floor("target")
    taken = {}
    for turn in range(MAX_REPEAT):
        before = F.col("_before") + F.col("source_size") * turn
        taken[f"_taken{turn}"] = F.greatest(F.lit(0), F.least(F.col("size"), limit - before)).cast("long")
    streamed = streamed.withColumns(taken)
    return streamed.withColumns({
        f"_at{turn}": F.when(F.col(f"_taken{turn}") > 0, position(F.col("_before") + F.col("source_size") * turn, F.col("target"), F.col("_rank")))
        for turn in range(MAX_REPEAT)
    })


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document, range-sorted by its first training position (documents not taken last)."""
    rows = assign(docs, id_col, text_col, source_col)
    facts = cut_lineage(rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("_taken0") + F.col("_taken1")).alias("taken"),
        F.col("_at0").alias("first_position"), F.col("_at1").alias("second_position"),
    ))
    return facts.orderBy(F.col("first_position").asc_nulls_last(), F.col(id_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", in_part: bool = True) -> DataFrame:
    """The training stream: documents with all their columns, once per pass that takes them, in order of position.

    A document taken in part keeps its first words; without ``in_part`` it stays whole, so a source
    goes beyond its target by less than one document.
    """
    rows = assign(docs, id_col, text_col, source_col)
    passes = F.array(*[F.struct(F.col(f"_at{t}").alias("at"), F.col(f"_taken{t}").alias("n")) for t in range(MAX_REPEAT)])
    turns = rows.select(id_key(F.col("id")).alias("__id"), F.col("_source").alias("__source"), F.col("_sha").alias("__sha"), F.col("size").alias("__size"), F.explode(passes).alias("__turn"))
    turns = turns.filter("__turn.n > 0")
    names = ["__id", "__source", "__sha"]
    keyed = docs.withColumns({"__id": id_key(F.col(id_col)), "__source": id_key(F.col(source_col)), "__sha": F.sha2(whole(F.col(text_col)), 256)})
    stream = keyed.dropDuplicates(names).join(turns, names).withColumn("__at", F.col("__turn.at"))
    if not in_part:
        return stream.orderBy("__at", id_col).select(*docs.columns)
    text = whole(F.col(text_col))
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("__turn.n").cast("int")), "")
    cut = F.when(F.col("__turn.n") < F.col("__size"), part).otherwise(F.col(text_col))
    changed = {text_col: cut}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col("__turn.n") < F.col("__size"), F.length(part).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return stream.withColumns(changed).orderBy("__at", id_col).select(*docs.columns)
