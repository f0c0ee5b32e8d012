"""Rule lock: per job or session, settle on one rule after ten resolved events and spot-check it.

The lock is a state machine over the events of a container in arrival order. A container may hold
a third of all events, so it is never handed to one task. Containers are range-partitioned into
chunks; every chunk of a container that spans several is reduced to a *transition table* (entry
state -> exit state, a finite array); tables compose by indexing, so a tree of small joins gives
each chunk its entry state; then all chunks are replayed in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.session import cut_lineage, lookup_join

# Thresholds and spot-check rates.
LOCK_AFTER = 10
MISMATCH_LIMIT = 5
RATE_AFTER_MISMATCH, AFTER_MISMATCH_SPAN = 25, 50
RATE_EARLY, EARLY_SPAN = 50, 100
RATE_STEADY = 500

NO_RULE = -1
CHUNK_ROWS = 1_000_000
FAN_IN = 64

STATE_SCHEMA = (
    "container string, status string, rule_version_id string, sample_count_seen int, mismatch_count int, "
    "events_since_lock bigint, events_since_mismatch bigint"
)


def spot_check_rate(mismatches: Column, since_mismatch: Column, since_lock: Column) -> Column:
    """Every how many events a locked container is checked."""
    return (
        F.when((mismatches > 0) & (since_mismatch < AFTER_MISMATCH_SPAN), RATE_AFTER_MISMATCH)
        .when(since_lock < EARLY_SPAN, RATE_EARLY)
        .otherwise(RATE_STEADY)
    )


def is_spot_check(mismatches: Column, since_mismatch: Column, since_lock: Column) -> Column:
    return F.pmod(since_lock + 1, spot_check_rate(mismatches, since_mismatch, since_lock)) == 0


# --- finite state codes --------------------------------------------------------------
# 0..9: sampling with that many resolved events. Above: locked rule x (mismatches and how long
# ago the last one was: no mismatch, or 1..4 mismatches x {<25, <50, longer}) x events since the
# lock (exact below 100, else modulo 500 - all that the schedule ever looks at).
_SINCE = EARLY_SPAN + RATE_STEADY
_MISS = 1 + (MISMATCH_LIMIT - 1) * 3


def state_count(rules: int) -> int:
    return LOCK_AFTER + rules * _MISS * _SINCE


def encode(locked, seen, rule, miss, since_lock, since_miss):
    near = np.minimum(since_miss // RATE_AFTER_MISMATCH, 2)
    miss_code = np.where(miss == 0, 0, 1 + (miss - 1) * 3 + near)
    lock_code = np.where(since_lock < EARLY_SPAN, since_lock, EARLY_SPAN + since_lock % RATE_STEADY)
    return np.where(locked, LOCK_AFTER + (rule * _MISS + miss_code) * _SINCE + lock_code, seen)


def decode(code):
    locked = code >= LOCK_AFTER
    body = np.where(locked, code - LOCK_AFTER, 0)
    lock_code, rest = body % _SINCE, body // _SINCE
    miss_code, rule = rest % _MISS, rest // _MISS
    since_lock = np.where(lock_code < EARLY_SPAN, lock_code, RATE_STEADY + lock_code - EARLY_SPAN)
    miss = np.where(miss_code == 0, 0, 1 + (miss_code - 1) // 3)
    near = np.where(miss_code == 0, 0, (miss_code - 1) % 3)
    since_miss = np.where(near < 2, since_lock % RATE_AFTER_MISMATCH + RATE_AFTER_MISMATCH * near, AFTER_MISMATCH_SPAN)
    return locked, np.where(locked, 0, code), rule, miss, since_lock, np.where(miss == 0, 0, since_miss)


def gap_to_spot_check(miss, since_lock, since_miss):
    """Events that pass unchecked before the next spot check of a locked container."""
    far = np.iinfo(np.int64).max // 4
    to_25 = -(since_lock + 1) % RATE_AFTER_MISMATCH
    quick = np.where((miss > 0) & (since_miss + to_25 < AFTER_MISMATCH_SPAN), to_25, far)
    settled = np.where(miss > 0, np.maximum(AFTER_MISMATCH_SPAN - since_miss, 0), 0)
    to_50 = settled + -(since_lock + settled + 1) % RATE_EARLY
    early = np.where(since_lock + to_50 < EARLY_SPAN, to_50, far)
    start = np.maximum(settled, EARLY_SPAN - since_lock)
    steady = start + -(since_lock + start + 1) % RATE_STEADY
    return np.minimum(np.minimum(quick, early), steady)


def advance(states: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Exit state of a chunk for many entry states at once. ``rules`` holds the rule number that
    each event resolves to on its own, ``NO_RULE`` for none. Moves from decision to decision."""
    n = len(rules)
    resolved = np.flatnonzero(rules != NO_RULE)
    count_before = np.concatenate([[0], np.cumsum(rules != NO_RULE)])
    locked, seen, rule, miss, since_lock, since_miss = (np.array(a) for a in decode(states.astype(np.int64)))
    at = np.zeros(len(states), dtype=np.int64)
    live = np.flatnonzero(at < n)
    while len(live):
        sampling = live[~locked[live]]
        if len(sampling):
            nth = count_before[at[sampling]] + LOCK_AFTER - seen[sampling] - 1
            reach = nth < len(resolved)
            stay, move = sampling[~reach], sampling[reach]
            seen[stay] += count_before[n] - count_before[at[stay]]
            at[stay] = n
            hit = resolved[nth[reach]]
            locked[move], rule[move], at[move] = True, rules[hit], hit + 1
            seen[move] = miss[move] = since_lock[move] = since_miss[move] = 0
        held = live[locked[live] & (at[live] < n)]
        if len(held):
            gap = gap_to_spot_check(miss[held], since_lock[held], since_miss[held])
            left = n - at[held]
            out = held[gap >= left]
            since_lock[out] += n - at[out]
            since_miss[out] += n - at[out]
            at[out] = n
            checked, gap = held[gap < left], gap[gap < left]
            spot = at[checked] + gap
            since_lock[checked] += gap + 1
            good = rules[spot] == rule[checked]
            since_miss[checked] = np.where(good, since_miss[checked] + gap + 1, 0)
            miss[checked] += ~good
            at[checked] = spot + 1
            broken = checked[miss[checked] >= MISMATCH_LIMIT]
            locked[broken] = False
            seen[broken] = rule[broken] = miss[broken] = since_lock[broken] = since_miss[broken] = 0
        since_lock = np.where(since_lock >= EARLY_SPAN + 2 * RATE_STEADY, RATE_STEADY + since_lock % RATE_STEADY, since_lock)
        live = live[at[live] < n]
    return encode(locked, seen, rule, miss, since_lock, since_miss)


def replay(state: int, rules: np.ndarray):
    """Flags per event of a chunk (locked before it, spot check, mismatch, locks, unlocks), the rule
    used per event, and the exit state."""
    n = len(rules)
    used, was_locked = rules.copy(), np.zeros(n, dtype=bool)
    spots, misses, locks, unlocks = (np.zeros(n, dtype=bool) for _ in range(4))
    resolved = np.flatnonzero(rules != NO_RULE)
    locked, seen, rule, miss, since_lock, since_miss = (int(a) for a in decode(np.int64(state)))
    at = 0
    while at < n:
        if not locked:
            nth = np.searchsorted(resolved, at) + LOCK_AFTER - seen - 1
            if nth >= len(resolved):
                seen += len(resolved) - int(np.searchsorted(resolved, at))
                break
            at = int(resolved[nth]) + 1
            locks[at - 1] = True
            locked, seen, rule, miss, since_lock, since_miss = 1, 0, int(rules[at - 1]), 0, 0, 0
            continue
        gap = int(gap_to_spot_check(np.int64(miss), np.int64(since_lock), np.int64(since_miss)))
        end = min(at + gap, n)
        used[at:end] = rule
        was_locked[at : min(end + 1, n)] = True
        since_lock += end - at
        since_miss += end - at
        at = end
        if at == n:
            break
        spots[at] = True
        since_lock += 1
        if rules[at] == rule:
            since_miss += 1
        else:
            misses[at] = True
            miss, since_miss = miss + 1, 0
            if miss >= MISMATCH_LIMIT:
                unlocks[at] = True
                locked, seen, rule, miss, since_lock, since_miss = 0, 0, 0, 0, 0, 0
        at += 1
    last = encode(*(np.int64(a) for a in (locked, seen, rule, miss, since_lock, since_miss)))
    return {"was_locked": was_locked, "spot_check": spots, "mismatch": misses, "locks": locks, "unlocks": unlocks}, used, int(last)


# --- the distributed operator -----------------------------------------------------------


def _rule_numbers(pdf: pd.DataFrame, versions: list[str]) -> np.ndarray:
    return pd.Categorical(pdf["rule_version_id"], categories=versions).codes.astype(np.int64)


def entry_states(tables: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Entry state of every chunk: (container, chunk, entry) from (container, chunk, start, table).

    A container with more than ``fan_in`` chunks is folded block-wise first, recursively, so no
    task ever holds more than ``fan_in`` tables of one container.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, entries = int(pdf["start"].iloc[0]), []
        for blob in pdf["table"]:
            entries.append(state)
            state = int(np.frombuffer(blob, dtype=np.int32)[state])
        return pd.DataFrame({"container": pdf["container"], "chunk": pdf["chunk"], "entry": entries})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        whole = None
        for blob in pdf["table"]:
            table = np.frombuffer(blob, dtype=np.int32)
            whole = table if whole is None else table[whole]
        row = pdf.iloc[0]
        return pd.DataFrame({"container": [row["container"]], "chunk": [row["block"]], "start": [row["start"]], "table": [whole.tobytes()]})

    schema = "container string, chunk long, entry long"
    most = tables.groupBy("container").count().agg(F.max("count")).first()[0] or 0
    if most <= fan_in:
        return tables.groupBy("container").applyInPandas(walk, schema)
    blocked = tables.withColumn("block", F.floor(F.col("chunk") / fan_in))
    upper = cut_lineage(
        blocked.groupBy("container", "block").applyInPandas(compose, "container string, chunk long, start long, table binary")
    )
    starts = entry_states(upper, fan_in).select("container", F.col("chunk").alias("block"), F.col("entry").alias("start"))
    lower = blocked.drop("start").join(starts, ["container", "block"])
    return lower.groupBy("container", "block").applyInPandas(walk, schema)


def rule_lock(
    events: DataFrame,
    container: str,
    order: str,
    versions: list[str],
    version: str = "rule_version_id",
    initial: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Lock decisions per event: the rule version used, what the event resolves to by itself (``own_rule``), and how the lock stood.

    ``version`` holds what each event resolves to by itself (null for none); ``versions`` is the
    catalogue's list of rule versions; ``initial`` carries lock states from earlier batches.
    """
    versions = sorted(versions)
    narrow = events.filter(F.col(container).isNotNull()).select(
        F.col(container).alias("container"), F.col(order).alias("position"), "trace_id", F.col(version).alias("rule_version_id")
    )
    parts = max(1, math.ceil(narrow.count() / chunk_rows))
    placed = cut_lineage(
        narrow.repartitionByRange(parts, "container", "position").withColumn("chunk", F.spark_partition_id().cast("long"))
    )
    starts = _start_codes(initial, versions, placed)
    spans = placed.groupBy("container").agg(F.min("chunk").alias("_a"), F.max("chunk").alias("_b")).filter("_a < _b")
    # A container that spans chunks touches a partition edge: there are fewer of them than chunks.
    spanning = placed.join(spans.select("container"), "container", "left_semi")
    schema = "container string, chunk long, start long, table binary"

    def table_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        table = advance(np.arange(state_count(len(versions))), _rule_numbers(pdf, versions)).astype(np.int32)
        row = pdf.iloc[0]
        return pd.DataFrame({"container": [row["container"]], "chunk": [row["chunk"]], "start": [row["start"]], "table": [table.tobytes()]})

    if parts == 1:
        entries = starts.select("container", F.lit(0).cast("long").alias("chunk"), F.col("start").alias("entry"))
    else:
        tables = cut_lineage(
            spanning.join(starts, "container", "left").fillna(0, ["start"]).groupBy("container", "chunk").applyInPandas(table_of, schema)
        )
        inside = entry_states(tables, fan_in)
        alone = placed.select("container", "chunk").distinct().join(spans.select("container"), "container", "left_anti")
        whole = alone.join(starts, "container", "left").select("container", "chunk", F.coalesce("start", F.lit(0)).alias("entry"))
        entries = inside.unionByName(whole)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        flags, used, _ = replay(int(pdf["entry"].iloc[0]), _rule_numbers(pdf, versions))
        names = np.array([*versions, None], dtype=object)
        return pd.DataFrame(
            {
                "container": pdf["container"].to_numpy(), "position": pdf["position"].to_numpy(), "trace_id": pdf["trace_id"].to_numpy(),
                "rule_version_id": names[used], "own_rule": pdf["rule_version_id"].to_numpy(), **flags,
            }
        )

    position_type = dict(placed.dtypes)["position"]
    out = (
        f"container string, position {position_type}, trace_id string, rule_version_id string, own_rule string, "
        "was_locked boolean, spot_check boolean, mismatch boolean, locks boolean, unlocks boolean"
    )
    ready = placed.join(entries, ["container", "chunk"], "left").fillna(0, ["entry"])
    return ready.groupBy("container", "chunk").applyInPandas(decide, out)


def _start_codes(initial: DataFrame | None, versions: list[str], placed: DataFrame) -> DataFrame:
    """Entry code per container from carried lock states."""
    if initial is None:
        return placed.sparkSession.createDataFrame([], "container string, start long")
    rule = F
    for i, name in enumerate(versions):
        rule = rule.when(F.col("rule_version_id") == name, i)
    near = F.least(F.floor(F.col("events_since_mismatch") / RATE_AFTER_MISMATCH), F.lit(2))
    miss = F.when(F.col("mismatch_count") == 0, 0).otherwise(1 + (F.col("mismatch_count") - 1) * 3 + near)
    since = F.when(F.col("events_since_lock") < EARLY_SPAN, F.col("events_since_lock")).otherwise(
        EARLY_SPAN + F.col("events_since_lock") % RATE_STEADY
    )
    locked_code = LOCK_AFTER + (rule.otherwise(None) * _MISS + miss) * _SINCE + since
    code = F.when(F.col("status") == "LOCKED", locked_code).otherwise(F.col("sample_count_seen"))
    return initial.select("container", F.coalesce(code, F.lit(0)).cast("long").alias("start"))


def lock_states(decisions: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Lock row per container after the decisions: status, rule and exact counters.

    The current episode starts after the last lock or unlock event; its counters are plain counts
    over the events behind that point, plus the carried ones when the batch held no such event.
    """
    carried = initial if initial is not None else decisions.sparkSession.createDataFrame([], STATE_SCHEMA)
    carried = carried.select("container", *[F.col(c).alias("_" + c) for c in carried.columns if c != "container"])
    at = F.col("position")
    edges = decisions.groupBy("container").agg(
        F.max(F.when(F.col("locks"), at)).alias("_lock_at"),
        F.max(F.when(F.col("unlocks"), at)).alias("_unlock_at"),
        F.max(F.when(F.col("mismatch") & ~F.col("unlocks"), at)).alias("_miss_at"),
        F.max_by("rule_version_id", F.when(F.col("locks"), at)).alias("_lock_rule"),
    )
    edges = edges.withColumn("_from", F.greatest("_lock_at", "_unlock_at"))
    behind = F.col("_from").isNull() | (at > F.col("_from"))
    counts = lookup_join(decisions, edges.select("container", "_from", "_miss_at"), "container", "inner").groupBy("container").agg(
        F.count_if(behind).alias("_events"),
        F.count_if(behind & F.col("mismatch")).alias("_misses"),
        F.count_if(behind & F.col("rule_version_id").isNotNull()).alias("_resolved"),
        F.count_if(at > F.col("_miss_at")).alias("_after_miss"),
    )
    row = edges.join(counts, "container").join(carried, "container", "left")
    kept = F.col("_from").isNull()
    locked = F.when(kept, F.coalesce(F.col("_status") == "LOCKED", F.lit(False))).otherwise(
        F.col("_lock_at").isNotNull() & (F.col("_lock_at") == F.col("_from"))
    )

    def plus(count: Column, name: str) -> Column:
        return count + F.when(kept, F.coalesce(F.col(name), F.lit(0))).otherwise(0)

    missed_here = F.col("_miss_at").isNotNull() & (kept | (F.col("_miss_at") > F.col("_from")))
    return row.select(
        "container",
        F.when(locked, "LOCKED").otherwise("SAMPLING").alias("status"),
        F.when(locked, F.when(kept, F.col("_rule_version_id")).otherwise(F.col("_lock_rule"))).alias("rule_version_id"),
        F.when(locked, LOCK_AFTER).otherwise(plus(F.col("_resolved"), "_sample_count_seen")).cast("int").alias("sample_count_seen"),
        F.when(locked, plus(F.col("_misses"), "_mismatch_count")).otherwise(0).cast("int").alias("mismatch_count"),
        F.when(locked, plus(F.col("_events"), "_events_since_lock")).otherwise(0).cast("bigint").alias("events_since_lock"),
        F.when(
            locked, F.when(missed_here, F.col("_after_miss")).otherwise(plus(F.col("_events"), "_events_since_mismatch"))
        ).otherwise(0).cast("bigint").alias("events_since_mismatch"),
    )
