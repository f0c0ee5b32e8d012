"""The batch pipeline: raw events to one outcome row per event."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.text import fingerprint
from loglattice.operators.engine import RuleSet
from loglattice.operators.lock import rule_lock
from loglattice.operators.matching import (
    bind_fingerprint, discovery_timeline, first_passes, match_by_fingerprint, processed_ids, skip_processed,
)
from loglattice.operators.normalize import normalize, vendor_namespace
from loglattice.session import cut_lineage, lookup_join, settle, written

DEFAULT_TENANT = "default"


@dataclass
class BatchResult:
    """Outcome rows, the bindings that discovery added, and the lock decisions if a lock ran."""

    processed: DataFrame
    new_bindings: DataFrame
    decisions: DataFrame | None = None


def with_source(events: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Tenant and vendor namespace of each event's source."""
    if sources is None:
        return events.withColumns(
            {"tenant_id": F.lit(DEFAULT_TENANT), "namespace": vendor_namespace(F.lit(None).cast("string"), F.lit(None).cast("string"))}
        )
    dims = sources.select("source_id", "tenant_id", vendor_namespace(F.col("namespace"), F.col("vendor")).alias("namespace"))
    joined = lookup_join(events, dims, "source_id", "left")
    return joined.withColumn("namespace", F.coalesce(F.col("namespace"), F.lit("vendor")))


def with_fingerprint(events: DataFrame, line: str = "line") -> DataFrame:
    """Fingerprint scoped by source; a fingerprint stored at ingest is used as it is."""
    if "fingerprint" in events.columns:
        return events
    return events.withColumn("fingerprint", _scoped_fingerprint(line))


@cache
def _scoped_fingerprint(line: str) -> Column:
    return settle(fingerprint(F.col(line), F.col("source_id")))


def resolve_rules(
    events: DataFrame, rules: RuleSet, bindings: DataFrame, sources: DataFrame | None = None, order: str = "seq", discovery: bool = True,
    whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rule version per event by fingerprint and discovery, and the bindings discovery adds.

    Discovery passes several times over the events that no binding knows, so what it needs of those is
    written first, unless events store their fingerprint. The fingerprints are worked out again in the pass
    that returns the events; with ``whole``, where several passes follow, whole events are written instead.
    """
    stored = "fingerprint" in events.columns
    events = with_fingerprint(with_source(events, sources))
    matched = match_by_fingerprint(events, bindings, rules, "tenant_id")
    if discovery and rules.rules and not stored and whole:
        matched = written(matched, "matched")
    if not (discovery and rules.rules):
        return matched, events.sparkSession.createDataFrame([], "rule_id string, fingerprint string")
    unmatched = matched.filter(F.col("rule_version_id").isNull())
    if not stored and not whole:
        unmatched = written(unmatched.select("fingerprint", order, "line", "tenant_id"), "unmatched", "zstd")
    first = cut_lineage(first_passes(unmatched, rules, "line", order, "tenant_id"))
    return discovery_timeline(matched, rules, "line", order, "tenant_id", first=first), bind_fingerprint(first, bindings, rules)


def apply_decisions(matched: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events of locked containers take the rule the lock decided on; others keep their own.

    Only decisions that differ from the event's own rule are joined; they are few, and broadcast when
    proven so, so events and payloads stay where they are.
    """
    changed = decisions.filter(~F.col("rule_version_id").eqNullSafe(F.col("own_rule"))) if "own_rule" in decisions.columns else decisions
    choice = changed.select("trace_id", F.col("rule_version_id").alias("_locked"), F.lit(True).alias("_decided"))
    joined = lookup_join(matched, choice, "trace_id")
    version = F.when(F.col("_decided"), F.col("_locked")).otherwise(F.col("rule_version_id"))
    return joined.withColumn("rule_version_id", version).drop("_locked", "_decided")


def process_batch(
    events: DataFrame,
    rules: RuleSet,
    bindings: DataFrame,
    sources: DataFrame | None = None,
    prior: list[DataFrame] | None = None,
    order: str = "seq",
    discovery: bool = True,
    container: str | None = None,
    lock_state: DataFrame | None = None,
) -> BatchResult:
    """Run the whole pipeline over a batch.

    ``prior`` holds earlier outcome tables: events that already have an outcome are skipped. With
    ``container`` (job_id or session_id) the rule lock runs, starting from ``lock_state``.
    """
    if prior:
        events = skip_processed(events, processed_ids(*prior))
    matched, fresh = resolve_rules(events, rules, bindings, sources, order, discovery, whole=container is not None)
    decisions = None
    if container:
        versions = [rule.rule_version_id for rule in rules.rules]
        decisions = cut_lineage(rule_lock(matched, container, order, versions, initial=lock_state))
        matched = apply_decisions(matched, decisions)
    parsed = rules.parse_and_check(matched, "line", "rule_version_id")
    return BatchResult(normalize(parsed, rules), fresh, decisions)
