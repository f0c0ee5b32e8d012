"""Run unresolved events again once a rule covers them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.engine import RuleSet
from loglattice.operators.pipeline import BatchResult, process_batch
from loglattice.session import lookup_join, written
from loglattice.sources.vault import fetch_raw


def reprocess_select(unresolved: DataFrame, bindings: DataFrame, rule_id: str | None = None, fingerprint: str | None = None) -> DataFrame:
    """Unresolved events of one fingerprint, or of every fingerprint bound to a rule (none bound: none)."""
    if fingerprint:
        return unresolved.filter(F.col("fingerprint") == fingerprint)
    if rule_id is None:
        return unresolved
    bound = bindings.filter(F.col("rule_id") == rule_id).select("fingerprint").distinct()
    return lookup_join(unresolved, bound, "fingerprint", "left_semi")


@dataclass
class Reprocessed:
    result: BatchResult
    still_unresolved: DataFrame
    missing_raw: DataFrame


def reprocess_apply(
    selected: DataFrame, unresolved: DataFrame, raw: DataFrame, rules: RuleSet, bindings: DataFrame, sources: DataFrame | None = None
) -> Reprocessed:
    """Fetch raw lines of the selected events and run them through the pipeline.

    Events without a raw row stay unresolved and are counted. Job and session ids are kept. The vault is
    read once, by the addresses of the selected events; later steps read what was fetched.
    """
    events = written(fetch_raw(raw, selected), "backlog")
    result = process_batch(events, rules, bindings, sources)
    fetched = events.select("trace_id").distinct()
    missing = lookup_join(selected, fetched, "trace_id", "left_anti")
    still = lookup_join(unresolved, fetched, "trace_id", "left_anti")
    return Reprocessed(result, still, missing)


def auto_reprocess(
    unresolved: DataFrame, raw: DataFrame, rules: RuleSet, bindings: DataFrame, activated_rule_id: str, sources: DataFrame | None = None
) -> Reprocessed:
    """Backlog of a rule that has just become active."""
    selected = reprocess_select(unresolved, bindings, rule_id=activated_rule_id)
    return reprocess_apply(selected, unresolved, raw, rules, bindings, sources)
