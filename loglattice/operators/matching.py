"""Matching lines to rules: fingerprint lookup, discovery in arrival order, new bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.engine import RuleSet
from loglattice.session import cut_lineage, lookup_join

BINDING_SCHEMA = "rule_id string, fingerprint string, created_at timestamp"


def fingerprint_map(bindings: DataFrame, rules: RuleSet) -> DataFrame:
    """Fingerprint to rule version: the oldest binding whose rule is active, one row per fingerprint."""
    chosen = rules.known_bindings(bindings).groupBy("fingerprint").agg(
        F.min_by("rule_id", F.struct("created_at", "rule_id")).alias("_rule_id")
    )
    return rules.bound_versions(chosen)


def match_by_fingerprint(
    events: DataFrame, bindings: DataFrame, rules: RuleSet, tenant: str | None = None, out: str = "rule_version_id"
) -> DataFrame:
    """Left lookup of the rule version bound to the fingerprint; events never shuffle while the
    binding table is provably small; a larger one meets them by sort-merge join."""
    joined = lookup_join(events, fingerprint_map(bindings, rules), "fingerprint", "left")
    hit = F.col("_bound")
    if tenant:
        hit = F.when(F.col("_bound_tenant") == F.col(tenant), hit)
    return joined.withColumn(out, hit).drop("_bound", "_bound_tenant")


def discover_rule(events: DataFrame, rules: RuleSet, raw: str, tenant: str | None = None, out: str = "candidate") -> DataFrame:
    """First rule, in catalogue order, that parses and validates the line."""
    return rules.first_passing(events, raw, tenant, out)


def first_passes(unmatched: DataFrame, rules: RuleSet, raw: str, order: str, tenant: str | None = None) -> DataFrame:
    """Per unmatched fingerprint: where the first line passes any rule, and which rule that is.

    A hash aggregate with map-side partials, so a fingerprint that holds a third of all lines
    still reaches the reducer as one row per task. The earliest line of every fingerprint is tried
    first: where it passes nothing earlier can, and the other lines need not be parsed with all rules.
    Where it fails the others are tried, and it is not tried again.
    """
    earliest = unmatched.groupBy("fingerprint").agg(F.min(order).alias(order))
    earliest = cut_lineage(earliest)
    tried = lookup_join(unmatched, earliest, ["fingerprint", order], "left_semi")
    settled = cut_lineage(rules.first_passes(tried, raw, order, tenant))
    rest = lookup_join(unmatched, settled.select("fingerprint"), "fingerprint", "left_anti")
    rest = lookup_join(rest, earliest.withColumnRenamed(order, "_tried"), "fingerprint")
    rest = rest.filter((F.col(order) > F.col("_tried")) | F.col(order).isNull() | F.col("_tried").isNull()).drop("_tried")
    return settled.unionByName(rules.first_passes(rest, raw, order, tenant))


def discovery_timeline(
    events: DataFrame, rules: RuleSet, raw: str, order: str, tenant: str | None = None,
    out: str = "rule_version_id", first: DataFrame | None = None,
) -> DataFrame:
    """Give unmatched lines the rule discovered by the first passing line of their fingerprint.

    Lines before that first pass stay without a rule; later ones carry it even if they fail.
    ``events`` already has the looked-up version in ``out``; null there means unmatched.
    """
    if first is None:
        unmatched = events.filter(F.col(out).isNull())
        first = cut_lineage(first_passes(unmatched, rules, raw, order, tenant))
    joined = lookup_join(events, first, "fingerprint", "left")
    found = F.when(F.col(order) >= F.col("_first"), F.col("_discovered"))
    return joined.withColumn(out, F.coalesce(F.col(out), found)).drop("_first", "_discovered")


def bind_fingerprint(first: DataFrame, bindings: DataFrame, rules: RuleSet, at: str = "_first") -> DataFrame:
    """New (rule, fingerprint) bindings that discovery adds; existing ones are left out."""
    fresh = rules.add_rule_ids(first.select("fingerprint", "_discovered"), "_discovered").select("rule_id", "fingerprint").dropDuplicates(["rule_id", "fingerprint"])
    return fresh.join(bindings.select("rule_id", "fingerprint"), ["rule_id", "fingerprint"], "left_anti")


def processed_ids(*outcomes: DataFrame) -> DataFrame:
    """Distinct trace ids over the outcome tables."""
    ids = outcomes[0].select("trace_id")
    for table in outcomes[1:]:
        ids = ids.unionByName(table.select("trace_id"))
    return ids.distinct()


def skip_processed(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose trace id has no outcome yet."""
    return events.join(ids.select("trace_id"), "trace_id", "left_anti")
