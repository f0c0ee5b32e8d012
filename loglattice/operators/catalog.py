"""Rule catalogue over tables: versions, lifecycle fold, bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.ranking import WINDOW_MAX_ROWS, first_per_group, next_after, number_rows
from loglattice.operators.rules import rule_hash

# Lifecycle event names.
VERSION_CREATED = "VERSION_CREATED"
STATUS_PREFIX = "STATUS_CHANGED_TO_"
RULE_DISABLED = "RULE_DISABLED"
RULE_ARCHIVED = "RULE_ARCHIVED"
ACTIVATED = STATUS_PREFIX + "ACTIVE"


def latest_rule_version(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """Every rule with its newest version of any status; version 1 and schema 'unknown' when it has none."""
    newest = versions.groupBy("rule_id").agg(
        F.max("version").alias("_v"), F.max_by("target_schema", "version").alias("_s")
    )
    joined = rules.join(newest, "rule_id", "left")
    return joined.withColumns(
        {"version": F.coalesce("_v", F.lit(1)), "target_schema": F.when(F.col("_v").isNull(), "unknown").otherwise(F.col("_s"))}
    ).drop("_v", "_s")


def active_rule_version(versions: DataFrame) -> DataFrame:
    """Newest ACTIVE version per rule."""
    return first_per_group(versions.filter(F.col("status") == "ACTIVE"), ["rule_id"], [F.desc("version")])


def next_version(versions: DataFrame, requests: DataFrame, order: str, max_group: int = WINDOW_MAX_ROWS) -> DataFrame:
    """Number new versions of each rule after the highest existing one, in request order."""
    top = versions.groupBy("rule_id").agg(F.max("version").alias("_top"))
    numbered = number_rows(requests, ["rule_id"], [F.col(order)], "_n", max_group)
    joined = numbered.join(top, "rule_id", "left")
    return joined.withColumn("version", F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_top", "_n")


def version_history(versions: DataFrame, rule_id: str) -> DataFrame:
    """Versions of one rule, newest first."""
    return versions.filter(F.col("rule_id") == rule_id).orderBy(F.desc("version"))


def new_versions(versions: DataFrame, requests: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Draft rows for requested versions (numbered and hashed) and their lifecycle events."""
    drafts = next_version(versions, requests, order).withColumns({"rule_hash": rule_hash(), "status": F.lit("DRAFT")})
    drafts = drafts.withColumn("rule_version_id", F.sha2(F.concat_ws("|", "rule_id", "version", "rule_hash"), 256))
    events = drafts.select("rule_id", "rule_version_id", F.lit(VERSION_CREATED).alias("event_type"), F.col(order).alias("position"))
    return drafts, events


def catalog_snapshot(log: DataFrame, max_group: int = WINDOW_MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """Status of every version and rule after folding the lifecycle log.

    ``log`` has rule_id, rule_version_id (null for rule events), event_type, position (unique,
    increasing per rule). A version's last own event gives its status; what happened to the rule
    after it decides the rest: another activation deprecates an ACTIVE version, disabling stops
    ACTIVE ones, archiving takes ACTIVE and DISABLED ones.
    """
    at, kind = F.col("position"), F.col("event_type")
    ahead = next_after(
        log, ["rule_id"], "position",
        {
            "_activated": F.when(kind == ACTIVATED, at),
            "_disabled": F.when(kind == RULE_DISABLED, at),
            "_archived": F.when(kind == RULE_ARCHIVED, at),
        },
        max_group,
    )
    own = ahead.filter(F.col("rule_version_id").isNotNull())
    rest = ["event_type", "_activated", "_disabled", "_archived"]
    last = own.groupBy("rule_id", "rule_version_id").agg(F.max_by(F.struct(*rest), "position").alias("l"))
    last = last.select("rule_id", "rule_version_id", "l.*")
    archived_last = log.filter(kind == RULE_ARCHIVED).groupBy("rule_id").agg(F.max("position").alias("_last_archive"))
    last = last.join(archived_last, "rule_id", "left")
    base = F.when(F.col("event_type") == VERSION_CREATED, "DRAFT").otherwise(F.replace(F.col("event_type"), F.lit(STATUS_PREFIX), F.lit("")))
    first = F.least("_activated", "_disabled", "_archived")
    disabled_then = F.when(F.col("_last_archive") > F.col("_disabled"), "ARCHIVED").otherwise("DISABLED")
    status = (
        F.when(base == "ACTIVE",
               F.when(first.isNull(), "ACTIVE")
               .when(first == F.col("_activated"), "DEPRECATED")
               .when(first == F.col("_disabled"), disabled_then)
               .otherwise("ARCHIVED"))
        .when((base == "DISABLED") & F.col("_archived").isNotNull(), "ARCHIVED")
        .otherwise(base)
    )
    versions = last.select("rule_id", "rule_version_id", status.alias("status"))
    rule_event = F.when(kind == ACTIVATED, "ACTIVE").when(kind == RULE_DISABLED, "DISABLED").when(kind == RULE_ARCHIVED, "ARCHIVED")
    rules = log.groupBy("rule_id").agg(
        F.coalesce(F.max_by(rule_event, F.when(rule_event.isNotNull(), at)), F.lit("DRAFT")).alias("rule_status")
    )
    return versions, rules
