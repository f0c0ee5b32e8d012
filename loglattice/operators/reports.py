"""Read queries over the outcome tables: lists, pages, progress, integrity, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.ids import digest_verified, storage_uri
from loglattice.functions.text import raw_as_json_or_text
from loglattice.operators.normalize import FAST_PATH, UNRESOLVED_PATH
from loglattice.operators.ranking import number_rows
from loglattice.session import cut_lineage, lookup_join


def rule_label(name: Column, version: Column) -> Column:
    """``name@version``, the bare name, or null; empty names and version 0 count as missing."""
    named = F.nullif(name, F.lit(""))
    return F.when(version.isNotNull() & (version != 0), F.concat(named, F.lit("@"), version.cast("string"))).otherwise(named)


# --- filters ---------------------------------------------------------------------


def event_filters(events: DataFrame, source_id: str | None = None, rule_id: str | None = None, processing_path: str | None = None) -> DataFrame:
    """Optional equality filters; over stored tables all of them reach the Parquet scan."""
    for name, value in (("source_id", source_id), ("rule_id", rule_id), ("processing_path", processing_path)):
        if value:
            events = events.filter(F.col(name) == value)
    return events


def tenant_scope(rows: DataFrame, sources: DataFrame, tenant_id: str) -> DataFrame:
    """Rows whose source belongs to the tenant."""
    mine = sources.filter(F.col("tenant_id") == tenant_id).select("source_id").distinct()
    return lookup_join(rows, mine, "source_id", "left_semi")


def source_search(sources: DataFrame, query: str = "", transport: str = "all") -> DataFrame:
    """Case-insensitive text search over name, id, vendor and product, and a transport filter."""
    out = sources
    if query:
        needle = F.lit(query.lower())
        hit = F.lit(False)
        for name in ("name", "source_id", "vendor", "product"):
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), needle), F.lit(False))
        out = out.filter(hit)
    if transport != "all":
        out = out.filter(F.lower(F.col("transport")) == transport.lower())
    return out


# --- event lists ------------------------------------------------------------------


def events_with_context(normalized: DataFrame, raw_index: DataFrame | None, sources: DataFrame, rules: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Normalised events with raw address, source check and rule label.

    Address and digest follow from the event's own columns; a raw index is joined only where it is given.
    """
    scoped = tenant_scope(normalized, sources, tenant_id) if tenant_id else lookup_join(
        normalized, sources.select("source_id").distinct(), "source_id", "left_semi"
    )
    names = rules.groupBy("rule_id").agg(F.first("name", ignorenulls=True).alias("_name"))
    if raw_index is None:
        placed = scoped.withColumn("storage_uri", storage_uri(F.col("source_id"), F.col("created_at"), F.col("trace_id")))
        if "raw_reference" in scoped.columns:
            placed = placed.withColumn("digest", F.col("raw_reference")["digest"])
    else:
        placed = scoped.join(raw_index.select("trace_id", "storage_uri", "digest"), "trace_id", "left")
    joined = lookup_join(placed, names, "rule_id", "left")
    return joined.withColumn("rule_name", rule_label(F.col("_name"), F.col("rule_version"))).drop("_name")


def unresolved_with_context(unresolved: DataFrame, raw_index: DataFrame | None, sources: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Unresolved events with their raw address, limited to known sources; the address follows from the event."""
    if raw_index is None:
        joined = unresolved.withColumn("storage_uri", storage_uri(F.col("source_id"), F.col("created_at"), F.col("trace_id")))
    else:
        joined = unresolved.drop("source_id").join(raw_index.select("trace_id", "source_id", "storage_uri"), "trace_id")
    mine = sources.filter(F.col("tenant_id") == tenant_id) if tenant_id else sources
    return lookup_join(joined, mine.select("source_id").distinct(), "source_id", "left_semi")


LIST_COLUMNS = ["id", "created_at", "source_id", "rule_id", "rule_name", "processing_path", "trace_id", "storage_uri"]


def union_outcomes(
    with_context: DataFrame, unresolved_context: DataFrame,
    source_id: str | None = None, rule_id: str | None = None, processing_path: str | None = None,
) -> DataFrame:
    """One list of outcomes; unresolved rows only without a rule filter and for a fitting path."""
    done = event_filters(with_context, source_id, rule_id, processing_path).withColumn("id", F.col("event_id")).select(*LIST_COLUMNS)
    if rule_id or (processing_path and processing_path != UNRESOLVED_PATH):
        return done
    waiting = event_filters(unresolved_context, source_id).withColumn("processing_path", F.lit(UNRESOLVED_PATH))
    waiting = waiting.select(*[c for c in LIST_COLUMNS if c in waiting.columns])
    return done.unionByName(waiting, allowMissingColumns=True)


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page (1-based, 1 to 100 rows): top rows by a partial sort per task, never a full sort."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be at least 1 and size between 1 and 100")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def events_page(outcomes: DataFrame, raw: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Newest outcomes first. The page is cut first and its ids (100 at most) are broadcast, so raw
    rows are scanned but never shuffled, and payloads are rendered for the page alone."""
    cut = cut_lineage(page(outcomes, [F.desc("created_at"), F.col("id")], number, size))
    mine = raw.join(F.broadcast(cut.select("trace_id").distinct()), "trace_id", "left_semi")
    payload = mine.select("trace_id", raw_as_json_or_text(F.col("line")).alias("raw_payload"))
    return cut.join(payload, "trace_id", "left")


def containers_page(containers: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Jobs or sessions, newest start first."""
    return page(containers, [F.desc("started_at"), F.col("id")], number, size)


def source_events_page(normalized: DataFrame, source_id: str, number: int = 1, size: int = 50) -> DataFrame:
    mine = event_filters(normalized, source_id=source_id)
    return page(mine, [F.desc("created_at"), F.col("event_id")], number, size)


def page_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def lock_rule_name(containers: DataFrame, locks: DataFrame, versions: DataFrame, rules: DataFrame) -> DataFrame:
    """Containers with their lock and the label of the locked rule."""
    v = versions.select("rule_version_id", "rule_id", "version")
    names = rules.select("rule_id", F.col("name").alias("_name")).distinct()
    lock = locks.select(F.col("container").alias("id"), F.col("status").alias("lock_status"), "sample_count_seen", "mismatch_count", "rule_version_id")
    joined = lookup_join(lookup_join(containers.join(lock, "id", "left"), v, "rule_version_id"), names, "rule_id")
    label = F.concat(F.col("_name"), F.lit("@"), F.col("version").cast("string"))
    return joined.withColumn("rule_name", label).drop("_name", "version", "rule_id", "rule_version_id")


# --- single events -----------------------------------------------------------------


def event_by_id(normalized: DataFrame, sources: DataFrame, tenant_id: str, event_id: str) -> DataFrame:
    """Point filter; over stored tables the id comparison is pushed to the scan."""
    return tenant_scope(normalized.filter(F.col("event_id") == event_id), sources, tenant_id)


def event_trace(normalized: DataFrame, traces: DataFrame, raw_index: DataFrame) -> DataFrame:
    """Event to raw digest and address, and to the rule that handled it."""
    t = traces.select("trace_id", F.col("rule_id").alias("t_rule"), F.col("rule_version").alias("t_version"), "rule_hash", F.col("schema_version").alias("t_schema"))
    r = raw_index.select("trace_id", "digest", "storage_uri")
    joined = normalized.select("event_id", "trace_id", "processing_path").join(t, "trace_id").join(r, "trace_id", "left")
    return joined.select(
        "event_id", "trace_id",
        F.struct(F.col("digest").alias("sha256"), F.col("storage_uri").alias("reference")).alias("raw"),
        F.struct(F.col("t_rule").alias("id"), F.col("t_version").alias("version"), F.col("rule_hash").alias("hash")).alias("rule"),
        F.col("t_schema").alias("schema_version"),
        F.col("processing_path").alias("processing_mode"),
    )


def event_raw(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """Event to raw row, payload text and digest check."""
    kept = raw.select("trace_id", "source_id", "received_at", "transport", "byte_length", "digest", "storage_uri", "payload", "line")
    joined = normalized.select("event_id", "trace_id").join(kept, "trace_id")
    return joined.select(
        "event_id", "trace_id", "source_id", "received_at", "transport", "byte_length", F.col("digest").alias("sha256"),
        "storage_uri", F.col("line").alias("raw_payload"), digest_verified(F.col("payload"), F.col("digest")).alias("digest_verified"),
    )


def provenance_of(provenance: DataFrame, traces: DataFrame) -> DataFrame:
    """Provenance rows of the given traces."""
    return provenance.join(traces.select("trace_id").distinct(), "trace_id", "left_semi")


# --- aggregates ----------------------------------------------------------------------


def stats_overview(processed: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Totals over one row per outcome, in one pass; integrity failures when raw payloads are given."""
    outcome, path = F.col("outcome"), F.col("processing_path")
    normalized = F.count_if(outcome == "normalized")
    totals = processed.agg(
        F.count_if(outcome.isin("normalized", "unresolved", "dead_letter")).alias("events_ingested"),
        normalized.alias("events_normalized"),
        F.count_if((outcome == "normalized") & (path == FAST_PATH)).alias("fast_events"),
        F.count_if((outcome == "normalized") & (path != FAST_PATH)).alias("adaptive_events"),
        F.count_if(outcome == "unresolved").alias("review_pending"),
        F.count_if(outcome == "dead_letter").alias("dead_letters"),
    )
    if raw is None:
        return totals
    return totals.crossJoin(integrity_report(raw).select("integrity_failures"))


def integrity_report(raw: DataFrame) -> DataFrame:
    """Digest check over the whole raw table."""
    good = digest_verified(F.col("payload"), F.col("digest"))
    return raw.agg(F.count(F.lit(1)).alias("events"), F.count_if(~good).alias("integrity_failures"))


def container_progress(processed: DataFrame, totals: DataFrame, key: str, status: DataFrame | None = None) -> DataFrame:
    """Progress per job or session. ``totals`` has (key, total_events).

    ``normalized_count`` counts dead letters as well; ``normalized_ok`` and ``dead_letter_count``
    tell them apart.
    """
    outcome = F.col("outcome")
    counts = processed.groupBy(key).agg(
        F.count(F.lit(1)).alias("processed_events"),
        F.count_if(outcome != "unresolved").alias("normalized_count"),
        F.count_if(outcome == "unresolved").alias("unresolved_count"),
        F.count_if(outcome == "normalized").alias("normalized_ok"),
        F.count_if(outcome == "dead_letter").alias("dead_letter_count"),
    )
    joined = totals.join(counts, key, "left").fillna(0)
    if status is not None:
        joined = joined.join(status.select(key, "status"), key, "left").withColumn("failed", F.when(F.col("status") == "FAILED", 100).otherwise(0))
    return joined


def source_event_count(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))


def nearest_rank(p: int, n: int) -> int:
    """1-based rank of a percentile: half-even rounding of p/100*n + 0.5, kept within 1..n."""
    return min(n, max(1, round(p / 100.0 * n + 0.5)))


def latency_summary(requests: DataFrame, latency: str = "latency_ms", ok: str = "ok", key: str = "request_id", percentiles=(50, 95, 99)) -> DataFrame:
    """Mean, extremes, nearest-rank percentiles and error rate of measured requests.

    Percentiles are exact: rows are numbered by a distributed sort and three of them are picked.
    """
    value = F.col(latency)
    base = requests.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col(ok)).alias("errors"),
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    total = requests.count()
    numbered = number_rows(requests.select(key, latency), [], [F.col(latency), F.col(key)], "_rank")
    ranks = {p: nearest_rank(p, total) for p in percentiles}
    picked = numbered.filter(F.col("_rank").isin(sorted(set(ranks.values())))).agg(
        *[F.max(F.when(F.col("_rank") == r, value)).alias(f"p{p}") for p, r in ranks.items()]
    )
    rate = F.round(F.lit(100.0) * F.col("errors") / F.greatest(F.col("requests"), F.lit(1)), 2)
    return base.crossJoin(picked).withColumn("error_rate_pct", rate)
