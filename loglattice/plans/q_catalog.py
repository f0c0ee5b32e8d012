"""Queries: sources and sinks, rule catalogue, onboarding, reprocessing, lock, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loglattice.functions.text import fingerprint
from loglattice.operators import catalog, lock, onboarding, reports, reprocess
from loglattice.operators.engine import RuleSet
from loglattice.operators.parsers import Parser, register_parser
from loglattice.operators.parsers.registry import found
from loglattice.operators.rules import RULE_SCHEMA, Rule, active_rules, check_one_active
from loglattice.plans import fixtures as fx
from loglattice.plans.q_events import V, processed
from loglattice.plans.q_text import L, structure_sql
from loglattice.plans.registry import query
from loglattice.session import cut_lineage, ensure_checkpoint_dir
from loglattice.sources.lines import read_log_lines, stream_log_lines
from loglattice.sources.manifest import published
from loglattice.sources.results import SCHEMAS, read_results, write_results, write_search_documents
from loglattice.sources.vault import read_raw_by_uri, read_raw_vault, write_raw_vault
from loglattice.streaming.pipeline import stream_counters, stream_pipeline


def run_dir(spark, name):
    """A fresh folder beside the shared checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/runs/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -----------------------------------------------------------------------------

_DOC_LINES = "(SELECT trim(replace(unnest(string_split(text, chr(10))), chr(13), ''), concat(' ', chr(9), chr(160))) AS line FROM documents)"


@query("read_log_lines", f"SELECT line, count(*) AS n FROM {_DOC_LINES} WHERE line <> '' GROUP BY 1")
def _(spark, sf):
    path = run_dir(spark, "lines")
    fx.table(spark, sf, "documents").select("text").write.text(path)
    return read_log_lines(spark, path, "misc").groupBy("line").agg(F.count("*").alias("n"))


@query("stream_log_lines", f"SELECT line, count(*) AS n FROM {_DOC_LINES} WHERE line <> '' GROUP BY 1")
def _(spark, sf):
    path = run_dir(spark, "stream")
    fx.table(spark, sf, "documents").select("text").repartition(4).write.text(f"{path}/in")
    stream = stream_log_lines(spark, f"{path}/in", 2)
    q = stream.select("line").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("line").agg(F.count("*").alias("n"))


@query("write_raw_vault", f"SELECT source_id, count(*) AS n FROM {L('leef', 'xml', 'noise')} GROUP BY 1")
def _(spark, sf):
    path = run_dir(spark, "vault")
    events = fx.raw_events(spark, sf, "leef", "xml", "noise")
    write_raw_vault(events.filter("kind <> 'leef'"), path)
    write_raw_vault(events, path)  # already stored events are not written again
    return spark.read.parquet(path).groupBy("source_id").agg(F.count("*").alias("n"))


@query("read_raw_vault", f"SELECT trace_id, concat('sha256:', sha256(line)) AS digest FROM {L('xml')}")
def _(spark, sf):
    path = run_dir(spark, "vault")
    events = fx.raw_events(spark, sf, "xml", "leef")
    write_raw_vault(events, path)
    uris = read_raw_vault(spark, path, "win", fx.DEFAULT_TIME[:10]).select("storage_uri")
    return read_raw_by_uri(spark, path, uris).select("trace_id", "digest")


@query("write_results", f"SELECT 'normalized' AS name, count(*) AS n FROM {V('kv', 'xml')} WHERE outcome = 'normalized' UNION ALL SELECT 'dead_letter', count(*) FROM {V('kv', 'xml')} WHERE outcome = 'dead_letter' UNION ALL SELECT 'unresolved', count(*) FROM {V('kv', 'xml')} WHERE outcome = 'unresolved' UNION ALL SELECT 'trace', count(*) FROM {V('kv', 'xml')} UNION ALL SELECT 'provenance', sum(CASE kind WHEN 'kv' THEN 7 ELSE 3 END)::BIGINT FROM {V('kv', 'xml')} WHERE outcome = 'normalized'")
def _(spark, sf):
    path = run_dir(spark, "results")
    write_results(processed(spark, sf, "kv", "xml"), path)
    out = None
    for name, table in read_results(spark, path).items():
        row = table.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("search_doc_files", f"SELECT trace_id FROM {V('csv')}")
def _(spark, sf):
    path = run_dir(spark, "docs")
    write_search_documents(processed(spark, sf, "csv"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.trace_id").alias("trace_id"))


def _versions(spark, sf):
    """A version table that grows with orders: customers are rules, orders their versions."""
    return fx.table(spark, sf, "orders").selectExpr(
        "concat('rule-', cast(o_custkey as string)) AS rule_id", "concat('rv-', cast(o_orderkey as string)) AS rule_version_id", "cast(o_orderkey as int) AS version",
        "CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'DEPRECATED' ELSE 'DRAFT' END AS status", "CASE WHEN o_totalprice > 200000 THEN 'ocsf' ELSE 'ecs' END AS target_schema", "o_orderdate")


_VERS = "(SELECT concat('rule-', cast(o_custkey as varchar)) AS rule_id, concat('rv-', cast(o_orderkey as varchar)) AS rule_version_id, cast(o_orderkey as int) AS version, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'DEPRECATED' ELSE 'DRAFT' END AS status, CASE WHEN o_totalprice > 200000 THEN 'ocsf' ELSE 'ecs' END AS target_schema, o_orderdate FROM orders)"


def _rule_dim(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr("concat('rule-', cast(c_custkey as string)) AS rule_id", "c_name AS name")


@query("read_catalog", "SELECT concat('rv-', cast(p_partkey as varchar)) AS rule_version_id, 'core' AS target_schema, p_size AS version FROM part WHERE p_size > 45")
def _(spark, sf):
    path = run_dir(spark, "catalog")
    rows = fx.table(spark, sf, "part").selectExpr(
        "concat('rv-', cast(p_partkey as string)) AS rule_version_id", "concat('r-', cast(p_partkey as string)) AS rule_id", "p_name AS name", "'default' AS tenant_id", "'ACTIVE' AS rule_status",
        "p_size AS version", "CASE WHEN p_size > 45 THEN 'ACTIVE' ELSE 'DRAFT' END AS status", "'cef' AS parser_type", "'{}' AS parser_definition", "'{\"src\":\"source.ip\"}' AS field_mappings", "'[]' AS required_fields",
        "'{}' AS type_constraints", "'{}' AS masking_policy", "'core' AS target_schema", "'1.0' AS schema_version", "'' AS rule_hash", "timestamp'2024-01-01 00:00:00' AS created_at")
    rows.write.parquet(path)
    stored = spark.read.schema(RULE_SCHEMA).parquet(path)
    return active_rules(stored).select("rule_version_id", "target_schema", "version")


@query("latest_rule_version", f"SELECT c.rule_id, coalesce(v.version, 1) AS version, coalesce(v.target_schema, 'unknown') AS target_schema FROM (SELECT concat('rule-', cast(c_custkey as varchar)) AS rule_id FROM customer) c LEFT JOIN (SELECT rule_id, max(version) AS version, arg_max(target_schema, version) AS target_schema FROM {_VERS} GROUP BY 1) v USING (rule_id)")
def _(spark, sf):
    return catalog.latest_rule_version(_rule_dim(spark, sf), _versions(spark, sf)).select("rule_id", "version", "target_schema")


@query("active_rule_version", f"SELECT rule_id, max(version) AS version FROM {_VERS} WHERE status = 'ACTIVE' GROUP BY 1")
def _(spark, sf):
    return catalog.active_rule_version(_versions(spark, sf)).select("rule_id", "version")


@query("next_version", f"SELECT d.rule_version_id, coalesce(t.top, 0) + row_number() OVER (PARTITION BY d.rule_id ORDER BY d.version) AS version FROM {_VERS} d LEFT JOIN (SELECT rule_id, max(version) AS top FROM {_VERS} WHERE status <> 'DRAFT' GROUP BY 1) t ON d.rule_id = t.rule_id WHERE d.status = 'DRAFT'")
def _(spark, sf):
    v = _versions(spark, sf)
    requests = v.filter("status = 'DRAFT'").withColumnRenamed("version", "asked")
    out = catalog.next_version(v.filter("status <> 'DRAFT'"), requests, "asked", max_group=10)  # small bound: exercises the split path
    return out.select("rule_version_id", F.col("version").cast("long").alias("version"))


@query("version_history", f"SELECT version, status FROM {_VERS} WHERE rule_id = (SELECT min(rule_id) FROM {_VERS})")
def _(spark, sf):
    v = _versions(spark, sf)
    return catalog.version_history(v, v.agg(F.min("rule_id")).first()[0]).select("version", "status")


@query("check_one_active", f"SELECT rule_id, count(*) AS active_versions FROM {_VERS} WHERE status = 'ACTIVE' GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return check_one_active(_versions(spark, sf))


@query("new_versions", "SELECT p_brand AS rule_id, count(*) AS drafts, max(n) AS top FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) GROUP BY 1")
def _(spark, sf):
    requests = fx.table(spark, sf, "part").selectExpr(
        "p_brand AS rule_id", "p_partkey AS asked", "'cef' AS parser_type", "'{}' AS parser_definition", "concat('{\"src\":\"', p_type, '\"}') AS field_mappings", "'[]' AS required_fields",
        "'{}' AS type_constraints", "'{}' AS masking_policy", "'ocsf' AS target_schema", "'1.0' AS schema_version")
    none = spark.createDataFrame([], "rule_id string, version int")
    drafts, log = catalog.new_versions(none, requests, "asked")
    joined = drafts.join(log.select("rule_version_id", "event_type"), "rule_version_id")
    return joined.groupBy("rule_id").agg(F.count("*").alias("drafts"), F.max("version").cast("long").alias("top"))


_LOG = """SELECT concat('rule-', cast(o_custkey as {s})) AS rule_id, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'O' THEN NULL ELSE concat('rv-', cast(o_custkey as {s}), '-', o_orderstatus) END AS rule_version_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'STATUS_CHANGED_TO_ACTIVE' WHEN '2-HIGH' THEN 'STATUS_CHANGED_TO_ACTIVE' WHEN '3-MEDIUM' THEN 'STATUS_CHANGED_TO_PENDING_REVIEW' WHEN '4-NOT SPECIFIED' THEN 'VERSION_CREATED'
 ELSE CASE o_orderstatus WHEN 'O' THEN 'STATUS_CHANGED_TO_DISABLED' WHEN 'F' THEN 'RULE_DISABLED' ELSE 'RULE_ARCHIVED' END END AS event_type, o_orderkey AS position FROM orders"""
_FOLD = f"""WITH log AS ({_LOG.format(s='varchar')}),
 own AS (SELECT rule_id, rule_version_id, max(position) AS at, arg_max(event_type, position) AS e FROM log WHERE rule_version_id IS NOT NULL GROUP BY 1, 2),
 nxt AS (SELECT o.*, (SELECT min(position) FROM log l WHERE l.rule_id = o.rule_id AND l.position > o.at AND l.event_type = 'STATUS_CHANGED_TO_ACTIVE') AS a,
  (SELECT min(position) FROM log l WHERE l.rule_id = o.rule_id AND l.position > o.at AND l.event_type = 'RULE_DISABLED') AS d,
  (SELECT min(position) FROM log l WHERE l.rule_id = o.rule_id AND l.position > o.at AND l.event_type = 'RULE_ARCHIVED') AS r,
  (SELECT max(position) FROM log l WHERE l.rule_id = o.rule_id AND l.event_type = 'RULE_ARCHIVED') AS lr FROM own o)
 SELECT rule_version_id, CASE WHEN e = 'STATUS_CHANGED_TO_ACTIVE' THEN CASE WHEN a IS NULL AND d IS NULL AND r IS NULL THEN 'ACTIVE' WHEN a <= coalesce(least(d, r), a) THEN 'DEPRECATED' WHEN d <= coalesce(r, d) AND d IS NOT NULL THEN CASE WHEN lr > d THEN 'ARCHIVED' ELSE 'DISABLED' END ELSE 'ARCHIVED' END
  WHEN e = 'STATUS_CHANGED_TO_DISABLED' AND r IS NOT NULL THEN 'ARCHIVED' WHEN e = 'VERSION_CREATED' THEN 'DRAFT' ELSE replace(e, 'STATUS_CHANGED_TO_', '') END AS status FROM nxt"""


def _log(spark, sf):
    fx.table(spark, sf, "orders").createOrReplaceTempView("_log_orders")
    return spark.sql(_LOG.format(s="string").replace("FROM orders", "FROM _log_orders"))


@query("catalog_snapshot", _FOLD)
def _(spark, sf):
    return catalog.catalog_snapshot(_log(spark, sf))[0].select("rule_version_id", "status")


@query("catalog_snapshot_split", _FOLD)
def _(spark, sf):
    return catalog.catalog_snapshot(_log(spark, sf), max_group=10)[0].select("rule_version_id", "status")


@query("catalog_rules", f"WITH log AS ({_LOG.format(s='varchar')}) SELECT r.rule_id, coalesce(x.s, 'DRAFT') AS rule_status FROM (SELECT DISTINCT rule_id FROM log) r LEFT JOIN (SELECT rule_id, arg_max(CASE event_type WHEN 'RULE_DISABLED' THEN 'DISABLED' WHEN 'RULE_ARCHIVED' THEN 'ARCHIVED' ELSE 'ACTIVE' END, position) AS s FROM log WHERE event_type IN ('RULE_DISABLED', 'RULE_ARCHIVED', 'STATUS_CHANGED_TO_ACTIVE') GROUP BY 1) x USING (rule_id)")
def _(spark, sf):
    return catalog.catalog_snapshot(_log(spark, sf))[1]


# --- containers, latency, labels -----------------------------------------------------------------------

@query("containers_page", "SELECT started_at, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS started_at FROM orders ORDER BY o_orderdate DESC LIMIT 50 OFFSET 50) GROUP BY 1")
def _(spark, sf):
    jobs = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"))
    return reports.containers_page(jobs, 2, 50).groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("started_at")).agg(F.count("*").alias("n"))


@query("lock_rule_name", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN 'LOCKED' ELSE 'SAMPLING' END AS lock_status, CASE WHEN o_orderstatus = 'O' THEN concat(c_name, '@', cast(c_nationkey as varchar)) END AS rule_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    locks = o.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("container"), F.when(F.col("o_orderstatus") == "O", "LOCKED").otherwise("SAMPLING").alias("status"), F.lit(0).alias("sample_count_seen"), F.lit(0).alias("mismatch_count"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")).alias("rule_version_id"))
    c = fx.table(spark, sf, "customer")
    versions = c.select(F.col("c_custkey").alias("rule_version_id"), F.col("c_custkey").alias("rule_id"), F.col("c_nationkey").alias("version"))
    rules = c.select(F.col("c_custkey").alias("rule_id"), F.col("c_name").alias("name"))
    return reports.lock_rule_name(o.select(F.col("o_orderkey").alias("id")), locks, versions, rules).select("id", "lock_status", "rule_name")


def _rank_sql(p):
    return f"max(CASE WHEN rn = least(n, greatest(1, cast(round_even({p} / 100.0 * n + 0.5, 0) as bigint))) THEN l_extendedprice END) AS p{p}"


@query("latency_summary", f"SELECT max(n) AS requests, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, round(avg(l_extendedprice), 3) AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max, {_rank_sql(50)}, {_rank_sql(95)}, {_rank_sql(99)}, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / max(n), 2) AS error_rate_pct FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem)")
def _(spark, sf):
    req = fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request_id"), F.col("l_extendedprice").alias("latency_ms"), (F.col("l_returnflag") != "R").alias("ok"))
    return reports.latency_summary(req).withColumn("mean", F.round("mean", 3))


@query("rule_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey = 0 THEN c_name ELSE concat(c_name, '@', cast(o_orderkey as varchar)) END AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    j = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", reports.rule_label(F.col("c_name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))).alias("label"))


# --- onboarding --------------------------------------------------------------------------------------------

_PREFIX = "CASE WHEN substring(regexp_replace(upper(b), '[^A-Z0-9]', '', 'g'), 1, 5) = '' THEN 'UNK' ELSE substring(regexp_replace(upper(b), '[^A-Z0-9]', '', 'g'), 1, 5) END"


@query("register_sources", f"WITH req AS (SELECT c_custkey, c_nationkey AS tenant, {_PREFIX} AS p FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN '--' ELSE c_mktsegment END AS b FROM customer)), num AS (SELECT *, row_number() OVER (PARTITION BY tenant, p ORDER BY c_custkey) + CASE WHEN p = 'BUILD' THEN 1 ELSE 0 END AS n FROM req) SELECT c_custkey, concat('SRC-', p, '-', lpad(cast(n as varchar), cast(greatest(3, length(cast(n as varchar))) as int), '0')) AS source_id FROM num")
def _(spark, sf):
    c = fx.table(spark, sf, "customer")
    req = c.select("c_custkey", F.col("c_nationkey").alias("tenant_id"), F.when(F.col("c_acctbal") < 0, "--").otherwise("").alias("vendor"), F.col("c_mktsegment").alias("name"))
    existing = c.select(F.col("c_nationkey").alias("tenant_id")).distinct().withColumn("source_id", F.lit("SRC-BUILD-001"))
    return onboarding.register_sources(req, existing, "c_custkey", max_group=20).select("c_custkey", "source_id")


def _fingerprinted(spark, sf, *kinds):
    return fx.lines(spark, sf, *kinds).withColumn("fingerprint", fingerprint(F.col("line"), F.col("source_id")))


def _waiting(spark, sf, *kinds):
    return cut_lineage(_fingerprinted(spark, sf, *kinds).withColumn("created_at", F.col("received_at")))


_FP = f"concat(substring(sha256(source_id), 1, 8), '::', sha256({structure_sql()}))"


@query("pull_samples", f"SELECT trace_id, line FROM (SELECT *, row_number() OVER (PARTITION BY source_id, fp ORDER BY received_at, trace_id) AS rn FROM (SELECT *, {_FP} AS fp FROM {L('cef', 'csv', 'kv')})) WHERE rn <= 5")
def _(spark, sf):
    e = _waiting(spark, sf, "cef", "csv", "kv")
    return onboarding.pull_samples(e.drop("line"), e).select("trace_id", "line")


_TEMPLATE_SQL = f"SELECT source_id, template, count(DISTINCT fp) AS groups FROM (SELECT source_id, {_FP} AS fp, CASE kind WHEN 'asa' THEN 'asa' WHEN 'leef' THEN 'leef' ELSE 'any_text' END AS template FROM {L('asa', 'leef', 'cef')}) GROUP BY 1, 2 UNION ALL SELECT source_id, CASE WHEN json_valid(line) THEN 'trail_json' ELSE 'any_text' END, count(DISTINCT json_valid(line)) FROM {L('json')} GROUP BY 1, 2"


@query("suggest_template", _TEMPLATE_SQL)
def _(spark, sf):
    groups = onboarding.suggest_template(_fingerprinted(spark, sf, "asa", "leef", "cef", "json"))
    return groups.groupBy("source_id", "template").agg(F.count("*").alias("groups"))


@query("target_schema_compat", f"SELECT kind, kind = 'cef' OR kind = 'leef' AS active_rule_found, count(*) AS n FROM {L('cef', 'leef', 'csv')} GROUP BY 1, 2")
def _(spark, sf):
    version = F.when(F.col("kind") == "cef", "gate-cef@1").when(F.col("kind") == "leef", "mail-leef@1").otherwise("pan-rx@1")
    found_rules = onboarding.target_schema_compat(fx.lines(spark, sf, "cef", "leef", "csv").withColumn("rule_version_id", version), fx.rule_set(), "ocsf")
    return found_rules.groupBy("kind", "active_rule_found").agg(F.count("*").alias("n"))


def _tests(spark, sf, *kinds):
    names = {k: t for k, t in {"asa": "asa", "leef": "leef", "json": "trail_json", "csv": "any_text"}.items() if k in kinds}
    rules = RuleSet([onboarding.template_rule(t, f"draft-{t}") for t in names.values()])
    version = F
    for kind, t in names.items():
        version = version.when(F.col("kind") == kind, f"draft-{t}@1")
    return rules, onboarding.rule_tests(fx.lines(spark, sf, *names).withColumn("rule_version_id", version.otherwise(None)), rules)


@query("rule_test_report", f"SELECT concat('draft-', CASE kind WHEN 'json' THEN 'trail_json' WHEN 'csv' THEN 'any_text' ELSE kind END, '@1') AS rule_version_id, count(*) AS samples, count(*) FILTER (WHERE kind <> 'json' OR json_valid(line)) AS passed_samples, bool_and(kind <> 'json' OR json_valid(line)) AS passed FROM {L('asa', 'leef', 'json', 'csv')} GROUP BY 1")
def _(spark, sf):
    return onboarding.rule_test_report(_tests(spark, sf, "asa", "leef", "json", "csv")[1])


@query("golden_cases", f"SELECT concat('draft-', CASE kind WHEN 'json' THEN 'trail_json' WHEN 'csv' THEN 'any_text' ELSE kind END, '@1') AS rule_version_id, count(*) FILTER (WHERE kind <> 'json' OR json_valid(line)) AS cases, count(*) FILTER (WHERE kind = 'leef') AS regressions FROM {L('leef', 'json', 'csv')} GROUP BY 1")
def _(spark, sf):
    rules, tests = _tests(spark, sf, "leef", "json", "csv")
    cases = onboarding.golden_cases(tests)
    changed = RuleSet([Rule(**{**r.__dict__, "field_mappings": {"vendor": "source.hostname"}, "required_fields": []}) if r.rule_id == "draft-leef" else r for r in rules.rules])
    again = onboarding.rule_tests(cases.select("rule_version_id", "trace_id", "line"), changed)
    return onboarding.golden_regressions(cases, again)


# --- reprocessing -------------------------------------------------------------------------------------------

@query("reprocess_select", f"SELECT trace_id FROM {V('cef')} WHERE outcome <> 'unresolved' OR line IN (SELECT line FROM {L('cef')} WHERE {_FP} IN (SELECT {_FP} FROM {L('cef')} WHERE starts_with(line, 'CEF:')))")
def _(spark, sf):
    e = _waiting(spark, sf, "cef", "csv")
    bound = e.filter(F.startswith("line", F.lit("CEF:"))).select(F.lit("gate-cef").alias("rule_id"), "fingerprint").distinct()
    return reprocess.reprocess_select(e, bound, rule_id="gate-cef").select("trace_id")


def _backlog(spark, sf):
    """An unresolved backlog, and bindings for the rule that has just become active."""
    raw = fx.raw_events(spark, sf, "csv", "noise")
    raw = cut_lineage(raw.withColumn("fingerprint", fingerprint(F.col("line"), F.col("source_id"))))
    waiting = raw.select("trace_id", "fingerprint", "source_id", "job_id")
    return raw, waiting, fx.bindings(spark)


@query("reprocess_apply", f"SELECT outcome, count(*) AS n FROM {V('csv', 'noise')} GROUP BY 1")
def _(spark, sf):
    raw, waiting, bound = _backlog(spark, sf)
    done = reprocess.reprocess_apply(waiting, waiting, raw, fx.rule_set(), bound, fx.sources(spark))
    return done.result.processed.groupBy("outcome").agg(F.count("*").alias("n"))


@query("auto_reprocess", f"SELECT 'normalized' AS state, count(*) AS n FROM {L('csv')} UNION ALL SELECT 'unresolved', count(*) FROM {L('noise')}")
def _(spark, sf):
    raw, waiting, bound = _backlog(spark, sf)
    done = reprocess.auto_reprocess(waiting, raw, fx.rule_set(), bound, "pan-rx", fx.sources(spark))
    ran = done.result.processed.groupBy(F.col("outcome").alias("state")).agg(F.count("*").alias("n"))
    return ran.unionByName(done.still_unresolved.agg(F.lit("unresolved").alias("state"), F.count("*").alias("n")))


# --- lock and streaming ------------------------------------------------------------------------------------------

def _lock_events(spark, sf):
    """Jobs by event type; what an event resolves to follows its user, so rules alternate within a job."""
    e = fx.table(spark, sf, "events")
    own = F.when(F.col("value") > 300, None).when(F.col("user_id") > 40, "ra").otherwise("rb")
    return e.select(F.col("event_type").alias("job_id"), F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trace_id"), own.alias("rule_version_id"))


# The transition table, event by event: one recursion step takes the next event of every job.
_LOCK_STEPS = """
WITH RECURSIVE e AS (
  SELECT event_type AS c, event_id AS p, CASE WHEN value > 300 THEN NULL WHEN user_id > 40 THEN 'ra' ELSE 'rb' END AS own,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
s AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS p, CAST(NULL AS VARCHAR) AS used, false AS was, false AS spot, false AS off,
         false AS locked, CAST(NULL AS VARCHAR) AS rule, 0 AS seen, 0 AS miss, 0 AS since_lock, 0 AS since_miss FROM e
  UNION ALL
  SELECT c, i, p, used, was, spot, off,
         CASE WHEN was THEN NOT (off AND miss >= 4) ELSE used IS NOT NULL AND seen >= 9 END,
         CASE WHEN was THEN CASE WHEN off AND miss >= 4 THEN NULL ELSE rule END WHEN used IS NOT NULL AND seen >= 9 THEN used END,
         CASE WHEN was OR (used IS NOT NULL AND seen >= 9) THEN 0 ELSE seen + CASE WHEN used IS NULL THEN 0 ELSE 1 END END,
         CASE WHEN was AND off AND miss < 4 THEN miss + 1 WHEN was AND NOT off THEN miss ELSE 0 END,
         CASE WHEN was AND NOT (off AND miss >= 4) THEN since_lock + 1 ELSE 0 END,
         CASE WHEN was AND NOT off THEN since_miss + 1 ELSE 0 END
  FROM (
    SELECT *, spot AND used IS DISTINCT FROM rule AS off FROM (
      SELECT *, CASE WHEN was AND NOT spot THEN rule ELSE own END AS used FROM (
        SELECT e.c, e.i, e.p, e.own, s.locked AS was, s.rule, s.seen, s.miss, s.since_lock, s.since_miss,
               s.locked AND (s.since_lock + 1) % CASE WHEN s.miss > 0 AND s.since_miss < 50 THEN 25 WHEN s.since_lock < 100 THEN 50 ELSE 500 END = 0 AS spot
        FROM s JOIN e ON e.c = s.c AND e.i = s.i + 1))))
"""


@query("rule_lock", f"{_LOCK_STEPS} SELECT c AS container, p AS position, used AS rule_version_id, was AS was_locked, spot AS spot_check, off AS mismatch FROM s WHERE i > 0")
def _(spark, sf):
    return lock.rule_lock(_lock_events(spark, sf), "job_id", "seq", ["ra", "rb"], chunk_rows=2_000).select("container", "position", "rule_version_id", "was_locked", "spot_check", "mismatch")


@query("lock_transition", f"""{_LOCK_STEPS}
SELECT c AS container, CASE WHEN locked THEN 'LOCKED' ELSE 'SAMPLING' END AS status, rule AS rule_version_id, CASE WHEN locked THEN 10 ELSE seen END AS sample_count_seen, miss AS mismatch_count,
       CAST(since_lock AS BIGINT) AS events_since_lock, CAST(since_miss AS BIGINT) AS events_since_mismatch
FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i DESC) AS back FROM s WHERE i > 0) WHERE back = 1""")
def _(spark, sf):
    return lock.lock_states(cut_lineage(lock.rule_lock(_lock_events(spark, sf), "job_id", "seq", ["ra", "rb"], chunk_rows=2_000)))


@query("spot_check_rate", "SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_linenumber > 3 AND l_suppkey < 50 THEN 25 WHEN l_partkey < 100 THEN 50 ELSE 500 END AS rate FROM lineitem")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    miss = F.greatest(F.col("l_linenumber") - 3, F.lit(0))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), lock.spot_check_rate(miss, F.col("l_suppkey"), F.col("l_partkey")).alias("rate"))


@query("locked_pipeline", f"SELECT outcome, count(*) AS n FROM {V('csv', 'leef')} GROUP BY 1")
def _(spark, sf):
    return processed(spark, sf, "csv", "leef", container="job_id").groupBy("outcome").agg(F.count("*").alias("n"))


def _streamed(spark, sf, container=None):
    path = run_dir(spark, "pipe")
    kinds = ["leef", "xml", "csv"]
    lines = fx.lines(spark, sf, *kinds)
    # Two micro-batches, of as many files as the lines have tasks.
    files = lines.rdd.getNumPartitions()
    lines.repartition(files).write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{path}/in")
    known = fx.bindings(spark)
    stream_pipeline(events, fx.rule_set(), lambda: known, f"{path}/out", f"{path}/ck", fx.sources(spark), order="seq", container=container).awaitTermination()
    return path


@query("stream_pipeline", f"SELECT outcome, count(*) AS n FROM {V('leef', 'xml', 'csv')} GROUP BY 1")
def _(spark, sf):
    path = _streamed(spark, sf)
    out = None
    for name in ("normalized", "unresolved", "dead_letter"):
        row = published(spark, f"{path}/out", name, SCHEMAS[name]).agg(F.lit(name).alias("outcome"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.filter("n > 0")


@query("stream_dedupe", f"SELECT source_id, count(*) AS n FROM {L('csv')} WHERE line LIKE '%allow%' GROUP BY 1")
def _(spark, sf):
    from loglattice.streaming.pipeline import stream_dedupe

    e = fx.lines(spark, sf, "csv")
    twice = e.unionByName(e)
    return stream_dedupe(twice, [e.filter(~F.contains("line", F.lit("allow")))]).groupBy("source_id").agg(F.count("*").alias("n"))


@query("stream_counters", f"SELECT job_id, count(*) AS processed_events, count(*) FILTER (WHERE outcome <> 'unresolved') AS normalized_count, count(*) FILTER (WHERE outcome = 'unresolved') AS unresolved_count FROM (SELECT job_id, CASE WHEN line LIKE '%deny%' THEN 'unresolved' ELSE 'normalized' END AS outcome FROM {L('kv')}) GROUP BY 1")
def _(spark, sf):
    path = run_dir(spark, "counters")
    outcome = F.when(F.contains("line", F.lit("deny")), "unresolved").otherwise("normalized")
    fx.lines(spark, sf, "kv").select("job_id", outcome.alias("outcome")).repartition(2).write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream_counters(stream, "job_id").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("register_parser", f"SELECT trace_id, split_part(line, ',', 2) AS kind_of FROM {L('csv')}")
def _(spark, sf):
    register_parser("comma", Parser(
        prepare=lambda raw, rule: F.split(raw, ","), error=lambda prepared, rule: F.when(F.size(prepared) < 2, F.lit("too short")),
        value=lambda prepared, rule, key: found(F.get(prepared, F.lit(int(key)))), share_key=lambda rule: "comma"))
    rule = Rule("cm@1", "cm", 1, "comma", {}, {"1": "kind"}, ["kind"])
    parsed = RuleSet([rule]).parse_and_check(fx.lines(spark, sf, "csv").withColumn("rv", F.lit("cm@1")), "line", "rv")
    return parsed.select("trace_id", F.get("_values", F.lit(0))["value"].alias("kind_of"))


