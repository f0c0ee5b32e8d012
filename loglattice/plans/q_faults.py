"""Queries: repeated lines, hostile lines and faulty rules; every event keeps its own outcome."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from loglattice.operators.engine import RuleSet
from loglattice.operators.ingest import build_raw_events
from loglattice.operators.joined import compile_rules
from loglattice.operators.normalize import dead_letters, first_dead_letters, normalize, unexpected_errors
from loglattice.operators.pipeline import process_batch
from loglattice.operators.rules import Rule, load_rules, rules_frame
from loglattice.plans import fixtures as fx
from loglattice.plans.q_catalog import _DOC_LINES, run_dir
from loglattice.plans.q_events import V, processed
from loglattice.plans.registry import query
from loglattice.session import cut_lineage, tasks_for, written
from loglattice.sources.lines import read_log_lines, stream_log_lines
from loglattice.sources.manifest import publish, published
from loglattice.sources.results import read_results
from loglattice.streaming.pipeline import stream_pipeline


def _doc_files(spark, sf):
    path = run_dir(spark, "repeated")
    fx.table(spark, sf, "documents").select("text").write.text(f"{path}/in")
    return path


def _many_doc_files(spark, sf, parts):
    """Files in ``parts`` equal shares, and the files of a share: more of them for larger tables, so no task writes a fixed part of all."""
    path = run_dir(spark, "repeated")
    texts = fx.table(spark, sf, "documents").select("text")
    share = -(-tasks_for(texts) // parts)
    texts.repartition(parts * share).write.text(f"{path}/in")
    return path, share


@query("repeated_lines_batch", f"SELECT line, count(*) AS events, count(*) AS ids FROM {_DOC_LINES} WHERE line <> '' GROUP BY 1")
def _(spark, sf):
    events = build_raw_events(read_log_lines(spark, f"{_doc_files(spark, sf)}/in", "misc"))
    per_id = events.groupBy("line", "trace_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("line").agg(F.sum("n").alias("events"), F.count("*").alias("ids"))


@query("repeated_lines_stream", f"SELECT count(*) AS events, count(*) AS ids FROM {_DOC_LINES} WHERE line <> ''")
def _(spark, sf):
    path, share = _many_doc_files(spark, sf, 2)
    events = stream_log_lines(spark, f"{path}/in", share).withColumn("source_id", F.lit("misc"))
    known = fx.bindings(spark)
    stream_pipeline(events, fx.rule_set(), lambda: known, f"{path}/out", f"{path}/ck", fx.sources(spark)).awaitTermination()
    stored = read_results(spark, f"{path}/out")["trace"]
    return stored.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("events"), F.count("*").alias("ids"))


_LINES_TWICE = f"{_DOC_LINES} WHERE line <> ''"


@query("reread_lines", f"""SELECT * FROM (SELECT count(*) AS lines, count(*) AS after_adding, count(*) AS other_splits, count(*) AS by_stream FROM {_LINES_TWICE}),
    (SELECT count(*) AS added FROM nation)""")
def _(spark, sf):
    """A folder read four times: as it is, beside another file, in other splits, as a stream. Every line is one event in all."""
    path, share = _many_doc_files(spark, sf, 3)

    def ids(name):
        return written(build_raw_events(read_log_lines(spark, f"{path}/in", "misc")).select("trace_id", F.lit(name).alias("pass")), name)

    passes = ids("first")
    fx.table(spark, sf, "nation").select("n_name").coalesce(1).write.mode("append").text(f"{path}/in")
    passes = passes.unionByName(ids("beside"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        passes = passes.unionByName(ids("splits"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    lines = stream_log_lines(spark, f"{path}/in", 2 * share, blank=True).withColumn("source_id", F.lit("misc"))
    known = fx.bindings(spark)
    stream_pipeline(lines, fx.rule_set(), lambda: known, f"{path}/out", f"{path}/ck", fx.sources(spark)).awaitTermination()
    passes = passes.unionByName(read_results(spark, f"{path}/out")["trace"].select("trace_id", F.lit("stream").alias("pass")))
    seen = passes.groupBy("trace_id").agg(*[F.count_if(F.col("pass") == name).alias(name) for name in ("first", "beside", "splits", "stream")])
    old = F.col("first") == 1
    return seen.agg(
        F.count_if(old).alias("lines"), F.count_if(old & (F.col("beside") == 1)).alias("after_adding"), F.count_if(old & (F.col("splits") == 1)).alias("other_splits"),
        F.count_if(old & (F.col("stream") == 1)).alias("by_stream"), F.count_if(~old & (F.col("beside") == 1) & (F.col("splits") == 1) & (F.col("stream") == 1)).alias("added"))


@query("retried_batch", f"""SELECT outcome, count(*) AS n, 0 AS in_two FROM {V('leef', 'xml', 'csv')} WHERE kind <> 'csv' GROUP BY 1""")
def _(spark, sf):
    """A run whose first attempt had more rows, and one that is published empty: readers see the last attempts alone."""
    path, schema = run_dir(spark, "retried"), "trace_id string, outcome string, kind string"
    done = cut_lineage(processed(spark, sf, "leef", "xml", "csv").select("trace_id", "outcome", "kind"))

    def attempt(run, rows):
        publish(spark, path, run, {name: rows.filter(F.col("outcome") == name) for name in ("normalized", "unresolved", "dead_letter")})

    for run, rows in (("a", done), ("b", done), ("a", done.filter("kind <> 'csv'")), ("b", done.limit(0))):
        attempt(run, rows)
    tables = [published(spark, path, name, schema) for name in ("normalized", "unresolved", "dead_letter")]
    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    twice = every.groupBy("trace_id").agg(F.count(F.lit(1)).alias("times"), F.min("outcome").alias("outcome"))
    return twice.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("times") > 1).cast("int").alias("in_two"))


@query("repeated_lines_locked", f"SELECT count(*) AS events, count(*) AS ids FROM {_DOC_LINES} WHERE line <> ''")
def _(spark, sf):
    events = build_raw_events(read_log_lines(spark, f"{_doc_files(spark, sf)}/in", "misc", "job"))
    done = process_batch(events, fx.rule_set(), fx.bindings(spark), fx.sources(spark), container="job_id").processed
    return done.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("events"), F.count("*").alias("ids"))


# Lines whose own text once broke a pattern, and the fields that they hold.
_HOSTILE = """CASE c_custkey % 4
  WHEN 0 THEN concat('LEEF:2.0|a|b|c|d|(|src=10.0.0.', cast(c_nationkey as {s}), '(usrName=', c_name)
  WHEN 1 THEN concat('{{"id":', cast(c_custkey as {s}), '}}')
  WHEN 2 THEN concat('LEEF:2.0|a|b|c|d|[|src=10.0.0.', cast(c_nationkey as {s}), '[usrName=', c_name)
  ELSE c_name END"""
_HOSTILE_RULES = [
    Rule("leef@1", "leef", 1, "leef", {}, {"usrName": "who"}, ["who"]),
    Rule("brace@1", "brace", 1, "regex", {"pattern": r'^{"id":(?P<id>\d+)}$'}, {"id": "who"}, ["who"]),
]


@query("hostile_lines", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 2 THEN c_name WHEN 1 THEN cast(c_custkey as varchar) END AS who, c_custkey % 4 <> 3 AS ok FROM customer")
def _(spark, sf):
    version = F.when(F.startswith("line", F.lit("LEEF")), "leef@1").otherwise("brace@1")
    lines = fx.table(spark, sf, "customer").selectExpr("c_custkey AS id", _HOSTILE.format(s="string") + " AS line").withColumn("rv", version)
    parsed = RuleSet(load_rules(rules_frame(spark, _HOSTILE_RULES))).parse_and_check(lines, "line", "rv")
    return parsed.select("id", F.when(F.col("_error").isNull(), F.get("_values", F.lit(0))["value"]).alias("who"), F.col("_error").isNull().alias("ok"))


_FAULTY = [
    Rule("good@1", "good", 1, "regex", {"pattern": r"^Customer#(?P<n>\d+)$"}, {"n": "n"}, ["n"]),
    Rule("slow@1", "slow", 1, "regex", {"pattern": r"^((a+))+$"}, {"x": "x"}),
    Rule("odd@1", "odd", 1, "nosuch", {}, {"x": "x"}),
    Rule("path@1", "path", 1, "jsonpath", {"paths": {"x": "$.a[?(@.b)]"}}, {"x": "x"}),
    Rule("date@1", "date", 1, "regex", {"pattern": r"^(?P<n>.+)$"}, {"n": "n"}, ["n"], {"n": "int"}),
]


@query("bad_rules", """SELECT stage, error_class, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN 'validation_failed' ELSE 'parser_failed' END AS stage,
    CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN 'ValueError' ELSE 'ParserError' END AS error_class FROM customer WHERE c_custkey % 5 <> 0) GROUP BY 1, 2""")
def _(spark, sf):
    version = F.get(F.array(*[F.lit(rule.rule_version_id) for rule in _FAULTY]), (F.col("seq") % 5).cast("int"))
    lines = fx.table(spark, sf, "customer").selectExpr("c_custkey AS seq", "c_name AS line", "'mix' AS source_id", "timestamp_ntz'2024-01-01 00:00:00' AS received_at")
    events = build_raw_events(lines).withColumns({"rule_version_id": version, "namespace": F.lit("vendor"), "fingerprint": F.lit("f"), "tenant_id": F.lit("default")})
    rules = RuleSet(load_rules(rules_frame(spark, _FAULTY)))
    failed = dead_letters(normalize(rules.parse_and_check(events, "line", "rule_version_id"), rules))
    return failed.groupBy("stage", "error_class").agg(F.count("*").alias("n"))


_DATED = Rule("dated@1", "dated", 1, "regex", {"pattern": r"^t=(?P<t>.*) n=\d+$"}, {"t": "event_time"}, ["event_time"], {"event_time": "datetime"})


@query("discover_exact_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'dated@1' END AS candidate FROM orders")
def _(spark, sf):
    lines = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        "concat('t=', CASE o_orderkey % 3 WHEN 0 THEN 'rubbish' WHEN 1 THEN date_format(o_orderdate, 'MMM dd HH:mm:ss') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END, ' n=1') AS line")
    return RuleSet([_DATED], datetime_mode="exact").first_passing(lines, "line", None, "candidate").select("id", "candidate")


_SLICED = Rule("cut@1", "cut", 1, "jsonpath", {"paths": {"s": "$.l[1:]", "u": "$['x','b']", "n": "$.l[-1]"}}, {"s": "s", "u": "u", "n": "n"})


@query("jsonpath_slices", "SELECT p_partkey AS id, cast(p_size as varchar) AS s, p_brand AS u, cast(p_size + 1 as varchar) AS n FROM part")
def _(spark, sf):
    lines = fx.table(spark, sf, "part").selectExpr("p_partkey AS id", "to_json(named_struct('l', array(0, p_size, p_size + 1), 'b', p_brand)) AS line", "'cut@1' AS rv")
    parsed = RuleSet([_SLICED]).parse_and_check(lines, "line", "rv")
    return parsed.select("id", *[F.get("_values", F.lit(i))["value"].alias(name) for i, name in enumerate(_SLICED.targets)])


@query("dead_letter_stages", """SELECT stage, count(*) AS n FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'parser_failed' WHEN 1 THEN 'validation_failed' ELSE 'unexpected_error' END AS stage FROM customer
    WHERE c_custkey % 7 <> 0) GROUP BY 1""")
def _(spark, sf):
    """All three stages; traces that have a dead letter already, and second letters of a trace, add none."""
    version = F.get(F.array(*[F.lit(v) for v in ("date@1", "odd@1", "odd@1")]), (F.col("seq") % 3).cast("int"))
    lines = fx.table(spark, sf, "customer").selectExpr("c_custkey AS seq", "c_name AS line", "'mix' AS source_id", "timestamp_ntz'2024-01-01 00:00:00' AS received_at")
    events = build_raw_events(lines).withColumns({"rule_version_id": version, "namespace": F.lit("vendor"), "fingerprint": F.lit("f"), "tenant_id": F.lit("default")})
    rules = RuleSet(load_rules(rules_frame(spark, _FAULTY)))
    failed = dead_letters(normalize(rules.parse_and_check(events.filter("seq % 3 <> 2"), "line", "rule_version_id"), rules))
    lost = unexpected_errors(events.filter("seq % 3 = 2"), "TimeoutError", "gave up")
    stored = unexpected_errors(events.filter("seq % 7 = 0"), "TimeoutError", "gave up before")
    return first_dead_letters(stored, failed.unionByName(lost).unionByName(failed)).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


# Four loops over one text: matched in linear time, with the same groups.
_CHAINED = Rule("chain@1", "chain", 1, "regex", {"pattern": r"^(?P<head>\D*)\D*\D*\D*(?P<tail>\d+)$"}, {"head": "head", "tail": "tail"}, ["tail"])


@query("regex_linear", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Customer#' END AS head, CASE WHEN c_custkey % 2 = 0 THEN substring(c_name, 10) END AS tail,
    c_custkey % 2 = 0 AS ok FROM customer""")
def _(spark, sf):
    lines = fx.table(spark, sf, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE repeat(c_mktsegment, 400) END AS line", "'chain@1' AS rv")
    parsed = RuleSet(load_rules(rules_frame(spark, [_CHAINED]))).parse_and_check(lines, "line", "rv")
    ok = F.col("_error").isNull()
    return parsed.select("id", *[F.when(ok, F.get("_values", F.lit(i))["value"]).alias(name) for i, name in enumerate(_CHAINED.targets)], ok.alias("ok"))


def _many(spark, n=2_000):
    """The catalogue with ``n`` more rules of all families, newer than the others, that accept no line or lines that others take first."""
    known = fx.rule_set().rules
    more = []
    for i in range(n):
        kind = known[i % len(known)]
        own = {"parser_definition": {"pattern": rf"^only{i} (?P<a>\S+) (?P<b>\d+)$"}, "field_mappings": {"a": f"f{i}", "b": "event_time"}, "required_fields": ["event_time"], "type_constraints": {}}
        more.append(replace(kind, rule_version_id=f"m{i}@1", rule_id=f"m{i}", created_at="2025-01-01 00:00:00", **(own if kind.parser_type == "regex" else {})))
    return compile_rules([*known, *more], spark, fx.MASK_KEY)


@query("many_rules", f"SELECT trace_id, rule_id, rule_version, outcome, coalesce(action, '') AS action, coalesce(s_ip, '') AS s_ip, coalesce(n_src, '') AS n_src FROM {V('kv', 'json', 'leef', 'csv', 'asa', 'xml')}")
def _(spark, sf):
    """Two thousand rules in one plan: every event gets the rule and the values that the small catalogue gives it."""
    kinds = ["kv", "json", "leef", "csv", "asa", "xml"]
    done = process_batch(fx.raw_events(spark, sf, *kinds), _many(spark), fx.bindings(spark), fx.sources(spark)).processed
    ok = F.col("outcome") == "normalized"
    cells = {"action": F.col("security")["action"], "s_ip": F.col("source")["ip"], "n_src": F.col("network")["src_ip"]}
    return done.select("trace_id", "rule_id", "rule_version", "outcome", *[F.coalesce(F.when(ok, c), F.lit("")).alias(name) for name, c in cells.items()])
