"""Whole-pipeline properties and the registered queries on the smallest data."""


import pytest
from compare import check, connect
from conftest import SF
from loglattice.operators import normalize as n
from loglattice.operators.pipeline import process_batch
from loglattice.plans import QUERIES, SQL
from loglattice.plans import fixtures as fx
from pyspark.sql import functions as F

# A spread over the sections; `python tests/compare.py SF_DIR` runs all of them.
CHECKED = [
    "digest", "to_ist_iso", "mask_ip", "text_structure", "json_structure", "fingerprint", "redact_secrets", "parse_regex", "parse_jsonpath", "parse_cef_extension",
    "parse_leef2_ext", "parse_kv_quoted", "parse_xml_attr", "parse_error", "is_ip", "lint_nested_quantifier", "discovery_timeline", "route_canonical", "core_event",
    "provenance", "dead_letter", "events_page", "stats_overview", "job_progress", "latency_summary", "next_version", "catalog_snapshot_split", "register_sources",
    "rule_test_report", "auto_reprocess", "locked_pipeline", "stream_pipeline", "write_raw_vault", "read_log_lines",
    "assign_trace_id", "repeated_lines_batch", "repeated_lines_stream", "repeated_lines_locked", "hostile_lines", "bad_rules", "discover_exact_dates", "jsonpath_slices",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = connect(SF)
    assert name in SQL
    assert check(spark, con, SF, name) is None


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)


def test_second_run_adds_nothing(spark):
    events = fx.raw_events(spark, SF, "leef", "xml")
    first = process_batch(events, fx.rule_set(), fx.bindings(spark), fx.sources(spark)).processed
    tables = [n.normalized_events(first), n.unresolved(first), n.dead_letters(first)]
    again = process_batch(events, fx.rule_set(), fx.bindings(spark), fx.sources(spark), prior=tables).processed
    assert again.count() == 0


def test_clear_values_stay_out_of_provenance(spark):
    done = process_batch(fx.raw_events(spark, SF, "kv"), fx.rule_set(), fx.bindings(spark), fx.sources(spark)).processed
    rows = n.provenance(done).filter("transformation = 'mask_hmac_hash'")
    assert rows.filter(F.contains("source_value", F.lit("."))).count() == 0
    assert n.provenance(done, keep_clear_values=True).filter("transformation = 'mask_hmac_hash'").filter(F.contains("source_value", F.lit("."))).count() > 0


def test_plan_prunes_and_stays_native(spark):
    df = fx.lines(spark, SF, "kv").select("line")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "props" not in plan and "value" not in plan.split("ReadSchema")[1]
