"""Reports read a table of what they show: no documents and no fields are worked out or written for lists."""

from loglattice.operators import normalize as n
from loglattice.operators import reports
from loglattice.plans import q_events

LINES = [
    ("t1", "fw", 1, "date=2024-01-01 time=00:00:00 srcip=10.0.0.1 dstip=1.1.1.1 dstport=443 action=\"pass\""),
    ("t2", "fw", 2, "nothing known"),
]


def lines(spark):
    return spark.createDataFrame(LINES, "trace_id string, source_id string, seq bigint, line string").selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' AS received_at", "concat('fw-', seq) AS job_id", "'kv' AS kind")


def test_table_holds_what_lists_show(spark, monkeypatch):
    monkeypatch.setattr(q_events.fx, "lines", lambda spark, sf, *kinds: lines(spark))
    table, sources, rules = q_events._report_frames(spark, "")
    assert not {"payload_json", "line", "_entries", "source", "unmapped_fields"} & set(table.columns)
    done = reports.events_with_context(n.normalized_events(table), None, sources, rules, "default")
    assert [(r.trace_id, r.rule_name) for r in done.collect()] == [("t1", "fw-kv@1")]
    assert [r.trace_id for r in n.unresolved(table).collect()] == ["t2"]


def test_trace_of_repeated_ids(spark, monkeypatch):
    """Every copy meets every copy, as ids that are no keys do."""
    monkeypatch.setattr(q_events.fx, "lines", lambda spark, sf, *kinds: lines(spark).union(lines(spark)))
    traced = q_events.reports.event_trace
    table, _, _ = q_events._report_frames(spark, "", "rule_hash", "rule_schema_version", "digest")
    done = n.normalized_events(table)
    out = traced(done, n.traces(table), table)
    assert out.count() == 8 and "trace_id" in out.columns
    assert out.join(done.select("trace_id"), "trace_id").count() == out.join(done.select("event_id"), "event_id").count() == 16
