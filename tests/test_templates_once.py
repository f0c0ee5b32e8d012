"""Templates are suggested in one pass: samples are neither sorted nor kept."""

from loglattice.operators import onboarding
from loglattice.plans import QUERIES, q_catalog


def test_templates_need_no_sort_and_the_first_sample_decides(spark, monkeypatch):
    kept, cut = [], onboarding.cut_lineage
    monkeypatch.setattr(onboarding, "cut_lineage", lambda df: kept.append(df) or cut(df))
    rows = [
        ("s", "mixed", "b", "plain"), ("s", "mixed", "a", ' {"x":"amazonaws.com"}'), ("s", "late", "b", '{"x":1}'), ("s", "late", "a", "plain"),
        (None, "mixed", "b", '{"x":1}'), (None, "mixed", "a", "{broken}"), (None, None, "a", None), (None, None, "b", '{"x":1}'),
        ("s", None, "a", '{"x":1}'), ("s", None, None, "plain"), ("s", "none", None, '{"x":1}'), ("s", "leef", "z", "LEEF:1"), ("s", "leef", "a", "{}"),
    ]
    samples = spark.createDataFrame(rows, "source_id string, fingerprint string, trace_id string, line string")
    got = {(r.source_id, r.fingerprint): (r.samples, r.template) for r in onboarding.suggest_template(samples).collect()}
    assert got == {
        ("s", "mixed"): (2, "trail_json"), ("s", "late"): (2, "any_text"), (None, "mixed"): (2, "any_text"), (None, None): (2, "any_text"),
        ("s", None): (2, "any_json"), ("s", "none"): (1, "any_text"), ("s", "leef"): (2, "leef"),
    }
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_suggest_template_keeps_no_lines(spark, tmp_path, monkeypatch):
    tables = {
        "lineitem": "1L AS l_orderkey, 1 AS l_linenumber, 2L AS l_partkey, 3L AS l_suppkey, timestamp_ntz'2024-01-02 00:00:00' AS l_shipdate, 'A' AS l_returnflag, 'O' AS l_linestatus",
        "customer": "1L AS c_custkey, 'Customer#1' AS c_name, 2 AS c_nationkey, 'AUTO' AS c_mktsegment",
        "orders": "1L AS o_orderkey, 2L AS o_custkey, 'O' AS o_orderstatus, 3.0D AS o_totalprice, timestamp_ntz'2024-01-02 00:00:00' AS o_orderdate, '5-LOW' AS o_orderpriority",
        "events": "1L AS event_id, timestamp_ntz'2024-01-02 00:00:00' AS ts, 4L AS user_id, 'view' AS event_type",
    }
    for name, row in tables.items():
        spark.sql(f"SELECT {row}").write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(q_catalog, "cut_lineage", lambda df: 1 / 0)
    got = {tuple(r) for r in QUERIES["suggest_template"](spark, str(tmp_path)).collect()}
    assert got == {("asa", "asa", 1), ("mail", "leef", 1), ("gate", "any_text", 1), ("cloud", "trail_json", 1)}
