"""Lines and rules that once stopped a batch or lost events."""

import pytest
from conftest import SF
from loglattice.functions.typecheck import is_datetime
from loglattice.operators import reports
from loglattice.operators.engine import RuleSet
from loglattice.operators.ingest import build_raw_events
from loglattice.operators.normalize import provenance_upsert
from loglattice.operators.parsers.leef import leef_pairs
from loglattice.operators.parsers.regex import java_pattern
from loglattice.operators.pipeline import process_batch
from loglattice.operators.rules import Rule, active_rules, load_rules, pattern_hazard, rejected, rules_frame
from loglattice.plans import fixtures as fx
from loglattice.session import lookup_join
from loglattice.sources.lines import read_log_lines
from loglattice.sources.results import read_results, write_results
from loglattice.streaming.pipeline import arrival, placed, stream_dedupe
from pyspark.sql import functions as F


def test_repeated_lines_stay_different_events(spark, tmp_path):
    (tmp_path / "a.log").write_text("same\nsame\nother\nsame �\n")
    events = build_raw_events(read_log_lines(spark, str(tmp_path), "s"))
    rows = events.select("trace_id", "line").collect()
    assert len(rows) == 4 and len({r.trace_id for r in rows}) == 4
    assert "same �" in {r.line for r in rows}


def test_repeated_lines_of_a_micro_batch(spark):
    batch = spark.sql("SELECT 's' AS source_id, timestamp_ntz'2024-01-01 00:00:00' AS received_at, 'f' AS file_path, 0L AS block_start, 'same' AS line FROM range(5)")
    fresh = stream_dedupe(build_raw_events(placed(batch)), [])
    assert fresh.count() == 5


def test_identity_is_required(spark):
    lines = spark.sql("SELECT 's' AS source_id, timestamp_ntz'2024-01-01 00:00:00' AS received_at, 'x' AS line")
    with pytest.raises(ValueError, match="identity"):
        build_raw_events(lines)


@pytest.mark.parametrize("delimiter", ["\\E(", "\\Q", "\\", "(", "[a", "^|", "$1"])
def test_leef_delimiter_is_literal(spark, delimiter):
    df = spark.createDataFrame([(f"LEEF:2.0|a|b|c|d|{delimiter.split('|')[0]}|k=v",)], "raw string")
    assert df.select(leef_pairs(F.col("raw")).alias("o")).count() == 1
    assert df.select(leef_pairs(F.col("raw")).alias("o")).collect()


@pytest.mark.parametrize(("pattern", "line", "hit"), [
    (r'^{"id":(?P<id>\d+)}$', '{"id":7}', True), (r"^a{2}b{,2}$", "aabb", True), (r"^a{2,}$", "a", False), (r"^x{}$", "x{}", True), (r"^[{}]+$", "{}", True),
])
def test_literal_braces(spark, pattern, line, hit):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(F.col("line").rlike(java_pattern(pattern)[0])).first()[0] is hit


def test_salted_lookup_with_a_map_column(spark):
    facts = spark.sql("SELECT id % 3 AS k, map('a', id) AS m FROM range(1000)")
    lookup = spark.sql("SELECT id AS k, id * 10 AS v FROM range(3)")
    got = lookup_join(facts, lookup, "k", max_rows=1)
    assert got.count() == 1000 and got.filter("v = k * 10").count() == 1000


def test_new_provenance_wins_a_tie(spark):
    old, new = (spark.sql(f"SELECT 't' AS trace_id, 'f' AS target_field, '{v}' AS source_value, timestamp_ntz'2024-01-01 00:00:00' AS created_at") for v in ("old", "new"))
    assert provenance_upsert(old, new).first().source_value == "new"
    assert provenance_upsert(old, new).columns == old.columns


def test_faulty_rules_fail_their_own_events_only(spark):
    rules = [
        Rule("good@1", "good", 1, "regex", {"pattern": r"^ok (?P<n>\d+)$"}, {"n": "n"}, ["n"]),
        Rule("slow@1", "slow", 1, "regex", {"pattern": r"^((a+))+$"}, {"x": "x"}),
        Rule("odd@1", "odd", 1, "nosuch", {}, {"x": "x"}),
        Rule("look@1", "look", 1, "regex", {"pattern": r"(?=a)b"}, {"x": "x"}),
    ]
    loaded = load_rules(rules_frame(spark, rules))
    assert {v for v, _ in rejected(loaded)} == {"slow@1", "look@1"}
    lines = spark.createDataFrame([("ok 1", "good@1"), ("aaaa!", "slow@1"), ("x", "odd@1"), ("b", "look@1"), ("ok 2", None)], "line string, v string")
    got = {r.line: r._error for r in RuleSet(loaded).parse_and_check(lines, "line", "v").collect()}
    assert got["ok 1"] is None and got["ok 2"] is None
    assert got["x"] == "Unsupported parser type: nosuch" and got["aaaa!"].startswith("Unsafe regex pattern: ") and "look-around" in got["b"]
    found = RuleSet(loaded).first_passing(lines, "line", None).collect()
    assert {r.line: r._candidate for r in found} == {"ok 1": "good@1", "ok 2": "good@1", "aaaa!": None, "x": None, "b": None}


@pytest.mark.parametrize(("pattern", "hazard"), [
    (r"^((a+))+$", True), (r"(a|aa)+", True), (r"(a+){2,}", True), (r"(x+){1,30}", True), (r"(.|a)*", True), (r"(?<!a)b", True), (r"(a)\1", True), (r"(?P<a>x)(?P=a)", True),
    (r"\(?=x", False), (r"[(+]+", False), (r"(?:\.|,)+", False), (r"(?:cat|dog)*", False), (r"(?:\d{1,3}\.){3}\d+", False), (r"a|b+", False), ("(", False), ("[", False), ("", False),
])
def test_pattern_hazard(pattern, hazard):
    assert bool(pattern_hazard(pattern)) is hazard


@pytest.mark.parametrize(("pattern", "hazard"), [
    (r'^"(?:\\.|[^"\\])*"$', False), (r"^(?:\d|-)+$", False), (r"(?:\w|\s|-)*", False), (r"(?:[a-f]|[g-z])*", False), (r"(?:(?:a|b)c|x)+", False), (r"(?:ab?|c)+", False),
    (r'"(?:\\.|[^"])*"', True), (r"(?:\w|\d-)+", True), (r"(?:[a-f]|F)*", True), (r"(?:\d|-\d?)+", True), (r"(?:a?b|b)+", True), (r"(?:a|)+", True), (r"(?:k|\p{L})+", True),
])
def test_alternatives_are_compared_by_their_characters(spark, pattern, hazard):
    rule, = load_rules(rules_frame(spark, [Rule("v", "r", 1, "regex", {"pattern": pattern}, {"x": "x"})]))
    assert bool(rule.defect) is hazard


@pytest.mark.parametrize("mode", ["native", "exact"])
def test_dates_count_in_discovery(spark, mode):
    rule = Rule("d@1", "d", 1, "keyvalue", {"delimiter": " ", "kv_separator": "="}, {"t": "event_time", "n": "n"}, ["event_time"], {"event_time": "datetime"})
    lines = spark.createDataFrame([("t=rubbish n=1",), ("t=2024-01-05 n=1",), ("t='Jan  5 10:00:00' n=2",), ("n=1",)], "line string")
    found = RuleSet([rule], datetime_mode=mode).first_passing(lines, "line", None).collect()
    assert [r._candidate for r in found] == [None, "d@1", "d@1", None]


def test_times_without_a_year(spark):
    texts = ["Jan  5 10:00:00", "Dec 31 23:59:59", "jan 5 1:02:03", "Feb 30 10:00:00", "Apr 31 10:00:00", "Jan 5 25:00:00", "Foo 5 10:00:00", "", None, "2024-01-05"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.ok for r in df.select("i", is_datetime(F.col("t")).alias("ok")).orderBy("i").collect()]
    assert got == [True, True, True, False, False, False, False, False, False, True]


def test_second_write_adds_nothing(spark, tmp_path):
    done = process_batch(fx.raw_events(spark, SF, "leef", "xml"), fx.rule_set(), fx.bindings(spark), fx.sources(spark)).processed
    first = write_results(done, str(tmp_path))
    counts = {name: t.count() for name, t in read_results(spark, str(tmp_path)).items()}
    assert write_results(done, str(tmp_path)) == first
    assert {name: t.count() for name, t in read_results(spark, str(tmp_path)).items()} == counts
    other = write_results(done.limit(3), str(tmp_path))
    assert other != first and read_results(spark, str(tmp_path))["trace"].count() == counts["trace"] + 3


def test_filters_reach_stored_tables(spark, tmp_path):
    done = process_batch(fx.raw_events(spark, SF, "leef"), fx.rule_set(), fx.bindings(spark), fx.sources(spark)).processed
    write_results(done, str(tmp_path))
    stored = read_results(spark, str(tmp_path))["normalized"]
    plan = reports.event_filters(stored, source_id="mail", rule_id="mail-leef")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_id,mail)" in plan and "EqualTo(rule_id,mail-leef)" in plan
    plan = reports.event_by_id(stored, fx.sources(spark), "default", "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,x)" in plan


def test_page_does_not_shuffle_raw_rows(spark):
    raw = fx.raw_events(spark, SF, "leef")
    outcomes = raw.select(F.col("trace_id").alias("id"), "trace_id", F.col("received_at").alias("created_at"))
    out = reports.events_page(outcomes, raw, 1, 5)
    assert out.count() == 5 and out.filter("raw_payload IS NULL").count() == 0


@pytest.mark.parametrize(("path", "value"), [
    ("$.l[0:2]", "1"), ("$.l[1:]", "2"), ("$.l[-1]", "3"), ("$.l[-9]", None), ("$.l[5,1]", "2"), ("$['x','b']", "y"), ("$.l[::2]", "1"), ("$..d", "4"), ("$.l[*]", "1"),
])
def test_json_paths(spark, path, value):
    rule = Rule("j@1", "j", 1, "jsonpath", {"paths": {"a": path}}, {"a": "a"})
    df = spark.createDataFrame([('{"l":[1,2,3],"b":"y","c":{"d":4}}', "j@1")], "line string, v string")
    row = RuleSet([rule]).parse_and_check(df, "line", "v").first()
    assert row._error is None and row._values[0].value == value


def test_unknown_json_path_is_an_error_of_its_rule(spark):
    rules = [Rule("p@1", "p", 1, "jsonpath", {"paths": {"a": "$.l[?(@.x)]"}}, {"a": "a"}), Rule("q@1", "q", 1, "jsonpath", {"paths": {"a": "$.b"}}, {"a": "a"})]
    df = spark.createDataFrame([('{"b":1}', "p@1"), ('{"b":2}', "q@1")], "line string, v string")
    got = {r.v: r._error for r in RuleSet(rules).parse_and_check(df, "line", "v").collect()}
    assert got == {"p@1": "Unsupported JSON path: $.l[?(@.x)]", "q@1": None}


def test_arrival_has_no_ties(spark):
    batch = spark.sql("SELECT 's' AS source_id, timestamp_ntz'2024-01-01 00:00:00' AS received_at, 'f' AS file_path, 0L AS block_start, 'same' AS line FROM range(5)")
    events = build_raw_events(placed(batch))
    assert events.select(arrival(events).alias("a")).distinct().count() == 5


def test_catalogue_of_any_size(spark, tmp_path):
    from loglattice.plans import QUERIES

    rule = rules_frame(spark, [Rule("v", "r", 1, "cef", {}, {"src": "ip"})])
    many = rule.crossJoin(spark.range(10_000)).withColumns({
        "rule_id": F.expr("concat('r', id div 4)"), "rule_version_id": F.expr("concat('v', id)"), "version": F.expr("cast(id % 4 AS int)"),
        "status": F.expr("if(id % 4 = 3, 'DRAFT', 'ACTIVE')")}).drop("id")
    got = active_rules(many)
    assert got.columns == many.columns and got.count() == got.select("rule_id").distinct().count() == 2500
    assert got.filter("version <> 2 OR status <> 'ACTIVE'").isEmpty()
    parts = spark.range(1, 30_001).selectExpr("id AS p_partkey", "'n' AS p_name", "cast(id % 50 + 1 AS int) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["read_catalog"](spark, str(tmp_path)).count() == parts.filter("p_size > 45").count() == 3000


def test_stream_query_counts_dead_letters(spark, tmp_path, monkeypatch):
    from loglattice.plans import QUERIES, q_catalog
    from loglattice.sources.results import SCHEMAS

    for n, name in enumerate(("normalized", "unresolved", "dead_letter")):
        spark.range(n).select(F.lit("t").alias("trace_id")).write.parquet(f"{tmp_path}/out/{name}")
        assert "trace_id string" in SCHEMAS[name]
    monkeypatch.setattr(q_catalog, "_streamed", lambda spark, sf: str(tmp_path))
    assert {r.outcome: r.n for r in QUERIES["stream_pipeline"](spark, SF).collect()} == {"unresolved": 1, "dead_letter": 2}
