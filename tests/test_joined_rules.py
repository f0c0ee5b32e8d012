"""Rules as joined rows give the results of rules as columns, for any number of rules."""

import time
from dataclasses import replace

import pytest
from conftest import SF
from loglattice.operators.engine import RuleSet
from loglattice.operators.joined import COLUMN_RULES, JoinedRules, LiteralIndex, compile_rules, required_literal
from loglattice.operators.pipeline import process_batch
from loglattice.operators.rules import Rule
from loglattice.plans import fixtures as fx
from loglattice.sources.results import split_outcomes
from pyspark.sql import functions as F

ODD_RULES = [
    Rule("opt@1", "opt", 1, "regex", {"pattern": r"^a(?P<x>\d+)?(b)?(?:c|(?P<y>d))z?$"}, {"x": "event_time", "y": "network.src_ip", "capture_2": "n", "capture_9": "never", "nosuch": "m"}),
    Rule("two@1", "two", 1, "kv", {"delimiter": ";", "kv_separator": ":="}, {"k": "source.ip", "l": "source.ip", "m": "my.key"}, ["source.ip"], {"source.ip": "ip"}),
    Rule("sh@1", "sh", 1, "keyvalue", {}, {"k": "source.user", "n": "n"}, ["source.user"], {"n": "int"}),
    Rule("wild@1", "wild", 1, "jsonpath", {"paths": {"a": "$.l[*].v", "b": "$..deep", "c": "c.d", "e": "$.l[-1]"}}, {"a": "a", "b": "b", "c": "source.user", "e": "e"}, ["source.user"]),
    Rule("badpath@1", "badpath", 1, "jsonpath", {"paths": {"a": "$.l[?(@.x)]"}}, {"a": "a"}),
    Rule("chain@1", "chain", 1, "regex", {"pattern": r"^q(?P<a>\d*)\d*\d*\d*x(e)?$"}, {"a": "a", "capture_2": "b"}, ["a"]),
    Rule("none@1", "none", 1, "nosuch", {}, {"a": "a"}), Rule("nopat@1", "nopat", 1, "regex", {}, {"a": "a"}), Rule("brk@1", "brk", 1, "regex", {"pattern": "("}, {"a": "a"}),
    replace(Rule("def@1", "def", 1, "regex", {"pattern": "x"}, {"a": "a"}), defect="Unsafe regex pattern: test"),
    Rule("xml@1", "xml", 1, "xml", {}, {"b": "n", "a/@q": "q", "zz": "zz"}, ["q"]), Rule("empty@1", "empty", 1, "cef", {}, {}),
    Rule("cef@1", "cef", 1, "cef", {}, {"src": "source.ip", "name": "name", "device_vendor": "v"}, ["source.ip", "v"]),
]
ODD_LINES = [
    "a12bc", "ac", "ad", "adz", "a﷐c", "k:=10.0.0.1;m:=' x '", "l:=1.1.1.1;k:=nope;m:=", "k:=1.1.1.1;k:=2.2.2.2:=3;junk", "k=v n=1", 'k="a b" n=x', 's"k"=1 \'k\'=2', 'k="open',
    '{"l":[{"v":1},{"v":2}],"c":{"d":"u"},"x":{"deep":[1]}}', '{"c":{"d":null}}', '{"\\u0063":{"d":"esc"}}', "{bad", "[1]", "q123x", "qx", "qxe", "q" + "1" * 3000, "<a q='1'><b>t</b></a>", "<a><b/></a>", "<a",
    "CEF:0|V|P|1|2|N|5|src=1.2.3.4 msg=a b", "CEF:0|V|P|1|2|N|5|", "CEF:0|V", "", None, "LEEF:1.0|a|b|c|d|k=v",
]


def rows(df):
    return sorted((repr(r) for r in df.collect()))


@pytest.mark.parametrize("mode", ["exact"])
def test_parsing_agrees_on_odd_rules(spark, mode):
    lines = spark.createDataFrame([(line,) for line in ODD_LINES], "line string")
    pairs = lines.crossJoin(spark.createDataFrame([(r.rule_version_id,) for r in ODD_RULES] + [(None,), ("other@1",)], "rv string"))
    columns = ["line", "rv", "_values", "_fields", "_error"]
    want = rows(RuleSet(ODD_RULES, datetime_mode=mode).parse_and_check(pairs, "line", "rv").select(*columns))
    got = rows(JoinedRules(ODD_RULES, spark, datetime_mode=mode).parse_and_check(pairs, "line", "rv").select(*columns))
    assert [a for a, b in zip(got, want) if a != b] == [] and len(got) == len(want)


@pytest.mark.parametrize("evidence", [False, True])
def test_discovery_agrees_on_odd_rules(spark, evidence):
    lines = spark.createDataFrame([(line, "default") for line in ODD_LINES if line is not None], "line string, tenant_id string")
    rules = ODD_RULES[::-1] if evidence else [r for r in ODD_RULES if r.required_fields]
    want = rows(RuleSet(rules, require_evidence=evidence).first_passing(lines, "line", "tenant_id"))
    assert rows(JoinedRules(rules, spark, require_evidence=evidence).first_passing(lines, "line", "tenant_id")) == want


def test_candidates_hold_every_accepting_rule():
    assert required_literal(ODD_RULES[2]) == "k" and required_literal(ODD_RULES[5]) in ("q", "x") and required_literal(ODD_RULES[12]) == "src="
    index = LiteralIndex(ODD_RULES)
    assert index.always == [] or all(required_literal(ODD_RULES[n]) == "" for n in index.always)


@pytest.fixture(scope="module")
def batches(spark):
    events = fx.raw_events(spark, SF, "kv", "json", "cef", "xml", "noise")
    columns, joined = fx.rule_set(), JoinedRules(fx.rule_set().rules, spark, fx.MASK_KEY)
    return [process_batch(events, rules, fx.bindings(spark), fx.sources(spark)) for rules in (columns, joined)]


def test_whole_pipeline_agrees(batches):
    a, b = (split_outcomes(batch.processed) for batch in batches)
    for name in a:
        columns = [F.to_json(c).alias(c) if c == "unmapped_fields" else F.col(c) for c in a[name].columns if c != "processed_at"]
        left, right = a[name].select(*columns), b[name].select(*columns)
        assert left.exceptAll(right).isEmpty() and left.count() == right.count(), name
    assert rows(batches[0].new_bindings.select("rule_id", "fingerprint")) == rows(batches[1].new_bindings.select("rule_id", "fingerprint"))


def many_rules(n):
    kinds = [fx.rule_set().rules[i % len(fx.rule_set().rules)] for i in range(n)]
    return fx.rule_set().rules + [
        replace(kind, rule_version_id=f"m{i}@1", rule_id=f"m{i}", created_at="2025-01-01 00:00:00",
                **({"parser_definition": {"pattern": rf"^only{i} (?P<a>\S+) (?P<b>\d+)$"}, "field_mappings": {"a": f"f{i}", "b": "event_time"}, "required_fields": ["event_time"], "type_constraints": {}}
                   if kind.parser_type == "regex" else {})) for i, kind in enumerate(kinds)]


def test_two_thousand_rules_plan_in_seconds(spark, batches):
    rules = many_rules(2_000)
    events = fx.raw_events(spark, SF, "leef", "noise")
    compiled = compile_rules(rules, spark, fx.MASK_KEY)
    assert isinstance(compiled, JoinedRules) and not isinstance(compile_rules(rules[:COLUMN_RULES], spark), JoinedRules)
    matched = events.withColumns({"rule_version_id": F.lit("m7@1"), "tenant_id": F.lit("default"), "namespace": F.lit("n"), "fingerprint": F.lit("f")})
    start = time.time()
    compiled.parse_and_check(matched, "line", "rule_version_id")._jdf.queryExecution().executedPlan()
    compiled.passing_pairs(matched, "line", "tenant_id", ["seq"])._jdf.queryExecution().executedPlan()
    assert time.time() - start < 5
    done = process_batch(events, compiled, fx.bindings(spark), fx.sources(spark)).processed
    first = process_batch(events, fx.rule_set(), fx.bindings(spark), fx.sources(spark)).processed
    columns = ["trace_id", "rule_id", "outcome", "payload_json"]
    assert done.select(*columns).exceptAll(first.select(*columns)).isEmpty() and done.count() == first.count()


def test_lines_are_parsed_once_for_all_candidates(spark):
    """Rules of a family that cannot parse the line are left before anything is read for them."""
    rules = [Rule(f"j{i}@1", f"j{i}", 1, "jsonpath", {"paths": {"a": "$.key"}}, {"a": f"f{i}"}, [f"f{i}"]) for i in range(60)]
    joined = JoinedRules(rules, spark)
    rows_ = spark.createDataFrame([(1, '{"key":1}'), (2, '{"key":'), (3, None)], "i int, line string")
    whole = {r.i: r for r in joined._whole(rows_, "line").collect()}
    assert "json" not in whole[1]._refused and "json" in whole[2]._refused
    pairs = joined.passing_pairs(rows_, "line", None, ["i"]).collect()
    assert sorted((r.i, r._number) for r in pairs) == [(1, n) for n in range(60)]
