"""Cheap forms of parsing give what the general forms give, and discovery spares lines what cannot accept them."""

import shlex

from pyspark.sql import functions as F

from loglattice.operators.engine import RuleSet
from loglattice.operators.parsers.keyvalue import kv_quoted, shell_tokens
from loglattice.operators.parsers.registry import pairs_of
from loglattice.operators.rules import Rule
from loglattice.plans import fixtures as fx

KV = [
    'a=1 b="x y" c=z', ' a="" "b=1 2"  c = d ', 'a="x"y" z"', 'a=1 a=2 a="3 4"', "a='x y' b=2", 'a="x\\"y" b=1', "a=1\\ 2 b=3", 'a="', "", '""', '"a b"=1 =x', "a﷐b=1 c=\"﷐\"", 'x="\n" y=1\t',
]


def test_double_quotes_as_the_shell(spark):
    rows = spark.createDataFrame([(line,) for line in KV] + [(None,)], "line string")
    general = pairs_of(shell_tokens(F.col("line")), "=")
    for line, got, want in rows.select("line", kv_quoted(F.col("line")), general).collect():
        if line is None:
            assert got is None
            continue
        try:
            tokens = shlex.split(line)
        except ValueError:
            continue
        assert got == want
        if "﷐" not in line:
            assert [tuple(p) for p in got] == [tuple(t.split("=", 1)) for t in tokens if "=" in t]


def test_last_of_equal_keys(spark):
    rule = Rule("k@1", "k", 1, "kv", {}, {"a": "source.user", "b": "source.ip"}, ["source.user"], {"source.ip": "ip"})
    rows = spark.createDataFrame([("a=1 a=2 b=1.1.1.1",), ("a=1 b=1.1.1.1 b=x",), ("b=1.1.1.1",), ("a=1",)], "line string").withColumn("rv", F.lit("k@1"))
    out = RuleSet([rule]).parse_and_check(rows, "line", "rv").select("_values", "_error").collect()
    assert [(r._values[0].value, r._error) for r in out] == [
        ("2", None), ("1", "Validation failed: Field 'source.ip' with value 'x' does not match type constraint 'ip'"),
        (None, "Validation failed: Missing required fields: ['source.user']"), ("1", None)]


def test_discovery_gates_families(spark):
    """Only texts that hold what a rule needs are parsed for it; quoted keys and escaped names still pass."""
    lines = ["CEF:0|a|b|c|d|e|f|src=1.1.1.1", 'x="1" "src"ip=10.0.0.1 dstport=1 act"ion"=pass', '{"event\\u0054ime":"2024-01-01T00:00:00Z","eventName":"x"}', "a=1 b=2", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    rules = fx.rule_set()
    found = rules.first_passing(rows, "line", None, "rule").orderBy("i").collect()
    assert [r.rule for r in found] == ["gate-cef@1", "fw-kv@1", "cloud-json@2", None, None]
    gated = rules.prepare(rows, "line", None).orderBy("i").collect()
    kv = rules.slot(next(r for r in rules.rules if r.rule_id == "fw-kv"))
    assert [r[kv]["keys"] is not None for r in gated] == [False, True, False, False, False]


def test_one_rule_set_reads_any_version_column(spark):
    rules = fx.rule_set()
    for name in ("rv", "rule_version_id"):
        rows = spark.createDataFrame([("CEF:0|a",)], "line string").withColumn(name, F.lit("gate-cef@1"))
        assert rules.parse_and_check(rows, "line", name).first()._error == "Invalid CEF format, expected at least 8 pipe-separated fields, got 2"
