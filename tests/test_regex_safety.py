"""Patterns whose loops share their text are matched in linear time; all others stay on the JVM."""

import random
import re
import time

import pytest
from loglattice.operators.engine import RuleSet
from loglattice.operators.parsers.regex import linear_groups, linear_pattern, linear_refusal, regex_groups
from loglattice.operators.regexsafety import chained_loops
from loglattice.operators.rules import Rule, load_rules, rejected, rules_frame
from loglattice.plans import fixtures as fx
from pyspark.sql import functions as F


@pytest.mark.parametrize(("pattern", "loops"), [
    (r"^\d*\d*\d*\d*x$", 4), (r"^.*a.*b.*c.*d$", 4), (r'^"(?:\\.|[^"\\])*"$', 1), (r"^.*$", 1), (r"^.*a.*b$", 2), (r"\d+\.\d+", 2), (r"^(\S+) (\S+) (.*)$", 1),
    (r"^\w+\s*=\s*\w+$", 1), (fx.ASA_PATTERN, 1), (fx.CSV_PATTERN, 1), (r"^\d{1,50}\d{1,50}\d{1,50}x", 3), (r"^(?:\d{1,3}\.){3}\d+", 1), (r"^a?a?a?a$", 0), (r"x", 1), ("(", 0),
    (r"^(?:a*b?)a*[ab]*c", 3), (r"^(?:.*x|.*y)z.*", 2), (r"(?s)^a.*a.*a.*", 3), (r"^[^,]*,[^,]*,[^,]*$", 1), (r"^\s*\S+\s*\S+$", 2),
])
def test_chained_loops(pattern, loops):
    assert chained_loops(pattern) == loops


def test_slow_pattern_takes_linear_time(spark):
    rule = Rule("s@1", "s", 1, "regex", {"pattern": r"^(?P<a>\d*)\d*\d*(\d*)x$"}, {"a": "a", "capture_2": "b"}, ["a"])
    rules = load_rules(rules_frame(spark, [rule]))
    assert not rejected(rules)
    df = spark.createDataFrame([("1" * 100_000 + "y", "s@1"), ("123x", "s@1"), ("x", "s@1"), (None, "s@1"), ("1x", None)], "line string, v string")
    start = time.time()
    got = RuleSet(rules).parse_and_check(df, "line", "v").collect()
    assert time.time() - start < 30
    assert [r._error for r in got] == ["Regex did not match the event", None, None, "Regex did not match the event", None]
    assert [v.value for v in got[1]._values] == ["123", ""] and got[4]._values is None


def test_both_matchers_agree(spark):
    rng = random.Random(3)
    parts = [r"\d+", r"(\w*)", r"(?P<n>a|b)?", r"[^x\]]*", r"(?:c(d)?)+", r"\s", r".*", r"\.", r"x{1,2}", r"(?i:q)", "-"]
    patterns = ["".join(rng.sample(parts, rng.randrange(1, 5))) for _ in range(25)]
    lines = ["".join(rng.choice("ab12cdx. -q]") for _ in range(rng.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    for pattern in patterns:
        assert linear_refusal(pattern) == "", linear_pattern(pattern)
        rows = df.select("line", F.slice(regex_groups(F.col("line"), pattern), 2, 99).alias("a"), F.slice(linear_groups(F.col("line"), pattern), 2, 99).alias("b")).collect()
        for r in rows:
            found = re.search(pattern, r.line)
            assert r.b == (r.a and r.a[: len(r.b)]) == ([g or "" for g in found.groups()] if found else None), (pattern, r)


def test_pattern_without_any_fast_matcher_is_refused(spark):
    pattern = r"^(?>\d*)\d*\d*\d*x$"
    rule, = load_rules(rules_frame(spark, [Rule("v", "r", 1, "regex", {"pattern": pattern}, {"x": "x"})]))
    assert "share their text" in rule.defect
