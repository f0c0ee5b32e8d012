"""Discovery tries the earliest line of a fingerprint once."""

from loglattice.operators.engine import RuleSet
from loglattice.operators.matching import first_passes
from loglattice.operators.rules import Rule


class Counting(RuleSet):
    """Notes how many lines each pass parses."""

    def first_passes(self, unmatched, raw, order, tenant):
        self.tried = [*getattr(self, "tried", []), unmatched.count()]
        return super().first_passes(unmatched, raw, order, tenant)


def test_failed_earliest_lines_are_not_tried_again(spark):
    rules = Counting([Rule("r@1", "r", 1, "regex", {"pattern": r"^ok (?P<a>\w+)"}, {"a": "source.user"}, ["source.user"])])
    rows = [
        ("a", 1, "bad"), ("a", 2, "bad"), ("a", 3, "ok x"), ("a", 4, "ok y"),
        ("b", 1, "ok x"), ("b", 2, "bad"),
        ("c", 1, "bad"), ("c", 1, "ok x"),
        ("d", 7, "bad"), ("e", 1, "bad"), ("e", None, "ok x"),
        ("f", None, "bad"), (None, 1, "ok x"), (None, 2, "ok y"),
    ]
    got = first_passes(spark.createDataFrame(rows, "fingerprint string, seq long, line string"), rules, "line", "seq")
    plain = RuleSet(rules.rules).first_passes(spark.createDataFrame(rows, "fingerprint string, seq long, line string"), "line", "seq", None)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    # First a1, b1, c1 twice, d7, e1; then the rest of a, e and f, and the lines without a fingerprint.
    assert rules.tried == [6, 3 + 1 + 1 + 2]
