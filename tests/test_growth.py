"""Helpers whose cost must grow no faster than their input: splits, large lookups, discovery, derived lines."""

from loglattice.operators import catalog, matching, ranking
from loglattice.operators.engine import RuleSet
from loglattice.operators.rules import Rule
from loglattice.plans import fixtures as fx
from loglattice.session import lookup_join
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_bound_makes_no_task_of_every_few_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("rule_id"), F.col("id").alias("asked"), F.lit(None).cast("string").alias("x"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranking.range_parts(rows, 10) <= usual
    assert ranking.range_parts(rows, 1000) == 4
    got = catalog.next_version(spark.createDataFrame([(0, 7)], "rule_id long, version int"), rows, "asked", max_group=10)
    assert got.filter((F.col("version") - F.when(F.col("rule_id") == 0, 7).otherwise(0)) * 3 - 3 + F.col("rule_id") != F.col("asked")).count() == 0


def test_a_large_lookup_is_neither_broadcast_nor_copied(spark):
    facts = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup_join(facts, lookup, "k", max_rows=1)
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert joined.filter("v IS NULL").count() == joined.filter("k > 4").count() > 0 and joined.count() == 300


class Counted(RuleSet):
    """Counts the lines that are tried with all rules."""

    tried = 0

    def first_passes(self, unmatched, raw, order, tenant):
        self.tried += unmatched.count()
        return super().first_passes(unmatched, raw, order, tenant)


def test_only_the_earliest_line_is_tried_where_it_passes(spark):
    rules = Counted([Rule("a@1", "a", 1, "regex", {"pattern": r"^a(?P<n>\d+)$"}, {"n": "n"}, ["n"]), Rule("b@1", "b", 1, "regex", {"pattern": r"^(?P<n>[ab]\d+)$"}, {"n": "n"}, ["n"])])
    rows = [("good", i, f"a{i}") for i in range(50)] + [("late", 1, "no"), ("late", 2, "b2"), ("late", 3, "a3"), ("late", None, "a0")]
    rows += [("tie", 4, "no"), ("tie", 4, "b4"), ("tie", 5, "a5"), ("never", 1, "x"), (None, 1, "no"), (None, 2, "a2"), ("unplaced", None, "a1")]
    lines = spark.createDataFrame(rows, "fingerprint string, seq int, line string")
    got = sorted(matching.first_passes(lines, rules, "line", "seq").collect(), key=str)
    assert got == sorted(RuleSet(rules.rules).first_passes(lines, "line", "seq", None).collect(), key=str)
    assert rules.tried < 20


def test_rows_are_spread_before_they_become_lines(spark):
    plan = fx.lines(spark, SF, "kv", "csv")._jdf.queryExecution().optimizedPlan().toString()
    for below in plan.split("Repartition")[1:]:
        assert "concat(" not in below.split("Project")[0]
    one_file = fx.lines(spark, SF, "asa")
    assert one_file.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    first = plan.index("Repartition")
    assert "concat(" in plan[:first]


def test_reports_read_a_table_of_what_they_need(spark):
    from loglattice.plans import q_events

    p, _, _ = q_events._report_frames(spark, SF)
    assert "FileScan parquet" in plan_of(p) and not {"payload", "_fields", "_json"} & set(p.columns)
