"""Events keep their ids when they are read again; runs are visible as a whole or not at all."""

import pytest
from loglattice.operators.ingest import build_raw_events
from loglattice.sources import manifest
from loglattice.sources.lines import read_log_lines, stream_log_lines
from loglattice.sources.results import read_results
from pyspark.sql import functions as F


def ids(spark, path):
    rows = build_raw_events(read_log_lines(spark, str(path), "s")).select("file_path", "line_no", "line", "trace_id").collect()
    assert len({r.trace_id for r in rows}) == len(rows)
    return {(r.file_path.rsplit("/", 1)[1], r.line_no, r.line): r.trace_id for r in rows}


def test_ids_stay_when_files_are_added_and_splits_differ(spark, tmp_path):
    text = "".join(f"{'same' if i % 3 else ''}\r\n" if i % 2 else f"line {i} {'x' * (i % 90)}\n" for i in range(900))
    (tmp_path / "b.log").write_text(text)
    (tmp_path / "c.log").write_text("same\n\n \nsame")
    first = ids(spark, tmp_path)
    lines = text.split("\n")
    assert {k[1]: k[2] for k in first if k[0] == "b.log"} == {i: t.strip() for i, t in enumerate(lines) if t.strip()}
    assert {k[1] for k in first if k[0] == "c.log"} == {0, 3}
    (tmp_path / "a.log").write_text("one more\n" * 50)
    (tmp_path / "empty.log").write_text("")
    second = ids(spark, tmp_path)
    assert len(second) == len(first) + 50 and first.items() <= second.items()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert read_log_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        assert ids(spark, tmp_path) == second
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sequence_follows_files_and_lines(spark, tmp_path):
    for name in "ba":
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i}\n" for i in range(40)))
    rows = read_log_lines(spark, str(tmp_path), "s").orderBy("seq").collect()
    assert [r.line for r in rows] == [f"{name}{i}" for name in "ab" for i in range(40)]


SCHEMAS = {"good": "id long, at timestamp_ntz, day date", "bad": "id long, at timestamp_ntz"}


def tables(spark, good, bad):
    at = F.expr("timestamp_ntz'2024-01-01 10:00:00'")
    return {"good": spark.range(good).withColumn("at", at), "bad": spark.range(good, good + bad).withColumn("at", at)}


def publish(spark, path, run, good, bad, **more):
    return manifest.publish(spark, str(path), run, tables(spark, good, bad), {"good": "at"}, **more)


def counts(spark, path):
    return tuple(manifest.published(spark, str(path), name, schema).count() for name, schema in SCHEMAS.items())


def test_retry_with_fewer_rows_leaves_none_of_the_first(spark, tmp_path):
    publish(spark, tmp_path, "r", 9, 4)
    publish(spark, tmp_path, "s", 1, 1)
    assert counts(spark, tmp_path) == (10, 5)
    publish(spark, tmp_path, "r", 3, 0)
    assert counts(spark, tmp_path) == (4, 1)
    publish(spark, tmp_path, "r", 0, 0)
    assert counts(spark, tmp_path) == (1, 1)
    assert manifest.vacuum(spark, str(tmp_path), list(SCHEMAS)) == 3 and counts(spark, tmp_path) == (1, 1)
    assert manifest.vacuum(spark, str(tmp_path), list(SCHEMAS)) == 0


def test_half_a_run_is_invisible(spark, tmp_path):
    publish(spark, tmp_path, "r", 2, 2)
    broken = {**tables(spark, 5, 5), "bad": spark.range(1).select(F.raise_error(F.lit("lost")).cast("long").alias("id"), F.expr("timestamp_ntz'2024-01-01 10:00:00'").alias("at"))}
    with pytest.raises(Exception, match="lost"):
        manifest.publish(spark, str(tmp_path), "r", broken, {"good": "at"})
    assert counts(spark, tmp_path) == (2, 2)


def test_overwrite_drops_earlier_runs_from_view(spark, tmp_path):
    publish(spark, tmp_path, "r", 5, 5)
    publish(spark, tmp_path, "s", 1, 2, fresh=True)
    assert counts(spark, tmp_path) == (1, 2)
    assert manifest.published(spark, str(tmp_path), "good", SCHEMAS["good"], before="s").count() == 0


def test_readers_prune_other_attempts(spark, tmp_path):
    publish(spark, tmp_path, "r", 5, 5)
    plan = manifest.published(spark, str(tmp_path), "good", SCHEMAS["good"])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert manifest.published(spark, str(tmp_path), "none", "id long").count() == 0


def test_failed_micro_batch_becomes_dead_letters(spark, tmp_path):
    from loglattice.operators.engine import RuleSet
    from loglattice.operators.parsers import Parser, register_parser
    from loglattice.operators.parsers.registry import absent
    from loglattice.operators.rules import Rule
    from loglattice.streaming.pipeline import stream_pipeline

    register_parser("failing", Parser(lambda raw, rule: F.raise_error(F.lit("no memory")).cast("string"), lambda prepared, rule: prepared, lambda prepared, rule, key: absent(), lambda rule: "failing"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\n\ntwo\n")
    lines = stream_log_lines(spark, str(tmp_path / "in"), blank=True).withColumn("source_id", F.lit("s"))
    known = spark.createDataFrame([], "rule_id string, fingerprint string, created_at timestamp")
    rules = RuleSet([Rule("f@1", "f", 1, "failing", {}, {"a": "a"})])
    stream_pipeline(lines, rules, lambda: known, str(tmp_path / "out"), str(tmp_path / "ck"), on_error="dead_letter").awaitTermination()
    found = read_results(spark, str(tmp_path / "out"))["dead_letter"].collect()
    assert [r.stage for r in found] == ["unexpected_error"] * 2 and len({r.trace_id for r in found}) == 2
