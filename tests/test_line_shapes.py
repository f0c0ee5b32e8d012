"""Line structures in Arrow batches: equal to one substitution after the other, and digits cost nothing."""

import random
import re

import pyarrow as pa
import pytest
from loglattice.functions import lineshape, text
from pyspark.sql import functions as F

PARTS = [
    "0xdeadbeef", "1xdeadbeef", "0x12345678", "00x12345678", "1x12345678", "3abc", "5_", "_5", "0x", "x0", "10x", "12345678", "1234567", "a1b2c3d4", "10.0.0.1", "1.2.3.4.5", "1000.0.0.1",
    "fe80:1:2:3:4:5:6:7", "00:11:22:aa:bb:cc", "ab-cd-ef-ab-cd-ef", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.123+0100", "9Mar 3 10:11:12", "Mar  3 10:11:12", "https://a.b/c?d=1-",
    "http://1", "https://12.x", "a.1@b.co|", "1@2.com", "x@y.z1", "<IP>", "<7>", "\x0b", "\x1f", "\t\t", "  ", " ", "-", "[", "\x00", "\r\n", "T", "Z", "h", "",
]


def model(line):
    for name, pattern in text.TOKEN_CLASSES:
        line = re.sub(pattern, f"<{name}>", line)
    return re.sub(r"\s+", " ", re.sub(text.WORD_PATTERN, "<WORD>", line)).strip()


def awkward(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " ", ",", "=", "x", "7"]) for _ in range(rng.randint(0, 8))) for _ in range(n)]


def test_batches_equal_one_substitution_after_the_other():
    lines = [None, "", *awkward(20_000), None]
    got = lineshape.text_structures(pa.array(lines, pa.string()), text._arrow_masks()).to_pylist()
    assert got == [None if line is None else model(line) for line in lines]
    sliced = lineshape.text_structures(pa.array(lines, pa.string()).slice(7, 50), text._arrow_masks()).to_pylist()
    assert sliced == [model(line) for line in lines[7:57]]
    assert lineshape.text_structures(pa.array([None], pa.string()), text._arrow_masks()).to_pylist() == [None]
    assert lineshape.text_structures(pa.array([], pa.string()), text._arrow_masks()).to_pylist() == []


def test_lines_that_differ_in_digits_are_masked_once(monkeypatch):
    seen = []
    masked = lineshape._masked
    monkeypatch.setattr(lineshape, "_masked", lambda texts, masks: seen.append(len(texts) - texts.null_count) or masked(texts, masks))
    lines = [f"at 10.0.{i % 10}.{i % 7} port={1000 + i} id={10_000_000 + i}" for i in range(5000)]
    got = lineshape.text_structures(pa.array(lines), text._arrow_masks()).to_pylist()
    assert got == [model(line) for line in lines] and sum(seen) < 300


def test_ascii_lines_leave_the_jvm_matcher(spark):
    lines = [*awkward(300, 9), '{"a": 1}', ' {"a": "10.0.0.1"} ', "{broken}", "été 5 {", "{}", None]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, t string")
    got = df.select("i", text.structure(F.col("t")).alias("s"), text.text_structure(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [None if line is None else model(line) for line in lines]
    shaped = {'{"a": 1}': "{a:<NUM>}", ' {"a": "10.0.0.1"} ': "{a:<IP>}", "{broken}": "<INVALID_JSON>", "{}": "{}"}
    assert [r.s for r in got] == [None if line is None else shaped.get(line, model(line)) for line in lines]
    # The JVM patterns of ASCII lines, whose time per line was several times as long, are gone from the plan.
    plan = df.select(text.structure(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert text._ascii_form(text._guarded("NUM", text._PATTERN_OF["NUM"])) not in plan and "structures(" in plan


@pytest.mark.parametrize("column", ["structure", "text_structure"])
def test_undecodable_text_is_masked_on_the_jvm(spark, column):
    got = spark.sql("SELECT cast(X'6120800035' AS string) AS t").select(getattr(text, column)(F.col("t")).alias("s")).first()
    assert got.s == "<WORD> �\x00<<WORD>>"
