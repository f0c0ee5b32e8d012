"""Shapes are masked once a task, string tags and digests once for equal shapes."""

import random
import re

import pyarrow as pa
from loglattice.functions import jsonshape, lineshape, text
from pyspark.sql import functions as F
from test_line_shapes import awkward, model


def counted(monkeypatch):
    seen, masked = [], lineshape._masked
    monkeypatch.setattr(lineshape, "_masked", lambda texts, masks: seen.append(len(texts) - texts.null_count) or masked(texts, masks))
    return seen


def test_words_that_begin_with_a_digit_do_not_unshare_a_line(monkeypatch):
    seen = counted(monkeypatch)
    lines = [f"{i % 10},0x0,3rd 10.0.{i % 7}.{i % 10},{1000 + i},tcp" for i in range(5000)]
    got = lineshape.text_structures(pa.array(lines), text._arrow_masks()).to_pylist()
    assert got == [model(line) for line in lines] and "0x0" in got[0] and "3rd" in got[0] and sum(seen) < 50


def test_later_batches_reuse_shapes(monkeypatch):
    seen = counted(monkeypatch)
    structures = lineshape.Structures(text._arrow_masks())
    for start in (1000, 2000, 3000):
        lines = [None, *(f"port={start + i} 5x id" for i in range(500))]
        assert structures(pa.array(lines)).to_pylist() == [None if line is None else model(line) for line in lines]
    assert sum(seen) == 1


def test_a_full_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(lineshape, "KNOWN_BYTES", 2000)
    structures, lines = lineshape.Structures(text._arrow_masks()), awkward(3000, 21)
    for i in range(0, len(lines), 200):
        assert structures(pa.array(lines[i : i + 200], pa.string())).to_pylist() == [model(line) for line in lines[i : i + 200]]
        assert len(structures.known[0]) <= 400


def test_string_tags_equal_the_classes():
    classes = [(f"<{name}>", re.compile(pattern)) for name, pattern in text.TOKEN_CLASSES]
    rng, tag_of = random.Random(3), jsonshape.string_tags()
    values = [*awkward(3000, 4), "0x12345678", "1x12345678", "2024-01-02T03:04:05Z", "\ud800", "٣", "٣1", "7" * 80, *(str(rng.randrange(10**k)) for k in range(1, 12))]
    assert [tag_of(v) for v in values] == [next((tag for tag, p in classes if p.fullmatch(v)), "<STR>") for v in values]


def test_fingerprints_are_digests_of_structures(spark):
    lines = [*awkward(200, 8), '{"a": "10.0.0.1"}', " {broken} ", "été 5", "{", "} {", "　{}　", "", None]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, t string")
    t = F.col("t")
    got = df.select(text.fingerprint(t).alias("f"), text.scoped_hash(text.structure(t)).alias("g"),
                    text.text_fingerprint(t, F.lit("v")).alias("h"), text.scoped_hash(text.text_structure(t), F.lit("v")).alias("k")).collect()
    assert all(r.f == r.g and r.h == r.k for r in got) and got[-1].f is None and got[0].f
