"""Rule lock against a plain model of the transition table."""

import random

import numpy as np
import pandas as pd
import pytest
from loglattice.operators import lock
from pyspark.sql import functions as F


class Model:
    """The transition table, event by event."""

    def __init__(self):
        self.locked, self.rule, self.seen, self.miss, self.since_lock, self.since_miss = False, None, 0, 0, 0, 0

    def step(self, own):
        spot = False
        if self.locked:
            rate = 25 if self.miss > 0 and self.since_miss < 50 else 50 if self.since_lock < 100 else 500
            spot = (self.since_lock + 1) % rate == 0
        used = self.rule if self.locked and not spot else own
        if not self.locked:
            if used is not None:
                self.seen += 1
                if self.seen >= 10:
                    self.locked, self.rule, self.miss, self.since_lock, self.since_miss = True, used, 0, 0, 0
        elif not spot or used == self.rule:
            self.since_lock += 1
            self.since_miss += 1
        elif self.miss + 1 >= 5:
            self.__init__()
        else:
            self.miss, self.since_miss, self.since_lock = self.miss + 1, 0, self.since_lock + 1
        return used, spot


def sequences(seed, n):
    rng = random.Random(seed)
    names = ["a", "b", None]
    out, style = [], rng.choice(["mixed", "stable", "blocks"])
    current = "a"
    for _ in range(n):
        if style == "mixed":
            current = rng.choice(names)
        elif style == "stable":
            current = "a" if rng.random() < 0.97 else rng.choice(names)
        elif rng.random() < 0.004:
            current = rng.choice(names)
        out.append(current)
    return out


def codes(seq):
    return np.array([{"a": 0, "b": 1, None: -1}[x] for x in seq])


@pytest.mark.parametrize("seed", range(12))
def test_replay_equals_model(seed):
    seq = sequences(seed, 3000)
    model = Model()
    expected = [model.step(x) for x in seq]
    flags, used, last = lock.replay(0, codes(seq))
    assert [["a", "b", None][u] for u in used] == [u for u, _ in expected]
    assert list(flags["spot_check"]) == [s for _, s in expected]


@pytest.mark.parametrize("seed", range(12))
def test_chunk_tables_compose(seed):
    seq = codes(sequences(seed, 4000))
    cuts = sorted(random.Random(seed).sample(range(1, 4000), 5))
    state = 0
    for part in np.split(seq, cuts):
        table = lock.advance(np.arange(lock.state_count(2)), part)
        _, _, exit_state = lock.replay(state, part)
        assert table[state] == exit_state
        state = int(table[state])
    assert state == lock.replay(0, seq)[2]


@pytest.mark.parametrize("fan_in", [2, 64])
def test_distributed_lock_splits_hot_containers(spark, fan_in):
    rows, expected, finals = [], {}, {}
    for c, n in [("hot", 6000), ("small", 300), ("tiny", 4), ("mid", 900)]:
        model = Model()
        for i, own in enumerate(sequences(len(c), n)):
            rows.append((c, i, f"{c}-{i}", own))
            expected[f"{c}-{i}"] = model.step(own)
        finals[c] = model
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["job_id", "seq", "trace_id", "own"]).astype(object), "job_id string, seq long, trace_id string, own string")
    out = lock.rule_lock(df, "job_id", "seq", ["a", "b"], "own", chunk_rows=500, fan_in=fan_in)
    got = {r.trace_id: (r.rule_version_id, r.spot_check) for r in out.collect()}
    assert got == expected
    states = {r.container: r for r in lock.lock_states(out).collect()}
    for c, m in finals.items():
        s = states[c]
        assert (s.status == "LOCKED") == m.locked and s.rule_version_id == m.rule
        assert (s.sample_count_seen, s.mismatch_count) == (m.seen, m.miss)
        assert (s.events_since_lock, s.events_since_mismatch) == (m.since_lock, m.since_miss)


def test_lock_carries_state_between_batches(spark):
    seq = sequences(3, 2500)
    rows = [("j", i, f"t{i}", own) for i, own in enumerate(seq)]
    df = spark.createDataFrame(rows, "job_id string, seq long, trace_id string, own string")
    whole = lock.rule_lock(df, "job_id", "seq", ["a", "b"], "own")
    state, parts = None, []
    for low, high in [(0, 700), (700, 1500), (1500, 2500)]:
        batch = df.filter((F.col("seq") >= low) & (F.col("seq") < high))
        out = lock.rule_lock(batch, "job_id", "seq", ["a", "b"], "own", initial=state).persist()
        state = spark.createDataFrame(lock.lock_states(out, state).collect(), lock.STATE_SCHEMA)
        parts.extend(out.collect())
    key = lambda r: r.position
    assert sorted(parts, key=key) == sorted(whole.collect(), key=key)
    assert state.collect() == lock.lock_states(whole).collect()


def test_spot_check_rate(spark):
    cases = [(1, 10, 500, 25), (0, 10, 50, 50), (1, 60, 50, 50), (0, 0, 100, 500), (2, 50, 400, 500)]
    df = spark.createDataFrame(cases, "m int, sm int, sl int, expected int")
    got = df.select(lock.spot_check_rate(F.col("m"), F.col("sm"), F.col("sl")).alias("r"), "expected").collect()
    assert all(r.r == r.expected for r in got)
