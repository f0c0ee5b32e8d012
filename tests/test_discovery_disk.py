"""Discovery writes no whole events."""

from loglattice.operators import pipeline
from loglattice.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_discovery_writes_only_what_it_reads(spark, monkeypatch):
    seen = []
    real = pipeline.written
    monkeypatch.setattr(pipeline, "written", lambda df, *rest: seen.append((df.columns, df.count())) or real(df, *rest))
    events = fx.raw_events(spark, SF, "kv", "cef", "json")
    columns = ["trace_id", "rule_version_id", "payload", "digest"]
    found, fresh = pipeline.resolve_rules(events, fx.rule_set(), fx.bindings(spark), fx.sources(spark))
    assert [c for c, _ in seen] == [["fingerprint", "seq", "line", "tenant_id"]] and 0 < seen[0][1] < events.count()
    whole, same = pipeline.resolve_rules(events, fx.rule_set(), fx.bindings(spark), fx.sources(spark), whole=True)
    assert {"payload", "digest", "line"} <= set(seen[1][0])
    assert found.select(*columns).exceptAll(whole.select(*columns)).count() == 0 and found.count() == whole.count() == events.count()
    assert sorted(fresh.collect()) == sorted(same.collect()) != []
