"""Queries: matching, normalisation, outcomes and read reports over the derived events."""

from __future__ import annotations


from pyspark.sql import functions as F

from loglattice.functions.ids import event_id_for, storage_uri
from loglattice.functions.masking import mask_hmac, mask_value, normalize_action
from loglattice.functions.timefmt import normalize_timestamp
from loglattice.operators import matching, normalize as n, reports
from loglattice.operators.pipeline import process_batch, resolve_rules, with_fingerprint, with_source
from loglattice.plans import fixtures as fx
from loglattice.plans.q_text import L, structure_sql
from loglattice.plans.registry import query
from loglattice.session import cut_lineage, written

PIPE_KINDS = ["kv", "json", "cef", "leef", "leef2", "csv", "xml", "noise"]

# --- expected outcomes, stated once in SQL -----------------------------------------------------------


def _rx(pattern, group=1):
    return f"regexp_extract(line, '{pattern}', {group})"


_VOCAB = "CASE WHEN lower({0}) IN ('permit','pass','accept') THEN 'allow' WHEN lower({0}) IN ('drop','block','reject') THEN 'deny' ELSE {0} END"
_IPAD = bytes(b ^ 0x36 for b in fx.MASK_KEY.ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in fx.MASK_KEY.ljust(64, b"\0")).hex()


def hmac_sql(expr):
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({expr}))))"


def _kind_sql(kind, rule, version, outcome, time="''", user="NULL", ip="NULL", host="NULL", nsrc="NULL", ndst="NULL", port="NULL", proto="NULL", action="NULL", category="NULL", raw_action="NULL", source=None):
    ok = "outcome = 'normalized'"
    cols = {"event_time": f"CASE WHEN {ok} THEN {time} ELSE '' END"}
    for name, expr in dict(s_user=user, s_ip=ip, s_host=host, n_src=nsrc, n_dst=ndst, n_port=port, n_proto=proto, action=action, category=category, raw_action=raw_action).items():
        cols[name] = f"CASE WHEN {ok} THEN {expr} END"
    body = ", ".join(f"{expr} AS {name}" for name, expr in cols.items())
    rule_sql = f"CASE WHEN outcome = 'unresolved' THEN NULL ELSE '{rule}' END" if rule else "CAST(NULL AS varchar)"
    version_sql = f"CASE WHEN outcome = 'unresolved' THEN NULL ELSE {version} END" if rule else "CAST(NULL AS integer)"
    return (f"SELECT kind, trace_id, source_id, seq, received_at, job_id, line, outcome, {rule_sql} AS rule_id, {version_sql} AS rule_version, {body} "
            f"FROM (SELECT *, {outcome} AS outcome FROM {source or L(kind)})")


_CEF_GOOD = "starts_with(line, 'CEF:') AND NOT line LIKE '%src=10.0.0.999 %'"
_CEF_SRC = f"(SELECT *, min(CASE WHEN {_CEF_GOOD} THEN seq END) OVER (PARTITION BY fp) AS first_seq FROM (SELECT *, sha256({structure_sql()}) AS fp FROM {L('cef')}))"
_V = {
    "kv": _kind_sql("kv", "fw-kv", 1, "CASE WHEN line LIKE '%.999.%' THEN 'dead_letter' ELSE 'normalized' END", f"concat({_rx('date=([^ ]+)')}, 'T00:00:00Z')", host=_rx('devname="([^"]*)"'),
                    nsrc=hmac_sql(_rx("srcip=([^ ]+)")), ndst=_rx("dstip=([^ ]+)"), port=_rx("dstport=([^ ]+)"), action=_VOCAB.format(_rx('action="([^"]*)"')), raw_action=_rx('action="([^"]*)"')),
    "json": _kind_sql("json", "cloud-json", 2, "CASE WHEN json_valid(line) THEN 'normalized' ELSE 'unresolved' END", "json_extract_string(line, '$.eventTime')", user="'***'",
                      ip="json_extract_string(line, '$.sourceIPAddress')", action="json_extract_string(line, '$.eventName')", raw_action="json_extract_string(line, '$.eventName')"),
    "cef": _kind_sql("cef", "gate-cef", 1, f"CASE WHEN first_seq IS NULL OR seq < first_seq THEN 'unresolved' WHEN {_CEF_GOOD} THEN 'normalized' ELSE 'dead_letter' END", f"concat({_rx(' rt=([^ ]+)')}, 'T00:00:00Z')",
                     user=_rx("suser=([^ ]+)"), ip=_rx("src=([^ ]+)"), action=_VOCAB.format(_rx(" act=([^ ]+)")), raw_action=_rx(" act=([^ ]+)"), source=_CEF_SRC),
    "leef": _kind_sql("leef", "mail-leef", 1, "'normalized'", ip=_rx("src=([0-9.]+)"), category="split_part(line, '|', 5)"),
    "leef2": _kind_sql("leef2", "mail-leef", 1, "'normalized'", ip=_rx("src=([0-9.]+)"), category="split_part(line, '|', 5)"),
    "csv": _kind_sql("csv", "pan-rx", 1, "'normalized'", "concat(replace(replace(split_part(line, ',', 1), '/', '-'), ' ', 'T'), 'Z')", host="split_part(line, ',', 8)", nsrc="split_part(line, ',', 9)",
                     ndst="split_part(line, ',', 10)", proto="split_part(line, ',', 11)", action=_VOCAB.format("split_part(line, ',', 12)"), raw_action="split_part(line, ',', 12)"),
    "xml": _kind_sql("xml", "win-xml", 1, "CASE WHEN ends_with(line, '\"></Event>') THEN 'unresolved' ELSE 'normalized' END", host=_rx("<Computer>([^<]+)<"), category=_rx('nation="([0-9]+)"')),
    "noise": _kind_sql("noise", None, 0, "'unresolved'"),
    "asa": _kind_sql("asa", "asa-rx", 1, "'normalized'", "strftime(strptime(substring(line, 6, 20), '%b %d %Y %H:%M:%S'), '%Y-%m-%dT%H:%M:%SZ')", host=_rx("[0-9] (asa-[^ ]+) :"), nsrc=_rx("inside/([0-9.]+)"),
                     ndst=_rx("outside/([0-9.]+)"), port=_rx("outside/[0-9.]+\\((\\d+)"), proto="'tcp'", action=_rx("(permitted|denied)"), raw_action=_rx("(permitted|denied)")),
}


def V(*kinds):  # noqa: N802
    return "(" + " UNION ALL ".join(_V[k] for k in (kinds or PIPE_KINDS)) + ")"


def processed(spark, sf, *kinds, **options):
    return process_batch(fx.raw_events(spark, sf, *(kinds or PIPE_KINDS)), fx.rule_set(), fx.bindings(spark), fx.sources(spark), **options).processed


_RENAMES = [("event_time", "event_time"), ("source.user", "s_user"), ("source.ip", "s_ip"), ("source.hostname", "s_host"), ("network.src_ip", "n_src"), ("network.dst_ip", "n_dst"),
            ("network.dst_port", "n_port"), ("network.protocol", "n_proto"), ("security.action", "action"), ("security.category", "category")]
_FLAT = ", ".join(name for _, name in _RENAMES)


def flat(df, *keep):
    return df.select(*keep, *[F.col(path).alias(name) for path, name in _RENAMES])


@query("events_per_action", f"SELECT action, substring(event_time, 1, 10) AS day, count(*) AS events FROM {V('kv')} WHERE outcome = 'normalized' GROUP BY 1, 2")
def _(spark, sf):
    done = n.normalized_events(processed(spark, sf, "kv"))
    return done.groupBy(F.col("security.action").alias("action"), F.substring("event_time", 1, 10).alias("day")).agg(F.count("*").alias("events"))


@query("full_pipeline", f"SELECT kind, outcome, rule_id, rule_version, count(*) AS events FROM {V(*_V)} GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return processed(spark, sf, *_V).groupBy("kind", "outcome", "rule_id", "rule_version").agg(F.count("*").alias("events"))


@query("route_canonical", f"SELECT trace_id, outcome, {_FLAT} FROM {V(*_V)}")
def _(spark, sf):
    return flat(processed(spark, sf, *_V), "trace_id", "outcome")


# --- matching ---------------------------------------------------------------------------------------------

@query("match_by_fingerprint", f"SELECT kind, CASE WHEN kind IN ('cef', 'asa', 'noise') OR (kind IN ('json', 'xml') AND outcome <> 'normalized') THEN NULL ELSE concat(rule_id, '@', cast(rule_version as varchar)) END AS rule, count(*) AS n FROM {V(*_V)} GROUP BY 1, 2")
def _(spark, sf):
    events = with_fingerprint(with_source(fx.raw_events(spark, sf, *_V), fx.sources(spark)))
    return matching.match_by_fingerprint(events, fx.bindings(spark), fx.rule_set(), "tenant_id").groupBy("kind", F.col("rule_version_id").alias("rule")).agg(F.count("*").alias("n"))


@query("discover_rule", f"SELECT trace_id, CASE WHEN {_CEF_GOOD} THEN 'gate-cef@1' END AS rule FROM {L('cef')} UNION ALL SELECT trace_id, 'pan-rx@1' FROM {L('csv')} UNION ALL SELECT trace_id, CASE WHEN json_valid(line) THEN 'cloud-json@2' END FROM {L('json')}")
def _(spark, sf):
    found = matching.discover_rule(fx.lines(spark, sf, "cef", "csv", "json"), fx.rule_set(), "line", None, "rule")
    return found.select("trace_id", "rule")


@query("discovery_timeline", f"SELECT trace_id, CASE WHEN outcome = 'unresolved' THEN NULL ELSE 'gate-cef@1' END AS rule FROM {V('cef')}")
def _(spark, sf):
    events = with_fingerprint(fx.raw_events(spark, sf, "cef")).withColumn("rule", F.lit(None).cast("string"))
    return matching.discovery_timeline(events, fx.rule_set(), "line", "seq", out="rule").select("trace_id", "rule")


@query("bind_fingerprint", f"SELECT 'gate-cef' AS rule_id, fingerprint FROM (SELECT concat(substring(sha256(source_id), 1, 8), '::', sha256({structure_sql()})) AS fingerprint, line FROM {L('cef')}) WHERE {_CEF_GOOD} GROUP BY 2 UNION ALL SELECT 'asa-rx', concat(substring(sha256(source_id), 1, 8), '::', sha256({structure_sql()})) FROM {L('asa')} GROUP BY 2")
def _(spark, sf):
    _, fresh = resolve_rules(fx.raw_events(spark, sf, "cef", "asa", "kv"), fx.rule_set(), fx.bindings(spark), fx.sources(spark))
    return fresh


@query("skip_processed", f"SELECT source_id, count(*) AS n FROM {L('kv', 'csv')} WHERE line LIKE '%deny%' OR line LIKE '%allow%' GROUP BY 1")
def _(spark, sf):
    events = fx.lines(spark, sf, "kv", "csv")
    done = events.filter(~F.contains("line", F.lit("deny")) & ~F.contains("line", F.lit("allow")))
    return matching.skip_processed(events, done).groupBy("source_id").agg(F.count("*").alias("n"))


@query("processed_ids", f"SELECT trace_id FROM {L('kv')} UNION SELECT trace_id FROM {L('csv')}")
def _(spark, sf):
    kv, csv = fx.lines(spark, sf, "kv"), fx.lines(spark, sf, "csv")
    return matching.processed_ids(kv, csv, kv.filter(F.contains("line", F.lit("deny"))))


# --- normalisation ------------------------------------------------------------------------------------------

@query("vendor_namespace", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name WHEN n_regionkey = 0 THEN 'vendor' ELSE n_name END AS namespace FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    s = fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ns = F.when(F.col("s_acctbal") < 0, F.col("s_name")).otherwise("")
    return s.select("s_suppkey", n.vendor_namespace(ns, F.when(F.col("n_regionkey") != 0, F.col("n_name"))).alias("namespace"))


@query("route_unmapped", f"SELECT trace_id, 'acme' AS ns, {_rx('sentbyte=([0-9]+)')} AS value FROM {V('kv')} WHERE outcome = 'normalized' UNION ALL SELECT trace_id, 'gate', {_rx(' msg=(.*)$')} FROM {V('cef')} WHERE outcome = 'normalized' UNION ALL SELECT trace_id, 'Soft', {_rx('<EventID>([0-9]+)<')} FROM {V('xml')} WHERE outcome = 'normalized'")
def _(spark, sf):
    done = processed(spark, sf, "kv", "cef", "xml").filter("outcome = 'normalized'")
    return done.select("trace_id", F.explode("unmapped_fields").alias("ns", "m")).select("trace_id", "ns", F.explode("m").alias("k", "value")).drop("k")


_TIMES = """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN concat({D}, 'T10:57:15+05:30') WHEN '2-HIGH' THEN {P} WHEN '3-MEDIUM' THEN {B} WHEN '4-NOT SPECIFIED' THEN {D} ELSE concat('at ', {D}) END AS v, {D} AS day, o_orderpriority AS p FROM orders"""
_TIMES_SQL = _TIMES.format(D="strftime(o_orderdate, '%Y-%m-%d')", P="strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')", B="strftime(o_orderdate, '%b %d %Y %H:%M:%S')")


@query("normalize_timestamp", f"SELECT id, CASE WHEN p = '1-URGENT' THEN concat(day, 'T10:57:15Z') WHEN p = '5-LOW' THEN v ELSE concat(day, 'T00:00:00Z') END AS t, CASE WHEN p = '1-URGENT' THEN concat(day, 'T05:27:15Z') WHEN p = '5-LOW' THEN v ELSE concat(day, 'T00:00:00Z') END AS utc FROM ({_TIMES_SQL})")
def _(spark, sf):
    fx.table(spark, sf, "orders").createOrReplaceTempView("_t_orders")
    sql = _TIMES.format(D="date_format(o_orderdate, 'yyyy-MM-dd')", P="date_format(o_orderdate, 'yyyy/MM/dd HH:mm:ss')", B="date_format(o_orderdate, 'MMM dd yyyy HH:mm:ss')")
    df = spark.sql(sql.replace("FROM orders", "FROM _t_orders"))
    return df.select("id", normalize_timestamp(F.col("v")).alias("t"), normalize_timestamp(F.col("v"), "utc").alias("utc"))


@query("set_reserved", f"SELECT trace_id, {_rx('suser=([^ ]+)')} AS doc_event_id, {_rx(' rt=([^ ]+)')} AS ingest_time FROM {L('cef')} WHERE starts_with(line, 'CEF:')")
def _(spark, sf):
    from loglattice.operators.engine import RuleSet
    from loglattice.operators.rules import Rule

    rule = Rule("rs@1", "rs", 1, "cef", {}, {"suser": "event_id", "rt": "ingest_time"})
    events = fx.raw_events(spark, sf, "cef").withColumns({"rule_version_id": F.lit("rs@1"), "namespace": F.lit("x")})
    rules = RuleSet([rule])
    out = n.normalize(rules.parse_and_check(events, "line", "rule_version_id"), rules)
    return out.filter("outcome = 'normalized'").select("trace_id", "doc_event_id", "ingest_time")


@query("normalize_action", f"SELECT trace_id, {_VOCAB.format('upper(a)')} AS up, {_VOCAB.format('a')} AS low FROM (SELECT trace_id, {_rx('action="([^"]*)"')} AS a FROM {L('kv')} UNION ALL SELECT trace_id, split_part(line, ',', 12) FROM {L('csv')})")
def _(spark, sf):
    kv = fx.lines(spark, sf, "kv").select("trace_id", F.regexp_extract("line", 'action="([^"]*)"', 1).alias("a"))
    csv = fx.lines(spark, sf, "csv").select("trace_id", F.get(F.split("line", ","), F.lit(11)).alias("a"))
    return kv.unionByName(csv).select("trace_id", normalize_action(F.upper("a")).alias("up"), normalize_action(F.col("a")).alias("low"))


@query("mask_hmac", f"SELECT c_custkey, {hmac_sql('c_name')} AS masked FROM customer")
def _(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", mask_hmac(F.col("c_name"), fx.MASK_KEY).alias("masked"))


@query("mask_redact", "SELECT c_custkey, '***' AS masked FROM customer")
def _(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", mask_value(F.col("c_name"), "mask", fx.MASK_KEY).alias("masked"))


@query("mask_drop", f"SELECT trace_id, CAST(NULL AS varchar) AS s_user, '***' AS shown FROM {L('leef', 'leef2')}")
def _(spark, sf):
    p = processed(spark, sf, "leef", "leef2")
    rows = n.provenance(p).filter("transformation = 'mask_drop'").select("trace_id", F.col("source_value").alias("shown"))
    return p.select("trace_id", F.col("source.user").alias("s_user")).join(rows, "trace_id")


def _q(expr):
    return f"concat('\"', {expr}, '\"')"


_RAWREF = "concat('{\"trace_id\":\"', trace_id, '\",\"digest\":\"sha256:', sha256(line), '\",\"byte_length\":', cast(octet_length(encode(line)) as varchar), '}')"
_ECS = f"concat('{{\"ecs\":{{\"version\":\"8.11.0\"}},\"event\":{{\"id\":\"', trace_id, '\",\"created\":\"', event_time, '\",\"action\":\"', action, '\"}},\"source\":{{\"ip\":\"', s_ip, '\"}},\"user\":{{\"name\":\"***\"}},\"_unmapped\":{{}},\"_raw_reference\":', {_RAWREF}, ',\"normalization\":{{\"schema\":\"ecs-8.11.0\"}}}}')"
_OCSF = f"concat('{{\"metadata\":{{\"version\":\"1.1.0\",\"uid\":\"', trace_id, '\"}},\"time\":\"', event_time, '\",\"observables\":[],\"src_endpoint\":{{\"ip\":\"', s_ip, '\"}},\"action\":\"', action, '\",\"user\":{{\"name\":\"', s_user, '\"}},\"unmapped\":{{\"gate\":{{\"message\":\"', {_rx(' msg=(.*)$')}, '\"}}}},\"raw_data\":', {_RAWREF}, ',\"normalization\":{{\"schema\":\"ocsf-1.1.0\"}}}}')"
_CORE = f"concat('{{\"event_id\":\"', trace_id, '\",\"event_time\":\"', event_time, '\",\"ingest_time\":\"\",\"source\":{{\"user\":null,\"ip\":null,\"hostname\":\"', s_host, '\",\"mac_address\":null,\"device_type\":null}},\"network\":{{\"src_ip\":\"', n_src, '\",\"dst_ip\":\"', n_dst, '\",\"src_port\":null,\"dst_port\":\"', n_port, '\",\"protocol\":null,\"bytes_in\":null,\"bytes_out\":null}},\"security\":{{\"action\":\"', action, '\",\"severity\":null,\"threat_name\":null,\"category\":null}},\"normalization\":{{\"schema\":\"core-1.0\"}},\"raw_reference\":', {_RAWREF}, ',\"processing\":{{}},\"unmapped_fields\":{{\"acme\":{{\"sentbyte\":\"', {_rx('sentbyte=([0-9]+)')}, '\"}}}}}}')"


def _payload_query(*kinds):
    def build(spark, sf):
        return n.normalized_events(processed(spark, sf, *kinds)).select("trace_id", "payload_json")
    return build


query("core_event", f"SELECT trace_id, {_CORE} AS payload_json FROM {V('kv')} WHERE outcome = 'normalized'")(_payload_query("kv"))
query("to_ocsf", f"SELECT trace_id, {_OCSF} AS payload_json FROM {V('cef')} WHERE outcome = 'normalized'")(_payload_query("cef"))
query("to_ecs", f"SELECT trace_id, {_ECS} AS payload_json FROM {V('json')} WHERE outcome = 'normalized'")(_payload_query("json"))
query("select_target_schema", " UNION ALL ".join(f"SELECT trace_id, {doc} AS payload_json FROM {V(k)} WHERE outcome = 'normalized'" for k, doc in [("kv", _CORE), ("cef", _OCSF), ("json", _ECS)]))(_payload_query("kv", "cef", "json"))


@query("search_doc_sink", f"SELECT trace_id, concat(left(doc, length(doc) - 1), ',\"trace_id\":\"', trace_id, '\",\"source_id\":\"cloud\",\"processing_path\":\"fast_path\",\"@timestamp\":\"', strftime(received_at + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S'), CASE WHEN strftime(received_at, '%f') = '000000' THEN '' ELSE concat('.', strftime(received_at, '%f')) END, '+05:30\"}}') AS document FROM (SELECT *, {_ECS} AS doc FROM {V('json')} WHERE outcome = 'normalized')")
def _(spark, sf):
    return n.search_documents(cut_lineage(processed(spark, sf, "json")))


def _prov(kind, target, value, how, decision="deterministic", field=None):
    return f"SELECT trace_id, '{field or target}' AS target_field, '{target}' AS source_field, {value} AS source_value, '{how}' AS transformation, '{decision}' AS decision FROM {V(kind)} WHERE outcome = 'normalized'"


@query("provenance", " UNION ALL ".join([
    _prov("kv", "network.src_ip", "n_src", "mask_hmac_hash"), _prov("kv", "network.dst_ip", "n_dst", "direct"), _prov("kv", "network.dst_port", "n_port", "direct"), _prov("kv", "security.action", "raw_action", "action_vocab"),
    _prov("kv", "source.hostname", "s_host", "direct"), _prov("kv", "sentbyte", _rx("sentbyte=([0-9]+)"), "preserve", "unmapped", "unmapped_fields.acme.sentbyte"), _prov("kv", "event_time", _rx("date=([^ ]+)"), "tz_normalize"),
    _prov("leef", "source.ip", "s_ip", "direct"), _prov("leef", "source.user", "'***'", "mask_drop"), _prov("leef", "security.category", "category", "direct")]))
def _(spark, sf):
    return n.provenance(processed(spark, sf, "kv", "leef")).select("trace_id", "target_field", "source_field", "source_value", "transformation", "decision")


@query("provenance_upsert", f"SELECT trace_id, target_field, CASE WHEN n > 1 THEN 'new' ELSE transformation END AS transformation FROM (SELECT trace_id, 'source.ip' AS target_field, 'direct' AS transformation, CASE WHEN category = 'BUILDING' THEN 2 ELSE 1 END AS n FROM {V('leef')} UNION ALL SELECT trace_id, 'source.user', 'mask_drop', CASE WHEN category = 'BUILDING' THEN 2 ELSE 1 END FROM {V('leef')} UNION ALL SELECT trace_id, 'security.category', 'direct', CASE WHEN category = 'BUILDING' THEN 2 ELSE 1 END FROM {V('leef')})")
def _(spark, sf):
    p = cut_lineage(processed(spark, sf, "leef"))
    old = n.provenance(p)
    rerun = n.provenance(p.filter(F.col("security.category") == "BUILDING")).withColumns(
        {"transformation": F.lit("new"), "created_at": F.col("created_at") + F.expr("INTERVAL '1' DAY")})
    return n.provenance_upsert(old, rerun).select("trace_id", "target_field", "transformation")


@query("stamp_trace", f"SELECT trace_id, CASE WHEN outcome = 'normalized' THEN rule_id END AS rule_id, CASE WHEN outcome = 'normalized' THEN rule_version END AS rule_version, CASE WHEN outcome = 'normalized' THEN concat('h-', split_part(rule_id, '-', 1), '-', cast(rule_version as varchar)) END AS rule_hash FROM {V('kv', 'json', 'xml')}")
def _(spark, sf):
    return n.traces(processed(spark, sf, "kv", "json", "xml")).select("trace_id", "rule_id", "rule_version", "rule_hash")


@query("dead_letter", f"SELECT trace_id, source_id, 'parser_failed' AS stage, 'ParserError' AS error_class, CASE kind WHEN 'kv' THEN concat('Validation failed: Field ''network.src_ip'' with value ''', {_rx('srcip=([^ ]+)')}, ''' does not match type constraint ''ip''') ELSE 'Validation failed: Field ''source.ip'' with value ''10.0.0.999'' does not match type constraint ''ip''' END AS diagnostic, concat('vault://', source_id, '/', strftime(received_at, '%Y-%m-%d'), '/', trace_id, '.raw') AS raw_reference FROM {V('kv', 'cef')} WHERE outcome = 'dead_letter'")
def _(spark, sf):
    return n.dead_letters(processed(spark, sf, "kv", "cef")).select("trace_id", "source_id", "stage", "error_class", "diagnostic", "raw_reference")


@query("unresolved", f"SELECT trace_id, source_id, job_id FROM {V()} WHERE outcome = 'unresolved'")
def _(spark, sf):
    return n.unresolved(processed(spark, sf)).select("trace_id", "source_id", "job_id")


@query("processing_path", f"SELECT CASE outcome WHEN 'normalized' THEN 'fast_path' WHEN 'unresolved' THEN 'unresolved' END AS processing_path, count(*) AS n FROM {V()} GROUP BY 1")
def _(spark, sf):
    return processed(spark, sf).groupBy("processing_path").agg(F.count("*").alias("n"))


# --- reports ------------------------------------------------------------------------------------------------------

REPORT_KINDS = ["kv", "json", "cef", "csv", "noise"]


# What the lists show and filter by; fields and documents, which no list shows, are not worked out.
LISTED = ["trace_id", "source_id", "rule_id", "rule_version", "processing_path", "received_at", "outcome"]


def _report_frames(spark, sf, *more):
    """Processed events as a table: nothing is processed twice. It has the columns of the lists and ``more``; ids and addresses follow from them."""
    p = written(processed(spark, sf, *REPORT_KINDS).select(*LISTED, *more), "processed", "zstd")
    p = p.withColumns({"event_id": event_id_for(F.col("trace_id"), n.FAST_PATH), "storage_uri": storage_uri(F.col("source_id"), F.col("received_at"), F.col("trace_id"))})
    return p, fx.sources(spark), _rules(spark)


def _rules(spark):
    from loglattice.operators.rules import rules_frame

    return rules_frame(spark, fx.RULES)


_VR = V(*REPORT_KINDS)
_SRC = "(VALUES ('fw','default'),('cloud','default'),('gate','default'),('mail','default'),('asa','default'),('pan','default'),('win','default'),('misc','other'))"
_LABEL = "concat(rule_id, '@', cast(rule_version as varchar))"
_TS = "strftime(received_at, '%Y-%m-%d %H:%M:%S')"


def _ts(name="created_at"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("event_filters", f"SELECT trace_id, rule_id FROM {_VR} WHERE outcome = 'normalized' AND source_id = 'fw' AND rule_id = 'fw-kv'")
def _(spark, sf):
    done = n.normalized_events(processed(spark, sf, *REPORT_KINDS))
    return reports.event_filters(done, "fw", "fw-kv", "fast_path").select("trace_id", "rule_id")


@query("tenant_scope", f"SELECT kind, count(*) AS n FROM {L()} WHERE source_id <> 'misc' GROUP BY 1")
def _(spark, sf):
    return reports.tenant_scope(fx.lines(spark, sf), fx.sources(spark), "default").groupBy("kind").agg(F.count("*").alias("n"))


@query("source_search", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (lower(s_name) LIKE '%7%' OR lower(n_name) LIKE '%7%') AND s_acctbal > 0")
def _(spark, sf):
    s = fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    dims = s.select("s_suppkey", F.col("s_name").alias("name"), F.lit("SRC").alias("source_id"), F.upper("n_name").alias("vendor"), F.lit(None).cast("string").alias("product"),
                    F.when(F.col("s_acctbal") > 0, "Syslog").otherwise("api").alias("transport"))
    return reports.source_search(dims, "7", "syslog").select("s_suppkey")


@query("events_with_context", f"SELECT trace_id, source_id, {_LABEL} AS rule_name, concat('vault://', source_id, '/', strftime(received_at, '%Y-%m-%d'), '/', trace_id, '.raw') AS storage_uri FROM {_VR} WHERE outcome = 'normalized'")
def _(spark, sf):
    p, src, rules = _report_frames(spark, sf)
    return reports.events_with_context(n.normalized_events(p), None, src, rules, "default").select("trace_id", "source_id", "rule_name", "storage_uri")


@query("unresolved_with_context", f"SELECT trace_id, source_id FROM {_VR} WHERE outcome = 'unresolved' AND source_id <> 'misc'")
def _(spark, sf):
    p, src, _r = _report_frames(spark, sf)
    return reports.unresolved_with_context(n.unresolved(p), None, src, "default").select("trace_id", "source_id")


def _outcome_list(spark, sf, tenant=None, **filters):
    p, src, rules = _report_frames(spark, sf)
    done = reports.events_with_context(n.normalized_events(p), None, src, rules, tenant)
    waiting = reports.unresolved_with_context(n.unresolved(p), None, src, tenant)
    return reports.union_outcomes(done, waiting, **filters)


@query("union_outcomes", f"SELECT trace_id, source_id, CASE WHEN outcome = 'normalized' THEN {_LABEL} END AS rule_name, CASE WHEN outcome = 'normalized' THEN 'fast_path' ELSE 'unresolved' END AS processing_path FROM {_VR} WHERE outcome <> 'dead_letter'")
def _(spark, sf):
    return _outcome_list(spark, sf).select("trace_id", "source_id", "rule_name", "processing_path")


@query("page_total", f"SELECT count(*) AS total FROM {_VR} WHERE outcome <> 'dead_letter' AND source_id = 'gate'")
def _(spark, sf):
    return reports.page_total(_outcome_list(spark, sf, source_id="gate"))


@query("events_page", f"SELECT created_at, count(*) AS n FROM (SELECT {_TS} AS created_at FROM {_VR} WHERE outcome <> 'dead_letter' ORDER BY received_at DESC LIMIT 20 OFFSET 20) GROUP BY 1")
def _(spark, sf):
    raw = fx.raw_events(spark, sf, *REPORT_KINDS)
    return reports.events_page(_outcome_list(spark, sf), raw, 2, 20).groupBy(_ts()).agg(F.count("*").alias("n"))


@query("source_events_page", f"SELECT created_at, count(*) AS n FROM (SELECT {_TS} AS created_at FROM {_VR} WHERE outcome = 'normalized' AND source_id = 'fw' ORDER BY received_at DESC LIMIT 50) GROUP BY 1")
def _(spark, sf):
    done = n.normalized_events(processed(spark, sf, "kv"))
    return reports.source_events_page(done, "fw").groupBy(_ts()).agg(F.count("*").alias("n"))


@query("event_by_id", f"SELECT trace_id, rule_id FROM {V('kv')} WHERE outcome = 'normalized' AND trace_id = (SELECT max(trace_id) FROM {V('kv')} WHERE outcome = 'normalized')")
def _(spark, sf):
    done = cut_lineage(n.normalized_events(processed(spark, sf, "kv")))
    wanted = done.agg(F.max_by("event_id", "trace_id")).first()[0]
    return reports.event_by_id(done, fx.sources(spark), "default", wanted).select("trace_id", "rule_id")


@query("event_trace", f"SELECT trace_id, concat('sha256:', sha256(line)) AS sha, rule_id AS rule, rule_version AS version, '1.0' AS schema_version, 'fast_path' AS mode FROM {_VR} WHERE outcome = 'normalized'")
def _(spark, sf):
    p, _s, _r = _report_frames(spark, sf, "rule_hash", "rule_schema_version", "digest")
    done = n.normalized_events(p)
    # By trace id, as all joins of the trace, so nothing is dealt a second time; an event id stands for one trace id.
    t = reports.event_trace(done, n.traces(p), p).join(done.select("trace_id"), "trace_id")
    return t.select("trace_id", F.col("raw.sha256").alias("sha"), F.col("rule.id").alias("rule"), F.col("rule.version").alias("version"), "schema_version", F.col("processing_mode").alias("mode"))


@query("event_raw", f"SELECT trace_id, 'batch_api' AS transport, line AS raw_payload, true AS digest_verified FROM {V('csv', 'json')} WHERE outcome = 'normalized'")
def _(spark, sf):
    p = written(processed(spark, sf, "csv", "json").drop("_values", "_fields", "_entries", "_loose", "_json", "_at"), "processed")
    return reports.event_raw(n.normalized_events(p), p).select("trace_id", "transport", "raw_payload", "digest_verified")


@query("provenance_of", f"SELECT trace_id, 'source.ip' AS target_field FROM {V('leef')} WHERE category = 'BUILDING' UNION ALL SELECT trace_id, 'source.user' FROM {V('leef')} WHERE category = 'BUILDING' UNION ALL SELECT trace_id, 'security.category' FROM {V('leef')} WHERE category = 'BUILDING'")
def _(spark, sf):
    p = cut_lineage(processed(spark, sf, "leef"))
    return reports.provenance_of(n.provenance(p), p.filter(F.col("security.category") == "BUILDING")).select("trace_id", "target_field")


@query("stats_overview", f"SELECT count(*) AS events_ingested, count(*) FILTER (WHERE outcome = 'normalized') AS events_normalized, count(*) FILTER (WHERE outcome = 'normalized') AS fast_events, 0 AS adaptive_events, count(*) FILTER (WHERE outcome = 'unresolved') AS review_pending, count(*) FILTER (WHERE outcome = 'dead_letter') AS dead_letters FROM {_VR}")
def _(spark, sf):
    return reports.stats_overview(processed(spark, sf, *REPORT_KINDS))


@query("integrity_failures", f"SELECT count(*) AS events, count(*) FILTER (WHERE line LIKE '%deny%') AS integrity_failures FROM {L('kv', 'csv')}")
def _(spark, sf):
    raw = fx.raw_events(spark, sf, "kv", "csv")
    return reports.integrity_report(raw.withColumn("digest", F.when(F.contains("line", F.lit("deny")), "sha256:0").otherwise(F.col("digest"))))


_PROGRESS = "count(*) AS total_events, count(*) AS processed_events, count(*) FILTER (WHERE outcome <> 'unresolved') AS normalized_count, count(*) FILTER (WHERE outcome = 'unresolved') AS unresolved_count, count(*) FILTER (WHERE outcome = 'normalized') AS normalized_ok, count(*) FILTER (WHERE outcome = 'dead_letter') AS dead_letter_count"


@query("job_progress", f"SELECT job_id, {_PROGRESS}, CASE WHEN starts_with(job_id, 'gate') THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN starts_with(job_id, 'gate') THEN 100 ELSE 0 END AS failed FROM {_VR} GROUP BY job_id")
def _(spark, sf):
    from loglattice.sources.lines import job_event_total

    p = processed(spark, sf, *REPORT_KINDS)
    totals = job_event_total(fx.lines(spark, sf, *REPORT_KINDS), "job_id")
    status = totals.select("job_id", F.when(F.startswith("job_id", F.lit("gate")), "FAILED").otherwise("COMPLETED").alias("status"))
    return reports.container_progress(p, totals, "job_id", status)


@query("session_progress", f"SELECT source_id AS session_id, {_PROGRESS} FROM {_VR} GROUP BY source_id")
def _(spark, sf):
    from loglattice.sources.lines import session_event_total

    lines = fx.lines(spark, sf, *REPORT_KINDS)
    p = processed(spark, sf, *REPORT_KINDS).withColumn("session_id", F.col("source_id"))
    return reports.container_progress(p, session_event_total(lines.withColumn("session_id", F.col("source_id")), "session_id"), "session_id")


@query("source_event_count", f"SELECT source_id, count(*) AS total FROM {_VR} WHERE outcome = 'normalized' GROUP BY 1")
def _(spark, sf):
    return reports.source_event_count(n.normalized_events(processed(spark, sf, *REPORT_KINDS)))


