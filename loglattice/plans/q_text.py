"""Queries: ingest projections, fingerprints, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import ids, redact, text, timefmt
from loglattice.functions.jsonshape import json_invalid, json_scalar_class, json_structure
from loglattice.operators.ingest import build_raw_index, source_last_seen
from loglattice.plans import fixtures as fx
from loglattice.plans.registry import query
from loglattice.sources.lines import job_event_total



def L(*kinds):  # noqa: N802 - short name for SQL text below
    return f"({fx.lines_sql(*kinds)})"


# --- ingest projections -----------------------------------------------------------------

def _digits(number, width):
    """Base-32 digits of a number, highest first."""
    return ", ".join(f"substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((({number}) >> {5 * (width - 1 - i)}) & 31)::INT + 1, 1)" for i in range(width))


TRACE_ID_SQL = (
    f"SELECT seq, concat({_digits('ms', 10)}, {_digits('hi', 8)}, {_digits('lo', 8)}) AS trace_id FROM (SELECT seq, ms, CAST(concat('0x', substr(h, 1, 10)) AS BIGINT) AS hi, "
    "CAST(concat('0x', substr(h, 11, 10)) AS BIGINT) AS lo FROM (SELECT seq, epoch_us(received_at) // 1000 AS ms, sha256(concat_ws('␟', source_id, cast(seq as varchar), line)) AS h FROM {lines}))"
)


@query("assign_trace_id", TRACE_ID_SQL.format(lines=L("kv")))
def _(spark, sf):
    e = fx.lines(spark, sf, "kv").drop("trace_id")
    return e.select("seq", ids.assign_trace_id(F.col("received_at"), F.col("source_id"), F.col("seq"), F.col("line")).alias("trace_id"))


@query("digest", "SELECT doc_id, concat('sha256:', sha256(text)) AS digest FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", ids.digest(F.encode("text", "UTF-8")).alias("digest"))


@query("byte_length", "SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", ids.byte_length(F.encode("text", "UTF-8")).alias("n_bytes"))


@query("storage_uri", f"SELECT trace_id, concat('vault://', source_id, '/', strftime(received_at, '%Y-%m-%d'), '/', trace_id, '.raw') AS uri FROM {L('kv', 'csv')}")
def _(spark, sf):
    return fx.lines(spark, sf, "kv", "csv").select("trace_id", ids.storage_uri(F.col("source_id"), F.col("received_at"), F.col("trace_id")).alias("uri"))


@query("parse_vault_uri", f"SELECT trace_id, source_id, strftime(received_at, '%Y-%m-%d') AS received_date FROM {L('kv', 'csv')}")
def _(spark, sf):
    uri = fx.lines(spark, sf, "kv", "csv").select(ids.storage_uri(F.col("source_id"), F.col("received_at"), F.col("trace_id")).alias("uri"))
    return uri.select(ids.parse_vault_uri(F.col("uri")).alias("p")).select("p.source_id", "p.received_date", "p.trace_id")


@query("decode_payload", "SELECT doc_id, concat(text, chr(65533), '!') AS decoded FROM documents")
def _(spark, sf):
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF21")))
    return fx.table(spark, sf, "documents").select("doc_id", text.decode_payload(broken).alias("decoded"))


@query("build_raw_index", f"""SELECT trace_id, source_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at, 'batch_api' AS transport, job_id,
  octet_length(encode(line)) AS byte_length, concat('sha256:', sha256(line)) AS digest,
  concat('vault://', source_id, '/', strftime(received_at, '%Y-%m-%d'), '/', trace_id, '.raw') AS storage_uri FROM {L('kv', 'noise')}""")
def _(spark, sf):
    index = build_raw_index(fx.raw_events(spark, sf, "kv", "noise"))
    return index.select("trace_id", "source_id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"), "transport", "job_id", "byte_length", "digest", "storage_uri")


@query("source_last_seen", f"SELECT source_id, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM {L()} GROUP BY 1")
def _(spark, sf):
    seen = source_last_seen(fx.sources(spark), fx.lines(spark, sf))
    return seen.filter("last_seen_at IS NOT NULL").select("source_id", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at"))


@query("job_event_total", "SELECT source, count(*) AS total_events FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1")
def _(spark, sf):
    lines = fx.table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return job_event_total(lines, "source")


@query("to_ist_iso", """SELECT event_id, concat(strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S'), CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE concat('.', strftime(ts, '%f')) END, '+05:30') AS ist FROM events""")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", timefmt.to_ist_iso(F.col("ts")).alias("ist"))


@query("to_utc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", timefmt.to_utc_iso(F.col("ts")).alias("utc"))


@query("parse_mixed_time", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_number,
  CASE WHEN event_type = 'error' THEN NULL ELSE strftime(date_trunc('second', ts) - CASE WHEN event_type = 'purchase' THEN INTERVAL 150 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') END AS from_text FROM events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    number = F.when(F.col("user_id") > 50, secs).otherwise(secs * 1000)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    words = F.when(F.col("event_type") == "error", F.concat(F.lit("at "), stamp)).when(
        F.col("event_type") == "purchase", F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("+02:30"))).otherwise(stamp)
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", show(timefmt.parse_epoch(number)).alias("from_number"), show(timefmt.parse_mixed_time(words)).alias("from_text"))


@query("format_ist", """SELECT event_id, concat(strftime(t, '%d %b %Y'), ' ', lower(strftime(t, '%I:%M:%S %p')), ' IST') AS d1, concat(lower(strftime(t, '%I:%M:%S %p')), ' IST') AS d2,
  strftime(t, '%d %b %Y') AS d3, concat(strftime(t, '%d %b'), ', ', lower(strftime(t, '%I:%M:%S %p')), ' IST') AS d4 FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events)""")
def _(spark, sf):
    ts = F.col("ts")
    modes = [("d1", "datetime"), ("d2", "time"), ("d3", "date"), ("d4", "compact")]
    return fx.table(spark, sf, "events").select("event_id", *[timefmt.format_ist(ts, m).alias(n) for n, m in modes])


# --- masks and fingerprints ----------------------------------------------------------------

_PATTERNS = dict(text.TOKEN_CLASSES)


def _sq(s):
    return s.replace("'", "''")


def mask_sql(expr, name):
    pattern = _PATTERNS.get(name, text.WORD_PATTERN)
    return f"regexp_replace({expr}, '{_sq(pattern)}', '<{name}>', 'g')"


def structure_sql(expr="line"):
    out = expr
    for name, _ in text.TOKEN_CLASSES:
        out = mask_sql(out, name)
    return f"trim(regexp_replace({mask_sql(out, 'WORD')}, '\\s+', ' ', 'g'))"


for _name in [*_PATTERNS, "WORD"]:
    def _mask_query(spark, sf, name=_name):
        return fx.lines(spark, sf, *fx.TEXT_KINDS).select("trace_id", text.mask_token(F.col("line"), name).alias("masked"))

    query(f"mask_{_name.lower()}", f"SELECT trace_id, {mask_sql('line', _name)} AS masked FROM {L(*fx.TEXT_KINDS)}")(_mask_query)


@query("collapse_ws", f"SELECT trace_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS collapsed FROM {L('mix', 'leef')}")
def _(spark, sf):
    return fx.lines(spark, sf, "mix", "leef").select("trace_id", text.collapse_ws(F.col("line")).alias("collapsed"))


@query("text_structure", f"SELECT trace_id, {structure_sql()} AS structure FROM {L(*fx.TEXT_KINDS)}")
def _(spark, sf):
    return fx.lines(spark, sf, *fx.TEXT_KINDS).select("trace_id", text.text_structure(F.col("line")).alias("structure"))


@query("text_structure_unicode")
def _(spark, sf):
    return fx.lines(spark, sf, "noise").select("trace_id", F.sha2(text.text_structure(F.col("line")), 256).alias("structure_hash"))


_JSON_SHAPE = "{eventName:<STR>,eventTime:<TIME>,sev:<NUM>,sourceIPAddress:<IP>,userIdentity:{arn:<STR>}}"


@query("json_structure", f"""SELECT trace_id, CASE WHEN json_valid(line) THEN '{_JSON_SHAPE}' ELSE '<INVALID_JSON>' END AS shape FROM {L('json')}
  UNION ALL SELECT concat('props-', cast(event_id as varchar)), '{{k:<NUM>}}' FROM events
  UNION ALL SELECT concat('order-', cast(o_orderkey as varchar)), CASE WHEN o_orderstatus = 'P' THEN '{{a:[],flags:[<BOOL>|<NULL>|<NUM>|{{x:<STR>}}],when:<TIME>}}' ELSE '{{a:[<NUM>],flags:[<BOOL>|<NULL>|<NUM>|{{x:<STR>}}],when:<TIME>}}' END FROM orders""")
def _(spark, sf):
    a = fx.lines(spark, sf, "json").select("trace_id", "line")
    b = fx.table(spark, sf, "events").select(F.concat(F.lit("props-"), F.col("event_id").cast("string")).alias("trace_id"), F.col("props").alias("line"))
    nested = F.concat(F.lit('{"when":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z","a":['), F.when(F.col("o_orderstatus") == "P", "").otherwise("1,2"),
                      F.lit('],"flags":[true,{"x":"'), F.lower("o_orderpriority"), F.lit(' x"},null,'), F.col("o_totalprice").cast("string"), F.lit(",false]}"))
    c = fx.table(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("trace_id"), nested.alias("line"))
    return fx.spread(a.unionByName(b).unionByName(c)).select("trace_id", json_structure(F.col("line")).alias("shape"))


_SCALARS = """SELECT event_id, CASE event_type WHEN 'click' THEN concat('10.0.', cast(user_id % 250 as {s}), '.1') WHEN 'view' THEN cast(event_id as {s}) WHEN 'purchase' THEN md5(event_type) WHEN 'error' THEN concat('u', cast(user_id as {s}), '@corp.example') ELSE concat('https://h.example/', cast(event_id as {s})) END AS v FROM events"""


@query("json_scalar_class", "SELECT event_id, CASE " + " ".join(f"WHEN regexp_full_match(v, '{_sq(p)}') THEN '<{n}>'" for n, p in text.TOKEN_CLASSES) + f" ELSE '<STR>' END AS class FROM ({_SCALARS.format(s='varchar')})")
def _(spark, sf):
    fx.table(spark, sf, "events").createOrReplaceTempView("_events_scalar")
    return spark.sql(_SCALARS.format(s="string").replace("FROM events", "FROM _events_scalar")).select("event_id", json_scalar_class(F.col("v")).alias("class"))


@query("json_invalid", f"SELECT trace_id, NOT json_valid(line) AS invalid FROM {L('json')}")
def _(spark, sf):
    return fx.lines(spark, sf, "json").select("trace_id", json_invalid(F.col("line")).alias("invalid"))


@query("is_json_like", f"SELECT kind, starts_with(trim(line), '{{') AND ends_with(trim(line), '}}') AS json_like, count(*) AS n FROM {L()} GROUP BY 1, 2")
def _(spark, sf):
    return fx.lines(spark, sf).groupBy("kind", text.is_json_like(F.col("line")).alias("json_like")).agg(F.count("*").alias("n"))


@query("fingerprint", f"SELECT trace_id, sha256({structure_sql()}) AS fingerprint FROM {L(*fx.TEXT_KINDS)} UNION ALL SELECT trace_id, sha256(CASE WHEN json_valid(line) THEN '{_JSON_SHAPE}' ELSE '<INVALID_JSON>' END) FROM {L('json')}")
def _(spark, sf):
    return fx.lines(spark, sf, *fx.TEXT_KINDS, "json").select("trace_id", text.fingerprint(F.col("line")).alias("fingerprint"))


@query("vendor_scope", f"SELECT source_id, fingerprint, count(*) AS n FROM (SELECT source_id, concat(substring(sha256(source_id), 1, 8), '::', sha256({structure_sql()})) AS fingerprint FROM {L('kv', 'csv', 'asa')}) GROUP BY 1, 2")
def _(spark, sf):
    e = fx.lines(spark, sf, "kv", "csv", "asa").select("source_id", text.text_fingerprint(F.col("line"), F.col("source_id")).alias("fingerprint"))
    return e.groupBy("source_id", "fingerprint").agg(F.count("*").alias("n"))


# --- redaction ---------------------------------------------------------------------------------

_SECRET = """concat('GET Authorization: ', CASE WHEN c_nationkey > 12 THEN 'Bearer ' ELSE 'basic ' END, md5(c_name), '== user=', c_name, ' Password=', md5(c_mktsegment), ', pwd: x', cast(c_custkey as {s}), '; key AKIA', upper(substring(md5(c_name), 1, 16)), ' end')"""
_AUTH_SQL = r"regexp_replace({0}, '(Authorization:\s*(?:Bearer\s+|Basic\s+)?)([a-zA-Z0-9\-\._~+/]+=*)', '\1[REDACTED]', 'gi')"
_PASS_SQL = r"regexp_replace({0}, '(password|passwd|pwd)\s*(=|:)\s*([^\s,;]+)', '\1\2[REDACTED]', 'gi')"
_AWS_SQL = r"regexp_replace({0}, '\bAKIA[A-Z0-9]{{16}}\b', '[AWS_ACCESS_KEY_REDACTED]', 'g')"


def _secret_lines(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr("c_custkey", _SECRET.format(s="string") + " AS line")


for _n, _f, _s in [("redact_auth_header", redact.redact_auth_header, _AUTH_SQL), ("redact_password", redact.redact_password, _PASS_SQL), ("redact_aws_key", redact.redact_aws_key, _AWS_SQL)]:
    def _redact_query(spark, sf, f=_f):
        return _secret_lines(spark, sf).select("c_custkey", f(F.col("line")).alias("redacted"))

    query(_n, f"SELECT c_custkey, {_s.format('line')} AS redacted FROM (SELECT c_custkey, {_SECRET.format(s='varchar')} AS line FROM customer)")(_redact_query)

_ALL_SQL = _AWS_SQL.format(_PASS_SQL.format(_AUTH_SQL.format("line")))


@query("redact_secrets", f"SELECT id, {_ALL_SQL} AS redacted FROM (SELECT c_custkey AS id, {_SECRET.format(s='varchar')} AS line FROM customer)")
def _(spark, sf):
    return _secret_lines(spark, sf).select(F.col("c_custkey").alias("id"), redact.redact_secrets(F.col("line")).alias("redacted"))


@query("redact_documents")
def _(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents"))
    return docs.select("doc_id", F.sha2(redact.redact_secrets(F.col("text")), 256).alias("redacted_hash"))


@query("raw_as_json_or_text", f"SELECT trace_id, CASE WHEN json_valid(line) THEN concat('{{\"eventName\":', json_extract(line, '$.eventName'), ',\"eventTime\":', json_extract(line, '$.eventTime'), ',\"sev\":', json_extract(line, '$.sev'), ',\"sourceIPAddress\":', json_extract(line, '$.sourceIPAddress'), ',\"userIdentity\":', json_extract(line, '$.userIdentity'), '}}') ELSE line END AS payload FROM {L('json', 'csv')}")
def _(spark, sf):
    return fx.lines(spark, sf, "json", "csv").select("trace_id", text.raw_as_json_or_text(F.col("line")).alias("payload"))
