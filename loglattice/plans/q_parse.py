"""Queries: parsers, validation, rule lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import typecheck
from loglattice.functions.ids import digest, digest_verified
from loglattice.operators import rules as r
from loglattice.operators.engine import RuleSet
from loglattice.operators.rules import Rule
from loglattice.plans import fixtures as fx
from loglattice.plans.q_text import L
from loglattice.plans.registry import query

_RULE = {rule.rule_version_id: rule for rule in fx.RULES}


def _extract(spark, sf, kind, rule, columns, source=None):
    """Parse lines under one rule and read mapped targets back as columns."""
    rules = RuleSet([rule])
    df = (source if source is not None else fx.lines(spark, sf, kind)).select("trace_id", "line", F.lit(rule.rule_version_id).alias("rv"))
    parsed = rules.parse_and_check(df, "line", "rv")
    index = {t: i for i, t in enumerate(rule.targets)}
    return parsed.select("trace_id", *[F.get("_values", F.lit(index[t]))["value"].alias(name) for t, name in columns], F.col("_error").alias("error"))


_ASA_COLS = [("event_time", "ts"), ("source.hostname", "host"), ("security.action", "action"), ("network.protocol", "proto"), ("network.src_ip", "src_ip"), ("network.src_port", "src_port"), ("network.dst_ip", "dst_ip"), ("network.dst_port", "dst_port")]


def _rx(pattern, group, expr="line"):
    return f"regexp_extract({expr}, '{pattern}', {group})"


_ASA_SQL = ", ".join([
    "substring(line, 6, 20) AS ts", _rx("[0-9] (asa-[^ ]+) :", 1) + " AS host", _rx("(permitted|denied)", 1) + " AS action", _rx("(permitted|denied) (\\w+) inside", 2) + " AS proto",
    _rx("inside/([0-9.]+)", 1) + " AS src_ip", _rx("inside/[0-9.]+\\((\\d+)", 1) + " AS src_port", _rx("outside/([0-9.]+)", 1) + " AS dst_ip", _rx("outside/[0-9.]+\\((\\d+)", 1) + " AS dst_port"])


@query("parse_regex", f"SELECT trace_id, {_ASA_SQL}, CAST(NULL AS varchar) AS error FROM {L('asa')}")
def _(spark, sf):
    return _extract(spark, sf, "asa", _RULE["asa-rx@1"], _ASA_COLS)


@query("parse_regex_positional", f"SELECT trace_id, split_part(line, ',', 1) AS ts, split_part(line, ',', 8) AS host, split_part(line, ',', 9) AS src_ip, split_part(line, ',', 12) AS action, CAST(NULL AS varchar) AS error FROM {L('csv')}")
def _(spark, sf):
    return _extract(spark, sf, "csv", _RULE["pan-rx@1"], [("event_time", "ts"), ("source.hostname", "host"), ("network.src_ip", "src_ip"), ("security.action", "action")])


_JSON_RULE = Rule("j@1", "j", 1, "jsonpath", {"paths": {"a": "$.userIdentity.arn", "n": "$.eventName", "s": "$.sev", "m": "$.missing.x", "w": "$..arn"}},
                  {"a": "source.user", "n": "security.action", "s": "severity", "m": "nothing", "w": "deep"}, ["security.action"])


@query("parse_jsonpath", f"""SELECT trace_id, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.userIdentity.arn') END AS arn, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.eventName') END AS action,
  CASE WHEN json_valid(line) THEN json_extract_string(line, '$.sev') END AS sev, CAST(NULL AS varchar) AS nothing, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.userIdentity.arn') END AS deep,
  CASE WHEN json_valid(line) THEN NULL ELSE 'Event is not valid JSON' END AS error FROM {L('json')}""")
def _(spark, sf):
    return _extract(spark, sf, "json", _JSON_RULE, [("source.user", "arn"), ("security.action", "action"), ("severity", "sev"), ("nothing", "nothing"), ("deep", "deep")])


_CEF_HEAD = Rule("ch@1", "ch", 1, "cef", field_mappings={"cef_version": "v", "device_vendor": "vendor", "device_product": "product", "device_event_class_id": "cls", "name": "name", "severity": "sev"})
_CEF_EXT = Rule("ce@1", "ce", 1, "cef", field_mappings={"src": "src", "suser": "suser", "act": "act", "rt": "rt", "msg": "msg"})
_CEF_BAD = "CASE WHEN starts_with(line, 'CEF:') THEN NULL ELSE 'Event does not start with CEF:' END"


def _cef(expr):
    return f"CASE WHEN starts_with(line, 'CEF:') THEN {expr} END"


@query("parse_cef_header", f"SELECT trace_id, {_cef(chr(39) + '0' + chr(39))} AS v, {_cef('split_part(line, chr(124), 2)')} AS vendor, {_cef('split_part(line, chr(124), 3)')} AS product, {_cef('split_part(line, chr(124), 5)')} AS cls, {_cef('split_part(line, chr(124), 6)')} AS name, {_cef('split_part(line, chr(124), 7)')} AS sev, {_CEF_BAD} AS error FROM {L('cef')}")
def _(spark, sf):
    return _extract(spark, sf, "cef", _CEF_HEAD, [(t, t) for t in _CEF_HEAD.targets])


@query("parse_cef_extension", f"SELECT trace_id, {_cef(_rx('src=([^ ]+)', 1))} AS src, {_cef(_rx('suser=([^ ]+)', 1))} AS suser, {_cef(_rx(' act=([^ ]+)', 1))} AS act, {_cef(_rx(' rt=([^ ]+)', 1))} AS rt, {_cef(_rx(' msg=(.*)$', 1))} AS msg, {_CEF_BAD} AS error FROM {L('cef')}")
def _(spark, sf):
    return _extract(spark, sf, "cef", _CEF_EXT, [(t, t) for t in _CEF_EXT.targets])


_LEEF = Rule("le@1", "le", 1, "leef", field_mappings={"leef_version": "v", "device_vendor": "vendor", "device_event_class_id": "cls", "src": "src", "usrName": "usr", "nation": "nation"})


@query("parse_leef_header", f"SELECT trace_id, replace(split_part(line, '|', 1), 'LEEF:', '') AS v, split_part(line, '|', 2) AS vendor, split_part(line, '|', 5) AS cls, CAST(NULL AS varchar) AS error FROM {L('leef', 'leef2')}")
def _(spark, sf):
    return _extract(spark, sf, None, _LEEF, [("v", "v"), ("vendor", "vendor"), ("cls", "cls")], fx.lines(spark, sf, "leef", "leef2"))


@query("parse_leef1_ext", f"SELECT trace_id, {_rx('src=([^' + chr(92) + 't]+)', 1)} AS src, {_rx('usrName=([^' + chr(92) + 't]+)', 1)} AS usr, {_rx('nation=(.+)$', 1)} AS nation, CAST(NULL AS varchar) AS error FROM {L('leef')}")
def _(spark, sf):
    return _extract(spark, sf, "leef", _LEEF, [("src", "src"), ("usr", "usr"), ("nation", "nation")])


@query("parse_leef2_ext", f"SELECT trace_id, {_rx('src=([^^]+)', 1)} AS src, {_rx('usrName=(.+)$', 1)} AS usr, CAST(NULL AS varchar) AS nation, CAST(NULL AS varchar) AS error FROM {L('leef2')}")
def _(spark, sf):
    return _extract(spark, sf, "leef2", _LEEF, [("src", "src"), ("usr", "usr"), ("nation", "nation")])


_KV = Rule("kq@1", "kq", 1, "keyvalue", {}, {"devname": "dev", "type": "type", "srcip": "src", "action": "act", "sentbyte": "bytes"})


@query("parse_kv_quoted", f"""SELECT trace_id, {_rx('devname="([^"]*)"', 1)} AS dev, {_rx('type="([^"]*)"', 1)} AS type, {_rx('srcip=([^ ]+)', 1)} AS src, {_rx('action="([^"]*)"', 1)} AS act, {_rx('sentbyte=([0-9]+)', 1)} AS bytes, CAST(NULL AS varchar) AS error FROM {L('kv')}""")
def _(spark, sf):
    return _extract(spark, sf, "kv", _KV, [(t, t) for t in _KV.targets])


_KVD_LINE = "concat('k1: \"', p_brand, '\" ; k2 :', p_type, ';size:', cast(p_size as {s}), ';size:', cast(p_size + 1 as {s}))"
_KVD = Rule("kd@1", "kd", 1, "kv", {"delimiter": ";", "kv_separator": ":"}, {"k1": "brand", "k2": "type", "size": "size"})


@query("parse_kv_delimited", "SELECT concat('p', cast(p_partkey as varchar)) AS trace_id, p_brand AS brand, p_type AS type, cast(p_size + 1 as varchar) AS size, CAST(NULL AS varchar) AS error FROM part")
def _(spark, sf):
    src = fx.table(spark, sf, "part").selectExpr("concat('p', cast(p_partkey as string)) AS trace_id", _KVD_LINE.format(s="string") + " AS line")
    return _extract(spark, sf, None, _KVD, [("brand", "brand"), ("type", "type"), ("size", "size")], src)


def _xml_query(mapping, columns):
    rule = Rule("xx@1", "xx", 1, "xml", {}, mapping)
    return lambda spark, sf: _extract(spark, sf, "xml", rule, columns).withColumn("error", F.col("error").isNotNull())


_XML_OK = "NOT ends_with(line, '\"></Event>')"


def _xml_sql(pairs):
    cols = ", ".join(f"CASE WHEN {_XML_OK} THEN {expr} END AS {name}" for expr, name in pairs)
    return f"SELECT trace_id, {cols}, NOT ({_XML_OK}) AS error FROM {L('xml')}"


query("parse_xml_path", _xml_sql([(_rx("<EventID>([0-9]+)<", 1), "event_code"), (_rx("<Computer>([^<]+)<", 1), "host")]))(
    _xml_query({"Event/System/EventID": "c", "Event/System/Computer": "h"}, [("c", "event_code"), ("h", "host")]))
query("parse_xml_attr", _xml_sql([(_rx('nation="([0-9]+)"', 1), "nation")]))(_xml_query({"Event/EventData/@nation": "n"}, [("n", "nation")]))
query("xml_relative_path", _xml_sql([(_rx("<EventID>([0-9]+)<", 1), "event_code"), (_rx('nation="([0-9]+)"', 1), "nation")]))(
    _xml_query({"System/EventID": "c", "EventData/@nation": "n"}, [("c", "event_code"), ("n", "nation")]))


@query("map_fields", f"SELECT trace_id, 'source.ip' AS field, {_rx('src=([^ ]+)', 1)} AS value FROM {L('cef')} WHERE starts_with(line, 'CEF:') UNION ALL SELECT trace_id, 'message', {_rx(' msg=(.*)$', 1)} FROM {L('cef')} WHERE starts_with(line, 'CEF:')")
def _(spark, sf):
    rule = Rule("m@1", "m", 1, "cef", {}, {"src": "source.ip", "msg": "message", "absent": "never"})
    parsed = RuleSet([rule]).parse_and_check(fx.lines(spark, sf, "cef").select("trace_id", "line", F.lit("m@1").alias("rv")), "line", "rv")
    cells = F.filter(F.zip_with("_values", "_fields", lambda v, f: F.struct(f["target"].alias("field"), v["value"].alias("value"), v["present"].alias("p"))), lambda c: c["p"])
    return parsed.select("trace_id", F.explode(cells).alias("c")).select("trace_id", "c.field", "c.value")


_DISPATCH = {"kv": "fw-kv@1", "json": "cloud-json@2", "cef": "gate-cef@1", "leef": "mail-leef@1", "leef2": "mail-leef@1", "asa": "asa-rx@1", "csv": "pan-rx@1", "xml": "win-xml@1"}
_BAD_IP = "starts_with(line, 'CEF:') AND line LIKE '%src=10.0.0.999 %'"
_ERRORS_SQL = f"""CASE WHEN kind = 'json' AND NOT json_valid(line) THEN 'Event is not valid JSON'
  WHEN kind = 'cef' AND NOT starts_with(line, 'CEF:') THEN 'Event does not start with CEF:'
  WHEN kind = 'cef' AND {_BAD_IP} THEN 'Validation failed: Field ''source.ip'' with value ''10.0.0.999'' does not match type constraint ''ip'''
  WHEN kind = 'kv' AND line LIKE '%.999.%' THEN concat('Validation failed: Field ''network.src_ip'' with value ''', regexp_extract(line, 'srcip=([^ ]+)', 1), ''' does not match type constraint ''ip''')
  WHEN kind = 'xml' AND ends_with(line, '"></Event>') THEN 'xml' END"""


def _dispatched(spark, sf):
    rv = F
    for kind, version in _DISPATCH.items():
        rv = rv.when(F.col("kind") == kind, version)
    df = fx.lines(spark, sf, *_DISPATCH).withColumn("rv", rv.otherwise(None))
    return fx.rule_set().parse_and_check(df, "line", "rv")


@query("parse_dispatch", f"SELECT kind, error IS NULL AS ok, count(*) AS n FROM (SELECT kind, {_ERRORS_SQL} AS error FROM {L(*_DISPATCH)}) GROUP BY 1, 2")
def _(spark, sf):
    return _dispatched(spark, sf).groupBy("kind", F.col("_error").isNull().alias("ok")).agg(F.count("*").alias("n"))


@query("parse_error", f"SELECT trace_id, error FROM (SELECT trace_id, {_ERRORS_SQL} AS error FROM {L(*_DISPATCH)}) WHERE error IS NOT NULL")
def _(spark, sf):
    bad = _dispatched(spark, sf).filter("_error IS NOT NULL")
    return bad.select("trace_id", F.when(F.col("kind") == "xml", "xml").otherwise(F.col("_error")).alias("error"))


# --- validation ----------------------------------------------------------------------------------

@query("check_required", f"SELECT trace_id, CASE WHEN kind = 'leef' THEN 'Validation failed: Missing required fields: [''who'']' ELSE 'Validation failed: Missing required fields: [''nation'', ''who'']' END AS error FROM {L('leef', 'leef2')}")
def _(spark, sf):
    rule = Rule("rq@1", "rq", 1, "leef", {}, {"src": "source.ip", "nation": "nation", "absent": "who"}, ["source.ip", "nation", "who"])
    return _extract(spark, sf, None, rule, [], fx.lines(spark, sf, "leef", "leef2"))


_VALUES = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN cast(event_id as {s}) WHEN 'view' THEN concat(' +', cast(user_id as {s}), ' ') WHEN 'error' THEN concat('10.0.', cast(user_id as {s}), '.', cast(event_id as {s})) WHEN 'purchase' THEN concat(cast(user_id as {s}), '.5e3') ELSE event_type END AS v FROM events
 UNION ALL SELECT -1 - o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Yes' WHEN '2-HIGH' THEN {d} WHEN '3-MEDIUM' THEN concat('2001:db8::', cast(o_custkey as {s})) WHEN '5-LOW' THEN 'inf' ELSE concat({d}, 'T25:00:00') END FROM orders"""
_VAL_SQL = _VALUES.format(s="varchar", d="strftime(o_orderdate, '%Y-%m-%d')")


def _values(spark, sf):
    fx.table(spark, sf, "events").createOrReplaceTempView("_v_events")
    fx.table(spark, sf, "orders").createOrReplaceTempView("_v_orders")
    sql = _VALUES.format(s="string", d="date_format(o_orderdate, 'yyyy-MM-dd')")
    return spark.sql(sql.replace("FROM events", "FROM _v_events").replace("FROM orders", "FROM _v_orders"))


_V4 = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TYPE_SQL = {
    "int": "regexp_full_match(v, '\\s*[+-]?\\d+\\s*')",
    "float": "regexp_full_match(v, '\\s*[+-]?(\\d+(\\.\\d*)?(e[+-]?\\d+)?|inf)\\s*')",
    "ip": f"(regexp_full_match(v, '{_V4}(\\.{_V4}){{3}}') OR regexp_full_match(v, '2001:db8::[0-9a-f]{{1,4}}'))",
    "datetime": "regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}')",
    "boolean": "lower(v) IN ('true','false','1','0','yes','no')",
}
for _t, _cond in _TYPE_SQL.items():
    def _type_query(spark, sf, t=_t):
        return _values(spark, sf).select("id", typecheck.check_type(F.col("v"), F.lit("str"), t).alias("ok"))

    query(f"is_{_t}", f"SELECT id, {_cond} AS ok FROM ({_VAL_SQL})")(_type_query)


@query("check_types", f"SELECT id, CASE WHEN NOT {_TYPE_SQL['float']} THEN concat('Validation failed: Field ''n'' with value ''', v, ''' does not match type constraint ''float''') END AS error FROM (SELECT id, trim(v) AS v FROM ({_VAL_SQL}))")
def _(spark, sf):
    rule = Rule("ct@1", "ct", 1, "regex", {"pattern": r"^\s*(\S+)\s*$"}, {"capture_1": "n"}, [], {"n": "float", "other": "int"})
    src = _values(spark, sf).select(F.col("id").cast("string").alias("trace_id"), F.col("v").alias("line"))
    return _extract(spark, sf, None, rule, [], src).select(F.col("trace_id").cast("long").alias("id"), "error")


@query("check_types_unknown", f"SELECT trace_id, CAST(NULL AS varchar) AS error FROM {L('csv')}")
def _(spark, sf):
    rule = Rule("cu@1", "cu", 1, "regex", {"pattern": fx.CSV_PATTERN}, {"capture_5": "x"}, [], {"x": "ipv4_or_ipv6"})
    return _extract(spark, sf, "csv", rule, [])


# --- lint --------------------------------------------------------------------------------------------

_DEFS = """SELECT concat('p', cast(p_partkey as {s})) AS id, concat('{{"parser":{{"pattern":"^(', lower(substring(p_brand, 1, 5)), '+', CASE WHEN p_size > 25 THEN ')+' ELSE ')' END, '$","names":["', p_name, '"]}}', CASE WHEN p_retailprice > 1500 THEN '' ELSE '}}' END) AS def FROM part UNION ALL SELECT concat('d', cast(doc_id as {s})), text FROM documents"""


def _defs(spark, sf):
    fx.table(spark, sf, "part").createOrReplaceTempView("_lint_part")
    fx.table(spark, sf, "documents").createOrReplaceTempView("_lint_docs")
    return spark.sql(_DEFS.format(s="string").replace("FROM part", "FROM _lint_part").replace("FROM documents", "FROM _lint_docs"))


_DEFS_SQL = _DEFS.format(s="varchar")
query("lint_rule_size", f"SELECT id, length(def) <= 102400 AS ok FROM ({_DEFS_SQL})")(lambda spark, sf: _defs(spark, sf).select("id", r.lint_rule_size(F.col("def")).alias("ok")))
query("lint_rule_json", f"SELECT id, json_valid(def) AS ok FROM ({_DEFS_SQL})")(lambda spark, sf: _defs(spark, sf).select("id", r.lint_rule_json(F.col("def")).alias("ok")))


@query("lint_nested_quantifier", f"SELECT id, NOT (def LIKE '%+)+$%') AS ok FROM ({_DEFS_SQL})")
def _(spark, sf):
    return _defs(spark, sf).select("id", r.lint_nested_quantifier(F.col("def")).alias("ok"))


@query("rule_hash", """SELECT p_partkey AS id, sha256(concat_ws('|', 'regex', concat('{"a":"', p_brand, '","b":', cast(p_size as varchar), '}'), '{}', '[]', '{}', '{}', p_type, '1.0')) AS rule_hash FROM part""")
def _(spark, sf):
    rows = fx.table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "'regex' AS parser_type", """concat('{ "b": ', cast(p_size as string), ', "a":"', p_brand, '" }') AS parser_definition""",
        "cast(null as string) AS field_mappings", "cast(null as string) AS required_fields", "'{}' AS type_constraints", "cast(null as string) AS masking_policy", "p_type AS target_schema", "'1.0' AS schema_version")
    return rows.select("id", r.rule_hash().alias("rule_hash"))


@query("digest_verified", f"SELECT source_id, count(*) AS events, count(*) FILTER (WHERE line LIKE '%deny%') AS failures FROM {L('kv', 'json', 'csv')} GROUP BY 1")
def _(spark, sf):
    raw = fx.raw_events(spark, sf, "kv", "json", "csv")
    stored = F.when(F.contains("line", F.lit("deny")), digest(F.concat(F.col("payload"), F.lit(b"x")))).otherwise(F.col("digest"))
    return raw.withColumn("ok", digest_verified(F.col("payload"), stored)).groupBy("source_id").agg(F.count("*").alias("events"), F.count_if(~F.col("ok")).alias("failures"))


