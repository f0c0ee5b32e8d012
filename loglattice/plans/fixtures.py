"""Log lines derived from the given tables, and the rule catalogue that reads them.

Each kind is one text template over one table. The same template is rendered for Spark and for
the checking engine; ``{D:col}``, ``{T:col}``, ``{B:col}``, ``{P:col}`` are date, time and two
date-time renderings. Some lines are malformed by the value of an attribute, never by cutting.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions.text import fingerprint
from loglattice.operators.engine import RuleSet
from loglattice.operators.ingest import build_raw_events
from loglattice.operators.rules import Rule
from loglattice.session import tasks_for

_SPARK_FORMATS = {"D": "yyyy-MM-dd", "T": "HH:mm:ss", "B": "MMM dd yyyy HH:mm:ss", "P": "yyyy/MM/dd HH:mm:ss"}
_OTHER_FORMATS = {"D": "%Y-%m-%d", "T": "%H:%M:%S", "B": "%b %d %Y %H:%M:%S", "P": "%Y/%m/%d %H:%M:%S"}


@dataclass(frozen=True)
class Kind:
    table: str
    source_id: str
    seq: str
    received: str
    template: str


def _action(key: str) -> str:
    words = ["permit", "pass", "accept", "drop", "block", "reject", "allow", "deny"]
    return "CASE " + key + " % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


KINDS: dict[str, Kind] = {
    "kv": Kind("events", "fw", "event_id", "ts", f"""concat('date=', {{D:ts}}, ' time=', {{T:ts}}, ' devname="fw-', cast(user_id % 7 as string), '" type="traffic" srcip=10.', cast(user_id % 200 as string), CASE WHEN event_type = 'error' THEN '.999.' ELSE '.0.' END, cast(event_id % 250 as string), ' srcport=', cast(1024 + event_id % 60000 as string), ' dstip=203.0.113.', cast(event_id % 250 as string), ' dstport=443 proto=6 action="', {_action('event_id')}, '" sentbyte=', cast(event_id * 7 % 99991 as string))"""),
    "json": Kind("events", "cloud", "event_id", "ts", """concat('{"eventTime":"', {D:ts}, 'T', {T:ts}, 'Z","eventName":"', event_type, '","sourceIPAddress":"198.51.100.', cast(user_id % 250 as string), '","userIdentity":{"arn":"arn:user/', cast(user_id as string), '"},"sev":', CASE WHEN event_type = 'error' THEN '' ELSE cast(event_id % 5 as string) END, '}')"""),
    "cef": Kind("orders", "gate", "o_orderkey", "o_orderdate", f"""concat(CASE WHEN o_orderstatus = 'P' THEN 'CEF 0' ELSE 'CEF:0' END, '|Acme|Gate|1.0|', o_orderstatus, '|order ', lower(o_orderpriority), '|5|src=10.0.0.', CASE WHEN o_totalprice > 400000 THEN '999' ELSE cast(o_custkey % 250 as string) END, ' suser=u', cast(o_custkey as string), ' act=', {_action('o_orderkey')}, ' rt=', {{D:o_orderdate}}, ' msg=order ', cast(o_orderkey as string), ' accepted')"""),
    "leef": Kind("customer", "mail", "c_custkey", "", """concat('LEEF:1.0|Acme|Mail|2.1|', c_mktsegment, '|src=10.1.0.', cast(c_custkey % 250 as string), {TAB}, 'usrName=', c_name, {TAB}, 'nation=', cast(c_nationkey as string))"""),
    "leef2": Kind("customer", "mail", "c_custkey", "", """concat('LEEF:2.0|Acme|Mail|2.1|', c_mktsegment, '|^|src=10.1.0.', cast(c_custkey % 250 as string), '^usrName=', c_name)"""),
    "asa": Kind("lineitem", "asa", "l_orderkey * 8 + l_linenumber", "l_shipdate", """concat('<166>', {B:l_shipdate}, ' asa-', lower(l_returnflag), '-0', cast(l_linenumber as string), ' : %ASA-6-106100: access-list ACL-IN ', CASE WHEN l_linestatus = 'O' THEN 'permitted' ELSE 'denied' END, ' tcp inside/10.', cast(l_suppkey % 250 as string), '.0.', cast(l_partkey % 250 as string), '(', cast(1024 + l_orderkey % 60000 as string), ') -> outside/203.0.113.', cast(l_partkey % 250 as string), '(443) hit-cnt ', cast(l_linenumber as string))"""),
    "csv": Kind("orders", "pan", "o_orderkey", "o_orderdate", f"""concat({{P:o_orderdate}}, ',TRAFFIC,end,2560,0x0,trust,untrust,panos-', lower(o_orderstatus), '-01,172.16.0.', cast(o_custkey % 250 as string), ',203.0.113.', cast(o_orderkey % 250 as string), ',tcp,', {_action('o_orderkey')})"""),
    "xml": Kind("supplier", "win", "s_suppkey", "", """concat('<Event><System><EventID>', cast(s_suppkey as string), '</EventID><Computer>', s_name, '</Computer></System><EventData nation="', cast(s_nationkey as string), CASE WHEN s_acctbal < 0 THEN '"></Event>' ELSE '"/></Event>' END)"""),
    "noise": Kind("documents", "misc", "doc_id", "", "text"),
    # Lines rich in tokens of every class, for the fingerprint masks.
    "mix": Kind("customer", "mix", "c_custkey", "", """concat('req ', substring(md5(c_name), 1, 8), '-', substring(md5(c_name), 9, 4), '-4', substring(md5(c_name), 14, 3), '-a', substring(md5(c_name), 18, 3), '-', substring(md5(c_name), 21, 12), ' mac ', substring(md5(c_name), 1, 2), ':', substring(md5(c_name), 3, 2), ':', substring(md5(c_name), 5, 2), ':', substring(md5(c_name), 7, 2), ':', substring(md5(c_name), 9, 2), ':', substring(md5(c_name), 11, 2), ' hash 0x', md5(c_mktsegment), '  mail ', lower(c_mktsegment), '.', cast(c_custkey as string), '@corp.example ref https://host', cast(c_nationkey as string), '.example/p/', cast(c_custkey as string), '?q=1 at 2024-03-0', cast(1 + c_custkey % 9 as string), 'T10:00:0', cast(c_custkey % 10 as string), 'Z from 10.0.', cast(c_nationkey as string), '.', cast(c_custkey % 250 as string), ' on Mar  ', cast(1 + c_custkey % 9 as string), ' 10:11:12 ')"""),
}
# Columns that tell the rows of a table apart.
DEALT_BY = {
    "events": ["event_id", "ts"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_name"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "supplier": ["s_suppkey", "s_name"], "documents": ["doc_id", "text"],
}
LINE_KINDS = ["kv", "json", "cef", "leef", "leef2", "asa", "csv", "xml", "noise"]
TEXT_KINDS = ["kv", "cef", "leef", "leef2", "asa", "csv", "xml", "mix"]
DEFAULT_TIME = "2024-01-01 00:00:00"


def _render(template: str, spark: bool) -> str:
    def stamp(match):
        name, column = match[1], match[2]
        if spark:
            return f"date_format({column}, '{_SPARK_FORMATS[name]}')"
        return f"strftime({column}, '{_OTHER_FORMATS[name]}')"

    text = re.sub(r"\{([DTBP]):(\w+)\}", stamp, template)
    return text.replace("{TAB}", "char(9)" if spark else "chr(9)")


def _columns(name: str, spark: bool) -> list[str]:
    kind = KINDS[name]
    stamp = "timestamp_ntz" if spark else "timestamp"
    seq = f"cast({kind.seq} as bigint)"
    received = f"cast({kind.received} as {stamp})" if kind.received else f"{stamp}'{DEFAULT_TIME}'" if spark else f"timestamp '{DEFAULT_TIME}'"
    return [
        f"'{name}' AS kind",
        f"'{kind.source_id}' AS source_id",
        f"{seq} AS seq",
        f"{received} AS received_at",
        f"concat('{kind.source_id}-', cast({kind.seq} % 4 as string)) AS job_id",
        f"concat('{name}-', cast({kind.seq} as string)) AS trace_id",
        f"{_render(kind.template, spark)} AS line",
    ]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores, whatever row groups the files have: a scan by bytes leaves all rows of a row group to one task.

    Dealt by hash of the keys (of all columns without any), so no sort is needed and a retried task deals the same.
    """
    return df.repartition(tasks_for(df), *[F.col(k) for k in keys or df.columns])


def lines(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Derived lines of the given kinds (all of the standard ones by default)."""
    names = list(kinds or LINE_KINDS)
    # Rows of the tables are spread, which are narrow; lines are rendered where they are read.
    tables = {t: spread(table(spark, sf, t), *DEALT_BY[t]) for t in {KINDS[k].table for k in names}}
    return reduce(DataFrame.unionByName, [tables[KINDS[k].table].selectExpr(*_columns(k, True)) for k in names])


def lines_sql(*kinds: str) -> str:
    """The same lines as SQL for the checking engine."""
    return " UNION ALL ".join(
        f"SELECT {', '.join(_columns(k, False))} FROM {KINDS[k].table}" for k in (kinds or LINE_KINDS)
    )


def raw_events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    return build_raw_events(lines(spark, sf, *kinds))


# --- rules ------------------------------------------------------------------------------

MASK_KEY = b"fixture-key"

ASA_PATTERN = (
    r"^<\d+>(?P<ts>[A-Z][a-z]{2} \d{2} \d{4} \d{2}:\d{2}:\d{2}) (?P<host>\S+) : %ASA-\d-\d+: access-list \S+ "
    r"(?P<action>permitted|denied) (?P<proto>\w+) \w+/(?P<src_ip>[0-9.]+)\((?P<src_port>\d+)\) -> \w+/(?P<dst_ip>[0-9.]+)\((?P<dst_port>\d+)\)"
)
CSV_PATTERN = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}),(\w+),(\w+),\d+,\w+,\w+,\w+,([^,]+),([0-9.]+),([0-9.]+),(\w+),(\w+)$"

_KV = dict(
    parser_type="keyvalue",
    parser_definition={"delimiter": " ", "kv_separator": "="},
    field_mappings={
        "srcip": "network.src_ip", "dstip": "network.dst_ip", "dstport": "network.dst_port", "action": "security.action",
        "devname": "source.hostname", "sentbyte": "sentbyte", "date": "event_time",
    },
)
_CLOUD = dict(
    parser_type="jsonpath",
    parser_definition={"paths": {"arn": "$.userIdentity.arn", "ip": "$.sourceIPAddress", "name": "$.eventName", "time": "$.eventTime", "sev": "$.sev"}},
    field_mappings={"arn": "source.user", "ip": "source.ip", "name": "security.action", "time": "event_time"},
    required_fields=["event_time", "security.action"], type_constraints={"event_time": "datetime"},
    masking_policy={"source.user": "mask"}, target_schema="ecs",
)
RULES = [
    Rule("fw-kv@1", "fw-kv", 1, **_KV, required_fields=["network.src_ip", "security.action"],
         type_constraints={"network.src_ip": "ip", "network.dst_port": "int"}, masking_policy={"network.src_ip": "hash"}, rule_hash="h-fw-1"),
    Rule("cloud-json@1", "cloud-json", 1, **_CLOUD, status="DEPRECATED", rule_hash="h-cloud-1"),
    Rule("cloud-json@2", "cloud-json", 2, **_CLOUD, rule_hash="h-cloud-2"),
    Rule("gate-cef@1", "gate-cef", 1, "cef",
         field_mappings={"src": "source.ip", "suser": "source.user", "act": "security.action", "rt": "event_time", "msg": "message"},
         required_fields=["source.ip"], type_constraints={"source.ip": "ip"}, target_schema="ocsf", rule_hash="h-gate-1"),
    Rule("mail-leef@1", "mail-leef", 1, "leef",
         field_mappings={"src": "source.ip", "usrName": "source.user", "device_event_class_id": "security.category"},
         required_fields=["source.ip"], masking_policy={"source.user": "drop"}, target_schema="ocsf", rule_hash="h-mail-1"),
    Rule("asa-rx@1", "asa-rx", 1, "regex", {"pattern": ASA_PATTERN},
         {"ts": "event_time", "host": "source.hostname", "action": "security.action", "proto": "network.protocol", "src_ip": "network.src_ip",
          "src_port": "network.src_port", "dst_ip": "network.dst_ip", "dst_port": "network.dst_port"},
         ["event_time", "network.src_ip"], {"network.src_port": "int"}, rule_hash="h-asa-1"),
    Rule("pan-rx@1", "pan-rx", 1, "regex", {"pattern": CSV_PATTERN},
         {"capture_1": "event_time", "capture_4": "source.hostname", "capture_5": "network.src_ip", "capture_6": "network.dst_ip",
          "capture_7": "network.protocol", "capture_8": "security.action", "capture_99": "never"},
         ["event_time"], rule_hash="h-pan-1"),
    Rule("win-xml@1", "win-xml", 1, "xml",
         field_mappings={"System/EventID": "event_code", "Event/System/Computer": "source.hostname", "EventData/@nation": "security.category"},
         required_fields=["source.hostname"], rule_hash="h-win-1"),
    Rule("dis-kv@1", "dis-kv", 1, **_KV, rule_status="DISABLED", status="DISABLED", rule_hash="h-dis-1"),
]

_SAMPLE_LINES = [
    ("fw-kv", "fw", 'date=2024-01-01 time=00:00:00 devname="fw-1" type="traffic" srcip=10.1.0.1 srcport=1024 dstip=203.0.113.1 dstport=443 proto=6 action="pass" sentbyte=7'),
    ("cloud-json", "cloud", '{"eventTime":"2024-01-01T00:00:00Z","eventName":"x","sourceIPAddress":"198.51.100.1","userIdentity":{"arn":"arn:user/1"},"sev":1}'),
    ("mail-leef", "mail", "LEEF:1.0|Acme|Mail|2.1|FURNITURE|src=10.1.0.1\tusrName=Customer#000000001\tnation=1"),
    ("mail-leef", "mail", "LEEF:2.0|Acme|Mail|2.1|FURNITURE|^|src=10.1.0.1^usrName=Customer#000000001"),
    ("pan-rx", "pan", "2024/01/01 00:00:00,TRAFFIC,end,2560,0x0,trust,untrust,panos-o-01,172.16.0.1,203.0.113.1,tcp,pass"),
    ("win-xml", "win", '<Event><System><EventID>1</EventID><Computer>Supplier#000000001</Computer></System><EventData nation="1"/></Event>'),
]


@cache
def rule_set(**options) -> RuleSet:
    """The active rules in catalogue order."""
    active = sorted((r for r in RULES if r.status == "ACTIVE" and r.rule_status == "ACTIVE"), key=lambda r: (r.created_at, r.rule_id))
    return RuleSet(active, MASK_KEY, **options)


def bindings(spark: SparkSession) -> DataFrame:
    """Fingerprints bound to rules from one known line each; asa-rx and gate-cef stay unbound."""
    samples = spark.createDataFrame(_SAMPLE_LINES, "rule_id string, source_id string, line string")
    return samples.select("rule_id", fingerprint(F.col("line"), F.col("source_id")).alias("fingerprint"), F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at"))


def sources(spark: SparkSession) -> DataFrame:
    """Source dimension: tenants, vendors and namespaces of the derived sources."""
    rows = [("fw", "default", "FortiWall", "acme", "", "syslog"), ("cloud", "default", "Cloud", "Nimbus", None, "api"), ("gate", "default", "Gate", "Acme", "gate", "syslog"),
            ("mail", "default", "Mail", None, None, "syslog"), ("asa", "default", "Edge", "Vendor", "asa", "syslog"), ("pan", "default", "Pan", "", "", "syslog"),
            ("win", "default", "Win", "Soft", "", "agent"), ("misc", "other", "Misc", None, None, "api")]
    return spark.createDataFrame(rows, "source_id string, tenant_id string, name string, vendor string, namespace string, transport string")
