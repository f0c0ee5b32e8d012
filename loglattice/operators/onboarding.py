"""From unknown lines to a tested rule: sources, samples, templates, rule tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.redact import redact_secrets
from loglattice.functions.text import STRIP_CHARS, trim_space
from loglattice.operators.engine import RuleSet, py_text
from loglattice.operators.ranking import WINDOW_MAX_ROWS, first_per_group, number_rows
from loglattice.operators.rules import Rule
from loglattice.session import cut_lineage, lookup_join
from loglattice.sources.vault import fetch_raw

MAX_SAMPLES = 5
SOURCE_PREFIX_CHARS = 5
EMPTY_PREFIX = "UNK"


def source_prefix(vendor: Column, name: Column) -> Column:
    """Up to five letters and digits of the vendor, or of the name when there is no vendor."""
    raw = F.when(F.coalesce(vendor, F.lit("")) != "", trim_space(vendor)).otherwise(trim_space(name))
    letters = F.substring(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", ""), 1, SOURCE_PREFIX_CHARS)
    return F.when(letters == "", EMPTY_PREFIX).otherwise(letters)


def register_sources(requests: DataFrame, existing: DataFrame, order: str, max_group: int = WINDOW_MAX_ROWS) -> DataFrame:
    """Source ids for new sources: prefix plus the next number within tenant and prefix."""
    wanted = requests.withColumn("_prefix", source_prefix(F.col("vendor"), F.col("name")))
    numbered = number_rows(wanted, ["tenant_id", "_prefix"], [F.col(order)], "_n", max_group)
    taken = (
        existing.withColumn("_prefix", F.regexp_extract("source_id", "^SRC-(.*)-", 1))
        .groupBy("tenant_id", "_prefix").agg(F.count(F.lit(1)).alias("_taken"))
    )
    joined = numbered.join(taken, ["tenant_id", "_prefix"], "left")
    number = (F.coalesce("_taken", F.lit(0)) + F.col("_n")).cast("string")
    padded = F.lpad(number, F.greatest(F.lit(3), F.char_length(number)), F.lit("0"))
    return joined.withColumn("source_id", F.concat(F.lit("SRC-"), F.col("_prefix"), F.lit("-"), padded)).drop("_prefix", "_n", "_taken")


def shown(line: Column, redact: bool) -> Column:
    """A line as it may leave the vault: secrets are masked unless the caller says otherwise."""
    return redact_secrets(line) if redact else line


def pull_samples(unresolved: DataFrame, raw: DataFrame, n: int = MAX_SAMPLES, redact: bool = True) -> DataFrame:
    """Up to five lines per source and fingerprint, earliest first, without secrets.

    Ids are cut before lines are read, and lines are fetched by their address in the vault.
    """
    chosen = cut_lineage(first_per_group(unresolved.select("trace_id", "source_id", "fingerprint", "created_at"), ["source_id", "fingerprint"], [F.col("created_at"), F.col("trace_id")], n))
    lines = fetch_raw(raw, chosen).select("trace_id", shown(F.col("line"), redact).alias("line"))
    return lookup_join(lines, chosen.select("trace_id", "source_id", "fingerprint"), "trace_id", "inner").select("trace_id", "source_id", "fingerprint", "line")


def target_schema_compat(found: DataFrame, rules: RuleSet, target_schema: str | None, version: str = "rule_version_id") -> DataFrame:
    """Whether an active rule counts as found: it must write the requested layout, if one is requested."""
    layout = rules.literal_by_rule(version, lambda rule: rule.target_schema)
    rule_id = rules.literal_by_rule(version, lambda rule: rule.rule_id)
    good = F.col(version).isNotNull()
    if target_schema:
        good = good & (layout == target_schema)
    return found.withColumns({"active_rule_found": F.coalesce(good, F.lit(False)), "active_rule_id": F.when(good, rule_id)})


# Template names and what a group of samples must contain, tried in this order.
TEMPLATES = [
    ("firewall_threat", ["PAN"]),
    ("asa", ["ASA", "asa"]),
    ("sensor_json", ["sensor-0029", "link_flap"]),
    ("leef", ["LEEF:"]),
]
NON_JSON_TEMPLATE, TRAIL_TEMPLATE, JSON_TEMPLATE = "any_text", "trail_json", "any_json"
TRAIL_MARKS = ["amazonaws.com", "eventName"]


def suggest_template(samples: DataFrame, line: str = "line", order: str = "trace_id") -> DataFrame:
    """Template per (source, fingerprint): the first whose mark occurs in any sample of the group.

    Flags and counts fit a hash aggregate, so samples are not sorted. Whether the first sample is JSON
    is settled where all of a group agree; only groups that hold both kinds are read again for it.
    """
    text, keys = F.col(line), ["source_id", "fingerprint"]

    def any_mark(marks):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        return F.bool_or(hit)

    is_json = F.startswith(F.ltrim(text, F.lit(STRIP_CHARS)), F.lit("{")) & F.try_parse_json(text).isNotNull()
    ordered = F.when(F.col(order).isNotNull(), F.coalesce(is_json, F.lit(False)))
    groups = cut_lineage(samples.groupBy(*keys).agg(
        *[any_mark(marks).alias(f"_{name}") for name, marks in TEMPLATES],
        F.bool_or(ordered).alias("_json"),
        F.bool_and(ordered).alias("_all_json"),
        any_mark(TRAIL_MARKS).alias("_trail"),
        F.count(F.lit(1)).alias("samples"),
    )).withColumn("_group", F.struct(*keys))
    mixed = groups.filter(F.col("_json") & ~F.col("_all_json")).select("_group")
    if not mixed.isEmpty():
        members = lookup_join(samples.withColumn("_group", F.struct(*keys)), mixed, "_group", "left_semi")
        first = members.groupBy("_group").agg(F.min_by(F.coalesce(is_json, F.lit(False)), F.col(order)).alias("_first"))
        groups = lookup_join(groups, first, "_group").withColumn("_json", F.coalesce("_first", "_json"))
    choice = F
    for name, _ in TEMPLATES:
        choice = choice.when(F.col(f"_{name}"), name)
    choice = choice.when(~F.coalesce(F.col("_json"), F.lit(False)), NON_JSON_TEMPLATE).when(F.col("_trail"), TRAIL_TEMPLATE).otherwise(JSON_TEMPLATE)
    return groups.select("source_id", "fingerprint", "samples", choice.alias("template"))


def template_rule(name: str, rule_id: str, target_schema: str = "ocsf") -> Rule:
    """Draft rule of a template. Patterns, paths and mappings."""
    bodies = {
        "firewall_threat": ("regex", {"pattern": r"<\d+>\d*\s*(?P<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[+-]\d{2}:\d{2}|Z))\s+(?P<host>\S+)\s+PAN\s+-\s+-\s+-\s+THREAT,\S+,(?P<action>[^,]+),(?P<src_ip>[^,]+),(?P<dst_ip>[^,]+),(?P<dst_port>[^,]+),(?P<protocol>[^,]+),(?P<severity>[^,]+),(?P<description>[\s\S]*)"},
                            {"timestamp": "event_time", "host": "source.device_type", "action": "security.action", "src_ip": "network.src_ip", "dst_ip": "network.dst_ip", "dst_port": "network.dst_port", "protocol": "network.protocol", "severity": "security.severity", "description": "security.description"},
                            ["event_time", "network.src_ip", "network.dst_ip", "security.action"]),
        "asa": ("regex", {"pattern": r"<(?P<syslog_pri>\d+)>(?P<timestamp>[A-Z][a-z]{2}\s+\d+\s+\d{4}\s+\d{2}:\d{2}:\d{2})\s+(?P<host>\S+)\s+:\s+%ASA-\d+-\d+:\s+(?P<message>[\s\S]*)"},
                {"timestamp": "event_time", "host": "source.hostname", "message": "message"}, ["event_time", "source.hostname"]),
        "sensor_json": ("jsonpath", {"paths": {"time": "$.t", "device": "$.dev", "event": "$.evt", "peer_ip": "$.peer", "severity": "$.sev"}},
                        {"time": "event_time", "device": "source.hostname", "event": "message", "peer_ip": "network.src_ip"}, ["event_time", "source.hostname"]),
        "leef": ("regex", {"pattern": r"LEEF:\d+\.\d+\|(?P<vendor>[^\|]+)\|(?P<product>[^\|]+)\|(?P<version>[^\|]+)\|(?P<event_id>[^\|]+)\|(?P<extensions>[\s\S]*)"},
                 {"vendor": "source.device_type", "product": "source.hostname", "event_id": "activity_id", "extensions": "message"}, ["source.device_type", "source.hostname"]),
        NON_JSON_TEMPLATE: ("regex", {"pattern": r"^(?P<message>[\s\S]*)$"}, {"message": "message"}, ["message"]),
        TRAIL_TEMPLATE: ("jsonpath", {"paths": {"time": "$.eventTime", "user": "$.userIdentity.arn", "src_ip": "$.sourceIPAddress", "action": "$.eventName"}},
                         {"time": "event_time", "user": "source.user", "src_ip": "network.src_ip", "action": "security.action"}, ["event_time", "security.action"]),
        JSON_TEMPLATE: ("jsonpath", {"paths": {"time": "$.timestamp", "user": "$.user_id"}}, {"time": "event_time", "user": "source.user"}, ["event_time"]),
    }
    parser_type, definition, mappings, required = bodies[name]
    return Rule(f"{rule_id}@1", rule_id, 1, parser_type, definition, mappings, required, target_schema=target_schema, status="DRAFT")


def rule_tests(samples: DataFrame, rules: RuleSet, version: str = "rule_version_id", line: str = "line", redact: bool = True) -> DataFrame:
    """Per sample and candidate rule: extracted fields, error, ok. All candidates run in one pass.

    Rules are tested on what may be shown, so a case keeps passing when it is tested again.
    """
    parsed = rules.parse_and_check(samples.withColumn(line, shown(F.col(line), redact)), line, version)
    fields = F.zip_with("_values", "_fields", lambda v, f: F.when(v["present"], F.struct(f["target"].alias("field"), py_text(v["value"], v["kind"]).alias("value"))))
    return parsed.withColumns({"extracted": F.array_compact(fields), "error": F.col("_error"), "ok": F.col("_error").isNull()}).drop("_values", "_fields", "_error")


def rule_test_report(tests: DataFrame, version: str = "rule_version_id") -> DataFrame:
    """Verdict per candidate rule: passed when every sample passes."""
    return tests.groupBy(version).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("ok").alias("passed_samples"), F.bool_and("ok").alias("passed")
    )


def golden_cases(tests: DataFrame, version: str = "rule_version_id") -> DataFrame:
    """Passing samples with what was extracted from them: the rule's regression cases, without secrets as their tests."""
    return tests.filter("ok").select(version, "trace_id", "line", F.col("extracted").alias("expected"))


def golden_regressions(cases: DataFrame, retested: DataFrame, version: str = "rule_version_id") -> DataFrame:
    """Cases per rule, and how many no longer extract what they did."""
    now = retested.select(version, "trace_id", F.col("extracted").alias("_now"))
    joined = cases.join(now, [version, "trace_id"], "left")
    same = F.coalesce(F.col("expected") == F.col("_now"), F.lit(False))
    return joined.groupBy(version).agg(F.count(F.lit(1)).alias("cases"), F.count_if(~same).alias("regressions"))


def find_rules_for_samples(samples: DataFrame, bindings: DataFrame, rules: RuleSet, target_schema: str | None = None) -> DataFrame:
    """Active rule per sample fingerprint, subject to the requested layout."""
    from loglattice.operators.matching import fingerprint_map

    found = lookup_join(samples, fingerprint_map(bindings, rules).drop("_bound_tenant"), "fingerprint").withColumnRenamed("_bound", "rule_version_id")
    return target_schema_compat(found, rules, target_schema)

