"""Normalisation: canonical columns, unmapped fields, target documents, provenance, outcomes."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.ids import event_id_for
from loglattice.operators.engine import CANONICAL, PARSER_ERROR, POSITIONED, RuleSet, entry_at

# Labels of the target layouts and of the processing paths.
CORE_LABEL = "core-1.0"
OCSF_VERSION, OCSF_LABEL = "1.1.0", "ocsf-1.1.0"
ECS_VERSION, ECS_LABEL = "8.11.0", "ecs-8.11.0"
FAST_PATH, ONBOARDING_PATH, UNRESOLVED_PATH = "fast_path", "onboarding", "unresolved"
STAGE_PARSER_FAILED, STAGE_VALIDATION_FAILED, VALUE_ERROR = "parser_failed", "validation_failed", "ValueError"
STAGE_UNEXPECTED = "unexpected_error"
DIAGNOSTIC_CHARS = 500
DEFAULT_NAMESPACE = "vendor"


def vendor_namespace(namespace: Column, vendor: Column) -> Column:
    """Namespace, else vendor, else a constant; empty text counts as missing."""
    return F.coalesce(F.nullif(namespace, F.lit("")), F.nullif(vendor, F.lit("")), F.lit(DEFAULT_NAMESPACE))


# --- JSON text ----------------------------------------------------------------


def quoted(text: Column) -> Column:
    """JSON string of a text, null as JSON null."""
    body = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(body, F.lit(2), F.char_length(body) - 2))


def json_value(text: Column, kind: Column) -> Column:
    """JSON text of a value that keeps its kind."""
    return F.when(text.isNull(), F.lit("null")).when(kind.isin("num", "bool", "json"), text).otherwise(quoted(text))


def json_object(members: list[tuple[str, Column]]) -> Column:
    """JSON object with fixed member names."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(members):
        parts += [F.lit(f'{"," if i else ""}"{name}":'), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _members_json(cells: Column, name) -> Column:
    """Comma-joined ``"key":value`` members of an array of cells."""
    return F.array_join(
        F.transform(cells, lambda c: F.concat(quoted(name(c)), F.lit(":"), json_value(c["out"], c["out_kind"]))), ","
    )


# --- steps ----------------------------------------------------------------------


def _written(entries: Column) -> Column:
    """Cells that reach the document: present and not dropped by policy."""
    return F.filter(entries, lambda e: e["present"] & (e["transformation"] != "mask_drop"))


def _group_of(target: Column) -> Column:
    return F.substring_index(target, ".", 1)


def _field_of(target: Column) -> Column:
    return F.substr(target, F.char_length(_group_of(target)) + 2)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Typed canonical columns, each read from the fixed position of its target in the row's rule."""
    return df.withColumns(_canonical())


@cache
def _canonical() -> dict[str, Column]:
    groups = {
        group: F.struct(*[entry_at(f"{group}.{name}")["out"].alias(name) for name in names]) for group, names in CANONICAL.items()
    }
    return {
            **groups,
            "event_time": F.coalesce(entry_at("event_time")["out"], F.lit("")),
            "ingest_time": F.coalesce(entry_at("ingest_time")["out"], F.lit("")),
            "doc_event_id": F.coalesce(entry_at("event_id")["out"], F.col("trace_id")),
            "_json": F.transform("_entries", lambda e: json_value(e["out"], e["out_kind"])),
    }


def unmapped_column(df: DataFrame, rules: RuleSet, namespace: str = "namespace") -> DataFrame:
    """``unmapped_fields``: namespace or unknown group to key to value; plus ``_loose`` for JSON text."""
    columns = rules.once(("loose", namespace), lambda: _loose_columns(rules, namespace))
    for name, column in columns.items():
        df = df.withColumn(name, column)
    return df


def _loose_columns(rules: RuleSet, namespace: str) -> dict[str, Column]:
    def cell(e):
        dotless = ~F.contains(e["target"], F.lit("."))
        return F.struct(
            F.when(dotless, F.col(namespace)).otherwise(_group_of(e["target"])).alias("group"),
            F.when(dotless, e["target"]).otherwise(_field_of(e["target"])).alias("key"),
            e["out"].alias("out"), e["out_kind"].alias("out_kind"),
        )

    chosen = F.filter(_written(F.col("_entries")), lambda e: rules.is_loose_cell(e["target"]))
    loose = F.transform(chosen, cell)
    groups = F.array_distinct(F.transform(F.col("_loose"), lambda c: c["group"]))

    def inner(group):
        mine = F.filter(F.col("_loose"), lambda c: c["group"] == group)
        keys = F.array_distinct(F.transform(mine, lambda c: c["key"]))
        last = F.transform(keys, lambda k: F.element_at(F.filter(mine, lambda c: c["key"] == k), -1)["out"])
        return F.map_from_arrays(keys, last)

    return {"_loose": loose, "unmapped_fields": F.map_from_arrays(groups, F.transform(groups, inner))}


@cache
def _unmapped_json() -> Column:
    groups = F.array_distinct(F.transform(F.col("_loose"), lambda c: c["group"]))

    def one(group):
        mine = F.filter(F.col("_loose"), lambda c: c["group"] == group)
        return F.concat(quoted(group), F.lit(":{"), _members_json(mine, lambda c: c["key"]), F.lit("}"))

    return F.concat(F.lit("{"), F.array_join(F.transform(groups, one), ","), F.lit("}"))


def _open_json(group: str, fixed: list[tuple[str, Column]]) -> Column:
    """Open dict groups: fixed members first, then whatever a rule mapped into the group."""
    extra = F.filter(
        _written(F.col("_entries")), lambda e: F.startswith(e["target"], F.lit(group + "."))
    )
    more = _members_json(extra, lambda e: _field_of(e["target"]))
    head = [F.concat(F.lit(f'"{name}":'), value) for name, value in fixed]
    parts = F.array(*head, F.when(more != "", more))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ","), F.lit("}"))


def _cell_json(target: str) -> Column:
    return F.coalesce(F.get(F.col("_json"), F.get(F.col("_at"), F.lit(POSITIONED.index(target)))), F.lit("null"))


def _group_json(group: str) -> Column:
    return json_object([(name, _cell_json(f"{group}.{name}")) for name in CANONICAL[group]])


@cache
def _raw_reference_json() -> Column:
    return json_object(
        [("trace_id", quoted(F.col("trace_id"))), ("digest", quoted(F.col("digest"))), ("byte_length", F.col("byte_length").cast("string"))]
    )


@cache
def core_event() -> Column:
    """Core document as JSON text."""
    return json_object(
        [
            ("event_id", quoted(F.col("doc_event_id"))),
            ("event_time", quoted(F.col("event_time"))),
            ("ingest_time", quoted(F.col("ingest_time"))),
            *[(group, _group_json(group)) for group in CANONICAL],
            ("normalization", _open_json("normalization", [("schema", F.lit(f'"{CORE_LABEL}"'))])),
            ("raw_reference", _raw_reference_json()),
            ("processing", _open_json("processing", [])),
            ("unmapped_fields", _unmapped_json()),
        ]
    )


@cache
def to_ocsf() -> Column:
    """OCSF document as JSON text."""
    return json_object(
        [
            ("metadata", json_object([("version", F.lit(f'"{OCSF_VERSION}"')), ("uid", quoted(F.col("doc_event_id")))])),
            ("time", quoted(F.col("event_time"))),
            ("observables", F.lit("[]")),
            ("src_endpoint", json_object([("ip", _cell_json("source.ip"))])),
            ("action", _cell_json("security.action")),
            ("user", json_object([("name", _cell_json("source.user"))])),
            ("unmapped", _unmapped_json()),
            ("raw_data", _raw_reference_json()),
            ("normalization", F.lit('{"schema":"' + OCSF_LABEL + '"}')),
        ]
    )


@cache
def to_ecs() -> Column:
    """ECS document as JSON text."""
    return json_object(
        [
            ("ecs", F.lit('{"version":"' + ECS_VERSION + '"}')),
            ("event", json_object([
                ("id", quoted(F.col("doc_event_id"))),
                ("created", quoted(F.col("event_time"))),
                ("action", _cell_json("security.action")),
            ])),
            ("source", json_object([("ip", _cell_json("source.ip"))])),
            ("user", json_object([("name", _cell_json("source.user"))])),
            ("_unmapped", _unmapped_json()),
            ("_raw_reference", _raw_reference_json()),
            ("normalization", F.lit('{"schema":"' + ECS_LABEL + '"}')),
        ]
    )


@cache
def select_target_schema(target_schema: str) -> Column:
    """Document in the layout the rule asks for; anything but ocsf and ecs is core."""
    layout = F.col(target_schema)
    return F.when(layout == "ocsf", to_ocsf()).when(layout == "ecs", to_ecs()).otherwise(core_event())


RULE_COLUMNS = {
    "rule_id": lambda rule: rule.rule_id,
    "rule_version": lambda rule: rule.version,
    "rule_hash": lambda rule: rule.rule_hash,
    "rule_schema_version": lambda rule: rule.schema_version,
    "target_schema": lambda rule: rule.target_schema,
}


def stamp_trace(df: DataFrame, rules: RuleSet, version: str = "rule_version_id") -> DataFrame:
    """Rule id, version, hash and schema version of the rule that handled the row."""
    return df.withColumns(rules.once(("stamp", version), lambda: rules.rule_columns(version, RULE_COLUMNS)))


def normalize(df: DataFrame, rules: RuleSet, path: str = FAST_PATH) -> DataFrame:
    """From parsed rows (``_values``, ``_error``) to one wide outcome row per event."""
    df = stamp_trace(df, rules)
    df = rules.annotate(df, "rule_version_id", "namespace")
    df = canonical_columns(df)
    df = unmapped_column(df, rules)
    outcome = (
        F.when(F.col("rule_version_id").isNull(), "unresolved").when(F.col("_error").isNull(), "normalized").otherwise("dead_letter")
    )
    return df.withColumns(
        {
            "outcome": outcome,
            "processing_path": F.when(outcome == "normalized", path).when(outcome == "unresolved", UNRESOLVED_PATH),
            "event_id": event_id_for(F.col("trace_id"), path),
            "raw_reference": F.struct("trace_id", "digest", "byte_length"),
            "payload_json": F.when(outcome == "normalized", select_target_schema("target_schema")),
            "diagnostic": F.substring(F.col("_error"), 1, DIAGNOSTIC_CHARS),
            "processed_at": F.localtimestamp(),
        }
    ).drop("_rule")


# --- outcome tables -----------------------------------------------------------------


def _of(processed: DataFrame, names: list[str]) -> list[Column]:
    """Columns that the table has, under their names in the outcome tables; a table made for some reports may lack others."""
    renamed = {"rule_schema_version": "schema_version", "received_at": "created_at"}
    return [F.col(name).alias(renamed.get(name, name)) for name in names if name in processed.columns]


def normalized_events(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("outcome") == "normalized").select(*_of(processed, [
        "event_id", "trace_id", "source_id", "rule_schema_version", "rule_id", "rule_version",
        "processing_path", "job_id", "session_id", "received_at", "event_time",
        "source", "network", "security", "unmapped_fields", "raw_reference", "payload_json", "processed_at",
    ]))


def provenance(processed: DataFrame, keep_clear_values: bool = False) -> DataFrame:
    """One row per present field. Hashed and masked fields show the masked value unless asked not to."""
    e = F.col("e")
    rows = processed.filter(F.col("outcome") == "normalized").select(
        "trace_id", "received_at", "processed_at", F.explode(F.filter(F.col("_entries"), lambda x: x["present"])).alias("e")
    )
    masked = F.when(e["transformation"] == "mask_drop", F.lit("***"))
    if not keep_clear_values:
        masked = masked.when(e["transformation"].isin("mask_hmac_hash", "mask_redact"), e["out"])
    return rows.select(
        "trace_id",
        e["field"].alias("target_field"),
        e["target"].alias("source_field"),
        masked.otherwise(e["value"]).alias("source_value"),
        e["transformation"].alias("transformation"),
        F.lit(None).cast("double").alias("confidence"),
        e["decision"].alias("decision"),
        F.col("received_at").alias("created_at"),
        "processed_at",
    )


def provenance_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest row per (trace, target field) by arrival, then by processing; at equal times the new one wins over the old."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    key = ["trace_id", "target_field"]
    rest = [c for c in both.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", *[c for c in ("processed_at",) if c in rest], "_turn")).alias("n")
    return both.groupBy(*key).agg(newest).select(*key, *[F.col("n")[c].alias(c) for c in rest]).select(*old.columns)


def traces(processed: DataFrame) -> DataFrame:
    """Event to rule id, version, hash and schema version; empty for unresolved and failed events."""
    ok = F.col("outcome") == "normalized"
    return processed.select(
        "trace_id", "source_id", "received_at",
        F.when(ok, F.col("rule_id")).alias("rule_id"), F.when(ok, F.col("rule_version")).alias("rule_version"),
        F.when(ok, F.col("rule_hash")).alias("rule_hash"), F.when(ok, F.col("rule_schema_version")).alias("schema_version"),
    )


# How the texts of faulty rules begin; other failures are parser errors.
RULE_FAULTS = ("Unsupported parser type: ", "Unsafe regex pattern: ", "Rule definition is too large", "Unsupported JSON path: ")


def dead_letters(processed: DataFrame) -> DataFrame:
    """Failed events with stage and error class: a faulty rule fails validation, a bad line fails its parser."""
    faulty = F.lit(False)
    for start in RULE_FAULTS:
        faulty = faulty | F.startswith(F.col("diagnostic"), F.lit(start))
    stage = F.when(faulty, STAGE_VALIDATION_FAILED).otherwise(STAGE_PARSER_FAILED)
    error_class = F.when(faulty, VALUE_ERROR).otherwise(PARSER_ERROR)
    unknown = F.concat(F.lit("vault://"), F.col("source_id"), F.lit("/unknown/"), F.col("trace_id"), F.lit(".raw"))
    uri = F.col("storage_uri") if "storage_uri" in processed.columns else F.lit(None)
    return processed.filter(F.col("outcome") == "dead_letter").select(
        "trace_id", "source_id", stage.alias("stage"), error_class.alias("error_class"),
        "diagnostic", F.coalesce(uri, unknown).alias("raw_reference"), F.col("received_at").alias("created_at"), "job_id", "session_id",
    )


def first_dead_letters(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New dead letters of traces that have none yet, one per trace: the first stands for all later attempts."""
    once = new.groupBy("trace_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "trace_id"]), F.struct("created_at", "stage", "diagnostic")).alias("r"))
    return once.select("trace_id", "r.*").select(*new.columns).join(stored.select("trace_id"), "trace_id", "left_anti").select(*new.columns)


def unexpected_errors(events: DataFrame, error_class: str, diagnostic: str) -> DataFrame:
    """Dead letters of events whose whole step failed in a way no rule explains (stage ``unexpected_error``)."""
    unknown = F.concat(F.lit("vault://"), F.col("source_id"), F.lit("/unknown/"), F.col("trace_id"), F.lit(".raw"))
    uri = F.col("storage_uri") if "storage_uri" in events.columns else F.lit(None)
    return events.select(
        "trace_id", "source_id", F.lit(STAGE_UNEXPECTED).alias("stage"), F.lit(error_class).alias("error_class"), F.lit(diagnostic[:DIAGNOSTIC_CHARS]).alias("diagnostic"),
        F.coalesce(uri, unknown).alias("raw_reference"), F.col("received_at").alias("created_at"), "job_id", "session_id",
    )


def unresolved(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("outcome") == "unresolved").select(
        event_id_for(F.col("trace_id"), UNRESOLVED_PATH).alias("id"),
        *_of(processed, ["trace_id", "fingerprint", "source_id", "received_at", "job_id", "session_id"]),
    )


def search_documents(processed: DataFrame) -> DataFrame:
    """Search documents: the payload plus envelope members, keyed by trace id. Of several the last arrived, then last processed stays."""
    from loglattice.functions.timefmt import to_ist_iso

    done = processed.filter(F.col("outcome") == "normalized")
    tail = F.concat(
        F.lit(',"trace_id":'), quoted(F.col("trace_id")), F.lit(',"source_id":'), quoted(F.col("source_id")),
        F.lit(',"processing_path":'), quoted(F.col("processing_path")),
        F.lit(',"@timestamp":'), quoted(to_ist_iso(F.col("received_at"))), F.lit("}"),
    )
    body = F.substr(F.col("payload_json"), F.lit(1), F.char_length(F.col("payload_json")) - 1)
    docs = done.select("trace_id", F.struct("received_at", "processed_at", F.concat(body, tail).alias("document")).alias("version"))
    return docs.groupBy("trace_id").agg(F.max("version").alias("version")).select("trace_id", "version.document")
