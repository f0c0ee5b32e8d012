"""Rule set compiled to columns: prepare once per line, read values, check, annotate.

The steps are separate projections on purpose. Each reads the step before it several times, so
the optimiser keeps them apart and every costly expression runs once per row. What differs
between rules is held in literals picked by a CASE; what is common is written once as a lambda
over the fields, so plan and generated code grow with the number of rules only slightly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.masking import mask_hmac, mask_value, normalize_action
from loglattice.functions.timefmt import normalize_timestamp
from loglattice.functions.typecheck import KNOWN_TYPES, check_type, dateutil_accepts
from loglattice.operators.parsers import parser_for
from loglattice.operators.parsers.registry import absent
from loglattice.operators.rules import Rule
from loglattice.session import settle

# Canonical groups and their fields.
CANONICAL = {
    "source": ["user", "ip", "hostname", "mac_address", "device_type"],
    "network": ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_in", "bytes_out"],
    "security": ["action", "severity", "threat_name", "category"],
}
OPEN_GROUPS = ["normalization", "raw_reference", "processing", "unmapped_fields"]
RESERVED = ["event_id", "event_time", "ingest_time"]
PARSER_ERROR = "ParserError"
POLICIES = {"hash": "mask_hmac_hash", "mask": "mask_redact", "drop": "mask_drop"}

# Every target with a column of its own, in the order of the position literals.
POSITIONED = [f"{group}.{name}" for group, names in CANONICAL.items() for name in names] + RESERVED

VALUES_TYPE = "array<struct<value:string,kind:string,present:boolean>>"
FIELDS_TYPE = "array<struct<target:string,transformation:string,action:boolean,required:boolean,type:string,rank:int>>"
# Rules per CASE projection; more rules go to further projections to keep generated code small.
RULES_PER_STEP = 24


def py_text(value: Column, kind: Column) -> Column:
    """Text of a value as the messages and provenance rows print it."""
    return F.when(kind == "null", "None").when(kind == "bool", F.initcap(value)).otherwise(F.coalesce(value, F.lit("None")))


def how_written(rule: Rule, target: str) -> str:
    """Transformation that a target undergoes under a rule."""
    if "." not in target and target not in RESERVED:
        return "preserve"
    if target == "event_time":
        return "tz_normalize"
    if target in RESERVED:
        return "direct"
    policy = rule.masking_policy.get(target)
    if policy in POLICIES:
        return POLICIES[policy]
    return "action_vocab" if target == "security.action" else "direct"


def is_loose(target: str) -> bool:
    """True for targets that end up among the unmapped fields."""
    if target in POSITIONED:
        return False
    return "." not in target or target.split(".", 1)[0] not in OPEN_GROUPS


def fields_of(rule: Rule) -> Column:
    """Literal description of the targets of a rule."""
    constraints = list(rule.type_constraints)

    def text(value: str | None) -> str:
        return "null" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    cells = [
        f"named_struct('target', {text(t)}, 'transformation', {text(how_written(rule, t))}, 'action', {t == 'security.action'}, "
        f"'required', {t in rule.required_fields}, 'type', cast({text(rule.type_constraints.get(t))} as string), "
        f"'rank', {constraints.index(t) if t in constraints else -1})"
        for t in rule.targets
    ]
    return F.expr(f"cast(array({', '.join(cells)}) as {FIELDS_TYPE})")


def positions_of(rule: Rule) -> Column:
    """Literal positions of the canonical targets among the targets of a rule; -1 for none."""
    return F.expr(f"array({', '.join(str(rule.targets.index(t) if t in rule.targets else -1) for t in POSITIONED)})")


def _dated(values: Column, fields: Column) -> Column:
    """Text of each present ``datetime`` field, null elsewhere."""
    return F.zip_with(values, fields, lambda v, f: F.when((F.lower(f["type"]) == "datetime") & v["present"], py_text(v["value"], v["kind"])))


def _first_bad(batch: pd.Series) -> pd.Series:
    """Position of the first text per row that dateutil refuses, null for none."""
    return pd.Series(
        [next((i for i, text in enumerate(texts) if text is not None and not dateutil_accepts(text)), None) if texts is not None else None
         for texts in batch], dtype="Int32",
    )


class RuleSet:
    """Active rules in evaluation order, with their column expressions."""

    def __init__(self, rules: list[Rule], mask_key: bytes = b"", datetime_mode: str = "native", require_evidence: bool = False):
        self.rules = list(rules)
        self.mask_key = mask_key
        self.datetime_mode = datetime_mode
        self.require_evidence = require_evidence
        self._slots: dict[str, str] = {}
        self._memo: dict[object, object] = {}
        for rule in self.rules:
            self._slots.setdefault(parser_for(rule).share_key(rule), f"_p{len(self._slots)}")

    def once(self, key: object, make: Callable[[], object]) -> object:
        """Columns are built once per rule set: every micro-batch and query reuses them."""
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    # -- prepared columns ------------------------------------------------------

    def slot(self, rule: Rule) -> str:
        return self._slots[parser_for(rule).share_key(rule)]

    @property
    def slots(self) -> list[str]:
        return list(self._slots.values())

    def prepare(self, df: DataFrame, raw: str, gated_by: str | None) -> DataFrame:
        """Add one prepared column per parser family. ``gated_by`` names the column that holds the
        rule version of the row: a family is then evaluated only for rows of its own rules."""
        df = df.withColumns(self.once(("prepare", raw, gated_by), lambda: self._prepared(raw, gated_by)))
        return df.withColumns(self.once("finish", self._finished))

    def _prepared(self, raw: str, gated_by: str | None) -> dict[str, Column]:
        columns = {}
        for name in self.slots:
            members = [r for r in self.rules if self.slot(r) == name]
            text = F.col(raw)
            if gated_by:
                text = F.when(F.col(gated_by).isin([r.rule_version_id for r in members]), text)
            else:
                gates = [self.may_pass(raw, r) for r in members]
                if all(gate is not None for gate in gates):
                    text = F.when(reduce(Column.__or__, gates), text)
            columns[name] = parser_for(members[0]).prepare(text, members[0])
        return columns

    def _finished(self) -> dict[str, Column]:
        parsers = {self.slot(rule): parser_for(rule) for rule in self.rules}
        return {name: parser.finish(F.col(name)) for name, parser in parsers.items() if parser.finish}

    def may_pass(self, raw: str, rule: Rule) -> Column | None:
        """Whether a line holds the text without which the rule accepts none; null where there is no such text.

        Spares the families of a discovery the lines of others. Shell quoting may cut a key, and JSON may escape any character.
        """
        from loglattice.operators.joined import FAMILIES, _refusal, required_literal

        family = FAMILIES.get(rule.parser_type.lower())
        # Key-value lines without any pair still parse.
        if family is None or (family == "kv" and not rule.required_fields) or _refusal(rule) is not None:
            return None
        text, line = required_literal(rule), F.col(raw)
        if not text:
            return None
        gate = F.contains(line, F.lit(text))
        if family == "kv":
            gate = gate | (F.rlike(line, F.lit(r"[\"'\\]")) & F.contains(F.translate(line, "\"'\\", ""), F.lit(text)))
        if family == "json":
            gate = gate | F.contains(line, F.lit("\\"))
        return F.coalesce(gate, F.lit(True))

    def values(self, rule: Rule) -> Column:
        """Array of struct<value, kind, present>, one per target of the rule."""
        return self.once(("values", rule.rule_version_id), lambda: self._values(rule))

    def _values(self, rule: Rule) -> Column:
        parser = parser_for(rule)
        prepared = F.col(self.slot(rule))
        cells = []
        for target in rule.targets:
            options = [parser.value(prepared, rule, key) for key in rule.sources_of(target)]
            cell = options[0] if len(options) == 1 else F.coalesce(
                *[F.when(o["present"], o) for o in reversed(options)], absent()
            )
            cells.append(cell)
        return (F.array(*cells) if cells else F.array()).cast(VALUES_TYPE)

    def parser_error(self, rule: Rule) -> Column:
        return self.once(("error", rule.rule_version_id), lambda: parser_for(rule).error(F.col(self.slot(rule)), rule))

    def violation(self, values: Column, fields: Column, missing_names: Column, rules: list[Rule]) -> Column:
        """Validation error text: required fields first, then types in constraint order; null if none.

        ``missing_names`` is the literal list of required fields of the row's rule; ``rules`` are
        the rules the row may have (only their constraint types are compiled).
        """
        used = {name.lower() for rule in rules for name in rule.type_constraints.values()}
        cells = F.zip_with(values, fields, lambda v, f: F.struct(
            v["value"].alias("value"), v["kind"].alias("kind"), v["present"].alias("present"),
            f["target"].alias("target"), f["type"].alias("type"), f["rank"].alias("rank"),
        ))
        here = F.transform(F.filter(cells, lambda c: c["present"]), lambda c: c["target"])
        gone = F.transform(F.array_except(missing_names, here), lambda n: F.concat(F.lit("'"), n, F.lit("'")))
        missing = F.concat(F.lit("Validation failed: Missing required fields: ["), F.array_join(gone, ", "), F.lit("]"))

        def wrong(c):
            good, kind_name = F, F.lower(c["type"])
            for name in sorted(used.intersection(KNOWN_TYPES)):
                if name != "datetime" or self.datetime_mode == "native":
                    good = good.when(kind_name == name, check_type(c["value"], c["kind"], name))
            if good is F:
                return F.lit(False)
            return c["present"] & c["type"].isNotNull() & ~F.coalesce(good.otherwise(F.lit(True)), F.lit(False))

        def message(c):
            text = F.concat(
                F.lit("Validation failed: Field '"), c["target"], F.lit("' with value '"), py_text(c["value"], c["kind"]),
                F.lit("' does not match type constraint '"), c["type"], F.lit("'"),
            )
            return F.struct(c["rank"].alias("rank"), text.alias("text"))

        bad = F.transform(F.filter(cells, wrong), message)
        return F.when(F.size(gone) > 0, missing).otherwise(F.array_min(bad)["text"])

    def valid(self, values: Column, rule: Rule) -> Column:
        """True where :meth:`violation` finds nothing wrong with the values of a rule; never null."""
        at = {target: F.get(values, F.lit(i)) for i, target in enumerate(rule.targets)}
        good = F.lit(True)
        for name in dict.fromkeys(rule.required_fields):
            good = good & (at[name]["present"] if name in at else F.lit(False))
        for target, kind in rule.type_constraints.items():
            if target in at and kind and kind.lower() in KNOWN_TYPES and (kind.lower() != "datetime" or self.datetime_mode == "native"):
                good = good & (~at[target]["present"] | check_type(at[target]["value"], at[target]["kind"], kind))
        return F.coalesce(good, F.lit(False))

    # -- CASE over the rules ---------------------------------------------------

    def by_rule(self, df: DataFrame, name: str, version: str, make: Callable[[Rule], Column]) -> DataFrame:
        """Add a column that is ``make(rule)`` of the row's rule version, in steps of limited size."""
        for start in range(0, len(self.rules), RULES_PER_STEP):
            case = F
            for rule in self.rules[start : start + RULES_PER_STEP]:
                case = case.when(F.col(version) == rule.rule_version_id, make(rule))
            df = df.withColumn(name, case if start == 0 else F.coalesce(F.col(name), case))
        return df

    def literal_by_rule(self, version: str, attribute: Callable[[Rule], object]) -> Column:
        """CASE of a constant per rule."""
        case = F
        for rule in self.rules:
            value = attribute(rule)
            case = case.when(F.col(version) == rule.rule_version_id, value if isinstance(value, Column) else F.lit(value))
        return case.otherwise(F.lit(None)) if self.rules else F.lit(None)

    # -- whole steps -----------------------------------------------------------

    def parse_and_check(self, df: DataFrame, raw: str, version: str) -> DataFrame:
        """Add ``_values``, ``_fields`` and ``_error`` for the rule version of the row (null: no rule)."""
        if not self.rules:
            return df.selectExpr(
                "*", f"cast(null as {VALUES_TYPE}) AS _values", f"cast(null as {FIELDS_TYPE}) AS _fields", "cast(null as string) AS _error"
            )
        df = self.prepare(df, raw, version)
        df = self.by_rule(df, "_values", version, self.values)
        df = df.withColumns(
            self.once(("rule columns", version), lambda: {
                "_fields": self.literal_by_rule(version, fields_of),
                "_needed": self.literal_by_rule(version, self._required),
                "_parse_error": self.literal_by_rule(version, self.parser_error),
            })
        )
        # Most lines are valid, which is cheap to see; only others need words for what is wrong.
        df = df.withColumn("_error", self.once(("error of row", version), lambda: settle(F.coalesce(
            F.col("_parse_error"),
            F.when(~self._valid(version), self.violation(F.col("_values"), F.col("_fields"), F.col("_needed"), self.rules)),
        ))))
        if self.datetime_mode == "exact":
            df = self._exact_dates(df)
        return df.drop(*self.slots, "_needed", "_parse_error")

    def _valid(self, version: str) -> Column:
        case = F
        for rule in self.rules:
            case = case.when(F.col(version) == rule.rule_version_id, self.valid(F.col("_values"), rule))
        return case.otherwise(F.lit(True))

    @staticmethod
    def _required(rule: Rule) -> Column:
        return (F.array(*[F.lit(n) for n in rule.required_fields]) if rule.required_fields else F.array()).cast("array<string>")

    def _exact_dates(self, df: DataFrame) -> DataFrame:
        """Ask dateutil about ``datetime`` fields of rows without another error."""

        dated = _dated(F.col("_values"), F.col("_fields"))
        bad = F.pandas_udf(_first_bad, "int")(F.when(F.col("_error").isNull() & F.exists("_fields", lambda f: F.lower(f["type"]) == "datetime"), dated))
        df = df.withColumn("_bad", bad)
        cell = F.get("_values", F.col("_bad"))
        text = F.concat(
            F.lit("Validation failed: Field '"), F.get("_fields", F.col("_bad"))["target"], F.lit("' with value '"),
            py_text(cell["value"], cell["kind"]), F.lit("' does not match type constraint '"), F.get("_fields", F.col("_bad"))["type"], F.lit("'"),
        )
        return df.withColumn("_error", F.coalesce(F.col("_error"), F.when(F.col("_bad").isNotNull(), text))).drop("_bad")

    def first_passing(self, df: DataFrame, raw: str, tenant: str | None, out: str = "_candidate") -> DataFrame:
        """Add the version of the first rule, in catalogue order, that parses and validates the line."""
        before = df.columns
        if not self.rules:
            return df.withColumn(out, F.lit(None).cast("string"))
        df = self.prepare(df, raw, None).withColumns(
            self.once(("candidate values", raw), lambda: {
                f"_v{i}": F.when(self._may_parse(raw, rule), self.values(rule)) for i, rule in enumerate(self.rules)
            })
        )
        if self.datetime_mode == "exact":
            df = self._exact_candidates(df)
        return df.select(*before, self.once(("first passing", tenant), lambda: self._first_of(tenant)).alias(out))

    def _may_parse(self, raw: str, rule: Rule) -> Column:
        gate, parses = self.may_pass(raw, rule), self.parser_error(rule).isNull()
        return parses if gate is None else gate & parses

    def _exact_candidates(self, df: DataFrame) -> DataFrame:
        """Candidate values of rules with ``datetime`` fields go where dateutil refuses one of them.

        One Arrow pass for all rules.
        """
        dated = [i for i, rule in enumerate(self.rules) if "datetime" in {t.lower() for t in rule.type_constraints.values()}]
        if not dated:
            return df
        df = df.withColumns({
            f"_b{i}": F.pandas_udf(_first_bad, "int")(_dated(F.col(f"_v{i}"), fields_of(self.rules[i]))) for i in dated
        })
        return df.withColumns({f"_v{i}": F.when(F.col(f"_b{i}").isNull(), F.col(f"_v{i}")) for i in dated})

    def _first_of(self, tenant: str | None) -> Column:
        passes = []
        for i, rule in enumerate(self.rules):
            cells = F.col(f"_v{i}")
            good = cells.isNotNull() & self.valid(cells, rule)
            if tenant:
                good = good & (F.col(tenant) == rule.tenant_id)
            if self.require_evidence and not rule.required_fields:
                good = good & F.exists(cells, lambda c: c["present"])
            passes.append(F.when(good, F.lit(rule.rule_version_id)))
        return settle(F.coalesce(*passes))

    # -- what a rule says about the rows it is given, overridden where rules are joined rows --------

    def first_passes(self, unmatched: DataFrame, raw: str, order: str, tenant: str | None) -> DataFrame:
        """Per fingerprint: the first line that any rule accepts, and the first such rule."""
        tried = self.first_passing(unmatched, raw, tenant, "_candidate")
        passed = tried.filter(F.col("_candidate").isNotNull())
        # Rule numbers instead of id text keep the aggregate buffer fixed-width, hence hash-based.
        number = F
        for i, rule in enumerate(self.rules):
            number = number.when(F.col("_candidate") == rule.rule_version_id, i)
        found = passed.select("fingerprint", order, number.alias("_number")).groupBy("fingerprint").agg(
            F.min(order).alias("_first"), F.min_by("_number", order).alias("_number")
        )
        versions = F.array(*[F.lit(rule.rule_version_id) for rule in self.rules])
        return found.select("fingerprint", "_first", F.get(versions, F.col("_number")).alias("_discovered"))

    def known_bindings(self, bindings: DataFrame) -> DataFrame:
        """Bindings of rules in this set."""
        return bindings.filter(F.col("rule_id").isin([rule.rule_id for rule in self.rules]))

    def bound_versions(self, chosen: DataFrame) -> DataFrame:
        """``fingerprint``, ``_bound`` and ``_bound_tenant`` for rows of ``fingerprint`` and ``_rule_id``."""
        version, tenant = F, F
        for rule in self.rules:
            version = version.when(F.col("_rule_id") == rule.rule_id, rule.rule_version_id)
            tenant = tenant.when(F.col("_rule_id") == rule.rule_id, rule.tenant_id)
        if not self.rules:
            return chosen.select("fingerprint", F.lit(None).cast("string").alias("_bound"), F.lit(None).cast("string").alias("_bound_tenant"))
        return chosen.select("fingerprint", version.otherwise(None).alias("_bound"), tenant.otherwise(None).alias("_bound_tenant"))

    def add_rule_ids(self, df: DataFrame, version: str, out: str = "rule_id") -> DataFrame:
        return df.withColumn(out, self.literal_by_rule(version, lambda rule: rule.rule_id))

    def rule_columns(self, version: str, columns: dict[str, Callable[[Rule], object]]) -> dict[str, Column]:
        return {name: self.literal_by_rule(version, get) for name, get in columns.items()}

    def positions(self, version: str) -> Column:
        return self.literal_by_rule(version, positions_of).cast("array<int>")

    def is_loose_cell(self, target: Column) -> Column:
        loose = sorted({t for rule in self.rules for t in rule.targets if is_loose(t)})
        return target.isin(loose) if loose else F.lit(False)

    def annotate(self, df: DataFrame, version: str, namespace: str) -> DataFrame:
        """Add ``_entries``: one annotated cell per target, for rows with a rule and no error."""
        return df.withColumns(self.once(("annotate", version, namespace), lambda: self._annotated(version, namespace)))

    def _annotated(self, version: str, namespace: str) -> dict[str, Column]:
        ns, key = F.col(namespace), self.mask_key

        def cell(v, f):
            shown = py_text(v["value"], v["kind"])
            how = f["transformation"]
            text = F.when(f["action"], normalize_action(shown)).otherwise(shown)
            out = (
                F.when(how == "tz_normalize", normalize_timestamp(shown))
                .when(how == "action_vocab", text)
                .when(how == "mask_hmac_hash", mask_hmac(text, key))
                .when(how == "mask_redact", mask_value(text, "mask", key))
                .when(how == "mask_drop", F.lit(None))
                .when(f["target"].isin(RESERVED), shown)
                .otherwise(v["value"])
            )
            kept = how.isin("direct", "preserve") & ~f["target"].isin(RESERVED)
            loose_name = F.concat(F.lit("unmapped_fields."), ns, F.lit("."), f["target"])
            return F.struct(
                F.when(how == "preserve", loose_name).otherwise(f["target"]).alias("field"),
                f["target"].alias("target"),
                shown.alias("value"),
                v["present"].alias("present"),
                how.alias("transformation"),
                F.when(how == "preserve", "unmapped").otherwise("deterministic").alias("decision"),
                F.when(v["present"], out).alias("out"),
                F.when(kept, v["kind"]).otherwise("str").alias("out_kind"),
            )

        entries = F.zip_with("_values", "_fields", cell)
        ok = F.col(version).isNotNull() & F.col("_error").isNull()
        return {"_entries": F.when(ok, entries), "_at": self.positions(version)}


def entry_at(target: str) -> Column:
    """Entry of a canonical target in the row, null when its rule does not map it."""
    return F.get(F.col("_entries"), F.get(F.col("_at"), F.lit(POSITIONED.index(target))))
