"""Rules as joined rows: one plan for any number of rules.

:class:`RuleSet` compiles every rule to columns, so its plan grows with the rules. Here a rule is a row of
a small table with its family, pattern or delimiters, mapped fields and checks; events meet it by a
join on the rule version, and one expression per parser family reads what to do from the row. Discovery
asks an index over the literals that lines of a rule must contain for candidates per line, and parses only
the (line, candidate) pairs. Results are those of :class:`RuleSet`.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp

import ahocorasick
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators.engine import FIELDS_TYPE, POSITIONED, VALUES_TYPE, RuleSet, how_written, is_loose
from loglattice.operators.parsers import cef, jsonpath, keyvalue, leef, xmlpath
from loglattice.operators.parsers import regex as rx
from loglattice.operators.parsers.registry import absent, found, last_first, let, parser_for, strip, value_at
from loglattice.operators.regexsafety import MAX_LOOPS, chained_loops
from loglattice.operators.rules import Rule
from loglattice.session import lookup_join, settle

# Up to this many rules one plan with a branch per rule is the faster form.
COLUMN_RULES = 48
FAMILIES = {"keyvalue": "kv", "kv": "kv", "cef": "cef", "leef": "leef", "xml": "xml", "jsonpath": "json", "regex": "regex"}
SOURCES_TYPE = "array<array<struct<key:string,number:int,optional:boolean,path:string,slot:int>>>"
# Families whose parsing is the same for all rules: column, parser, and a text that every line of theirs holds.
WHOLE = {"cef": ("cef", cef.cef_pairs, "CEF:"), "leef": ("leef", leef.leef_pairs, "LEEF:"), "xml": ("xml", xmlpath.xml_pairs, "<"), "json": ("doc", F.try_parse_json, "")}
ROW_SCHEMA = (
    "version string, number int, family string, refusal string, delimiter string, separator string, whole string, body string, template string, "
    f"groups int, linear string, wild array<string>, sources {SOURCES_TYPE}, fields {FIELDS_TYPE}, needed array<string>, at array<int>, loose array<string>, "
    "has_required boolean, tenant string, rule_id string, rule_version int, rule_hash string, rule_schema_version string, target_schema string"
)


def compile_rules(rules: list[Rule], spark: SparkSession, mask_key: bytes = b"", **options) -> RuleSet:
    """The form that suits the number of rules; parser types without a joined form keep a branch of their own."""
    joinable = all(r.parser_type.lower() in FAMILIES or parser_for(r).share_key(r) == "refused" for r in rules)
    if len(rules) <= COLUMN_RULES or not joinable:
        return RuleSet(rules, mask_key, **options)
    return JoinedRules(rules, spark, mask_key, **options)


def _refusal(rule: Rule) -> str | None:
    """Why no line of the rule can be parsed."""
    family = FAMILIES.get(rule.parser_type.lower())
    if rule.defect or family is None:
        return rule.defect or f"Unsupported parser type: {rule.parser_type}"
    if family == "regex":
        return rx._broken(rule)
    if family == "json":
        unknown = sorted({p for p in rule.parser_definition.get("paths", {}).values() if p and not jsonpath.is_simple(p) and jsonpath.steps_of(p) is None})
        return jsonpath.BAD_PATH + unknown[0] if unknown else None
    return None


def _source(rule: Rule, family: str, key: str, refused: bool) -> tuple:
    """Where a source key is read: (key, group number, may be left out, JSON path, slot among wildcard paths)."""
    number = optional = path = slot = None
    if family == "regex" and not refused:
        number, optional = rx.group_of(rule.parser_definition["pattern"], key)
    if family == "json" and not refused:
        text = rule.parser_definition.get("paths", {}).get(key)
        if text and jsonpath.is_simple(text):
            path = jsonpath.full_path(text)
        elif text:
            slot = jsonpath._complex_paths(rule).index(text)
    return key, number, optional, path, slot


def rule_row(rule: Rule, number: int) -> tuple:
    family, refusal = FAMILIES.get(rule.parser_type.lower(), "none"), _refusal(rule)
    refused = refusal is not None
    delimiter, separator = keyvalue._settings(rule) if family == "kv" else (None, None)
    whole = body = template = linear = groups = None
    if family == "regex" and not refused:
        pattern = rule.parser_definition["pattern"]
        groups = rx.java_pattern(pattern)[2]
        if chained_loops(pattern) > MAX_LOOPS:
            linear = rx.linear_pattern(pattern)
        else:
            body = "(?d)" + rx.java_pattern(pattern)[0]
            whole, template = rx.whole_line(pattern)
    constraints = list(rule.type_constraints)
    fields = [
        (t, how_written(rule, t), t == "security.action", t in rule.required_fields, rule.type_constraints.get(t), constraints.index(t) if t in constraints else -1)
        for t in rule.targets
    ]
    # The last of several sources that is there counts, so it comes first.
    sources = [[_source(rule, family, key, refused) for key in reversed(rule.sources_of(t))] for t in rule.targets]
    wild = jsonpath._complex_paths(rule) if family == "json" and not refused else []
    return (
        rule.rule_version_id, number, family, refusal, delimiter, separator, whole, body, template, groups, linear, wild, sources, fields, list(rule.required_fields),
        [rule.targets.index(t) if t in rule.targets else -1 for t in POSITIONED], [t for t in rule.targets if is_loose(t)],
        bool(rule.required_fields), rule.tenant_id, rule.rule_id, rule.version, rule.rule_hash, rule.schema_version, rule.target_schema,
    )


# --- literals that a passing line must contain ---------------------------------------------------

def _pattern_literal(pattern: str) -> str:
    """Longest run of characters that every match holds."""
    try:
        tree = rp.parse(pattern)
    except (re.error, OverflowError):
        return ""
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs, run = [""], ""

    def walk(part) -> None:
        nonlocal run
        for op, value in part:
            if op is rc.LITERAL:
                run += chr(value)
            elif op is rc.SUBPATTERN and not value[1]:
                walk(value[-1])
            elif op is not rc.AT:
                runs.append(run)
                run = ""
                if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] > 0:
                    walk(value[2])
                    runs.append(run)
                    run = ""

    walk(tree)
    return max([*runs, run], key=len)


def required_literal(rule: Rule) -> str:
    """A text that every line holds which the rule accepts; empty where none is known."""
    family = FAMILIES.get(rule.parser_type.lower())
    if family == "regex":
        return _pattern_literal(rule.parser_definition.get("pattern") or "")
    literals = [{"cef": "CEF:", "leef": "LEEF:", "xml": "<", "kv": rule.parser_definition.get("kv_separator", "=")}.get(family, "")]
    for target in rule.required_fields:
        keys = rule.sources_of(target)
        if len(keys) != 1:
            continue
        if family == "kv" and not re.search(r"[\"'\\]", keys[0]):
            literals.append(keys[0])
        elif family == "cef" and keys[0] not in cef.HEADER:
            literals.append(keys[0] + "=")
        elif family == "leef" and keys[0] not in leef.HEADER:
            literals.append(keys[0])
        elif family == "xml" and "{" not in keys[0]:
            literals.append(keys[0].rsplit("/", 1)[-1].lstrip("@"))
        elif family == "json":
            path = rule.parser_definition.get("paths", {}).get(keys[0])
            names = re.findall(r"\.([^.\[\]]+)", jsonpath.full_path(path)) if path and jsonpath.is_simple(path) else []
            literals += [n for n in names if n.isascii() and n.isprintable() and not re.search(r'["\\/]', n)]
    return max(reversed(literals), key=len)


class LiteralIndex:
    """Candidate rules of a line: one pass of a multi-pattern automaton over all required literals."""

    def __init__(self, rules: list[Rule]):
        by_literal: dict[str, list[int]] = {}
        for number, rule in enumerate(rules):
            if _refusal(rule) is None:
                by_literal.setdefault(required_literal(rule), []).append(number)
        self.always = by_literal.pop("", [])
        self.by_literal = by_literal
        # JSON may write any character as an escape, so names prove nothing in lines with a backslash.
        self.json = [n for n, r in enumerate(rules) if FAMILIES.get(r.parser_type.lower()) == "json" and _refusal(r) is None]

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.by_literal:
            return None
        automaton = ahocorasick.Automaton()
        for literal, numbers in self.by_literal.items():
            automaton.add_word(literal, numbers)
        automaton.make_automaton()
        return automaton

    def column(self, raw: Column) -> Column:
        """Numbers of the candidates, ascending; a line without any gets an empty list."""
        index = self
        bare = str.maketrans("", "", "\"'\\")  # shell quoting may cut a key
        made: list = []

        def candidates(lines: pd.Series) -> pd.Series:
            if not made:
                made.append(index.automaton())
            return lines.map(one)

        def one(line: str | None) -> list[int] | None:
            if line is None:
                return None
            found = set(index.always)
            for text in {line, line.translate(bare)} if made[0] else ():
                for _, numbers in made[0].iter(text):
                    found.update(numbers)
            if "\\" in line:
                found.update(index.json)
            return sorted(found)

        return F.pandas_udf(candidates, "array<int>")(raw)


# --- one expression per family -------------------------------------------------------------------

def _linear_groups(lines: pd.Series, patterns: pd.Series) -> pd.Series:
    """Groups by the automaton-based matcher, for all lines of one pattern at a time."""
    out = pd.Series([None] * len(lines), dtype=object)
    for pattern in patterns.dropna().unique():
        at = (patterns == pattern) & lines.notna()
        hits = pc.extract_regex(pa.array(lines[at], pa.string()), pattern)
        names = range(1, hits.type.num_fields)
        rows = [None if hit is None else ["", *[hit[f"g{g}"] for g in names]] for hit in hits.to_pylist()]
        out[at] = pd.Series(rows, index=lines.index[at], dtype=object)
    return out


def _wildcard_hits(lines: pd.Series, paths: pd.Series) -> pd.Series:
    out = []
    for line, wanted in zip(lines, paths):
        out.append(jsonpath.first_hits(line, list(wanted)) if line is not None and wanted is not None else None)
    return pd.Series(out, dtype=object)


def _pairs_between(tokens: Column, separator: Column) -> Column:
    """As the literal form: tokens that hold the separator, cut at its first place, keys trimmed and values unquoted."""

    def one(token):
        at = F.position(separator, token)
        key, value = F.substr(token, F.lit(1), at - 1), F.substr(token, at + F.char_length(separator))
        return F.struct(strip(key).alias("k"), strip(value, keyvalue.QUOTE_STRIP).alias("v"))

    return F.transform(F.filter(tokens, lambda t: F.contains(t, separator)), one)


class JoinedRules(RuleSet):
    """A rule set of any size, read from a joined row."""

    def __init__(self, rules: list[Rule], spark: SparkSession, mask_key: bytes = b"", datetime_mode: str = "native", require_evidence: bool = False):
        self.rules, self.mask_key, self.datetime_mode, self.require_evidence = list(rules), mask_key, datetime_mode, require_evidence
        self._slots, self._memo = {}, {}
        self.table = spark.createDataFrame([rule_row(rule, i) for i, rule in enumerate(self.rules)], ROW_SCHEMA)
        self.index = LiteralIndex(self.rules)

    def _with_rule(self, df: DataFrame, on: str, key: str) -> DataFrame:
        """Add the rule's row as ``_rule``."""
        return lookup_join(df, self.table.select(F.col(key).alias(on), F.struct("*").alias("_rule")), on)

    def parse_and_check(self, df: DataFrame, raw: str, version: str) -> DataFrame:
        return self._parsed(self._with_rule(df, version, "version"), raw)

    def _parsed(self, df: DataFrame, raw: str, whole: bool = False) -> DataFrame:
        """Values and errors of rows with their rule; ``whole`` where :meth:`_whole` has parsed the lines already."""
        rule, line = F.col("_rule"), F.col(raw)
        open_, family = rule["refusal"].isNull(), rule["family"]

        def of(name: str, more: Column | None = None) -> Column:
            wanted = open_ & (family == name)
            return F.when(wanted if more is None else wanted & more, line)

        kv = of("kv")
        quoted = (rule["delimiter"] == " ") & (rule["separator"] == "=")
        split = _pairs_between(leef.split_literal(kv, rule["delimiter"]), rule["separator"])
        fast = F.regexp_replace(of("regex"), rule["whole"], rule["template"])
        marked = F.when(F.contains(line, F.lit(rx._MARK)), F.when(F.rlike(of("regex"), rule["body"]), F.transform(
            F.sequence(F.lit(0), rule["groups"]), lambda g: F.when(g == 0, F.lit("")).otherwise(F.call_function("regexp_extract", line, rule["body"], g)))))
        slow = F.pandas_udf(_linear_groups, "array<string>")(of("regex", rule["linear"].isNotNull()), rule["linear"])
        df = df.withColumns({
            "_kv": F.when(quoted, keyvalue.kv_quoted(kv)).otherwise(split), "_fast": fast, "_marked": marked, "_slow": slow,
            **{f"_{name}": F.when(open_ & (family == kind), F.col(f"_{name}")) if whole else parse(of(kind)) for kind, (name, parse, _) in WHOLE.items()},
            "_hits": F.pandas_udf(_wildcard_hits, "array<string>")(of("json", F.size(rule["wild"]) > 0), rule["wild"]),
        })
        picked = F.when(F.contains(line, F.lit(rx._MARK)), F.col("_marked")).otherwise(F.when(F.rlike("_fast", F.lit("^" + rx._MARK)), F.split("_fast", rx._MARK)))
        df = df.withColumns({
            "_groups": F.coalesce("_slow", F.when(rule["linear"].isNull(), picked)),
            "_pairs": F.when(family == "kv", F.col("_kv")).when(family == "cef", F.col("_cef")["pairs"]).when(family == "leef", F.col("_leef")["pairs"])
            .when(family == "xml", F.col("_xml")["pairs"]), "_root": F.col("_xml")["root"],
        })
        df = df.withColumns({f"_{c}": column for c, column in zip(("keys", "last"), last_first(F.col("_pairs")))})
        parse_error = F.coalesce(
            rule["refusal"], F.when(family == "cef", F.col("_cef")["error"]).when(family == "leef", F.col("_leef")["error"]).when(family == "xml", F.col("_xml")["error"])
            .when((family == "regex") & F.col("_groups").isNull(), rx.NO_MATCH).when((family == "json") & F.col("_doc").isNull(), jsonpath.NOT_JSON))

        def value(o):
            text = F.get(F.col("_groups"), o["number"])
            grouped = F.when(o["optional"], found(F.nullif(text, F.lit("")), present=F.col("_groups").isNotNull())).otherwise(found(text))
            paired = value_at(F.col("_keys"), F.col("_last"), o["key"])
            below = value_at(F.col("_keys"), F.col("_last"), F.concat(F.col("_root"), F.lit("/"), o["key"]))
            simple = jsonpath.variant_field(F.try_variant_get(F.col("_doc"), o["path"], "variant"))
            wild = jsonpath.variant_field(F.try_parse_json(F.get(F.col("_hits"), o["slot"])))
            return (
                F.when(family.isin("kv", "cef", "leef"), let(paired, lambda v: found(v))).when(family == "xml", let(F.coalesce(paired, below), lambda v: found(v)))
                .when((family == "regex") & o["number"].isNotNull(), grouped).when(o["path"].isNotNull(), simple).when(o["slot"].isNotNull(), wild).otherwise(absent())
            )

        def best(options):
            return F.coalesce(F.get(F.filter(F.transform(options, value), lambda v: v["present"]), F.lit(0)), absent())

        values = F.when(open_, F.transform(rule["sources"], best)).otherwise(F.transform(rule["sources"], lambda o: absent())).cast(VALUES_TYPE)
        # Settled, so that no later step copies the calls to Python into its own expressions.
        df = df.withColumns({"_values": settle(values), "_fields": rule["fields"], "_parse_error": parse_error})
        df = df.withColumn("_error", settle(F.coalesce("_parse_error", self.violation(F.col("_values"), F.col("_fields"), rule["needed"], self.rules))))
        if self.datetime_mode == "exact":
            df = self._exact_dates(df)
        return df.drop("_kv", "_cef", "_leef", "_xml", "_fast", "_marked", "_slow", "_doc", "_hits", "_groups", "_pairs", "_keys", "_last", "_root", "_parse_error")

    # -- discovery -------------------------------------------------------------

    @staticmethod
    def _whole(df: DataFrame, raw: str) -> DataFrame:
        """Lines parsed once for all rules of the families that need no rule for it; ``_refused`` names those that cannot."""
        line = F.col(raw)
        df = df.withColumns({f"_{name}": parse(F.when(F.contains(line, F.lit(mark)), line)) for name, parse, mark in WHOLE.values()})
        refused = {
            "cef": ~F.startswith(line, F.lit("CEF:")) | F.col("_cef")["error"].isNotNull(), "leef": ~F.startswith(line, F.lit("LEEF:")) | F.col("_leef")["error"].isNotNull(),
            "xml": ~F.contains(line, F.lit("<")) | F.col("_xml")["error"].isNotNull(), "json": F.col("_doc").isNull(),
        }
        return df.withColumn("_refused", F.array_compact(F.array(*[F.when(no, F.lit(kind)) for kind, no in refused.items()])))

    def passing_pairs(self, df: DataFrame, raw: str, tenant: str | None, keep: list[str]) -> DataFrame:
        """One row per (row, candidate rule that accepts its line): the columns ``keep`` and ``_number``.

        A line is parsed once a family however many candidates it has, and rules of families that cannot parse it are left at once.
        """
        lines = self._whole(df.select(*dict.fromkeys([*keep, raw, *([tenant] if tenant else [])])), raw)
        pairs = lines.select("*", F.explode(self.index.column(F.col(raw))).alias("_number"))
        joined = self._with_rule(pairs, "_number", "number").filter(~F.array_contains("_refused", F.col("_rule")["family"]))
        if tenant:
            joined = joined.filter(F.col(tenant) == F.col("_rule")["tenant"])
        passed = self._parsed(joined, raw, whole=True).filter(F.col("_error").isNull())
        if self.require_evidence:
            passed = passed.filter(F.col("_rule")["has_required"] | F.exists("_values", lambda v: v["present"]))
        return passed.select(*keep, "_number")

    def first_passing(self, df: DataFrame, raw: str, tenant: str | None, out: str = "_candidate") -> DataFrame:
        """Add the version of the first rule, in catalogue order, that accepts the line.

        The rows are numbered and written, so that the pairs find their row again.
        """
        from loglattice.session import written

        numbered = written(df.withColumn("_at_row", F.monotonically_increasing_id()), "numbered")
        first = self.passing_pairs(numbered, raw, tenant, ["_at_row"]).groupBy("_at_row").agg(F.min("_number").alias("_number"))
        versions = lookup_join(first, self.table.select(F.col("number").alias("_number"), F.col("version").alias(out)), "_number").drop("_number")
        return numbered.join(versions, "_at_row", "left").drop("_at_row")

    def first_passes(self, unmatched: DataFrame, raw: str, order: str, tenant: str | None) -> DataFrame:
        found_ = self.passing_pairs(unmatched, raw, tenant, ["fingerprint", order])
        # Two aggregates of fixed width: the first line, then the least rule that accepts it.
        best = found_.groupBy("fingerprint", order).agg(F.min("_number").alias("_number")).groupBy("fingerprint").agg(
            F.min(order).alias("_first"), F.min_by("_number", order).alias("_number"))
        versions = self.table.select(F.col("number").alias("_number"), F.col("version").alias("_discovered"))
        return lookup_join(best, versions, "_number").select("fingerprint", "_first", "_discovered")

    # -- what the row says -----------------------------------------------------

    def bound_versions(self, chosen: DataFrame) -> DataFrame:
        ids = self.table.select(F.col("rule_id").alias("_rule_id"), F.col("version").alias("_bound"), F.col("tenant").alias("_bound_tenant"))
        return lookup_join(chosen, ids, "_rule_id").select("fingerprint", "_bound", "_bound_tenant")

    def known_bindings(self, bindings: DataFrame) -> DataFrame:
        return lookup_join(bindings, self.table.select("rule_id"), "rule_id", "left_semi")

    def add_rule_ids(self, df: DataFrame, version: str, out: str = "rule_id") -> DataFrame:
        return lookup_join(df, self.table.select(F.col("version").alias(version), F.col("rule_id").alias(out)), version)

    def rule_columns(self, version: str, columns: dict) -> dict[str, Column]:
        return {name: F.col("_rule")[name] for name in columns}

    def positions(self, version: str) -> Column:
        return F.col("_rule")["at"]

    def is_loose_cell(self, target: Column) -> Column:
        return F.array_contains(F.col("_rule")["loose"], target)
