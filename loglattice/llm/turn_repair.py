"""Conversation structure repair: the cheapest edits that give roles ``(s?(ua)+)?``, by iterative-deepening A*.

Edits of a conversation's rows: Delete (4), Insert an empty user or assistant turn (3), Keep (0), Rerole
to user or assistant (3). Blank and duplicate rows must go; a truncated row that stays adds 3. The search
goes depth first in ASCII order of the edits' initials under increasing cost bounds, prunes by an
admissible estimate of what the remaining rows cost at least, and keeps a transposition table of failed
states with the cost they are known to need; so the first accepting path is the cheapest, and of equally
cheap ones the least in ASCII order. Which role an inserted or reroled turn takes follows from the state.

Conversations of up to ``WHOLE_ROWS`` rows are searched whole, each inside one task. A longer one is cut
into chunks; each chunk is searched for every pair of entry and exit state, the tables of costs compose in
a tree of bounded fan-in (inserts at a border belong to the later chunk, so no chunk's edits begin another's
and the order of whole audits follows from the order inside the first chunk that differs), and the chosen
pairs are searched once more for their edits. Only costs and orders of four states travel in the tree.

Defined results: null roles and texts, and null ids and turns in the text that decides on damage, count as
one space. A null conv_id is a conversation of its own. Rows of equal turn are ordered by role, then text;
equal rows are duplicates. Turns that are null come first. A role that begins with none of s, u, a cannot be
kept. A conversation without rows has zeros, an empty audit and the digest of an empty text; an empty table
gives no rows. Other columns are not read. A hot conversation's digest is taken over its repaired turns in
order, one chunk at a time, as a digest demands.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import id_key
from loglattice.operators.ranking import number_rows
from loglattice.session import lookup_join, written

# Rows of a conversation that is searched whole, of a chunk of a longer one, and children of a node of the tree.
WHOLE_ROWS, CHUNK_ROWS, FAN_IN = 1000, 128, 64
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 40
# States: nothing yet, after s, after u, after a. A conversation ends in the first or the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, ACCEPTING = range(4), (START, AFTER_A)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
FREE = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U, AFTER_U: AFTER_A}
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = {"su", "ua", "au"}
FINE, FORCED, CUT = range(3)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

Row = tuple[int, str]  # fault (FINE, FORCED: must go, CUT: truncated), role initial


def least_costs(rows: list[Row]) -> list[int]:
    """Per position what the rows from there on cost at least.

    Rows that must go cost a deletion, truncated ones their penalty. Of the neighbourhoods of the rows
    that may stay, one edit touches two at most, and these lie side by side: a run of k bad ones needs
    k / 2 edits, and runs share none. An edit costs 3 more, or 1 more where it deletes a truncated row.
    """
    costs, sure, cut, run, behind, following = [0], 0, 0, 0, 0, ""
    for fault, initial in reversed(rows):
        if fault == FORCED:
            sure += DELETE
        else:
            sure, cut = sure + TRUNCATED * (fault == CUT), cut + (fault == CUT)
            if following and initial + following not in LEGAL:
                run += 1
            else:
                run, behind = 0, behind + (run + 1) // 2
            following = initial or "?"
        edits = behind + (run + 1) // 2
        cheap = min(cut, edits)
        costs.append(sure + cheap * (DELETE - TRUNCATED) + (edits - cheap) * min(INSERT, REROLE))
    return costs[::-1]


def search(rows: list[Row], entry: int = START, goal: tuple[int, ...] = ACCEPTING, last: bool = True) -> tuple[int, str] | None:
    """Cost and edits of the cheapest, then ASCII-least path from ``entry`` to a state of ``goal``; None where there is none.

    Only the ``last`` chunk of a conversation may insert behind its rows.
    """
    n, estimate, known, path = len(rows), least_costs(rows), {}, []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * n + 4000))
    furthest = AFTER_U if set(goal) & {AFTER_U, AFTER_A} else max(goal)  # states lead to later ones only, but for the last two

    def needs(i: int, state: int, left: int) -> int:
        """0 when a path within ``left`` is found (its edits are in ``path``, last first), else more than ``left``."""
        if i == n and state in goal:
            return 0
        least = known.get((i, state), estimate[i])
        if least > left:
            return least
        least = NEVER
        moves = []
        if i < n:
            fault, initial = rows[i]
            moves.append(("D", DELETE, i + 1, state))
        if i < n or last:
            moves.append(("I", INSERT, i, FREE[state]))
        if i < n and fault != FORCED:
            penalty = TRUNCATED * (fault == CUT)
            kept = STEP.get((state, initial))
            if kept is not None:
                moves.append(("K", penalty, i + 1, kept))
            moves.append(("R", REROLE + penalty, i + 1, FREE[state]))
        for letter, cost, j, following in moves:
            if min(following, AFTER_U) > furthest:
                continue
            need = needs(j, following, left - cost)
            if need <= left - cost:
                path.append(letter)
                return 0
            least = min(least, need + cost)
        known[i, state] = least
        return least

    # Deleting all rows but one and inserting two turns reaches every state that can be reached.
    bound, most = estimate[0], DELETE * n + 2 * INSERT + TRUNCATED
    while bound <= most:
        need = needs(0, entry, bound)
        if need <= bound:
            return bound, "".join(reversed(path))
        bound = need
    return None


def repaired(rows: list[tuple[str, str]], audit: str, entry: int = START) -> Iterator[str]:
    """Lines ``role:text`` of the repaired conversation."""
    i, state = 0, entry
    for letter in audit:
        if letter == "I":
            state = FREE[state]
            yield f"{NAMES[state]}:"
            continue
        role, text = rows[i]
        i += 1
        if letter == "K":
            state = STEP[state, role[:1]]
            yield f"{role}:{text}"
        elif letter == "R":
            state = FREE[state]
            yield f"{NAMES[state]}:{text}"


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows left after the keyed damage: conv, turn, role, text, copy (a repeated row stands twice)."""
    plain = {"role": F.coalesce(F.col(role_col), F.lit(" ")), "text": F.coalesce(F.col(text_col), F.lit(" "))}
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    kind = F.crc32(named.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(id_key(F.col(id_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *[c.alias(k) for k, c in plain.items()], kind.alias("kind"))
    rows = rows.filter("kind != 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows


def as_rows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as they are, in the form that :func:`repair` reads."""
    plain = [F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    return conversations.select(id_key(F.col(id_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *plain, F.lit(0).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``blank`` and ``cut`` (the last character that is no white space ends no sentence)."""
    seen = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.withColumns({"blank": ~seen, "cut": seen & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of consecutive rows with equal keys, across batches."""
    current, group = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current:
                if group:
                    yield current, group
                current, group = key, []
            group.append(row)
    if group:
        yield current, group


def _grouped(rows: DataFrame, by: list[str], order: list[Column | str], make: Callable[[tuple, list[dict]], dict], schema: str) -> DataFrame:
    """``make`` on each group of bounded size, many groups a task."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name: [] for name in names}
        for key, group in _runs(batches, by):
            for made in make(key, group):
                for name in names:
                    out[name].append(made[name])
            if len(out[names[0]]) >= 2000:
                yield pa.record_batch([pa.array(out[name], types[name]) for name in names], names=names)
                out = {name: [] for name in names}
        if out[names[0]]:
            yield pa.record_batch([pa.array(out[name], types[name]) for name in names], names=names)

    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    types = {part.strip().split(" ")[0]: kinds[part.strip().split(" ")[1]] for part in schema.split(",")}
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _whole(key: tuple, group: list[dict]) -> Iterator[dict]:
    """All results of a conversation that is searched whole."""
    seen, rows, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for row in group:
        said = (row["role"], row["text"])
        fault = "blank" if row["blank"] else "duplicate" if said in seen else "truncated" if row["cut"] else None
        seen.add(said)
        if fault:
            faults[fault] += 1
        rows.append((FINE if fault is None else CUT if fault == "truncated" else FORCED, row["role"][:1]))
    turns = {row["turn"] for row in group} - {None}
    cost, audit = search(rows)
    lines = "\n".join(repaired([(r["role"], r["text"]) for r in group], audit))
    yield {
        "conv": key[0], "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **faults, "illegal": _illegal([r[1] for r in rows]),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest(),
    }


# Tables of chunks: costs and orders of the 16 pairs of entry and exit state, row by row.

def _ordered(keys: dict[int, tuple]) -> dict[int, int]:
    return {exit_: place for place, exit_ in enumerate(sorted(keys, key=keys.get))}


def _chunk_table(rows: list[Row], last: bool) -> tuple[list[int], list[int]]:
    costs, orders = [NEVER] * 16, [0] * 16
    for entry in STATES:
        found = {e: search(rows, entry, (e,), last) for e in STATES}
        found = {e: f for e, f in found.items() if f is not None}
        for e, place in _ordered({e: (f[1],) for e, f in found.items()}).items():
            costs[4 * entry + e], orders[4 * entry + e] = found[e][0], place
    return costs, orders


def _joined(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """Table of two neighbours: cheapest, then least in order, over the state between them."""
    costs, orders = [NEVER] * 16, [0] * 16
    for entry in STATES:
        keys = {}
        for e in STATES:
            ways = [(a[0][4 * entry + m] + b[0][4 * m + e], a[1][4 * entry + m], b[1][4 * m + e]) for m in STATES]
            best = min(ways)
            if best[0] < NEVER:
                costs[4 * entry + e], keys[e] = best[0], best[1:]
        for e, place in _ordered(keys).items():
            orders[4 * entry + e] = place
    return costs, orders


def _between(tables: list[tuple[list[int], list[int]]], entry: int, exit_: int) -> list[tuple[int, int]]:
    """Entry and exit state of each table along the best way from ``entry`` to ``exit_``."""
    rest = [0 if s == exit_ else NEVER for s in STATES]
    after = [rest]
    for costs, _ in reversed(tables):
        rest = [min(costs[4 * s + e] + rest[e] for e in STATES) for s in STATES]
        after.append(rest)
    after.reverse()
    ways, state = [], entry
    for (costs, orders), rest in zip(tables, after[1:]):
        following = min(STATES, key=lambda e: (costs[4 * state + e] + rest[e], orders[4 * state + e] if costs[4 * state + e] < NEVER else NEVER))
        ways.append((state, following))
        state = following
    return ways


NODE = "conv string, node long, costs array<long>, orders array<long>"


def _compose(key: tuple, group: list[dict]) -> Iterator[dict]:
    table = (group[0]["costs"], group[0]["orders"])
    for row in group[1:]:
        table = _joined(table, (row["costs"], row["orders"]))
    yield {"conv": key[0], "node": key[1], "costs": table[0], "orders": table[1]}


def _spread(key: tuple, group: list[dict]) -> Iterator[dict]:
    tables = [(row["costs"], row["orders"]) for row in group]
    for row, (entry, exit_) in zip(group, _between(tables, group[0]["entry"], group[0]["exit"])):
        yield {"conv": key[0], "node": row["node"], "entry": entry, "exit": exit_}


def _long_conversations(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Results of conversations of more than a chunk; every group that a task holds has a bounded size."""
    numbered = written(number_rows(rows.withColumn("sha", F.sha2("text", 256)), ["conv"], [F.col("turn").asc_nulls_first(), "role", "text", "copy"], "pos"), "turns")
    repeated = numbered.groupBy("conv", "role", "sha").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    marked = lookup_join(numbered, written(repeated, "repeated"), ["conv", "role", "sha"])
    again = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    ends = numbered.groupBy("conv").agg(F.max("pos").alias("rows"))
    chunk = F.floor((F.col("pos") - 1) / chunk_rows).cast("long")
    marked = marked.select("conv", chunk.alias("node"), "pos", "turn", "role", "text", fault.alias("fault"))
    marked = written(lookup_join(marked, ends.select("conv", F.floor((F.col("rows") - 1) / chunk_rows).cast("long").alias("final")), "conv"), "marked")
    kind = {"": FINE, "truncated": CUT, "blank": FORCED, "duplicate": FORCED}

    def table(key: tuple, group: list[dict]) -> Iterator[dict]:
        found = [(kind[r["fault"]], r["initial"]) for r in group]
        costs, orders = _chunk_table(found, group[0]["node"] == group[0]["final"])
        yield {"conv": key[0], "node": key[1], "costs": costs, "orders": orders, "illegal": _illegal([r[1] for r in found]), "head": found[0][1], "tail": found[-1][1]}

    slim = marked.select("conv", "node", "pos", "fault", F.substring("role", 1, 1).alias("initial"), "final")
    leaves = written(_grouped(slim, ["conv", "node"], ["pos"], table, f"{NODE}, illegal long, head string, tail string"), "tables")
    levels = [leaves.select("conv", "node", "costs", "orders")]
    width = leaves.agg(F.max("node")).first()[0] + 1
    while width > 1:
        parents = levels[-1].withColumn("parent", F.floor(F.col("node") / FAN_IN).cast("long"))
        levels.append(written(_grouped(parents, ["conv", "parent"], ["node"], _compose, NODE), "tables"))
        width = math.ceil(width / FAN_IN)
    # The whole conversation: from the start to the better of the two accepting states.
    pick = F.array_min(F.array(*[F.struct(F.get("costs", F.lit(e)).alias("cost"), F.get("orders", F.lit(e)).alias("order"), F.lit(e).cast("long").alias("exit")) for e in ACCEPTING]))
    top = levels[-1].withColumn("pick", pick)
    chosen = top.select("conv", "node", F.lit(START).cast("long").alias("entry"), F.col("pick.exit").alias("exit"))
    costs = top.select("conv", F.col("pick.cost").alias("cost"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("parent", F.floor(F.col("node") / FAN_IN).cast("long")).join(chosen.withColumnRenamed("node", "parent"), ["conv", "parent"])
        chosen = written(_grouped(below, ["conv", "parent"], ["node"], _spread, "conv string, node long, entry long, exit long"), "ways")

    def edits(key: tuple, group: list[dict]) -> Iterator[dict]:
        way = group[0]
        found = [(kind[r["fault"]], r["role"][:1]) for r in group]
        _, audit = search(found, way["entry"], (way["exit"],), way["node"] == way["final"])
        lines = list(repaired([(r["role"], r["text"]) for r in group], audit, way["entry"]))
        yield {"conv": key[0], "node": key[1], "audit": audit, "lines": "\n".join(lines) if lines else None}

    pieces = written(_grouped(marked.join(chosen, ["conv", "node"]), ["conv", "node"], ["pos"], edits, "conv string, node long, audit string, lines string"), "edits")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, current, audit, sha, started = ["conv", "audit", "repaired_sha256"], None, [], None, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv"] != current:
                    if current is not None:
                        yield pa.record_batch([[current], ["".join(audit)], [sha.hexdigest()]], names=names)
                    current, audit, sha, started = row["conv"], [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["lines"] is not None:
                    sha.update(("\n" if started else "").encode() + row["lines"].encode())
                    started = True
        if current is not None:
            yield pa.record_batch([[current], ["".join(audit)], [sha.hexdigest()]], names=names)

    whole = pieces.repartition("conv").sortWithinPartitions("conv", "node").mapInArrow(digests, "conv string, audit string, repaired_sha256 string")
    turns = marked.filter("turn IS NOT NULL").groupBy("conv", "turn").count().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    counts = marked.groupBy("conv").agg(*[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")])
    borders = leaves.select("conv", (F.col("node") + 1).alias("node"), F.col("tail").alias("before"))
    met = leaves.join(borders, ["conv", "node"], "left")
    bad = (F.col("before").isNotNull() & ~F.concat("before", "head").isin(*LEGAL)).cast("long")
    illegal = met.groupBy("conv").agg(F.sum(F.col("illegal") + bad).alias("illegal"))
    return whole.join(counts, "conv").join(illegal, "conv").join(costs, "conv").join(turns, "conv", "left").select(
        "conv", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def repair(rows: DataFrame, whole_rows: int = WHOLE_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per conversation with rows (conv, turn, role, text, copy): faults, cost, edits and digest of the repaired turns."""
    judged = with_faults(rows)
    large = written(rows.groupBy("conv").count().filter(F.col("count") > whole_rows).select("conv"), "long")
    if large.isEmpty():
        return _grouped(judged, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text", "copy"], _whole, RESULT)
    short = lookup_join(judged, large, "conv", "left_anti")
    long = lookup_join(judged, large, "conv", "left_semi")
    found = _grouped(short, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text", "copy"], _whole, RESULT)
    return found.unionByName(_long_conversations(long, chunk_rows))


def repair_damaged(conversations: DataFrame, id_col: str = "conv_id", whole_rows: int = WHOLE_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Damage, then repair: one row per conversation of the input."""
    found = repair(damage(conversations, id_col), whole_rows, chunk_rows)
    every = conversations.select(F.col(id_col), id_key(F.col(id_col)).alias("conv")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "conv", "left").select(
        id_col, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
