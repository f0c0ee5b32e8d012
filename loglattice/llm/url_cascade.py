"""URL filters by Bloom filter cascades: exact membership of every key of the corpus, without joins.

A list of keys (``host`` + ``path``) is encoded by alternate levels of Bloom filters: level 0 holds the
listed keys, level 1 the keys of the corpus that level 0 takes for listed, level 2 the listed keys that
level 1 takes for unlisted, and so on until a level errs on no key of the corpus. As the levels are
built over the complete universe of keys that the corpus can ask for, a key's answer is exact: the
parity of the first level that does not hold it. Pages are then judged row by row, whatever their
number; the filters take some bits per listed key.

A url's keys are its host and all parent domains, each with those beginnings of its path whose length
occurs in a list. Of the rules that fit, the one with the most characters wins (of equally long ones a
blocking rule, then the one with the longer host). Where no rule fits, hosts of the list ``listed``, and
all below them, are blocked; all else is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed. Repeated rows are judged each, repeated rules count once; a key that stands in both lists blocks.
An empty table of pages or rules gives no rows or no rules. Of the pages only the id and the url are
read, so other columns and their names do not matter. Keys are told apart by 128 bits of hash: should a
listed and an unlisted key agree in all of them, building ends with an error, never with a wrong answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm.common import ascii_lower
from loglattice.session import written

# Bytes of one slice's first level; longer lists are cut by hash into slices that are probed one after the other.
SLICE_BYTES = 64 << 20
# Keys left on both sides that are few enough to finish the remaining levels on the driver (16 bytes each).
LOCAL_KEYS = 50_000
MAX_LEVELS = 200
# Words in a label of a host that put it on the list of blocked hosts.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "xxx")

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SEEDS = (11, 29)
LISTS = ("allow", "block", "listed")
KEY_FIELDS = "k0 long, k1 long, listed boolean"


def mixed(values: np.ndarray, level: int) -> np.ndarray:
    """One independent 64-bit hash per level (a finaliser of two multiplications)."""
    with np.errstate(over="ignore"):
        x = values ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def places(k0: np.ndarray, k1: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of each key in a level: one row per hash."""
    first, step = mixed(k0, level), mixed(k1, level) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(first + np.uint64(j) * step) % np.uint64(bits) for j in range(hashes)])


def level_shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter of ``n`` keys with the given rate of errors."""
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    return -(-bits // 64) * 64, max(1, round(math.log2(1 / rate)))


def held(words: np.ndarray, k0: np.ndarray, k1: np.ndarray, level: int, hashes: int) -> np.ndarray:
    """Which keys a level holds (or takes for held)."""
    at = places(k0, k1, level, len(words) * 64, hashes)
    return (((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)) == 1).all(axis=0)


def filled(k0: np.ndarray, k1: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    words = np.zeros(bits // 64, dtype=np.uint64)
    at = places(k0, k1, level, bits, hashes).ravel()
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


Level = tuple[np.ndarray, int]  # words, hashes


def members(levels: list[Level], k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe: the parity of the first level that does not hold the key."""
    answer = np.full(len(k0), len(levels) % 2 == 1)
    alive = np.arange(len(k0))
    for number, (words, hashes) in enumerate(levels):
        inside = held(words, k0[alive], k1[alive], number, hashes)
        answer[alive[~inside]] = number % 2 == 1
        alive = alive[inside]
    return answer


def _keys(batch: pa.RecordBatch, prefix: str = "k") -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(f"{prefix}{i}").to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))


def _level_words(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """One filter over all keys of the frame: each task sends the words it set, equal words are joined by bit_or."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(*_keys(batch), level, bits, hashes))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = keys.select("k0", "k1").mapInArrow(fill, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    words = np.zeros(bits // 64, dtype=np.uint64)
    got = rows.toArrow()  # at most bits / 64 rows, within SLICE_BYTES
    words[got.column("word").to_numpy()] = got.column("value").to_numpy().view(np.uint64)
    return words


def _passing(keys: DataFrame, words: np.ndarray, level: int, hashes: int) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(words, *_keys(batch), level, hashes)))

    return keys.mapInArrow(keep, KEY_FIELDS)


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels over a written table of distinct keys (k0, k1, listed) with both sides of the universe.

    Each level reads only the keys on which the one before it erred; these become fewer at least by
    half from level to level, and the last few are finished on the driver.
    """
    levels: list[Level] = []
    listed = {True: keys.filter("listed"), False: keys.filter("NOT listed")}
    counts = {side: frame.count() for side, frame in listed.items()}
    while counts[len(levels) % 2 == 0]:
        number, side = len(levels), len(levels) % 2 == 0
        if number == MAX_LEVELS:
            raise RuntimeError("a listed and an unlisted key agree in all bits of their hashes")
        if number and sum(counts.values()) <= LOCAL_KEYS:
            tables = {s: frame.select("k0", "k1").toArrow().combine_chunks() for s, frame in listed.items()}
            rest = {s: tuple(t.column(c).to_numpy().view(np.uint64) for c in ("k0", "k1")) for s, t in tables.items()}
            return _finish(levels, rest)
        # The first level errs so seldom that the second has about as many keys; all others err on half.
        rate = min(0.5, math.sqrt(0.5) * counts[side] / max(1, counts[not side])) if number == 0 else 0.5
        bits, hashes = level_shape(counts[side], rate)
        words = _level_words(listed[side], number, bits, hashes)
        levels.append((words, hashes))
        listed[not side] = written(_passing(listed[not side], words, number, hashes), "cascade")
        counts[not side] = listed[not side].count()
    return levels


def _finish(levels: list[Level], rest: dict[bool, tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    while len(rest[len(levels) % 2 == 0][0]):
        number, side = len(levels), len(levels) % 2 == 0
        if number == MAX_LEVELS:
            raise RuntimeError("a listed and an unlisted key agree in all bits of their hashes")
        bits, hashes = level_shape(len(rest[side][0]), 0.5)
        words = filled(*rest[side], number, bits, hashes)
        levels.append((words, hashes))
        stays = held(words, *rest[not side], number, hashes)
        rest[not side] = tuple(k[stays] for k in rest[not side])
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path; both empty where there is none."""
    text, pattern = F.coalesce(url.cast("string"), F.lit("")), r"://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key) for seed in SEEDS]


def candidates(shapes: list[tuple[int, int]]) -> Column:
    """Keys of columns ``host`` and ``path``: parent domains of k labels, each with a beginning of the path of l characters."""
    if not shapes:
        return F.expr("CAST(array() AS array<string>)")
    listed = ", ".join(f"named_struct('k', {k}, 'l', {size})" for k, size in shapes)
    fits = f"filter(array({listed}), s -> s.k <= size(split(host, '[.]')) AND s.l <= length(path))"
    return F.expr(f"transform({fits}, s -> concat(substring_index(host, '.', -s.k), substring(path, 1, s.l)))")


def shapes_of(keys: DataFrame) -> list[tuple[int, int]]:
    """Numbers of labels and path lengths that occur in a list with ``host`` and ``path`` (few, whatever its length)."""
    rows = keys.select(F.size(F.split("host", "[.]")).alias("k"), F.length("path").alias("l")).distinct().collect()
    return sorted((r.k, r.l) for r in rows)


def listed_hosts(pages: DataFrame, url_col: str = "url", blocked_words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """Hosts of the corpus with a blocked word in a label (labels are cut at hyphens), as keys without a path."""
    host = host_and_path(F.col(url_col))[0]
    pattern = rf"(^|[.-])({'|'.join(blocked_words)})([.-]|$)"
    return pages.select(host.alias("host")).filter(F.col("host").rlike(pattern)).distinct().withColumn("path", F.lit(""))


def _slices(n_listed: int, n_all: int, slice_bytes: int) -> int:
    if not n_listed:
        return 1
    rate = min(0.5, math.sqrt(0.5) * n_listed / max(1, n_all - n_listed))
    return max(1, math.ceil(level_shape(n_listed, rate)[0] / 8 / slice_bytes))


def cascades(universe: DataFrame, listing: DataFrame, names: tuple[str, ...] = LISTS, slice_bytes: int = SLICE_BYTES) -> list[dict[str, list[Level]]]:
    """Per slice of the hashes one cascade per list. ``universe``: distinct (k0, k1); ``listing``: (key, list)."""
    hashed = listing.select(*[h.alias(f"k{i}") for i, h in enumerate(key_hashes(F.col("key")))], "list")
    both = universe.withColumn("list", F.lit(None).cast("string")).unionByName(hashed).groupBy("k0", "k1")
    keys = written(both.agg(*[F.max(F.coalesce(F.col("list") == name, F.lit(False))).alias(name) for name in names]), "url-keys")
    n_all, *counts = keys.agg(F.count(F.lit(1)), *[F.count_if(name) for name in names]).first()
    slices = max(_slices(n, n_all, slice_bytes) for n in counts)
    part = F.pmod("k0", F.lit(slices))
    found = []
    for s in range(slices):
        mine = keys.filter(part == s) if slices > 1 else keys
        found.append({name: build_cascade(mine.select("k0", "k1", F.col(name).alias("listed"))) for name in names})
    return found


def _judge(rows: DataFrame, filters: dict[str, list[Level]], number: int, slices: int) -> DataFrame:
    """Fold one slice's answers into ``best`` (length, blocking, position of the winning rule's key) and ``hit`` (listed)."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in ("k0s", "k1s", "sizes")}
            sizes = np.diff(lists["k0s"].offsets.to_numpy())
            k0, k1 = (lists[c].flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("k0s", "k1s"))
            length = lists["sizes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            local = np.arange(len(k0)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            mine = np.flatnonzero(np.mod(k0.view(np.int64), slices) == number)
            found = {name: np.zeros(len(k0), dtype=bool) for name in ("allow", "block", "listed")}
            for name, levels in filters.items():
                found[name][mine] = members(levels, k0[mine], k1[mine])
            score = np.where(found["allow"] | found["block"], (length << 21) | (found["block"].astype(np.int64) << 20) | local, -1)
            best = batch.column("best").to_numpy(zero_copy_only=False).copy()
            np.maximum.at(best, row, score)
            hit = batch.column("hit").to_numpy(zero_copy_only=False).copy()
            hit[row[found["listed"]]] = True
            names = batch.schema.names
            columns = [pa.array(best) if n == "best" else pa.array(hit) if n == "hit" else batch.column(n) for n in names]
            yield pa.record_batch(columns, names=names)

    return rows.mapInArrow(probe, rows.schema)


def judge_urls(
    pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row per page: id, host, path, rule (or null), verdict ``allow`` or ``block``.

    ``rules`` has ``host``, ``path``, ``verdict``; ``listed`` has ``host``, ``path`` of keys that block
    where no rule fits. Lists may be of any length; rules without a host are left out.
    """
    stated = rules.filter(F.coalesce("host", F.lit("")) != "").select("host", F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").alias("list"))
    stated = stated.filter(F.col("list").isin("allow", "block"))
    if listed is not None:
        stated = stated.unionByName(listed.select("host", F.coalesce("path", F.lit("")).alias("path"), F.lit("listed").alias("list")))
    listing = written(stated.distinct(), "url-lists")
    # The longest host comes last, which settles ties.
    shapes = sorted(shapes_of(listing), key=lambda s: (s[0], -s[1]))
    host, path = host_and_path(F.col(url_col))
    asked = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("keys", candidates(shapes))
    hashes = {f"k{i}s": F.transform("keys", lambda key: key_hashes(key)[i]) for i in range(2)}
    asked = asked.withColumns({**hashes, "sizes": F.transform("keys", F.length)})
    pair = F.explode(F.arrays_zip("k0s", "k1s"))
    universe = asked.select(pair.alias("p")).select(F.col("p.k0s").alias("k0"), F.col("p.k1s").alias("k1")).distinct()
    parts = cascades(universe, listing.select(F.concat("host", "path").alias("key"), "list"), slice_bytes=slice_bytes)
    rows = asked.withColumns({"best": F.lit(-1).cast("long"), "hit": F.lit(False)})
    for number, filters in enumerate(parts):
        rows = _judge(rows, filters, number, len(parts))
        rows = written(rows, "judged") if number + 1 < len(parts) else rows
    rule = F.when(F.col("best") >= 0, F.get("keys", F.col("best").bitwiseAND(F.lit((1 << 20) - 1)).cast("int")))
    blocks = F.when(F.col("best") >= 0, F.col("best").bitwiseAND(F.lit(1 << 20)) > 0).otherwise(F.col("hit"))
    return rows.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules stated in a program: (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
