"""Near-duplicate groups by SimHash, found with Golay-code keys.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits), each read as a word of the
perfect binary Golay code of length 23: every such word lies within 3 bits of exactly one
codeword, whose 12-bit message is the segment's index. A segment also has the indices of all words
one bit away: one index if it is within 2 bits of its codeword, up to six otherwise. Two segments
that differ in at most one bit therefore meet when one side shows its own index and the other side
all of its indices.

Pigeonhole over the errors a >= b >= c of the three segments, a + b + c <= 3: either c = 0 and then
b <= 1, or all are 1. So two linked fingerprints agree in one whole segment and meet in the indices
of another (33 bits of key), or meet in the indices of all three (36 bits). Rows with equal keys
are verified by counting differing bits. Inside a key only a chain through each connected set
leaves the task, never all pairs; links between chains come from other keys. Components follow by
contraction.

Defined results: null and wordless texts have fingerprint 0 and are linked like any other. Equal
fingerprints are one node, so repeated rows and groups of any size cost one row each. Null ids get
the component of their fingerprint; a component with only null ids has a null component_id. Empty
input gives an empty table. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loglattice.llm.common import ascii_lower, attach, id_key, whole, words
from loglattice.llm.components import connected_components, label
from loglattice.session import cut_lineage

MAX_BITS = 3
SHINGLE = 3
# Segments as (lowest bit, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GENERATOR, CHECK_BITS, CODE_BITS = 0b110001110101, 11, 23
# Rows of one key that are compared with each other at a time.
BLOCK = 2048
# Entries of the index table that are worked out at a time.
TABLE_STEP = 1 << 16


# ---- fingerprints

def with_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``hashes``: XXH64 (seed 42, the seed Spark has) of all three-word shingles, repeats included."""
    split = docs.select(F.col(id_col).alias("id"), words(ascii_lower(whole(F.col(text_col)))).alias("w"))
    n = F.size("w")
    each = F.transform(
        F.slice("w", F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(0))),
        lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(F.col("w"), i + k) for k in range(1, SHINGLE)])),
    )
    short = F.array(F.xxhash64(F.array_join("w", " ")))
    none = F.array().cast("array<bigint>")
    return split.select("id", F.when(n >= SHINGLE, each).when(n > 0, short).otherwise(none).alias("hashes"))


@F.pandas_udf(LongType())
def majority(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash of each array of hashes: a bit is set if it is set in over half of them."""
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    for batch in batches:
        out = np.zeros(len(batch), dtype=np.uint64)
        for k, hashes in enumerate(batch):
            h = np.asarray(hashes, dtype=np.int64)
            if len(h):
                ones = np.zeros(64, dtype=np.int64)
                for at in range(0, len(h), 65536):
                    part = np.ascontiguousarray(h[at : at + 65536]).view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[k] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
        yield pd.Series(out.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a long) per row of ``docs``."""
    return with_hashes(docs, id_col, text_col).select("id", majority(F.col("hashes")).alias("fp"))


# ---- Golay code

def _remainder(values: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    rest = values.copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        rest ^= (rest >> bit & 1) * (GENERATOR << (bit - CHECK_BITS))
    return rest


def error_table() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2,048 remainders (the code is perfect)."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(CODE_BITS), n)], dtype=np.int32)
    table = np.full(1 << CHECK_BITS, -1, dtype=np.int32)
    table[_remainder(patterns)] = patterns
    return table


def index_table() -> np.ndarray:
    """Index (12-bit message of the nearest codeword) of every 22-bit word.

    Filled in slices: each Python worker of an executor builds it, often all at once.
    """
    errors, out = error_table(), np.empty(1 << 22, dtype=np.int16)
    for low in range(0, len(out), TABLE_STEP):
        words22 = np.arange(low, low + TABLE_STEP, dtype=np.int32)
        out[low : low + TABLE_STEP] = (words22 ^ errors[_remainder(words22)]) >> CHECK_BITS
    return out


_TABLES: dict[str, np.ndarray] = {}


def own_index(segment: np.ndarray) -> np.ndarray:
    if "index" not in _TABLES:  # built from the rule once per Python worker
        _TABLES["index"] = index_table()
    return _TABLES["index"][segment].astype(np.int64)


def all_indices(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct indices of each segment and of the words one bit away."""
    near = np.stack([own_index(segment), *[own_index(segment ^ (1 << b)) for b in range(width)]], axis=1)
    near.sort(axis=1)
    first = np.ones(near.shape, dtype=bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, places = np.nonzero(first)
    return rows, near[rows, places]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, shows_all): every key of every fingerprint; the flag tells the side."""
    bits = fp.view(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    own = [own_index(p) for p in parts]
    every = [all_indices(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    out = []
    everyone = np.arange(len(fp))
    for same in range(3):
        for near in range(3):
            if same != near:
                tag = (same * 3 + near) << 40
                rows, index = every[near]
                out.append((rows, tag | parts[same][rows] << 12 | index, np.ones(len(rows), dtype=bool)))
                out.append((everyone, tag | parts[same] << 12 | own[near], np.zeros(len(fp), dtype=bool)))
    tag = 15 << 40
    rows, index = every[2]
    out.append((rows, tag | own[0][rows] << 24 | own[1][rows] << 12 | index, np.ones(len(rows), dtype=bool)))
    # The other side shows all indices of the first two segments and its own of the third.
    (r0, i0), (r1, i1) = every[0], every[1]
    many = np.bincount(r1, minlength=len(fp))
    starts = np.concatenate([[0], np.cumsum(many)[:-1]]) if len(fp) else np.zeros(0, dtype=np.int64)
    times = many[r0]
    left = np.repeat(np.arange(len(r0)), times)
    step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    rows = r0[left]
    out.append((rows, tag | i0[left] << 24 | i1[starts[rows] + step] << 12 | own[2][rows], np.zeros(len(rows), dtype=bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 4096):
            fp = batch["fp"].to_numpy(dtype=np.int64)[at : at + 4096]
            rows, key, shows = golay_keys(fp)
            yield pd.DataFrame({"key": key, "shows_all": shows, "fp": fp[rows]})


# ---- verification inside a key

def bit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def chains(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the links between ``left`` and ``right`` (distinct values each).

    Pairs are compared in blocks; a block's links are folded into the labels at once, and each
    component leaves as a chain, so there are fewer edges than nodes.
    """
    nodes = np.unique(np.concatenate([left, right]))
    parent = np.arange(len(nodes))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    for i in range(0, len(left), BLOCK):
        for j in range(0, len(right), BLOCK):
            x, y = np.nonzero(bit_distance(left[i : i + BLOCK, None], right[None, j : j + BLOCK]) <= MAX_BITS)
            for u, v in zip(at_left[i + x], at_right[j + y], strict=True):
                if u != v:
                    parent[find(u)] = find(v)
    roots = np.array([find(k) for k in range(len(nodes))])
    order = np.argsort(roots, kind="stable")
    together = roots[order[1:]] == roots[order[:-1]]
    return list(zip(nodes[order[:-1][together]], nodes[order[1:][together]], strict=True))


def link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges from rows sorted by key. A run of equal keys is carried over batch borders."""
    kept = pd.DataFrame({"key": np.zeros(0, np.int64), "shows_all": np.zeros(0, bool), "fp": np.zeros(0, np.int64)})

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        key, shows, fp = (frame[c].to_numpy() for c in ("key", "shows_all", "fp"))
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        out: list[tuple[int, int]] = []
        for a, b in zip(start[stop - start > 1], stop[stop - start > 1], strict=True):
            left, right = np.unique(fp[a:b][shows[a:b]]), np.unique(fp[a:b][~shows[a:b]])
            if len(left) and len(right) and (len(left) > 1 or len(right) > 1 or left[0] != right[0]):
                out += chains(left, right)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    for batch in batches:
        frame = pd.concat([kept, batch], ignore_index=True) if len(kept) else batch
        if len(frame):
            whole_until = np.searchsorted(frame["key"].to_numpy(), frame["key"].iloc[-1])
            kept = frame.iloc[whole_until:]
            if whole_until:
                yield edges(frame.iloc[:whole_until])
    if len(kept):
        yield edges(kept)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct.fp`` within three bits."""
    keys = distinct.select("fp").mapInPandas(key_rows, "key long, shows_all boolean, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInPandas(link_runs, "a long, b long").distinct()


# ---- groups

def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written ``rows`` (id, fp): fingerprints (fp, n, root), and components (root, component_id: the smallest id, fps)."""
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(links(distinct))
    known = cut_lineage(
        distinct.withColumn("node", label(F.col("fp"))).join(roots, "node", "left").select("fp", "low", "n", F.coalesce("root", "node").alias("root"))
    )
    lows = cut_lineage(known.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    return known.select("fp", "n", "root"), lows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links)."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    known, lows = grouped(rows)
    facts = cut_lineage(attach(known, lows, "root", "fps").select("fp", "n", "component_id"))
    return attach(rows, facts, "fp", "n").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Rows are told apart by id and text digest, so null and repeated ids lose no component; null ids
    lose against any id, and of equal ids the smallest digest stays.
    """
    sha = F.sha2(whole(F.col(text_col)), 256)
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), sha.alias("sha"))
    rows = cut_lineage(fingerprints(docs.select(row.alias("__row"), F.col(text_col)), "__row", text_col))
    keep = grouped(rows)[1].select(id_key(F.col("component_id.id")).alias("__id"), F.col("component_id.sha").alias("__sha"))
    names = ["__id", "__sha"]
    keyed = docs.withColumns({"__id": id_key(F.col(id_col)), "__sha": sha})
    return keyed.join(keep, names, "left_semi").dropDuplicates(names).drop(*names)
