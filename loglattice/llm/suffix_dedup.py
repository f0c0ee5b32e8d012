"""Removal of repeated 200-byte strings by a distributed merge sort of suffixes.

Only suffixes at anchors are sorted. The anchor of a 200-byte window is its leftmost 32-byte string
of smallest hash, so equal windows have equal anchors at equal offsets, and one suffix stands for all
windows that share it. Steps:

1. Equal texts become one text with a count; a text with copies is repeated as a whole.
2. Anchor hashes are counted; anchors whose hash is alone cannot lie in a repeated window.
3. Each task sorts the suffixes at its remaining anchors (the hash, then up to 200 bytes), folds equal
   ones into one with several owners, and sends the run front-coded: length of the prefix shared with
   the suffix before, and the rest. Bytes left of the anchor travel along.
4. A task merges the runs of its share of hashes with a loser tree that carries common-prefix
   lengths: heads with different lengths are ordered without looking at a byte, equal lengths are
   compared from there on. The lengths come out with the merged order.
5. A window at offset o is repeated when its suffix agrees in 200 - o bytes and its left context in o
   bytes with another one: two cumulative sums over the merged order and the left order give exact
   classes. Runs of repeated windows leave as byte intervals, which are joined to the texts.

Defined results: null texts are empty. Texts under 200 bytes lose nothing. Matches never cross texts;
repeated rows lose everything (200 bytes or more). Ids may be null or repeated. An empty table stays
empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import attach, whole
from loglattice.session import cut_lineage, ensure_checkpoint_dir

WINDOW, SEED_BYTES = 200, 32
SPAN = WINDOW - SEED_BYTES + 1
# Bytes of a text handled at a time, and anchors that one merging task should get on average.
PIECE, PART_ANCHORS = 1 << 23, 50_000
# Suffixes that a sorting task gathers before it writes its runs.
RUN_SUFFIXES = 200_000


# ---- anchors

def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 32-byte string, by doubling."""
    h, factor = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    step = 1
    while step < SEED_BYTES:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = (factor * factor + 2) % (1 << 64)
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors_in(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window, hash) of every anchor of texts laid end to end, in order.

    ``ends``: where each text ends. Windows over a border are left out, so no anchor has windows of two texts.
    """
    part = np.frombuffer(data, np.uint8)
    if len(part) < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    hashes = seed_hashes(part)
    # 40 bits of hash, then the position: the smallest value is the leftmost smallest hash.
    low = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :]) & np.uint64((1 << 24) - 1)
    sizes = np.diff(ends, prepend=0)
    border = np.repeat(ends, sizes)[: len(low)]
    window = np.flatnonzero(np.arange(len(low)) + WINDOW <= border)
    at = low[window].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    return at[first], window[first], window[last], hashes[at[first]].view(np.int64)


def anchors_of(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, number of its earlier anchors, position, first window, last window, hash) for stretches of texts, in order."""
    start = 0
    while start < len(texts):
        if len(texts[start]) > PIECE:
            n = 0
            for begin in range(0, len(texts[start]) - WINDOW + 1, PIECE):
                piece = texts[start][begin : begin + PIECE + WINDOW - 1]
                at, first, last, h = anchors_in(piece, np.array([len(piece)]))
                yield start, n, at + begin, first + begin, last + begin, h
                n += len(at)
            start += 1
            continue
        stop, size = start, 0
        while stop < len(texts) and size + len(texts[stop]) <= PIECE:
            size += len(texts[stop])
            stop += 1
        ends = np.cumsum([len(t) for t in texts[start:stop]])
        at, first, last, h = anchors_in(b"".join(texts[start:stop]), ends)
        cuts = np.searchsorted(at, ends)
        begins = ends - np.diff(ends, prepend=0)
        for k, (x, y) in enumerate(zip(np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist(), strict=True)):
            if y > x:
                shift = begins[k]
                yield start + k, 0, at[x:y] - shift, first[x:y] - shift, last[x:y] - shift, h[x:y]
        start = stop


def anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = batch["key"].to_numpy()
        found = [(keys[k], n, h) for k, n, _, _, _, h in anchors_of([t.encode() for t in batch["text"]])]
        if found:
            yield pd.DataFrame({
                "key": np.repeat([f[0] for f in found], [len(f[2]) for f in found]),
                "place": np.concatenate([np.arange(n, n + len(h), dtype=np.int32) for _, n, h in found]), "h": np.concatenate([f[2] for f in found]),
            })


# ---- sorted runs

def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    end = min(len(a), len(b))
    while start + 16 <= end and a[start : start + 16] == b[start : start + 16]:
        start += 16
    while start < end and a[start] == b[start]:
        start += 1
    return start


# A suffix with what belongs to it: (hash and right bytes, left bytes, first offset, last offset, owners).
Suffix = tuple[bytes, bytes, int, int, list[tuple[int, int]]]


def pack_run(suffixes: list[Suffix]) -> bytes:
    """A sorted run, front-coded."""
    out, before = [], b""
    for text, left, low, high, owners in suffixes:
        shared = common(before, text, 0)
        out.append(struct.pack("<HHHHHI", shared, len(text) - shared, len(left), low, high, len(owners)))
        out.append(text[shared:])
        out.append(left)
        out += [struct.pack("<qq", key, at) for key, at in owners]
        before = text
    return zlib.compress(b"".join(out), 1)


def unpack_run(block: bytes) -> Iterator[tuple[int, Suffix]]:
    """(prefix shared with the suffix before, suffix)."""
    data, at, before = zlib.decompress(block), 0, b""
    while at < len(data):
        shared, rest, n_left, low, high, n = struct.unpack_from("<HHHHHI", data, at)
        at += 14
        text = before[:shared] + data[at : at + rest]
        at += rest
        left = data[at : at + n_left]
        at += n_left
        owners = [struct.unpack_from("<qq", data, at + 16 * k) for k in range(n)]
        at += 16 * n
        yield shared, (text, left, low, high, owners)
        before = text


def suffixes_of(keys: list[int], texts: list[bytes], wanted: list[np.ndarray]) -> Iterator[tuple[int, Suffix]]:
    """(hash, suffix) at the wanted anchors of each text."""
    for k, n, at, first, last, h in anchors_of(texts):
        some = wanted[k][(wanted[k] >= n) & (wanted[k] < n + len(at))] - n
        key, data = keys[k], texts[k]
        for a, low, high, value in zip(at[some].tolist(), first[some].tolist(), last[some].tolist(), h[some].tolist(), strict=True):
            yield value, (struct.pack(">q", value) + data[a : min(a, high) + WINDOW], data[low:a], a - high, a - low, [(key, a)])


def write_runs(parts: int):
    """Tasks' sorted runs as rows (part, block), equal suffixes folded."""
    def blocks(held: list[list[Suffix]]) -> pd.DataFrame:
        rows = []
        for part, run in enumerate(held):
            folded: dict[tuple, list] = {}
            for text, left, low, high, owners in run:
                folded.setdefault((text, left, low, high), []).extend(owners)
            if folded:
                rows.append((part, pack_run([(*k, folded[k]) for k in sorted(folded)])))
        return pd.DataFrame(rows, columns=["part", "block"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [[] for _ in range(parts)], 0
        for batch in batches:
            wanted = [np.sort(np.asarray(p)) for p in batch["places"]]
            for value, suffix in suffixes_of(batch["key"].tolist(), [t.encode() for t in batch["text"]], wanted):
                held[value % parts].append(suffix)
                count += 1
                if count >= RUN_SUFFIXES:
                    yield blocks(held)
                    held, count = [[] for _ in range(parts)], 0
        yield blocks(held)

    return write


# ---- merge

def merge_runs(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """All suffixes in order, each with the prefix it shares with the one before it.

    A loser tree: every node holds the run that lost there and the length of the prefix its head
    shares with the head that beat it. All heads on the winner's way compare against the last
    output, so of two heads the one that shares more with it is smaller, whatever bytes follow.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[Suffix | None] = [None] * size
    shared = [0] * size
    for r, run in enumerate(runs):
        heads[r] = next(run, (0, None))[1]
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        n = common(x, y, shared[a])
        first, second = (a, b) if n == len(x) or n < len(y) and x[n] < y[n] else (b, a)
        shared[second] = n
        return first, second

    def start(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(start(2 * node), start(2 * node + 1))
        return winner

    winner = start(1) if size > 1 else 0
    while heads[winner] is not None:
        yield shared[winner], heads[winner]
        shared[winner], heads[winner] = next(runs[winner], (0, None)) if winner < len(runs) else (0, None)
        node = (size + winner) // 2
        while node:
            winner, losers[node] = play(losers[node], winner)
            node //= 2


def repeated_windows(merged: list[tuple[int, Suffix]]) -> Iterator[tuple[int, int, int]]:
    """(text key, first byte, end) of runs of repeated windows, from one share of the merged order."""
    lcp = np.array([n - 8 for n, _ in merged], np.int64)
    lcp[:1] = -1
    new_group = lcp < SEED_BYTES
    group = np.cumsum(new_group)
    owners = np.array([len(s[4]) for _, s in merged], np.int64)
    total = np.bincount(group, weights=owners)
    keep = np.flatnonzero(total[group] > 1)
    if not len(keep):
        return
    # Whole groups are kept, so neighbours in a group stay neighbours.
    lcp, group, owners = lcp[keep], group[keep], owners[keep]
    lcp[np.concatenate([[True], group[1:] != group[:-1]])] = -1
    rows = [merged[k][1] for k in keep]
    low, high = np.array([s[2] for s in rows]), np.array([s[3] for s in rows])
    backward = [s[1][::-1] for s in rows]
    group_list = group.tolist()
    left_order = np.array(sorted(range(len(rows)), key=lambda k: (group_list[k], backward[k])))
    left_lcp = np.array([-1] + [
        common(backward[a], backward[b], 0) if group_list[a] == group_list[b] else -1 for a, b in zip(left_order[:-1].tolist(), left_order[1:].tolist(), strict=True)
    ])
    found = np.zeros((SPAN, len(rows)), bool)
    for o in range(SPAN):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some):
            right_class = np.cumsum(lcp < WINDOW - o)
            left_class = np.empty(len(rows), np.int64)
            left_class[left_order] = np.cumsum(left_lcp < o)
            both = right_class[some] * (len(rows) + 1) + left_class[some]
            _, which = np.unique(both, return_inverse=True)
            found[o, some] = np.bincount(which, weights=owners[some])[which] > 1
    edges = np.diff(np.pad(found, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    starts, stops = np.nonzero(edges.T == 1), np.nonzero(edges.T == -1)
    for k, begin, end in zip(starts[0].tolist(), starts[1].tolist(), stops[1].tolist(), strict=True):
        for key, at in rows[k][4]:
            yield key, at - (end - 1), at - begin + WINDOW


def merge_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals from rows (part, block) sorted by part; one share is held at a time."""
    part, blocks = None, []

    def done() -> pd.DataFrame:
        merged = list(merge_runs([unpack_run(b) for b in blocks]))
        return pd.DataFrame(list(repeated_windows(merged)), columns=["key", "begin", "end"])

    for batch in batches:
        for p, block in zip(batch["part"], batch["block"], strict=True):
            if p != part and blocks:
                yield done()
                blocks = []
            part = p
            blocks.append(block)
    if blocks:
        yield done()


# ---- removal

def cut_out(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    order = np.argsort(begins, kind="stable")
    kept, at, removed, spans = [], 0, 0, 0
    for begin, end in zip(begins[order].tolist(), ends[order].tolist(), strict=True):
        if begin > at or spans == 0:
            kept.append(data[at:begin])
            spans += 1
            at = begin
        if end > at:
            removed += end - at
            at = end
    kept.append(data[at:])
    return b"".join(kept), removed, spans


def removal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        batch = batch[batch["n"] == 1]  # texts with copies go as a whole
        for key, text, spans in zip(batch["sha"], batch["text"], batch["spans"], strict=True):
            pairs = np.array([(s["begin"], s["end"]) for s in spans], np.int64)
            left, removed, n = cut_out(text.encode(), pairs[:, 0], pairs[:, 1])
            out.append((key, removed, n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        yield pd.DataFrame(out, columns=["sha", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; ``kept_text`` on request."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/suffixes-{uuid.uuid4().hex}"
    texts = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = cut_lineage(texts.select("id", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    counts = cut_lineage(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.first("n_bytes").alias("bytes")))
    distinct = texts.filter(F.octet_length("text") >= WINDOW).groupBy("sha").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    distinct.withColumn("key", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    once = spark.read.parquet(folder)

    found = once.select("key", "text").mapInPandas(anchor_rows, "key long, place int, h long")
    shared = cut_lineage(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    places = cut_lineage(found.join(shared.select("h"), "h").groupBy("key").agg(F.collect_list("place").alias("places")))
    total = places.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(8, -(-total // PART_ANCHORS))
    # The texts move once for both of their uses below: the two joins read the same columns, so the exchange is shared.
    shared_columns = ["key", "sha", "n", "text"]
    runs = once.join(places, "key").select(*shared_columns, "places").mapInPandas(write_runs(parts), "part int, block binary")
    spans = runs.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(merge_parts, "key long, begin long, end long")
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    # A text with copies goes as a whole; the others lose what the merge found.
    cut = once.join(by_text, "key").select(*shared_columns, "spans").mapInPandas(
        removal, "sha string, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    partly = cut if with_text else cut.drop("kept_text")
    facts = cut_lineage(counts.join(partly, "sha", "left").withColumn("gone", (F.col("n") > 1) & (F.col("bytes") >= WINDOW)).drop("bytes"))
    joined = attach(rows, facts, "sha", "n")
    gone = F.col("gone")
    empty = hashlib.sha256(b"").hexdigest()
    out = joined.select(
        F.col("id").alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
    return out
