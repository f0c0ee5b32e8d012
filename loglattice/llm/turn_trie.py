"""Conversation prefix trie from padded turn-id matrices.

Every rebuilt conversation is a row of turn ids (128 bits per role and text). Rows are range-sorted by their
ids; each task pads blocks of rows to a matrix, sorts it by ``numpy.lexsort`` and accumulates column changes
against the row before with OR: where the mask of depth d is set, a node of depth d starts. ``reduceat`` over
these starts aggregates every depth. All sums are kept so that they add up: a node's one-time items (its start,
its leaf) belong to one row, for which a block needs just the last row before it and the first row behind it.
So nodes on the first and the last row of a block, which may go on in other blocks and shards, leave partial
sums that recombine by the digest of their path; all other nodes are complete where they stand.

A conversation of more than ``BAND_TURNS`` turns is cut into bands. Bands are sorted under the digest of all
turns before them and built from the deepest up; a band hands what each row adds to its ancestors to the row of
the same conversation above it. So no row or group that a task holds grows with the input: equal
conversations and hot first turns are spread over shards like others, as the id is the last sorting key.

Defined results: null roles and texts are empty; null turns come first; rows of equal turn go by role, then by the
digest of their text. Equal rows stand for turns each. A null conv_id is one conversation, keeps all its turns
(h = 0) and is passed over by the smallest member and by the list of ends; a node of no other member has a null
conv_id. An empty table has no nodes, no root either. Other columns are not read. The digest of a node's ends is
taken over ready-made runs of its ids in order, one task a node, as a digest demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import id_key, word_count
from loglattice.operators.ranking import number_rows
from loglattice.session import cut_lineage, lookup_join, written

BAND_TURNS = 512
# Cells of a block's matrix (16 bytes each).
BLOCK_CELLS = 1 << 20
SHARED_TURNS, FAMILY = 4, 20
NO_ID = (1 << 63) - 1


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv, position from 0, two ids of role and text, words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(3), said).alias("a"), F.xxhash64(F.lit(5), said).alias("b"), word_count(text).alias("words"),
    ).withColumn("ck", id_key(F.col("conv")))
    numbered = number_rows(rows, ["ck"], [F.col("turn").asc_nulls_first(), "role", "a", "b"], "pos")
    return numbered.select("ck", "conv", (F.col("pos") - 1).cast("long").alias("pos"), "a", "b", "words")


def rebuilt(rows: DataFrame, family: int = FAMILY, shared: int = SHARED_TURNS) -> tuple[DataFrame, DataFrame]:
    """Conversations (ck, conv) and their rebuilt turns: the first h turns come from the family's first conversation.

    At most ``family`` conversations ask for the few first turns of one, so no key of these joins is hot.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    own = rows.groupBy("ck", "conv").agg(F.count(F.lit(1)).alias("n"))
    convs = own.select("ck", "conv", F.coalesce(h, F.lit(0)).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    sizes = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n")).filter("base IS NOT NULL")
    convs = written(convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "convs")
    heads = rows.filter((F.col("pos") < shared - 1) & F.col("conv").isNotNull() & (F.col("conv") % family == 0)).select(F.col("conv").alias("base"), "pos", "a", "b", "words")
    first = convs.filter("taken > 0").select("ck", "conv", "base", "taken").join(heads, "base").filter("pos < taken")
    # Where the family gives fewer than h turns, a conversation's own turns move up by what is missing.
    kept = rows.withColumn("h", F.coalesce(h, F.lit(0))).filter("pos >= h")
    shifts = convs.filter("taken <> h").select("ck", "taken")
    kept = lookup_join(kept, written(shifts, "shifts"), "ck").withColumn("pos", F.col("pos") - F.col("h") + F.coalesce("taken", "h"))
    columns = ["ck", "conv", "pos", "a", "b", "words"]
    return convs.select("ck", "conv"), first.select(*columns).unionByName(kept.select(*columns))


def bands(convs: DataFrame, rows: DataFrame, band_turns: int) -> tuple[DataFrame, int]:
    """Rows (ck, conv, band, deeper, p0, p1, q0, q1, ids, words) of at most ``band_turns`` turns, and the number of bands.

    p digests all bands before the row's, q its own as well: 128 bits, summed by exclusive or of marked digests.
    """
    longest = rows.agg(F.max("pos")).first()[0]
    count = 1 if longest is None else longest // band_turns + 1
    turn = F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words")))
    packed = rows.groupBy("ck", F.floor(F.col("pos") / band_turns).cast("long").alias("band")).agg(turn.alias("t"))
    packed = packed.select("ck", "band", F.flatten(F.transform("t", lambda t: F.array(t.a, t.b))).alias("ids"), F.transform("t", lambda t: t.words).alias("words"))
    tops = convs.withColumn("band", F.lit(0).cast("long")).join(packed, ["ck", "band"], "left")
    if count > 1:
        tops = tops.unionByName(packed.filter("band > 0").join(convs, "ck"))
    empty = F.expr("CAST(array() AS array<bigint>)")
    full = tops.withColumns({"ids": F.coalesce("ids", empty), "words": F.coalesce("words", empty), "conv": F.coalesce("conv", F.lit(NO_ID))})
    if count == 1:
        return full.withColumns({"deeper": F.lit(False), **{name: F.lit(0).cast("long") for name in ("p0", "p1", "q0", "q1")}}), 1
    full = full.withColumns({f"m{i}": F.xxhash64(F.lit(seed), "band", "ids") for i, seed in enumerate((7, 13))})
    order = Window.partitionBy("ck").orderBy("band")
    before, through = (order.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    marks = {f"p{i}": F.coalesce(F.bit_xor(f"m{i}").over(before), F.lit(0).cast("long")) for i in range(2)}
    marks |= {f"q{i}": F.bit_xor(f"m{i}").over(through) for i in range(2)}
    return full.withColumns({**marks, "deeper": F.lead("band").over(order).isNotNull()}).drop("m0", "m1"), count


SORTED = ["p0", "p1", "ids", "deeper", "conv"]
NODES = "key string, parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, first long, ends string, ends_sha256 string"
ABOVE = "ck string, leaves long, saved long, children long"
Row = tuple[tuple[int, int], np.ndarray]  # digest of the bands before, ids


def shared_depth(a: Row | None, b: Row | None) -> int:
    """Depth of the deepest node that two rows have in common; -1 where they have none in this band."""
    if a is None or b is None or a[0] != b[0]:
        return -1
    n = min(len(a[1]), len(b[1])) // 2
    differs = np.flatnonzero((a[1][: 2 * n] != b[1][: 2 * n]).reshape(n, 2).any(axis=1))
    return int(differs[0]) if len(differs) else n


def top_key(marks: tuple[int, int], band: int) -> str:
    return hashlib.blake2b(np.array([*marks, band], dtype=np.int64).tobytes(), digest_size=16).hexdigest()


def path_keys(row: Row, band: int) -> list[str]:
    """Keys of the nodes along a row, from the band's top."""
    keys, digest = [top_key(row[0], band)], hashlib.blake2b(np.array([*row[0], band, -1], dtype=np.int64).tobytes(), digest_size=16)
    for d in range(len(row[1]) // 2):
        digest.update(row[1][2 * d : 2 * d + 2].tobytes())
        keys.append(digest.hexdigest())
    return keys


def _list_column(batch: pa.RecordBatch, name: str, width: int, sizes: np.ndarray) -> np.ndarray:
    """A column of lists as a matrix, padded with zeros."""
    matrix = np.zeros((len(sizes), width), dtype=np.int64)
    matrix[np.arange(width) < sizes[:, None]] = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return matrix


class Block:
    """The nodes of consecutive sorted rows, between the row before and the row behind them."""

    def __init__(self, batch: pa.RecordBatch, band: int, band_turns: int):
        self.band, self.band_turns, self.n = band, band_turns, batch.num_rows
        number = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("p0", "p1", "q0", "q1", "conv", "deeper", "leaves", "saved", "children")}
        depths = np.diff(batch.column("words").offsets.to_numpy()).astype(np.int64)
        self.width = int(depths.max(initial=0))
        ids, words = _list_column(batch, "ids", 2 * self.width, 2 * depths), _list_column(batch, "words", self.width, depths)
        inside = np.arange(self.width) < depths[:, None]
        keys = [number["conv"], number["deeper"]]
        for d in range(self.width - 1, -1, -1):
            keys += [ids[:, 2 * d + 1], ids[:, 2 * d], inside[:, d]]
        order = np.lexsort([*keys, number["p1"], number["p0"]])
        self.number = {c: v[order] for c, v in number.items()}
        self.depths, self.ids, self.ck = depths[order], ids[order], batch.column("ck").take(pa.array(order))
        self.real = np.ones((self.n, self.width + 1), dtype=bool)
        self.real[:, 1:] = inside[order]
        self.words = np.zeros((self.n, self.width + 1), dtype=np.int64)
        self.words[:, 1:] = words[order]
        # A path changes at a depth where a column at or above it does; padding differs from any turn.
        changed = np.ones((self.n, self.width + 1), dtype=bool)
        changed[1:, 0] = (self.number["p0"][1:] != self.number["p0"][:-1]) | (self.number["p1"][1:] != self.number["p1"][:-1])
        turn = (self.ids[1:] != self.ids[:-1]).reshape(self.n - 1, self.width, 2).any(axis=2)
        changed[1:, 1:] = turn | (self.real[1:, 1:] != self.real[:-1, 1:])
        self.changed = np.logical_or.accumulate(changed, axis=1)

    def row(self, i: int) -> Row:
        return (int(self.number["p0"][i]), int(self.number["p1"][i])), self.ids[i, : 2 * self.depths[i]]

    def tables(self, before: Row | None, behind: Row | None) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Nodes (or their parts) of this block, and what each row adds to the nodes above the band."""
        n, number, head, tail = self.n, self.number, self.row(0), self.row(self.n - 1)
        from_before, to_behind = shared_depth(before, head), shared_depth(tail, behind)
        starts = self.changed & self.real
        starts[0, : from_before + 1] = False
        ends_row = number["deeper"] == 0
        # The last row of its own deepest node makes it a leaf, as longer rows and deeper ones sort behind.
        last = np.append(self.changed[np.arange(1, n), self.depths[:-1]], to_behind < self.depths[-1])
        leaf = (last & ends_row).astype(np.int64) + number["leaves"]
        counted = self.words * ~starts  # one occurrence of each node's text is not saved
        gain = number["saved"] + counted.sum(axis=1)
        firsts = starts[:, 1].astype(np.int64) if self.width else np.zeros(n, dtype=np.int64)
        above = pa.record_batch([self.ck, pa.array(leaf), pa.array(gain), pa.array(firsts)], names=["ck", "leaves", "saved", "children"])
        paths = {0: path_keys(head, self.band), n - 1: path_keys(tail, self.band)}
        out: dict[str, list] = {part.strip().split(" ")[0]: [] for part in NODES.split(",")}
        over = None
        for d in range(self.width + 1):
            begin = np.flatnonzero(self.changed[:, d])
            end = np.append(begin[1:], n)
            here = {"begin": begin, "end": end, "owner": np.repeat(np.arange(len(begin)), end - begin), "least": np.minimum.reduceat(number["conv"], begin)}
            if d:
                gain = gain - counted[:, d - 1]
            below = starts[:, d + 1].astype(np.int64) if d < self.width else np.zeros(n, dtype=np.int64)
            below = below + np.where(self.depths == d, number["children"], 0)
            sums = {"n_convs": np.ones(n, dtype=np.int64), "n_children": below, "n_leaves": leaf, "saved_tokens": gain}
            sums = {name: np.add.reduceat(values, begin) for name, values in sums.items()}
            stop = np.add.reduceat(((self.depths == d) & ends_row).astype(np.int64), begin)
            if d or not self.band:
                for k in np.flatnonzero(self.real[begin, d]).tolist():
                    s, e = int(begin[k]), int(end[k])
                    key = paths[0][d] if s == 0 and d <= from_before else paths[n - 1][d] if e == n and d <= to_behind else None
                    if d == self.band_turns and not ends_row[e - 1]:
                        key = top_key((int(number["q0"][e - 1]), int(number["q1"][e - 1])), self.band + 1)
                    elif d == self.band_turns and key is not None:
                        key = top_key((int(number["q0"][s]), int(number["q1"][s])), self.band + 1)
                    parent = parent_conv = None
                    if d == 1 and self.band:
                        parent = top_key((int(number["p0"][s]), int(number["p1"][s])), self.band)
                    elif d:
                        o = over["owner"][s]
                        if over["begin"][o] == 0 and d - 1 <= from_before:
                            parent = paths[0][d - 1]
                        elif over["end"][o] == n and d - 1 <= to_behind:
                            parent = paths[n - 1][d - 1]
                        else:
                            parent_conv = int(over["least"][o])
                    members = number["conv"][s : s + stop[k]]
                    ends = ",".join(map(str, members[members != NO_ID].tolist()))
                    out["key"].append(key)
                    out["parent"].append(parent)
                    out["conv_id"].append(int(here["least"][k]))
                    out["depth"].append(self.band * self.band_turns + d)
                    out["parent_conv_id"].append(parent_conv)
                    for name, values in sums.items():
                        out[name].append(int(values[k]))
                    out["first"].append(int(members[0]) if ends else None)
                    out["ends"].append(ends if key is not None and ends else None)
                    out["ends_sha256"].append(hashlib.sha256(ends.encode()).hexdigest() if key is None else None)
            over = here
        kinds = {"string": pa.string(), "long": pa.int64()}
        types = dict(part.strip().split(" ") for part in NODES.split(","))
        return pa.record_batch([pa.array(v, kinds[types[c]]) for c, v in out.items()], names=list(out)), above


def _row_of(batch: pa.RecordBatch, i: int) -> Row:
    return (batch.column("p0")[i].as_py(), batch.column("p1")[i].as_py()), np.array(batch.column("ids")[i].as_py(), dtype=np.int64)


def border_rows(shards: DataFrame) -> dict[int, tuple[Row, Row]]:
    """First and last row of each non-empty shard: two rows of bounded length per task."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first if first is not None else batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            for place, row in enumerate((first, last)):
                names = ["shard", "p0", "p1", "ids", "place"]
                yield pa.record_batch([*[row.column(c) for c in names[:4]], pa.array([place])], names=names)

    rows = shards.select("shard", "p0", "p1", "ids").mapInArrow(ends, "shard int, p0 long, p1 long, ids array<long>, place long").collect()
    found = {(r.shard, r.place): ((r.p0, r.p1), np.array(r.ids, dtype=np.int64)) for r in rows}
    return {shard: (found[shard, 0], found[shard, 1]) for shard, place in found if place == 0}


def _blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose padded matrix stays within ``cells``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        widest = max(1, int(np.diff(batch.column("words").offsets.to_numpy()).max()))
        step = max(1, cells // widest)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def band_tables(shards: DataFrame, band: int, band_turns: int, block_cells: int, what: int) -> DataFrame:
    """Of one band's shards the nodes (``what`` 0) or the sums for the band above (1)."""
    borders = border_rows(shards)
    names = sorted(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = before = place = None
        for block in _blocks(batches, block_cells):
            if held is None:  # all rows of a task are of one shard
                place = names.index(block.column("shard")[0].as_py())
                before = borders[names[place - 1]][1] if place else None
            else:
                yield held.tables(before, _row_of(block, 0))[what]
                before = held.row(held.n - 1)
            held = Block(block, band, band_turns)
        if held is not None:
            yield held.tables(before, borders[names[place + 1]][0] if place + 1 < len(names) else None)[what]

    return shards.mapInArrow(run, (NODES, ABOVE)[what])


def _digests(parts: DataFrame) -> DataFrame:
    """SHA-256 over the runs of ids of each key, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            for following, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if following != key:
                    if key is not None:
                        yield pa.record_batch([[key], [sha.hexdigest()]], names=["key", "sha"])
                    key, sha = following, hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
        if key is not None:
            yield pa.record_batch([[key], [sha.hexdigest()]], names=["key", "sha"])

    return parts.repartition("key").sortWithinPartitions("key", "first").select("key", "ends").mapInArrow(run, "key string, sha string")


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", family: int = FAMILY, shared: int = SHARED_TURNS, band_turns: int = BAND_TURNS, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations."""
    convs, rows = rebuilt(written(turns(conversations, id_col), "turns"), family, shared)
    cut, count = bands(convs, written(rows, "rebuilt"), band_turns)
    cut = written(cut, "bands") if count > 1 else cut
    above, found = None, None
    for band in range(count - 1, -1, -1):
        mine = cut.filter(F.col("band") == band) if count > 1 else cut
        sums = ["leaves", "saved", "children"]
        mine = mine.join(above, "ck", "left") if above is not None else mine.withColumns({c: F.lit(0).cast("long") for c in sums})
        mine = mine.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in sums})
        shards = cut_lineage(mine.repartitionByRange(*SORTED).sortWithinPartitions(*SORTED).withColumn("shard", F.spark_partition_id()))
        nodes = band_tables(shards, band, band_turns, block_cells, 0)
        found = nodes if found is None else found.unionByName(nodes)
        above = written(band_tables(shards, band, band_turns, block_cells, 1), "above") if band else None
    found = written(found, "nodes")
    parts = found.filter("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    # The parts of a node agree in depth and parent.
    joined = parts.groupBy("key").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), *sums)
    joined = joined.join(_digests(parts.filter("ends IS NOT NULL")), "key", "left")
    keyed = written(joined.withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))).drop("sha"), "keyed")
    columns = ["parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = found.filter("key IS NULL").select(*columns).unionByName(keyed.select(*columns))
    every = lookup_join(every, keyed.select(F.col("key").alias("parent"), F.col("conv_id").alias("above")), "parent")
    known = {c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("conv_id", "parent_conv_id")}
    return every.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).withColumns(known).select(
        F.col("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
