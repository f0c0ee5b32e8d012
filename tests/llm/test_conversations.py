"""Conversation operators and URL filters against brute force, on random and odd rows."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from loglattice.llm import QUERIES, turn_repair, turn_trie, url_cascade

CONVERSATION = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def random_conversations(seed, convs=60, longest=14, texts=("Yes.", "No", "", "Well?", " \n", "So it is.  ", "one two three", None)):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), role, f"{rng.choice(texts) or ''}" if rng.random() < 0.9 else None))
    return rows


def brute_repair(rows):
    """Dynamic programme over whole edit strings: no bounds, no tables, no estimates."""
    out = {}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        by_conv[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, group in by_conv.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = []
        for i, (_, role, text) in enumerate(group):
            bare = text.strip(SPACE)
            if not bare:
                faults.append("blank")
            elif (role, text) in [(a, b) for _, a, b in group[:i]]:
                faults.append("duplicate")
            else:
                faults.append("" if bare[-1] in ".!?" else "truncated")
        ways = {"": (0, "", [])}  # role initials so far -> cheapest edits
        prefix = re.compile("s?(ua)*u?$")

        def add(found, shape, cost, audit, lines):
            # All that matters of the initials is their last one.
            shape = shape[-1:]
            if shape not in found or (cost, audit) < found[shape][:2]:
                found[shape] = (cost, audit, lines)

        def inserted(ways):
            found = dict(ways)
            for _ in range(3):
                for shape, (cost, audit, lines) in list(found.items()):
                    add(found, "a" if shape == "u" else "u", cost + 3, audit + "I", lines + ["assistant:" if shape == "u" else "user:"])
            return found

        for (_, role, text), fault in zip(group, faults):
            following = {}
            for shape, (cost, audit, lines) in inserted(ways).items():
                add(following, shape, cost + 4, audit + "D", lines)
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 if fault == "truncated" else 0
                if role[:1] and prefix.match(shape + role[:1]) or (shape == "a" and role[:1] == "u"):
                    if not (shape and role[:1] == "s"):
                        add(following, role[:1], cost + more, audit + "K", lines + [f"{role}:{text}"])
                to = "assistant" if shape == "u" else "user"
                add(following, to[0], cost + more + 3, audit + "R", lines + [f"{to}:{text}"])
            ways = following
        ends = [w for shape, w in inserted(ways).items() if shape in ("", "a")]
        cost, audit, lines = min(ends)
        turns = {t for t, _, _ in group if t is not None}
        initials = [r[:1] for _, r, _ in group]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize(("whole_rows", "chunk_rows"), [(4, 3), (1000, 128)])
def test_repair_matches_brute_force(spark, whole_rows, chunk_rows, monkeypatch):
    monkeypatch.setattr(turn_repair, "FAN_IN", 2)
    rows = random_conversations(chunk_rows) + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ah."), (900, None, None, None), (901, 5, "s", "x" * 70_000 + ".")]
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({"conv": F.lit(1), "fault": F.lit("x"), "pos": F.lit(2)})
    got = {r[0]: tuple(r[1:]) for r in turn_repair.repair_damaged(df, whole_rows=whole_rows, chunk_rows=chunk_rows).collect()}
    want = brute_repair(rows)
    assert got == want
    assert turn_repair.repair_damaged(df.limit(0)).count() == 0


def test_long_conversation_takes_bounded_work():
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.choice("uuaas")) for _ in range(turn_repair.WHOLE_ROWS)]
    cost, audit = turn_repair.search(rows)
    assert len(audit.replace("I", "")) == len(rows) and cost >= turn_repair.least_costs(rows)[0]


def brute_trie(rows, family=20, shared=4):
    """Nodes as tuples of (role, text), straight from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(g)] for c, g in own.items()}
    whole = {}
    for conv, group in own.items():
        h = zlib.crc32(str(conv).encode()) % shared
        whole[conv] = own.get(conv - conv % family, [])[:h] + group[h:]
    members = defaultdict(list)
    for conv, group in whole.items():
        for d in range(len(group) + 1):
            members[tuple(group[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, convs in members.items():
        subtree = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", m[-1][1])) for m in subtree if m)
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[m] for m in subtree), saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("band_turns", "block_cells"), [(512, 6), (3, 5)])
def test_trie_matches_brute_force(spark, band_turns, block_cells):
    rng = random.Random(band_turns * block_cells)
    rows = []
    for conv in rng.sample(range(400), 90):
        start = rng.choice([[], ["Hi", "Yes?"], ["Hi", "Yes?", "one two"]])
        for turn, text in enumerate(start + [rng.choice(["a b", "c", "d e f", "", None]) for _ in range(rng.randrange(1, 7))]):
            rows.append((conv, None if turn == 0 and rng.random() < 0.1 else turn, rng.choice(["user", None]) if rng.random() < 0.1 else "user", text))
    rows += [(20_000 + i, 0, "user", "the same") for i in range(30)] + [(21_000, 3, None, "w " * 30_000)]
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({"conv": F.lit(1), "band": F.lit("x"), "key": F.lit(2), "words": F.lit("w")}).repartition(5)
    got = sorted((tuple(r) for r in turn_trie.prefix_trie(df, band_turns=band_turns, block_cells=block_cells).collect()), key=repr)
    assert got == brute_trie(rows)


PAGES = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x"), (5, "http://www.example.com/en/"), (6, "http://a.www.example.com/en/1?x"), (7, "http://com"), (8, "http://x.net/es/"),
    (9, "http://x.net/es"), (10, "https://spam.example.org/a"), (11, "http://a.spam.example.org"), (12, "x://y://z/p"), (13, "http:///en/"), (None, "http://b.net/fr/" + "q" * 70_000), (4, "http://EXAMPLE.com/en/x"),
]


@pytest.mark.parametrize(("local_keys", "slice_bytes"), [(50_000, 1 << 20), (0, 8)])
def test_cascade_is_exact(spark, monkeypatch, local_keys, slice_bytes):
    monkeypatch.setattr(url_cascade, "LOCAL_KEYS", local_keys)
    rng = random.Random(7)
    urls = PAGES + [(100 + i, f"http://{'.'.join(rng.choice('abcde') for _ in range(rng.randrange(1, 5)))}/{rng.choice(['x', 'y/', 'en/z', ''])}") for i in range(600)]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "net", "/fr/"), ("allow", "", "/")]
    rules += [(rng.choice(["allow", "block"]), ".".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4))), rng.choice(["/", "/x", "", "/en/"])) for _ in range(60)]
    listed = ["spam.example.org", "d.e"]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({"host": F.lit("x"), "keys": F.lit(1), "best": F.lit(2)})
    frames = url_cascade.rule_table(spark, rules), spark.createDataFrame([(h, "") for h in listed], "host string, path string")
    got = sorted((tuple(r) for r in url_cascade.judge_urls(df, *frames, slice_bytes=slice_bytes).collect()), key=repr)
    want = []
    for page, url in urls:
        found = re.search("://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
        fits = [(len(h + p), v == "block", h.count("."), h + p) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        blocked = best[1] if best else any(host == h or host.endswith("." + h) for h in listed)
        want.append((page, host, path, best[3] if best else None, "block" if blocked else "allow"))
    assert got == sorted(want, key=repr)
    assert url_cascade.judge_urls(df.limit(0), *frames).count() == 0


@pytest.mark.parametrize("name", ["op11_url_cascade", "op12_turn_repair", "op13_turn_trie"])
def test_empty_tables(spark, tmp_path, name):
    for table in ("pages", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_trie_with_null_ids(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "user", "b"), (40, 1, "user", "a")]
    got = {(r.depth, r.conv_id): r.n_convs for r in turn_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATION)).collect()}
    assert got == {(0, 40): 2, (1, 40): 2, (2, None): 1}
