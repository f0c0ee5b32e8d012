"""Operators against brute force, round trips, library results and held-out labels, and odd inputs."""

import hashlib
import os
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from loglattice.llm import QUERIES, SQL
from loglattice.llm import chunk_dedup, curriculum, html_extract, line_rules, piece_codec, simhash_golay, suffix_dedup, surrogates, token_transducer, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "The lazy dog sleeps. " * 4000
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "One Two three.\nÉa É", "a"), (4, "One Two three.\nÉa É", "a"), (5, "one two THREE.\nÉa É", "b"),
    (None, "one two three.\nÉa É", "b"), (None, None, None), (6, LONG, "b"), (7, LONG.upper(), "b"), (8, "a@b.example.com and " * 30, "a"), (9, "x" * 5000, "c"),
]


def frame(spark, rows=ODD):
    """Odd rows, with columns that clash with names used inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"id": F.lit("x"), "n": F.lit(1), "key": F.lit(2), "row": F.lit(3), "sha": F.lit("s"), "w": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


def texts_of(df):
    return [(r[0], r[1] or "") for r in df.select("doc_id", "text").collect()]


OPERATORS = {
    "op1": suffix_dedup.remove_repeats, "op2": piece_codec.encode_decode, "op3": chunk_dedup.exact_dedup, "op5": curriculum.mixture,
    "op6": surrogates.pseudonymize, "op7": token_transducer.token_counts, "op9": simhash_golay.near_duplicates, "op10": line_rules.quality,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_rows(spark, name):
    df = frame(spark)
    got = OPERATORS[name](df).collect()
    assert len(got) == len(ODD) and Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert OPERATORS[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [line_rules.clean, chunk_dedup.keep_one, simhash_golay.keep_one, curriculum.mix])
def test_stages_keep_columns(spark, stage):
    df = frame(spark)
    assert stage(df).columns == df.columns and stage(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)


def brute_repeats(rows):
    seen = Counter(b[p : p + 200] for _, t in rows for b in [t.encode()] for p in range(len(b) - 199))
    out = []
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(150, 700))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(base)[rnd.randint(0, 90) :] + "xyz"[: rnd.randint(0, 3)] for _ in range(rnd.randint(0, 4)))) for i in range(120)]
    rows += [(200, "a" * 900), (201, "a" * 199), (202, "a" * 200), (203, ""), (204, "ab" * 400), (205, base[0]), (205, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == brute_repeats(rows)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()) == brute_repeats(texts_of(real))
    # Pieces of a long text give the anchors of the whole.
    text = "".join(rnd.choice("ab c") for _ in range(9000)).encode()
    whole = {(int(a), int(h)) for _, _, at, _, _, hs in suffix_dedup.anchors_of([text]) for a, h in zip(at, hs)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert {(int(a), int(h)) for _, _, at, _, _, hs in suffix_dedup.anchors_of([text]) for a, h in zip(at, hs)} == whole


def test_merge_of_front_coded_runs():
    rnd = random.Random(1)
    for runs in (0, 1, 2, 5, 9):
        lists = [sorted("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))).encode() for _ in range(rnd.randint(0, 30))) for _ in range(runs)]
        packed = [suffix_dedup.unpack_run(suffix_dedup.pack_run([(t, b"l", 0, 1, [(1, 2)]) for t in texts])) for texts in lists]
        merged = list(suffix_dedup.merge_runs(packed))
        assert [s[0] for _, s in merged] == sorted(t for texts in lists for t in texts)
        for (_, a), (n, b) in zip(merged, merged[1:]):
            assert n == len(os.path.commonprefix([a[0], b[0]]))


def test_piece_codec_is_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.resolve(piece_codec.MODEL))
    rnd = random.Random(3)
    marks = [" ", "  ", "a", "the", "\n", "\n\n", "\t", "▁", "é", "ﬁ", "中文", "</s>", "<0x0A>", "\x00", "😀", "　", "."]
    rows = [(i, "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 9)))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = Counter()
    for d, t in texts_of(df):
        ids = [*lib.encode(t), lib.eos_id()]
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in piece_codec.encode_decode(df).collect()) == want
    table = piece_codec.WordTable(piece_codec.MODEL, limit=3)  # a table that starts afresh all the time
    for _, t in rows[:200]:
        marked = piece_codec.marked_words(t)
        table.learn([marked])
        assert table.segment(marked)[0] == " ".join(map(str, lib.encode(t)))


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_transducer.resolve(token_transducer.TOKENIZER))
    rnd = random.Random(3)
    marks = [" ", "  ", "a", "the", "\n", "\r\n", "'", "'s", "'ll", "'d", "'l", "é", "中文", "12", "<|endoftext|>", "\x00", "😀", "　", "...", "\x1c", "\x85", "²", "S", "nti"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 0x2FFF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(0, 12))) for _ in range(1000)]
    texts += [t for _, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_transducer.token_counts(df).collect()}
    want = lib.encode_batch(texts, add_special_tokens=False)
    assert got == {i: (len(t.encode()), len(e.ids)) for i, (t, e) in enumerate(zip(texts, want))}


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall(text.translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_match_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    rnd = random.Random(2)
    rows = [(i, t) for i, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet"))]
    base = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(3)]
    rows += [(10_000 + i, " ".join(w if rnd.random() > 0.004 else "z" for w in rnd.choice(base).split())) for i in range(150)] + [(20_000, None), (20_001, "")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_golay.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {d: brute_fingerprint(t or "") for d, t in rows}
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(fps)
    links = 0
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                links += a >= 10_000
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert links > 50
    assert got == {d: (f"{f:016x}", find(d)) for d, f in fps.items()}


def test_golay_keys_meet_within_three_bits():
    assert (simhash_golay.error_table() >= 0).all()
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 400)
    b = a.view(np.uint64).copy()
    for k in range(len(b)):
        for bit in rng.choice(64, k % 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    sides = []
    for fps in (a, b.view(np.int64)):
        keys = {}
        for row, key, shows in zip(*simhash_golay.golay_keys(fps)):
            keys.setdefault((row, bool(shows)), set()).add(key)
        sides.append(keys)
    assert all(sides[0][k, True] & sides[1][k, False] for k in range(len(a)))


def test_weak_chunk_hashes_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(["a b.", "c d.", "a b.", "x" * 3000, "y" * 3000, "x" * 3000, "a. " * 300, "b. " * 300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = {r.doc_id: (r.keep_id, r.group_size) for r in chunk_dedup.exact_dedup(df, digest=lambda c: F.length(c).cast("long")).collect()}
    assert weak == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (5, 2), 4: (4, 1), 5: (5, 2), 6: (6, 1), 7: (7, 1)}
    assert weak == {r.doc_id: (r.keep_id, r.group_size) for r in chunk_dedup.exact_dedup(df).collect()}


def test_mix_takes_what_was_assigned(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = curriculum.mixture(df).collect()
    stream = curriculum.mix(df).select("doc_id", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("k")).groupBy("doc_id").agg(F.sum("k").alias("k"))
    assert {r.doc_id: r.k for r in stream.collect()} == {r.doc_id: r.taken for r in plan if r.taken}
    assert all(r.taken <= 2 * r.size for r in plan)


def test_surrogates(spark):
    text = "Mail ann.b@mail7.example.com, bob@mail7.example.com or +1 (632) 555-4827, 66.87.218.26 card 4111111111111111. Mrs. Smith met Mr. John Smith. Herr Иванов"
    df = spark.createDataFrame([(1, text), (2, "again ann.b@mail7.example.com"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.pseudonymize(df).collect()}
    assert got[3].text == "nothing here" and got[4].text is None and got[1].n_entities == 8
    for old in ("ann.b", "mail7", "555-4827", "66.87.218.26", "4111111111111111", "Smith", "Иванов"):
        assert old not in got[1].text
    assert got[2].text.removeprefix("again ") in got[1].text
    hosts = re.findall(r"@(\S+?)[ ,]", got[1].text)
    assert hosts[0] == hosts[1] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)
    woman, man = re.search(r"Mrs\. (\w+) met Mr\. \w+ (\w+)\.", got[1].text).groups()
    assert woman == man
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('a', id % 700, '@x.io and 10.0.', id % 7, '.', id % 250) AS text")
    entities = many.select(F.explode(surrogates.found_in(F.col("text"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    mapped = surrogates.assign_surrogates(entities.withColumn("kind", surrogates.kind_of(F.col("entity"))).select("kind", "entity", "n")).collect()
    assert len({r.surrogate for r in mapped}) == len(mapped) and not {r.surrogate for r in mapped} & {r.entity for r in mapped}


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html as h

    for r in html_extract.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = [(1, None, None), (2, "u", ""), (3, "u", "<script>x"), (4, "u", "<div class='comments'><p>so it is said by the one and the other, and that is that for now</p></div>"), (None, None, "<p"),
           (5, "u", "<body><main><h1>Title</h1><p>It is the text of the page and there is more of it to be read here.</p><nav>a</nav></main></body>")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == got[3] == got[4] == "" and got[5].startswith("Title\nIt is the text")


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y, s = got.toxic.to_numpy(), got.score.to_numpy()
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert np.mean(pairs) > 0.8
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    odd = toxicity.score(frame(spark), empty).collect()
    assert len(odd) == len(ODD) and all(r.score == 0.0 for r in odd)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns
    again = piece_codec.encode_decode(step)
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in out.select(*again.columns).collect())


P8 = "<p>The story of the river and the town that grew on its banks is long, and it is told by many of the people who live there.</p>"
T8 = P8[3:-4]


@pytest.mark.parametrize(("page", "text"), [
    (f"<body class='has-sidebar menu-open'><main class='with-sidebar'>{P8}</main></body>", T8),
    (f"<div class='sidebar'>{P8}</div><article class='post has-share'><div class='entry-header'><h1>A title</h1></div>{P8}</article>", f"A title\n{T8}"),
    (f"<article>{P8}<p class='ad'>Buy the best of the best and it is for you now.</p></article>", T8),
    (f"<article>{P8}</article><section id='comments'><article class='comment'>{P8}</article></section>", T8),
    (f"<article>{P8}</article><article class='comment'>{P8}</article>", T8),
    (f"<article>{P8}<div hidden>{P8}</div><div style='display: none'>{P8}</div><p title='hidden'>It is the last of them.</p></article>", f"{T8}\nIt is the last of them."),
])
def test_html_marks_of_elements(page, text):
    assert html_extract.main_text(page) == text


def test_near_dedup_keeps_null_and_repeated_ids(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"]
    a, b, c, d, e, f, g = texts
    # Null ids and repeated ids with different texts; copies of them under other ids.
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, d), (None, e), (5, e), (None, f), (9, f), (9, g), (4, g)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    kept = simhash_golay.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, a), (None, b), (7, c), (3, d), (5, e), (9, f), (4, g)])


def test_mixing_stage_keeps_documents_whole(spark):
    import corpus_pipeline

    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r for r in curriculum.mixture(df).collect() if r.taken}
    texts = dict(texts_of(df))
    stream = texts_of(corpus_pipeline.mixing(spark, df, SF))
    assert any(r.taken % r.size for r in plan.values()) and all(t == texts[d] for d, t in stream)
    assert Counter(d for d, _ in stream) == {d: -(-r.taken // r.size) for d, r in plan.items()}


def test_entities_of_letters_only_and_whole_names(spark):
    token, hexes, aws = "sk_" + "abcdefghijklmnopqrst", "abcdefabcdefabcdefabcdefabcdefab", "AKIA" + "ABCDEFGHIJKLMNOP"
    places = ["{}", "a\n{}", "a\t{}", "`{}`", "[{}]", "a,{} b", "key={} 1", "a ({})", "x/{}"]
    rows = [p.format(x) for x in (token, hexes, aws, "xoxb-" + "q" * 20) for p in places]
    rows += [f"{t} {n} said so." for t, n in [("Mr.", "McDonald"), ("Mr.", "John F. Kennedy"), ("Frau", "Müller-Lenz"), ("Mrs.", "O'Brien"), ("Mr.", "J. R. Tolkien"), ("Mme", "Anne-Marie D’Artagnan"), ("Mr.", "John F Kennedy"), ("Herr", "SCHMIDT")]]
    rows += ["Mr. McDonald's cat and Mr. McDonald. The end.", "desk_abcdefghijklmnopqrst"]
    got = [(r.doc_id, r.text, r.n_entities) for r in surrogates.pseudonymize(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [n for _, _, n in got] == [1] * (len(rows) - 2) + [2, 0]
    new = [t for _, t, _ in got]
    for old in (token, hexes, aws, "qqqq", "McDonald", "Donald", "Kennedy", "Lenz", "ller", "Brien", "Tolkien", "Artagnan", "Marie", "SCHMIDT"):
        assert not any(old in t for t in new[:-1]), old
    assert len({re.search("sk_[a-z]{20}", t)[0] for t in new[: len(places)]}) == 1
    name, again = re.fullmatch(r"Mr\. (\w+)'s cat and Mr\. (\w+)\. The end\.", new[-2]).groups()
    assert name == again and re.fullmatch(r"Mr\. \w+ \p{Lu}\. \w+ said so\.".replace(r"\p{Lu}", "[A-Z]"), new[len(places) * 4 + 1])
    assert re.fullmatch(r"Mrs\. [A-Z]'[A-Z][a-z]{4} said so\.", new[len(places) * 4 + 3]) and new[-1] == rows[-1]


@pytest.mark.parametrize(("page", "text"), [
    (f"<html><head><title>A title</title><meta charset=utf-8><style>p {{}}</style><body><article>{P8}</article></body></html>", T8),
    (f"<head><title>A title</title><article>{P8}</article>", T8),
    (f"<head><title>A title<article>{P8}</article>", T8),
    (f"<head><script>let a = '<p>'</script></head><body><article>{P8}</article>", T8),
    *[(f"<body><article><{tag}>{P8}</article>", T8) for tag in ("object", "iframe", "select", "noscript", "svg", "template", "textarea")],
    (f"<article>{P8}<noscript>{P8}</noscript><svg/><object data='x'>{P8}</object>{P8}<select>{P8}", f"{T8}\n{T8}\n{T8}"),
    (f"<article>{P8}<script>{P8}</article>", T8),
    (f"<article>{P8}<script src='a>b'>{P8}</script>", T8),
])
def test_html_elements_without_end(page, text):
    assert html_extract.main_text(page) == text


def test_html_many_open_elements_take_linear_time():
    import time

    start = time.perf_counter()
    assert html_extract.main_text("<article>" + "<object>" * 200_000 + P8) == T8
    assert time.perf_counter() - start < 20
