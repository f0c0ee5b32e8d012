"""Line-first quality rules, in DataFrame functions only and without a shuffle.

Base counts are taken on the text as it is. Then every line is judged by itself (punctuation,
navigation, boilerplate, symbols), failing lines go, and a document that loses more than
``MAX_LOST`` of its word characters, or has no line left, is rejected.

Defined results: a null or empty text has zero counts, fails the base rules and is rejected. Rows
are judged one by one, so repeated rows and ties change nothing; an empty table stays empty; other
columns, whatever their names, are kept by :func:`clean` and not read. Repeated windows are found by
64-bit hashes of eight words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import whole, words
from loglattice.session import settle

MIN_WORDS, MAX_REPEATED_PCT, WINDOW = 20, 30, 8
# A document that loses a larger part of its word characters than this is rejected.
MAX_LOST = 0.5
# Symbols, separators of menus, and phrases of page furniture.
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = ["/", "::", "<", "<<", ">", ">>", "|", "«", "»", "·", "‹", "›", "•"]
BOILERPLATE = [
    "accept cookies", "all rights reserved", "back to top", "click here to", "cookie policy", "enable javascript", "javascript is disabled",
    "log in to", "privacy policy", "read more", "share on facebook", "sign up for our newsletter", "skip to content", "terms of service",
    "terms of use", "use of cookies", "uses cookies",
]
BOILERPLATE_WORDS = 40
FRAGMENT_WORDS = 3


def paired(a: Column, step: int) -> Column:
    """A hash of every element of ``a`` (a plain column) with the one ``step`` places on."""
    return F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))


def with_windows(df: DataFrame, w: str, out: str) -> DataFrame:
    """Add ``out``: a hash of every eight-word window of the column ``w``, by doubling (1 + 1, 2 + 2, 4 + 4 words).

    Sorted with their positions, equal neighbours give the repeated windows, and the union of their
    stretches is summed in order: n log n for any text.
    """
    hashed = df.withColumn("__h2", paired(F.col(w), 1)).withColumn("__h4", paired(F.col("__h2"), 2)).withColumn("__h8", paired(F.col("__h4"), 4))
    n = F.size(w) - (WINDOW - 1)
    return hashed.withColumn(out, F.when(n > 0, F.slice("__h8", F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))


def repeats_sorted(hashes: Column) -> Column:
    """(hash, position) in order, for texts in which some hash is not alone; else empty."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def covered(pairs: Column) -> Column:
    """Words covered by windows whose hash equals a neighbour's in the sorted ``pairs`` (a plain column)."""
    found = F.filter(
        F.transform(pairs, lambda p, k: F.when((F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"])),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        F.sort_array(found), start,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"],
    )


FURNITURE = "|".join(BOILERPLATE)


def split_lines(text: Column) -> Column:
    """Per line: the line, its words, its number of symbols and of standing separators."""
    parts = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), words(line).alias("w")))
    return F.transform(
        parts,
        lambda x: F.struct(
            x["line"].alias("line"), x["w"].alias("w"), F.size(x["w"]).alias("n"), F.length(F.array_join(x["w"], "")).alias("chars"), F.regexp_count(x["line"], F.lit(SYMBOLS)).alias("symbols"),
            F.size(F.filter(x["w"], lambda p: p.isin(SEPARATORS))).alias("separators"),
        ),
    )


def line_fails(x: Column) -> Column:
    """True for a line of page furniture, given its struct of :func:`split_lines`; needs a word."""
    menu = (x["separators"] >= 2) & (x["separators"] * 4 >= x["n"])
    noise = (x["symbols"] >= 3) & (x["symbols"] * 2 > x["n"])
    fragment = (x["n"] <= FRAGMENT_WORDS) & ~x["line"].rlike(r"[.!?:;,\"')\]…。！？][\x20\x09-\x0D]*$")
    return menu | noise | fragment | ((x["n"] <= BOILERPLATE_WORDS) & F.lower(x["line"]).rlike(FURNITURE))


def total(lines: str, field: str) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus one struct column ``__verdict``: counts, base_failed, kept, clean."""
    text = whole(F.col(text_col))
    staged = docs.withColumn("__l", split_lines(text)).withColumn("__w", F.flatten(F.col("__l.w")))
    staged = with_windows(staged, "__w", "__h").withColumn("__p", repeats_sorted(F.col("__h")))
    staged = staged.withColumn("__good", F.filter("__l", lambda x: (x["n"] == 0) | ~line_fails(x)))
    staged = staged.withColumn("__worded", F.filter("__l", lambda x: x["n"] > 0)["line"])
    counts = staged.withColumn(
        "__c",
        F.struct(
            F.size("__w").cast("long").alias("n_words"), total("__l", "chars").alias("word_chars"),
            total("__l", "symbols").alias("n_symbols"),
            (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"),
            covered(F.col("__p")).alias("n_repeat_words"),
            F.array_join(F.col("__good.line"), "\n").alias("clean"), total("__good", "chars").alias("kept_chars"),
        ),
    )
    base = (F.col("__c.n_words") < MIN_WORDS) | (F.col("__c.n_repeat_words") * 100 > F.col("__c.n_words") * MAX_REPEATED_PCT)
    fine = (F.col("__c.kept_chars") > 0) & (F.col("__c.kept_chars") >= F.col("__c.word_chars") * (1 - MAX_LOST))
    verdict = F.struct("__c.*", base.alias("base_failed"), (~base & fine).alias("kept"))
    return counts.withColumn("__verdict", verdict).select(*docs.columns, "__verdict")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict per document."""
    judged = judge(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"]
    return judged.select(id_col, *[F.col(f"__verdict.{n}").alias(n) for n in names])


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The kept documents without their failing lines; ``length_col``, if there, is counted anew."""
    judged = judge(docs, text_col).withColumn("__kept", settle(F.col("__verdict.kept"))).filter("__kept")
    changed = {text_col: F.col("__verdict.clean")}
    if length_col in docs.columns:
        changed[length_col] = F.length("__verdict.clean").cast(docs.schema[length_col].dataType)
    return judged.withColumns(changed).select(*docs.columns)
