"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are columns computed in the JVM: densities of a fixed and of a learned lexicon, insults
near a second person, capitals, punctuation and obfuscation rates. The lexicon, the trees and the
calibration are fitted on a bounded sample of labelled rows (``MAX_LABELLED``, the first ones in
the order of a digest of the id); trees and lexicon take one part of it, calibration another. All
rows are then scored whole. The score is the calibrated probability with a little of the raw one, so
that equal steps of the calibration keep an order.

Defined results: null and empty texts have all features 0 and get the score of such a text. A row
without an id is never used for training. Labels that are null are left out; without both labels
in the training part every score is the share of label 1 (0 without any). Rows are scored one by
one, repeated rows alike; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import whole
from loglattice.session import cut_lineage

# Rows of labels used at most; the sample and the learned lexicon are broadcast.
MAX_LABELLED = 20_000
MAX_TERMS, MIN_DOCS, MIN_LOG_ODDS = 300, 8, 1.5
THRESHOLD, RAW_PART, NEAR = 0.3, 0.02, 6
TREES, DEPTH = 20, 4
# Insults and second persons of four languages, and look-alike characters.
INSULTS = (
    "idiot idiots idiotic moron morons stupid dumb fool clown loser losers trash garbage scum worthless pathetic disgusting filthy vermin ugly jerk bastard bitch "
    "idioten dumm dummkopf trottel depp arschloch abschaum wertlos widerlich schwein versager "
    "imbécil idiota estúpido estúpida basura asqueroso asquerosa inútil escoria payaso cabrón "
    "imbécile crétin crétine connard connasse salaud ordure dégoûtant abruti abrutie débile raclure"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur du dein deine deinen dich dir ihr euch euer tú tu tus ti te usted ustedes vosotros toi ton ta tes vous votre vos"
).split()
LOOKS, LIKE = "013457@$!|*+", "oieastasilit"
FEATURES = ["lexicon", "learned", "learned_kinds", "hidden", "near_you", "you", "capitals", "shouted", "exclaimed", "asked", "symbols", "mixed", "repeated", "length"]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def unmasked(text: Column) -> Column:
    """Look-alike characters back to letters, for texts that have some between letters."""
    return F.translate(F.lower(text), LOOKS, LIKE)


MASKED = r"\p{L}[0-9@$!|*+]+\p{L}"


def rate(count: Column, n: Column) -> Column:
    return count / F.greatest(n, F.lit(1))


def with_features(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Add the feature columns for the text column ``text`` (not null)."""
    known, learned = [*INSULTS], terms or [""]
    t = F.col(text)
    hit = lambda w: w.isin(*known) | w.isin(*learned)
    staged = docs.withColumn("__t", tokens(t)).withColumn("__n", F.size("__t"))
    staged = staged.withColumn("__hits", F.filter(F.transform("__t", lambda w, i: F.when(hit(w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull()))
    staged = staged.withColumn("__masked", F.regexp_count(t, F.lit(MASKED)))
    hidden = F.size(F.filter(tokens(unmasked(t)), hit)) - F.size("__hits")
    upper, letters = F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}"))
    around = lambda x: F.slice(F.col("__t"), F.greatest(x["i"] - NEAR + 1, F.lit(1)), 2 * NEAR)
    n = F.col("__n")
    return staged.withColumns({
        "lexicon": rate(F.size(F.filter("__hits", lambda x: x["w"].isin(*known))), n),
        "learned": rate(F.size(F.filter("__hits", lambda x: x["w"].isin(*learned))), n),
        "learned_kinds": F.size(F.array_distinct(F.col("__hits.w"))).cast("double"),
        "hidden": rate(F.when(F.col("__masked") > 0, F.greatest(hidden, F.lit(0))).otherwise(0), n),
        "near_you": rate(F.size(F.filter("__hits", lambda x: F.exists(around(x), lambda w: w.isin(*SECOND_PERSON)))), n),
        "you": rate(F.size(F.filter("__t", lambda w: w.isin(*SECOND_PERSON))), n),
        "capitals": rate(upper, letters),
        "shouted": rate(F.regexp_count(t, F.lit(r"(?<!\p{L})\p{Lu}{3,}(?!\p{L})")), n),
        "exclaimed": rate(F.regexp_count(t, F.lit("!")), n),
        "asked": rate(F.regexp_count(t, F.lit(r"\?")), n),
        "symbols": rate(F.regexp_count(t, F.lit(r"[#$%&*@|<>]")), n),
        "mixed": rate(F.col("__masked"), n),
        "repeated": rate(F.regexp_count(t, F.lit(r"(\p{L})\1{2,}")), n),
        "length": F.log1p(n.cast("double")),
    }).withColumns({c: F.col(c).cast("double") for c in FEATURES}).drop("__t", "__n", "__hits", "__masked")


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, usable: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, by the order of a digest of the id; written, so all steps see the same rows."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("double").alias("label"))
    return cut_lineage(rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(limit))


def learn_terms(docs: DataFrame, sample: DataFrame) -> list[str]:
    """Words whose documents are labelled 1 far more often than others (smoothed log odds), ``MAX_TERMS`` at most."""
    some = docs.join(F.broadcast(sample), "id")
    total, toxic = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    words = some.select("label", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    counted = words.groupBy("w").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_DOCS)
    odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)) - F.log(F.lit((toxic + 0.5) / (total - toxic + 0.5)))
    # A count that chance could give is held against a term: two standard errors are taken off.
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    best = counted.withColumn("odds", odds - 2 * error).filter(F.col("odds") >= MIN_LOG_ODDS)
    return sorted(r[0] for r in best.orderBy(F.desc("odds"), "w").limit(MAX_TERMS).collect())


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``held_out``, ``score``, ``predicted``.

    Labels of rows whose crc32(id as text) mod 4 is 2 are never read; remainders 0 and 1 train, 3 calibrates.
    """
    part = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4))
    texts = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    sample = labelled_sample(labels, id_col, label_col, part(F.col(id_col)) != 2, max_labelled)
    terms = learn_terms(texts, sample.filter(part(F.col("id")) != 3))
    rows = cut_lineage(with_features(texts, "text", terms).select("id", *FEATURES))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    known = cut_lineage(assembled.join(F.broadcast(sample), "id").select("id", "features", "label"))
    train, hold = known.filter(part(F.col("id")) != 3), known.filter(part(F.col("id")) == 3)
    share = known.agg(F.avg("label")).first()[0] or 0.0
    kinds = train.select("label").distinct().count()
    if kinds < 2:
        scored = rows.withColumn("score", F.lit(float(share)))
    else:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, minInstancesPerNode=10).fit(train.coalesce(4))
        raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
        scored = raw(assembled)
        if hold.isEmpty():
            scored = scored.withColumn("score", F.col("raw"))
        else:
            calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw(hold).select("raw", "label"))
            scored = calibrated.transform(scored).withColumn("score", F.col("calibrated") * (1 - RAW_PART) + F.col("raw") * RAW_PART)
    final = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(part(F.col("id")) == 2, F.lit(False)).alias("held_out"), final.alias("score"),
        (final >= THRESHOLD).cast("int").alias("predicted"),
    )
