"""PII replaced by keyed surrogates, in DataFrame functions only.

Entities are found by type (patterns below). Every distinct entity gets one surrogate, drawn from a
keyed digest, of the same type and format: digits stay digits, letters keep case and script, signs
stay; card numbers keep a valid check digit; octets of addresses stay octets; mail domains keep
their last label and map alike in all addresses; names after a title keep the gender the title
tells. The same entity has the same surrogate everywhere, and no two entities share one: surrogates
that clash with another, or with any entity of the corpus, are drawn again, with the attempt in the
digest, until none clash; from attempt ``LENGTHEN`` on they grow by characters.

Distinct entities are counted with map-side sums. Texts are keyed by digest; only texts with
entities move, and what is joined to hot entities or hot texts is broadcast (:func:`attach`).

Defined results: null stays null and has no entities; empty texts stay empty. Equal texts change
alike, so repeated rows agree. An empty table stays empty. Other columns are not read by
:func:`pseudonymize`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import attach
from loglattice.session import cut_lineage

KEY = "public-demo-key"
LENGTHEN, MAX_ATTEMPTS = 8, 64
# Entity patterns. Names count after a title, which is part of the entity and tells the gender.
# A word of a name has inner capitals, apostrophes (not those of 's, 'd, 'll) and hyphens; initials stand before it or between two.
PREFIX = r"(?:sk|pk|ghp|gho|xox[bp])[-_]"
NAME_WORD = r"\p{Lu}(?:(?:['’](?=\p{Lu}|\p{Ll}{3})|-(?=\p{Lu}))?[\p{L}\p{M}])+"
NAME = rf"(?:\p{{Lu}}[.] ?|\p{{Lu}} )*{NAME_WORD}(?:(?: \p{{Lu}}[.]?)* {NAME_WORD})?"
TYPES = [
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", rf"(?<![A-Za-z0-9_])(?:[0-9a-f]{{32,128}}|{PREFIX}[A-Za-z0-9_-]{{16,128}})\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9-])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9-])"),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("name_f", rf"\b(?:Mrs[.]?|Ms[.]?|Frau|Madame|Mme|Señora|Sra[.]?) {NAME}"),
    ("name_m", rf"\b(?:Mr[.]?|Herrn?|Monsieur|Señor|Sr[.]?) {NAME}"),
]
ENTITY = "|".join(f"(?:{p})" for _, p in TYPES)
# Every entity has one of these (keys and hex secrets may be letters only); texts without are passed by at once.
CHEAP = rf"[@0-9]|{PREFIX}|AKIA|ASIA|[a-f]{{32}}|\b(?:Mrs?|Ms|Mme|Frau|Herrn?|Madame|Monsieur|Señora?|Sra?)\b"
# Given names by gender for Latin script; names of other scripts are drawn letter by letter.
GIVEN = {
    "name_f": ["Anna", "Clara", "Elena", "Emma", "Eva", "Hanna", "Ines", "Julia", "Laura", "Lena", "Maria", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sara", "Sofia"],
    "name_m": ["Anton", "Bruno", "Carlo", "David", "Emil", "Felix", "Hugo", "Ivan", "Jakob", "Karl", "Leo", "Lukas", "Marco", "Max", "Otto", "Paul", "Simon", "Tomas"],
}
# Alphabets by script and case, as code point ranges.
ALPHABETS = [("0", "9"), ("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω")]


def kind_of(entity: Column) -> Column:
    """The type of a found entity, by its shape."""
    found = F.when(entity.contains("@"), "email").when(entity.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"), "aws_key")
    found = found.when(entity.rlike(rf"^(?:[0-9a-f]{{32,128}}|{PREFIX}.*)$"), "secret").when(entity.rlike(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), "iban")
    found = found.when(entity.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip").when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    found = found.when(entity.rlike(r"^(?:[0-9]{4}[ -]?){3}[0-9]{1,7}$"), "card").when(entity.rlike(r"^[+(0-9]"), "phone")
    return found.when(entity.rlike(r"^(?:Mrs|Ms|Frau|Madame|Mme|Señora|Sra)"), "name_f").otherwise("name_m")


def draws(*parts: Column) -> Column:
    """128 hex digits of a keyed digest: nested, so that key and message cannot be exchanged."""
    message = F.concat_ws("\x1f", *parts)
    return F.sha2(F.concat(F.lit(KEY), F.sha2(F.concat(F.lit(KEY), message), 512)), 512)


def number_at(digest: Column, i: Column, below: Column) -> Column:
    """The i-th pseudo-random number of a digest, below a bound (three hex digits each, taken in a circle)."""
    return F.pmod(F.conv(F.substring(F.concat(digest, digest), F.pmod(i * 3, F.lit(125)) + 1, F.lit(3)), 16, 10).cast("int") + i, below).cast("int")


def like(text: Column, digest: Column) -> Column:
    """Every letter and digit replaced within its alphabet; other characters stay."""
    def draw(c: Column, i: Column) -> Column:
        out, code = c, F.ascii(c)
        for low, high in ALPHABETS:
            size = ord(high) - ord(low) + 1
            drawn = F.chr(F.lit(ord(low)) + number_at(digest, i, F.lit(size))) if ord(high) < 128 else F.get(F.array(*[F.lit(chr(k)) for k in range(ord(low), ord(high) + 1)]), number_at(digest, i, F.lit(size)))
            out = F.when((c >= low) & (c <= high), drawn).otherwise(out)
        latin = c.rlike(r"^\p{IsLatin}$") & (code >= 128)
        folded = F.chr(F.when(c.rlike(r"^\p{Lu}$"), 65).otherwise(97) + number_at(digest, i, F.lit(26)))
        return F.when(latin, folded).otherwise(out)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), draw), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit not doubled."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    weighed = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def first_name_of(given: list[str]) -> Callable[[Column], Column]:
    """A candidate for a given name; initials and names of other scripts are drawn letter by letter."""
    def draw(name: Column) -> Column:
        digest = draws(F.lit("given"), name)
        drawn = F.get(F.array(*[F.lit(g) for g in given]), number_at(digest, F.lit(0), F.lit(len(given))))
        return F.when(name.rlike(r"^\p{IsLatin}") & ~name.rlike(r"^\p{Lu}$|[.]$"), drawn).otherwise(like(name, digest))

    return draw


def surrogate(kind: Column, entity: Column, attempt: Column) -> Column:
    """A candidate for one entity of one type."""
    digest = draws(kind, entity, attempt.cast("string"))
    shaped = like(entity, digest)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    suffix = F.element_at(F.split(domain, r"\."), -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(suffix))
    mail = F.concat(like(local, digest), F.lit("@"), like(host, draws(F.lit("domain"), domain)), suffix)
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda _, i: (number_at(digest, i * 2, F.lit(254)) + 1).cast("string")), ".")
    digits = F.regexp_replace(shaped, "[^0-9]", "")
    valid = luhn_sum(F.regexp_replace(entity, "[^0-9]", "")) % 10 == 0
    first = F.concat(F.substring(entity, 1, 1), F.substring(shaped, F.lit(2), F.length(shaped) - 1))
    check = F.pmod(10 - luhn_sum(F.concat(F.substring(F.regexp_replace(first, "[^0-9]", ""), F.lit(1), F.length(digits) - 1), F.lit("0"))) % 10, F.lit(10))
    card = F.when(valid, F.concat(F.substring(first, F.lit(1), F.length(first) - 1), check.cast("string"))).otherwise(first)
    aws = F.concat(F.substring(entity, 1, 4), F.substring(shaped, F.lit(5), F.length(shaped) - 4))
    country = F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .(-])|^", 0)
    phone = F.concat(country, F.substring(shaped, F.length(country) + 1, F.length(shaped)))
    iban = F.concat(F.substring(entity, 1, 2), F.substring(shaped, F.lit(3), F.length(shaped) - 2))
    hexes = F.when(entity.rlike("^[0-9a-f]+$"), F.substring(F.concat(digest, digest), F.lit(1), F.length(entity))).otherwise(
        F.concat(F.regexp_extract(entity, r"^[a-z]+[-_]", 0), like(F.regexp_replace(entity, r"^[a-z]+[-_]", ""), digest)))
    out = F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "card", card).when(kind == "aws_key", aws).when(kind == "phone", phone)
    out = out.when(kind == "iban", iban).when(kind == "secret", hexes)
    title, last = F.substring_index(entity, " ", 1), F.element_at(F.split(entity, " "), -1)
    surname = like(last, draws(F.lit("surname"), last, attempt.cast("string")))
    # Given names and initials between title and last word.
    middles = F.slice(F.split(entity, " "), F.lit(2), F.greatest(F.size(F.split(entity, " ")) - 2, F.lit(0)))
    for gender, given in GIVEN.items():
        named = F.concat_ws(" ", title, F.array_join(F.transform(middles, first_name_of(given)), " "), surname)
        out = out.when(kind == gender, F.when(F.size(F.split(entity, " ")) > 2, named).otherwise(F.concat_ws(" ", title, surname)))
    out = out.otherwise(shaped)
    grown = F.when(kind.isin("email", "secret"), F.concat(F.substring(digest, F.lit(1), attempt - LENGTHEN + 1), out))
    grown = grown.when(kind.startswith("name"), F.concat(out, F.translate(F.substring(digest, F.lit(1), attempt - LENGTHEN + 1), "0123456789", "ghijklmnop")))
    grown = grown.otherwise(F.concat(out, F.translate(F.substring(digest, F.lit(1), attempt - LENGTHEN + 1), "abcdef", "012345")))
    return F.when(attempt >= LENGTHEN, grown).otherwise(out)


def assign_surrogates(entities: DataFrame) -> DataFrame:
    """``entities`` (kind, entity, n), distinct, plus ``surrogate``: one to one, and none equal to an entity."""
    drawn = cut_lineage(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.lit(0))))
    for _ in range(MAX_ATTEMPTS):
        # Of those that share a surrogate the smallest entity keeps it; one that is somebody's real value is never kept.
        owners = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("owner"), F.count(F.lit(1)).alias("claims"))
        real = entities.select(F.col("entity").alias("surrogate")).distinct().withColumn("is_real", F.lit(True))
        judged = drawn.join(owners, "surrogate").join(real, "surrogate", "left")
        clash = F.col("is_real").isNotNull() | (F.col("owner") != F.struct("kind", "entity"))
        marked = cut_lineage(judged.withColumn("clash", clash).select("kind", "entity", "n", "attempt", "surrogate", "clash"))
        if marked.filter("clash").isEmpty():
            return marked.select("kind", "entity", "n", "surrogate")
        retry = F.col("attempt") + F.col("clash").cast("int")
        drawn = cut_lineage(
            marked.withColumn("attempt", retry)
            .withColumn("surrogate", F.when(F.col("clash"), surrogate(F.col("kind"), F.col("entity"), F.col("attempt"))).otherwise(F.col("surrogate"))).drop("clash")
        )
    raise RuntimeError(f"surrogates still clash after {MAX_ATTEMPTS} attempts")


def found_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def pseudonymize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``text`` with surrogates, ``n_entities``, ``n_kinds``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    has = F.coalesce(F.col("text").rlike(CHEAP) & F.col("text").rlike(ENTITY), F.lit(False))
    texts = rows.filter(has).select(F.sha2("text", 256).alias("sha"), "text")
    # One row per distinct text with entities: the digest, and its entities in order.
    listed = texts.select("sha", found_in(F.col("text")).alias("found"))
    per_text = cut_lineage(listed.groupBy("sha", "found").agg(F.count(F.lit(1)).alias("n")))
    placed = per_text.select("sha", F.posexplode("found").alias("place", "entity")).withColumn("kind", kind_of(F.col("entity")))
    placed = cut_lineage(placed)
    entities = cut_lineage(placed.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n")))
    replaced = attach(placed, assign_surrogates(entities).select("entity", "n", "surrogate"), "entity", "n")
    by_text = replaced.groupBy("sha").agg(
        F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("new"), F.countDistinct("kind").alias("n_kinds"))
    facts = cut_lineage(by_text.select("sha", F.col("new.surrogate").alias("new"), "n_kinds").join(per_text.select("sha", "n"), "sha"))
    # Texts without entities stay where they are.
    joined = attach(rows.filter(has).withColumn("sha", F.sha2("text", 256)), facts, "sha", "n")
    # The text between entities, with the surrogates put back in order.
    zipped = F.arrays_zip(F.split(F.col("text"), ENTITY).alias("p"), F.col("new").alias("s"))
    rebuilt = F.array_join(F.flatten(F.transform(zipped, lambda x: F.array(x["p"], F.coalesce(x["s"], F.lit(""))))), "")
    changed = joined.select("id", rebuilt.alias("text"), F.size("new").cast("long").alias("n_entities"), F.col("n_kinds").cast("long"))
    none = F.lit(0).cast("long")
    plain = rows.filter(~has).select("id", "text", none.alias("n_entities"), none.alias("n_kinds"))
    return changed.unionByName(plain).withColumnRenamed("id", id_col)
