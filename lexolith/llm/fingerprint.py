"""Document fingerprints: a canonical exact digest.

A text's canonical form has compatibility characters composed (NFKC), case folded and runs of white space folded to one
blank. Two xxHash64 values of it, 128 bits, are its bucket. In buckets that hold more than one row the canonical bytes
are compared, and texts that differ get different fingerprints. All steps are SQL functions; normalisation and case
folding call the ICU library that comes with Spark through java_method.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexolith.llm.common import checkpointed

#: Parts into which the rows of a bucket are dealt.
SALTS = 16
_ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"
_ICU_CHARACTER = "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """The canonical form of a text; ASCII texts skip the Unicode steps, which would not change them."""

    def composed(c: Column) -> Column:
        return F.call_function("java_method", F.lit(_ICU_NORMALIZER), F.lit("compose"), c, F.lit(True))

    folded = composed(F.call_function("java_method", F.lit(_ICU_CHARACTER), F.lit("foldCase"), composed(text), F.lit(True)))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def buckets(form: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a canonical form."""
    return F.xxhash64(form), F.xxhash64(F.lit("lexolith"), form)


def _hex(high: Column, low: Column, nth: Column) -> Column:
    text = F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))
    return F.when(nth > 0, F.concat(text, F.lit("-"), nth.cast("string"))).otherwise(text)


def row_key(id_col: Column, text: Column) -> Column:
    """32 bytes that rows share only if they have the same id and text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit("|"), text).cast("binary"), 256))


def following(rows: DataFrame) -> DataFrame:
    """``rows`` (id, key, ...) with next_key, that of the row after each in the order of descending id, then key.

    After the last row comes the first. Rows are sorted by range; each range looks ahead within itself, and a table with
    a row for each range, not for each document, carries the heads across.
    """
    order = [F.desc_nulls_last("id"), F.asc("key")]
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*order)
    looked = ranged.withColumn("next_key", F.lead("key").over(within)).withColumn("nth", F.row_number().over(within))
    by_range = Window.orderBy("range")
    heads = looked.filter("nth = 1").select("range", F.col("key").alias("head"))
    after = heads.select("range", F.coalesce(F.lead("head").over(by_range), F.first("head").over(by_range)).alias("next_head"))
    joined = looked.join(F.broadcast(after), "range")
    return joined.select(*rows.columns, F.coalesce("next_key", "next_head").alias("next_key"))


def collisions(rows: DataFrame) -> DataFrame:
    """high, low, digest, nth (from 1) of the second and further canonical forms in each bucket of ``rows`` (high, low, form).

    Forms are compared byte by byte, copies being put together before they are shuffled. Rows of the result are 128-bit
    collisions of different texts; n texts have about n * n / 2**129 of them, none in practice.
    """
    forms = rows.groupBy("high", "low", "form").agg(F.count(F.lit(1)).alias("members"))
    nth = F.row_number().over(Window.partitionBy("high", "low").orderBy("form")) - 1
    return forms.select("high", "low", F.sha2(F.col("form").cast("binary"), 256).alias("digest"), nth.alias("nth")).filter("nth > 0")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_of: Callable[[Column], tuple[Column, Column]] = buckets) -> DataFrame:
    """Fingerprints of every row of ``docs`` and of its edited text, with their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document in the order of descending id (after the last: the first). Of equal rows, each but the last is followed by
    the next of them; rows that share an id but not the text are ordered by a hash of both; null ids come last. Columns:
    ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: 1.0 if the two
    fingerprints are equal, else 0.0, since the digest is exact. A null text is the empty one; texts of any length are taken whole. An empty table gives an
    empty result; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.withColumn("key", row_key(F.col("id"), F.col("text")))
    high, low = bucket_of(canonical(F.col("text")))
    narrow = keyed.select("id", "key", F.length("text").cast("long").alias("n_chars"), high.alias("high"), low.alias("low"))
    placed = checkpointed(following(narrow.groupBy("id", "key", "n_chars", "high", "low").agg(F.count(F.lit(1)).alias("copies"))))

    # rows whose bucket holds others too, dealt out so that no bucket's rows meet in one task
    shared = placed.groupBy("high", "low").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = shared.select("high", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("shares"))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    wide = salted.join(shared, ["high", "low", "salt"], "left").select("key", "id", "n_chars", "high", "low", "copies", "shares")

    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    own = texts.join(wide, "key")
    compared = own.filter("shares").select("high", "low", canonical(F.col("text")).alias("form"))
    others = collisions(compared)

    takes = placed.select(F.col("next_key").alias("key"), F.col("key").alias("taker"), F.expr("n_chars div 2").cast("int").alias("take"))
    given = texts.join(takes, "key").select(F.col("taker").alias("key"), F.expr("left(text, take)").alias("head"), canonical(F.col("text")).alias("next_form"))
    next_high, next_low = bucket_of(F.col("next_form"))
    given = given.select("key", "head", _digest("next_form").alias("next_digest"), next_high.alias("next_high"), next_low.alias("next_low"))
    both = own.join(given, "key")
    kept = F.expr("left(text, cast(n_chars - n_chars div 2 as int))")
    once = both.select("id", "n_chars", "text", F.concat(kept, "head").alias("edited"), "high", "low", "next_high", "next_low", "next_digest", F.lit(1).cast("bigint").alias("times"))
    # equal rows follow each other: all but the last take from their own text
    own_head = F.expr("substring(text, 1, cast(n_chars div 2 as int))")
    again = both.filter("copies > 1").select(
        "id", "n_chars", "text", F.concat(kept, own_head).alias("edited"), "high", "low", F.col("high").alias("next_high"), F.col("low").alias("next_low"),
        _digest(canonical(F.col("text"))).alias("next_digest"), (F.col("copies") - 1).alias("times"),
    )
    rows = once.unionByName(again).withColumn("form", canonical(F.col("text"))).withColumn("edited_form", canonical(F.col("edited")))
    edited_high, edited_low = bucket_of(F.col("edited_form"))
    rows = rows.select(
        "id", "n_chars", "times", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), _digest("form").alias("digest"), "high", "low",
        "next_digest", "next_high", "next_low", _digest("edited_form").alias("edited_digest"), edited_high.alias("edited_high"), edited_low.alias("edited_low"),
    )
    for of in ("", "next_", "edited_"):
        nth = others.select(*[F.col(c).alias(of + c) for c in ("high", "low", "digest")], F.col("nth").alias(of + "nth"))
        rows = rows.join(F.broadcast(nth), [of + "high", of + "low", of + "digest"], "left")
        rows = rows.withColumn(of + "fingerprint", _hex(F.col(of + "high"), F.col(of + "low"), F.coalesce(of + "nth", F.lit(0))))
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )


def _digest(form: Column | str) -> Column:
    return F.sha2((F.col(form) if isinstance(form, str) else form).cast("binary"), 256)
