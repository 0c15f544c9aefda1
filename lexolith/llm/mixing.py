"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its target share of the rows divided by its present share. Each row's number of
copies is read off the Poisson distribution with that mean at a point in [0, 1) which a hash of the seed and the row's id
gives, so the choice does not depend on partitions, retries or order. The copies are then ordered by another hash: a
global shuffle by range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of all sources' distributions that are sent to every worker, 32 MB; beyond it they are joined by salted keys.
STEPS_BROADCAST = 4_000_000
#: Parts into which each source's rows are salted for that join.
SALTS = 64


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) from the first 13 hexadecimal digits of the MD5 of the parts, joined by a colon."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(16**13))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """source, rate and steps, the cumulative Poisson probabilities P(X <= 0), P(X <= 1), ..., of ``rates`` (source, rate > 0).

    Terms follow each other by their logarithms, so large rates do not underflow; a source's steps are sums over its own
    rows, so their cost follows the rate.
    """
    longest = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40)
    term = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    so_far = Window.partitionBy("source", "rate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = rates.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), longest))).withColumn("log_p", F.sum(term).over(so_far))
    totals = terms.withColumn("total", F.sum(F.exp("log_p")).over(so_far))
    listed = F.array_sort(F.collect_list(F.struct("k", "total")))
    return totals.groupBy("source", "rate").agg(F.transform(listed, lambda x: x["total"]).alias("steps"))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, source_col: str = "source") -> DataFrame:
    """source, n_rows, rate: the repetition rate of each source, null sources being one source of their own.

    With ``weights``, a source's target share is its weight over the weights of all sources present (0 for a source
    without one). Without, it is proportional to n_rows ** temperature: 1 keeps the mixture, 0 levels it.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature))))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = counts.join(given, counts["source"].eqNullSafe(given["source"]), "left").select(counts["source"], "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    totals = weighed.agg(F.sum("n_rows").alias("all_rows"), F.sum("weight").alias("all_weight"))  # one row
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return weighed.join(F.broadcast(totals)).select("source", "n_rows", F.round(share * F.col("all_rows") / F.col("n_rows"), 9).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    details: bool = False,
    steps_broadcast: int = STEPS_BROADCAST,
) -> DataFrame:
    """``docs`` with every row repeated by its Poisson count, in the order of a hash.

    All columns are kept, whatever their names. ``details`` adds __copy (1, 2, ...), __rate and __order, the key of the
    shuffle; a table that has a column of such a name raises a ValueError then. A null source is a source of its own; a
    null id hashes as the word null; rows that share an id share its count, since the hash sees only the id. A rate of 0
    leaves a source out. Empty and very long texts are columns like others. An empty table gives an empty result.
    """
    if details and (clash := {"__copy", "__rate", "__order"} & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns named {sorted(clash)} exist already")
    rates = poisson_steps(source_rates(docs, weights, temperature, source_col).filter("rate > 0").select("source", "rate"))
    # the steps of all sources bound the table that would be sent to the workers
    steps = rates.agg(F.sum(F.size("steps"))).first()[0] or 0
    rates = rates.select(F.col("source").alias("its_source"), "rate", "steps")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), key.alias("key"))
    if steps <= steps_broadcast:
        joined = rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("its_source")))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, (F.col("salt") == F.col("part")) & F.col("source").eqNullSafe(F.col("its_source")))
    copies = F.size(F.filter("steps", lambda p: p <= F.col("point")))
    drawn = joined.withColumn("point", unit_hash(F.lit(seed), F.col("key"))).select("row", "key", "rate", copies.alias("copies")).filter("copies > 0")
    repeated = drawn.select("row", "key", "rate", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    out = repeated.withColumn("order", unit_hash(F.lit(seed + "-order"), F.col("key"), F.col("copy"))).sort("order", "key", "copy")
    return out.select("row.*", *([F.col("copy").alias("__copy"), F.col("rate").alias("__rate"), F.col("order").alias("__order")] if details else []))


#: DuckDB's form of mix_sources() with details and the given temperature and seed, over a relation {docs}.
MIX_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows FROM {docs} GROUP BY source),
weighed AS (SELECT source, n_rows, power(n_rows::double, {temperature}) AS weight FROM counts),
rates AS (SELECT source, round(weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(n_rows) FROM weighed) / n_rows, 9) AS rate FROM weighed),
steps AS (
    SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM rates WHERE rate > 0
    UNION ALL
    SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::double), total + exp(log_p + ln(rate) - ln((k + 1)::double))
    FROM steps WHERE k < (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 40) FROM rates)
),
points AS (
    SELECT d.*, ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0 AS point FROM {docs} d
),
copied AS (
    SELECT p.*, r.rate, unnest(range(1, 1 + (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM p.source AND s.total <= p.point))) AS copy
    FROM points p JOIN rates r ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, text, lang, source, n_chars, copy::integer AS copy, rate,
    ('0x' || substr(md5('{seed}-order:' || coalesce(doc_id::varchar, 'null') || ':' || copy), 1, 13))::bigint::double / 4503599627370496.0 AS order_key
FROM copied
"""
