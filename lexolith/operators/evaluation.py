"""Evaluation of answers: run matrices, cells, pairwise comparisons, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexolith.functions.text import salvaged_json, truncated

#: Rows of a configuration that may be sent to every worker.
MOST_CONFIGS = 10_000


def run_matrix(queries: DataFrame, prompts: DataFrame, models: DataFrame, repetitions: int) -> DataFrame:
    """Every query with every prompt, model and repetition: the matrix is the operator. Prompts and models are
    configurations; a side is broadcast only if it has MOST_CONFIGS rows at most."""
    every = queries
    for side in (prompts, models):
        few = side.limit(MOST_CONFIGS + 1).count() <= MOST_CONFIGS
        every = every.crossJoin(F.broadcast(side) if few else side)
    return every.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def paired_versions(versions: DataFrame) -> DataFrame:
    """Queries (version_nr, query_id, text) of later versions beside those of version 0; without a partner they go."""
    base = versions.filter("version_nr = 0").select("query_id", F.col("text").alias("base_text"))
    return versions.filter("version_nr > 0").join(base, "query_id")


def is_ok(status: Column, response: Column, error: Column) -> Column:
    return (status == "ANSWER_GENERATED") & response.isNotNull() & error.isNull()


def cell_stats(runs: DataFrame, *cell: str) -> DataFrame:
    """Counts and integer means per cell of ``runs`` (ok and the fields of compliance()); means over max(ok, 1) runs."""
    good = lambda c: F.count_if(F.col("ok") & c)
    mean = lambda name: F.floor(F.coalesce(F.sum(F.when(F.col("ok"), F.col(name))), F.lit(0)) / F.greatest(F.count_if("ok"), F.lit(1))).cast("bigint")
    return runs.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("ok").alias("ok"),
        good(F.col("json_block")).alias("json_block"),
        good(F.col("inline_in_json")).alias("matched"),
        good(F.col("substituted")).alias("substituted"),
        good((F.col("prose_words") >= 50) & ~F.col("substituted")).alias("uncited"),
        *[mean(c).alias(f"mean_{c}") for c in ("prose_chars", "prose_words", "json_entries", "cited_pages", "stacked_runs")],
    )


def chained(variants: DataFrame, order: str, name: str) -> DataFrame:
    """(before, after) of neighbours in the order of the distinct variants."""
    ordered = variants.groupBy(name).agg(F.min(order).alias(order))
    pairs = ordered.select(F.lag(name).over(Window.orderBy(order, name)).alias("before"), F.col(name).alias("after"))  # a row for each variant
    return pairs.filter("before IS NOT NULL")


def compared(runs: DataFrame, pairs: DataFrame, variant: str, same: list[str], value: str, ordinal: str) -> DataFrame:
    """``same``, before, after, and the values of both: runs that agree in all but the variant, for each pair of variants.

    Of runs that agree in the variant too, the last by ``ordinal`` counts.
    """
    last = runs.groupBy(*same, variant).agg(F.max_by(value, ordinal).alias("v"))
    a = last.select(*same, F.col(variant).alias("before"), F.col("v").alias("value_before"))
    b = last.select(*same, F.col(variant).alias("after"), F.col("v").alias("value_after"))
    return a.join(pairs, "before").join(b, [*same, "after"])


def labelled(results: DataFrame, configs: DataFrame, label: str = "label") -> DataFrame:
    """``results`` with the columns of the query configuration of their label; configurations with one label count once,
    the least by their columns, and results without one keep nulls. Spark broadcasts the smaller side by its size."""
    rest = [c for c in configs.columns if c != label]
    one = configs.groupBy(F.col(label).alias("its_label")).agg(F.min(F.struct(*rest)).alias("config"))
    return results.join(one, F.col(label) == F.col("its_label"), "left").select(*results.columns, *[F.col("config")[c].alias(c) for c in rest])


def report_rows(results: DataFrame) -> DataFrame:
    """Results in the order of reports: query, prompt, model, iteration."""
    return results.orderBy("query_id", "prompt", "model", "iteration")


def verdicts(judged: DataFrame, verdict: str = "verdict") -> DataFrame:
    """verdict and n in the order of verdicts; null counts as UNPARSED."""
    return judged.groupBy(F.coalesce(verdict, F.lit("UNPARSED")).alias("verdict")).agg(F.count(F.lit(1)).alias("n")).orderBy("verdict")


def judged_summary(pairs: DataFrame, *by: str) -> DataFrame:
    """n_similar, mean_similarity (text, ``n/a`` without any), n_judged, mean_structure_a and mean_structure_b of each
    group of ``pairs`` (similarity, verdict, structure_a, structure_b); structure means are over judged pairs."""
    judged = F.col("verdict").isNotNull() & (F.col("verdict") != "UNPARSED")
    mean = F.avg("similarity")
    return pairs.groupBy(*by).agg(
        F.count("similarity").alias("n_similar"),
        F.when(mean.isNull(), "n/a").otherwise(F.format_string("%.3f", mean)).alias("mean_similarity"),
        F.count_if(judged).alias("n_judged"),
        *[F.round(F.coalesce(F.avg(F.when(judged, F.col(f"structure_{x}").cast("double"))), F.lit(0.0)), 6).alias(f"mean_structure_{x}") for x in "ab"],
    )


def report_totals(runs: DataFrame, *by: str) -> DataFrame:
    """Sums over the good ones of ``runs`` (ok and the fields of compliance()), and matched of all as n/N."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).cast("bigint").alias(f"total_{c}")
    matched = F.concat(F.count_if(F.col("ok") & F.col("inline_in_json")).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"))
    return runs.groupBy(*by).agg(*map(total, ("prose_words", "cited_pages", "stacked_runs")), matched.alias("matched"))


def histogram(scores: DataFrame, value: str, width: float, *by: str) -> DataFrame:
    """bin (its lower end) and n of each group's scores that are not null, attributes of null left out of ``attributes``.

    Counts are added up before they move, so no group meets in one task.
    """
    given = F.map_filter(F.create_map(*[x for c in by for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    rows = scores.filter(F.col(value).isNotNull()).select(F.to_json(given).alias("attributes"), (F.floor(F.col(value) / width) * width).alias("bin"))
    return rows.groupBy("attributes", "bin").agg(F.count(F.lit(1)).alias("n"))


def publish_histogram(scores: DataFrame, value: str, width: float, path: str, number: int, *by: str) -> None:
    """Writes the histogram of a batch to the table of metrics at ``path``, in the batch's place: a batch that runs again
    replaces what it wrote."""
    histogram(scores, value, width, *by).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")


#: Size of quantile sketches, and the share of ranks by which their quantiles may be off, with a probability over 0.99.
SKETCH_SIZE, RANK_ERROR = 400, 0.01


def publish_sketches(scores: DataFrame, value: str, path: str, number: int, *by: str) -> None:
    """Writes n, the sum, the least and greatest score and a quantile sketch of each group of a batch to the table at
    ``path``, in the batch's place: a batch that runs again replaces what it wrote. Scores that are null are left out."""
    rows = scores.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    sketch = F.kll_sketch_agg_double("_v", F.lit(SKETCH_SIZE)).alias("sketch")
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("sum"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), sketch)
    found.write.mode("overwrite").parquet(f"{path}/batch={number}")


def sketched_distribution(spark: SparkSession, path: str, shares: list[float], *by: str) -> DataFrame:
    """n, mean, least, greatest and quantiles (an array, for each of ``shares``) of each group over all batches at ``path``.

    Sketches are merged, no score is read again. The share of scores up to a quantile is off by RANK_ERROR at most, with a
    probability over 0.99; n, mean, least and greatest are exact.
    """
    found = spark.read.parquet(path).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch")
    )
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(s)) for s in shares])
    return found.select(*by, "n", F.round(F.col("sum") / F.col("n"), 6).alias("mean"), "least", "greatest", quantiles.alias("quantiles"))


def distribution(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, least, median and greatest score of each group, scores that are null left out.

    A group's values are counted before they move; the median is read off the running counts of its distinct values, a
    window that sorts and spills.
    """
    rows = scores.filter(F.col(value).isNotNull())
    basic = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    counts = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.withColumn("end", F.sum("c").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("all") - 1) / 2) + 1, F.floor(F.col("all") / 2) + 1
    holds = lambda place: F.min(F.when(F.col("end") >= place, F.col("v")))
    middle = ends.groupBy(*by).agg(F.round((holds(low) + holds(high)) / 2, 6).alias("median"))
    same = F.lit(True)
    for c in by:
        same = same & basic[c].eqNullSafe(middle[c])
    return basic.join(middle, same).select(*[basic[c] for c in by], "n", "mean", "least", "median", "greatest")


def judge_result(raw: Column) -> Column:
    """verdict, missing_a, missing_b, structure_a, structure_b, similarity and note of a judge's reply, from its outermost
    braces, with defaults: UNPARSED, 0, and a note shortened to 100 characters."""
    fields = "verdict string, factsMissingFromA array<string>, factsMissingFromB array<string>, structureScoreA int, structureScoreB int, similarity double, note string"
    parsed = F.from_json(salvaged_json(raw), fields)
    size = lambda name: F.coalesce(F.when(parsed[name].isNotNull(), F.size(parsed[name])), F.lit(0))
    number = lambda name: F.coalesce(parsed[name], F.lit(0))
    return F.struct(
        F.coalesce(parsed["verdict"], F.lit("UNPARSED")).alias("verdict"), size("factsMissingFromA").alias("missing_a"), size("factsMissingFromB").alias("missing_b"),
        number("structureScoreA").alias("structure_a"), number("structureScoreB").alias("structure_b"), F.coalesce(parsed["similarity"], F.lit(0.0)).alias("similarity"),
        truncated(F.coalesce(parsed["note"], F.lit("")), 100).alias("note"),
    )
