"""Prompts, contexts, model calls and the guard on what models answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexolith.functions.predicates import is_acceptable
from lexolith.functions.text import is_blank, salvaged_json

#: What stands for an answer when no chunk was found, and when the model gave nothing.
NO_DATA, NO_ANSWER = "No relevant data was found for this query.", "The model gave no answer."


def contexts(chunks: DataFrame, group: str = "query_id") -> DataFrame:
    """``group`` and context: chunks (document_id, rank, chunk, file_name, page_number, custom_metadata) as nested tags.

    Documents follow each other by their best rank, passages by rank. A document's name is its first chunk's
    material_name, or file name. Texts are not escaped; a null page is an empty element.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk", "file_name", "page_number", "custom_metadata")))
    documents = chunks.groupBy(group, "document_id").agg(listed.alias("c"))
    first = F.get("c", F.lit(0))
    named = F.get(F.filter(F.coalesce(first["custom_metadata"], F.array().cast("array<struct<key:string,value:string>>")), lambda m: (m["key"] == "material_name") & ~is_blank(m["value"])), F.lit(0))
    name = F.coalesce(named["value"], first["file_name"], F.lit(""))
    passages = F.transform("c", lambda x: F.concat(F.lit("<passage><page>"), F.coalesce(x["page_number"].cast("string"), F.lit("")), F.lit("</page><text>"), x["chunk"], F.lit("</text></passage>")))
    rendered = F.concat(F.lit("<document><id>"), F.col("document_id").cast("string"), F.lit("</id><name>"), name, F.lit("</name>"), F.array_join(passages, ""), F.lit("</document>"))
    whole = documents.select(group, first["rank"].alias("rank"), "document_id", rendered.alias("d"))
    ordered = whole.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "document_id", "d"))).alias("ds"))
    return ordered.select(group, F.concat(F.lit("<documents>"), F.array_join(F.transform("ds", lambda x: x["d"]), ""), F.lit("</documents>")).alias("context"))


def generation_prompt(query: Column, instructions: Column, context: Column) -> Column:
    return F.concat(F.lit("Question:\n"), F.coalesce(query, F.lit("")), F.lit("\n\nInstructions:\n"), F.coalesce(instructions, F.lit("")), F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("<documents></documents>")))


def scoring_prompt(query: Column, answer: Column, context: Column) -> Column:
    return F.concat(F.lit("Judge how well the answer rests on the context.\n\nQuestion:\n"), F.coalesce(query, F.lit("")), F.lit("\n\nAnswer:\n"), F.coalesce(answer, F.lit("")), F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("<documents></documents>")))


def answered(requests: DataFrame, call) -> DataFrame:
    """``requests`` (prompt, has_chunks) with raw: what ``call``, a function of a list of prompts, answers.

    Requests without chunks are not sent; they and empty answers get fixed texts.
    """

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        asked = [i for i, p in enumerate(prompts) if p is not None]
        out: list = [None] * len(prompts)
        for i, answer in zip(asked, call([prompts.iloc[i] for i in asked]) if asked else []):
            out[i] = answer
        return pd.Series(out, index=prompts.index)

    given = requests.withColumn("raw", run(F.when(F.col("has_chunks"), F.col("prompt"))))
    return given.withColumn("raw", F.when(~F.col("has_chunks"), NO_DATA).when(is_blank(F.col("raw")), NO_ANSWER).otherwise(F.col("raw")))


def guarded(outcomes: DataFrame, outcome: str = "outcome", mode: str = "mode", attempt: str = "attempt", most: int = 3) -> DataFrame:
    """``outcomes`` with verdict: DELIVER, RETRY while attempts are left, then DELIVER_DEGRADED or FAIL by the mode."""
    o = F.col(outcome)
    fine = is_acceptable(F.col(mode), o["rendered"], o["json_block"], o["empty_fact_map"], o["inline_markers"])
    verdict = F.when(fine, "DELIVER").when(F.col(attempt) < most, "RETRY").when(F.col(mode) == "DELIVER", "DELIVER_DEGRADED").otherwise("FAIL")
    reason = F.when(~fine, F.format_string("Citations missing: block=%s, inline=%s, rendered=%s", o["json_block"].cast("string"), o["inline_markers"].cast("string"), o["rendered"].cast("string")))
    return outcomes.withColumn("verdict", verdict).withColumn("reason", reason)


def parsed_score(raw: Column) -> Column:
    """groundedness and reasoning of a judge's answer, from its outermost braces; 0 if there is no number."""
    parsed = F.from_json(salvaged_json(raw), "groundednessScore decimal(10,4), reasoning string")
    return F.struct(F.coalesce(parsed["groundednessScore"].cast("double"), F.lit(0.0)).alias("groundedness"), parsed["reasoning"].alias("reasoning"))


def with_scores(generated: DataFrame, scores: DataFrame, key: str = "transaction_id") -> DataFrame:
    """``generated`` with the groundedness of ``scores`` where it has one; scores without a transaction go nowhere."""
    new = scores.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("groundedness", "scored_at").alias("_new"))
    merged = generated.join(new, key, "left")
    return merged.withColumn("groundedness", F.coalesce("_new", "groundedness")).drop("_new")


def status_view(generated: DataFrame, snapshots: DataFrame | None = None, key: str = "transaction_id") -> DataFrame:
    """What a caller sees of answers: id, status, reason, response, duration if it is positive, and, if asked for, the chunks."""
    duration = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    view = generated.select(key, "status", "reason", "response", duration.alias("duration_ms"))
    return view if snapshots is None else view.join(snapshots.select(key, "chunks"), key, "left")
