"""Checks on requests: validation messages, tenants, JSON answers and labels, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexolith.functions.ids import is_uuid
from lexolith.functions.text import blank_to_null, is_blank

#: What a tenant check may lead to.
OPEN, OWN, UNAUTHORISED = "OPEN", "OWN", "UNAUTHORISED"


def violations(rules: Mapping[str, tuple[Column, str]]) -> Column:
    """``path: message`` of every rule, by path, whose condition does not hold; a condition that is null does not."""
    found = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(f"{path}: {message}")) for path, (holds, message) in sorted(rules.items())]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def required(**columns: Column) -> dict[str, tuple[Column, str]]:
    """Rules for fields that must not be blank."""
    return {path: (~is_blank(c), "must not be blank") for path, c in columns.items()}


def tenant(header: Column, isolated: bool) -> Column:
    """client_id and access of a caller: without isolation no client and OPEN; with it the trimmed header if that is a
    UUID, in lower case, and OWN, else UNAUTHORISED."""
    if not isolated:
        return F.struct(F.lit(None).cast("string").alias("client_id"), F.lit(OPEN).alias("access"))
    good = is_uuid(header)
    return F.struct(F.when(good, F.lower(F.trim(header))).alias("client_id"), F.when(good, OWN).otherwise(UNAUTHORISED).alias("access"))


def found_for(asked: DataFrame, rows: DataFrame, key: str, client: str = "client_id") -> DataFrame:
    """``asked`` (key, client, access) with found: whether the caller's own rows hold the key. Another tenant's row is not
    found rather than forbidden; callers without a tenant see rows without one."""
    own = rows.select(F.col(key).alias("its_key"), blank_to_null(F.col(client)).alias("its_client")).distinct()
    same = (F.col(key) == F.col("its_key")) & F.col(client).eqNullSafe(F.col("its_client")) & (F.col("access") != UNAUTHORISED)
    return asked.join(own, same, "left").withColumn("found", F.col("its_key").isNotNull()).drop("its_key", "its_client")


def json_or_empty(value: Column) -> Column:
    """A struct, map or array as JSON, ``{}`` for null."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def query_label(label: Column, query_id: Column, version: Column) -> Column:
    """A query's label, or its id if it has none, with the version behind it from the second on."""
    return F.concat(F.coalesce(blank_to_null(label), query_id), F.when(version > 0, F.concat(F.lit(" v"), version.cast("string"))).otherwise(""))
