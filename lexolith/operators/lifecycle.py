"""Lifecycles of documents and answers over tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_status(events: DataFrame, keys: list[str], status: str, at: str, terminal: Column, order: str) -> DataFrame:
    """The status of each key: its first terminal one if there is any, else its latest."""
    first_end = F.min_by(status, F.when(terminal, F.struct(at, order)))
    latest = F.max_by(status, F.struct(at, order))
    ended = F.max(F.when(terminal, True))
    return events.groupBy(*keys).agg(F.when(ended, first_end).otherwise(latest).alias("status"), F.coalesce(ended, F.lit(False)).alias("terminal"), F.count(F.lit(1)).alias("n_events"))


def attempts(deliveries: DataFrame, keys: list[str], failed: Column, most: int, order: list[str]) -> DataFrame:
    """Deliveries numbered since the last success, and what each leads to: DONE, RETRY or FAILED at the last attempt."""
    in_order = Window.partitionBy(*keys).orderBy(*order)
    runs = deliveries.withColumn("_failed", failed).withColumn("_run", F.coalesce(F.sum(F.when(~F.col("_failed"), 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))
    attempt = ((nth - 1) % most) + 1
    numbered = runs.withColumn("attempt", attempt)
    return numbered.withColumn("outcome", F.when(~F.col("_failed"), "DONE").when(F.col("attempt") >= most, "FAILED").otherwise("RETRY")).drop("_failed", "_run")


def lease_conflicts(claims: DataFrame, keys: list[str], at: str, seconds: int, order: str) -> DataFrame:
    """Claims whose predecessor's lease is still live: it expires ``seconds`` after that claim, and exactly then is free."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at, order))
    live = (F.unix_micros(before) + seconds * 1_000_000) > F.unix_micros(at)
    return claims.withColumn("conflict", F.coalesce(live, F.lit(False)))


def point_get(rows: DataFrame, key: dict[str, object]) -> DataFrame:
    """The rows with this key: a filter that reaches the scan, so files sorted by the key are skipped."""
    found = rows
    for name, value in key.items():
        found = found.filter(F.col(name).eqNullSafe(F.lit(value)))
    return found


def inserted_if_absent(current: DataFrame, arrived: DataFrame, keys: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``arrived`` to insert, and those that find their key taken.

    Of several new rows with one key the first by ``order``, then by all other columns, is inserted; the others find it
    taken, but for exact repeats of it, which are the same insert. A null key is a key. Winners are found by partial
    aggregation, so a hot key is no hot task.
    """
    rest = [c for c in arrived.columns if c not in keys]
    ranked = [*(order or []), *[c for c in rest if c not in (order or [])]]
    new = arrived.join(current.select(*[F.col(k).alias(f"its_{k}") for k in keys]).distinct(), _same(keys), "left_anti")
    first = new.groupBy(*keys).agg(F.min(F.struct(*ranked) if ranked else F.lit(0)).alias("row"))
    inserted = first.select(*keys, *[F.col("row")[c].alias(c) for c in rest])
    taken = arrived.join(inserted.select(*[F.col(c).alias(f"its_{c}") for c in arrived.columns]), _same(arrived.columns), "left_anti")
    return inserted.select(*arrived.columns), taken


def insert_versions(current: DataFrame, arrived: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``keys`` and version of each row that inserted_if_absent() inserts: the token, 1, that the first change must name."""
    return inserted_if_absent(current, arrived, keys, order)[0].select(*keys, F.lit(1).cast("bigint").alias("version"))


def updated_if_unchanged(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``current`` with changes applied whose version is the row's, which then rises by one; and the changes that lost.

    Of several changes to the same version of a row the least by its columns wins and the others lose, as they would
    find the version gone.
    """
    asked = changes.groupBy(*[F.col(k).alias(f"its_{k}") for k in keys], F.col("version").alias("its_version")).agg(F.min(F.struct(*columns)).alias("new"))
    joined = current.join(asked, _same([*keys, "version"]), "left")
    wins = F.col("new").isNotNull()
    rest = [c for c in current.columns if c not in (*columns, "version")]
    applied = joined.select(*rest, *[F.when(wins, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in columns], (F.col("version") + wins.cast("bigint")).alias("version"))
    won = joined.filter(wins).select(*[F.col(f"its_{k}") for k in keys], "its_version", *[F.col("new")[c].alias(f"its_{c}") for c in columns])
    return applied.select(*current.columns), changes.join(won, _same([*keys, "version", *columns]), "left_anti")


def _same(columns: list[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).eqNullSafe(F.col(f"its_{c}"))
    return found
