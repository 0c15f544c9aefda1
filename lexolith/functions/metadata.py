"""Metadata as lists of key-value pairs, where keys may repeat, and as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "array<struct<key:string,value:string>>"


def _kept(pairs: Column) -> Column:
    """The first pair of each key, in order."""
    none = F.array().cast(PAIRS)
    return F.aggregate(F.coalesce(pairs, none), none, lambda done, p: F.when(F.exists(done, lambda d: d["key"] == p["key"]), done).otherwise(F.concat(done, F.array(p))))


def first_wins(pairs: Column) -> Column:
    """A map of the pairs; of pairs with the same key the first holds."""
    return F.map_from_entries(_kept(pairs))


def last_wins(pairs: Column) -> Column:
    """A map of the pairs; of pairs with the same key the last holds."""
    return F.map_from_entries(_kept(F.reverse(F.coalesce(pairs, F.array().cast(PAIRS)))))


def overlaid(document_id: Column, given: Column) -> Column:
    """A message's metadata: the document's id under both its names, then what the caller gave, which may replace them."""
    own = F.array(*[F.struct(F.lit(k).alias("key"), document_id.alias("value")) for k in ("document_id", "documentId")])
    return last_wins(F.concat(own, F.coalesce(F.map_entries(given), F.array().cast(PAIRS)).cast(PAIRS)))


def pairs_of(metadata: Column) -> Column:
    """A map's pairs as a list."""
    return F.coalesce(F.map_entries(metadata), F.array()).cast(PAIRS)


def from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")
