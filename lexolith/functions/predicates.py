"""Predicates on chunks, requests and states, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metadata keys that only the engine may set.
RESERVED_KEYS = ("clientid", "is_active")
INGESTION_DONE = ("INGESTION_SUCCESS", "INGESTION_FAILED", "FILE_SIZE_OVER_LIMIT")
ANSWER_DONE = ("ANSWER_GENERATED", "ANSWER_GENERATION_FAILED")
#: Statuses of any kind of message after which nothing more is done for it.
DONE_STATUSES = ("DONE", "FAILED", *INGESTION_DONE, *ANSWER_DONE)
GUARD_MODES = ("OFF", "DELIVER", "REJECT")


def has_pair(metadata: Column, key: str, value: str | Column) -> Column:
    """Whether any metadata pair has this key and value. Pairs are a list: keys may repeat."""
    return F.exists(_listed(metadata), lambda m: (m["key"] == key) & (m["value"] == value))


def matches_all(metadata: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    found = F.lit(True)
    for key, value in pairs:
        found = found & has_pair(metadata, key, value)
    return found


def is_active(metadata: Column) -> Column:
    """No activity mark at all, or any that is not false; null metadata is active."""
    marked = F.exists(_listed(metadata), lambda m: m["key"] == "is_active")
    alive = F.exists(_listed(metadata), lambda m: (m["key"] == "is_active") & (m["value"] != "false"))
    return ~marked | alive


def is_strictly_active(metadata: Column) -> Column:
    """No mark that is false: one cannot outvote another."""
    return ~F.exists(_listed(metadata), lambda m: (m["key"] == "is_active") & (m["value"] == "false"))


def of_client(client_column: Column, client_id: str | None) -> Column:
    """Equality with a client, if one is given."""
    return F.lit(True) if client_id is None or not client_id.strip() else client_column == client_id


def retrievable(metadata: Column, client_column: Column, client_id: str | None, pairs: Sequence[tuple[str, str]] = ()) -> Column:
    """A client's active chunks with all the given metadata pairs."""
    reserved = [k for k, _ in pairs if k.lower() in RESERVED_KEYS]
    if reserved:
        raise ValueError(f"reserved metadata keys: {reserved}")
    return of_client(client_column, client_id) & matches_all(metadata, pairs) & is_active(metadata)


def reserved_keys_in(metadata: Column) -> Column:
    """The reserved keys among metadata pairs, in any case."""
    return F.filter(F.transform(_listed(metadata), lambda m: m["key"]), lambda k: F.lower(k).isin(*RESERVED_KEYS))


def within_size(size: Column, limit_mib: int = 80) -> Column:
    """A file of exactly the limit is over it."""
    return size < limit_mib * 1024 * 1024


def is_terminal(status: Column) -> Column:
    """Whether a status ends its message, document or answer; null does not."""
    return F.coalesce(status.isin(*DONE_STATUSES), F.lit(False))


def is_live_lease(expires_at: Column, now: Column) -> Column:
    """A lease that expires exactly now may be taken."""
    return F.coalesce(expires_at > now, F.lit(False))


def is_acceptable(mode: Column, rendered: Column, block_present: Column, empty_fact_map: Column, inline: Column) -> Column:
    """Whether the citation guard lets an answer pass: cited, or a deliberate refusal without any marker."""
    return (mode == "OFF") | (rendered >= 1) | (block_present & empty_fact_map & (inline == 0))


def is_reasoning_model(name: Column) -> Column:
    return F.lower(name).rlike("^(gpt-?5|o1|o3|o4)")


def _listed(metadata: Column) -> Column:
    return F.coalesce(metadata, F.array().cast("array<struct<key:string,value:string>>"))
