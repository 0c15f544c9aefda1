"""Column expressions for keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexolith.functions.text import blank_to_null

_DATE = "yyyyMMdd"
#: documentId_yyyyMMdd.extension, with an optional client folder before it; a document id holds no underscore or slash.
_BLOB = r"^(?:c=([^/]+)/)?([^/_]+)_(\d{8})\.([^./]+)$"
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def name_uuid(text: Column) -> Column:
    """The name-based UUID (version 3, MD5) of the trimmed text."""
    digest = F.md5(F.trim(text).cast("binary"))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), nibble % 4 + 1, F.lit(1))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("3"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def partition_key(client_id: Column, key: Column) -> Column:
    """The client, or the key itself for rows without one."""
    return F.coalesce(blank_to_null(client_id), key)


def is_uuid(text: Column) -> Column:
    """Whether a text is a UUID in its usual form; null and blank are not."""
    return F.coalesce(F.trim(text).rlike(_UUID), F.lit(False))


def valid_client(client_id: Column) -> Column:
    """A client id is absent or a UUID."""
    return client_id.isNull() | is_uuid(client_id)


def client_prefix(client_id: Column) -> Column:
    return F.when(blank_to_null(client_id).isNotNull(), F.concat(F.lit("c="), client_id, F.lit("/"))).otherwise("")


def blob_name(document_id: Column, day: Column, extension: Column, client_id: Column) -> Column:
    return F.concat(client_prefix(client_id), document_id, F.lit("_"), F.date_format(day, _DATE), F.lit("."), extension)


def parsed_blob_name(name: Column) -> Column:
    """client_id, document_id, day and extension of a blob name; null if it is malformed or its date does not exist."""
    day = F.try_to_timestamp(F.regexp_extract(name, _BLOB, 3), F.lit(_DATE)).cast("date")
    parts = F.struct(
        F.nullif(F.regexp_extract(name, _BLOB, 1), F.lit("")).alias("client_id"),
        F.regexp_extract(name, _BLOB, 2).alias("document_id"),
        day.alias("day"),
        F.regexp_extract(name, _BLOB, 4).alias("extension"),
    )
    return F.when(name.rlike(_BLOB) & day.isNotNull(), parts)


def artefact_name(kind: str, transaction_id: Column) -> Column:
    """The file that keeps a request's chunks or its payload for scoring."""
    return F.concat(F.lit(f"llm-{kind}-"), transaction_id, F.lit(".json"))
