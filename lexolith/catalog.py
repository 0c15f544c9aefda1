"""All registered queries of the library."""

from __future__ import annotations

from lexolith.queries import ORACLE_SQL, QUERIES, answers, corpus, evaluation, lifecycle, messages, requests, retrieval, scalars, stored  # noqa: F401

FLAGSHIP = "retrieval_pipeline"
