"""URL filters by a sort-merge range join over reversed-host keys.

A host's labels, reversed and each followed by a NUL, make a key of which the key of every parent domain is a prefix: a
rule's host is an interval of keys, and the intervals nest. Each partition's URLs are sorted by that key and swept beside
the sorted rules; a stack holds the rules whose intervals are open at the current key. The paths of one host's rules are
looked up from the longest down. Rules are sent to the workers in blocks of a checked size, so any number of rules works;
URLs are not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that go to the workers at once; more are applied in several passes.
RULES_PER_BLOCK = 100_000

_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
Rule = tuple[str, str, str]  # host, path, verdict


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    return "".join(label + "\0" for label in reversed(host.split(".")))


class RuleSweep:
    """The rules of one block beside an ascending run of hosts, with a stack of the rules that are open."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        by_host: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            own = by_host.setdefault(host, {})
            own[path] = longer(own.get(path), (host + path, verdict))
        self.nodes = sorted((host_key(h), paths, sorted({len(p) for p in paths}, reverse=True)) for h, paths in by_host.items())
        self.stack: list[tuple] = []
        self.at = 0

    def longest(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict; ``key`` must not be less than the one before."""
        stack, nodes = self.stack, self.nodes
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        while self.at < len(nodes) and nodes[self.at][0] <= key:
            if key.startswith(nodes[self.at][0]):
                stack.append(nodes[self.at])
            self.at += 1
        best = None
        for _, by_path, lengths in stack:
            hit = next((by_path[path[:n]] for n in lengths if n <= len(path) and path[:n] in by_path), None)
            best = longer(best, hit)
        return best


def longer(a: tuple[str, str] | None, b: tuple[str, str] | None) -> tuple[str, str] | None:
    """The rule with the longer text, the greater text on a tie; of two equal rules block, whichever block of rules they are in."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda r: (len(r[0]), r[0], r[1] == "block", r[1]))


def rule_blocks(rules: Sequence[Rule] | DataFrame, size: int) -> Iterator[list[Rule]]:
    """The distinct rules, hosts lower-cased, in blocks of about ``size``: of a list by its order, of a table (host, path,
    verdict) by a hash, so that no more than a block of it is on the driver at once. A rule with a null fits nothing."""
    if isinstance(rules, DataFrame):
        host = F.translate("host", ascii_uppercase, ascii_lowercase)
        table = rules.select(host.alias("host"), "path", "verdict").dropna().distinct()
        n = -(-table.count() // size)
        for b in range(n):
            yield list(map(tuple, table.filter(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == b).collect()))
    else:
        known = sorted({(h.translate(_LOWER), p, v) for h, p, v in rules if None not in (h, p, v)})
        yield from (known[i : i + size] for i in range(0, len(known), size))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    rules_per_block: int = RULES_PER_BLOCK,
) -> DataFrame:
    """``id_col``, host, path, rule (host and path of the longest fitting rule, else null) and verdict of every row.

    ``rules`` are (host, path, verdict) triples or a table of them; a rule fits its host and all subdomains if the URL's path starts with
    the rule's. The longest rule (host and path together) wins, the greater text on a tie, block over allow for equal
    rules. ``default`` is the verdict where none fits. A null URL and one without ``://`` have empty host and path;
    URLs may have any length.
    Repeated rows stay; other columns are not read; an empty table gives an empty result.
    """
    sc = pages.sparkSession.sparkContext
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "\0"), F.lit("\0"))
    rows = rows.select("*", key.alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    rows = rows.sortWithinPartitions("key")
    for block in rule_blocks(rules, rules_per_block):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            sweep = RuleSweep(sent.value)
            for batch in batches:
                before = [None if r is None else (r, v) for r, v in zip(batch["rule"], batch["verdict"])]
                found = [longer(b, sweep.longest(k, p)) or (None, None) for b, k, p in zip(before, batch["key"], batch["path"])]
                yield batch.assign(rule=[r for r, _ in found], verdict=[v for _, v in found])

        rows = rows.mapInPandas(run, rows.schema)
    return rows.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
