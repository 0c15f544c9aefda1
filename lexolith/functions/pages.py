"""Page lists as column expressions: ranges and unions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "N/A"
_NUMBER = "^[+-]?[0-9]+$"


def _page_tokens(pages: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(pages, F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != "")


def compressed(pages: Column) -> Column:
    """Runs of consecutive pages as ranges: ``1,2,3,5,6`` gives ``1-3,5,6``.

    The order stays; a run of two stays two pages; a list with anything but numbers stays as it is; none gives N/A.
    """
    tokens = _page_tokens(pages)
    numbers = F.transform(tokens, lambda t: t.try_cast("bigint"))
    start = F.struct(F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), F.array().cast("array<string>").alias("done"))

    def written(first: Column, last: Column) -> Column:
        a, b = first.cast("string"), last.cast("string")
        return F.when(first == last, a).when(last == first + 1, F.concat(a, F.lit(","), b)).otherwise(F.concat(a, F.lit("-"), b))

    def step(s: Column, n: Column) -> Column:
        opens = s["last"].isNull()
        follows = n == s["last"] + 1
        first = F.when(opens | ~follows, n).otherwise(s["first"])
        done = F.when(opens | follows, s["done"]).otherwise(F.concat(s["done"], F.array(written(s["first"], s["last"]))))
        return F.struct(first.alias("first"), n.alias("last"), done.alias("done"))

    ranges = F.aggregate(numbers, start, step, lambda s: F.array_join(F.concat(s["done"], F.array(written(s["first"], s["last"]))), ","))
    blank = F.trim(F.coalesce(pages, F.lit(""))).isin("", NOT_AVAILABLE) | (F.size(tokens) == 0)
    return F.when(blank, NOT_AVAILABLE).when(F.exists(tokens, lambda t: ~t.rlike(_NUMBER)), pages).otherwise(ranges)


def united(page_lists: Column) -> Column:
    """One list of the pages in an array of lists: numbers once each, ascending, then other tokens as first seen."""
    tokens = F.filter(F.flatten(F.transform(page_lists, _page_tokens)), lambda t: t != NOT_AVAILABLE)
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike(_NUMBER)), lambda t: t.try_cast("bigint"))))
    others = F.array_distinct(F.filter(tokens, lambda t: ~t.rlike(_NUMBER)))
    out = F.array_join(F.concat(F.transform(numbers, lambda n: n.cast("string")), others), ",")
    return F.when(out == "", NOT_AVAILABLE).otherwise(out)
