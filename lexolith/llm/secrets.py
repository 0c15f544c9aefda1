"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds which (blob, rule version) pairs
have been scanned and what was found; it is kept as a table in storage that the cluster shares. Only pairs that it lacks
are scanned, each distinct blob once however many paths and versions hold it, and findings are joined back to all of them. All steps are SQL functions.

Places are found without a procedural scan: splitting a text at a rule gives the pieces between its matches, extracting
gives the matches, and running sums of both lengths are the matches' offsets in code points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexolith.sources.shared import shared_folder


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``group`` of them has ``least`` characters at least."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        """The rule's name in the ledger. It holds a digest of what the rule looks for, so an edited rule scans anew."""
        looks_for = sha256(f"{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:12]
        return f"{self.kind}@{self.version}#{looks_for}"


#: The base rules, in the order in which spans with the same start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs of 32 at least: a match of the run pattern is a whole run, so shorter ones need not be listed to be dropped
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Addresses of unseen blobs, 32 bytes each, that are sent to the workers; more are joined.
UNSEEN_SENT = 500_000
#: Parts into which each blob's paths are dealt when findings are joined back, so that no blob's paths meet in one task.
SALTS = 16
LEDGER = "blob binary, rule string, spans array<struct<start:bigint,end:bigint>>"
_HITS = "array<struct<n:int,gap:int,length:int,counts:boolean>>"


def address(text: Column) -> Column:
    """The content address of a text: 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hits(text: Column, rule: Rule) -> Column:
    """The rule's matches in order: number, characters since the last match, length, whether the match counts."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    zipped = F.arrays_zip(matches.alias("hit"), F.split(text, rule.pattern, -1).alias("gap"))
    found = F.when(F.size(matches) > 0, F.filter(zipped, lambda x: x["hit"].isNotNull()))

    def hit(x: Column, i: Column) -> Column:
        part = x["hit"] if rule.group == 0 else F.regexp_extract(x["hit"], rule.pattern, rule.group)
        return F.struct(i.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("length"), (F.length(part) >= rule.least).alias("counts"))

    return F.coalesce(F.transform(found, hit), F.array()).cast(_HITS)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule, spans) for the pairs of ``blobs`` (blob, text) and ``rules`` that ``ledger`` lacks."""
    pairs = [F.struct(F.lit(r.key).alias("rule"), _hits(F.col("text"), r).alias("hits")) for r in rules]
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        pairs = [F.when(~F.array_contains("seen", r.key), p) for r, p in zip(rules, pairs)]
    scanned = blobs.select("blob", F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("pair"))
    hits = scanned.select("blob", F.col("pair.rule").alias("rule"), F.explode_outer("pair.hits").alias("hit"))
    so_far = Window.partitionBy("blob", "rule").orderBy("hit.n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("hit.gap") + F.col("hit.length")).cast("bigint")).over(so_far)
    placed = hits.select("blob", "rule", "hit.counts", (end - F.col("hit.length")).alias("start"), end.alias("end"))
    span = F.when(F.col("counts"), F.struct("start", "end"))
    return placed.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _blobs(versions: DataFrame, text_col: str) -> DataFrame:
    """The distinct texts of ``versions`` by their address."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(address(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def _unseen(versions: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None, text_col: str) -> DataFrame | None:
    """The blobs (blob, text) of ``versions`` for which ``ledger`` lacks a pair; None if there are none.

    Addresses are compared first, and only unseen texts move: they are picked where they lie if they are few.
    """
    if ledger is None:
        return _blobs(versions, text_col)
    keys = [r.key for r in rules]
    whole = ledger.filter(F.col("rule").isin(keys)).groupBy("blob").agg(F.count_distinct("rule").alias("n")).filter(F.col("n") == len(keys)).select("blob")
    own = versions.select(address(F.coalesce(F.col(text_col), F.lit(""))).alias("blob")).distinct()
    shared_folder(versions.sparkSession)
    unseen = own.join(whole, "blob", "left_anti").checkpoint().withColumnRenamed("blob", "its_blob")
    n = unseen.count()
    if not n:
        return None
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(address(text).alias("blob"), text.alias("text"))
    picked = rows.join(F.broadcast(unseen) if n <= UNSEEN_SENT else unseen, F.col("blob") == F.col("its_blob"), "left_semi")
    return picked.groupBy("blob").agg(F.first("text").alias("text"))


def _joined_back(versions: DataFrame, entries: DataFrame, rules: Sequence[Rule], text_col: str) -> DataFrame:
    """The columns of ``versions`` but the text, __blob and __spans, from the entries of a ledger."""
    places = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = entries.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).withColumn("at", F.try_element_at(places, F.col("rule")))
    kind = F.element_at(kinds, F.col("at") + 1)
    per_rule = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("at").alias("place"), kind.alias("kind"), s["end"].alias("end")))
    found = listed.select("blob", "at", per_rule.alias("spans")).distinct().groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = found.select(F.col("blob").alias("its_blob"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("its_salt"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rest = [F.col(f"`{c}`") for c in versions.columns if c != text_col]
    paths = versions.select(F.struct(F.lit(0), *rest).alias("row"), address(F.coalesce(F.col(text_col), F.lit(""))).alias("blob"), salt.alias("salt"))
    joined = paths.join(found, (F.col("blob") == F.col("its_blob")) & (F.col("salt") == F.col("its_salt")), "left")
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    rest = [F.col("row")[c].alias(c) for c in versions.columns if c != text_col]
    return joined.select(*rest, F.col("blob").alias("__blob"), F.coalesce("spans", none).alias("__spans"))


def _check_names(versions: DataFrame) -> None:
    if clash := {"__blob", "__spans"} & {c.lower() for c in versions.columns}:
        raise ValueError(f"columns named {sorted(clash)} exist already")


def scan_versions(
    versions: DataFrame, rules: Sequence[Rule] = BASE_RULES, ledger: DataFrame | None = None, text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions``, and the ledger with the pairs added that this call scanned.

    The first result has the columns of ``versions`` but the text, its __blob, and __spans: an array of (start, place of
    the rule, kind, end) in that order, of code points, end exclusive. The ledger has blob, rule (kind@version) and spans.
    A null text is the empty one; texts of any length are scanned whole. Repeated rows stay and share their blob's
    findings; an empty table gives empty results. Input columns named __blob or __spans raise a ValueError.
    """
    _check_names(versions)
    unseen = _unseen(versions, rules, ledger, text_col)
    entries = None if unseen is None else scan_blobs(unseen, rules, ledger)
    if ledger is not None:
        known = ledger.select("blob", "rule", "spans")
        entries = known if entries is None else known.unionByName(entries)
    return _joined_back(versions, entries, rules, text_col), entries


def stored_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger that lies in a folder of the cluster's storage, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def scan_with_ledger(versions: DataFrame, path: str, rules: Sequence[Rule] = BASE_RULES, text_col: str = "text") -> DataFrame:
    """scan_versions() over a ledger that is kept at ``path``: pairs that it lacks are scanned and appended to it, and
    findings are read from it.

    A run that fails before its append leaves the ledger as it was; entries that two runs append are the same and count once.
    """
    _check_names(versions)
    spark = versions.sparkSession
    ledger = stored_ledger(spark, path)
    unseen = _unseen(versions, rules, ledger, text_col)
    if unseen is not None:
        scan_blobs(unseen, rules, ledger).write.mode("append").parquet(path)
    return _joined_back(versions, stored_ledger(spark, path), rules, text_col)


def listing(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        more = F.when(s["start"] >= state["at"], F.concat(state["parts"], F.array(before, F.lit(mask)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("parts"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, path: str, rules: Sequence[Rule] = BASE_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the findings of scan_with_ledger() masked in its texts, all columns as they were, whatever their names.

    A null text stays null and an empty one empty; repeated rows stay; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    found = scan_with_ledger(rows, path, rules)
    out = redacted(F.col("row")[text_col], F.col("__spans"))
    return found.select(*[out.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
