"""The registered queries of this subpackage, with the parameters of production, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.llm import bilinear, divergence, fingerprint, jaccard, langid, merkle, mixing, packing, quality, secrets, tokens, topk, urls
from lexolith.llm.common import table
from lexolith.sources.shared import shared_folder

#: The rules against which pages are judged.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), limit=2048)


def ledger_of(spark: SparkSession, sf_dir: str) -> str:
    """Where the ledger of the corpus in a data folder is kept: the shared folder of the session's storage, not its tasks'."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or shared_folder(spark)
    return f"{root.rstrip('/')}/secret-ledger-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_with_ledger(docs, ledger_of(spark, sf_dir))
    listed = secrets.listing(F.col("__spans"))
    counts = [secrets.count_of(F.col("__spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), temperature=0.5, seed="mix", details=True)
    return mixed.withColumnsRenamed({"__copy": "copy", "__rate": "rate", "__order": "order_key"})


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"), F.col("__keep").alias("keep"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = langid.fit(docs.filter(~F.coalesce(held_out, F.lit(True))))
    return langid.identify(docs, model, held_out)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def az_lowered(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc32_of("doc_id") % 5 == 0, az_lowered(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, found={"text": tampered})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score(table(spark, sf_dir, "documents"), crc32_of("doc_id") % 7 == 2)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, terms=10)


QUERIES = {
    f.__name__: f
    for f in (op1_topk, op2_token_counts, op3_secret_scans, op4_mix_sources, op5_quality, op6_fingerprints, op7_packing, op8_url_filters, op9_language_id, op10_ngram_jaccard, op11_merkle_manifest, op12_lm_scores, op13_source_divergence)
}


def _spans_sql() -> str:
    """The base rules one by one: matches and the pieces between them, whose lengths add up to the places."""
    parts = []
    for place, rule in enumerate(secrets.BASE_RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, hits, gaps, groups, unnest(range(1, len(hits) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS hits, string_split_regex(text, '{pattern}') AS gaps,
                    regexp_extract_all(text, '{pattern}', {rule.group}) AS groups FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
            ) WHERE len(hits) > 0""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.BASE_RULES))
    return f"""
        WITH found AS ({" UNION ALL ".join(parts)}),
        placed AS (
            SELECT doc_id, place, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start, length(hits[i]) AS n
            FROM found WHERE length(groups[i]) >= CASE place {least} END
        ),
        listed AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(kind || ':' || start::bigint || ':' || (start + n)::bigint, ',' ORDER BY start, place) AS spans FROM placed GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN listed USING (doc_id)
    """


#: CRC-32 of a decimal id, bit by bit over its digits.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({id}::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _manifest_sql() -> str:
    """Levels of all trees by recursion, then siblings of every row level by level, then the fold of what is found."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    climb = """
        {name} AS (
            SELECT 0 AS level, tree, pos, digest, n FROM {base}
            UNION ALL
            SELECT any_value(level) + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, pos // 16
        )"""
    return f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS digest, CASE WHEN {_CRC32.format(id="doc_id")} % 5 = 0 THEN {leaf("lowered")} ELSE {leaf("text")} END AS found
            FROM (SELECT *, {lowered} AS lowered FROM documents)
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
        {climb.format(name="own", base="placed")},
        subroots AS (
            SELECT 'root' AS tree, tree AS name, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1
        ),
        {climb.format(name="top", base="subroots")},
        nodes AS (SELECT 0 AS tier, * FROM own UNION ALL SELECT 1, * FROM top),
        ways AS (
            SELECT doc_id, p.tree AS name, p.pos AS leaf_pos, 0 AS tier, p.tree AS tree, l.level, p.pos >> (4 * l.level) AS pos FROM placed p JOIN (SELECT DISTINCT tree, level FROM own WHERE n > 1) l ON l.tree = p.tree
            UNION ALL
            SELECT doc_id, p.tree, p.pos, 1, 'root', l.level, s.pos >> (4 * l.level) FROM placed p JOIN subroots s ON s.name = p.tree CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l
        ),
        joined AS (
            SELECT w.name, w.leaf_pos, w.tier, w.level, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < w.pos), '') AS before, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > w.pos), '') AS after
            FROM ways w JOIN nodes x ON x.tier = w.tier AND x.tree = w.tree AND x.level = w.level AND x.pos // 16 = w.pos // 16 GROUP BY ALL
        ),
        steps AS (SELECT *, row_number() OVER (PARTITION BY name, leaf_pos ORDER BY tier, level) AS nth FROM joined),
        proofs AS (SELECT name, leaf_pos, sha256(string_agg(before || after, '' ORDER BY nth)) AS proof, max(nth) AS steps FROM steps GROUP BY ALL),
        folds AS (
            SELECT tree AS name, pos AS leaf_pos, 0::bigint AS nth, found AS digest FROM placed
            UNION ALL
            SELECT f.name, f.leaf_pos, s.nth, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s ON s.name = f.name AND s.leaf_pos = f.leaf_pos AND s.nth = f.nth + 1
        )
        SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
        FROM placed p JOIN subroots s ON s.name = p.tree CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
        LEFT JOIN proofs q ON q.name = p.tree AND q.leaf_pos = p.pos JOIN folds f ON f.name = p.tree AND f.leaf_pos = p.pos AND f.nth = coalesce(q.steps, 0)
    """


ORACLE_SQL = {
    "op13_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ),
        counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS df FROM words GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::bigint AS n FROM counted GROUP BY ALL HAVING sum(df) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(n)::bigint AS total FROM kept GROUP BY lang),
        sources AS (SELECT DISTINCT lang, source FROM docs),
        held AS (
            SELECT s.lang, s.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n FROM sources s JOIN kept k USING (lang)
            LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ),
        totals AS (SELECT lang, source, sum(n)::bigint AS total FROM held GROUP BY ALL),
        shares AS (
            SELECT lang, source, term, h.n, (1 + 1000000000::hugeint * (h.n + 2) // (t.total + 2 * l.v))::hugeint AS p, (1 + 1000000000::hugeint * (h.lang_n + 2) // (l.total + 2 * l.v))::hugeint AS q
            FROM held h JOIN totals t USING (lang, source) JOIN langs l USING (lang)
        ),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint AS value
            FROM sources a JOIN sources b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL
        ),
        found AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint FROM shares WHERE n > 0 AND p > q
        ),
        ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::integer AS rank FROM found)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op11_merkle_manifest": _manifest_sql(),
    "op3_secret_scans": _spans_sql(),
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda x: x[1] * x[2]))::bigint AS score
            FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
        ),
        ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::integer AS rank, vec_id, score FROM scored)
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op4_mix_sources": mixing.MIX_SQL.format(docs="documents", seed="mix", temperature=0.5),
    "op8_url_filters": r"""
        WITH u AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ),
        rules(rule_host, rule_path, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ),
        best AS (
            SELECT u.*, (
                SELECT max((length(rule_host || rule_path), rule_host || rule_path, rules.verdict)) FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            ) AS r FROM u
        )
        SELECT page_id, host, path, r[2] AS rule, coalesce(r[3], 'allow') AS verdict FROM best
    """,
}
