"""The queries of this subpackage: one opN_<name> for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnspark.llm import url_filter
from bnspark.llm.common import read
from bnspark.llm.exact_dedup import exact_duplicates
from bnspark.llm.fingerprints import edited_fingerprints
from bnspark.llm.licenses import license_scan
from bnspark.llm.line_dedup import line_report
from bnspark.llm.mixing import mixing_rates
from bnspark.llm.quality import quality_scores
from bnspark.llm.sentencepiece_bpe import token_digests
from bnspark.llm.simhash import simhash_components
from bnspark.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP5_RULES = [
    url_filter.split_rule(rule, verdict)
    for rule, verdict in (
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"),
    )
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(read(spark, sf_dir, "pages"), OP5_RULES)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(read(spark, sf_dir, "documents"), shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_license_scan": op3_license_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_warc": op7_warc,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
}

# A-Z alone are lower-cased, so the letters are translated and the rest stays as it is.
OP4_SQL = """
WITH t AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

def _op7_sql() -> str:
    """Base32 of a digest: each five of its 160 bits, looked up among all five bits, name a letter."""
    codes = " ".join(f"{k:05b}" for k in range(32))
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (strpos('{}', substr(bits, {}, 5)) - 1) // 6, 1)"
    digest = " || ".join(letter.format(codes, 5 * i + 1) for i in range(32))
    return f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
    SELECT page_id, strlen(html) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY html) AS owner
    FROM t
)
SELECT page_id, payload_bytes, {digest} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d
"""


def _op5_sql() -> str:
    """The rules, and the sums over damped paths of up to MOST_ROUNDS links."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in OP5_RULES)
    d = url_filter.DAMPING
    ctes = [
        f"rules(of_host, of_path, said) AS (VALUES {rules})",
        "u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,"
        " regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        "hit AS (SELECT page_id, host, path, arg_max(of_host || of_path, length(of_host || of_path)) AS rule,"
        " arg_max(said, length(of_host || of_path)) AS said FROM p JOIN rules"
        " ON host <> '' AND (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, of_path) GROUP BY ALL)",
        "ruled AS (SELECT p.page_id, p.host, p.path, hit.rule, hit.said FROM p LEFT JOIN hit USING (page_id))",
        "marks AS (SELECT host, count(*) AS pages, count(*) FILTER (said = 'block') AS bad, count(*) FILTER (said = 'allow') AS good"
        " FROM ruled WHERE host <> '' GROUP BY host)",
        f"seed0 AS (SELECT CASE WHEN bad >= {url_filter.MOSTLY} * pages THEN 'distrust' WHEN good > 0 THEN 'trust' END AS kind, host FROM marks)",
        "seeds AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS share FROM seed0 WHERE kind IS NOT NULL)",
        "link0 AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''),"
        f" '(?i)href\\s*=\\s*[\"'']?(?:https?:)?//([^/?#\"''\\s>]+)', 1)), '{url_filter.UPPER}', '{url_filter.LOWER}') AS dst FROM p)",
        "link AS (SELECT src, dst, count(*) AS n FROM link0 WHERE src <> '' AND src <> dst GROUP BY ALL)",
        "both0 AS (SELECT 'trust' AS kind, src AS host, dst, n FROM link UNION ALL SELECT 'distrust', dst, src, n FROM link)",
        f"edges AS (SELECT kind, host, dst, {d} * n / sum(n) OVER (PARTITION BY kind, host) AS w FROM both0)",
        "path(k, kind, host, v) AS (SELECT 0, kind, host, share FROM seeds UNION ALL SELECT k + 1, e.kind, e.dst, sum(e.w * v)"
        f" FROM path JOIN edges e ON e.kind = path.kind AND e.host = path.host WHERE k < {url_filter.MOST_ROUNDS} GROUP BY k, e.kind, e.dst)",
        "raw AS (SELECT kind, host, sum(v) AS score FROM path GROUP BY ALL)",
        "ranks AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM raw)",
    ]
    ctes += [
        "size AS (SELECT kind, count(*) AS many FROM seeds GROUP BY kind)",
        "excess AS (SELECT host FROM ranks JOIN size USING (kind) GROUP BY host"
        f" HAVING sum(CASE kind WHEN 'trust' THEN -score * many ELSE score * many END) > {url_filter.THRESHOLD})",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT page_id, host, path, rule,"
        " coalesce(said, CASE WHEN host IN (SELECT host FROM excess) THEN 'block' END, 'allow') AS verdict FROM ruled"
    )


ORACLES: dict[str, str] = {"op5_url_filter": _op5_sql(), "op4_exact_dedup": OP4_SQL, "op7_warc": _op7_sql()}
