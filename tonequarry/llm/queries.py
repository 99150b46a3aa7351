"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonequarry.llm import ann, bpe, html, interaction, licenses, lines, media, merkle, packing, quality, secrets, simhash, urls
from tonequarry.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored(table(spark, sf_dir, "documents")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(lines.dedup_lines(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


#: The rules, and the hosts whose canonical URLs are listed.
RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{h}/",) for h in LISTED_HOSTS], "key string")
    return urls.judge(table(spark, sf_dir, "pages"), RULES, listed)


def op10_sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r.host + r.path))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    rule = " ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules, strict=True))
    hosts = ", ".join(f"'{h}'" for h in LISTED_HOSTS)
    return f"""
        WITH parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^www[.]', '') AS b FROM parts)
        SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
               CASE {verdict} WHEN EXISTS (SELECT 1 FROM unnest([{hosts}]) AS l(h) WHERE b = h OR ends_with(b, '.' || h)) THEN 'block' ELSE 'allow' END AS verdict
        FROM bare"""


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=True)


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_simhash": op2_simhash, "op3_media": op3_media, "op4_lines": op4_lines, "op5_quality": op5_quality, "op6_neighbours": op6_neighbours, "op7_html": op7_html, "op8_packing": op8_packing, "op9_secrets": op9_secrets, "op10_urls": op10_urls, "op11_licenses": op11_licenses, "op12_manifest": op12_manifest, "op13_interaction": op13_interaction}


def oracle_sql() -> dict[str, str]:
    return {"op10_urls": op10_sql(), "op11_licenses": licenses.sql(), "op12_manifest": merkle.sql(), "op13_interaction": interaction.sql()}
