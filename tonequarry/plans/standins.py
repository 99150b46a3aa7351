"""Stand-ins for filings, prices and fundamentals, as SQL that Spark and DuckDB both read, over the test tables.

The factors below one keep averages off the ties of rounding, on which the two engines differ.

Names in braces are other stand-ins or tables. Doubles are rounded where sums may differ in their last digits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

STANDINS = {
    "filings": """
        SELECT o.o_orderkey AS accession, o.o_custkey AS cik, CAST(o.o_orderdate AS DATE) AS date_filed,
               CAST(year(o.o_orderdate) AS INT) AS filing_year,
               CASE o.o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K405' ELSE '10-K/A' END AS form_type, s.permno
        FROM {orders} o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS permno FROM {lineitem} GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey""",
    "bars": """
        SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice / l_quantity) * 0.99731002393, 6) AS prc,
               CAST(sum(l_quantity) AS DOUBLE) AS vol, round(avg(l_discount) * 0.99731002393 - 0.05, 6) AS ret, CAST(count(*) + 10 AS DOUBLE) AS shrout,
               CAST(l_suppkey % 4 AS INT) AS exchcd
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "market": """
        SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) * 0.99731002393 - 0.05, 6) AS vwretd, round(avg(l_discount) * 0.99713004171 - 0.0507, 6) AS mktrf,
               round(avg(l_tax) * 0.99731002393 - 0.04, 6) AS smb, round((avg(l_quantity) * 0.99731002393 - 25.5) / 1000, 7) AS hml, CAST(0.0001 AS DOUBLE) AS rf
        FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)""",
    "daily": "SELECT b.*, m.vwretd, m.mktrf, m.smb, m.hml, m.rf FROM {bars} b JOIN {market} m ON b.date = m.date",
    "fundamentals": """
        SELECT o_custkey AS cik, o_custkey + 100000 AS gvkey, CAST(o_custkey % 10 + 1 AS BIGINT) AS permno, CAST(year(o_orderdate) AS INT) AS fyear,
               round(sum(o_totalprice), 2) AS be, round(sum(o_totalprice), 2) + 1000 * count(*) AS mkt_value,
               round(sum(o_totalprice) / (sum(o_totalprice) + 1000 * count(*)), 6) AS bm,
               CAST(o_custkey % 9000 AS INT) AS sic, CAST(CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey * 7 % 9000 END AS INT) AS sich
        FROM {orders} WHERE o_custkey % 3 <> 0 GROUP BY o_custkey, year(o_orderdate)""",
    "history": """
        SELECT o_custkey AS cik, o_custkey + 100001 AS gvkey, CAST(min(o_orderdate) AS DATE) AS linkdt,
               CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(max(o_orderdate) AS DATE) END AS linkenddt
        FROM {orders} WHERE o_custkey % 3 = 0 GROUP BY o_custkey""",
    "monthly": """
        SELECT permno, CAST(date_trunc('month', date) AS DATE) AS yrmon, max(prc) AS prc, CAST(permno % 4 AS INT) AS exchcd,
               CAST(CASE WHEN (permno + month(max(date))) % 7 = 0 THEN NULL ELSE 10 + permno % 3 END AS INT) AS shrcd,
               CAST(CASE WHEN permno % 5 = 0 THEN NULL ELSE permno * 37 % 9000 END AS INT) AS siccd
        FROM {bars} GROUP BY permno, CAST(date_trunc('month', date) AS DATE) HAVING (permno + month(max(date))) % 5 <> 0""",
    "names": """
        SELECT permno, CAST(min(date) AS DATE) AS namedt, CASE WHEN permno % 2 = 0 AND year(min(date)) = 2001 THEN NULL ELSE CAST(max(date) AS DATE) END AS nameendt,
               CAST(permno * 100 + year(min(date)) % 100 AS BIGINT) AS ticker
        FROM {bars} GROUP BY permno, year(date)""",
    "holdings": """
        SELECT l_suppkey AS mgrno, l_partkey % 50 AS cusip, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS rdate, CAST(l_shipdate AS DATE) AS fdate,
               l_orderkey * 10 + l_linenumber AS seq, l_quantity AS shares
        FROM {lineitem}""",
    "published": """
        SELECT doc_id, n_chars AS n_words, doc_id % 40 AS n_negative, doc_id % 30 AS n_positive, doc_id % 7 AS n_negation FROM {documents}""",
    "changes": """
        SELECT user_id % 40 AS accession, CAST(event_id AS BIGINT) AS seq, event_type AS status, CAST(user_id AS BIGINT) AS cik, round(value, 2) AS size FROM {events}""",
    "log": "SELECT c_custkey % 60 + 20 AS accession, 0 AS seq, min(c_mktsegment) AS status, min(c_custkey) AS cik, CAST(0 AS DOUBLE) AS size FROM {customer} GROUP BY c_custkey % 60",
    "scores": """
        SELECT o_orderkey AS accession, round(100.0 * (o_orderkey * 37 % 29) / 200, 6) AS tone, round(100.0 * (o_orderkey * 37 % 29 - o_orderkey * 37 % 29 % 3) / 200, 6) AS tone_positive,
               round((o_orderkey * 53 % 97) / 97.0, 6) AS tfidf, round((o_orderkey * 53 % 97 - o_orderkey % 5) / 97.0, 6) AS tfidf_positive,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(100.0 * (o_orderkey * 31 % 23) / 150, 6) END AS section_tone, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round((o_orderkey * 59 % 89) / 89.0, 6) END AS section_tfidf
        FROM {orders}""",
    "inst_own": """
        SELECT permno, CAST(date_trunc('quarter', date) AS DATE) AS yqtr, round(sum(vol) / 100000, 6) AS inst_own FROM {bars}
        GROUP BY permno, CAST(date_trunc('quarter', date) AS DATE)""",
    "ranges": """
        SELECT * FROM (VALUES (100, 999, 1, 1), (800, 1999, 2, 2), (2000, 3999, 3, 3), (3500, 3599, 4, 4), (5000, 8999, 5, 5), (6000, 6099, 6, 6)) AS r(low, high, industry, line)""",
}


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or stand-in."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = STANDINS[name]
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in needs(text)})


def sql(select: str) -> str:
    """A statement for DuckDB with the stand-ins that it names in braces as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in needs(text):
            if n in STANDINS and n not in order:
                add(STANDINS[n])
                order.append(n)

    add(select)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    parts = [f"{n} AS ({plain(STANDINS[n])})" for n in order]
    body = plain(select).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
