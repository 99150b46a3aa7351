"""Queries of the study's operators, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonequarry.functions import columns as C
from tonequarry.functions.batches import narrow_batches
from tonequarry.functions.text import clean_text
from tonequarry.operators import eventtime, links, membership, regress, rows, stats, tone
from tonequarry.plans import pipeline
from tonequarry.plans.standins import frame, sql
from tonequarry.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The test tables and stand-ins of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return frame(self.spark, self.folder, name)


def query(name: str, statement: str | None = None) -> Callable:
    """Registers a function of ``t(name) -> DataFrame`` and its statement."""

    def add(make: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if statement is not None:
            ORACLES[name] = sql(statement)
        return make

    return add


def rounded(df: DataFrame, digits: int = 6, *but: str) -> DataFrame:
    return df.select(*(F.round(n, digits).alias(n) if kind == "double" and n not in but else F.col(n) for n, kind in df.dtypes))


# --- sources ---------------------------------------------------------------------------------------------------------

LINE = "concat(CAST(o_custkey AS VARCHAR(20)), '|', 'CO ', CAST(o_custkey AS VARCHAR(20)), '|', CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K405/A' ELSE '8-K' END, '|', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), '|edgar/data/', CAST(o_custkey AS VARCHAR(20)), '/', lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '0'), '-97-', lpad(CAST(o_orderkey % 1000000 AS VARCHAR(20)), 6, '0'), '.txt')"


@query(
    "SRC4_index_lines",
    """SELECT o_custkey AS cik, 'CO ' || o_custkey AS company_name, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-97-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession,
       CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-K405/A' END AS form_type, CASE o_orderstatus WHEN 'F' THEN '10K' ELSE '10KA' END AS form_family, CAST(o_orderdate AS DATE) AS date_filed,
       'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-97-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '.txt' AS txt_url, 'pending' AS status
       FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def _(t: Tables) -> DataFrame:
    lines = t("orders").select(F.expr(LINE).alias("value"))
    head = lines.sparkSession.createDataFrame([("CIK|Company Name|Form Type|Date Filed|Filename",), ("-----",), ("12|too|few",)], "value string")
    return readers.index_lines(head.unionByName(lines))


@query("SRC5_parquet_projection", "SELECT doc_id, lang FROM documents WHERE n_chars > 5000")
def _(t: Tables) -> DataFrame:
    return t("documents").where("n_chars > 5000").select("doc_id", "lang")


@query("SRC2_by_year", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    orders = t("orders")
    return rows.count_by(readers.by_year(lambda y: orders.where(F.year("o_orderdate") == y).select(F.year("o_orderdate").alias("year")), 1996, 1998), "year")


@query("SRC12_done_keys", "SELECT DISTINCT accession FROM {changes} WHERE status = 'click'")
def _(t: Tables) -> DataFrame:
    return t("changes").where("status = 'click'").select("accession").distinct()


@query("SRC14_quarters", "SELECT y.y AS year, q.q AS quarter FROM (SELECT unnest(range(min(filing_year), max(filing_year) + 1)) AS y FROM {filings}) y, range(1, 5) q(q) WHERE (y.y, q.q) NOT IN (SELECT (year(date_filed), quarter(date_filed)) FROM {filings})")
def _(t: Tables) -> DataFrame:
    """The quarters of the filings' years that are still to be fetched."""
    return readers.missing_quarters(t("filings"), "date_filed")


@query("SRC8_dictionary", "SELECT DISTINCT upper(p_type) AS word, p_size % 3 <> 0 AS neg, p_size % 5 <> 0 AS pos FROM (SELECT p_type, min(p_size) AS p_size FROM part GROUP BY p_type)")
def _(t: Tables) -> DataFrame:
    words = t("part").groupBy("p_type").agg(F.min("p_size").alias("s")).select(F.col("p_type").alias("word"), (F.col("s") % 3 * 2009).alias("negative"), (F.col("s") % 5 * 2009).alias("positive"))
    return tone.dictionary(words)


# --- projections and predicates --------------------------------------------------------------------------------------


@query("PRJ1_columns", "SELECT o_orderkey AS accession, o_custkey AS cik FROM orders")
def _(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cik"))


@query("PRJ2_form_family", "SELECT accession, CASE form_type WHEN '10-K' THEN '10K' WHEN '10-K405' THEN '10K' WHEN '10-K/A' THEN '10KA' END AS family FROM {filings}")
def _(t: Tables) -> DataFrame:
    return t("filings").select("accession", C.label(F.col("form_type"), readers.FAMILIES).alias("family"))


@query("PRJ3_extended_family", "SELECT accession, CASE form_type WHEN '10-K' THEN '10K' WHEN '10-K405' THEN '10K' WHEN '10-K/A' THEN '10KA' END AS family FROM {filings}")
def _(t: Tables) -> DataFrame:
    return t("filings").select("accession", C.label(F.translate("form_type", "/", "-"), readers.EXTENDED_FAMILIES).alias("family"))


@query("PRJ4_code_label", "SELECT permno, date, CASE exchcd WHEN 1 THEN 'NYSE' WHEN 2 THEN 'AMEX' WHEN 3 THEN 'NASDAQ' ELSE 'OTHER' END AS exchange FROM {bars}")
def _(t: Tables) -> DataFrame:
    return t("bars").select("permno", "date", C.label(F.col("exchcd"), {1: "NYSE", 2: "AMEX", 3: "NASDAQ"}, "OTHER").alias("exchange"))


@query("PRJ5_coalesce_chain", "SELECT cik, fyear, coalesce(sich, sic, 0) AS code FROM {fundamentals}")
def _(t: Tables) -> DataFrame:
    return t("fundamentals").select("cik", "fyear", F.coalesce("sich", "sic", F.lit(0)).alias("code"))


@query("PRJ6_positive_ratio", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS be, round(CASE WHEN c_acctbal > 0 AND c_nationkey <> 0 THEN c_acctbal / c_nationkey END, 6) AS bm FROM customer")
def _(t: Tables) -> DataFrame:
    be = C.positive(F.col("c_acctbal"))
    return t("customer").select("c_custkey", be.alias("be"), F.round(C.ratio(be, F.col("c_nationkey")), 6).alias("bm"))


@query("PRJ7_safe_coercion", "SELECT doc_id, try_cast(substr(text, 1, 4) AS DOUBLE) AS number, try_cast(lang AS DATE) AS day FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", C.number(F.substring("text", 1, 4)).alias("number"), C.to_date(F.col("lang")).alias("day"))


@query("PRJ8_sentinels", "SELECT cik, coalesce(linkenddt, DATE '2099-12-31') AS linkenddt, linkdt FROM {history}")
def _(t: Tables) -> DataFrame:
    return t("history").select("cik", F.coalesce("linkenddt", F.lit("2099-12-31").cast("date")).alias("linkenddt"), "linkdt")


@query("PRJ9_price_scale", "SELECT permno, date, abs(prc) AS prc, shrout / 1000 AS shrout, nullif(exchcd, 0) AS siccd FROM {bars}")
def _(t: Tables) -> DataFrame:
    return t("bars").select("permno", "date", F.abs("prc").alias("prc"), (F.col("shrout") / 1000).alias("shrout"), C.nonzero(F.col("exchcd")).alias("siccd"))


@query("PRJ10_where", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN n_chars END AS long_only FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("long_only"))


@query("PRJ11_clip", "SELECT cik, fyear, CASE WHEN sich IS NULL THEN NULL ELSE least(greatest(sich, 100), 5000) END AS code, CASE WHEN sich IS NULL THEN NULL ELSE greatest(CAST(sich AS DOUBLE), 1000.0) END AS floor FROM {fundamentals}")
def _(t: Tables) -> DataFrame:
    return t("fundamentals").select("cik", "fyear", C.clipped(F.col("sich"), F.lit(100), F.lit(5000)).alias("code"), C.at_least(F.col("sich").cast("double"), 1000.0).alias("floor"))


@query("FLT1_year_filter", "SELECT permno, date, ret FROM {bars} WHERE year(date) BETWEEN 1996 AND 1997")
def _(t: Tables) -> DataFrame:
    return t("bars").where(F.year("date").between(1996, 1997)).select("permno", "date", "ret")


@query("FLT2_membership", "SELECT accession FROM {filings} WHERE form_type IN ('10-K', '10-K405')")
def _(t: Tables) -> DataFrame:
    return t("filings").where(F.col("form_type").isin("10-K", "10-K405")).select("accession")


@query("FLT3_drop_missing", "SELECT cik, fyear FROM {fundamentals} WHERE sich IS NOT NULL AND bm IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t("fundamentals").na.drop(subset=["sich", "bm"]).select("cik", "fyear")


@query("FLT4_string_predicates", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') AND ends_with(p_name, 'e') OR length(p_type) = 8")
def _(t: Tables) -> DataFrame:
    p = t("part")
    return p.where((F.col("p_brand").startswith("Brand#1") & F.col("p_name").endswith("e")) | (F.length("p_type") == 8)).select("p_partkey")


@query("FLT5_anti_membership", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)")
def _(t: Tables) -> DataFrame:
    return membership.todo(t("orders").select("o_orderkey"), t("documents").select(F.col("doc_id").alias("o_orderkey")), "o_orderkey")


@query("FLT6_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice / l_quantity BETWEEN 950 AND 1050")
def _(t: Tables) -> DataFrame:
    return t("lineitem").where((F.col("l_extendedprice") / F.col("l_quantity")).between(950, 1050)).select("l_orderkey", "l_linenumber")


@query("FLT7_options", "SELECT accession FROM {filings} WHERE form_type = '10-K/A' AND permno % 3 + 10 IN (10, 12)")
def _(t: Tables) -> DataFrame:
    o = pipeline.Options(forms=("10-K/A",), share_codes=(10, 12))
    return t("filings").where(F.col("form_type").isin(*o.forms) & (F.col("permno") % 3 + 10).isin(*o.share_codes)).select("accession")


@query("TXT6_accession", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-07-000001' END AS accession FROM orders")
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-07-000001.txt"))).otherwise("x/none.txt")
    return t("orders").select("o_orderkey", C.accession_of(name).alias("accession"))


@query("TXT7_strings", "SELECT p_partkey, trim(p_name) || '/' || substr(p_type, 1, 8) AS url, nullif(p_brand, 'Brand#11') AS brand FROM part")
def _(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.concat(F.trim("p_name"), F.lit("/"), F.substring("p_type", 1, 8)).alias("url"), F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("brand"))


# --- dates -----------------------------------------------------------------------------------------------------------


@query("DAT1_parts", "SELECT accession, CAST(year(date_filed) AS INT) AS y, CAST(month(date_filed) AS INT) AS m, CAST(date_trunc('month', date_filed) AS DATE) AS month_start, CAST(date_trunc('quarter', date_filed) AS DATE) AS quarter_start, CAST(date_filed - DATE '1995-01-01' AS INT) AS gap FROM {filings}")
def _(t: Tables) -> DataFrame:
    d = F.col("date_filed")
    return t("filings").select("accession", F.year(d).alias("y"), F.month(d).alias("m"), C.month_start(d).alias("month_start"), C.quarter_start(d).alias("quarter_start"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("gap"))


@query("DAT2_quarter_end", "SELECT accession, last_day(CAST(date_trunc('quarter', date_filed) AS DATE) + INTERVAL 2 MONTH) AS quarter_end FROM {filings}")
def _(t: Tables) -> DataFrame:
    return t("filings").select("accession", C.quarter_end(F.col("date_filed")).alias("quarter_end"))


@query("DAT3_quarter_month", "SELECT accession FROM {filings} WHERE month(date_filed) IN (3, 6, 9, 12)")
def _(t: Tables) -> DataFrame:
    return t("filings").where(C.ends_quarter(F.col("date_filed"))).select("accession")


@query("WIN10_previous_quarter", "SELECT accession, CAST(CAST(date_trunc('quarter', date_filed) AS DATE) - 1 AS DATE) AS yqtr FROM {filings}")
def _(t: Tables) -> DataFrame:
    return t("filings").select("accession", C.previous_quarter_end(F.col("date_filed")).alias("yqtr"))


# --- joins -----------------------------------------------------------------------------------------------------------

KEEP = "accession, cik, date_filed, filing_year"


@query("JN1_left_join", "SELECT f.accession, d.lang FROM {filings} f LEFT JOIN documents d ON d.doc_id = f.accession")
def _(t: Tables) -> DataFrame:
    return t("filings").join(t("documents").select(F.col("doc_id").alias("accession"), "lang"), "accession", "left").select("accession", "lang")


@query("JN2_inner_multi_key", "SELECT f.accession, m.prc FROM {filings} f JOIN {monthly} m ON m.permno = f.permno AND m.yrmon = CAST(date_trunc('month', f.date_filed) AS DATE)")
def _(t: Tables) -> DataFrame:
    return t("filings").withColumn("yrmon", C.month_start(F.col("date_filed"))).join(t("monthly"), ["permno", "yrmon"]).select("accession", "prc")


@query("JN3_inner_check", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def _(t: Tables) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "quality")


@query("JN4_dimension", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(t: Tables) -> DataFrame:
    return t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("JN5_link_history", "SELECT f.accession, h.gvkey FROM {filings} f LEFT JOIN {history} h ON h.cik = f.cik AND f.date_filed >= h.linkdt AND f.date_filed <= coalesce(h.linkenddt, DATE '2099-12-31') AND h.gvkey % 4 <> 0")
def _(t: Tables) -> DataFrame:
    f, h = t("filings"), t("history").withColumnRenamed("gvkey", "g")
    return links.valid_on(f, h, "cik", "date_filed", "linkdt", "linkenddt", F.col("g") % 4 != 0).select("accession", F.col("g").alias("gvkey"))


@query("JN6_name_history", "SELECT f.accession, n.ticker FROM {filings} f LEFT JOIN {names} n ON n.permno = f.permno AND f.date_filed >= n.namedt AND f.date_filed <= coalesce(n.nameendt, DATE '2099-12-31')")
def _(t: Tables) -> DataFrame:
    return links.valid_on(t("filings"), t("names"), "permno", "date_filed", "namedt", "nameendt").select("accession", "ticker")


@query("JN7_date_dimension", "SELECT b.permno, b.date, b.ret, m.vwretd, m.smb FROM {bars} b LEFT JOIN {market} m ON m.date = b.date")
def _(t: Tables) -> DataFrame:
    return t("bars").join(t("market"), "date", "left").select("permno", "date", "ret", "vwretd", "smb")


NEAREST = """SELECT f.accession, f.cik, f.date_filed, f.filing_year, u.gvkey, u.permno, row_number() OVER (PARTITION BY f.accession ORDER BY abs(u.fyear - (f.filing_year - 1)) NULLS LAST, u.fyear DESC NULLS LAST, u.gvkey) AS k
             FROM {filings} f LEFT JOIN {fundamentals} u ON u.cik = f.cik"""


@query("JN8_nearest_year", f"SELECT {KEEP}, gvkey, permno FROM ({NEAREST}) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    f = t("filings").select(*KEEP.split(", "))
    out = links.nearest_year(f, t("fundamentals").select("cik", "gvkey", "permno", "fyear"), "cik", "accession", "filing_year", "fyear", [F.col("gvkey")])
    return out.drop("fyear")


@query(
    "JN9_latest_interval",
    """SELECT accession, gvkey FROM (SELECT f.accession, h.gvkey, row_number() OVER (PARTITION BY f.accession ORDER BY h.linkdt DESC, h.gvkey) AS k
       FROM {filings} f JOIN {history} h ON h.cik = f.cik AND f.date_filed >= h.linkdt AND f.date_filed <= coalesce(h.linkenddt, DATE '2099-12-31')) WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    return links.latest_valid(t("filings"), t("history"), "cik", "accession", "date_filed", "linkdt", "linkenddt", ["gvkey"]).select("accession", "gvkey")


@query(
    "JN11_linked_filings",
    f"""WITH a AS (SELECT * FROM ({NEAREST}) WHERE k = 1),
        b AS (SELECT * FROM (SELECT a.accession, a.filing_year, h.gvkey, row_number() OVER (PARTITION BY a.accession ORDER BY h.linkdt DESC, h.gvkey) AS j
              FROM a JOIN {{history}} h ON h.cik = a.cik AND a.date_filed >= h.linkdt AND a.date_filed <= coalesce(h.linkenddt, DATE '2099-12-31') WHERE a.gvkey IS NULL) WHERE j = 1),
        c AS (SELECT * FROM (SELECT b.accession, b.gvkey, u.permno, row_number() OVER (PARTITION BY b.accession ORDER BY abs(u.fyear - (b.filing_year - 1)) NULLS LAST, u.fyear DESC NULLS LAST, u.permno) AS i
              FROM b LEFT JOIN {{fundamentals}} u ON u.gvkey = b.gvkey) WHERE i = 1)
        SELECT a.accession, a.cik, a.date_filed, a.filing_year, coalesce(a.gvkey, c.gvkey) AS gvkey, CASE WHEN a.gvkey IS NOT NULL THEN a.permno ELSE c.permno END AS permno,
               CASE WHEN a.gvkey IS NOT NULL THEN 'compustat' WHEN c.gvkey IS NOT NULL THEN 'comphist' ELSE 'none' END AS match_source
        FROM a LEFT JOIN c ON c.accession = a.accession""",
)
def _(t: Tables) -> DataFrame:
    return links.linked(t("filings"), t("fundamentals"), t("history"))


@query("JN10_second_hop", "SELECT * FROM (SELECT h.cik, h.gvkey, u.permno, row_number() OVER (PARTITION BY h.cik ORDER BY abs(u.fyear - (year(h.linkdt) - 1)) NULLS LAST, u.fyear DESC NULLS LAST, u.permno) AS k FROM {history} h LEFT JOIN {fundamentals} u ON u.gvkey = h.gvkey) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    h = t("history").select("cik", "gvkey", F.year("linkdt").alias("y"))
    out = links.nearest_year(h, t("fundamentals").select("gvkey", "permno", "fyear"), "gvkey", "cik", "y", "fyear", [F.col("permno")])
    return out.select("cik", "gvkey", "permno", F.lit(1).cast("long").alias("k"))


AS_OF = """SELECT f.accession, CASE WHEN m.yrmon = f.yrmon OR m.shrcd IS NOT NULL THEN m.shrcd END AS shrcd, CASE WHEN m.yrmon = f.yrmon OR m.shrcd IS NOT NULL THEN m.prc END AS prc
           FROM (SELECT *, CAST(date_trunc('month', date_filed) AS DATE) AS yrmon FROM {filings} WHERE permno IS NOT NULL) f
           ASOF LEFT JOIN {monthly} m ON m.permno = f.permno AND m.yrmon <= f.yrmon"""


@query("JN12_as_of", AS_OF)
def _(t: Tables) -> DataFrame:
    f = t("filings").where("permno IS NOT NULL").withColumn("yrmon", C.month_start(F.col("date_filed")))
    return links.as_of(f, t("monthly"), "permno", "accession", "yrmon", ["shrcd", "prc"], 100_000, "shrcd").select("accession", "shrcd", "prc")


@query("JN13_previous_year", "SELECT f.accession, u.bm FROM {filings} f JOIN {fundamentals} u ON u.cik = f.cik AND u.fyear = f.filing_year - 1 WHERE u.be > 0")
def _(t: Tables) -> DataFrame:
    u = t("fundamentals").where("be > 0").select("cik", (F.col("fyear") + 1).alias("filing_year"), "bm")
    return t("filings").join(u, ["cik", "filing_year"]).select("accession", "bm")


@query("JN14_previous_quarter_join", "SELECT f.accession, o.inst_own FROM {filings} f LEFT JOIN {inst_own} o ON o.permno = f.permno AND o.yqtr = CAST(date_trunc('quarter', CAST(date_trunc('quarter', f.date_filed) AS DATE) - 1) AS DATE)")
def _(t: Tables) -> DataFrame:
    f = t("filings").withColumn("yqtr", C.quarter_start(C.previous_quarter_end(F.col("date_filed"))))
    return f.join(t("inst_own"), ["permno", "yqtr"], "left").select("accession", "inst_own")


@query("JN16_semi_join", "SELECT accession FROM {filings} WHERE accession IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t: Tables) -> DataFrame:
    good = t("labels").where("quality = 1").select(F.col("doc_id").alias("accession"))
    return membership.known(t("filings").select("accession"), good, "accession")


DENSE = "SELECT c.code, r.industry FROM range(0, 10000) c(code) JOIN {ranges} r ON c.code BETWEEN r.low AND r.high QUALIFY row_number() OVER (PARTITION BY c.code ORDER BY r.line DESC) = 1"


@query("JN17_range_lookup", f"WITH d AS ({DENSE}) SELECT u.cik, u.fyear, coalesce(d.industry, 49) AS industry FROM {{fundamentals}} u LEFT JOIN d ON d.code = u.sich")
def _(t: Tables) -> DataFrame:
    dense = links.dense_ranges(t("ranges"), "low", "high", "industry", "line")
    return links.range_lookup(t("fundamentals"), F.col("sich"), dense, "industry", 49).select("cik", "fyear", "industry")


@query("JN15_dictionary_map", "SELECT f.accession, m.static_siccd FROM {filings} f LEFT JOIN (SELECT permno, max_by(siccd, yrmon) AS static_siccd FROM {monthly} WHERE siccd IS NOT NULL GROUP BY permno) m ON m.permno = f.permno")
def _(t: Tables) -> DataFrame:
    return t("filings").join(pipeline.last_known(t("monthly")), "permno", "left").select("accession", "static_siccd")


@query("JN18_outer_counts", "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS mine, coalesce(b.n, 0) AS theirs, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 20000 GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) b ON a.lang = b.lang")
def _(t: Tables) -> DataFrame:
    d = t("documents")
    return rows.breakdown(d.where("n_chars > 20000"), d, "lang")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("AGG1_crosstab", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) AS \"TOTAL\" FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rows.crosstab(t("orders").withColumn("year", F.year("o_orderdate")), "year", "o_orderstatus", ["F", "O", "P"])


@query("AGG2_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rows.count_by(t("events"), "event_type").orderBy(F.desc("n"), "event_type")


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mgrno, cusip, rdate ORDER BY fdate DESC, seq DESC) AS k FROM {holdings}) WHERE k = 1"


@query("AGG3_latest_holdings", f"SELECT cusip, rdate, sum(shares) AS shares FROM ({LATEST}) GROUP BY cusip, rdate")
def _(t: Tables) -> DataFrame:
    return rows.first_by(t("holdings"), ["mgrno", "cusip", "rdate"], [F.desc("fdate"), F.desc("seq")]).groupBy("cusip", "rdate").agg(F.sum("shares").alias("shares"))


@query("AGG8_distinct_on", f"SELECT mgrno, cusip, rdate, seq FROM ({LATEST})")
def _(t: Tables) -> DataFrame:
    return rows.first_by(t("holdings"), ["mgrno", "cusip", "rdate"], [F.desc("fdate"), F.desc("seq")]).select("mgrno", "cusip", "rdate", "seq")


@query("AGG4_ratio_sum", "SELECT permno, CAST(date_trunc('quarter', date) AS DATE) AS yqtr, round(sum(vol / shrout), 6) AS io FROM {bars} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return rounded(t("bars").groupBy("permno", C.quarter_start(F.col("date")).alias("yqtr")).agg(F.sum(C.ratio(F.col("vol"), F.col("shrout"))).alias("io")))


@query("AGG5_distinct_count", "SELECT count(DISTINCT permno) AS firms, count(DISTINCT cik) AS ciks FROM {filings}")
def _(t: Tables) -> DataFrame:
    return t("filings").agg(F.countDistinct("permno").alias("firms"), F.countDistinct("cik").alias("ciks"))


@query("AGG6_keep_last", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return rows.first_by(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, filing_year ORDER BY date_filed, accession) AS k FROM {filings}) WHERE k = 1"


@query("AGG7_first_of_year", f"SELECT accession, cik, filing_year FROM ({FIRST})")
def _(t: Tables) -> DataFrame:
    return rows.first_by(t("filings"), ["cik", "filing_year"], ["date_filed", "accession"]).select("accession", "cik", "filing_year")


DESCRIBED = ("prc", "vol", "ret")


@query("AGG9_describe", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS sd, min({c}) AS min, max({c}) AS max FROM {{bars}}" for c in DESCRIBED))
def _(t: Tables) -> DataFrame:
    return rounded(stats.describe(t("bars"), DESCRIBED))


@query("AGG10_quantiles", " UNION ALL ".join(f"SELECT {p} AS p, round(quantile_cont(prc, {p}), 6) AS value FROM {{bars}}" for p in (0.01, 0.5, 0.99)))
def _(t: Tables) -> DataFrame:
    return rounded(stats.quantiles(t("bars"), "prc", [0.01, 0.5, 0.99])).select(F.col("p").cast("decimal(3,2)").alias("p"), "value")


@query("AGG11_winsorize", "SELECT permno, date, round(least(greatest(prc, lo), hi), 6) AS prc FROM {bars}, (SELECT quantile_cont(prc, 0.01) AS lo, quantile_cont(prc, 0.99) AS hi FROM {bars})")
def _(t: Tables) -> DataFrame:
    return rounded(stats.winsorize(t("bars"), ["prc"]).select("permno", "date", "prc"))


@query("AGG11_winsorize_by_quarter", "SELECT b.permno, b.date, round(least(greatest(prc, lo), hi), 6) AS prc FROM {bars} b JOIN (SELECT date_trunc('quarter', date) AS q, quantile_cont(prc, 0.01) AS lo, quantile_cont(prc, 0.99) AS hi FROM {bars} GROUP BY 1) c ON c.q = date_trunc('quarter', b.date)")
def _(t: Tables) -> DataFrame:
    return rounded(stats.winsorize(t("bars").withColumn("q", C.quarter_start(F.col("date"))), ["prc"], by=["q"]).select("permno", "date", "prc"))


@query("AGG12_coverage", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(100.0 * count({c}) / count(*), 6) AS pct FROM {{fundamentals}}" for c in ("sic", "sich")))
def _(t: Tables) -> DataFrame:
    return rounded(stats.coverage(t("fundamentals"), ["sic", "sich"]))


RELATIVE = "SELECT (l_extendedprice / 1000 - l_quantity) / l_quantity AS d FROM lineitem WHERE l_quantity > 0"


@query("AGG13_agreement", f"SELECT count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg(CAST(abs(d) <= 0.02 AS DOUBLE)), 6) AS within_2, round(avg(CAST(abs(d) <= 0.05 AS DOUBLE)), 6) AS within_5 FROM ({RELATIVE})")
def _(t: Tables) -> DataFrame:
    return rounded(stats.agreement(t("lineitem").select((F.col("l_extendedprice") / 1000).alias("m"), F.col("l_quantity").alias("q")), "m", "q"))


@query("AGG14_correlation", "SELECT round(corr(prc, vol), 6) AS r FROM {bars}")
def _(t: Tables) -> DataFrame:
    return rounded(t("bars").agg(F.corr("prc", "vol").alias("r")))


@query("AGG15_match_rate", "SELECT round(avg(CAST(d.doc_id IS NOT NULL AS DOUBLE)), 6) AS rate FROM {filings} f LEFT JOIN documents d ON d.doc_id = f.accession")
def _(t: Tables) -> DataFrame:
    both = t("filings").join(t("documents").select(F.col("doc_id").alias("accession"), F.lit(1).alias("m")), "accession", "left")
    return rounded(both.agg(F.avg(F.col("m").isNotNull().cast("int")).alias("rate")))


@query("AGG16_size_ratio", "SELECT count(*) AS n, count(*) FILTER (r BETWEEN 0.95 AND 1.05) AS good, count(*) FILTER (r < 0.5) AS low, count(*) FILTER (r > 1.5) AS high, round(median(r), 6) AS median, round(avg(r), 6) AS mean FROM (SELECT l_extendedprice / 1000 / l_quantity AS r FROM lineitem WHERE l_quantity > 0)")
def _(t: Tables) -> DataFrame:
    return rounded(stats.size_check(t("lineitem").select((F.col("l_extendedprice") / 1000).alias("m"), F.col("l_quantity").alias("q")), "m", "q"))


# --- order, sets, samples, state -------------------------------------------------------------------------------------


@query("ORD1_mixed_sort", "SELECT cik, fyear, row_number() OVER (ORDER BY sich ASC NULLS LAST, fyear DESC, cik) AS k FROM {fundamentals}")
def _(t: Tables) -> DataFrame:
    ordered = t("fundamentals").orderBy(F.asc_nulls_last("sich"), F.desc("fyear"), "cik").select("cik", "fyear")
    # a global position for the comparison: partitions are in order, so their sizes give each row's place
    placed = ordered.withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id())
    before = placed.groupBy("p").count().withColumn("b", F.sum("count").over(Window.orderBy("p")) - F.col("count"))
    return placed.join(F.broadcast(before), "p").withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("m")) + F.col("b")).select("cik", "fyear", "k")


@query("LIM1_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t: Tables) -> DataFrame:
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("LIM2_per_group", "SELECT permno, date FROM (SELECT *, row_number() OVER (PARTITION BY permno ORDER BY date) AS k FROM {bars}) WHERE k <= 4")
def _(t: Tables) -> DataFrame:
    return rows.first_by(t("bars"), ["permno"], ["date"], 4).select("permno", "date")


@query(
    "SET1_coverage",
    """SELECT count(a) AS n_mine, count(b) AS n_theirs, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS only_mine, count(*) FILTER (a IS NULL) AS only_theirs,
       round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(b), 6) AS recall_pct
       FROM (SELECT DISTINCT o_orderkey AS a FROM orders) x FULL JOIN (SELECT DISTINCT doc_id AS b FROM documents) y ON a = b""",
)
def _(t: Tables) -> DataFrame:
    return rows.coverage(t("orders").select(F.col("o_orderkey").alias("k")), t("documents").select(F.col("doc_id").alias("k")), "k")


@query("SET2_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def _(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_custkey").alias("k")).unionByName(t("customer").select(F.col("c_custkey").alias("k")))


@query("SMP1_stratified_size", "SELECT CAST(year(o_orderdate) AS INT) AS year, least(count(*), 2) AS n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rows.count_by(rows.stratified(t("orders").withColumn("year", F.year("o_orderdate")), "year", "o_orderkey", 2), "year")


@query(
    "SNK6_upsert",
    """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY seq DESC) AS k FROM {changes}) WHERE k = 1)
       SELECT l.accession, CAST(l.seq AS BIGINT) AS seq, l.status, l.cik, l.size FROM {log} l WHERE l.accession NOT IN (SELECT accession FROM c)
       UNION ALL SELECT c.accession, c.seq, c.status, coalesce(l.cik, c.cik), c.size FROM c LEFT JOIN {log} l ON l.accession = c.accession""",
)
def _(t: Tables) -> DataFrame:
    state = t("log").withColumn("seq", F.col("seq").cast("long"))
    return rows.upsert(state, t("changes"), "accession", ["cik"], [F.desc("seq")])


@query("SNK2_exchangeable", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(year(o_orderdate) AS DOUBLE) AS y FROM orders")
def _(t: Tables) -> DataFrame:
    return sinks.exchangeable(t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")))


# --- text and tone ---------------------------------------------------------------------------------------------------

#: DuckDB's word boundaries know ASCII letters only, so others become a letter that ends no token.
TOKENS = r"regexp_extract_all(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g'), '\b[A-Z][A-Z\-]+\b')"
EACH = f"SELECT doc_id, unnest({TOKENS}) AS word FROM documents"
WORDS = f"SELECT DISTINCT word, length(word) % 7 = 0 AS neg, length(word) % 5 = 0 AS pos FROM (SELECT unnest({TOKENS}) AS word FROM benchmark)"
TERMS = "SELECT e.doc_id, e.word, count(*) AS tf, any_value(w.neg) AS neg, any_value(w.pos) AS pos FROM e JOIN w ON w.word = e.word GROUP BY e.doc_id, e.word"
COUNTS = "SELECT d.doc_id, coalesce(sum(tf), 0) AS n_words, coalesce(sum(tf) FILTER (neg), 0) AS n_neg, coalesce(sum(tf) FILTER (pos), 0) AS n_pos FROM documents d LEFT JOIN terms t ON t.doc_id = d.doc_id GROUP BY d.doc_id"
HEAD = f"WITH e AS ({EACH}), w AS ({WORDS}), terms AS ({TERMS}), counts AS ({COUNTS})"


def word_list(t: Tables) -> DataFrame:
    """A dictionary: the words of the benchmark's texts, flagged by their length."""
    known = t("benchmark").select(F.explode(tone.tokens(F.upper("text"))).alias("word")).distinct()
    return known.select("word", (F.length("word") % 7 == 0).alias("neg"), (F.length("word") % 5 == 0).alias("pos"))


@query("TXT3_tokens", f"SELECT doc_id, len({TOKENS}) AS n, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    words = tone.tokens(F.upper("text"))
    return t("documents").select("doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


@query("TXT5_dictionary", f"SELECT word, neg, pos FROM ({WORDS})")
def _(t: Tables) -> DataFrame:
    return word_list(t)


@query("TXT4_term_frequency", f"{HEAD} SELECT doc_id, word, tf FROM terms WHERE neg")
def _(t: Tables) -> DataFrame:
    d = t("documents")
    return tone.term_counts(d, word_list(t)).where("neg").select("doc_id", "word", "tf")


@query("SCR1_proportional_tone", f"{HEAD} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_neg AS BIGINT) AS n_neg, CAST(n_pos AS BIGINT) AS n_pos, round(CASE WHEN n_words > 0 THEN 100.0 * n_neg / n_words END, 6) AS neg_pct, round(CASE WHEN n_words > 0 THEN 100.0 * n_pos / n_words END, 6) AS pos_pct FROM counts")
def scr1(t: Tables) -> DataFrame:
    d = t("documents")
    return rounded(tone.proportional(tone.word_counts(d, word_list(t))))


@query("AGG17_document_frequency", f"{HEAD} SELECT word, count(*) AS df FROM terms WHERE neg GROUP BY word")
def _(t: Tables) -> DataFrame:
    d = t("documents")
    return tone.document_frequency(tone.term_counts(d, word_list(t)).where("neg"))


@query(
    "SCR3_tfidf",
    f"""{HEAD}, neg AS (SELECT * FROM terms WHERE neg), idf AS (SELECT word, ln((SELECT count(*) FROM counts)::DOUBLE / count(*)) AS idf FROM neg GROUP BY word)
        SELECT c.doc_id, round(coalesce(s.w, 0) / (1 + ln(greatest(c.n_words, 1))), 6) AS tfidf FROM counts c LEFT JOIN (SELECT n.doc_id, sum((1 + ln(n.tf)) * i.idf) AS w FROM neg n JOIN idf i ON i.word = n.word GROUP BY n.doc_id) s ON s.doc_id = c.doc_id""",
)
def _(t: Tables) -> DataFrame:
    d = t("documents")
    words = word_list(t)
    return rounded(tone.tfidf(tone.term_counts(d, words).where("neg"), tone.word_counts(d, words)))


@query("SCR5_published_scores", "SELECT doc_id, round(100.0 * n_negative / n_words, 6) AS neg_pct, round(100.0 * n_positive / n_words, 6) AS pos_pct, round(100.0 * (n_positive - 2 * n_negation) / n_words, 6) AS net_pos_pct FROM {published}")
def _(t: Tables) -> DataFrame:
    return rounded(tone.published_scores(t("published")).select("doc_id", "neg_pct", "pos_pct", "net_pos_pct"))


@query("SCR6_transforms", "SELECT cik, fyear, round(ln(greatest(bm, 0.000001)), 6) AS log_bm, round(sqrt(mkt_value), 6) AS root FROM {fundamentals}")
def _(t: Tables) -> DataFrame:
    return rounded(t("fundamentals").select("cik", "fyear", C.log_floor(F.col("bm"), 1e-6).alias("log_bm"), F.sqrt("mkt_value").alias("root")))


@query("SCR7_dummy", "SELECT permno, yrmon, CAST(coalesce(exchcd, -1) = 3 AS INT) AS nasdaq FROM {monthly}")
def _(t: Tables) -> DataFrame:
    return t("monthly").select("permno", "yrmon", (F.coalesce("exchcd", F.lit(-1)) == 3).cast("int").alias("nasdaq"))


@query("SCR8_industry", f"WITH d AS ({DENSE}) SELECT u.cik, u.fyear, coalesce(d.industry, 49) AS industry FROM {{fundamentals}} u LEFT JOIN d ON d.code = coalesce(u.sich, u.sic)")
def _(t: Tables) -> DataFrame:
    dense = links.dense_ranges(t("ranges"), "low", "high", "industry", "line")
    return links.range_lookup(t("fundamentals"), pipeline.industry_code("sich"), dense, "industry", 49).select("cik", "fyear", "industry")


@query("SCR9_gap_to_target", "SELECT permno, yrmon, round(100.0 * (prc - 997) / 997, 6) AS gap_pct FROM {monthly}")
def _(t: Tables) -> DataFrame:
    return rounded(t("monthly").select("permno", "yrmon", C.percent(F.col("prc") - 997, F.lit(997)).alias("gap_pct")))


@query("SCR10_report_units", "SELECT permno, yqtr, round(inst_own * 100, 4) AS inst_own_pct FROM {inst_own}")
def _(t: Tables) -> DataFrame:
    return rounded(t("inst_own").select("permno", "yqtr", (F.col("inst_own") * 100).alias("inst_own_pct")), 4)


# --- event time ------------------------------------------------------------------------------------------------------

DAYS = "SELECT *, CAST(row_number() OVER (PARTITION BY permno ORDER BY date) AS INT) AS td FROM {daily}"
EVENTS = "SELECT f.accession, f.permno, f.date_filed, coalesce(b.td, 0) AS before FROM (SELECT accession, permno, date_filed FROM {filings} WHERE permno IS NOT NULL) f ASOF LEFT JOIN days b ON b.permno = f.permno AND b.date < f.date_filed"
SPAN = "SELECT e.accession, e.before, d.td - e.before - 1 AS off, d.* FROM ev e JOIN days d ON d.permno = e.permno AND d.td BETWEEN e.before + 1 - 257 AND e.before + 1 + 255"
TIME = f"WITH days AS ({DAYS}), ev AS ({EVENTS}), span AS ({SPAN})"


@query("JN19_event_day", f"WITH days AS ({DAYS}) SELECT accession, permno, date_filed, CAST(before AS BIGINT) AS before FROM ({EVENTS})")
def _(t: Tables) -> DataFrame:
    days = eventtime.trading_days(t("daily"))
    return eventtime.event_days(t("filings"), days).select("accession", "permno", "date_filed", "before")


@query("WIN1_gap_filter", "SELECT accession FROM (SELECT accession, date_filed - lag(date_filed) OVER (PARTITION BY cik ORDER BY date_filed, accession) AS gap FROM {filings}) WHERE gap IS NULL OR gap >= 180")
def _(t: Tables) -> DataFrame:
    return eventtime.gap_filter(t("filings")).select("accession")


CHECKS = """SELECT accession, count(*) FILTER (off BETWEEN 0 AND 3 AND vol >= 0) = 4 AS ev_ok, count(*) FILTER (off BETWEEN -257 AND -6 AND vol >= 0) AS pre,
    count(*) FILTER (off BETWEEN 4 AND 255 AND vol >= 0) AS post, max(abs(prc)) FILTER (off = -1) AS price_before FROM span GROUP BY accession"""
CHECKED = "SELECT ev.accession, coalesce(ev_ok, false) AS ev_ok, coalesce(ev_ok AND before >= 65 AND pre >= 60 AND post >= 60, false) AS pre_post_ok, price_before FROM ev LEFT JOIN ck ON ck.accession = ev.accession"


@query("WIN2_WIN5_event_checks", f"{TIME}, ck AS ({CHECKS}) {CHECKED}")
def _(t: Tables) -> DataFrame:
    days = eventtime.trading_days(t("daily"))
    return eventtime.checks(t("filings"), days)


def _minor(i: int, j: int) -> str:
    names = ["m", "s", "h"]
    return "c" + "".join(sorted((names[i], names[j]), key=names.index))


def _alpha() -> str:
    """The intercept from centred moments, the slopes by Cramer's rule."""
    a = [[_minor(i, j) for j in range(3)] for i in range(3)]
    b = ["ym", "ys", "yh"]
    det = lambda m: f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]}) + {m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"
    slope = lambda k: f"{det([[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)])} / {det(a)}"
    return f"(y - ({slope(0)}) * mm - ({slope(1)}) * ms - ({slope(2)}) * mh) * 252"


_IN = "FILTER (off BETWEEN -257 AND -6)"
_PART = "FILTER (off <= -6 AND off >= CASE WHEN before >= 257 THEN -252 ELSE -257 END)"


MOMENTS = f"""SELECT accession, before, count(*) FILTER (off BETWEEN 0 AND 3) AS n4,
        {" * ".join(f"max(1 + ret) FILTER (off = {o})" for o in range(4))} AS grown, {" * ".join(f"max(1 + vwretd) FILTER (off = {o})" for o in range(4))} AS market,
        max(abs(prc)) FILTER (off = -1) * max(shrout) FILTER (off = -1) / 1000 AS size_b, count(*) {_PART} AS ns, max(shrout) FILTER (off = -1) AS shares,
        sum(CASE WHEN exchcd = 3 AND date <= DATE '2001-12-31' THEN vol / 2 ELSE vol END) {_PART} AS volume, count(*) {_IN} AS nc,
        avg(ret - rf) {_IN} AS y, avg(mktrf) {_IN} AS mm, avg(smb) {_IN} AS ms, avg(hml) {_IN} AS mh,
        covar_pop(mktrf, ret - rf) {_IN} AS ym, covar_pop(smb, ret - rf) {_IN} AS ys, covar_pop(hml, ret - rf) {_IN} AS yh,
        covar_pop(mktrf, mktrf) {_IN} AS cmm, covar_pop(mktrf, smb) {_IN} AS cms, covar_pop(mktrf, hml) {_IN} AS cmh, covar_pop(smb, smb) {_IN} AS css, covar_pop(smb, hml) {_IN} AS csh, covar_pop(hml, hml) {_IN} AS chh
        FROM span GROUP BY accession, before"""
VARIABLES = f"""SELECT ev.accession, round(CASE WHEN n4 = 4 THEN (grown - market) * 100 END, 6) AS excret, round(CASE WHEN n4 = 4 THEN size_b END, 9) AS size_b,
        round(CASE WHEN n4 = 4 AND ev.before >= 60 AND ns >= 60 AND shares > 0 THEN volume / (shares * 1000000) END, 9) AS turnover,
        round(CASE WHEN n4 = 4 AND ev.before >= 60 AND nc >= 60 THEN {_alpha()} END, 4) AS alpha FROM ev LEFT JOIN mo ON mo.accession = ev.accession"""


@query("WIN6_WIN9_event_variables", f"{TIME}, mo AS ({MOMENTS}) {VARIABLES}")
def _(t: Tables) -> DataFrame:
    days = eventtime.trading_days(t("daily"))
    out = eventtime.variables(t("filings"), days)
    return out.select("accession", F.round("excret", 6).alias("excret"), F.round("size_b", 9).alias("size_b"), F.round("turnover", 9).alias("turnover"), F.round("alpha", 4).alias("alpha"))


@query("WIN11_last_code", "SELECT permno, max_by(siccd, yrmon) AS static_siccd FROM {monthly} WHERE siccd IS NOT NULL AND yrmon <= DATE '1999-06-30' GROUP BY permno")
def _(t: Tables) -> DataFrame:
    return pipeline.last_known(t("monthly"), "1999-06-30")


@query("WIN12_same_day_weight", "SELECT accession, round(1.0 / count(*) OVER (PARTITION BY date_filed), 9) AS w FROM {filings}")
def _(t: Tables) -> DataFrame:
    return t("filings").select("accession", F.round(1.0 / F.count("*").over(Window.partitionBy("date_filed")), 9).alias("w"))


@query("WIN13_thin_cells", "SELECT cik, fyear FROM (SELECT cik, fyear, count(*) OVER (PARTITION BY fyear, sic % 48) AS n FROM {fundamentals}) WHERE n >= 10")
def _(t: Tables) -> DataFrame:
    u = t("fundamentals").withColumn("industry", F.col("sic") % 48)
    return u.withColumn("n", F.count("*").over(Window.partitionBy("fyear", "industry"))).where("n >= 10").select("cik", "fyear")


# --- funnel ----------------------------------------------------------------------------------------------------------


@query(
    "FUN1_FUN3_first_filters",
    """WITH a AS (SELECT * FROM {filings} WHERE form_type IN ('10-K', '10-K405')), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, filing_year ORDER BY date_filed, accession) AS k FROM a) WHERE k = 1),
       c AS (SELECT * FROM (SELECT *, date_filed - lag(date_filed) OVER (PARTITION BY cik ORDER BY date_filed, accession) AS gap FROM b) WHERE gap IS NULL OR gap >= 180)
       SELECT 'forms' AS filter, count(*) AS n FROM a UNION ALL SELECT 'first_of_year', count(*) FROM b UNION ALL SELECT 'distance', count(*) FROM c""",
)
def _(t: Tables) -> DataFrame:
    kept = pipeline.survivors(t("filings").select("accession", "cik", "date_filed", "form_type"), pipeline.Options())
    out = None
    for name, df in zip(("forms", "first_of_year", "distance"), kept, strict=True):
        one = df.agg(F.lit(name).alias("filter"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "AGG19_cumulative_flags",
    """SELECT 0 AS step, 'all' AS filter, count(*) AS n FROM orders UNION ALL SELECT 1, 'a', count(*) FILTER (o_orderkey % 2 = 0) FROM orders
       UNION ALL SELECT 2, 'b', count(*) FILTER (o_orderkey % 2 = 0 AND o_totalprice > 100000) FROM orders UNION ALL SELECT 3, 'c', count(*) FILTER (o_orderkey % 2 = 0 AND o_totalprice > 100000 AND o_orderstatus = 'F') FROM orders""",
)
def _(t: Tables) -> DataFrame:
    o = t("orders").select((F.col("o_orderkey") % 2 == 0).alias("a"), (F.col("o_totalprice") > 100000).alias("b"), (F.col("o_orderstatus") == "F").alias("c"))
    return stats.funnel(o, ["a", "b", "c"])


# --- regressions -----------------------------------------------------------------------------------------------------


@query(
    "REG4_newey_west",
    """WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, o_orderpriority AS g, avg(o_totalprice) AS beta, count(*) AS n FROM orders GROUP BY 1, 2),
       m AS (SELECT *, sum(n * beta) OVER (PARTITION BY g) / sum(n) OVER (PARTITION BY g) AS coef FROM q), u AS (SELECT *, n * (beta - coef) AS u FROM m),
       l AS (SELECT *, coalesce(lag(u, 1) OVER w, 0) AS u1, coalesce(lag(u, 2) OVER w, 0) AS u2, coalesce(lag(u, 3) OVER w, 0) AS u3 FROM u WINDOW w AS (PARTITION BY g ORDER BY quarter))
       SELECT g, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_quarters, round(any_value(coef), 4) AS coef, round(sqrt(sum(u * u + 2 * 0.75 * u * u1 + 2 * 0.5 * u * u2 + 2 * 0.25 * u * u3)) / sum(n), 4) AS se FROM l GROUP BY g""",
)
def _(t: Tables) -> DataFrame:
    q = t("orders").groupBy(C.quarter_start(F.to_date("o_orderdate")).alias("quarter"), F.col("o_orderpriority").alias("g")).agg(F.avg("o_totalprice").alias("beta"), F.count("*").alias("n"))
    q = q.select("*", F.lit(0.0).alias("r2"), F.lit(3).alias("lags"), F.lit(True).alias("ts_weight"))
    return rounded(regress.newey_west(q, ["g"]).select("g", "n", "n_quarters", "coef", "se"), 4)


# --- cleaning, sections, checks --------------------------------------------------------------------------------------

def raw_filing() -> Column:
    """A document as the body of an annual report, with markup, an entity and a numeric table."""
    return F.concat(F.lit("<SEC-HEADER>x</SEC-HEADER><DOCUMENT>\n<TYPE>10-K\n<TEXT>"), F.col("text"), F.lit(" <b>A</b> &amp; <TABLE>1 2 3</TABLE></TEXT></DOCUMENT>"))


@query("TXT1_clean_text", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')) || '  A  & ', '-\s*\n\s*', '-', 'g'), '[ \t\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents""")
def _(t: Tables) -> DataFrame:
    return narrow_batches(t("documents")).select("doc_id", F.md5(clean_text(raw_filing())).alias("digest"))


@query("JN20_probe", "SELECT o.o_orderkey, d.n_chars FROM orders o JOIN documents d ON d.doc_id = o.o_orderkey")
def _(t: Tables) -> DataFrame:
    return t("orders").join(t("documents"), F.col("o_orderkey") == F.col("doc_id")).select("o_orderkey", "n_chars")


@query(
    "VAL1_key_coverage",
    """SELECT count(a) AS n_mine, count(b) AS n_theirs, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS only_mine, count(*) FILTER (a IS NULL) AS only_theirs,
       round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(b), 6) AS recall_pct FROM (SELECT DISTINCT accession AS a FROM {filings} WHERE form_type = '10-K') x FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) y ON a = b""",
)
def _(t: Tables) -> DataFrame:
    return rows.coverage(t("filings").where("form_type = '10-K'").select(F.col("accession").alias("k")), t("labels").select(F.col("doc_id").alias("k")), "k")


@query("VAL2_family_breakdown", "SELECT coalesce(a.f, b.f) AS form_type, coalesce(a.n, 0) AS mine, coalesce(b.n, 0) AS theirs, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM (SELECT form_type AS f, count(*) AS n FROM {filings} WHERE permno IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT form_type AS f, count(*) AS n FROM {filings} WHERE form_type <> '10-K' GROUP BY 1) b ON a.f = b.f")
def _(t: Tables) -> DataFrame:
    return rows.breakdown(t("filings").where("permno IS NOT NULL"), t("filings").where("form_type <> '10-K'"), "form_type")


@query("VAL3_size_check", "SELECT count(*) AS n, count(*) FILTER (r BETWEEN 0.95 AND 1.05) AS good, count(*) FILTER (r < 0.5) AS low, count(*) FILTER (r > 1.5) AS high, round(median(r), 6) AS median, round(avg(r), 6) AS mean FROM (SELECT octet_length(encode(text)) / n_chars AS r FROM documents WHERE n_chars > 0)")
def _(t: Tables) -> DataFrame:
    return rounded(stats.size_check(t("documents").select(F.octet_length("text").alias("m"), "n_chars"), "m", "n_chars"))


@query("VAL4_count_check", "SELECT count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg(CAST(abs(d) <= 0.02 AS DOUBLE)), 6) AS within_2, round(avg(CAST(abs(d) <= 0.05 AS DOUBLE)), 6) AS within_5 FROM (SELECT (octet_length(encode(text)) - n_chars) / n_chars AS d FROM documents WHERE n_chars > 0)")
def _(t: Tables) -> DataFrame:
    return rounded(stats.agreement(t("documents").select(F.octet_length("text").alias("m"), "n_chars"), "m", "n_chars"))


@query("VAL5_comparison", "SELECT a.event_type AS label, a.mine, b.target, round(100.0 * (a.mine - b.target) / b.target, 6) AS gap_pct FROM (SELECT event_type, count(*) AS mine FROM events GROUP BY 1) a JOIN (SELECT event_type, 7 + count(DISTINCT user_id) AS target FROM events GROUP BY 1) b ON a.event_type = b.event_type")
def _(t: Tables) -> DataFrame:
    e = t("events")
    mine, target = e.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("mine")), e.groupBy(F.col("event_type").alias("label")).agg((7 + F.countDistinct("user_id")).alias("target"))
    return rounded(mine.join(target, "label").withColumn("gap_pct", C.percent(F.col("mine") - F.col("target"), F.col("target"))))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone of the documents: tokens, dictionary, counts, proportional scores."""
    return scr1(Tables(spark, sf_dir))


from tonequarry.plans import studies  # noqa: E402, F401  registers the composite queries
