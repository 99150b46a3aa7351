"""Composite queries: the funnel, the panel, regressions and their grid, section tone, stored tables and files."""

from __future__ import annotations

import dataclasses
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonequarry.functions import columns as C
from tonequarry.functions.batches import narrow_batches
from tonequarry.functions.text import clean_text, extract_section, tokens
from tonequarry.operators import eventtime, links, regress, rows, selection, stats, tone
from tonequarry.plans import pipeline
from tonequarry.plans.queries import CHECKED, CHECKS, DAYS, DENSE, EACH, EVENTS, HEAD, MOMENTS, NEAREST, SPAN, TERMS, TIME, TOKENS, VARIABLES, WORDS, Tables, query, rounded, word_list
from tonequarry.sources import readers, sinks
from tonequarry.sources.versioned import VersionedTable

# --- funnel ----------------------------------------------------------------------------------------------------------

FUNNEL_OPTIONS = pipeline.Options(least_words=500, share_codes=(10, 11, 12), least_price=900.0)

#: The link, first to the primary table and then through the history, of the filings in ``c``.
LINKED = f"""a1 AS (SELECT * FROM ({NEAREST.replace("{filings}", "c")}) WHERE k = 1),
    b1 AS (SELECT * FROM (SELECT a1.accession, a1.filing_year, h.gvkey, row_number() OVER (PARTITION BY a1.accession ORDER BY h.linkdt DESC, h.gvkey) AS j
           FROM a1 JOIN {{history}} h ON h.cik = a1.cik AND a1.date_filed >= h.linkdt AND a1.date_filed <= coalesce(h.linkenddt, DATE '2099-12-31') WHERE a1.gvkey IS NULL) WHERE j = 1),
    c1 AS (SELECT * FROM (SELECT b1.accession, b1.gvkey, u.permno, row_number() OVER (PARTITION BY b1.accession ORDER BY abs(u.fyear - (b1.filing_year - 1)) NULLS LAST, u.fyear DESC NULLS LAST, u.permno) AS i
           FROM b1 LEFT JOIN {{fundamentals}} u ON u.gvkey = b1.gvkey) WHERE i = 1),
    linked AS (SELECT a1.accession, a1.date_filed, a1.filing_year, coalesce(a1.gvkey, c1.gvkey) AS gvkey, CASE WHEN a1.gvkey IS NOT NULL THEN a1.permno ELSE c1.permno END AS permno,
               CAST(date_trunc('month', a1.date_filed) AS DATE) AS yrmon FROM a1 LEFT JOIN c1 ON c1.accession = a1.accession)"""
#: The latest month at or before the filing's, at most 400 days earlier; without a share code only the filing's own month counts.
MONTHLY = """months AS (SELECT l.accession, CASE WHEN m.yrmon = l.yrmon OR m.shrcd IS NOT NULL THEN m.shrcd END AS shrcd,
    CASE WHEN m.yrmon = l.yrmon OR m.shrcd IS NOT NULL THEN m.exchcd END AS exchcd, CASE WHEN m.yrmon = l.yrmon OR m.shrcd IS NOT NULL THEN m.prc END AS prc
    FROM linked l LEFT JOIN {monthly} m ON m.permno = l.permno AND m.yrmon <= l.yrmon AND l.yrmon - m.yrmon <= 400
    QUALIFY row_number() OVER (PARTITION BY l.accession ORDER BY m.yrmon DESC NULLS LAST) = 1)"""
FUNNEL_FLAGS = ["permno IS NOT NULL", "shrcd IN (10, 11, 12)", "prc IS NOT NULL", "price_before >= 900", "ev_ok", "exchcd IN (1, 2, 3)", "pre_post_ok", "bm IS NOT NULL", "o.o_orderkey % 3 <> 0 AND o.o_orderkey % 2000 >= 500"]
FUNNEL_STEPS = ["linked", "share_code", "market_cap", "price", "event_window", "exchange", "pre_post", "book_to_market", "words"]


def _funnel_sql() -> str:
    flags = ", ".join(f"coalesce({c}, false) AS f{i}" for i, c in enumerate(FUNNEL_FLAGS))
    steps = " UNION ALL ".join(f"SELECT {i + 4} AS step, 'f_{n}' AS filter, count(*) FILTER ({' AND '.join(f'f{k}' for k in range(i + 1))}) AS n FROM flags" for i, n in enumerate(FUNNEL_STEPS))
    return f"""WITH a AS (SELECT * FROM {{filings}} WHERE form_type IN ('10-K', '10-K405')), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, filing_year ORDER BY date_filed, accession) AS kk FROM a) WHERE kk = 1),
        c AS (SELECT * FROM (SELECT *, date_filed - lag(date_filed) OVER (PARTITION BY cik ORDER BY date_filed, accession) AS gap FROM b) WHERE gap IS NULL OR gap >= 180),
        {LINKED}, {MONTHLY}, days AS ({DAYS}), ev AS ({EVENTS.replace("{filings}", "linked")}), span AS ({SPAN}), ck AS ({CHECKS}), checked AS ({CHECKED}),
        yr AS (SELECT gvkey, fyear + 1 AS filing_year, min(bm) AS bm FROM {{fundamentals}} WHERE be > 0 AND bm IS NOT NULL AND mkt_value IS NOT NULL GROUP BY 1, 2),
        flags AS (SELECT {flags} FROM linked l JOIN months m ON m.accession = l.accession LEFT JOIN checked k ON k.accession = l.accession
                  LEFT JOIN yr ON yr.gvkey = l.gvkey AND yr.filing_year = l.filing_year LEFT JOIN orders o ON o.o_orderkey = l.accession)
        SELECT 1 AS step, 'forms' AS filter, count(*) AS n FROM a UNION ALL SELECT 2, 'first_of_year', count(*) FROM b UNION ALL SELECT 3, 'distance', count(*) FROM c UNION ALL {steps}"""


@query("FUN_sample_funnel", _funnel_sql())
def _(t: Tables) -> DataFrame:
    o = FUNNEL_OPTIONS
    kept = pipeline.survivors(t("filings").select("accession", "cik", "date_filed", "form_type"), o)
    words = t("orders").select(F.col("o_orderkey").alias("accession"), (F.col("o_orderkey") % 3 != 0).alias("ok"), (F.col("o_orderkey") % 2000).alias("n_words"))
    flags = pipeline.flagged(kept[2], t("fundamentals"), t("history"), t("monthly"), t("daily"), words, o)
    return pipeline.funnel_report(t("filings"), kept, flags)


#: The event variables with turnover and size as they are, for logarithms.
EXACT = VARIABLES.replace("round(CASE WHEN n4 = 4 AND ev.before >= 60 AND ns >= 60 AND shares > 0 THEN volume / (shares * 1000000) END, 9)", "CASE WHEN n4 = 4 AND ev.before >= 60 AND ns >= 60 AND shares > 0 THEN volume / (shares * 1000000) END").replace("round(CASE WHEN n4 = 4 THEN size_b END, 9)", "CASE WHEN n4 = 4 THEN size_b END")

# --- panel -----------------------------------------------------------------------------------------------------------


@query(
    "PANEL_analysis",
    f"""{TIME}, mo AS ({MOMENTS}), v AS ({EXACT}), d AS ({DENSE}), st AS (SELECT permno, max_by(siccd, yrmon) AS s FROM {{monthly}} WHERE siccd IS NOT NULL AND yrmon <= DATE '2008-12-31' GROUP BY permno),
        s AS (SELECT f.accession, f.cik, f.permno, u.gvkey, f.date_filed, u.bm, u.sic, u.sich, m.exchcd, m.siccd FROM {{filings}} f JOIN {{fundamentals}} u ON u.cik = f.cik AND u.fyear = f.filing_year - 1
              LEFT JOIN {{monthly}} m ON m.permno = f.permno AND m.yrmon = CAST(date_trunc('month', f.date_filed) AS DATE))
        SELECT s.accession, s.cik, s.permno, s.gvkey, s.date_filed, CAST(coalesce(d.industry, 49) AS INT) AS industry, v.excret, v.alpha, o.inst_own, round(100.0 * (s.accession % 13) / 200, 6) AS neg_pct,
               round((s.accession % 17) / 10.0, 6) AS tfidf, CASE WHEN v.size_b IS NOT NULL THEN round(ln(greatest(v.size_b, 0.000001)), 4) END AS log_size, round(ln(greatest(s.bm, 0.000001)), 6) AS log_bm,
               CASE WHEN v.turnover IS NOT NULL THEN round(ln(greatest(v.turnover, 0.000000001)), 3) END AS log_turnover, CAST(coalesce(s.exchcd, -1) = 3 AS INT) AS nasdaq
        FROM s LEFT JOIN v ON v.accession = s.accession LEFT JOIN {{inst_own}} o ON o.permno = s.permno AND o.yqtr = CAST(date_trunc('quarter', CAST(date_trunc('quarter', s.date_filed) AS DATE) - 1) AS DATE)
        LEFT JOIN st ON st.permno = s.permno LEFT JOIN d ON d.code = coalesce(st.s, s.siccd, s.sich, s.sic)""",
)
def _(t: Tables) -> DataFrame:
    u = t("fundamentals")
    sample = t("filings").join(u.select("cik", (F.col("fyear") + 1).alias("filing_year"), "gvkey", "bm"), ["cik", "filing_year"])
    sample = sample.withColumn("yrmon", C.month_start(F.col("date_filed"))).join(t("monthly").select("permno", "yrmon", "exchcd", "siccd"), ["permno", "yrmon"], "left").drop("yrmon", "form_type")
    scores = t("filings").select("accession", F.round((F.col("accession") % 17) / 10.0, 6).alias("tfidf"))
    counts = t("filings").select("accession", F.round(100.0 * (F.col("accession") % 13) / 200, 6).alias("neg_pct"))
    ownership = t("inst_own").select("permno", C.quarter_end(F.col("yqtr")).alias("yqtr"), "inst_own")
    out = pipeline.panel(sample, t("daily"), counts, scores, ownership, t("ranges"), u, t("monthly"), pipeline.Options(sic_source="header_static"))
    digits = {"excret": 6, "alpha": 4, "log_size": 4, "log_bm": 6, "log_turnover": 3}
    return out.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c).cast("int").alias(c) if c == "industry" else F.col(c) for c in out.columns))


SIC_CODES = {"crsp": "coalesce(m.siccd, u.sich, u.sic)", "sich": "coalesce(u.sich, u.sic)", "sic": "u.sic", "header_static": "coalesce(st.s, m.siccd, u.sich, u.sic)"}


@query(
    "SCR8_industry_policies",
    f"""WITH d AS ({DENSE}), st AS (SELECT permno, max_by(siccd, yrmon) AS s FROM {{monthly}} WHERE siccd IS NOT NULL AND yrmon <= DATE '2008-12-31' GROUP BY permno),
        u AS (SELECT f.accession, f.permno, f.date_filed, x.sic, x.sich FROM {{filings}} f LEFT JOIN {{fundamentals}} x ON x.cik = f.cik AND x.fyear = f.filing_year - 1)
        SELECT u.accession, {", ".join(f"coalesce(d_{k}.industry, 49) AS by_{k}" for k in SIC_CODES)} FROM u LEFT JOIN {{monthly}} m ON m.permno = u.permno AND m.yrmon = CAST(date_trunc('month', u.date_filed) AS DATE)
        LEFT JOIN st ON st.permno = u.permno {" ".join(f"LEFT JOIN d d_{k} ON d_{k}.code = {c}" for k, c in SIC_CODES.items())}""",
)
def _(t: Tables) -> DataFrame:
    u = t("fundamentals").select("cik", (F.col("fyear") + 1).alias("filing_year"), "sic", "sich")
    out = t("filings").join(u, ["cik", "filing_year"], "left").withColumn("yrmon", C.month_start(F.col("date_filed")))
    out = out.join(t("monthly").select("permno", "yrmon", "siccd"), ["permno", "yrmon"], "left").join(pipeline.last_known(t("monthly")), "permno", "left")
    dense = links.dense_ranges(t("ranges"), "low", "high", "industry", "line")
    for k in SIC_CODES:
        out = links.range_lookup(out, pipeline.industry_code(k), dense, "industry", 49).withColumnRenamed("industry", f"by_{k}")
    return out.select("accession", *(f"by_{k}" for k in SIC_CODES))


# --- regressions -----------------------------------------------------------------------------------------------------


def panel_of(t: Tables, *wanted: str) -> DataFrame:
    """Filings with outcomes, main variables, controls and an industry, from the event variables that are wanted."""
    days = eventtime.trading_days(t("daily"))
    found = eventtime.variables(t("filings"), days, wanted=wanted)
    base = t("filings").select("accession", "permno", "date_filed", (F.col("cik") % 12).alias("industry"), F.round((F.col("accession") * 37 % 101) / 101.0, 6).alias("tone"), F.round((F.col("accession") * 53 % 97) / 97.0, 6).alias("tfidf"))
    logs = {"size_b": ("log_size", 1e-6), "turnover": ("log_turnover", 1e-9)}
    out = base.join(found, "accession").withColumn("nasdaq", (F.col("permno") % 4 == 3).cast("int"))
    return out.withColumns({name: C.log_floor(F.col(v), least) for v, (name, least) in logs.items() if v in wanted})


CELL = {"full": ("excret", "tone")}
RETURNS = " * ".join(f"max(1 + ret) FILTER (off = {o})" for o in range(4)), " * ".join(f"max(1 + vwretd) FILTER (off = {o})" for o in range(4))
PANEL = f"""{TIME}, a AS (SELECT accession, count(*) FILTER (off BETWEEN 0 AND 3) AS n4, {RETURNS[0]} AS grown, {RETURNS[1]} AS market, max(abs(prc)) FILTER (off = -1) * max(shrout) FILTER (off = -1) / 1000 AS size_b FROM span GROUP BY accession),
    p AS (SELECT f.date_filed, CAST(date_trunc('quarter', f.date_filed) AS DATE) AS quarter, f.cik % 12 AS industry, (a.grown - a.market) * 100 AS excret, CASE WHEN a.size_b IS NOT NULL THEN ln(greatest(a.size_b, 0.000001)) END AS log_size,
          round((f.accession * 37 % 101) / 101.0, 6) AS tone, round((f.accession * 53 % 97) / 97.0, 6) AS tfidf FROM {{filings}} f JOIN a ON a.accession = f.accession WHERE n4 = 4 AND f.permno IS NOT NULL)"""


@query("REG2_cross_sections", f"{PANEL} SELECT quarter, count(*) AS n, round(regr_slope(excret, tone), 5) AS beta, round(1 - (count(*) - 1) / (count(*) - 2) * (1 - regr_r2(excret, tone)), 6) AS r2 FROM p GROUP BY 1 HAVING count(*) >= 30")
def _(t: Tables) -> DataFrame:
    """REG2 and REG3: slopes and adjusted R-squared of each quarter."""
    one = [regress.Setting("J", winsor="none", industries=False)]
    fits = regress.quarterly_fits(panel_of(t, "excret"), CELL, [], one)
    return fits.select("quarter", "n", F.round("beta", 5).alias("beta"), F.round("r2", 6).alias("r2"))


#: Cells of the tables: outcome and main variable.
TABLE_CELLS = {"return_tone": ("excret", "tone"), "return_tfidf": ("excret", "tfidf"), "size_tone": ("log_size", "tone"), "size_tfidf": ("log_size", "tfidf")}
OWN = "panel, cell, setting, industries"


def _grid_sql(source: str, settings: list[regress.Setting], cells: dict[str, tuple[str, str]], controls: list[str] | None = None, panels: dict[str, tuple[str, dict[str, str]]] | None = None, both: bool = True) -> str:
    """Coefficients with industry effects and their averages, from rows ``p`` that ``source`` ends with.

    All columns less their (weighted) industry means; then Gauss-Jordan elimination of their products, one regressor
    after the other. ``panels``: name to (which rows, columns replaced).
    """
    controls = controls or []
    k = 2 + len(controls)
    z = range(k)
    columns = lambda c, how: [how.get(x, x) for x in (*cells[c], *controls)]
    melted = " UNION ALL ".join(
        f"SELECT '{p}' AS panel, '{c}' AS cell, quarter, date_filed, {how.get('industry', 'industry')} AS industry, {', '.join(f'{x}::DOUBLE AS z{i}' for i, x in enumerate(columns(c, how)))} FROM p WHERE ({where}) AND {' AND '.join(f'{x} IS NOT NULL' for x in columns(c, how))}"
        for p, (where, how) in (panels or {"default": ("true", {})}).items() for c in cells
    )
    kinds = list(dict.fromkeys(s.winsor for s in settings))
    flat = [i for i in z if i >= 2 and controls[i - 2] == "nasdaq"]
    cut = ", ".join(f"quantile_cont(z{i}, 0.01) AS l{i}, quantile_cont(z{i}, 0.99) AS h{i}" for i in z)
    clip = ", ".join(f"z{i}" if i in flat else f"least(greatest(z{i}, l{i}), h{i}) AS z{i}" for i in z)
    ways = {
        "full": f"SELECT panel, cell, quarter, date_filed, industry, 'full' AS winsor, {clip} FROM melted JOIN (SELECT panel, cell, {cut} FROM melted GROUP BY ALL) USING (panel, cell)",
        "quarter": f"SELECT panel, cell, quarter, date_filed, industry, 'quarter' AS winsor, {clip} FROM melted JOIN (SELECT panel, cell, quarter, {cut} FROM melted GROUP BY ALL) USING (panel, cell, quarter)",
        "none": f"SELECT panel, cell, quarter, date_filed, industry, 'none' AS winsor, {', '.join(f'z{i}' for i in z)} FROM melted",
    }
    arms = ", ".join(f"('{s.name}', {s.min_obs}, '{s.winsor}', {s.weight}, {s.ts_weight}, {s.thin}, {s.lags})" for s in settings)
    pairs = [(i, j) for i in z for j in z]
    steps, last = [], "q0"
    for p in range(1, k):  # column 0 is the outcome
        changed = [f"a{p}_{j} / nullif(a{p}_{p}, 0) AS a{i}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / nullif(a{p}_{p}, 0) AS a{i}_{j}" for i in range(1, k) for j in z]
        steps.append(f"q{p} AS (SELECT {OWN}, quarter, lags, n, v, {', '.join(changed)} FROM {last})")
        last = f"q{p}"
    names = {c: [x, *controls] for c, (_, x) in cells.items()}
    variable = lambda i: "CASE cell " + " ".join(f"WHEN '{c}' THEN '{n[i]}'" for c, n in names.items()) + " END"
    betas = " UNION ALL ".join(f"SELECT {OWN}, quarter, lags, n, v, {variable(i - 1)} AS variable, a{i}_0 AS beta FROM {last}" for i in range(1, k if controls else 2))
    lag = lambda i: f"CASE WHEN lags >= {i} THEN 2 * (1 - {i} / (lags + 1)) * u * coalesce(lag(u, {i}) OVER w, 0) ELSE 0 END"
    key = f"{OWN}, variable"
    return f"""{source}, arms(setting, least, winsor, weight, ts_weight, thin, lags) AS (VALUES {arms}), melted AS ({melted}), clipped AS ({" UNION ALL ".join(ways[x] for x in kinds)}),
        big AS (SELECT *, count(*) OVER (PARTITION BY panel, cell, setting, quarter) AS n0, count(*) OVER (PARTITION BY panel, cell, setting, quarter, industry) AS ni FROM clipped JOIN arms USING (winsor)),
        thick AS (SELECT *, count(*) OVER (PARTITION BY panel, cell, setting, quarter) AS n1 FROM big WHERE n0 >= least AND ni >= thin),
        weighed AS (SELECT *, CASE WHEN weight THEN 1.0 / count(*) OVER (PARTITION BY panel, cell, setting, quarter, date_filed) ELSE 1.0 END AS g FROM thick WHERE n1 >= least),
        fixed AS (SELECT *, unnest([{"true, false" if both else "true"}]) AS industries FROM weighed),
        means AS (SELECT {OWN}, quarter, lags, ts_weight, g, {", ".join(f"z{i} - sum(g * z{i}) OVER e / sum(g) OVER e AS r{i}" for i in z)} FROM fixed WINDOW e AS (PARTITION BY {OWN}, quarter, CASE WHEN industries THEN industry ELSE -1 END)),
        q0 AS (SELECT {OWN}, quarter, any_value(lags) AS lags, count(*) AS n, CASE WHEN any_value(ts_weight) THEN count(*) ELSE 1.0 END AS v, {", ".join(f"sum(g * r{i} * r{j}) AS a{i}_{j}" for i, j in pairs)} FROM means GROUP BY {OWN}, quarter),
        {", ".join(steps)}, betas AS ({betas}),
        m AS (SELECT *, sum(v * beta) OVER k / sum(v) OVER k AS coef FROM betas WINDOW k AS (PARTITION BY {key})), away AS (SELECT *, v * (beta - coef) AS u FROM m),
        z AS (SELECT *, u * u + {" + ".join(lag(i) for i in range(1, max(s.lags for s in settings) + 1))} AS term FROM away WINDOW w AS (PARTITION BY {key} ORDER BY quarter))
        SELECT {key if controls else OWN}, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_quarters, round(any_value(coef), 4) AS coef, round(sqrt(greatest(sum(term), 0)) / sum(v), 4) AS se FROM z GROUP BY {key}"""


def _digest(df: DataFrame, *more: str) -> DataFrame:
    """The digits of averages by the queries' rule: a quarter that can't be solved has no coefficient, but its weight counts."""
    return df.select("panel", "cell", "setting", "industries", *more, "n", "n_quarters", F.round("coef", 4).alias("coef"), F.round(F.coalesce("se", F.lit(0.0)), 4).alias("se"))


PLAIN = regress.Setting("A", winsor="none")


@query("REG9_tables", _grid_sql(PANEL, [PLAIN], TABLE_CELLS))
def _(t: Tables) -> DataFrame:
    """REG6, REG8 and REG9: four cells, with and without industry effects."""
    return _digest(regress.fama_macbeth(panel_of(t, "excret", "size_b"), TABLE_CELLS, [], [PLAIN], both=True, least_norm=False))


#: The event variables as they are, for regressions, and the rows of ``panel_of`` with all of them.
UNROUNDED = EXACT.replace("round(CASE WHEN n4 = 4 THEN (grown - market) * 100 END, 6)", "CASE WHEN n4 = 4 THEN (grown - market) * 100 END").replace("END, 4) AS alpha", "END AS alpha").replace("round(CASE WHEN n4 = 4 AND ev.before >= 60 AND nc >= 60", "CASE WHEN n4 = 4 AND ev.before >= 60 AND nc >= 60")
LOGS = "CASE WHEN {v}.size_b IS NOT NULL THEN ln(greatest({v}.size_b, 0.000001)) END AS log_size, CASE WHEN {v}.turnover IS NOT NULL THEN ln(greatest({v}.turnover, 0.000000001)) END AS log_turnover"
WHOLE_PANEL = f"""{TIME}, mo AS ({MOMENTS}), v AS ({UNROUNDED}),
    p AS (SELECT f.date_filed, CAST(date_trunc('quarter', f.date_filed) AS DATE) AS quarter, f.cik % 12 AS industry, v.excret, v.alpha, {LOGS.replace("{v}", "v")}, CAST(f.permno % 4 = 3 AS INT) AS nasdaq,
          round((f.accession * 37 % 101) / 101.0, 6) AS tone, round((f.accession * 53 % 97) / 97.0, 6) AS tfidf FROM {{filings}} f JOIN v ON v.accession = f.accession WHERE f.permno IS NOT NULL)"""
REG7_CONTROLS = ["log_size", "log_turnover", "nasdaq"]


@query("REG7_fama_macbeth", _grid_sql(WHOLE_PANEL, [regress.Setting("A")], CELL, REG7_CONTROLS))
def _(t: Tables) -> DataFrame:
    """All coefficients, with controls and winsorizing over the whole panel."""
    return _digest(regress.fama_macbeth(panel_of(t, "excret", "size_b", "turnover"), CELL, REG7_CONTROLS, [regress.Setting("A")], both=True, least_norm=False), "variable")


GRID_CELLS = {f"{y}_{x}": (y, x) for y in ("excret", "alpha") for x in ("tone", "tfidf")}


@query("REG10_variant_grid", _grid_sql(WHOLE_PANEL, list(regress.GRID), GRID_CELLS, ["log_size", "nasdaq"]))
def _(t: Tables) -> DataFrame:
    """All twelve settings of the grid: winsorizing, weights, least rows, lags, thin industries."""
    return _digest(regress.fama_macbeth(panel_of(t, "excret", "size_b", "alpha"), GRID_CELLS, ["log_size", "nasdaq"], both=True, least_norm=False), "variable")


@query("REG5_p_values", "SELECT o_orderkey, round(1 - 2 / sqrt(2 * pi()) * x / 600 * list_sum(list_transform(range(0, 201), lambda i: CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(x * i / 200, 2) / 2))), 6) AS p FROM (SELECT o_orderkey, o_orderkey % 601 / 100.0 AS x FROM orders)")
def _(t: Tables) -> DataFrame:
    """Two-sided p values of statistics from 0 to 6, in SQL by Simpson's rule."""
    return t("orders").select("o_orderkey", F.round(regress.p_value((F.col("o_orderkey") % 601 / 100.0).cast("double")), 6).alias("p"))


# --- panels of the grid ----------------------------------------------------------------------------------------------

#: The stand-ins' prices and words are other than filings'.
PANEL_OPTIONS = {n: dataclasses.replace(o, least_words=500, least_price=900.0) for n, o in pipeline.VARIANTS.items()}
PANEL_CELLS = {"tone": ("excret", "tone"), "tfidf": ("excret", "tfidf"), "section_tone": ("excret", "section_tone"), "section_tfidf": ("excret", "section_tfidf")}
PANEL_CONTROLS = ["log_size", "log_bm", "log_turnover", "alpha", "inst_own", "nasdaq"]
POSITIVE = {"tone": "tone_positive", "tfidf": "tfidf_positive"}


def _panels_source() -> str:
    """Rows ``p`` of all panels, with a column for each option that panels differ in."""
    linked = LINKED.replace("coalesce(a1.gvkey, c1.gvkey) AS gvkey", "coalesce(a1.gvkey, c1.gvkey) AS gvkey, a1.gvkey IS NOT NULL AS direct")
    months = MONTHLY.replace("END AS prc", "END AS prc, CASE WHEN m.yrmon = l.yrmon OR m.shrcd IS NOT NULL THEN m.siccd END AS siccd")
    codes = {"crsp": "m.siccd, u.sich, u.sic", "sich": "u.sich, u.sic", "sic": "u.sic", "header_static": "st.s, m.siccd, u.sich, u.sic"}
    return f"""WITH a AS (SELECT * FROM {{filings}} WHERE form_type IN ('10-K', '10-K405')), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, filing_year ORDER BY date_filed, accession) AS kk FROM a) WHERE kk = 1),
        c AS (SELECT * FROM (SELECT *, date_filed - lag(date_filed) OVER (PARTITION BY cik ORDER BY date_filed, accession) AS gap FROM b) WHERE gap IS NULL OR gap >= 180),
        {linked}, {months}, days AS ({DAYS}), ev AS ({EVENTS.replace("{filings}", "linked")}), span AS ({SPAN}), ck AS ({CHECKS}), checked AS ({CHECKED}), mo AS ({MOMENTS}), v AS ({UNROUNDED}), dn AS ({DENSE}),
        st AS (SELECT permno, max_by(siccd, yrmon) AS s FROM {{monthly}} WHERE siccd IS NOT NULL AND yrmon <= DATE '2008-12-31' GROUP BY permno),
        yr AS (SELECT gvkey, fyear + 1 AS filing_year, min(bm) AS bm FROM {{fundamentals}} WHERE be > 0 AND bm IS NOT NULL AND mkt_value IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT l.date_filed, CAST(date_trunc('quarter', l.date_filed) AS DATE) AS quarter, l.direct, m.shrcd, v.excret, v.alpha, o.inst_own, sc.* EXCLUDE (accession), {LOGS.replace("{v}", "v")}, ln(greatest(yr.bm, 0.000001)) AS log_bm,
                     CAST(coalesce(m.exchcd, -1) = 3 AS INT) AS nasdaq, {", ".join(f"coalesce(d_{k}.industry, 49) AS industry_{k}" for k in codes)}
              FROM linked l JOIN months m ON m.accession = l.accession JOIN checked k ON k.accession = l.accession JOIN v ON v.accession = l.accession JOIN yr ON yr.gvkey = l.gvkey AND yr.filing_year = l.filing_year
              JOIN {{scores}} sc ON sc.accession = l.accession LEFT JOIN {{inst_own}} o ON o.permno = l.permno AND o.yqtr = CAST(date_trunc('quarter', CAST(date_trunc('quarter', l.date_filed) AS DATE) - 1) AS DATE)
              LEFT JOIN {{fundamentals}} u ON u.gvkey = l.gvkey AND u.fyear = l.filing_year - 1 LEFT JOIN st ON st.permno = l.permno
              {" ".join(f"LEFT JOIN dn d_{k} ON d_{k}.code = coalesce({c})" for k, c in codes.items())}
              WHERE l.permno IS NOT NULL AND m.prc IS NOT NULL AND price_before >= 900 AND ev_ok AND m.exchcd IN (1, 2, 3) AND pre_post_ok AND l.accession % 3 <> 0 AND l.accession % 2000 >= 500)"""


def _panels_where() -> dict[str, tuple[str, dict[str, str]]]:
    of = lambda o: f"shrcd IN ({', '.join(map(str, o.share_codes))})" + ("" if o.use_history else " AND direct")
    return {n: (of(o), {"industry": f"industry_{o.sic_source}", **(POSITIVE if o.positive_only else {})}) for n, o in PANEL_OPTIONS.items()}


def grid_panels(t: Tables) -> tuple[DataFrame, dict[str, regress.Variant]]:
    """The eight panels of the grid, from one funnel under options that allow all of them."""
    o = dataclasses.replace(PANEL_OPTIONS["default"], use_history=True)
    kept = pipeline.survivors(t("filings").select("accession", "cik", "date_filed", "form_type"), o)[2]
    words = t("orders").select(F.col("o_orderkey").alias("accession"), (F.col("o_orderkey") % 3 != 0).alias("ok"), (F.col("o_orderkey") % 2000).alias("n_words"))
    last = t("filings").agg(F.max("date_filed")).first()[0]
    linked = selection.saved(links.linked(kept, t("fundamentals"), links.ended(t("history"), "linkenddt", last)))
    monthly, daily, own = pipeline.of_securities(linked, t("monthly"), t("daily"), t("inst_own"))
    monthly = selection.saved(monthly)
    sample = pipeline.attributes_and_variables(linked, t("fundamentals"), monthly, daily, words, o)
    ownership = own.select("permno", C.quarter_end(F.col("yqtr")).alias("yqtr"), "inst_own")
    return pipeline.grid_panels(sample, t("scores"), POSITIVE, ownership, t("ranges"), t("fundamentals"), monthly, PANEL_OPTIONS)


@query("REG10_variant_panels", _grid_sql(_panels_source(), list(regress.GRID), PANEL_CELLS, PANEL_CONTROLS, _panels_where()))
def _(t: Tables) -> DataFrame:
    """The whole grid: eight panels, four cells, twelve settings, with and without industries, six controls."""
    rows_of, panels = grid_panels(t)
    return _digest(regress.fama_macbeth(rows_of, PANEL_CELLS, PANEL_CONTROLS, both=True, panels=panels, least_norm=False), "variable")


# --- sections --------------------------------------------------------------------------------------------------------

#: By language: what stands before and after a text, and the form, so that every tier is met.
FRAMES = {
    "en": ("ITEM 7. MANAGEMENT'S DISCUSSION ", " ITEM 8. FINANCIAL STATEMENTS", "10-K", "t1_10k_item7", 4),
    "fr": ("ITEM 6. MANAGEMENT'S DISCUSSION ", " ITEM 7. FINANCIAL STATEMENTS", "10-KSB", "t1_ksb_item6", 4),
    "de": ("II. MANAGEMENT'S DISCUSSION ", " CONSOLIDATED BALANCE SHEETS", "10-KSB", "t2_roman", 3),
    "es": ("MANAGEMENT'S DISCUSSION ", " REPORT OF INDEPENDENT", "10-K", "t3_bare", 2),
}


def _case(of: int) -> str:
    q = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN {q(v[of])}" for k, v in FRAMES.items()) + " END"


UPPER = "upper(replace(text, 'ß', 'ss'))"
FRAMED = f"SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) + {_case(4)} BETWEEN 250 AND 100000 AS ok, {_case(0)} || {UPPER} AS section, 'ok_' || {_case(3)} AS status FROM documents"


def sections(t: Tables) -> DataFrame:
    """``(doc_id, text, status)``: the section found in each document, framed as a filing's."""
    def of(i: int) -> Column:
        return F.create_map(*(F.lit(x) for k, v in FRAMES.items() for x in (k, v[i])))[F.col("lang")]

    framed = F.concat(of(0), F.upper("text"), of(1))
    found = extract_section(framed, of(2)).alias("x")
    return narrow_batches(t("documents")).select("doc_id", found).select("doc_id", "x.text", "x.status")


@query("TXT2_section", f"SELECT doc_id, CASE WHEN ok THEN status ELSE 'no_match' END AS status, CASE WHEN ok THEN md5(regexp_replace(section, '\\s+$', '')) END AS digest FROM ({FRAMED})")
def _(t: Tables) -> DataFrame:
    """TXT2, TXT2a and TXT2b: all four headings and several ends, with the text that is found."""
    return sections(t).select("doc_id", "status", F.md5("text").alias("digest"))


SECTION_EACH = f"SELECT doc_id, unnest({TOKENS}) AS word FROM (SELECT doc_id, section AS text FROM ({FRAMED}) WHERE ok)"
SECTION_HEAD = f"WITH e AS ({SECTION_EACH}), w AS ({WORDS}), terms AS ({TERMS}), counts AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS n_words, coalesce(sum(tf) FILTER (neg), 0) AS n_neg FROM documents d LEFT JOIN terms t ON t.doc_id = d.doc_id GROUP BY d.doc_id)"


@query("SCR2_section_tone", f"{SECTION_HEAD} SELECT doc_id, round(CASE WHEN n_words > 0 THEN 100.0 * n_neg / n_words END, 6) AS neg_pct FROM counts")
def _(t: Tables) -> DataFrame:
    return rounded(tone.proportional(tone.word_counts(sections(t), word_list(t))).select("doc_id", "neg_pct"))


IDF = "idf AS (SELECT word, ln((SELECT count(*) FROM counts)::DOUBLE / count(*)) AS idf FROM neg GROUP BY word)"
SUMS = "SELECT n.doc_id, sum((1 + ln(n.tf)) * i.idf) AS w FROM neg n JOIN idf i ON i.word = n.word GROUP BY n.doc_id"


@query("SCR4_section_tfidf", f"{SECTION_HEAD}, neg AS (SELECT * FROM terms WHERE neg), {IDF} SELECT c.doc_id, round(coalesce(s.w, 0) / (1 + ln(greatest(c.n_words, 1))), 6) AS tfidf FROM counts c JOIN ({FRAMED}) f ON f.doc_id = c.doc_id AND f.ok LEFT JOIN ({SUMS}) s ON s.doc_id = c.doc_id")
def _(t: Tables) -> DataFrame:
    """Scores of the sections that were found; the number of documents is that of all."""
    found, words = sections(t), word_list(t)
    scores = tone.tfidf(tone.term_counts(found, words).where("neg"), tone.word_counts(found, words))
    return rounded(scores.join(found.where(F.col("status").startswith("ok")).select("doc_id"), "doc_id", "left_semi"))


@query("AGG18_weighted_sums", f"{HEAD}, neg AS (SELECT * FROM terms WHERE neg), {IDF} SELECT d.doc_id, round(coalesce(s.w, 0), 6) AS w FROM documents d LEFT JOIN ({SUMS}) s ON s.doc_id = d.doc_id")
def _(t: Tables) -> DataFrame:
    d, words = t("documents"), word_list(t)
    return rounded(tone.weighted_sums(tone.term_counts(d, words).where("neg"), d.select("doc_id")))


@query("TXT11_sizes", f"SELECT doc_id, length(text) AS raw, length(trim({UPPER}, ' ' || chr(10))) AS clean, CASE WHEN ok THEN length(regexp_replace(section, '\\s+$', '')) ELSE 0 END AS section FROM ({FRAMED})")
def _(t: Tables) -> DataFrame:
    """Sizes of the raw and clean texts and of the sections, for checking a sample by eye."""
    sizes = t("documents").select("doc_id", F.char_length("text").cast("long").alias("raw"), F.char_length(F.trim(F.upper("text"), F.lit(" \n"))).cast("long").alias("clean"))
    return sizes.join(sections(t).select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("section")), "doc_id")


@query("TXT1b_markup", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')) || '  TAIL', '-\s*\n\s*', '-', 'g'), '[ \t\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents""")
def _(t: Tables) -> DataFrame:
    """TXT1b to TXT1d: embedded files, encoded lines and hidden facts."""
    raw = F.concat(F.lit("<DOCUMENT>\n<TYPE>10-K405\n<TEXT>"), F.col("text"), F.lit(" <PDF>x\n<b>y</PDF> <XBRL>1</xbrl> begin 644 f.gif\nM86\nM87\nend\n <ix:hidden id='1'>7</ix:hidden> tail</TEXT>"))
    return narrow_batches(t("documents")).select("doc_id", F.md5(clean_text(raw)).alias("digest"))


# --- stored tables and files -----------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder that executors share: in the checkpoint folder the cluster names, else (in tests) a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stored-")
    return f"{folder}/stored-{uuid.uuid4().hex}"


@query("SNK1_parquet", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    sinks.parquet(t("orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("y")), path, by=["y"])
    return readers.parquet(t.spark, path)


@query("SRC6_column_subset", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    return readers.parquet(t.spark, f"{t.folder}/customer.parquet", ["c_custkey", "c_mktsegment"])


@query("SNK3_SRC7_csv", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    sinks.csv(t("part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return readers.csv(t.spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double", ["p_partkey", "p_name", "p_size"]).where("p_size > 10")


@query("SRC3_first_table", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables) -> DataFrame:
    t("region").createOrReplaceTempView("tonequarry_region")
    return readers.first_table(t.spark, ["tonequarry_absent", "tonequarry_region"]).select("r_regionkey", "r_name")


@query("SNK4_SRC10_term_frequency", f"WITH e AS ({EACH}), w AS ({WORDS}), terms AS ({TERMS}) SELECT doc_id, word, tf FROM terms WHERE pos")
def _(t: Tables) -> DataFrame:
    """The long relation stored by scope; reading one scope prunes the others' folders."""
    path, terms = scratch(t.spark), tone.term_counts(t("documents"), word_list(t))
    both = terms.where("neg").withColumn("scope", F.lit("neg")).unionByName(terms.where("pos").withColumn("scope", F.lit("pos")))
    sinks.parquet(both, path, by=["scope"])
    return readers.parquet(t.spark, path).where("scope = 'pos'").select("doc_id", "word", "tf")


@query("SRC9_TXT8_TXT10_filings", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN NULL ELSE upper(n_name) || ' & ' || n_regionkey END AS clean, CASE WHEN n_nationkey = 3 THEN NULL ELSE 43 + length(n_name) + length(CAST(n_regionkey AS VARCHAR)) END AS length, n_nationkey <> 3 AS ok FROM nation")
def _(t: Tables) -> DataFrame:
    """One compressed file per filing, cleaned with its size; a file that is none is a row with an error."""
    path = scratch(t.spark)
    raw = F.concat(F.lit("<DOCUMENT>\n<TYPE>10-K\n<TEXT>"), "n_name", F.lit(" &amp; "), F.col("n_regionkey").cast("string"), F.lit("</TEXT>"))
    nation = t("nation").select("n_nationkey", raw.alias("value"))
    nation.where("n_nationkey <> 3").write.partitionBy("n_nationkey").option("compression", "gzip").text(path)
    broken = t.spark.createDataFrame([("not compressed",)], "value string")
    broken.write.text(f"{path}/plain")
    files = readers.filings(t.spark, path)
    good = files.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "clean", "length", "ok")
    bad = t.spark.read.format("binaryFile").load(f"{path}/plain/*.txt").select(F.lit(3).alias("n_nationkey"), readers.opened("content").alias("x"))
    return good.unionByName(bad.select("n_nationkey", F.lit(None).cast("string").alias("clean"), "x.length", "x.ok"))


@query("SNK5_texts", "SELECT n_nationkey, n_name AS text FROM nation")
def _(t: Tables) -> DataFrame:
    """A text file per row of a small sample, read back by name."""
    path = scratch(t.spark)
    sinks.texts(t("nation").select("n_nationkey", "n_name"), path, "n_nationkey", "n_name")
    back = t.spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select("value", F.input_file_name().alias("f"))
    return back.select(F.regexp_extract("f", r"(\d+)\.txt$", 1).cast("int").alias("n_nationkey"), F.col("value").alias("text"))


@query("SNK7_stored_digest", "SELECT doc_id, sha256(text) AS sha, strlen(text) AS length FROM documents")
def _(t: Tables) -> DataFrame:
    """Files put in place by one commit, not rewritten by a second one, and the digests of what is stored."""
    path = scratch(t.spark)
    docs = t("documents").select("doc_id", "text")
    sinks.texts(docs, path, "doc_id")
    sinks.texts(docs.withColumn("text", F.lit("rewritten")), path, "doc_id", again=False)
    back = t.spark.read.format("binaryFile").load(path)
    return back.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), sinks.digest().alias("sha"), "length")


@query(
    "SNK6_versioned_upserts",
    """WITH b AS (SELECT user_id AS accession, event_id AS cik, event_type AS status, round(value, 2) AS size, (day(ts) - 1) // 11 AS batch, event_id FROM events),
        last AS (SELECT accession, status, size, batch FROM b QUALIFY row_number() OVER (PARTITION BY accession ORDER BY batch DESC, event_id DESC) = 1),
        first AS (SELECT accession, cik FROM b QUALIFY row_number() OVER (PARTITION BY accession ORDER BY batch, event_id DESC) = 1)
        SELECT last.accession, cik, status, size, 3 AS version, 0 AS damaged FROM last JOIN first ON first.accession = last.accession""",
)
def _(t: Tables) -> DataFrame:
    """Three batches of changes put into a versioned table; the first row of a key keeps its cik."""
    days = t("events").select(F.col("user_id").alias("accession"), F.col("event_id").alias("cik"), F.col("event_type").alias("status"), F.round("value", 2).alias("size"), F.floor((F.dayofmonth("ts") - 1) / 11).alias("batch"))
    table = VersionedTable(t.spark, scratch(t.spark), "accession long, cik long, status string, size double", "accession", ["cik"], 8)
    for i in range(3):
        version = table.upsert(days.where(F.col("batch") == i), [F.desc("cik")])
    damaged = table.damaged().agg(F.count("*").cast("int").alias("damaged"))
    return table.read().withColumn("version", F.lit(version)).crossJoin(F.broadcast(damaged))  # one row


@query("SNK8_markdown", "SELECT place, line FROM (SELECT 1 AS place, '| o_orderpriority | n | total |' AS line UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT 2 + row_number() OVER (ORDER BY o_orderpriority), '| ' || o_orderpriority || ' | ' || count(*) || ' | ' || printf('%.1f', round(avg(o_totalprice), 1)) || ' |' FROM orders GROUP BY o_orderpriority)")
def _(t: Tables) -> DataFrame:
    few = t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 1).alias("total"))
    return sinks.markdown(few, ["o_orderpriority"], digits=1)


@query("ORD2_by_ratio", "SELECT event_type, row_number() OVER (ORDER BY r DESC, event_type) AS k FROM (SELECT event_type, round(avg(value) / stddev_samp(value), 6) AS r FROM events GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    """A report of a few rows in order of a ratio, with their places: one sorted task over the grouped rows."""
    few = rounded(t("events").groupBy("event_type").agg((F.avg("value") / F.stddev_samp("value")).alias("r")))
    return few.select("event_type", F.row_number().over(Window.orderBy(F.desc("r"), "event_type")).cast("long").alias("k"))


@query(
    "SRC11_range_lines",
    """SELECT 1000 + n_nationkey * 10 AS low, 1000 + n_nationkey * 10 + 9 AS high, CAST(n_regionkey + 1 AS INT) AS industry, 'R' || n_regionkey AS name,
       CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) + n_regionkey AS INT) AS line FROM nation""",
)
def _(t: Tables) -> DataFrame:
    """A range file made of the nations under their regions, stored as text and read back."""
    path = scratch(t.spark)
    ranges = t("nation").select("n_regionkey", F.format_string("          %d-%d %s", 1000 + F.col("n_nationkey") * 10, 1009 + F.col("n_nationkey") * 10, "n_name").alias("value"), F.col("n_nationkey").alias("k"))
    heads = t("region").select(F.col("r_regionkey").alias("n_regionkey"), F.format_string(" %d R%d  %s", F.col("r_regionkey") + 1, "r_regionkey", "r_name").alias("value"), F.lit(-1).alias("k"))
    ranges.unionByName(heads).coalesce(1).sortWithinPartitions("n_regionkey", "k").select("value").write.text(path)
    return readers.industry_ranges(t.spark, path).select("low", "high", "industry", "name", "line")


@query("SRC1_remote_pull", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS total FROM orders WHERE o_custkey < 700 AND o_orderstatus <> 'P'")
def _(t: Tables) -> DataFrame:
    """The orders in databases that executors share, one for each run of rows; the filter goes there."""
    path = scratch(t.spark)
    orders = t("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    readers.databases(orders, "o_orderkey", path, "orders")
    found = readers.pulled(t.spark, path, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey < 700 AND o_orderstatus <> 'P'", "o_orderkey long, o_custkey long, o_totalprice double")
    return found.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("total"))
