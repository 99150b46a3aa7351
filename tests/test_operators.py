"""Hand-built cases: ties, nulls, window edges, rank-deficient designs."""

import dataclasses
import datetime
import gzip
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonequarry.functions import columns as C
from tonequarry.functions import text as T
from tonequarry.operators import eventtime, links, regress, rows, stats, tone
from tonequarry.plans import pipeline
from tonequarry.sources import readers, sinks

D = datetime.date


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 0), (float("nan"), 1), (float("inf"), 2), (None, 3)], "x double, k int")
    assert [r.x for r in C.finite(df).orderBy("k").collect()] == [1.0, None, None, None]
    got = df.select(C.at_least(F.lit(None).cast("double"), 1e-6).alias("a"), C.ratio(F.lit(1), F.lit(0)).alias("b")).first()
    assert got.a is None and got.b is None


def test_first_by_total_order(spark):
    df = spark.createDataFrame([("a", 2, D(2000, 1, 1)), ("a", 1, D(2000, 1, 1))], "accession string, cik int, d date")
    assert rows.first_by(df, ["accession"], ["d", "cik"]).first().cik == 1


def test_nearest_year_prefers_later(spark):
    f = spark.createDataFrame([(1, 7, 2001), (2, 8, 2001)], "accession int, cik int, filing_year int")
    u = spark.createDataFrame([(7, 1999), (7, 2001)], "cik int, fyear int")
    got = {r.accession: r.fyear for r in links.nearest_year(f, u, "cik", "accession", "filing_year", "fyear").collect()}
    assert got == {1: 2001, 2: None}


def test_as_of_null_blocks_and_tolerance(spark):
    left = spark.createDataFrame([(1, 5, D(2001, 6, 1)), (2, 6, D(2001, 6, 1)), (3, 7, D(2001, 6, 1)), (4, 8, D(2001, 6, 1))], "accession int, permno int, yrmon date")
    right = spark.createDataFrame(
        [(5, D(2001, 6, 1), None, 9.0), (5, D(2001, 5, 1), 10, 8.0), (6, D(2001, 5, 1), None, 7.0), (6, D(2001, 4, 1), 11, 6.0), (7, D(2001, 6, 1) - datetime.timedelta(400), 12, 5.0), (8, D(2001, 6, 1) - datetime.timedelta(401), 13, 4.0)],
        "permno int, yrmon date, shrcd int, prc double",
    )
    got = {r.accession: (r.shrcd, r.prc) for r in links.as_of(left, right, "permno", "accession", "yrmon", ["shrcd", "prc"], 400, "shrcd").collect()}
    assert got == {1: (None, 9.0), 2: (None, None), 3: (12, 5.0), 4: (None, None)}


def history_rows():
    """Overlapping, nested, touching, open and empty intervals of a few keys, one of them with many."""
    r = random.Random(4)
    out = [(1, 10, D(2000, 1, 1), D(2003, 12, 31)), (1, 11, D(2001, 1, 1), D(2001, 6, 30)), (1, 12, D(2002, 1, 1), None), (2, 20, D(1999, 1, 1), D(1999, 1, 1)), (2, 21, D(1999, 1, 2), D(1999, 1, 2)), (3, 30, D(2005, 1, 1), D(2004, 1, 1)), (None, 40, D(2000, 1, 1), None), (4, 41, None, None), (5, 51, D(2000, 5, 5), None), (5, 50, D(2000, 5, 5), None)]
    for i in range(60):
        a = D(1995, 1, 1) + datetime.timedelta(r.randrange(4000))
        out.append((6, 100 + i, a, None if i % 9 == 0 else a + datetime.timedelta(r.choice([0, 1, 30, 400, 2000]))))
    return out


def test_intervals_against_force(spark):
    history = spark.createDataFrame(history_rows(), "cik int, gvkey int, linkdt date, linkenddt date")
    r = random.Random(5)
    asked = [(i, r.choice([1, 2, 5, 6, 6, 6, 7, None]), None if i % 50 == 0 else D(1994, 6, 1) + datetime.timedelta(r.randrange(6000))) for i in range(400)]
    asked += [(400 + k, c, d) for k, (c, d) in enumerate((c, d + datetime.timedelta(o)) for c, _, a, b in history_rows() for d in (a, b) if d for o in (-1, 0, 1))]
    left = spark.createDataFrame(asked, "accession int, cik int, date_filed date")
    want = {}
    for i, cik, day in asked:
        held = [(a, -g, g) for c, g, a, b in history_rows() if c == cik and cik is not None and day and a and a <= day and (b is None or day <= b)]
        if held:
            want[i] = max(held)[2]
    got = {x.accession: x.gvkey for x in links.latest_valid(left, history, "cik", "accession", "date_filed", "linkdt", "linkenddt", ["gvkey"]).collect()}
    assert got == want and len(want) > 200
    assert links.latest_valid(left, history.where("false"), "cik", "accession", "date_filed", "linkdt", "linkenddt").collect() == []


def test_as_of_against_force(spark):
    r = random.Random(6)
    right = [(k, D(1998, 1, 1) + datetime.timedelta(d), None if d % 5 == 0 else d, float(d)) for k in (1, 2, 9) for d in r.sample(range(3000), 40 if k < 9 else 900)]
    left = [(i, r.choice([1, 2, 3, 9, None]), None if i == 7 else D(1997, 6, 1) + datetime.timedelta(r.randrange(4500))) for i in range(500)]
    args = spark.createDataFrame(left, "accession int, permno int, yrmon date"), spark.createDataFrame(right, "permno int, yrmon date, shrcd int, prc double")
    for days in (0, 1, 30, 400):
        got = {x.accession: (x.shrcd, x.prc) for x in links.as_of(*args, "permno", "accession", "yrmon", ["shrcd", "prc"], days, "shrcd").collect()}
        assert len(got) == len(left)
        for i, k, day in left:
            before = [x for x in right if x[0] == k and day and x[1] <= day and (day - x[1]).days <= days]
            last = max(before, key=lambda x: x[1], default=None)
            stands = last and (last[2] is not None or last[1] == day)
            assert got[i] == ((last[2], last[3]) if stands else (None, None)), (i, days)
    plan = links.as_of(*args, "permno", "accession", "yrmon", ["shrcd", "prc"], 400, "shrcd")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_ranges_later_wins_and_default(spark):
    r = spark.createDataFrame([(100, 199, 1, 0), (150, 150, 2, 1)], "low int, high int, industry int, line int")
    df = spark.createDataFrame([(100,), (150,), (None,), (0,), (99999,)], "sic int")
    got = links.range_lookup(df, F.col("sic"), links.dense_ranges(r, "low", "high", "industry", "line"), "industry", 49)
    assert {x.sic: x.industry for x in got.collect()} == {100: 1, 150: 2, None: 49, 0: 49, 99999: 49}


def bars(n, start=D(1999, 1, 1), null_vol=(), null_market=()):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        r, m, s, h = rng.normal(0, 0.01, 4)
        out.append((1, start + datetime.timedelta(i), 10.0 + i, float(r), None if i in null_vol else 100.0 + i, 2.0, 3 if i % 2 else 1, None if i in null_market else float(m), float(m), float(s), float(h), 0.0001))
    return out


BARS = "permno long, date date, prc double, ret double, vol double, shrout double, exchcd int, vwretd double, mktrf double, smb double, hml double, rf double"


@pytest.mark.parametrize("before", [59, 60, 64, 65, 252, 253, 256, 257, 300])
def test_windows_against_loops(spark, before):
    data = bars(before + 300)
    daily = spark.createDataFrame(data, BARS)
    f = spark.createDataFrame([(1, 1, data[before][1])], "accession long, permno long, date_filed date")
    days = eventtime.trading_days(daily)
    events = eventtime.event_days(f, days)
    v, c = eventtime.variables(events, days).first(), eventtime.checks(events, days).first()
    p = pd.DataFrame(data, columns=[x.split()[0] for x in BARS.split(", ")])
    ev, pre = p.iloc[before : before + 4], p.iloc[:before]
    assert c.ev_ok and c.price_before == pre.prc.iloc[-1]
    assert c.pre_post_ok == (before >= 65)
    assert v.excret == pytest.approx((np.prod(1 + ev.ret) - np.prod(1 + ev.vwretd)) * 100)
    span = pre.iloc[-252:-5] if before >= 257 else pre.iloc[:-5]
    if len(span) >= 60 and before >= 60:
        vol = np.where((span.exchcd == 3) & (pd.to_datetime(span.date) <= "2001-12-31"), span.vol / 2, span.vol).sum()
        assert v.turnover == pytest.approx(vol / (2.0 * 1e6))
        year = pre.iloc[-257:-5] if before >= 257 else pre.iloc[:-5]
        x = np.column_stack([np.ones(len(year)), year.mktrf, year.smb, year.hml])
        beta = np.linalg.lstsq(x, year.ret - year.rf, rcond=None)[0]
        assert v.alpha == pytest.approx(beta[0] * 252)
    else:
        assert v.turnover is None and v.alpha is None


def test_bars_are_moved_once(spark):
    """One exchange and no join, whether or not a side is small enough to broadcast."""
    data = bars(80)
    days = eventtime.trading_days(spark.createDataFrame(data, BARS))
    f = spark.createDataFrame([(1, 1, data[70][1])], "accession long, permno long, date_filed date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            for df in (eventtime.checks(f, days), eventtime.variables(f, days)):
                plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
                assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nulls_propagate(spark):
    data = bars(400, null_vol={200}, null_market={301})
    f = spark.createDataFrame([(1, 1, data[300][1]), (2, 1, D(2030, 1, 1)), (3, 9, D(2000, 1, 1))], "accession long, permno long, date_filed date")
    days = eventtime.trading_days(spark.createDataFrame(data, BARS))
    got = {r.accession: r for r in eventtime.variables(eventtime.event_days(f, days), days).collect()}
    assert got[1].excret is None and got[1].turnover is None and got[1].alpha is not None
    assert got[2].excret is None and got[2].size_b is None and got[3].excret is None
    checks = {r.accession: r for r in eventtime.checks(eventtime.event_days(f, days), days).collect()}
    assert not checks[2].ev_ok and checks[2].price_before == data[-1][2] and checks[3].price_before is None


def test_gap_filter_is_one_pass(spark):
    f = spark.createDataFrame([(1, 1, D(2000, 1, 1)), (2, 1, D(2000, 5, 1)), (3, 1, D(2000, 8, 1))], "accession int, cik int, date_filed date")
    assert [r.accession for r in eventtime.gap_filter(f).collect()] == [1]


RAW = "<DOCUMENT>\n<TYPE>EX-1\n<TEXT>no</TEXT></DOCUMENT><DOCUMENT>\n<TYPE>{}\n<SEQUENCE>1\n<TEXT>{}</TEXT></DOCUMENT>"


@pytest.mark.parametrize(
    ("form", "body", "want"),
    [
        ("10-K", "Café well-\n  known &amp; good", "CAFÉ WELL-KNOWN & GOOD"),
        ("10-K405", "a<b>c</b>\t d\n\n\n\ne", "A C D\n\nE"),
        ("10-KSB", "text", ""),
        ("10-K/A", "text", ""),
        ("10-K", "x<TABLE>1a2b</TABLE>y<table>12abcdef</table>z", "X Y 12ABCDEF Z"),
        ("10-K", "x<TABLE></TABLE>y &lt;i&gt; soft­hyphen “q”", 'X Y SOFT-HYPHEN "Q"'),
        ("10-K", "a<PDF>zz</PDF>b<ix:hidden x='1'>q</ix:hidden>c", "A B C"),
    ],
)
def test_clean_text(spark, form, body, want):
    assert spark.createDataFrame([(RAW.format(form, body),)], "raw string").select(T.clean_text("raw")).first()[0] == want


def test_sections():
    words = "WORD " * 250
    toc = "ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS\nITEM 8. FINANCIAL STATEMENTS\n"
    text = toc + "ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS " + words + "ITEM 8. FINANCIAL STATEMENTS END"
    got, status = T.section(text, "10-K")
    assert status == "ok_t1_10k_item7" and got.startswith("ITEM 7.") and got.endswith("WORD")
    assert T.section(text.replace(words, "WORD " * 100), "10-K") == (None, "no_match")
    assert T.section("\nMANAGEMENTS DISCUSSION " + words + "CONSOLIDATED BALANCE SHEET", "10-K")[1] == "ok_t3_bare"
    assert T.section("ITEM 6. MANAGEMENT'S DISCUSSION " + words + "ITEM 7. FINANCIAL STATEMENTS", "10-KSB")[1] == "ok_t1_ksb_item6"
    assert T.section("\nVI. MANAGEMENT'S DISCUSSION " + words + "REPORT OF INDEPENDENT", "10-KSB")[1] == "ok_t2_roman"
    assert T.section(None, None) == (None, "no_match")
    # An end within another's reach, and many headings without a quadratic search.
    near = "ITEM 7. MANAGEMENT'S DISCUSSION " + words + "ITEM 8. ITEM 8. FINANCIAL STATEMENTS"
    assert T.section(near, "10-K")[0].endswith("WORD")
    began = time.time()
    assert T.section("MANAGEMENT'S DISCUSSION ITEM 8. FINANCIAL STATEMENTS\n" * 5000, "10-K")[1] == "no_match"
    assert time.time() - began < 20


def test_text_columns(spark):
    df = spark.createDataFrame([(RAW.format("10-K", "loss and gain"),), (None,)], "raw string")
    assert [r[0] for r in df.select(T.clean_text("raw")).collect()] == ["LOSS AND GAIN", ""]
    got = df.select(T.extract_section(T.clean_text("raw"), F.lit("10-K")).alias("x")).select("x.*").collect()
    assert [r.status for r in got] == ["no_match", "no_match"]


def test_filings_reader(spark, tmp_path):
    (tmp_path / "1_a.txt.gz").write_bytes(gzip.compress(RAW.format("10-K", "café").encode("latin-1")))
    (tmp_path / "2_b.txt.gz").write_bytes(b"not gzip")
    got = {r.path[-10:]: r for r in readers.filings(spark, str(tmp_path)).collect()}
    assert got["1_a.txt.gz"].clean == "CAFÉ" and got["1_a.txt.gz"].ok
    assert not got["2_b.txt.gz"].ok and "not a compressed file" in got["2_b.txt.gz"].error


def test_dictionary_rules_and_literal_null(spark, tmp_path):
    (tmp_path / "d.csv").write_text("word,negative,positive\nnull,2009,0\nna,-2014,0\nnan,0,2009\n")
    words = readers.csv(spark, str(tmp_path / "d.csv"), "word string, negative int, positive int")
    assert {r.word: r.neg for r in tone.dictionary(words).collect()} == {"NULL": True, "NA": True, "NAN": False}
    assert {r.word: r.neg for r in tone.dictionary(words, "positive").collect()} == {"NULL": True, "NA": False, "NAN": False}


def test_tone_of_empty_documents(spark):
    docs = spark.createDataFrame([(1, "loss loss gain"), (2, ""), (3, None)], "doc_id int, text string")
    words = spark.createDataFrame([("LOSS", True, False), ("GAIN", False, True)], "word string, neg boolean, pos boolean")
    counts = tone.proportional(tone.word_counts(docs, words))
    got = {r.doc_id: (r.n_words, r.n_neg, r.neg_pct) for r in counts.collect()}
    assert got == {1: (3, 2, pytest.approx(200 / 3)), 2: (0, 0, None), 3: (0, 0, None)}
    scores = {r.doc_id: r.tfidf for r in tone.tfidf(tone.term_counts(docs, words).where("neg"), counts).collect()}
    assert scores[1] == pytest.approx((1 + np.log(2)) / (1 + np.log(3)) * np.log(3)) and scores[2] == 0


def test_upsert_keeps_fixed_columns(spark):
    state = spark.createDataFrame([(1, 10, "failed"), (2, 20, "ok")], "accession int, cik int, status string")
    changes = spark.createDataFrame([(1, 99, "failed", 1), (1, 99, "ok", 2), (3, 30, "ok", 1)], "accession int, cik int, status string, at int")
    got = sorted(tuple(r) for r in rows.upsert(state, changes, "accession", ["cik"], [F.desc("at")]).collect())
    assert got == [(1, 10, "ok"), (2, 20, "ok"), (3, 30, "ok")]


def quarter(n, q, seed, industries=4):
    rng = np.random.default_rng(seed)
    x, c = rng.normal(size=n), rng.normal(size=n)
    return pd.DataFrame({"date_filed": [q + datetime.timedelta(int(d)) for d in rng.integers(0, 60, n)], "industry": rng.integers(0, industries, n), "x": x, "c": c, "y": 0.5 * x - c + rng.normal(size=n)})


def test_fama_macbeth_against_numpy(spark):
    frames = [quarter(n, D(2000 + i // 4, 3 * (i % 4) + 1, 1), i) for i, n in enumerate([29, 30, 60, 80, 45, 100])]
    panel = spark.createDataFrame(pd.concat(frames)).withColumn("date_filed", F.to_date("date_filed"))
    s = regress.Setting("J", winsor="none", lags=2)
    got = {r.variable: r for r in regress.fama_macbeth(panel, {"full": ("y", "x")}, ["c"], [s]).collect()}
    betas, ns = [], []
    for g in frames[1:]:
        d = pd.get_dummies(g.industry, drop_first=True).to_numpy(float)
        m = np.column_stack([g.x, g.c, d, np.ones(len(g))])
        betas.append(np.linalg.lstsq(m, g.y, rcond=None)[0][:2])
        ns.append(len(g))
    betas, w = np.array(betas), np.array(ns, float)
    for j, v in enumerate(["x", "c"]):
        coef = (w * betas[:, j]).sum() / w.sum()
        u = w * (betas[:, j] - coef)
        var = (u * u).sum() + sum(2 * (1 - k / 3) * (u[k:] * u[:-k]).sum() for k in (1, 2))
        assert got[v].coef == pytest.approx(coef) and got[v].t == pytest.approx(coef / (np.sqrt(var) / w.sum()))
        assert got[v].n == sum(ns) and got[v].n_quarters == 5


def fit_by_force(g, y, x, continuous, s):
    """One cross section by the rules, row by row; none if it has too few rows, before or after thin industries go."""
    if len(g) < s.min_obs:
        return None
    g = g.copy()
    if s.winsor == "quarter":
        for c in continuous:
            g[c] = g[c].clip(g[c].quantile(0.01), g[c].quantile(0.99))
    if s.thin:
        g = g[g.groupby("industry")["industry"].transform("size") >= s.thin]
        if len(g) < s.min_obs:
            return None
    weights = 1.0 / g.groupby("date_filed")["industry"].transform("size").to_numpy(float) if s.weight else np.ones(len(g))
    columns = [g[c].to_numpy(float) for c in x]
    if s.industries:
        codes, names = pd.factorize(g["industry"], sort=True)
        columns += [(codes == i).astype(float) for i in range(1, len(names))]
    design, root, own = np.column_stack([*columns, np.ones(len(g))]), np.sqrt(weights), g[y].to_numpy(float)
    beta = np.linalg.pinv(design * root[:, None]) @ (own * root)
    rank = np.linalg.matrix_rank(design * root[:, None])
    rest, total = (weights * (own - design @ beta) ** 2).sum(), (weights * (own - np.average(own, weights=weights)) ** 2).sum()
    return len(g), 1 - (len(g) - 1) / (len(g) - rank) * rest / total if len(g) > rank else None, beta[: len(x)]


def grid_rows():
    frames = []
    for i, n in enumerate([29, 30, 60, 110, 45, 100]):
        g = quarter(n, D(2000 + i // 4, 3 * (i % 4) + 1, 1), i, 7)
        g["x2"], g["y2"] = g.x**3 + 100, 1e6 * g.y + 3e7
        g["nasdaq"] = (g.c > 1).astype(int)
        frames.append(g)
    p = pd.concat(frames, ignore_index=True)
    p.loc[p.index % 17 == 0, "x2"] = np.nan
    return p


def test_grid_against_force(spark):
    """Every setting, cell and arm, with winsorizing, weights, thin industries and a dummy."""
    p = grid_rows()
    panel = spark.createDataFrame(p).withColumn("date_filed", F.to_date("date_filed")).withColumn("x2", F.when(~F.isnan("x2"), F.col("x2")))
    cells, controls = {"a": ("y", "x"), "b": ("y2", "x2")}, ["c", "nasdaq"]
    settings = [*regress.GRID, regress.Setting("W", weight=True, thin=5, min_obs=20)]
    got = {(r.cell, r.setting, r.industries, r.quarter, r.variable): r for r in regress.quarterly_fits(panel, cells, controls, settings, True).collect()}
    want = {}
    for cell, (y, main) in cells.items():
        rows = p.dropna(subset=[y, main, *controls])
        smooth = [y, main, "c"]
        full = rows.copy()
        for c in smooth:
            full[c] = full[c].clip(full[c].quantile(0.01), full[c].quantile(0.99))
        for s in settings:
            for e in (True, False):
                arm = dataclasses.replace(s, industries=e)
                for q, g in (full if s.winsor == "full" else rows).groupby(pd.PeriodIndex(pd.to_datetime(rows.date_filed), freq="Q")):
                    found = fit_by_force(g, y, [main, *controls], smooth, arm)
                    if found:
                        for v, b in zip([main, *controls], found[2], strict=True):
                            want[cell, s.name, e, q.start_time.date(), v] = (found[0], found[1], b)
    assert set(got) == set(want)
    for key, (n, r2, beta) in want.items():
        r = got[key]
        assert r.n == n and r.beta == pytest.approx(beta, rel=1e-7, abs=1e-9) and r.r2 == pytest.approx(r2, rel=1e-7), key


def test_rank_deficient_and_thin(spark):
    """The least-norm solution where a control is constant, within industries or on the whole, and odd tables."""
    g = quarter(40, D(2000, 1, 1), 3)
    g["one"], g["by"] = 1.0, g.industry * 2.0
    one = g.assign(industry=1)
    for frame, x in ((g, ["x", "one"]), (g, ["x", "by"]), (g, ["x", "by", "one"]), (one, ["x", "c"])):
        panel = spark.createDataFrame(frame).withColumn("date_filed", F.to_date("date_filed"))
        for s in (regress.Setting("J", winsor="none"), regress.Setting("J", winsor="none", weight=True), regress.Setting("J", winsor="none", industries=False)):
            got = {r.variable: r for r in regress.quarterly_fits(panel, {"k": ("y", x[0])}, x[1:], [s]).collect()}
            n, r2, beta = fit_by_force(frame, "y", x, [], s)
            assert [got[v].beta for v in x] == pytest.approx(list(beta), rel=1e-6, abs=1e-8) and got["x"].n == n and got["x"].r2 == pytest.approx(r2, rel=1e-6)
    panel = spark.createDataFrame(g).withColumn("date_filed", F.to_date("date_filed"))
    assert regress.quarterly_fits(panel, {"k": ("y", "x")}, [], [regress.Setting(thin=40)]).collect() == []
    assert regress.quarterly_fits(panel.where("false"), {"k": ("y", "x")}, ["c"], both=True).collect() == []


def test_panels_are_masks_of_one_table(spark):
    """Panels that share rows and differ in a column, from one reading of the panel; each equals its own fit."""
    p = grid_rows()
    panel = spark.createDataFrame(p).withColumn("date_filed", F.to_date("date_filed"))
    variants = {
        "all": regress.Variant(F.lit(True)),
        "some": regress.Variant(F.col("c") < 0.5),
        "other": regress.Variant(F.lit(True), {"industry": F.col("industry") % 2, "x": F.col("x") + F.col("c")}),
        "none": regress.Variant(F.lit(None).cast("boolean")),
    }
    own = {"all": panel, "some": panel.where("c < 0.5"), "other": panel.withColumn("industry", F.col("industry") % 2).withColumn("x", F.col("x") + F.col("c"))}
    settings = [regress.Setting("A"), regress.Setting("C", weight=True)]
    got = {(r.panel, r.setting, r.quarter, r.variable): r.beta for r in regress.quarterly_fits(panel, {"k": ("y", "x")}, ["c"], settings, panels=variants).collect()}
    want = {(n, r.setting, r.quarter, r.variable): r.beta for n, df in own.items() for r in regress.quarterly_fits(df, {"k": ("y", "x")}, ["c"], settings).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want)


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else float(i)) for i in range(6)], "a double, b double")
    got = {r.variable: r for r in stats.describe(df, ["a", "b"]).collect()}
    assert got["b"].n == 3 and got["a"].sd == pytest.approx(pd.Series(range(6)).std())
    assert [r.value for r in stats.quantiles(df, "a", [0.25]).collect()] == [1.25]
    assert {r.variable: r.pct for r in stats.coverage(df, ["a", "b"]).collect()} == {"a": 100.0, "b": 50.0}


def test_range_file(spark, tmp_path):
    lines = ["          0001-0002 above", " 1 Agric  Agriculture", "          0100-0199 Crops", "          0150-0150 Other", " 2 Food", "", "          2000-2046"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("junk\r\n 7 Other x\r\n 9000-9001 y")
    got = sorted(tuple(r)[1:] for r in readers.industry_ranges(spark, str(tmp_path)).collect())
    assert got == [(100, 199, 1, "Agric", 2), (150, 150, 1, "Agric", 3), (2000, 2046, 2, "Food", 6), (9000, 9001, 7, "Other", 2)]


def test_missing_quarters(spark):
    df = spark.createDataFrame([(D(2000, 5, 1),), (D(2001, 12, 31),), (None,)], "d date")
    assert sorted(tuple(r) for r in readers.missing_quarters(df, "d").collect()) == [(2000, 1), (2000, 3), (2000, 4), (2001, 1), (2001, 2), (2001, 3)]
    assert readers.missing_quarters(df.where("false"), "d").collect() == [] and readers.quarters(spark, 2000, 2001).count() == 8


def test_files_are_whole_or_absent(spark, tmp_path):
    folder = tmp_path / "out"
    df = spark.createDataFrame([(i, f"text {i}\n") for i in range(20)] + [(20, None)], "k int, text string").repartition(4)
    for address in (str(folder), f"file://{tmp_path}/url"):
        sinks.texts(df, address, "k")
    assert {p.name: p.read_text() for p in folder.iterdir()} == {f"{i}.txt": f"text {i}\n" if i < 20 else "" for i in range(21)}
    assert len(list((tmp_path / "url").iterdir())) == 21
    sinks.texts(df.where("k < 3").withColumn("text", F.lit("new")), str(folder), "k", again=False)
    assert (folder / "1.txt").read_text() == "text 1\n"
    sinks.texts(df.where("k < 3").withColumn("text", F.lit("new")), str(folder), "k")
    assert (folder / "1.txt").read_text() == "new" and len(list(folder.iterdir())) == 21
    for bad in (df.withColumn("k", F.col("k") % 5), df.select(F.when(F.col("k") != 7, F.col("k")).alias("k"), "text"), df.select(F.concat(F.lit("a/"), "k").alias("k"), "text")):
        with pytest.raises(Exception):  # noqa: B017
            sinks.texts(bad, str(tmp_path / "none"), "k")
        assert not list((tmp_path / "none").glob("**/*.txt")) and not list((tmp_path / "none").glob("_staged*"))


def test_contract_and_probe(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    assert readers.contract(df, "a int").first().a == 1
    with pytest.raises(ValueError, match="missing"):
        readers.contract(df, "a int, z int")
    df.createOrReplaceTempView("second_choice")
    assert readers.first_table(spark, ["first_choice", "second_choice"]).count() == 1
    with pytest.raises(ValueError, match="none"):
        readers.first_table(spark, ["absent"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", float("inf")), (2, "b", 1.5)], "k int, name string, x double")
    sinks.parquet(df, str(tmp_path / "p"), by=["name"])
    assert {(r.k, r.x) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, None), (2, 1.5)}
    sinks.csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "k int, name string, x double").count() == 2
    lines = [r.line for r in sinks.markdown(df, ["k"], "T").orderBy("place").collect()]
    assert lines[:4] == ["## T", "", "| k | name | x |", "|---|---|---|"] and lines[-1] == "| 2 | b | 1.5000 |" and len(lines) == 6


def test_empty_tables(spark):
    f = spark.createDataFrame([], "accession long, cik long, date_filed date, filing_year int, permno long")
    u = spark.createDataFrame([], "cik long, gvkey long, permno long, fyear int")
    h = spark.createDataFrame([], "cik long, gvkey long, linkdt date, linkenddt date")
    assert links.linked(f, u, h).count() == 0
    days = eventtime.trading_days(spark.createDataFrame([], BARS))
    assert eventtime.checks(eventtime.event_days(f, days), days).count() == 0


def test_event_windows_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    from tonequarry.operators import eventtime
    from tonequarry.plans.queries import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    found = lambda: eventtime.checks(t("filings"), eventtime.trading_days(t("daily")))
    usual = found()
    monkeypatch.setattr(eventtime, "PART_BYTES", 20_000)
    more = found()
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan(more) and "REPARTITION_BY_NUM" not in plan(usual)
    assert sorted(more.collect()) == sorted(usual.collect())


def test_databases_are_asked_where_they_stand(spark, tmp_path):
    """Databases are made and asked by tasks: nulls, several databases of one task, ranges of keys, and no driver's memory."""
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i * 0.5, f"t{i % 3}") for i in range(100)], "k long, v double, s string").repartition(3)
    readers.databases(df, "k", str(tmp_path / "db"), "rows", 10)
    assert spark.read.parquet(str(tmp_path / "db")).count() >= 10
    got = readers.pulled(spark, str(tmp_path / "db"), "SELECT k, v FROM rows WHERE s <> 't1'", "k long, v double")
    assert sorted(map(tuple, got.collect())) == [(i, None if i % 7 == 0 else i * 0.5) for i in range(100) if i % 3 != 1]
    assert readers.pulled(spark, str(tmp_path / "db"), "SELECT k FROM rows", "k long", low=1000).count() == 0


def test_the_pulled_database_is_no_jvm_s_own(spark):
    """The plan of the pull holds no connection to a database in the driver's memory, which executors can't reach."""
    from tonequarry.plans import queries as plans

    plan = plans.QUERIES["SRC1_remote_pull"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "JDBC" not in plan and "MapInArrow" in plan


def test_only_wanted_variables_are_summed(spark):
    """What isn't wanted has no running sum and no lookup; what is wanted is as it is among all."""
    bars = spark.sql("SELECT 1 AS permno, date_add(DATE '2000-01-01', CAST(id AS INT)) AS date, 10.0 + id % 7 AS prc, 100.0 AS vol, 0.001D * (id % 5) AS ret, 5.0 AS shrout, 1 AS exchcd, 0.001D AS vwretd, 0.001D * (id % 3) AS mktrf, 0.001D * (id % 4) AS smb, 0.001D * (id % 6) AS hml, 0.0001D AS rf FROM range(400)")
    filings = spark.sql("SELECT 9 AS accession, 1 AS permno, DATE '2001-01-20' AS date_filed")
    days = eventtime.trading_days(bars)
    every = eventtime.variables(filings, days).first().asDict()
    some = eventtime.variables(filings, days, wanted=("excret", "size_b"))
    assert None not in every.values()
    assert some.first().asDict() == {n: every[n] for n in ("accession", "excret", "size_b")}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "volume" not in plan and "s_x0" not in plan


def test_unsolvable_quarters_count_by_weight(spark):
    """As in the queries' SQL: a quarter of less than full rank has no coefficient, but its rows and weight count."""
    r = random.Random(3)
    rows = [(D(2000, 1 + 3 * q, 1 + i % 28), i % 3, r.random(), float(i % 10), float((i % 3) if q == 1 else i % 2)) for q in range(3) for i in range(60)]
    panel = spark.createDataFrame(rows, "date_filed date, industry long, y double, x double, nasdaq double")
    one = [regress.Setting("J", winsor="none")]
    fits = {(f.quarter.month, f.variable): f.beta for f in regress.quarterly_fits(panel, {"c": ("y", "x")}, ["nasdaq"], one).collect()}
    got = {f.variable: f for f in regress.fama_macbeth(panel, {"c": ("y", "x")}, ["nasdaq"], one, least_norm=False).collect()}
    for v in ("x", "nasdaq"):
        assert got[v].n == 180 and got[v].n_quarters == 3
        assert got[v].coef == pytest.approx((fits[1, v] + fits[7, v]) / 3)


def test_rows_of_a_date_are_summed_in_one_task(spark):
    start = datetime.date(2000, 1, 3)
    rows = [(start + datetime.timedelta(days=i % 5), i % 3, float(i), float(i * i % 7)) for i in range(200)]
    panel = spark.createDataFrame(rows, "date_filed date, industry int, y double, x double").repartition(8)
    melted = regress._melted(panel, {"c": ["y", "x"]}, None)
    places = melted.select("date_filed", F.spark_partition_id().alias("part")).distinct()
    assert melted.count() == 200 and places.count() == 5


def test_only_linked_securities_are_read_and_windows_asked_once(spark, monkeypatch):
    day = datetime.date(2000, 1, 3)
    linked = spark.createDataFrame([(1, 7, day), (2, 7, day), (3, 9, day), (4, None, day)], "accession long, permno long, date_filed date")
    bars = spark.createDataFrame([(p, float(p)) for p in (1, 7, 7, 8, 9, 12)], "permno long, prc double")
    (own,) = pipeline.of_securities(linked, bars)
    assert sorted(r.permno for r in own.collect()) == [7, 7, 9]
    (none,) = pipeline.of_securities(linked.where("permno IS NULL"), bars)
    assert none.count() == 0

    class Asked(Exception):
        pass

    def stop(asked, days):
        raise Asked(sorted((r.accession, r.permno) for r in asked.collect()))

    monkeypatch.setattr(pipeline.eventtime, "checks", stop)
    monkeypatch.setattr(pipeline.eventtime, "trading_days", lambda daily: daily)
    with pytest.raises(Asked) as found:
        pipeline.attributes_and_variables(linked, None, None, None, None, pipeline.Options())
    assert found.value.args[0] == [(1, 7), (3, 9)]


def test_open_intervals_end_with_the_last_row_asking(spark):
    d = datetime.date
    history = spark.createDataFrame([(1, 10, d(1999, 1, 1), None), (1, 11, d(2000, 2, 1), d(2030, 1, 1)), (2, 12, d(2005, 1, 1), None), (2, 13, d(1998, 1, 1), d(1998, 6, 1))], "cik long, gvkey long, linkdt date, linkenddt date")
    left = spark.createDataFrame([(1, 1, d(1999, 5, 1)), (2, 1, d(2000, 3, 1)), (3, 2, d(1998, 6, 1)), (4, 2, d(2000, 3, 1))], "accession long, cik long, date_filed date")
    short = links.ended(history, "linkenddt", d(2000, 3, 1))
    of = lambda h: sorted(tuple(r) for r in links.latest_valid(left, h, "cik", "accession", "date_filed", "linkdt", "linkenddt", ["gvkey"]).select("accession", "gvkey").collect())
    assert of(short) == of(history) == [(1, 10), (2, 11), (3, 13)]
    assert links.segments(short, "cik", "linkdt", "linkenddt").count() < 20 < links.segments(history, "cik", "linkdt", "linkenddt").count()
