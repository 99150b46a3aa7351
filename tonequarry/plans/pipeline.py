"""The composite plans: the sample funnel, the analysis panel, the industry policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonequarry.functions.columns import log_floor, month_start, previous_quarter_end
from tonequarry.operators import eventtime, links, regress, rows, selection, stats


@dataclass(frozen=True)
class Options:
    """What varies between runs of the study; passed on, never taken from the environment."""

    forms: tuple[str, ...] = ("10-K", "10-K405")
    share_codes: tuple[int, ...] = (10, 11)
    exchanges: tuple[int, ...] = (1, 2, 3)
    gap_days: int = 180
    least_price: float = 3.0
    least_words: int = 2000
    as_of_days: int = 400
    use_history: bool = True
    sic_source: str = "crsp"
    positive_only: bool = False


#: The panels of the robustness grid: runs of the study that differ in one option.
_BASE = Options(share_codes=(10, 11, 12), use_history=False)
VARIANTS = {
    "default": _BASE,
    "dict_pos_only": replace(_BASE, positive_only=True),
    "link_with_comphist": replace(_BASE, use_history=True),
    "shrcd_10_11": replace(_BASE, share_codes=(10, 11)),
    "shrcd_10_11_12_18": replace(_BASE, share_codes=(10, 11, 12, 18)),
    "sic_sich": replace(_BASE, sic_source="sich"),
    "sic_sic": replace(_BASE, sic_source="sic"),
    "sic_header": replace(_BASE, sic_source="header_static"),
}


#: Which codes an industry comes from, the first that isn't null.
SIC_SOURCES = {"crsp": ("siccd", "sich", "sic"), "sich": ("sich", "sic"), "sic": ("sic",), "header_static": ("static_siccd", "siccd", "sich", "sic")}


def industry_code(source: str) -> Column:
    return F.coalesce(*map(F.col, SIC_SOURCES[source]))


def last_known(monthly: DataFrame, until: str = "2008-12-31") -> DataFrame:
    """``(permno, static_siccd)``: each security's last code up to a day."""
    sound = monthly.where(F.col("yrmon") <= F.lit(until).cast("date")).where("siccd IS NOT NULL")
    return sound.groupBy("permno").agg(F.max_by("siccd", "yrmon").alias("static_siccd"))


def survivors(manifest: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first three filters, which depend on each other's rows: forms, first of a year, distance."""
    forms = rows.first_by(manifest.where(F.col("form_type").isin(*o.forms)), ["accession"], ["date_filed", "cik"])
    forms = forms.withColumn("filing_year", F.year("date_filed"))
    first = rows.first_by(forms, ["cik", "filing_year"], ["date_filed", "accession"])
    return forms, first, eventtime.gap_filter(first, o.gap_days)


def attributes(filings: DataFrame, fundamentals: DataFrame, history: DataFrame | None, monthly: DataFrame, daily: DataFrame, words: DataFrame, o: Options) -> DataFrame:
    """Filings with what the later filters ask for: one lazy plan, no filter applied."""
    out = _with_month(links.linked(filings, fundamentals, history if o.use_history else None), monthly, o)
    out = out.join(eventtime.checks(out, eventtime.trading_days(daily)), "accession", "left")
    return _with_year_and_words(out, fundamentals, words, o)


def attributes_and_variables(linked: DataFrame, fundamentals: DataFrame, monthly: DataFrame, daily: DataFrame, words: DataFrame, o: Options) -> DataFrame:
    """``attributes`` of stored ``linked`` filings, with the event variables.

    Windows are the same for all filings of a security and day: they are looked up once, for the least of these filings.
    """
    days = eventtime.trading_days(daily)
    asked = selection.saved(linked.where("permno IS NOT NULL AND date_filed IS NOT NULL").groupBy("permno", "date_filed").agg(F.min("accession").alias("accession")))
    found = eventtime.checks(asked, days).join(eventtime.variables(asked, days), "accession").join(asked, "accession").drop("accession")
    out = _with_month(linked, monthly, o).join(found, ["permno", "date_filed"], "left")
    return _with_year_and_words(out, fundamentals, words, o)


def _with_month(linked: DataFrame, monthly: DataFrame, o: Options) -> DataFrame:
    out = linked.withColumn("yrmon", month_start(F.col("date_filed")))
    month = rows.first_by(monthly, ["permno", "yrmon"], [F.col("prc").asc_nulls_last()])
    return links.as_of(out, month, "permno", "accession", "yrmon", ["shrcd", "exchcd", "siccd", "prc"], o.as_of_days, "shrcd")


def _with_year_and_words(out: DataFrame, fundamentals: DataFrame, words: DataFrame, o: Options) -> DataFrame:
    year = fundamentals.where("be > 0 AND bm IS NOT NULL AND mkt_value IS NOT NULL").select("gvkey", (F.col("fyear") + 1).alias("filing_year"), "bm", "mkt_value")
    year = rows.first_by(year, ["gvkey", "filing_year"], ["bm", "mkt_value"])
    out = out.join(year, ["gvkey", "filing_year"], "left")
    enough = words.where(F.col("ok") & (F.col("n_words") >= o.least_words)).select("accession", F.lit(True).alias("enough_words")).distinct()
    return out.join(enough, "accession", "left")


#: Securities that are broadcast, at most.
FEW_SECURITIES = 1 << 20


def of_securities(linked: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of ``tables`` whose security some of the stored filings are linked to: what no filing asks for isn't moved.

    The range of the keys, by which files are read, goes below every aggregation; the join behind it is exact.
    """
    own = selection.saved(linked.where("permno IS NOT NULL").select("permno").distinct())
    n, least, most = own.agg(F.count("*"), F.min("permno"), F.max("permno")).first()
    some = F.broadcast(own) if n <= FEW_SECURITIES else own
    inside = F.col("permno").between(least, most) if n else F.lit(False)
    return [t.where(inside).join(some, "permno", "left_semi") for t in tables]


def flags_of(o: Options) -> dict[str, Column]:
    """The later filters of one set of options, over the columns of ``attributes``; a null is no."""
    linked = F.col("permno").isNotNull()
    if not o.use_history:
        linked = linked & (F.col("match_source") != "comphist")
    flags = {
        "linked": linked,
        "share_code": F.col("shrcd").isin(*o.share_codes),
        "market_cap": F.col("prc").isNotNull(),
        "price": F.col("price_before") >= o.least_price,
        "event_window": F.col("ev_ok"),
        "exchange": F.col("exchcd").isin(*o.exchanges),
        "pre_post": F.col("pre_post_ok"),
        "book_to_market": F.col("bm").isNotNull(),
        "words": F.col("enough_words"),
    }
    return {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}


def flagged(filings: DataFrame, fundamentals: DataFrame, history: DataFrame | None, monthly: DataFrame, daily: DataFrame, words: DataFrame, o: Options) -> DataFrame:
    """Filings with a flag per later filter and the attributes that those need: one lazy plan, no filter applied."""
    out = attributes(filings, fundamentals, history, monthly, daily, words, o)
    return out.select("*", *(c.alias(f"f_{n}") for n, c in flags_of(o).items()))


FLAGS = tuple(f"f_{n}" for n in ("linked", "share_code", "market_cap", "price", "event_window", "exchange", "pre_post", "book_to_market", "words"))


def funnel_report(manifest: DataFrame, kept: tuple[DataFrame, DataFrame, DataFrame], flags: DataFrame) -> DataFrame:
    """``(step, filter, n)`` of all filters in order."""
    counts = None
    for i, (name, df) in enumerate(zip(("forms", "first_of_year", "distance"), kept, strict=True), 1):
        one = df.agg(F.lit(i).alias("step"), F.lit(name).alias("filter"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    later = stats.funnel(flags, FLAGS).where("step > 0").withColumn("step", F.col("step") + 3)
    return counts.unionByName(later)


def panel(sample: DataFrame, daily: DataFrame, counts: DataFrame, scores: DataFrame, ownership: DataFrame, industries: DataFrame, fundamentals: DataFrame, monthly: DataFrame, o: Options) -> DataFrame:
    """The sample with window variables, scores, ownership of the quarter before, industry and transforms."""
    days = eventtime.trading_days(daily)
    found = eventtime.variables(sample, days)
    out = sample.join(found, "accession", "left").join(counts, "accession", "left").join(scores, "accession", "left")
    out = out.withColumn("yqtr", previous_quarter_end(F.col("date_filed"))).join(ownership, ["permno", "yqtr"], "left")
    codes = fundamentals.select("gvkey", (F.col("fyear") + 1).alias("filing_year"), "sic", "sich")
    codes = rows.first_by(codes, ["gvkey", "filing_year"], [F.col("sich").asc_nulls_last(), F.col("sic").asc_nulls_last()])
    out = out.join(codes, ["gvkey", "filing_year"], "left").join(last_known(monthly), "permno", "left")
    out = links.range_lookup(out, industry_code(o.sic_source), links.dense_ranges(industries, "low", "high", "industry", "line"), "industry", 49)
    return out.select(
        "accession", "cik", "permno", "gvkey", "date_filed", "industry", "excret", "alpha", "inst_own", "neg_pct", "tfidf",
        log_floor(F.col("size_b"), 1e-6).alias("log_size"), log_floor(F.col("bm"), 1e-6).alias("log_bm"), log_floor(F.col("turnover"), 1e-9).alias("log_turnover"),
        (F.coalesce("exchcd", F.lit(-1)) == 3).cast("int").alias("nasdaq"),
    )


def grid_panels(sample: DataFrame, scores: DataFrame, positive: Mapping[str, str], ownership: DataFrame, industries: DataFrame, fundamentals: DataFrame, monthly: DataFrame, options: Mapping[str, Options]) -> tuple[DataFrame, dict[str, regress.Variant]]:
    """The rows of all panels of a grid, each once, and what each panel takes of them.

    ``sample``: ``attributes`` with event variables, under options that allow all that any panel does. A panel's rows
    are those that pass its own filters; its industry is that of its policy; with the positive rule the scores named
    in ``positive`` stand for those that they are named after.
    """
    out = sample.join(scores, "accession", "left")
    out = out.withColumn("yqtr", previous_quarter_end(F.col("date_filed"))).join(ownership, ["permno", "yqtr"], "left")
    codes = fundamentals.select("gvkey", (F.col("fyear") + 1).alias("filing_year"), "sic", "sich")
    codes = rows.first_by(codes, ["gvkey", "filing_year"], [F.col("sich").asc_nulls_last(), F.col("sic").asc_nulls_last()])
    out = out.join(codes, ["gvkey", "filing_year"], "left").join(last_known(monthly), "permno", "left")
    dense = links.dense_ranges(industries, "low", "high", "industry", "line")
    for k in dict.fromkeys(o.sic_source for o in options.values()):
        out = links.range_lookup(out, industry_code(k), dense, "industry", 49).withColumnRenamed("industry", f"industry_{k}")
    member = {n: _all(list(flags_of(o).values())) for n, o in options.items()}
    names = [c for c in scores.columns if c != "accession"]
    rows_of = out.select(
        "date_filed", "excret", "alpha", "inst_own", *names, *(c for c in out.columns if c.startswith("industry_")), F.array(*member.values()).alias("member"),
        log_floor(F.col("size_b"), 1e-6).alias("log_size"), log_floor(F.col("bm"), 1e-6).alias("log_bm"), log_floor(F.col("turnover"), 1e-9).alias("log_turnover"),
        (F.coalesce("exchcd", F.lit(-1)) == 3).cast("int").alias("nasdaq"),
    )
    swap = {n: {a: F.col(b) for a, b in positive.items()} if o.positive_only else {} for n, o in options.items()}
    return rows_of, {n: regress.Variant(F.col("member")[i], {"industry": F.col(f"industry_{o.sic_source}"), **swap[n]}) for i, (n, o) in enumerate(options.items())}


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
