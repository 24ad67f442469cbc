"""Candidate selection, re-eligibility, budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.functions.prices import call_cost, implied_move
from sigloft.functions.text import stated_side
from sigloft.plans import candidates as plan
from sigloft.plans.backtest import best_brief

LOOKBACK_HOURS = 24 * 365
_BLOCKED = ("S7", "S13", "S21")
OPEN = f"""
open_scored AS (
  SELECT q.* FROM quotes q, quotes_anchor
  WHERE flagged_candidate AND scored_at >= anchor - INTERVAL {LOOKBACK_HOURS} HOUR AND yes_bid BETWEEN 0.25 AND 0.75
    AND date_diff('day', anchor, close_time) BETWEEN 60 AND 365)"""
_ORDER = "mispricing_score DESC, abs(coalesce(delta_15m, 0)) DESC, ticker"
_SHOWN = f"ticker, title, yes_bid, {fx('mispricing_score')} AS mispricing_score, {fx('yes_bid / (1 + coalesce(delta_15m, 0))', 6)} AS previous_odds"


def open_scored(spark, sf):
    rows = v.quotes(spark, sf).drop("close_time", "series", "o_orderkey")
    live = v.quotes(spark, sf).select("ticker", "close_time")
    return plan.open_scored(rows, live, v.orders_anchor(spark, sf), LOOKBACK_HOURS)


def _shown(rows):
    return rows.select("ticker", "title", "yes_bid", fixed("mispricing_score", 4).alias("mispricing_score"), fixed("previous_odds", 6).alias("previous_odds"))


def ranked_sql(source: str, body: str = _SHOWN) -> str:
    return f"""SELECT {body} FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY series ORDER BY {_ORDER}) <= {fv.SERIES_LIMIT})
ORDER BY {_ORDER} LIMIT {fv.CANDIDATE_LIMIT}"""


@query("candidate_selection", with_ctes(ranked_sql("open_scored"), v.QUOTES, OPEN))
def candidate_selection(spark, sf):
    """The top list: at most three per series, fifty in all."""
    return _shown(plan.ranked_candidates(open_scored(spark, sf)))


@query("open_candidates", with_ctes(
    f"SELECT ticker, series, yes_bid, {fx('mispricing_score')} AS mispricing_score FROM open_scored", v.QUOTES, OPEN))
def open_candidates(spark, sf):
    """All candidates before ranking."""
    return open_scored(spark, sf).select("ticker", "series", "yes_bid", fixed("mispricing_score", 4).alias("mispricing_score"))


BLOCKED = f"unblocked AS (SELECT * FROM open_scored WHERE series NOT IN {_BLOCKED} AND NOT contains(lower(title), 'how many') AND NOT contains(lower(title), 'number of'))"


@query("candidate_blocklist", with_ctes(ranked_sql("unblocked"), v.QUOTES, OPEN, BLOCKED))
def candidate_blocklist(spark, sf):
    """The top list without blocked series and count-style titles."""
    return _shown(plan.ranked_candidates(plan.without_blocked(open_scored(spark, sf), _BLOCKED)))


HISTORY = """
history AS (
  SELECT 'S' || (o_custkey % 50) || '-' || o_orderkey AS ticker, anchor - to_minutes(m) AS analyzed_at,
         CASE WHEN m % 4 <> 0 THEN (m % 512) / 1024::DOUBLE + 0.25 END AS last_price, CASE WHEN m % 3 <> 0 THEN (m % 9) / 2::DOUBLE END AS last_spike
  FROM (SELECT l_orderkey, (l_partkey * 3 + l_linenumber) % 2400 AS m FROM lineitem) JOIN orders ON l_orderkey = o_orderkey, quotes_anchor
  WHERE o_orderstatus <> 'P'),
last_seen AS (
  SELECT ticker, max(analyzed_at) AS analyzed_at, arg_max(last_price, analyzed_at) AS last_price, arg_max(last_spike, analyzed_at) AS last_spike
  FROM history GROUP BY ticker)"""


def inference_history(spark, sf):
    """One analysis per line item of orders that are not pending."""
    minutes = (F.col("l_partkey") * 3 + F.col("l_linenumber")) % 2400
    items = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), minutes.alias("_m"))
    owner = v.table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey")
    m = F.col("_m")
    return items.join(owner, "o_orderkey").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("ticker"),
        (v.orders_anchor(spark, sf) - F.make_dt_interval(mins=m.cast("int"))).alias("analyzed_at"),
        F.when(m % 4 != 0, (m % 512) / 1024 + 0.25).alias("last_price"), F.when(m % 3 != 0, (m % 9) / 2).alias("last_spike"),
    )


@query("change_eligibility", with_ctes("""
SELECT l.ticker, l.yes_bid, l.max_spike_multiplier FROM open_scored l LEFT JOIN last_seen h ON l.ticker = h.ticker, quotes_anchor
WHERE h.ticker IS NULL OR h.analyzed_at IS NULL OR (h.analyzed_at < anchor - INTERVAL 15 MINUTE AND (
  h.last_price IS NULL OR abs(l.yes_bid - h.last_price) >= 0.05::DOUBLE OR l.max_spike_multiplier >= greatest(coalesce(h.last_spike, 0) * 1.5::DOUBLE, 3.0::DOUBLE)
  OR h.analyzed_at < anchor - INTERVAL 24 HOUR))""", v.QUOTES, OPEN, HISTORY))
def change_eligibility(spark, sf):
    """Candidates never analysed, or moved, re-spiked or old since."""
    rows = plan.eligible_again(open_scored(spark, sf), inference_history(spark, sf), v.orders_anchor(spark, sf))
    return rows.select("ticker", "yes_bid", "max_spike_multiplier")


_AGAIN = """
again AS (
  SELECT l.* FROM unblocked l LEFT JOIN last_seen h ON l.ticker = h.ticker, quotes_anchor
  WHERE h.ticker IS NULL OR h.analyzed_at IS NULL OR (h.analyzed_at < anchor - INTERVAL 15 MINUTE AND (
    h.last_price IS NULL OR abs(l.yes_bid - h.last_price) >= 0.05::DOUBLE OR l.max_spike_multiplier >= greatest(coalesce(h.last_spike, 0) * 1.5::DOUBLE, 3.0::DOUBLE)
    OR h.analyzed_at < anchor - INTERVAL 24 HOUR)))"""


@query("candidate_chain", with_ctes(ranked_sql("again"), v.QUOTES, OPEN, BLOCKED, HISTORY, _AGAIN))
def candidate_chain(spark, sf):
    """The whole selection in one plan: open and flagged, not blocked, new or changed since the last analysis, three per series, fifty in all."""
    rows = plan.without_blocked(open_scored(spark, sf), _BLOCKED)
    return _shown(plan.ranked_candidates(plan.eligible_again(rows, inference_history(spark, sf), v.orders_anchor(spark, sf))))


@query("last_inference", with_ctes(
    "SELECT ticker, epoch_us(analyzed_at) // 1000000 AS analyzed_sec, last_price, last_spike FROM last_seen", v.QUOTES, HISTORY))
def last_inference(spark, sf):
    return plan.last_inference(inference_history(spark, sf)).select(
        "ticker", F.unix_seconds("analyzed_at").alias("analyzed_sec"), "last_price", "last_spike"
    )


_COST = "((o_orderkey * 37) % 4096) / 16384::DOUBLE"


@query("budget_guard", f"""
SELECT o_orderkey, day, spent_before FROM (
  SELECT o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day, coalesce(sum({_COST}) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM orders) WHERE spent_before < 1.0""")
def budget_guard(spark, sf):
    """Calls of a day until its budget is spent."""
    calls = v.table(spark, sf, "orders").select(
        "o_orderkey", F.floor(F.unix_seconds("o_orderdate") / 86_400).cast("bigint").alias("day"), (v.hashed("o_orderkey", 37, 4096) / 16_384).alias("cost")
    )
    kept = plan.within_budget(calls, "day", "o_orderkey", "o_orderkey", "cost")
    return kept.select("o_orderkey", "day", "spent_before")


@query("daily_spend", f"""
SELECT epoch_us(o_orderdate) // 86400000000 AS day, sum({_COST}) AS spend, {fx('sum(((o_orderkey * 53) % 4096) / 1000000.0::DOUBLE * 0.15::DOUBLE + (o_orderkey % 512) / 1000000.0::DOUBLE * 0.6::DOUBLE)', 6)} AS token_cost
FROM orders GROUP BY 1""")
def daily_spend(spark, sf):
    """Spend per day, and the cost of the calls by token counts."""
    rows = v.table(spark, sf, "orders").select(
        F.floor(F.unix_seconds("o_orderdate") / 86_400).cast("bigint").alias("day"), (v.hashed("o_orderkey", 37, 4096) / 16_384).alias("cost"),
        call_cost(v.hashed("o_orderkey", 53, 4096).cast("double"), (F.col("o_orderkey") % 512).cast("double")).alias("tokens"),
    )
    return rows.groupBy("day").agg(F.sum("cost").alias("spend"), fixed(F.sum("tokens"), 6).alias("token_cost"))


@query("held_tickers", with_ctes("""
SELECT ticker FROM fills WHERE action = 'buy' UNION SELECT ticker FROM briefs WHERE brief_id % 7 <> 0""", v.BRIEFS, v.FILLS))
def held_tickers(spark, sf):
    """Held by the ledger or by a trade that is not closed."""
    ledger = v.fills(spark, sf).where(F.col("action") == "buy")
    trades = v.briefs(spark, sf).select("ticker", F.when(F.col("brief_id") % 7 == 0, F.col("sec")).alias("closed_at"))
    return plan.held_tickers(ledger, trades)


@query("brief_gates", with_ctes(f"""
SELECT ticker, brief_id, side, {fx("CASE WHEN side = 'yes' THEN confidence ELSE 1 - confidence END - odds")} AS odds_delta FROM (
  SELECT *, CASE WHEN recommended_side IN ('yes', 'no') THEN recommended_side WHEN contains(lower(verdict), 'buy no') THEN 'no'
         WHEN contains(lower(verdict), 'buy yes') THEN 'yes' END AS side
  FROM briefs QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY confidence DESC, sec DESC, brief_id DESC) = 1)
WHERE side IS NOT NULL AND confidence >= 0.65::DOUBLE AND confidence >= CASE WHEN side = 'yes' THEN odds ELSE 1 - odds END + 0.10::DOUBLE""", v.BRIEFS))
def brief_gates(spark, sf):
    """Best brief per market that clears the confidence floor and the edge, with the implied move."""
    best = best_brief(v.briefs(spark, sf), ["ticker"]).withColumn("side", stated_side(F.col("recommended_side"), F.col("verdict")))
    kept = best.where(F.col("side").isNotNull() & plan.clears_edge(F.col("side"), F.col("confidence"), F.col("odds")))
    return kept.select("ticker", "brief_id", "side", fixed(implied_move(F.col("side"), F.col("confidence"), F.col("odds")), 4).alias("odds_delta"))
