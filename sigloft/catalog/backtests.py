"""Back-tests and strategy statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.catalog.sqlparts import NAMED, kelly_sql, theme_sql
from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.functions.prices import position_pnl
from sigloft.plans import backtest as plan
from sigloft.plans.exits import first_touch
from sigloft.plans.orders import results_by_ticker
from sigloft.plans.serving import resolved_markets
from sigloft.session import stored

BANKROLL = 1000.0

# -- signal back-test -------------------------------------------------------------------------------------------------
_SIDE_PRICE = "CASE WHEN recommended_side = 'yes' THEN odds ELSE 1 - odds END"
_DAYS = "(CASE WHEN result IS NULL THEN (close_sec - (SELECT anchor FROM briefs_anchor)) / 86400 END)"
_K = kelly_sql("confidence", "entry_price", BANKROLL, "(SELECT n FROM resolved)", _DAYS)
SIGNALS = f"""
best AS (SELECT * FROM briefs WHERE {NAMED} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY confidence DESC, sec DESC, brief_id DESC) = 1),
resolved AS (SELECT count(DISTINCT ticker) AS n FROM results WHERE ticker IN (SELECT ticker FROM briefs)),
staged AS (
  SELECT best.*, {_SIDE_PRICE} AS entry_price, r.result, l.live_bid, l.close_sec,
         CASE WHEN r.result IS NOT NULL THEN CASE WHEN r.result = recommended_side THEN 'WIN' ELSE 'LOSS' END WHEN live_bid IS NOT NULL THEN 'OPEN' ELSE 'UNKNOWN' END AS outcome
  FROM best LEFT JOIN results r USING (ticker) LEFT JOIN live l USING (ticker)),
sized AS (
  SELECT *, {_K['edge']} AS edge, {_K['fraction']} AS fraction, {_K['bet']} AS bet, {theme_sql('ticker', 'title')} AS theme,
         CASE WHEN outcome = 'WIN' THEN 1 - entry_price WHEN outcome = 'LOSS' THEN -entry_price
              WHEN outcome = 'OPEN' THEN CASE WHEN recommended_side = 'yes' THEN live_bid ELSE 1 - live_bid END - entry_price END AS per
  FROM staged),
capped AS (
  SELECT *, greatest(0, least(round(bet * 100), 8000 - prior)) / 100 AS capped_bet FROM (
    SELECT *, coalesce(sum(round(bet * 100)) OVER (PARTITION BY theme ORDER BY bet DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM sized)),
simulated AS (
  SELECT *, {fx("floor((CASE WHEN fraction > 0 THEN capped_bet ELSE 10 END) / entry_price) * per", 2)} AS sim_pnl FROM capped)"""


def best_briefs(spark, sf):
    return plan.best_brief(plan.usable_briefs(v.briefs(spark, sf)), ["ticker"])


def simulated(spark, sf, current_gates: bool = False):
    results = results_by_ticker(v.settled(spark, sf))
    resolved = resolved_markets(results, v.briefs(spark, sf)).scalar()
    return plan.signal_backtest(best_briefs(spark, sf), results, v.live(spark, sf), BANKROLL, resolved, v.briefs_anchor(spark, sf),
                                current_gates)


@query("signal_backtest", with_ctes(f"""
SELECT ticker, brief_id, outcome, entry_price, edge AS kelly_edge, fraction AS kelly_fraction, theme, capped_bet,
       {fx('per')} AS pnl_per_contract, sim_pnl FROM simulated""", v.BRIEFS, v.SETTLED, SIGNALS))
def signal_backtest(spark, sf):
    """One brief per market: outcome, size under theme caps, simulated P&L."""
    return simulated(spark, sf).select(
        "ticker", "brief_id", "outcome", "entry_price", "kelly_edge", "kelly_fraction", "theme", "capped_bet",
        fixed("pnl_per_contract", 4).alias("pnl_per_contract"), "sim_pnl",
    )


_GATED = SIGNALS.replace("FROM best LEFT JOIN", f"FROM (SELECT * FROM best WHERE odds BETWEEN 0.25 AND 0.75 AND confidence >= {_SIDE_PRICE} + 0.10::DOUBLE) best LEFT JOIN")


@query("gated_backtest", with_ctes(f"""
SELECT ticker, brief_id, outcome, entry_price, edge AS kelly_edge, fraction AS kelly_fraction, theme, capped_bet,
       {fx('per')} AS pnl_per_contract, sim_pnl FROM simulated""", v.BRIEFS, v.SETTLED, _GATED))
def gated_backtest(spark, sf):
    """The same back-test over briefs that today's price band and edge would let through."""
    rows = simulated(spark, sf, current_gates=True)
    return rows.select("ticker", "brief_id", "outcome", "entry_price", "kelly_edge", "kelly_fraction", "theme", "capped_bet",
                       fixed("pnl_per_contract", 4).alias("pnl_per_contract"), "sim_pnl")


_SUM = lambda e: fx(f"coalesce(sum({e}), 0)", 2)


@query("backtest_stats", with_ctes(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE outcome IN ('WIN', 'LOSS')) AS resolved, count(*) FILTER (WHERE outcome = 'WIN') AS wins,
       count(*) FILTER (WHERE outcome = 'LOSS') AS losses, count(*) FILTER (WHERE outcome = 'OPEN') AS open, count(*) FILTER (WHERE outcome = 'UNKNOWN') AS unknown,
       {fx("count(*) FILTER (WHERE outcome = 'WIN') / nullif(count(*) FILTER (WHERE outcome IN ('WIN', 'LOSS')), 0)")} AS hit_rate,
       {_SUM('sim_pnl')} AS sim_total_pnl, {_SUM("CASE WHEN outcome = 'OPEN' THEN sim_pnl END")} AS sim_open_pnl,
       {_SUM("CASE WHEN outcome IN ('WIN', 'LOSS') THEN sim_pnl END")} AS sim_resolved_pnl FROM simulated""", v.BRIEFS, v.SETTLED, SIGNALS))
def backtest_stats(spark, sf):
    return plan.backtest_stats(simulated(spark, sf))


# -- first touch ------------------------------------------------------------------------------------------------------
_KU = kelly_sql("confidence", "entry_price", BANKROLL, "50")
TRADES = f"""
user_best AS (SELECT *, {_SIDE_PRICE} AS entry_price FROM user_briefs QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY confidence DESC, sec DESC, brief_id DESC) = 1),
all_trades AS (SELECT brief_id AS trade_id, ticker, recommended_side AS side, entry_price, odds, CAST(floor({_KU['bet']} / entry_price) AS BIGINT) AS qty, pos AS entry_pos
  FROM user_best WHERE {_KU['edge']})"""
_NEAR = """
nearest AS (
  SELECT t.trade_id, s.bid FROM all_trades t JOIN ticks s ON s.ticker = t.ticker AND abs(s.pos - t.entry_pos) < 3600000000
  QUALIFY row_number() OVER (PARTITION BY t.trade_id ORDER BY abs(s.pos - t.entry_pos), s.pos) = 1),
trades AS (SELECT t.* FROM all_trades t LEFT JOIN nearest n USING (trade_id) WHERE n.bid IS NULL OR abs(n.bid - t.odds) <= 0.10::DOUBLE)"""


def touch_sql(history: str, forward: bool) -> str:
    gate = "AND s.pos >= t.entry_pos" if forward else ""
    return f"""
walked AS (
  SELECT t.trade_id, s.pos, (CASE WHEN t.side = 'yes' THEN s.bid ELSE 1 - s.ask END - t.entry_price) / t.entry_price AS roi
  FROM trades t JOIN {history} s ON s.ticker = t.ticker {gate}),
hit AS (
  SELECT trade_id, min(pos) AS exit_pos FROM walked WHERE roi >= 0.65::DOUBLE OR roi <= -0.20::DOUBLE GROUP BY trade_id),
hit_kind AS (SELECT h.*, max(roi >= 0.65::DOUBLE) AS won FROM hit h JOIN walked w ON w.trade_id = h.trade_id AND w.pos = h.exit_pos GROUP BY ALL),
peak AS (SELECT w.trade_id, max(roi) AS peak FROM walked w LEFT JOIN hit h USING (trade_id) WHERE h.exit_pos IS NULL OR w.pos <= h.exit_pos GROUP BY 1),
closed AS (
  SELECT t.*, h.exit_pos, p.peak, h.won,
         CASE WHEN h.won THEN 'PROFIT_EXIT' WHEN NOT h.won THEN 'STOP_EXIT' WHEN r.result = t.side THEN 'SETTLED_WIN' WHEN r.result IS NOT NULL THEN 'SETTLED_LOSS' ELSE 'OPEN' END AS outcome,
         CASE WHEN t.side = 'yes' THEN live_bid ELSE 1 - live_ask END AS mark
  FROM trades t LEFT JOIN hit_kind h USING (trade_id) LEFT JOIN peak p USING (trade_id) LEFT JOIN user_settled r ON r.ticker = t.ticker LEFT JOIN user_live l ON l.ticker = t.ticker),
priced AS (
  SELECT *, CASE outcome WHEN 'PROFIT_EXIT' THEN {fx('entry_price * 1.65::DOUBLE')} WHEN 'STOP_EXIT' THEN {fx('entry_price * (1 - 0.20::DOUBLE)')}
         WHEN 'SETTLED_WIN' THEN 1 WHEN 'SETTLED_LOSS' THEN 0 ELSE {fx('mark')} END AS exit_price FROM closed),
paid AS (
  SELECT *, {fx("(CASE outcome WHEN 'OPEN' THEN mark ELSE exit_price END - entry_price) * qty", 2)} AS gross,
         ({fx('0.07::DOUBLE * entry_price * (1 - entry_price)')} + {fx('0.07::DOUBLE * exit_price * (1 - exit_price)')}) * qty AS fees FROM priced)"""


_TOUCH_OUT = f"SELECT trade_id, ticker, side, entry_price, qty, outcome, exit_price, exit_pos, {{pnl}} AS pnl, {fx('greatest(0, coalesce(peak, 0)) * 100', 1)} AS peak_roi_pct FROM paid"
_TOUCH_COLUMNS = ["trade_id", "ticker", "side", "entry_price", "qty", "outcome", "exit_price", "exit_pos", "pnl", "peak_roi_pct"]


def _trades(spark, sf):
    return plan.sized_trades(plan.best_brief(v.user_briefs(spark, sf), ["ticker"]), BANKROLL)


def _history(spark, sf):
    return v.ticks(spark, sf).select("ticker", "pos", "snap_id", "bid", "ask")


def touched(spark, sf):
    return first_touch(_trades(spark, sf), _history(spark, sf), v.user_settled(spark, sf), v.user_live(spark, sf), from_entry=False)


@query("first_touch_exit", with_ctes(_TOUCH_OUT.format(pnl="gross"), v.SNAP, v.USER_BRIEFS, TRADES, "trades AS (SELECT * FROM all_trades)", touch_sql("ticks", False)))
def first_touch_exit(spark, sf):
    """Exits over the whole quote history of each trade's market."""
    return touched(spark, sf).select(*_TOUCH_COLUMNS)


def touched_realistic(spark, sf):
    history = _history(spark, sf)
    fresh = stored(plan.without_stale_entries(_trades(spark, sf), history, 3_600_000_000), "trades")
    return first_touch(fresh, history, v.user_settled(spark, sf), v.user_live(spark, sf), from_entry=True, fees=True)


@query("first_touch_realistic", with_ctes(
    _TOUCH_OUT.format(pnl=f"CASE WHEN qty > 0 THEN {fx('gross - fees', 2)} ELSE gross END"), v.SNAP, v.USER_BRIEFS, TRADES, _NEAR, touch_sql("ticks", True)))
def first_touch_realistic(spark, sf):
    """Only quotes after entry count, stale entries drop out, fees are paid on both sides."""
    return touched_realistic(spark, sf).select(*_TOUCH_COLUMNS)


STATS = f"""
SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'PROFIT_EXIT') AS profit_exits, count(*) FILTER (WHERE outcome = 'STOP_EXIT') AS stop_exits,
       count(*) FILTER (WHERE outcome = 'SETTLED_WIN') AS settled_wins, count(*) FILTER (WHERE outcome = 'SETTLED_LOSS') AS settled_losses,
       count(*) FILTER (WHERE outcome = 'OPEN') AS open, count(*) FILTER (WHERE win) AS wins, count(*) FILTER (WHERE loss) AS losses,
       {fx('count(*) FILTER (WHERE win) / nullif(count(*) FILTER (WHERE win OR loss), 0)')} AS win_rate, {fx('coalesce(sum(gross), 0)', 2)} AS total_pnl,
       coalesce({fx('avg(gross) FILTER (WHERE win)', 2)}, 0) AS avg_win, coalesce({fx('avg(gross) FILTER (WHERE loss)', 2)}, 0) AS avg_loss,
       {fx(f"abs({fx('avg(gross) FILTER (WHERE win)', 2)} / nullif({fx('avg(gross) FILTER (WHERE loss)', 2)}, 0))", 2)} AS reward_risk
FROM (SELECT *, outcome IN ('PROFIT_EXIT', 'SETTLED_WIN') AS win, outcome IN ('STOP_EXIT', 'SETTLED_LOSS') AS loss FROM paid)"""


@query("strategy_stats", with_ctes(STATS, v.SNAP, v.USER_BRIEFS, TRADES, "trades AS (SELECT * FROM all_trades)", touch_sql("ticks", False)))
def strategy_stats(spark, sf):
    return plan.strategy_stats(touched(spark, sf))


# -- upper bound ------------------------------------------------------------------------------------------------------
ORACLE = f"""
trades AS (
  SELECT snap_id AS trade_id, ticker, side, entry_price, bid AS odds, CAST(greatest(1, floor({BANKROLL * fv.TRADE_CAP}::DOUBLE / entry_price)) AS BIGINT) AS qty, pos AS entry_pos FROM (
    SELECT s.*, r.result AS side, CASE WHEN r.result = 'yes' THEN s.bid ELSE 1 - s.ask END AS entry_price
    FROM snap s JOIN user_settled r ON r.ticker = s.ticker WHERE s.bid BETWEEN 0.25 AND 0.75
    QUALIFY row_number() OVER (PARTITION BY s.ticker ORDER BY s.pos, s.snap_id) = 1)
  WHERE entry_price > 0.05::DOUBLE AND entry_price < 0.95::DOUBLE)"""


def oracle_rows(spark, sf):
    snapshots = v.snap(spark, sf).select("ticker", "pos", "snap_id", "bid", "ask")
    return plan.oracle_backtest(snapshots, v.user_settled(spark, sf), BANKROLL)


@query("oracle_upper_bound", with_ctes(_TOUCH_OUT.format(pnl="gross"), v.SNAP, v.USER_BRIEFS, ORACLE, touch_sql("snap", True)))
def oracle_upper_bound(spark, sf):
    """First in-band quote of every settled market, always on the winning side, with the same exits."""
    return oracle_rows(spark, sf).select(*_TOUCH_COLUMNS)


@query("oracle_stats", with_ctes(STATS, v.SNAP, v.USER_BRIEFS, ORACLE, touch_sql("snap", True)))
def oracle_stats(spark, sf):
    return plan.strategy_stats(oracle_rows(spark, sf))


# -- trade metrics ----------------------------------------------------------------------------------------------------
PNL = """
pnls AS (
  SELECT o_orderkey, o_orderdate, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (o_orderkey % 40 + 1)
         * (((613 * o_orderkey) % 1023 + 1) / 1024::DOUBLE - ((7919 * o_orderkey) % 1023 + 1) / 1024::DOUBLE) AS pnl
  FROM orders)"""


def trade_rows(spark, sf):
    """Closed trades, one per order."""
    side = F.when(F.col("o_orderkey") % 2 == 0, "YES").otherwise("NO")
    entry, out = v.hashed("o_orderkey", 7919, 1023, 1) / 1024, v.hashed("o_orderkey", 613, 1023, 1) / 1024
    return v.table(spark, sf, "orders").select(
        "o_orderkey", F.unix_seconds("o_orderdate").alias("sec"), position_pnl(side, entry, out, F.col("o_orderkey") % 40 + 1).alias("pnl")
    )


@query("trade_metrics", with_ctes(f"""
SELECT count(*) AS total_trades, count(*) FILTER (WHERE pnl > 0) AS winning_trades, count(*) FILTER (WHERE pnl < 0) AS losing_trades,
       {fx('count(*) FILTER (WHERE pnl > 0) / count(*)', 6)} AS win_rate, {fx('sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0)', 6)} AS profit_factor,
       sum(pnl) AS total_pnl, {fx('avg(pnl) FILTER (WHERE pnl > 0)', 6)} AS avg_win, {fx('avg(pnl) FILTER (WHERE pnl < 0)', 6)} AS avg_loss FROM pnls""", PNL))
def trade_metrics(spark, sf):
    rows = plan.trade_metrics(trade_rows(spark, sf))
    return rows.withColumns({c: fixed(c, 6) for c in ("win_rate", "profit_factor", "avg_win", "avg_loss")})


@query("sharpe", with_ctes(f"""
SELECT count(*) AS days, {fx('avg(p) / stddev_samp(p) * sqrt(252.0::DOUBLE)', 6)} AS sharpe_ratio FROM (SELECT sum(pnl) AS p FROM pnls GROUP BY o_orderdate)""", PNL))
def sharpe(spark, sf):
    return plan.sharpe(trade_rows(spark, sf), "sec").withColumn("sharpe_ratio", fixed("sharpe_ratio", 6))


@query("max_drawdown", with_ctes(f"""
SELECT min(equity - peak) AS max_drawdown_usd, {fx('min(CASE WHEN peak > 0 THEN (equity - peak) / peak END)', 6)} AS max_drawdown FROM (
  SELECT equity, max(equity) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS peak, o_orderkey FROM (
    SELECT o_orderdate, o_orderkey, sum(pnl) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS equity FROM pnls))""", PNL))
def max_drawdown(spark, sf):
    rows = plan.max_drawdown(trade_rows(spark, sf), "sec", "o_orderkey")
    return rows.withColumn("max_drawdown", fixed("max_drawdown", 6))
