"""Sizing, exits, ledger and paper orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import candidates, views as v
from sigloft.catalog.backtests import BANKROLL
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.catalog.sqlparts import kelly_sql, theme_sql
from sigloft.functions.numeric import fixed
from sigloft.operators.keyed import latest_per_key, top_per_key
from sigloft.plans import orders as plan
from sigloft.plans.exits import exit_decision, exit_order
from sigloft.plans.ledger import cost_basis as basis, fill_price, position_ledger as build_ledger, positions
from sigloft.plans.sizing import cap_by_theme, with_kelly
from sigloft.session import stored

_LEFT = "(brief_id % 20)"
_KB = kelly_sql("confidence", "price", BANKROLL, "(brief_id % 60)", _LEFT)
_PRICED = "priced_briefs AS (SELECT *, CASE WHEN recommended_side = 'yes' THEN odds ELSE 1 - odds END AS price FROM briefs WHERE recommended_side IS NOT NULL)"


def _sized(spark, sf):
    rows = v.briefs(spark, sf).where(F.col("recommended_side").isNotNull())
    price = F.when(F.col("recommended_side") == "yes", F.col("odds")).otherwise(1 - F.col("odds"))
    return with_kelly(rows, F.col("confidence"), price, BANKROLL, F.col("brief_id") % 60, F.col("brief_id") % 20, "k")


@query("kelly_sizing", with_ctes(f"""
SELECT brief_id, {_KB['edge']} AS edge_detected, {_KB['fraction']} AS kelly_fraction, {_KB['quarter']} AS quarter_kelly_fraction,
       {_KB['capped']} AS capped_fraction, {_KB['bet']} AS suggested_bet_usd, {_KB['win']} AS adjusted_win_prob, {_KB['short']} AS short_dated, {_KB['rails']} AS guardrails
FROM priced_briefs""", v.BRIEFS, _PRICED))
def kelly_sizing(spark, sf):
    """Every brief sized, with all guardrails in play."""
    rows = _sized(spark, sf)
    names = ["edge_detected", "kelly_fraction", "quarter_kelly_fraction", "capped_fraction", "suggested_bet_usd", "adjusted_win_prob", "short_dated"]
    return rows.select("brief_id", *[F.col(f"k.{n}").alias(n) for n in names], F.array_join("k.guardrails", ",").alias("guardrails"))


@query("theme_caps", with_ctes(f"""
SELECT brief_id, theme, suggested_bet_usd, greatest(0, least(round(suggested_bet_usd * 100), 8000 - prior)) / 100 AS capped_bet FROM (
  SELECT *, coalesce(sum(round(suggested_bet_usd * 100)) OVER (PARTITION BY theme ORDER BY suggested_bet_usd DESC, brief_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM (SELECT brief_id, {theme_sql('ticker', 'title')} AS theme, {_KB['bet']} AS suggested_bet_usd FROM priced_briefs))""".replace(_KB["bet"], f"CASE WHEN {_KB['edge']} THEN {_KB['bet']} ELSE 0 END"), v.BRIEFS, _PRICED))
def theme_caps(spark, sf):
    """All sized briefs against the exposure cap of their theme."""
    rows = _sized(spark, sf).withColumn("suggested_bet_usd", F.col("k.suggested_bet_usd"))
    return cap_by_theme(rows, BANKROLL, row_id="brief_id").select("brief_id", "theme", "suggested_bet_usd", "capped_bet")


@query("cost_basis", with_ctes("SELECT ticker, sum(price * count) AS cost_basis, sum(count) AS bought FROM fills WHERE action = 'buy' GROUP BY ticker", v.BRIEFS, v.FILLS))
def cost_basis(spark, sf):
    """Cost per market from fills that carry dollar or cent prices."""
    fills = v.fills(spark, sf)
    in_dollars, yes = F.col("count") % 2 == 0, F.col("side") == "yes"
    shown = lambda hit, value: F.when(hit, value)
    price, cents = F.col("price"), F.col("price") * 100
    landed = fills.withColumns({
        "yes_dollars": shown(yes & in_dollars, price), "no_dollars": shown(~yes & in_dollars, price),
        "yes_cents": shown(yes & ~in_dollars, cents), "no_cents": shown(~yes & ~in_dollars, cents),
    })
    unified = fill_price(F.col("side"), F.col("yes_dollars"), F.col("no_dollars"), F.col("yes_cents"), F.col("no_cents"))
    return basis(landed.withColumn("price", unified))


@query("net_positions", with_ctes("""
SELECT ticker, side, CASE WHEN side = 'yes' THEN sum(count) ELSE -sum(count) END AS position, sum(count * price) AS exposure
FROM fills WHERE action = 'buy' GROUP BY ticker, side HAVING sum(count) <> 0""", v.BRIEFS, v.FILLS))
def net_positions(spark, sf):
    return positions(v.fills(spark, sf))


_TOLERANCE = 90 * 86_400
LEDGER = f"""
held AS (
  SELECT ticker, side, sum(count) AS qty, {fx('sum(price * count) / sum(count)')} AS entry_price, {fx('sum(price * count) / sum(count) * sum(count)')} AS cost_basis, min(pos) AS entry_pos
  FROM fills WHERE action = 'buy' GROUP BY ticker, side),
ledger AS (
  SELECT h.*, b.brief_id, b.confidence, b.odds, b.recommended_side
  FROM held h LEFT JOIN briefs b ON b.ticker = h.ticker AND b.sec <= h.entry_pos AND b.sec >= h.entry_pos - {_TOLERANCE}
  QUALIFY row_number() OVER (PARTITION BY h.ticker, h.side ORDER BY b.sec DESC, b.brief_id DESC) = 1)"""


def ledger_rows(spark, sf):
    marks = v.briefs(spark, sf).select("ticker", F.col("sec").alias("pos"), "brief_id", "confidence", "odds", "recommended_side")
    return build_ledger(v.fills(spark, sf), marks, _TOLERANCE, ["confidence", "odds", "recommended_side"])


@query("position_ledger", with_ctes("SELECT * FROM ledger", v.BRIEFS, v.FILLS, LEDGER))
def position_ledger(spark, sf):
    """One row per position with average cost, first fill and the brief behind it."""
    return ledger_rows(spark, sf)


_YEAR = 365 * 86_400
_GAIN = "(mark - entry_price)"
EXITS = f"""
today AS (
  SELECT ticker, recommended_side AS brief_side, verdict FROM briefs WHERE sec >= (SELECT anchor FROM briefs_anchor) - {_YEAR}
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sec DESC, brief_id DESC) = 1),
marked AS (
  SELECT h.*, t.brief_side, t.verdict, (l.close_sec - (SELECT anchor FROM briefs_anchor)) / 3600 AS hours,
         CASE WHEN h.side = 'yes' THEN live_bid ELSE 1 - live_ask END AS mark
  FROM held h JOIN live l USING (ticker) LEFT JOIN today t USING (ticker)),
graded AS (
  SELECT *, CASE WHEN entry_price > 0 THEN {_GAIN} / entry_price ELSE 0 END AS roi, CASE WHEN entry_price < 1 THEN {_GAIN} / (1 - entry_price) ELSE 0 END AS capture FROM marked),
decided AS (
  SELECT *, CASE WHEN roi >= 0.65::DOUBLE THEN 'take_profit' WHEN roi <= -0.20::DOUBLE THEN 'stop_loss' WHEN capture >= 0.80::DOUBLE THEN 'profit_lock'
    WHEN {_GAIN} <= -0.20::DOUBLE THEN 'absolute_stop' WHEN brief_side IS NOT NULL AND brief_side <> side AND NOT contains(lower(coalesce(verdict, '')), 'no trade') THEN 'thesis_flip'
    WHEN hours > 0 AND hours < 24 AND abs({_GAIN}) < 0.05::DOUBLE THEN 'time_decay' ELSE 'none' END AS trigger FROM graded),
decisions AS (
  SELECT ticker, side, qty, entry_price, trigger, CASE trigger WHEN 'take_profit' THEN 'SELL_PROFIT' WHEN 'profit_lock' THEN 'SELL_PROFIT' WHEN 'stop_loss' THEN 'SELL_LOSS'
    WHEN 'absolute_stop' THEN 'SELL_LOSS' WHEN 'thesis_flip' THEN 'SELL_FLIP' WHEN 'time_decay' THEN 'SELL_TIMEOUT' ELSE 'HOLD' END AS action,
    CASE trigger WHEN 'take_profit' THEN 4::BIGINT WHEN 'profit_lock' THEN 4 WHEN 'stop_loss' THEN 5 WHEN 'absolute_stop' THEN 5 WHEN 'thesis_flip' THEN 3 WHEN 'time_decay' THEN 2 ELSE 0 END AS urgency,
    {fx('mark')} AS suggested_exit_price, {fx(f'{_GAIN} * qty')} AS unrealized_pnl, {fx('capture')} AS capture_pct, {fx('roi')} AS roi_pct FROM decided)"""
_DECISION = ["action", "trigger", "urgency", "suggested_exit_price", "unrealized_pnl", "capture_pct", "roi_pct"]


def decisions(spark, sf, ledger):
    held = ledger.select("ticker", "side", "qty", "entry_price")
    anchor = v.briefs_anchor(spark, sf)
    recent = v.briefs(spark, sf).where(F.col("sec") >= anchor - _YEAR)
    today = latest_per_key(recent, ["ticker"], "sec", "brief_id").select("ticker", F.col("recommended_side").alias("brief_side"), "verdict")
    joined = held.join(v.live(spark, sf), "ticker").join(today, "ticker", "left")
    decision = exit_decision(F.col("side"), F.col("entry_price"), F.col("qty"), F.col("live_bid"), F.col("live_ask"),
                             (F.col("close_sec") - anchor) / 3600, F.col("brief_side"), F.col("verdict"))
    return joined.withColumn("d", decision).select("ticker", "side", "qty", "entry_price", *[F.col(f"d.{c}").alias(c) for c in _DECISION])


@query("exit_decisions", with_ctes("SELECT * FROM decisions", v.BRIEFS, v.SETTLED, v.FILLS, LEDGER, EXITS))
def exit_decisions(spark, sf):
    """Six exit triggers over all open positions with a live quote."""
    return decisions(spark, sf, ledger_rows(spark, sf))


@query("exit_worklist", with_ctes("""
SELECT d.ticker, d.side, d.action, d.urgency, d.unrealized_pnl, l.entry_pos, l.cost_basis, l.brief_id FROM decisions d LEFT JOIN ledger l ON l.ticker = d.ticker AND l.side = d.side
ORDER BY CASE WHEN d.action = 'HOLD' THEN 1 ELSE 0 END, d.urgency DESC, d.unrealized_pnl DESC, d.ticker, d.side""", v.BRIEFS, v.SETTLED, v.FILLS, LEDGER, EXITS))
def exit_worklist(spark, sf):
    """All exits beside their ledger rows, the most pressing first."""
    ledger = stored(ledger_rows(spark, sf), "ledger")
    entries = ledger.select("ticker", "side", "entry_pos", "cost_basis", "brief_id")
    joined = decisions(spark, sf, ledger).join(entries, ["ticker", "side"], "left")
    return joined.orderBy(*exit_order()).select("ticker", "side", "action", "urgency", "unrealized_pnl", "entry_pos", "cost_basis", "brief_id")


# -- paper orders -----------------------------------------------------------------------------------------------------
_AT = 1_000_000
_HELD_SQL = "held_orders AS (SELECT ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'sentiment' ELSE 'brief' END AS arm FROM quotes WHERE o_orderkey % 5 = 0)"
_LIMIT = {s: fx(f"({b}) + 0.5::DOUBLE * (({a}) - ({b}))") for s, b, a in (("yes", "yes_bid", "yes_ask"), ("no", "1 - yes_ask", "1 - yes_bid"))}


def _orders_sql(source: str, arm: str) -> str:
    pick = lambda y, n: f"CASE WHEN side = 'yes' THEN {y} ELSE {n} END"
    return f"""
SELECT ticker, side, limit_price, CAST(greatest(1, floor(10 / limit_price)) AS BIGINT) AS count, {fx(pick('yes_bid', '1 - yes_ask'))} AS entry_bid,
       {fx(pick('yes_ask', '1 - yes_bid'))} AS entry_ask, '{arm}' AS arm FROM (
  SELECT *, {pick(_LIMIT['yes'], _LIMIT['no'])} AS limit_price FROM {source})
WHERE yes_bid > 0 AND yes_bid < yes_ask AND yes_ask < 1 AND limit_price > 0 AND limit_price < 1"""


def _held_orders(spark, sf):
    arm = F.when(F.col("o_orderkey") % 2 == 0, "sentiment").otherwise("brief")
    return v.quotes(spark, sf).where(F.col("o_orderkey") % 5 == 0).select("ticker", arm.alias("arm"), F.lit("resting").alias("status"))


_PLACED = ["ticker", "side", "limit_price", "count", "entry_bid", "entry_ask", "arm"]


@query("place_orders_sentiment", with_ctes(_orders_sql("""(
    SELECT *, CASE WHEN sentiment_signal > 0 THEN 'yes' ELSE 'no' END AS side FROM open_scored
    WHERE abs(sentiment_signal) >= 0.05::DOUBLE AND ticker NOT IN (SELECT ticker FROM held_orders WHERE arm = 'sentiment'))""", "sentiment"),
    v.QUOTES, candidates.OPEN, _HELD_SQL))
def place_orders_sentiment(spark, sf):
    """Resting orders on the side of the sentiment signal."""
    return plan.sentiment_orders(candidates.open_scored(spark, sf), _held_orders(spark, sf), F.lit(_AT)).select(*_PLACED)


_QUOTE_BRIEFS = """quote_briefs AS (
  SELECT ticker, CASE WHEN o_orderkey % 3 = 0 THEN ' YES' WHEN o_orderkey % 3 = 1 THEN 'no' ELSE 'hold' END AS recommended_side,
         CASE WHEN o_orderkey % 7 = 0 THEN 'No trade here' ELSE 'Buy' END AS verdict FROM quotes WHERE o_orderkey % 4 <> 0)"""


@query("place_orders_brief", with_ctes(_orders_sql("""(
    SELECT o.*, lower(trim(b.recommended_side)) AS side FROM open_scored o JOIN quote_briefs b USING (ticker)
    WHERE lower(trim(b.recommended_side)) IN ('yes', 'no') AND NOT contains(lower(b.verdict), 'no trade') AND ticker NOT IN (SELECT ticker FROM held_orders WHERE arm = 'brief'))""", "brief"),
    v.QUOTES, candidates.OPEN, _HELD_SQL, _QUOTE_BRIEFS))
def place_orders_brief(spark, sf):
    """Resting orders on the side of the latest brief."""
    key = F.col("o_orderkey")
    latest = v.quotes(spark, sf).where(key % 4 != 0).select(
        "ticker", F.when(key % 3 == 0, " YES").when(key % 3 == 1, "no").otherwise("hold").alias("recommended_side"),
        F.when(key % 7 == 0, "No trade here").otherwise("Buy").alias("verdict"),
    )
    return plan.brief_orders(candidates.open_scored(spark, sf), latest, _held_orders(spark, sf), F.lit(_AT)).select(*_PLACED)


_TIMEOUT = 2_880 * 60 * 1_000_000
USER_ORDERS = f"""
placed AS (
  SELECT brief_id AS order_id, ticker, user_id, recommended_side AS side, pos AS created_at, CASE WHEN user_id % 2 = 0 THEN 'sentiment' ELSE 'brief' END AS arm,
         {fx("CASE WHEN recommended_side = 'yes' THEN odds ELSE 1 - odds END")} AS limit_price, user_id % 9 + 1 AS count
  FROM user_briefs QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos, brief_id) = 1),
deciding AS (
  SELECT o.order_id, t.pos, CASE WHEN o.side = 'yes' THEN t.ask ELSE 1 - t.bid END AS side_ask FROM placed o JOIN ticks t ON t.ticker = o.ticker AND t.pos > o.created_at
  WHERE CASE WHEN o.side = 'yes' THEN t.ask ELSE 1 - t.bid END <= o.limit_price OR t.pos - o.created_at > {_TIMEOUT}
  QUALIFY row_number() OVER (PARTITION BY o.order_id ORDER BY t.pos) = 1),
resolved_orders AS (
  SELECT o.*, CASE WHEN d.order_id IS NULL THEN 'resting' WHEN side_ask <= limit_price THEN 'filled' ELSE 'expired' END AS status,
         CASE WHEN side_ask <= limit_price THEN {fx('side_ask')} END AS filled_price, CASE WHEN side_ask <= limit_price THEN d.pos END AS filled_at,
         CASE WHEN side_ask > limit_price THEN d.pos END AS closed_at, CASE WHEN side_ask > limit_price THEN 'fill_timeout' END AS close_reason
  FROM placed o LEFT JOIN deciding d USING (order_id)),
settled_orders AS (
  SELECT o.* REPLACE (CASE WHEN done THEN 'closed' ELSE status END AS status, CASE WHEN done THEN CASE WHEN won THEN 'settled_win' ELSE 'settled_loss' END ELSE close_reason END AS close_reason),
         CASE WHEN done THEN CASE WHEN won THEN 1 ELSE 0 END END::DOUBLE AS close_price
  FROM (SELECT r.*, s.result IS NOT NULL AND status = 'filled' AS done, s.result = r.side AS won FROM resolved_orders r LEFT JOIN user_settled s USING (ticker)) o),
order_marks AS (
  SELECT *, CASE status WHEN 'filled' THEN 'OPEN' WHEN 'closed' THEN CASE WHEN contains(close_reason, 'win') THEN 'SETTLED_WIN' ELSE 'SETTLED_LOSS' END ELSE upper(status) END AS shown,
         CASE status WHEN 'closed' THEN close_price WHEN 'expired' THEN NULL ELSE CASE WHEN side = 'yes' THEN live_bid ELSE 1 - live_ask END END AS now,
         coalesce(filled_price, limit_price) AS entry
  FROM settled_orders LEFT JOIN user_live USING (ticker)),
shown_orders AS (SELECT *, CASE WHEN status IN ('filled', 'closed') THEN {fx('(now - filled_price) * count', 2)} END AS pnl FROM order_marks)"""


def resting_orders(spark, sf, per_market: int = 1):
    """The first briefs of each market as resting orders at the price they name."""
    first = top_per_key(v.user_briefs(spark, sf), ["ticker"], [F.col("pos"), F.col("brief_id")], per_market)
    price = F.when(F.col("recommended_side") == "yes", F.col("odds")).otherwise(1 - F.col("odds"))
    return first.select(
        F.col("brief_id").alias("order_id"), F.when(F.col("user_id") % 2 == 0, "sentiment").otherwise("brief").alias("arm"), "ticker",
        F.col("recommended_side").alias("side"), (F.col("user_id") % 9 + 1).alias("count"), fixed(price, 4).alias("limit_price"),
        F.lit("resting").alias("status"), F.col("pos").alias("created_at"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("filled_price", "double"), ("filled_at", "bigint"), ("close_price", "double"),
                                                    ("closed_at", "bigint"), ("close_reason", "string"))],
    )


def resolved_orders(spark, sf):
    quotes = v.ticks(spark, sf).select("ticker", "pos", "bid", "ask")
    return plan.resolve_fills(resting_orders(spark, sf), quotes, _TIMEOUT)


def settled_orders(spark, sf):
    return plan.settle(resolved_orders(spark, sf), v.user_settled(spark, sf), F.lit(_AT).cast("bigint"))


_U = (v.SNAP, v.USER_BRIEFS, USER_ORDERS)


@query("fill_resolution", with_ctes("SELECT order_id, ticker, side, limit_price, status, filled_price, filled_at, closed_at, close_reason FROM resolved_orders", *_U))
def fill_resolution(spark, sf):
    """Resting orders filled, expired or left resting by the quotes after them."""
    return resolved_orders(spark, sf).select("order_id", "ticker", "side", "limit_price", "status", "filled_price", "filled_at", "closed_at", "close_reason")


@query("settle_orders", with_ctes("SELECT order_id, ticker, side, status, filled_price, close_price, close_reason FROM settled_orders", *_U))
def settle_orders(spark, sf):
    return settled_orders(spark, sf).select("order_id", "ticker", "side", "status", "filled_price", "close_price", "close_reason")


def order_marks(spark, sf):
    return plan.open_marks(settled_orders(spark, sf), v.user_live(spark, sf))


@query("open_marks", with_ctes(f"""
SELECT order_id, arm, ticker, side, shown, {fx('now')} AS current_price, pnl, {fx('entry')} AS entry_price, {fx('entry * count', 2)} AS cost_basis,
       CASE WHEN entry > 0 THEN {fx('(now - entry) / entry * 100', 1)} END AS roi_pct FROM shown_orders""", *_U))
def open_marks(spark, sf):
    """Orders with display status, mark and P&L."""
    return order_marks(spark, sf).select("order_id", "arm", "ticker", "side", "shown", "current_price", "pnl", "entry_price", "cost_basis", "roi_pct")


@query("arm_summary", with_ctes(f"""
SELECT arm, count(*) FILTER (WHERE shown IN ('OPEN', 'SETTLED_WIN', 'SETTLED_LOSS')) AS trades, count(*) FILTER (WHERE shown = 'OPEN') AS open,
       count(*) FILTER (WHERE shown = 'RESTING') AS resting, count(*) FILTER (WHERE shown = 'SETTLED_WIN') AS settled_win, count(*) FILTER (WHERE shown = 'SETTLED_LOSS') AS settled_loss,
       count(*) FILTER (WHERE shown = 'EXPIRED') AS expired, {fx("coalesce(sum(pnl) FILTER (WHERE shown = 'OPEN'), 0)", 2)} AS unrealized_pnl,
       {fx("coalesce(sum(pnl) FILTER (WHERE status = 'closed'), 0)", 2)} AS realized_pnl, {fx("coalesce(sum(filled_price * count) FILTER (WHERE pnl IS NOT NULL), 0)", 2)} AS invested,
       {fx("count(*) FILTER (WHERE shown = 'SETTLED_WIN') / nullif(count(*) FILTER (WHERE shown IN ('SETTLED_WIN', 'SETTLED_LOSS')), 0)", 3)} AS win_rate
FROM shown_orders GROUP BY arm""", *_U))
def arm_summary(spark, sf):
    return plan.arm_summary(order_marks(spark, sf))


@query("close_by_hand", with_ctes(f"""
SELECT order_id, CASE WHEN NOT chosen THEN status WHEN status = 'resting' THEN 'expired' WHEN status = 'filled' THEN 'closed' ELSE status END AS status,
       CASE WHEN chosen AND status = 'resting' THEN 'manual_cancel' WHEN chosen AND status = 'filled' THEN 'manual_close' ELSE close_reason END AS close_reason,
       CASE WHEN chosen AND status = 'filled' THEN {fx("coalesce(CASE WHEN side = 'yes' THEN live_bid ELSE 1 - live_ask END, 0)")} END AS close_price
FROM (SELECT *, user_id % 2 = 1 AS chosen FROM resolved_orders) LEFT JOIN user_live USING (ticker)""", *_U))
def close_by_hand(spark, sf):
    """All orders of one arm are closed by hand."""
    closed = plan.close_by_hand(resolved_orders(spark, sf), F.col("arm") == "brief", v.user_live(spark, sf), F.lit(_AT).cast("bigint"))
    return closed.select("order_id", "status", "close_reason", "close_price")


# -- simple paper trades ----------------------------------------------------------------------------------------------
PAPER = f"""
paper AS (SELECT brief_id, ticker, CASE WHEN brief_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side, brief_id % 40 + 1 AS count, odds AS price,
  CASE WHEN brief_id % 10 = 0 THEN sec END AS closed_at FROM briefs),
paper_now AS (
  SELECT p.*, r.result, CASE WHEN r.result IS NOT NULL THEN (r.result = p.side)::INT::DOUBLE WHEN side = 'yes' THEN live_bid ELSE 1 - live_ask END AS now
  FROM paper p LEFT JOIN results r USING (ticker) LEFT JOIN live USING (ticker)),
paper_shown AS (
  SELECT *, CASE WHEN closed_at IS NOT NULL THEN 'CLOSED' WHEN result = side THEN 'SETTLED_WIN' WHEN result IS NOT NULL THEN 'SETTLED_LOSS'
    WHEN (now - price) / price >= 0.65::DOUBLE THEN 'TP_READY' WHEN (now - price) / price <= -0.20::DOUBLE THEN 'SL_HIT' ELSE 'OPEN' END AS shown,
    {fx('(now - price) * count', 2)} AS unrealized_pnl FROM paper_now)"""


def paper_rows(spark, sf):
    key = F.col("brief_id")
    trades = v.briefs(spark, sf).select(
        "brief_id", "ticker", F.when(key % 2 == 0, "yes").otherwise("no").alias("side"), (key % 40 + 1).alias("count"), F.col("odds").alias("price"),
        F.when(key % 10 == 0, F.col("sec")).alias("closed_at"),
    )
    return plan.paper_positions(trades, v.settled(spark, sf), v.live(spark, sf))


_RANK = "CASE shown WHEN 'SL_HIT' THEN 0::BIGINT WHEN 'CLOSED' THEN 1 WHEN 'TP_READY' THEN 2 WHEN 'OPEN' THEN 3 WHEN 'SETTLED_WIN' THEN 4 WHEN 'SETTLED_LOSS' THEN 5 ELSE 9 END"


@query("paper_positions", with_ctes(f"""
SELECT brief_id, ticker, side, shown, {_RANK} AS status_rank, {fx('now')} AS current_price, unrealized_pnl, {fx('count * price', 2)} AS cost_basis,
       {fx('(now - price) / price * 100', 1)} AS roi_pct FROM paper_shown""", v.BRIEFS, v.SETTLED, PAPER))
def paper_positions(spark, sf):
    """Simple trades with result or mark, status and its display rank."""
    return paper_rows(spark, sf).select("brief_id", "ticker", "side", "shown", "status_rank", "current_price", "unrealized_pnl", "cost_basis", "roi_pct")


@query("ranked_positions", with_ctes(f"""
SELECT brief_id, ticker, shown, {_RANK} AS status_rank, unrealized_pnl FROM paper_shown ORDER BY status_rank, unrealized_pnl DESC NULLS LAST, brief_id""", v.BRIEFS, v.SETTLED, PAPER))
def ranked_positions(spark, sf):
    """The simple trades in the order they are shown: by status, the best result first."""
    rows = paper_rows(spark, sf).orderBy("status_rank", F.col("unrealized_pnl").desc_nulls_last(), "brief_id")
    return rows.select("brief_id", "ticker", "shown", "status_rank", "unrealized_pnl")


@query("paper_summary", with_ctes(f"""
SELECT {fx("coalesce(sum(unrealized_pnl) FILTER (WHERE shown <> 'CLOSED'), 0)", 2)} AS total_pnl, """ + ", ".join(
    f"count(*) FILTER (WHERE shown = '{s}') AS {s.lower()}" for s in ("OPEN", "TP_READY", "SL_HIT", "SETTLED_WIN", "SETTLED_LOSS", "CLOSED")
) + " FROM paper_shown", v.BRIEFS, v.SETTLED, PAPER))
def paper_summary(spark, sf):
    return plan.paper_summary(paper_rows(spark, sf))
