"""Read-side views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.backtests import BANKROLL
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.catalog.sqlparts import USABLE, kelly_sql, theme_sql
from sigloft.functions.numeric import fixed
from sigloft.functions.prices import confidence_blend, entry_price
from sigloft.functions.text import answer_fields
from sigloft.operators.keyed import top_per_key
from sigloft.plans import serving as plan
from sigloft.plans.backtest import model_is
from sigloft.plans.orders import results_by_ticker
from sigloft.plans.sizing import with_kelly
from sigloft.sources.schemas import first_present

_SPAN = 400 * 86_400
_KM = kelly_sql("confidence", "side_price", BANKROLL, "(SELECT n FROM resolved)", "((close_sec - (SELECT anchor FROM briefs_anchor)) / 86400)")
VIEW = f"""
resolved AS (SELECT count(DISTINCT ticker) AS n FROM results WHERE ticker IN (SELECT ticker FROM briefs)),
usable AS (
  SELECT * FROM briefs WHERE sec >= (SELECT anchor FROM briefs_anchor) - {_SPAN} AND {USABLE}
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY confidence DESC, sec DESC, brief_id DESC) = 1),
sided AS (
  SELECT *, CASE WHEN contains(lower(verdict), 'buy no') THEN 'no' WHEN contains(lower(verdict), 'buy yes') THEN 'yes' WHEN odds_delta < -0.05::DOUBLE THEN 'no' ELSE 'yes' END AS side
  FROM usable JOIN live USING (ticker)),
edged AS (SELECT * FROM (SELECT *, CASE WHEN side = 'yes' THEN live_bid ELSE 1 - live_bid END AS side_price FROM sided) WHERE confidence >= side_price + 0.10::DOUBLE),
bets AS (SELECT *, {_KM['edge']} AS edge, {_KM['fraction']} AS kelly_fraction, CASE WHEN {_KM['edge']} THEN {_KM['bet']} ELSE 0 END AS bet, {theme_sql('ticker', 'title')} AS theme FROM edged)"""


def resolved(spark, sf):
    return plan.resolved_markets(results_by_ticker(v.settled(spark, sf)), v.briefs(spark, sf))


@query("market_view", with_ctes("""
SELECT ticker, brief_id, side, side_price, edge AS edge_detected, kelly_fraction, bet AS suggested_bet_usd, theme, greatest(0, least(round(bet * 100), 8000 - prior)) / 100 AS capped_bet
FROM (SELECT *, coalesce(sum(round(bet * 100)) OVER (PARTITION BY theme ORDER BY bet DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM bets)""",
    v.BRIEFS, v.SETTLED, VIEW))
def market_view(spark, sf):
    """Usable recent briefs of live markets with side, size and theme cap."""
    anchor = v.briefs_anchor(spark, sf)
    rows = plan.market_view(v.briefs(spark, sf), v.live(spark, sf), anchor - _SPAN, anchor, BANKROLL, resolved(spark, sf).scalar())
    return rows.select("ticker", "brief_id", "side", "side_price", F.col("kelly.edge_detected").alias("edge_detected"),
                       F.col("kelly.kelly_fraction").alias("kelly_fraction"), "suggested_bet_usd", "theme", "capped_bet")


@query("resolved_count", with_ctes("SELECT count(DISTINCT ticker) AS resolved_count FROM results WHERE ticker IN (SELECT ticker FROM briefs)", v.BRIEFS, v.SETTLED))
def resolved_count(spark, sf):
    return resolved(spark, sf)


@query("brief_history", with_ctes(f"""
SELECT ticker, sec // 86400 AS brief_day, brief_id, confidence, verdict FROM briefs
WHERE sec >= (SELECT anchor FROM briefs_anchor) - {_SPAN} AND verdict IS NOT NULL AND NOT contains(verdict, 'Error')
QUALIFY row_number() OVER (PARTITION BY ticker, sec // 86400 ORDER BY confidence DESC, sec DESC, brief_id DESC) = 1""", v.BRIEFS))
def brief_history(spark, sf):
    """One brief per market and day."""
    rows = plan.brief_history(v.briefs(spark, sf), v.briefs_anchor(spark, sf) - _SPAN)
    return rows.select("ticker", "brief_day", "brief_id", "confidence", "verdict")


@query("recent_briefs", with_ctes(f"""
SELECT ticker, brief_id, {fx('confidence * 100', 1)} AS confidence_pct, verdict, sec FROM briefs WHERE contains(ticker, 'C1')
ORDER BY sec DESC, confidence DESC, brief_id LIMIT 5""", v.BRIEFS))
def recent_briefs(spark, sf):
    """The five newest briefs of markets whose ticker contains a text."""
    rows = v.briefs(spark, sf).where(F.col("ticker").contains("C1"))
    top = plan.top_rows(rows, [F.col("sec").desc(), F.col("confidence").desc(), F.col("brief_id")], 5)
    return top.select("ticker", "brief_id", fixed(F.col("confidence") * 100, 1).alias("confidence_pct"), "verdict", "sec")


@query("recent_scores", with_ctes("SELECT snap_id, ticker, bid, sec FROM snap WHERE series = 'S5' ORDER BY sec DESC, snap_id DESC LIMIT 10", v.SNAP))
def recent_scores(spark, sf):
    """The ten newest rows of one series."""
    rows = v.snap(spark, sf).where(F.col("series") == "S5").select("snap_id", "ticker", "bid", "sec")
    return plan.top_rows(rows, [F.col("sec").desc(), F.col("snap_id").desc()], 10)


@query("prediction_history", with_ctes("SELECT ticker, title, odds AS current_price, odds_delta, verdict, confidence, sec AS analyzed_at FROM briefs ORDER BY odds_delta DESC", v.BRIEFS))
def prediction_history(spark, sf):
    """All briefs under their serving names, sorted at read."""
    return v.briefs(spark, sf).select("ticker", "title", F.col("odds").alias("current_price"), "odds_delta", "verdict", "confidence",
                                      F.col("sec").alias("analyzed_at")).orderBy(F.col("odds_delta").desc(), "analyzed_at", "ticker")


_STATUS_SPAN = 7 * 86_400


@query("one_row_status", with_ctes(f"""
SELECT 'S3' AS series, (SELECT max(sec) FROM s) AS latest_snapshot, {fx('(SELECT avg(ask) FROM s) * 100', 1)} AS yes_price_cents,
  (SELECT count(*) FROM a) AS news_articles, {fx('(SELECT avg(sentiment_score) FROM a)', 6)} AS avg_sentiment, (SELECT count(*) FROM t) AS events,
  {fx('(SELECT avg(tone / 100) FROM t)', 6)} AS avg_tone, (SELECT arg_max(bid, snap_id) FROM s WHERE sec = (SELECT max(sec) FROM s)) AS last_bid,
  (SELECT arg_max(verdict, brief_id) FROM b WHERE sec = (SELECT max(sec) FROM b)) AS final_verdict
FROM (SELECT 1)""", v.SNAP, v.ARTICLES, v.TONES, v.BRIEFS,
    f"s AS (SELECT * FROM snap WHERE series = 'S3' AND sec > (SELECT max(sec) FROM snap) - {_STATUS_SPAN})",
    f"a AS (SELECT * FROM articles WHERE contains(lower(title), 'tion') AND sec > (SELECT max(sec) FROM articles) - {_STATUS_SPAN})",
    f"t AS (SELECT * FROM tones WHERE code LIKE '%i%' AND sec > (SELECT max(sec) FROM tones) - {_STATUS_SPAN})",
    "b AS (SELECT * FROM briefs WHERE ticker LIKE '%C3-%' AND verdict IS NOT NULL)"))
def one_row_status(spark, sf):
    """Quotes, news, events, last price and last verdict of one series side by side, each a one-row subquery."""
    def recent(rows):
        return rows.where(F.col("sec") > rows.agg(F.max("sec")).scalar() - _STATUS_SPAN)

    parts = {
        "q": recent(v.snap(spark, sf)).where(F.col("series") == "S3").agg(F.struct(
            F.max("sec").alias("latest_snapshot"), fixed(F.avg("ask") * 100, 1).alias("yes_price_cents"),
            F.max_by("bid", F.struct("sec", "snap_id")).alias("last_bid"))),
        "n": recent(v.articles(spark, sf)).where(F.lower("title").contains("tion")).agg(F.struct(
            F.count("*").alias("news_articles"), fixed(F.avg("sentiment_score"), 6).alias("avg_sentiment"))),
        "e": recent(v.tones(spark, sf)).where(F.col("code").contains("i")).agg(F.struct(
            F.count("*").alias("events"), fixed(F.avg(F.col("tone") / 100), 6).alias("avg_tone"))),
        "b": v.briefs(spark, sf).where(F.col("ticker").contains("C3-") & F.col("verdict").isNotNull()).agg(F.struct(
            F.max_by("verdict", F.struct("sec", "brief_id")).alias("final_verdict"))),
    }
    row = spark.range(1).select(F.lit("S3").alias("series"), *[p.scalar().alias(n) for n, p in parts.items()])
    return row.select("series", *[f"{n}.*" for n in parts])


@query("title_fallback", with_ctes("""
SELECT DISTINCT s.ticker, coalesce(l.title, h.title, s.ticker) AS title, CASE WHEN l.title IS NOT NULL THEN 'latest' WHEN h.title IS NOT NULL THEN 'history' ELSE 'none' END AS found_in
FROM snap s LEFT JOIN (SELECT ticker, 'Now ' || sec AS title FROM (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC, snap_id DESC) = 1) WHERE status = 'open') l USING (ticker)
LEFT JOIN (SELECT ticker, 'Then ' || sec AS title FROM snap WHERE status = 'closed' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC, snap_id DESC) = 1) h USING (ticker)""", v.SNAP))
def title_fallback(spark, sf):
    """Title from the latest open snapshot, else from the newest closed one, else the ticker."""
    rows = v.snap(spark, sf).select("ticker", "pos", "snap_id", "sec", "status")
    newest = top_per_key(rows, ["ticker"], [F.col("pos").desc(), F.col("snap_id").desc()])
    latest = newest.where(F.col("status") == "open").withColumn("title", F.concat(F.lit("Now "), F.col("sec").cast("string")))
    history = rows.withColumn("title", F.when(F.col("status") == "closed", F.concat(F.lit("Then "), F.col("sec").cast("string"))))
    return plan.titles_with_fallback(rows, latest, history, "pos", "snap_id")


@query("column_filters_sort", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
WHERE contains(lower(o_orderpriority), 'urgent') AND contains(lower(o_orderstatus), 'o') AND contains(o_orderkey::VARCHAR, '7')""")
def column_filters_sort(spark, sf):
    """Text filters per column, all of them, and a typed sort."""
    rows = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    wanted = {"o_orderpriority": "URGENT", "o_orderstatus": "o", "o_orderkey": "7", "o_totalprice": ""}
    return plan.text_filters(rows, wanted).orderBy(F.col("o_totalprice").desc(), "o_orderkey")


@query("age_buckets", with_ctes("""
SELECT bucket, shown, count(*) AS briefs FROM (
  SELECT CASE WHEN m <= 180 THEN 'fresh' WHEN m <= 360 THEN 'mid' ELSE 'aged' END AS bucket,
         CASE WHEN contains(lower(coalesce(verdict, '')), 'no trade') THEN 'notrade' ELSE recommended_side END AS shown
  FROM (SELECT *, ((SELECT max(sec) FROM briefs) - sec) / 60 / 24 AS m FROM briefs)) WHERE shown IN ('yes', 'notrade') GROUP BY 1, 2""", v.BRIEFS))
def age_buckets(spark, sf):
    """Briefs by age group and display side (age in units of a day per hour, so that all groups occur)."""
    rows = v.briefs(spark, sf)
    minutes = (rows.agg(F.max("sec")).scalar() - F.col("sec")) / 60 / 24
    tagged = rows.select(plan.age_bucket(minutes).alias("bucket"), plan.shown_side(F.col("recommended_side"), F.col("verdict")).alias("shown"))
    return tagged.where(F.col("shown").isin("yes", "notrade")).groupBy("bucket", "shown").agg(F.count("*").alias("briefs"))


_TOTALS = """
totals AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OPEN' ELSE 'SETTLED' END AS status, ((7919 * o_orderkey) % 1023 + 1) / 1024::DOUBLE * (o_orderkey % 40 + 1) AS cost_basis,
         CASE WHEN o_orderkey % 11 <> 0 THEN ((613 * o_orderkey) % 513 - 256) / 64::DOUBLE END AS pnl FROM orders)"""


@query("dashboard_totals", with_ctes(f"""
SELECT sum(cost_basis) AS invested, sum(p) AS total_pnl, sum(greatest(0, p)) AS won, sum(greatest(0, -p)) AS lost, count(*) FILTER (WHERE p > 0) AS winning, count(*) FILTER (WHERE p < 0) AS losing,
       count(*) FILTER (WHERE status = 'OPEN') AS open, {fx('sum(p) / sum(cost_basis) * 100')} AS pnl_pct, {fx('sum(greatest(0, p)) / sum(cost_basis) * 100')} AS won_pct,
       {fx('sum(greatest(0, -p)) / sum(cost_basis) * 100')} AS lost_pct, {fx('count(*) FILTER (WHERE p > 0) / count(*) FILTER (WHERE p <> 0)')} AS win_rate
FROM (SELECT *, coalesce(pnl, 0) AS p FROM totals)""", _TOTALS))
def dashboard_totals(spark, sf):
    key = F.col("o_orderkey")
    rows = v.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("SETTLED").alias("status"),
        (v.hashed("o_orderkey", 7919, 1023, 1) / 1024 * (key % 40 + 1)).alias("cost_basis"),
        F.when(key % 11 != 0, v.hashed("o_orderkey", 613, 513, -256) / 64).alias("pnl"),
    )
    totals = plan.portfolio_totals(rows)
    return totals.withColumns({c: fixed(c, 4) for c in ("pnl_pct", "won_pct", "lost_pct", "win_rate")})


REPLAY = """
last_brief AS (
  SELECT ticker, arg_max(verdict, sec * 100000000 + brief_id) AS verdict, arg_max(recommended_side, sec * 100000000 + brief_id) AS recommended_side,
         arg_max(odds, sec * 100000000 + brief_id) AS odds FROM briefs GROUP BY ticker),
replays AS (
  SELECT 'C' || (c_custkey % 40) || '-' || c_custkey AS ticker, CASE WHEN c_acctbal < 0 THEN 'No trade' WHEN c_nationkey % 2 = 0 THEN 'Buy YES now' ELSE 'Buy NO now' END AS new_verdict,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'YES' ELSE 'no' END AS new_side, (c_custkey % 101) / 100 AS model_pct FROM customer),
compared AS (
  SELECT ticker, odds, verdict AS old_verdict, recommended_side AS old_side, new_verdict, lower(new_side) AS new_side, model_pct,
         coalesce(recommended_side, '') <> lower(coalesce(new_side, '')) AS changed FROM last_brief JOIN replays USING (ticker))"""


def compared(spark, sf):
    balance, yes = F.col("c_acctbal"), F.col("c_nationkey") % 2 == 0
    replays = v.table(spark, sf, "customer").select(
        v.customer_ticker("c_custkey").alias("ticker"), F.when(balance < 0, "No trade").when(yes, "Buy YES now").otherwise("Buy NO now").alias("new_verdict"),
        F.when(balance < 0, F.lit(None)).when(yes, "YES").otherwise("no").alias("new_side"), (F.col("c_custkey") % 101 / 100).alias("new_confidence"),
    )
    return plan.verdict_replay(v.briefs(spark, sf), replays)


@query("replay_compare", with_ctes(f"""
SELECT ticker, odds, old_verdict, old_side, new_verdict, new_side, changed, {fx('0.6::DOUBLE * model_pct + 0.4::DOUBLE * odds', 6)} AS blended_confidence FROM compared""", v.BRIEFS, REPLAY))
def replay_compare(spark, sf):
    """Last known brief beside its replayed verdict."""
    rows = compared(spark, sf)
    return rows.select("ticker", "odds", "old_verdict", "old_side", "new_verdict", "new_side", "changed",
                       fixed(confidence_blend(F.col("new_confidence"), F.col("odds")), 6).alias("blended_confidence"))


@query("replay_counts", with_ctes("""
SELECT 'old_verdict' AS facet, coalesce(old_verdict[1:8], '') AS value, count(*) AS n FROM compared GROUP BY 2
UNION ALL SELECT 'new_verdict', coalesce(new_verdict[1:8], ''), count(*) FROM compared GROUP BY 2
UNION ALL SELECT 'old_side', coalesce(old_side, ''), count(*) FROM compared GROUP BY 2 UNION ALL SELECT 'new_side', coalesce(new_side, ''), count(*) FROM compared GROUP BY 2
UNION ALL SELECT 'flip', CASE WHEN changed THEN concat_ws('>', old_side, new_side) ELSE 'same' END, count(*) FROM compared GROUP BY 2""", v.BRIEFS, REPLAY))
def replay_counts(spark, sf):
    return plan.replay_counts(compared(spark, sf))


@query("sample_keys", """
SELECT k AS key, count(*) AS rows, count(DISTINCT val) AS distinct_values,
       array_to_string(list_sort(list_distinct(list(val)))[1:2], ',') AS examples
FROM (SELECT 'k' AS k, json_extract_string(props, '$.k') AS val FROM events UNION ALL SELECT 'type', event_type FROM events) GROUP BY 1""")
def sample_keys(spark, sf):
    """Metadata keys with row counts and example values."""
    tags = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return plan.metadata_keys(v.table(spark, sf, "events").select(tags.alias("tags")), "tags")


@query("head_preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def head_preview(spark, sf):
    """The first ten rows of a batch, newest first."""
    rows = v.table(spark, sf, "orders")
    return plan.top_rows(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 10).select("o_orderkey", "o_orderstatus")


@query("optional_column", "SELECT o_orderkey, NULL::DOUBLE AS rag_score, o_orderstatus AS status FROM orders")
def optional_column(spark, sf):
    """A column older files lack is served as a typed null."""


    rows = v.table(spark, sf, "orders")
    return rows.select("o_orderkey", first_present(rows, ["rag_score"], "double").alias("rag_score"), first_present(rows, ["status", "o_orderstatus"]).alias("status"))


@query("model_filter", with_ctes(f"""
SELECT m AS model, count(*) AS briefs, {fx('avg(confidence)', 6)} AS avg_confidence FROM (
  SELECT 'all' AS m, confidence FROM briefs UNION ALL SELECT 'production', confidence FROM briefs WHERE coalesce(replay_model, '') = ''
  UNION ALL SELECT 'model-a', confidence FROM briefs WHERE replay_model = 'model-a') GROUP BY 1""", v.BRIEFS))
def model_filter(spark, sf):
    """Briefs of all models, of the live one and of one replay model, in one pass."""
    wanted = F.array_compact(F.array(*[F.when(model_is(m), m) for m in ("all", "production", "model-a")]))
    rows = v.briefs(spark, sf).select("confidence", F.explode(wanted).alias("model"))
    return rows.groupBy("model").agg(F.count("*").alias("briefs"), fixed(F.avg("confidence"), 6).alias("avg_confidence"))


_KT = kelly_sql("confidence", "price", BANKROLL, "50")


@query("brief_totals", with_ctes(f"""
SELECT count(*) AS briefs, count(*) FILTER (WHERE {_KT['edge']}) AS with_edge, {fx('avg(confidence) * 100', 4)} AS avg_confidence_pct,
       {fx(f"sum(CASE WHEN {_KT['edge']} THEN {_KT['bet']} ELSE 0 END)", 2)} AS total_suggested
FROM (SELECT *, CASE WHEN recommended_side = 'yes' THEN odds ELSE 1 - odds END AS price FROM briefs WHERE recommended_side IS NOT NULL)""", v.BRIEFS))
def brief_totals(spark, sf):
    """Dashboard head line of all briefs with a side."""
    rows = v.briefs(spark, sf).where(F.col("recommended_side").isNotNull())
    sized = with_kelly(rows, F.col("confidence"), entry_price(F.col("recommended_side"), F.col("odds")), BANKROLL, 50)
    return sized.agg(
        F.count("*").alias("briefs"), F.count_if("kelly.edge_detected").alias("with_edge"), fixed(F.avg("confidence") * 100, 4).alias("avg_confidence_pct"),
        fixed(F.sum("kelly.suggested_bet_usd"), 2).alias("total_suggested"),
    )


@query("answer_defaults", """
SELECT conv_id, turn, k NOT IN (4, 5) AS parsed, CASE WHEN k IN (4, 5) THEN 'Error: unreadable answer' WHEN k = 3 THEN '' ELSE role END AS verdict,
       CASE k WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS side, CASE k WHEN 0 THEN (turn % 101) / 100 WHEN 1 THEN 0.72::DOUBLE ELSE 0.5 END AS confidence
FROM (SELECT *, (conv_id + turn) % 6 AS k FROM conversations)""")
def answer_defaults(spark, sf):
    """Model answers read with their defaults: number, text, bad or missing percentage, broken JSON, plain text."""
    k, role = (F.col("conv_id") + F.col("turn")) % 6, F.col("role")
    answer = (
        F.when(k == 0, F.to_json(F.struct(role.alias("verdict"), F.lit("YES ").alias("recommended_side"), (F.col("turn") % 101).alias("confidence_pct"))))
        .when(k == 1, F.to_json(F.struct(role.alias("verdict"), F.lit("no").alias("recommended_side"), F.lit("72").alias("confidence_pct"))))
        .when(k == 2, F.to_json(F.struct(role.alias("verdict"), F.lit("high").alias("confidence_pct"))))
        .when(k == 3, F.lit("{}")).when(k == 4, F.concat(F.lit("{"), role)).otherwise(F.col("text"))
    )
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", answer_fields(answer).alias("a"))
    return rows.select("conv_id", "turn", "a.*")
