"""Hand-computed cases of the domain rules."""

import pytest
from pyspark.sql import functions as F

from sigloft.functions import prices
from sigloft.functions.text import (
    event_class, first_date, has_theme, pad_code, parse_when, readable, record_sentence, scrub_text, series_theme, side_from_verdict,
    stated_side, unpack_names, unpack_places, verdict_is_usable,
)
from sigloft.plans.candidates import eligible_again
from sigloft.plans.exits import exit_decision, first_touch
from sigloft.plans.lexicon import sentence_sentiment
from sigloft.plans.orders import brief_orders, close_by_hand, resolve_fills, sentiment_orders, settle
from sigloft.plans.sizing import cap_by_theme, kelly_reason, with_kelly


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize("conf,price,resolved,days,bet,share,edge", [
    (0.82, 0.30, 50, None, 50.0, 0.05, True), (0.82, 0.30, 0, None, 10.0, 0.01, True), (0.60, 0.45, 50, None, 10.0, 0.01, True),
    (0.82, 0.30, 50, 3.0, 25.0, 0.025, True), (0.55, 0.60, 50, None, 0.0, 0.0, False), (0.82, 1.0, 50, None, 0.0, 0.0, False),
    (0.0, 0.3, 50, None, 0.0, 0.0, False), (0.82, 0.30, None, None, 50.0, 0.05, True),
])
def test_kelly(spark, conf, price, resolved, days, bet, share, edge):
    df = with_kelly(spark.range(1), F.lit(conf), F.lit(price), 1000.0, resolved, None if days is None else F.lit(days))
    k = df.collect()[0].kelly
    assert (k.suggested_bet_usd, k.capped_fraction, k.edge_detected) == (bet, share, edge)
    reason = df.select(kelly_reason(F.col("kelly"), F.lit(price), 1000.0)).collect()[0][0]
    assert reason


def test_kelly_figures(spark):
    k = with_kelly(spark.range(1), F.lit(0.82), F.lit(0.30), 1000.0, 50).collect()[0].kelly
    assert (k.adjusted_win_prob, k.kelly_fraction, k.quarter_kelly_fraction, list(k.guardrails)) == (0.66, 0.5143, 0.1286, [])
    k = with_kelly(spark.range(1), F.lit(0.60), F.lit(0.45), 1000.0, 5, F.lit(2.0)).collect()[0].kelly
    assert list(k.guardrails) == ["short_dated", "uncalibrated", "low_confidence"]


def test_theme_caps(spark):
    bets = spark.createDataFrame([
        ("KXA-1", "Will Jerome Powell be out?", 50.0), ("KXB-1", "Will Jerome Powell leave the board?", 50.0),
        ("KXC-1", "Will Letitia James be arrested?", 40.0), ("KXD-9", "Other", None)], "ticker string, title string, suggested_bet_usd double")
    got = {r.ticker: (r.theme, r.capped_bet, r.cap_note) for r in cap_by_theme(bets, 1000.0).collect()}
    assert got == {"KXA-1": ("jerome-powell", 50.0, None), "KXB-1": ("jerome-powell", 30.0, "trimmed"),
                   "KXC-1": ("trump-doj", 40.0, None), "KXD-9": ("kxd", 0.0, None)}


def test_theme_fallbacks(spark):
    assert one(spark, series_theme(F.lit("KXW-26"), F.lit(None)), series_theme(F.lit(None).cast("string"), F.lit("x")),
               series_theme(F.lit("a"), F.lit("The FEDERAL reserve and Powell"))) == ("kxw", "untagged", "jerome-powell")


def test_scores(spark):
    score = lambda raw: prices.anchored_score(F.lit(raw).cast("double"))
    at_anchor, pinned, below, none = one(spark, score(9.0), score(16.79), score(16.78), score(None))
    assert (at_anchor, pinned, none) == (80.0, 100.0, 0.0) and 99.9 < below < 100
    raw = prices.raw_score
    assert one(spark, raw(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.0)), raw(F.lit(4.0), F.lit(-0.5), F.lit(-0.25))) == (0.0, 2.5)
    assert one(spark, prices.anchored_score(raw(F.lit(4.0), F.lit(None).cast("double"), F.lit(0.0)))) == 0.0
    assert one(spark, prices.legacy_score(F.lit(10.0), F.lit(0.02)), prices.legacy_score(F.lit(5.0), F.lit(0.60))) == (98.0, 0.0)


def test_spike(spark):
    spike = prices.spike_multiplier
    assert one(spark, spike(F.lit(2), F.lit(864), 10), spike(F.lit(2), F.lit(9), 10), spike(F.lit(1), F.lit(8640), 10)) == (10.0, 0.0, 1.0)


def test_prices(spark):
    yes, no = F.lit("yes"), F.lit("no")
    bid, ask = F.lit(0.40), F.lit(0.46)
    assert one(spark, prices.limit_price(yes, bid, ask), prices.limit_price(no, bid, ask)) == (0.43, 0.57)
    assert one(spark, prices.contracts(10.0, F.lit(0.43)), prices.contracts(10.0, F.lit(0.57)), prices.contracts(1.0, F.lit(5.0))) == (23, 17, 1)
    assert one(spark, prices.fee_per_contract(F.lit(0.5)), prices.change_since(F.lit(0.5), F.lit(0.0)), prices.change_since(F.lit(0.5), F.lit(0.4))) == (
        0.0175, 0.0, pytest.approx(0.25))
    assert one(spark, prices.position_pnl(F.lit("NO"), F.lit(0.5), F.lit(0.25), F.lit(8)), prices.price_before(F.lit(0.5), F.lit(None).cast("double"))) == (2.0, 0.5)
    assert one(spark, prices.decayed(F.lit(0.8), F.lit(24.0))) == pytest.approx(0.64, abs=1e-3)


def _exit(spark, side, entry, bid, ask, hours=None, brief=None, verdict=None):
    d = exit_decision(F.lit(side), F.lit(entry), F.lit(10.0), F.lit(bid), F.lit(ask), F.lit(hours).cast("double"), F.lit(brief).cast("string"),
                      F.lit(verdict).cast("string"))
    r = spark.range(1).select(d.alias("d")).collect()[0].d
    return r.trigger, r.urgency


def test_exit_priority(spark):
    assert _exit(spark, "yes", 0.52, 0.46, 0.48) == ("none", 0)
    assert _exit(spark, "yes", 0.50, 0.39, 0.41, brief="no") == ("stop_loss", 5)
    assert _exit(spark, "yes", 0.50, 0.40, 0.41, brief="no", verdict="Buy NO") == ("thesis_flip", 3)
    assert _exit(spark, "yes", 0.50, 0.40, 0.41, brief="no", verdict="No trade") == ("none", 0)
    assert _exit(spark, "yes", 0.50, 0.83, 0.85) == ("take_profit", 4)
    assert _exit(spark, "yes", 0.80, 0.97, 0.98) == ("profit_lock", 4)
    assert _exit(spark, "no", 0.50, 0.55, 0.58, hours=5.0) == ("none", 0)
    assert _exit(spark, "no", 0.50, 0.51, 0.52, hours=5.0) == ("time_decay", 2)
    assert _exit(spark, "no", 0.50, 0.51, 0.52, hours=25.0) == ("none", 0)


def _touch(spark, quotes, **kw):
    trades = spark.createDataFrame([("t", "m", "yes", 0.5, 10, 0)], "trade_id string, ticker string, side string, entry_price double, qty bigint, entry_pos bigint")
    snaps = spark.createDataFrame([("m", i, b, b + 0.01) for i, b in quotes], "ticker string, pos bigint, bid double, ask double")
    return first_touch(trades, snaps, **kw).collect()[0]


def test_first_touch(spark):
    r = _touch(spark, [(1, 0.55), (2, 0.83), (3, 0.30)])
    assert (r.outcome, r.exit_price, r.exit_pos, r.pnl, r.peak_roi_pct) == ("PROFIT_EXIT", 0.825, 2, 3.25, 66.0)
    r = _touch(spark, [(1, 0.60), (2, 0.39), (3, 0.90)])
    assert (r.outcome, r.exit_price, r.peak_roi_pct) == ("STOP_EXIT", 0.4, 20.0)
    settled = spark.createDataFrame([("m", "no")], "ticker string, result string")
    assert _touch(spark, [(1, 0.51)], settled=settled).outcome == "SETTLED_LOSS"
    assert _touch(spark, [(1, 0.51)]).outcome == "OPEN"
    early = _touch(spark, [(-1, 0.9), (1, 0.51)])
    assert early.outcome == "OPEN" and _touch(spark, [(-1, 0.9), (1, 0.51)], from_entry=False).outcome == "PROFIT_EXIT"


ORDER = "order_id string, arm string, ticker string, side string, count bigint, limit_price double, status string, created_at bigint, filled_price double, filled_at bigint, close_price double, closed_at bigint, close_reason string"


def _orders(spark, side="yes", status="resting"):
    return spark.createDataFrame([("o", "a", "m", side, 23, 0.43, status, 0, None, None, None, None, None)], ORDER)


@pytest.mark.parametrize("quotes,status", [([(10, 0.43)], "filled"), ([(10, 0.44)], "resting"), ([(2881, 0.44)], "expired"),
                                           ([(2880, 0.44)], "resting"), ([(10, 0.44), (2881, 0.43)], "filled"), ([], "resting")])
def test_order_fills(spark, quotes, status):
    ticks = spark.createDataFrame([("m", p, a - 0.01, a) for p, a in quotes], "ticker string, pos bigint, bid double, ask double")
    got = resolve_fills(_orders(spark), ticks, 2880).collect()[0]
    assert got.status == status and (got.filled_price == 0.43) == (status == "filled") and (got.close_reason == "fill_timeout") == (status == "expired")


def test_order_settlement_and_hand_close(spark):
    results = spark.createDataFrame([("m", "No"), ("m", "void")], "ticker string, result string")
    assert [settle(_orders(spark, s, "filled"), results, F.lit(9)).collect()[0].close_reason for s in ("yes", "no")] == ["settled_loss", "settled_win"]
    live = spark.createDataFrame([("m", 0.3, 0.35)], "ticker string, live_bid double, live_ask double")
    done = [close_by_hand(_orders(spark, "no", s), F.lit(True), live, F.lit(9)).collect()[0] for s in ("resting", "filled", "closed")]
    assert [(d.status, d.close_reason, d.close_price) for d in done] == [("expired", "manual_cancel", None), ("closed", "manual_close", 0.65), ("closed", None, None)]


def test_order_placing(spark):
    cands = spark.createDataFrame([("a", 0.40, 0.46, 0.3, 90.0), ("b", 0.40, 0.46, 0.04, 90.0), ("c", 0.46, 0.46, 0.9, 90.0), ("d", 0.40, 0.46, -0.3, 90.0),
                                   ("e", 0.40, 0.46, 0.9, 90.0)], "ticker string, yes_bid double, yes_ask double, sentiment_signal double, mispricing_score double")
    held = spark.createDataFrame([("e", "sentiment", "filled"), ("a", "sentiment", "expired")], "ticker string, arm string, status string")
    got = {r.ticker: (r.side, r.limit_price, r["count"]) for r in sentiment_orders(cands, held, F.lit(1)).collect()}
    assert got == {"a": ("yes", 0.43, 23), "d": ("no", 0.57, 17)}
    briefs = spark.createDataFrame([("a", "NO ", "Buy"), ("b", "yes", "No trade"), ("d", "hold", "x")], "ticker string, recommended_side string, verdict string")
    assert [(r.ticker, r.side) for r in brief_orders(cands, briefs, held, F.lit(1)).collect()] == [("a", "no")]


@pytest.mark.parametrize("price,spike,hours,again", [(0.54, 5.0, 1, False), (0.55, 5.0, 1, True), (0.54, 6.0, 1, True), (0.54, 5.0, 25, True),
                                                     (0.90, 9.0, 0.1, False)])
def test_re_eligibility(spark, price, spike, hours, again):
    rows = spark.createDataFrame([("m", price, spike)], "ticker string, yes_bid double, max_spike_multiplier double")
    anchor = F.timestamp_seconds(F.lit(1_000_000))
    history = spark.createDataFrame([("m", 0.50, 4.0)], "ticker string, last_price double, last_spike double").withColumn(
        "analyzed_at", F.timestamp_seconds(F.lit(int(1_000_000 - hours * 3600))))
    assert (eligible_again(rows, history, anchor).count() == 1) is again
    assert eligible_again(rows, history.where("false"), anchor).count() == 1


def test_lists_and_codes(spark):
    assert one(spark, unpack_names(F.lit("Donald Trump,15;Joe Biden,42"))) == ["Donald Trump", "Joe Biden"]
    assert one(spark, unpack_names(F.lit(";,3;x")), unpack_names(F.lit(None).cast("string"))) == (["x"], None)
    assert one(spark, unpack_places(F.lit("4#Paris, France#FR#1;Rome,3"))) == ["Paris, France", "Rome"]
    assert one(spark, pad_code(F.lit("1")), pad_code(F.lit("043")), pad_code(F.lit("0211"))) == ("01", "043", "0211")
    assert one(spark, *[event_class(F.lit(c)) for c in ("01", "06", "14", "20", "99", "x")]) == ("1", "2", "3", "4", "0", "0")
    assert one(spark, has_theme(F.lit("A,1;WAR_X,2"), ("WAR_",)), has_theme(F.lit("XWAR_"), ("WAR_",)), has_theme(F.lit(None).cast("string"), ("W",))) == (True, False, False)
    names = F.array(*[F.lit(n) for n in ("ann lee", "bo", "c", "d", "e", "f")])
    empty = F.array().cast("array<string>")
    assert one(spark, record_sentence(names, F.array(F.lit("TAX_CUT")), empty, F.lit(1.5))) == "People involved: Ann Lee, Bo, C, D, E. Themes: Tax Cut. Tone: positive"


def test_dates(spark):
    when = lambda s: F.unix_seconds(parse_when(F.lit(s)))
    got = one(spark, when("2026-05-01T10:00:00+02:00"), when("2026-05-01 10:00:00"), when("Fri, 01 May 2026 10:00:00 GMT"),
              when("Friday, 1 May 2026 10:00:00 -0500"), when("May 1, 2026"), when("1 May 2026 10:00:00 EST"), when("soon"))
    base = 1777629600
    assert got == (base - 7200, base, base, base + 18000, base - 36000, base, None)
    assert one(spark, F.unix_seconds(first_date(F.lit("bad"), F.lit(" "), F.lit("2026-05-01 10:00:00")))) == base
    assert one(spark, scrub_text(F.lit(" NaN ")), scrub_text(F.lit("none")), scrub_text(F.lit("n"))) == (None, None, "n")


def test_verdicts(spark):
    usable = [verdict_is_usable(F.lit(t)) for t in ("Buy YES now", "GHOST PUMP: x", "An Error here", " No Trade ", "short", "Neutral")]
    assert one(spark, *usable) == (True, False, False, False, False, False)
    assert one(spark, side_from_verdict(F.lit("we Buy NO"), F.lit(0.1)), side_from_verdict(F.lit("x"), F.lit(-0.06)), side_from_verdict(F.lit(None), F.lit(None).cast("double"))) == ("no", "no", "yes")
    assert one(spark, stated_side(F.lit(" YES"), F.lit("buy no")), stated_side(F.lit("?"), F.lit("Buy No")), stated_side(F.lit(None).cast("string"), F.lit("wait"))) == ("yes", "no", None)


@pytest.mark.parametrize("text,flat", [
    ("plain", "plain"), ('{"reason": {"text": "deep"}}', "deep"), ('{"direction": "up", "n": 3, "e": ""}', "[UP] 3"), ('["a", {"content": "b"}]', "a b"),
    ("{broken", "{broken"), ('{"verdict": "[1, 2]"}', "1 2"), ('{"x": null, "y": true}', "None True"),
    ('{"zeta": "1st", "alpha": {"y": "2nd", "x": "3rd"}}', "1st 2nd 3rd"), ('["a", "", "b"]', "a  b"), ('[{"n": ""}, [], "b"]', "  b"), ("[]", ""), ("{}", ""),
    ('{"a": [], "b": "c"}', "c"), ('{"text": "[{\\"reason\\": \\"in a string\\"}, 2]"}', "in a string 2"), ('{"text": "[not json"}', "[not json"), (" \n[1.5]", "1.5"),
    ('{"sentiment": true, "strength": "weak"}', "[TRUE] [WEAK]"), ("[" * 40 + '"deep"' + "]" * 40, "deep"), ('["' + "é{" * 30 + '"]', "é{" * 30), (None, None), ("", ""),
])
def test_flatten(spark, text, flat):
    assert spark.createDataFrame([(text,)], "t string").select(readable(F.col("t"))).collect()[0][0] == flat


def test_flatten_has_no_python_worker(spark):
    long = "[" + ",".join('{"text": "w%d"}' % i for i in range(3000)) + "]"
    df = spark.createDataFrame([(long,)], "t string").select(readable(F.col("t")).alias("flat"))
    assert df.first().flat == " ".join(f"w{i}" for i in range(3000))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


_VALENCES = {"good": 1.9, "great": 3.1, "bad": -2.5, "kind": 2.4, "least": 0.5}


@pytest.mark.parametrize("text,total", [
    ("The book was good.", 1.9), ("The book was very good", 1.9 + 0.293), ("The book was only kinda good", 1.9 - 0.293), ("not good", 1.9 * -0.74), ("isn't very good", (1.9 + 0.293) * -0.74),
    ("very bad", -2.5 - 0.293), ("very, truly good", 1.9 + 0.293 * 0.95), ("very, it is good", 1.9 + 0.293 * 0.9), ("very, as it is good", 1.9), ("GOOD book", 1.9 + 0.733), ("GOOD", 1.9),
    ("a BAD, VERY BAD book", -2.5 - 0.733 + (-2.5 - 0.733 - 0.293 - 0.733)), ("good but bad", 1.9 * 0.5 - 2.5 * 1.5), ("never so good", 1.9 * 1.25 + 0.293 * 1.25), ("without a doubt good", 1.9),
    ("good!!", 1.9 + 0.584), ("bad!!!!!!", -2.5 - 4 * 0.292), ("good??", 1.9 + 0.36), ("good????", 1.9 + 0.96), ("good?", 1.9), ("not kind good", 2.4 * -0.74 + 1.9 * -0.74), ("", 0), ("!!", 0), ("words", 0),
    (None, 0), ("at least good", 0.5 + 1.9), ("not, not good", 1.9 * 0.74 * 0.74),
])
def test_sentence_rules_by_hand(spark, text, total):
    lexicon = spark.createDataFrame(list(_VALENCES.items()), "word string, valence double")
    got = sentence_sentiment(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", lexicon).first()
    assert got.sentiment_score == pytest.approx(total / (total * total + 15) ** 0.5, abs=1e-6)


def test_least_denies(spark):
    lexicon = spark.createDataFrame([("good", 1.9)], "word string, valence double")
    texts = spark.createDataFrame([(1, "least good"), (2, "at least good"), (3, "the least good")], "id int, text string")
    got = {r.id: r.sentiment_label for r in sentence_sentiment(texts, "id", "text", lexicon).collect()}
    assert got == {1: "Negative", 2: "Positive", 3: "Negative"}


def test_only_numbers_of_list_words_travel(spark):
    lexicon = spark.createDataFrame(list(_VALENCES.items()), "word string, valence double")
    texts = spark.createDataFrame([(1, " NEVER so\tGOOD, never this bad \n"), (2, " \n"), (3, "but GOOD"), (4, "ok, -so- good :)")], "id int, text string")
    scored = sentence_sentiment(texts, "id", "text", lexicon)
    want = {1: (1.9 + 0.733 + 0.293) * 1.25 + -2.5 * 1.25, 2: 0, 3: (1.9 + 0.733) * 1.5, 4: 1.9}  # "so" raises, "-so-" is kept with its signs
    assert {r.id: r.sentiment_score for r in scored.collect()} == {k: pytest.approx(x / (x * x + 15) ** 0.5, abs=1e-6) for k, x in want.items()}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    met = plan[plan.index("Window [") : plan.index("Join Inner")]
    assert "_b1" in met and not any(f"_w{k}" in met for k in range(4))
    assert "size(split(" not in plan  # texts are not split once more to see whether they have words
