"""Operators with their size limits set so low that every key is split, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloft.operators.allocate import capped_allocation
from sigloft.operators.asof import asof_join, asof_offsets, interval_join
from sigloft.operators.contains import contains_join
from sigloft.operators.keyed import dedup_keeping_null_keys, duplicate_report, last_known_values, top_per_key
from sigloft.operators.ordered import drawdown_curve, in_slots, lag_rows, running
from sigloft.operators.vector_index import build_index, calibrated_probes, indexed_nearest, probed_lists, remaining_lists
from sigloft.operators.vectors import nearest_documents
from sigloft.session import shared_folder
from sigloft.operators.velocity import mention_velocity
from sigloft.plans.exits import first_hits, first_touch, quote_blocks


@pytest.fixture(scope="module")
def ticks():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rng.choice("abc")
        rows.append((key, rng.randrange(0, 400), i, rng.randrange(1, 65) / 64))
    return pd.DataFrame(rows, columns=["k", "t", "id", "x"])


def _sizes(df, slots):
    got = in_slots(df, ["k"], [F.col("t"), F.col("id")], slots).toPandas().sort_values(["k", "t", "id"])
    assert got._slot.is_monotonic_increasing and len(got) == df.count()
    return got.groupby("_slot").size()


@pytest.mark.parametrize("moment", ["id % 2", "id + 500000"])
def test_slots_follow_the_data(spark, moment):
    """200,000 rows of one key at two instants, or at as many in a row, beside one row far before and one far after."""
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), F.expr(moment).alias("t"), "id")
    far = spark.createDataFrame([("hot", -10**12, -1), ("hot", 10**12, -2), ("a", 1, -3), ("z", 1, -4)], "k string, t bigint, id bigint")
    sizes = _sizes(rows.union(far), 40)
    assert len(sizes) > 20 and sizes.max() <= 4 * 200_000 / 40


@pytest.mark.parametrize("limit", [30, 1])
def test_running(spark, ticks, limit):
    got = running(spark.createDataFrame(ticks), ["k"], [F.col("t"), F.col("id")],
                  sums={"total": F.col("x"), "n": F.lit(1)}, maxes={"top": F.col("x")}, slots=limit).toPandas()
    want = ticks.sort_values(["k", "t", "id"])
    want["total"], want["n"], want["top"] = want.groupby("k").x.cumsum(), want.groupby("k").cumcount() + 1, want.groupby("k").x.cummax()
    pd.testing.assert_frame_equal(
        got.sort_values("id")[["id", "total", "n", "top"]].reset_index(drop=True),
        want.sort_values("id")[["id", "total", "n", "top"]].reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("limit", [30, 1])
def test_drawdown(spark, limit):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"t": rng.integers(0, 50, 400), "id": range(400), "pnl": rng.integers(-64, 60, 400) / 64.0})
    got = drawdown_curve(spark.createDataFrame(rows), [F.col("t"), F.col("id")], "pnl", limit).toPandas().sort_values(["t", "id"])
    equity = rows.sort_values(["t", "id"]).pnl.cumsum().to_numpy()
    assert np.array_equal(got.equity.to_numpy(), equity) and np.array_equal(got.peak.to_numpy(), np.maximum.accumulate(equity))


@pytest.mark.parametrize("limit", [20, 10_000])
def test_lag_rows(spark, ticks, limit):
    got = lag_rows(spark.createDataFrame(ticks), ["k"], [F.col("t"), F.col("id")], "x", {"p1": 1, "p7": 7}, slots=12, chunk_rows=limit).toPandas()
    want = ticks.sort_values(["k", "t", "id"])
    want["p1"], want["p7"] = want.groupby("k").x.shift(1), want.groupby("k").x.shift(7)
    pd.testing.assert_frame_equal(got.sort_values("id")[["id", "p1", "p7"]].reset_index(drop=True),
                                  want.sort_values("id")[["id", "p1", "p7"]].reset_index(drop=True))


def _brute_asof(left, right, direction, tolerance):
    out = {}
    for l in left.itertuples():
        r = right[right.k == l.k]
        best = None
        for m in r.itertuples():
            if direction == "backward" and m.t > l.t or direction == "forward" and m.t < l.t:
                continue
            if tolerance is not None and abs(m.t - l.t) > tolerance:
                continue
            rank = (abs(m.t - l.t), m.t, -m.id if m.t <= l.t and direction != "forward" else m.id)
            if best is None or rank < best[0]:
                best = (rank, m.id)
        out[l.id] = best[1] if best else None
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("limit,tolerance", [(30, None), (30, 3), (1, 3)])
def test_asof(spark, ticks, direction, limit, tolerance):
    left, right = ticks[ticks.id % 4 == 0], ticks[(ticks.id % 4 != 0) & (ticks.t % 5 != 0)]
    marks = spark.createDataFrame(right).withColumn("m", F.col("id"))
    got = asof_join(spark.createDataFrame(left), marks, ["k"], "t", "t", "m", ["m"], tolerance, direction, limit).toPandas()
    want = _brute_asof(left, right, direction, tolerance)
    assert {r.id: (None if pd.isna(r.m) else int(r.m)) for r in got.itertuples()} == want


def test_asof_offsets(spark, ticks):
    left, right = ticks[ticks.id % 4 == 0], ticks[ticks.id % 4 != 0]
    marks = spark.createDataFrame(right).select("k", "t", F.col("id").alias("rid"), F.col("x").alias("v"))
    got = asof_offsets(spark.createDataFrame(left), marks, ["k"], "id", "t", "t", "rid", "v", {"now": 0, "later": 40}, slots=30).toPandas()
    values = dict(zip(right.id, right.x))
    for name, by in (("now", 0), ("later", 40)):
        want = _brute_asof(left.assign(t=left.t + by), right, "backward", None)
        assert {r.id: None if pd.isna(getattr(r, name)) else getattr(r, name) for r in got.itertuples()} == {
            i: values.get(m) for i, m in want.items()}


def test_interval_join(spark):
    points = spark.createDataFrame([(i, i * 7 % 50) for i in range(60)], "id int, t bigint")
    spans = spark.createDataFrame([(s,) for s in (0, 5, 13, 44)], "s bigint")
    got = {(r.id, r.s) for r in interval_join(points, spans, "t", "s", 6).collect()}
    assert got == {(i, s) for i in range(60) for s in (0, 5, 13, 44) if s <= i * 7 % 50 <= s + 6}


def test_contains_join_finds_all_substrings_and_nothing_else(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 30))) for i in range(40)]
    names = [word(n) for n in (1, 2, 3, 4, 4, 5, 6, 7, 9) for _ in range(4)] + ["", "zzz"]
    got = contains_join(spark.createDataFrame(texts, "i int, text string"), ["i"], "text", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    assert {(r.i, r.n) for r in got.collect()} == {(i, n) for i, t in texts for n in names if n and n in t}
    long = contains_join(spark.createDataFrame(texts, "i int, text string"), ["i"], "text", spark.createDataFrame([(n,) for n in names], "n string"), "n", shortest=4)
    assert {(r.i, r.n) for r in long.collect()} == {(i, n) for i, t in texts for n in names if len(n) >= 4 and n in t}


def test_contains_join_respects_the_group(spark):
    texts = spark.createDataFrame([("x", 1, "abcd"), ("y", 2, "abcd")], "g string, i int, text string")
    names = spark.createDataFrame([("x", "bc"), ("y", "zz")], "g string, n string")
    assert [(r.g, r.i, r.n) for r in contains_join(texts, ["i"], "text", names, "n", on=["g"]).collect()] == [("x", 1, "bc")]


def test_capped_allocation_equals_the_greedy_walk(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["t", "t", "u", "v"]), rng.choice([10.0, 10.0, 10.0, 50.0, 33.33, 0.0, 7.01, None])) for i in range(400)]
    got = {r.id: r.allocated for r in capped_allocation(spark.createDataFrame(rows, "id bigint, g string, bet double"), "g", "bet", "id", 80.0).collect()}
    left, want = {}, {}
    for i, g, bet in sorted(rows, key=lambda r: (-(r[2] or 0), r[0])):
        grant = round(min(bet or 0, max(0, left.get(g, 80.0))), 2)
        left[g] = round(left.get(g, 80.0) - grant, 2)
        want[i] = grant
    assert got == want


def test_capped_allocation_with_one_very_common_amount(spark):
    rows = spark.range(5000).select("id", F.lit("t").alias("g"), F.lit(10.0).alias("bet"))
    got = capped_allocation(rows, "g", "bet", "id", 80.0).where("allocated > 0").collect()
    assert sorted(r.id for r in got) == list(range(8)) and {r.allocated for r in got} == {10.0}


@pytest.mark.parametrize("window", [None, 50])
def test_nearest_documents_in_small_blocks(spark, window):
    rng = np.random.default_rng(5)
    docs = [("news" if i % 2 else "rec", i, int(rng.integers(0, 300)), rng.normal(size=6).tolist()) for i in range(90)]
    asks = [(1000 + i, int(rng.integers(0, 300)), rng.normal(size=6).tolist()) for i in range(12)]
    got = nearest_documents(
        spark.createDataFrame(asks, "query_id bigint, as_of bigint, vector array<double>"),
        spark.createDataFrame(docs, "collection string, doc_id bigint, doc_time bigint, vector array<double>"), 3, window, 7, 4).collect()
    want = set()
    for q, t, vec in asks:
        for name in ("news", "rec"):
            usable = [(1 - np.dot(vec, d[3]) / np.linalg.norm(vec) / np.linalg.norm(d[3]), d[1]) for d in docs
                      if d[0] == name and (window is None or t - window <= d[2] <= t)]
            want |= {(q, name, i) for _, i in sorted(usable)[:3]}
    assert {(r.query_id, r.collection, r.doc_id) for r in got} == want


def test_velocity_frames_include_their_lower_bound(spark):
    rows = [("a", s, "l", 1.0) for s in (0, 900, 1801)] + [("a", -9_000_000, "l", 5.0), ("old", -9_000_000, "l", 1.0)]
    got = mention_velocity(spark.createDataFrame(rows, "k string, s bigint, link string, tone double"), ["k"], "s", "link", "tone", F.lit(0), 3).collect()
    assert [(r.k, r.vol_15m, r.vol_24h, r.vol_90d, r.tone_24h) for r in got] == [("a", 2, 3, 4, 1.0)]


def test_top_per_key_is_cut_before_the_shuffle(spark):
    df = top_per_key(spark.range(1000).withColumn("k", F.col("id") % 2), ["k"], [F.col("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_keyed_helpers(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), (None, 4, 1.0), (None, 5, 2.0)], "k string, t int, x double")
    assert last_known_values(df.where("k is not null"), ["k"], ["t"], ["x"]).collect()[0].x == 5.0
    assert sorted(r.t for r in dedup_keeping_null_keys(df, "k", "t").collect()) == [3, 4, 5]
    report = duplicate_report(df.where("k is not null"), ["k"], "t").collect()[0]
    assert (report.total_rows, report.distinct_keys, report.distinct_key_times, round(report.duplicate_pct, 2)) == (3, 1, 3, 66.67)


def _brute_touch(trades, quotes, from_entry):
    out = {}
    for t in trades.itertuples():
        peak, hit = None, None
        for q in quotes[quotes.ticker == t.ticker].sort_values("pos").itertuples():
            if from_entry and q.pos < t.entry_pos:
                continue
            back = ((q.bid if t.side == "yes" else 1 - q.ask) - t.entry_price) / t.entry_price
            peak = back if peak is None else max(peak, back)
            if back >= 0.5 or back <= -0.5:
                hit = (q.pos, "PROFIT_EXIT" if back >= 0.5 else "STOP_EXIT")
                break
        out[t.trade_id] = (hit, peak)
    return out


@pytest.mark.parametrize("from_entry", [True, False])
@pytest.mark.parametrize("width", [50, 100_000])
def test_first_touch_of_one_market_with_most_trades_and_quotes(spark, from_entry, width):
    rng = np.random.default_rng(4)
    level = np.clip(512 + np.cumsum(rng.integers(-9, 10, 3000)), 40, 980)
    quotes = pd.DataFrame({"ticker": ["hot" if i % 10 else "cold" for i in range(3000)], "pos": np.arange(3000) * 3, "bid": level / 1024, "ask": (level + 20) / 1024})
    trades = pd.DataFrame({"trade_id": range(120), "ticker": ["hot" if i % 6 else "cold" for i in range(120)], "side": ["yes" if i % 2 else "no" for i in range(120)],
                           "entry_price": rng.integers(200, 800, 120) / 1024, "entry_pos": rng.integers(0, 9000, 120), "qty": 1})
    t, q = spark.createDataFrame(trades), spark.createDataFrame(quotes)
    got = {r.trade_id: ((r.exit_pos, r._kind) if r._kind else None, r._peak) for r in first_hits(t, q, 0.5, 0.5, from_entry, width).collect()}
    want = {k: x for k, x in _brute_touch(trades, quotes, from_entry).items() if x != (None, None)}
    assert got == want and len({x[0] and x[0][1] for x in want.values()}) == 3
    done = first_touch(t, q, take_profit=0.5, stop_loss=0.5, from_entry=from_entry, width=width)
    assert {r.trade_id: r.exit_pos for r in done.collect()} == {i: want.get(i, (None, None))[0] and want[i][0][0] for i in trades.trade_id}
    assert quote_blocks(q, 50).count() > 150


def test_first_touch_opens_two_blocks_of_a_trade(spark):
    """Of 100,000 quotes of one market each trade meets those of its entry's block and of the first that crosses."""
    quotes = spark.range(100_000).select(F.lit("hot").alias("ticker"), F.col("id").alias("pos"), F.when(F.col("id") == 70_007, 0.9).otherwise(0.5).alias("bid"),
                                         F.lit(0.95).alias("ask"))
    trades = spark.range(40).select(F.col("id").alias("trade_id"), F.lit("hot").alias("ticker"), F.lit("yes").alias("side"), F.lit(0.5).alias("entry_price"),
                                    (F.col("id") * 1000).alias("entry_pos"))
    hits = first_hits(trades, quotes, 0.5, 0.5, True, 100)
    assert [tuple(r) for r in hits.select("exit_pos", "_kind", "_peak").distinct().collect()] == [(70_007, "PROFIT_EXIT", 0.8)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        opened = first_hits(trades, quotes, 0.5, 0.5, True, 100)
        opened.collect()
        met = []
        todo = [opened._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows") and "pos" in node.output().toString() and "block" in node.output().toString():
                met.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert met and max(met) <= 40 * 2 * 100


@pytest.mark.parametrize("window", [None, 400])
def test_vector_index(spark, window):
    """3,000 vectors around 60 directions and 200 anywhere: probing 6 of 50 lists finds 95 %, completing finds all and leaves lists out."""
    rng = np.random.default_rng(6)
    around = rng.normal(size=(60, 16))
    points = np.vstack([around[rng.integers(0, 60, 3000)] + rng.normal(scale=0.15, size=(3000, 16)), rng.normal(size=(200, 16)), np.zeros((2, 16))])
    docs = spark.createDataFrame([("news" if i % 3 else "rec", i, int(rng.integers(0, 1000)), x.tolist()) for i, x in enumerate(points)] + [("rec", 9999, 5, None)],
                                 "collection string, doc_id bigint, doc_time bigint, vector array<double>")
    asks = spark.createDataFrame([(10_000 + i, 900, (points[i * 50] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(60)],
                                 "query_id bigint, as_of bigint, vector array<double>")
    index = build_index(docs, 50, shared_folder(spark, "ivf"))
    assert index.rows(spark).count() == 3202
    found = lambda df: {(r.query_id, r.collection, r.doc_id) for r in df.collect()}
    exact = found(nearest_documents(asks, docs.where("vector IS NOT NULL"), 5, window))
    assert found(indexed_nearest(index, asks, 5, 1, window, complete=True)) == exact
    probed = indexed_nearest(index, asks, 5, 6, window)
    assert len(found(probed) & exact) >= 0.95 * len(exact)
    sizes = {r["list"]: r["count"] for r in index.rows(spark).groupBy("list").count().collect()}
    met = sum(sizes.get(r._bucket, 0) for r in probed_lists(index, asks, 6).collect())
    assert met <= 0.25 * 60 * 3202
    assert calibrated_probes(index, asks, 5, 0.95, window) <= 6
    if window is None:
        assert remaining_lists(index, asks, probed, 6, 5, 2).count() < 0.8 * 60 * 44
