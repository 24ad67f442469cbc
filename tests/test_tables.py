"""Versioned tables, landed files and repeated streaming runs."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigloft.operators.keyed import top_per_key
from sigloft.session import shared_folder, stateful_session
from sigloft.sources import landed, schemas, tables
from sigloft.streaming import jobs
from sigloft.streaming.order_state import decide_or_expire, decide_orders


def test_versions_merge_and_vacuum(spark):
    path = shared_folder(spark, "t")
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path)
    row = lambda *r: spark.createDataFrame(list(r), "k string, t int, x string")
    tables.merge(spark, path, row(("a", 1, "old"), ("b", 1, "b"), ("a", 2, "new")), ["k"], ["t"])
    tables.merge(spark, path, row(("a", 1, "batch"), ("c", 1, "c")).withColumn("extra", F.lit(7)), ["k"], ["t"])
    assert {(r.k, r.x, r.extra) for r in tables.read(spark, path).collect()} == {("a", "batch", 7), ("b", "b", None), ("c", "c", 7)}
    tables.update_where(spark, path, F.col("k") == "b", {"x": F.lit("upd")})
    assert tables.read(spark, path).where("k = 'b'").collect()[0].x == "upd"
    assert tables.vacuum(spark, path, keep=1) == ["v=000001", "v=000002"] and tables.read(spark, path).count() == 3


def test_append_once_keeps_late_rows(spark):
    path = shared_folder(spark, "a")
    row = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    for batch in (row(5, 6), row(5, 6), row(1, 6), row(1)):
        tables.append_once(spark, path, batch, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 5, 6]


def test_corrupt_and_latest_files_are_skipped(spark):
    from pathlib import Path

    base = shared_folder(spark, "d")
    spark.createDataFrame([("a", 1)], "ticker string, yes_bid bigint").write.parquet(f"{base}/one")
    spark.createDataFrame([("z", 1)], "ticker string, yes_bid bigint").write.parquet(f"{base}/latest.parquet")
    Path(f"{base}/bad.parquet").write_bytes(b"not parquet")
    got = landed.read_drifting(spark, base, schemas._struct("ticker string, yes_bid double, title string")).collect()
    assert [(r.ticker, r.yes_bid, r.title) for r in got] == [("a", 1.0, None)]
    rejected = landed.drifting_and_rejects(spark, base, schemas._struct("ticker string"))[1]
    assert [(r.path.split("/")[-1], bool(r.error)) for r in rejected.collect()] == [("bad.parquet", True)]
    assert landed.read_drifting(spark, base, schemas._struct("ticker string"), modified_after="2099-01-01T00:00:00").count() == 0


def test_code_lists_keep_one_row_per_code(spark):
    rows = landed.code_list(spark, (("AU", "Australia"), ("US", "United States"), ("AU", "Austria")), "code", "name").collect()
    assert sorted((r.code, r.name) for r in rows) == [("AU", "Australia"), ("US", "United States")]


def test_conform_and_defaults(spark):
    df = spark.createDataFrame([("1.5", 3)], "a string, b int")
    got = schemas.conform(df, schemas._struct("a double, c double, b bigint"), {"c": 0.0}).collect()[0]
    assert tuple(got) == (1.5, 0.0, 3)


def test_records_survive_quotes_and_bad_lines(spark):
    base = shared_folder(spark, "r")
    good = "\t".join(['id"1'] + [f"v{i}" for i in range(26)])
    spark.createDataFrame([(good,), ("too\tfew",)], "value string").coalesce(1).write.text(base)
    rows = landed.read_records(spark, base).where("SOURCEURL is not null").collect()
    assert [(r.GKGRECORDID, r.SOURCEURL) for r in rows] == [('id"1', "v3")]


def test_stream_run_again_adds_nothing_and_takes_new_files(spark):
    base = shared_folder(spark, "s")
    schema = schemas._struct("k string, t bigint")
    land = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run = lambda: jobs.drain_upserts(jobs.open_stream(spark, f"{base}/in", schema), ["k"], ["t"], f"{base}/cur", f"{base}/hist", f"{base}/cp")
    land(("a", 1), ("a", 3), ("b", 2))
    assert {(r.k, r.t) for r in run().collect()} == {("a", 3), ("b", 2)}
    run()
    assert spark.read.parquet(f"{base}/hist").count() == 3
    land(("a", 2), ("c", 1))
    assert {(r.k, r.t) for r in run().collect()} == {("a", 3), ("b", 2), ("c", 1)}
    assert spark.read.parquet(f"{base}/hist").count() == 5


def test_append_once_takes_a_repeat_of_the_batch_once(spark):
    path = shared_folder(spark, "once")
    batch = spark.createDataFrame([(1,), (1,), (2,)], "k bigint")
    for _ in range(2):
        tables.append_once(spark, path, batch, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]


def test_all_orders_of_a_ticker_are_decided(spark):
    base = shared_folder(spark, "orders")
    orders = spark.createDataFrame([("a", "1", "yes", 0.5, 0), ("a", "2", "no", 0.7, 0), ("a", "3", "yes", 0.1, 0), ("b", "4", "yes", 0.5, 0)],
                                   "ticker string, order_id string, side string, limit_price double, created_at bigint")
    schema = schemas._struct("ticker string, pos bigint, bid double, ask double")
    spark.createDataFrame([("a", 5, 0.4, 0.45), ("a", 9, 0.3, 0.6), ("a", 200, 0.3, 0.6)], schema).write.parquet(f"{base}/in")
    decided = decide_orders(orders, jobs.open_stream(stateful_session(spark), f"{base}/in", schema), 100)
    jobs.drain(decided, f"{base}/cp", lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
    got = {(r.order_id, r.status, r.at) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {("1", "filled", 5), ("2", "filled", 5), ("3", "expired", 200)}


def test_a_large_k_is_cut_twice(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), "id")
    top = top_per_key(rows, ["k"], [F.col("id").desc()], 1200)
    assert sorted(r.id for r in top.collect()) == list(range(3800, 5000))
    assert str(top._jdf.queryExecution().optimizedPlan().toString()).count("row_number()") >= 2


def test_malformed_lines_are_kept_apart(spark):
    base = shared_folder(spark, "bad")
    good = "\t".join(f"v{i}" for i in range(27))
    spark.createDataFrame([(good,), ("too\tfew",)], "value string").write.text(base)
    assert [r.value for r in landed.malformed_lines(spark, base).collect()] == ["too\tfew"]
    assert landed.read_records(spark, base).where("SOURCEURL is not null").count() == 1 and landed.read_csvs(spark, base).count() == 0


def test_silent_orders_expire_by_timer_across_a_restart(spark):
    base = shared_folder(spark, "timers")
    orders = spark.createDataFrame(
        [("a", "1", "yes", 0.5, 0), ("silent", "2", "yes", 0.5, 0), ("a", "3", "yes", 0.1, 50_000), ("silent", "4", "no", 0.5, 400_000), ("a", "5", "no", 0.6, 0)],
        "ticker string, order_id string, side string, limit_price double, created_at bigint")
    schema = schemas._struct("ticker string, pos bigint, bid double, ask double")

    def run(*quotes):
        spark.createDataFrame(list(quotes), schema).write.mode("append").parquet(f"{base}/in")
        stream = jobs.open_stream(stateful_session(spark), f"{base}/in", schema).withColumn("moment", F.timestamp_micros("pos"))
        jobs.drain(decide_or_expire(orders, stream, 100_000), f"{base}/cp", lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
        rows = {(r.order_id, r.status, r.price, r.at) for r in spark.read.parquet(f"{base}/out").collect()}
        state = spark.read.format("statestore").option("stateVarName", "order").load(f"{base}/cp")
        return rows, {r.key.order_id for r in state.collect()}

    first = {("1", "filled", 0.45, 5_000), ("5", "filled", 0.6, 5_000)}
    assert run(("a", 5_000, 0.4, 0.45)) == (first, {"2", "3", "4"})
    # another market's quote at 160 ms moves time past two deadlines; the quote within the limit comes too late for order 3
    second = first | {("2", "expired", None, 100_000), ("3", "expired", None, 150_000)}
    assert run(("b", 160_000, 0.4, 0.45), ("a", 155_000, 0.05, 0.08)) == (second, {"4"})
    assert run(("b", 600_000, 0.4, 0.45)) == (second | {("4", "expired", None, 500_000)}, set())


def _files(path):
    from pathlib import Path

    return {str(f): (f.stat().st_size, f.stat().st_mtime_ns) for f in Path(path).rglob("*.parquet")}


def test_a_merge_writes_only_the_buckets_of_its_batch(spark):
    path = shared_folder(spark, "buckets")
    with pytest.raises(FileNotFoundError):
        tables.read_buckets(spark, path)
    base = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("t"), F.col("id").cast("string").alias("x"))
    tables.merge_buckets(spark, path, base, ["k"], ["t"])
    before = _files(path)
    batch = spark.createDataFrame([(5, 2, "new"), (5, 1, "older"), (99_999, 1, "added"), (None, 1, "null key")], "k bigint, t int, x string").withColumn("extra", F.lit(7))
    for _ in range(2):  # repeating a batch changes nothing
        tables.merge_buckets(spark, path, batch, ["k"], ["t"])
        rows = tables.read_buckets(spark, path)
        assert rows.count() == 20_002 and {(r.k, r.x, r.extra) for r in rows.where("extra = 7").collect()} >= {(5, "new", 7), (99_999, "added", 7), (None, "null key", 7)}
    after = _files(path)
    touched = {f.split("_bucket=")[1].split("/")[0] for f in set(after) ^ set(before)}
    assert len(touched) <= 3 and sum(size for f, (size, _) in after.items() if f not in before) < 0.1 * sum(size for size, _ in before.values())
    tables.update_buckets(spark, path, spark.createDataFrame([(7,), (8,)], "k bigint"), ["k"], F.col("x") == "7", {"x": F.lit("hit"), "t": F.lit(9)})
    assert {(r.k, r.x, r.t) for r in tables.read_buckets(spark, path).where("k in (7, 8)").collect()} == {(7, "hit", 9), (8, "8", 1)}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in set(_files(path)) ^ set(after)}) <= 2
    with pytest.raises(ValueError):
        tables.read_buckets(spark, path, buckets=8)


def test_small_files_are_packed_and_large_ones_left(spark):
    from pathlib import Path

    path = f"{shared_folder(spark, 'pack')}/h"
    noise = lambda n, seed: spark.range(n).select("id", F.sha2((F.col("id") + seed * 10**6).cast("string"), 256).alias("x"))
    noise(60_000, 1).coalesce(1).write.mode("append").parquet(path)
    for seed in range(2, 12):
        noise(2_000, seed).repartition(2).write.mode("append").parquet(path)
    before = _files(path)
    large = max(before, key=lambda f: before[f][0])
    target, total = before[large][0] // 4, spark.read.parquet(path).select(F.count("*"), F.sum(F.xxhash64("id", "x").cast("decimal(38,0)"))).first()
    made = tables.compact_by_size(spark, path, target)
    after = _files(path)
    assert spark.read.parquet(path).select(F.count("*"), F.sum(F.xxhash64("id", "x").cast("decimal(38,0)"))).first() == total
    assert after[large] == before[large] and len(after) == made + 1 < len(before)
    sizes = sorted(size for f, (size, _) in after.items() if f != large)
    assert all(size >= target / 2 for size in sizes[1:]) and max(sizes) <= 2 * target
    # an interrupted packing: the list is there and one new file is moved, the old files still stand
    (Path(path) / "_compacting").mkdir()
    extra = noise(10, 50).coalesce(1)
    extra.write.parquet(f"{path}/_compacting/new")
    spark.createDataFrame([(f"file://{f}",) for f in list(after)[:1]], "_path string").write.parquet(f"{path}/_compacting/old")
    lost = spark.read.parquet(list(after)[0]).count()
    tables.compact_by_size(spark, path, 1)
    assert spark.read.parquet(path).count() == total[0] - lost + 10 and not (Path(path) / "_compacting").exists()


def test_footers_are_read_in_one_job(spark):
    base = shared_folder(spark, "many")
    for i in range(12):
        spark.range(1).select(F.lit(i).cast("int" if i % 3 else "string").alias("a")).write.parquet(f"{base}/{i}")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("footers", "one listing, one scan")
    rows, rejected = landed.drifting_and_rejects(spark, base, schemas._struct("a string"))
    jobs_run = len(tracker.getJobIdsForGroup("footers"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs_run < 12 and rejected.count() == 0 and sorted(int(r.a) for r in rows.collect()) == list(range(12))


def test_every_line_is_kept_or_rejected(spark):
    base = shared_folder(spark, "lines")
    good = "\t".join(f"v{i}" for i in range(27))
    lines = [good, "few\tcolumns", good + "\tmore", "", good, 'q"' + good]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{base}/in")
    kept, rejected = landed.records_and_rejects(spark, f"{base}/in", f"{base}/out")
    assert kept.count() == 3 and sorted(r[0] for r in rejected.collect()) == ["few\tcolumns", good + "\tmore"] and "SOURCEURL" in kept.columns
    lines = ['{"a": 1}', '{"a": "x"}', "{", '{"a": null}', "[1]"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{base}/json")
    kept, rejected = landed.json_and_rejects(spark, f"{base}/json", schemas._struct("a bigint"), f"{base}/json-out")
    assert sorted(str(r.a) for r in kept.collect()) == ["1", "None"] and sorted(r[0] for r in rejected.collect()) == ['[1]', "{", '{"a": "x"}']


def test_old_files_are_not_opened_and_late_rows_within_the_hour_are_kept(spark):
    import os

    base, mark = shared_folder(spark, "levels"), 1_700_000_000
    schema = schemas._struct("name string, at timestamp")
    landings = {"far": -7200, "near": -1800, "after": 60}  # seconds of writing, as seen from the watermark
    for name, by in landings.items():
        rows = spark.createDataFrame([(f"{name}-old", mark - 10), (f"{name}-new", mark + 10)], "name string, s bigint")
        rows.select("name", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"{base}/{name}")
        for f in _files(f"{base}/{name}"):
            os.utime(f, (mark + by, mark + by))
    watermark = spark.createDataFrame([(mark,)], "s bigint").select(F.timestamp_seconds("s").alias("w"))
    got = landed.read_behind(spark, base, schema, "at", watermark)
    assert sorted(r.name for r in got.collect()) == ["after-new", "near-new"]
    assert {f.split("/")[-2] for f in got.inputFiles()} == {"near", "after"}
    assert landed.read_behind(spark, base, schema, "at", watermark.where("false")).count() == 6


def test_seen_keys_cost_the_same_in_every_batch(spark):
    base = shared_folder(spark, "seen")
    schema = schemas._struct("k bigint, t bigint")
    source = lambda: jobs.open_stream(stateful_session(spark), f"{base}/in", schema)
    for i in range(10):  # each batch: 20 keys of the batch before and 20 new ones, twice
        rows = spark.range(40).select((F.col("id") + 20 * i).alias("k"), F.lit(i).cast("bigint").alias("t"))
        rows.union(rows.withColumn("t", F.col("t") + 100)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        progress = jobs.drain(jobs.unseen(source(), "k", ["t"]), f"{base}/cp", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
        written = [o.numRowsUpdated for p in progress for o in p.stateOperators]
        assert sum(p.numInputRows for p in progress) == 80 and sum(written) <= 40
    got = [(r.k, r.t) for r in spark.read.parquet(f"{base}/out").collect()]
    assert sorted(got) == [(k, 100 + max(0, k // 20 - 1)) for k in range(220)]
    plan = jobs.unseen(source(), "k", ["t"])._jdf.queryExecution().analyzed().toString()
    assert f"{base}/out" not in plan


def test_embedding_sync_replaces_windows_in_ordered_batches(spark):
    from sigloft.plans.retrieval import sync_embeddings

    path = shared_folder(spark, "sync")
    schema = "link string, title string, full_text string, sec bigint, published_sec bigint, source string, sentiment_score double"

    def feed(texts):
        return spark.createDataFrame([(k, "t", x, sec, None, "s", None) for k, (x, sec) in texts.items()], schema)

    texts = {"a": ("x" * 25, 5), "b": ("y" * 3, 1), "c": ("z" * 8, 5), "d": ("w" * 40, 5), "e": ("", 9)}
    assert sync_embeddings(spark, feed(texts), "news", path, 2, 10) == 2  # b with all of time 5, then e
    windows = lambda: {(r.id, r.window): r.model_input for r in tables.read_buckets(spark, path).collect()}
    cut = lambda k, x: {(f"news_{k}", i): d[10 * i : 10 * i + 10] for d in [f"t | {x}"] for i in range((len(d) + 9) // 10)}
    want = lambda: {w: x for k, (text, _) in texts.items() for w, x in cut(k, text).items()}
    assert windows() == want()
    before = _files(path)
    assert sync_embeddings(spark, feed(texts), "news", path, 2, 10) == 0 and _files(path) == before
    texts["d"], texts["f"] = ("w" * 2, 5), ("new", 3)
    assert sync_embeddings(spark, feed(texts), "news", path, 10, 10) == 1 and windows() == want()


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from sigloft.catalog.streams import stream_dedup

    rows = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(["a", "b", "a", None, "", "b"])], "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part")
    Path(f"{tmp_path}/one").mkdir()
    [part] = Path(f"{tmp_path}/part").glob("part-*.parquet")
    Path(f"{tmp_path}/one/documents.parquet").write_bytes(part.read_bytes())
    for folder in ("one", "many"):
        got = [r.content for r in stream_dedup(spark, f"{tmp_path}/{folder}").collect()]
        assert len(got) == 4 and set(got) == {hashlib.md5(x.encode()).hexdigest() for x in ("a", "b", "")} | {None}


def test_a_replacement_writes_its_batch_and_no_stored_row(spark):
    path = shared_folder(spark, "replaced")
    rows = lambda ks, x: spark.createDataFrame([(k, i, x * 50) for k in ks for i in range(2)], "k string, i int, x string")
    size = lambda: sum(n for n, _ in _files(path).values())
    tables.replace_buckets(spark, path, rows([*map(str, range(3000)), None], "a"), "k")
    first, before = _files(path), size()
    tables.replace_buckets(spark, path, rows(map(str, range(2995, 3005)), "b").where("k <> '2999' OR i = 0"), "k")
    assert first.items() <= _files(path).items() and size() - before < 0.2 * before
    held = {(r.k, r.i, r.x[0]) for r in tables.read_buckets(spark, path).collect()}
    want = {(k, i, "a") for k in [*map(str, range(2995)), None] for i in range(2)} | {(str(k), i, "b") for k in range(2995, 3005) for i in range(2)} - {("2999", 1, "b")}
    assert held == want and tables.read_buckets(spark, path).count() == len(want)
    rows(["0"], "c").withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/log-64/rows/_version=3")  # left by a run that failed
    assert tables.read_buckets(spark, path).count() == len(want)
    tables.replace_buckets(spark, path, rows(["1"], "d"), "k")
    assert {r.x[0] for r in tables.read_buckets(spark, path).where("k in ('0', '1')").collect()} == {"a", "d"}
    tables.settle_buckets(spark, path, f"{path}-settled", "k")
    assert tables.read_buckets(spark, f"{path}-settled").exceptAll(tables.read_buckets(spark, path)).isEmpty()
    assert tables.read_buckets(spark, f"{path}-settled", select=["k"]).count() == len(want)
    with pytest.raises(ValueError):
        tables.replace_buckets(spark, path, rows(["1"], "d"), "k", 8)
    with pytest.raises(ValueError):
        tables.merge_buckets(spark, path, rows(["1"], "d"), ["k"], ["i"])
