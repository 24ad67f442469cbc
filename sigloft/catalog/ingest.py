"""Landed events, markets, pages and payloads: filters, lookups, type drift, formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.functions.text import bill_key, contains_any, readable
from sigloft.plans import enrich
from sigloft.session import shared_folder
from sigloft.sources import landed, schemas

_CODES = [c for c, _ in fv.EVENT_CODES]
_PLACES = [c for c, _ in fv.COUNTRY_CODES] + [None, "ZZ"]
_FIRST_COUNTRY = {c: n for c, n in reversed(fv.COUNTRY_CODES)}


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


WORLD = f"""
world AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, ({v.sql_list(_CODES)})[(l_partkey % {len(_CODES)}) + 1] AS code,
         ({v.sql_list(_PLACES)})[(l_suppkey % {len(_PLACES)}) + 1] AS place1,
         ({v.sql_list(_PLACES)})[((l_suppkey * 7 + l_linenumber) % {len(_PLACES)}) + 1] AS place2, s_nationkey, c_nationkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
codes(code, description) AS {_values(fv.EVENT_CODES)},
countries(code, name) AS {_values(_FIRST_COUNTRY.items())},
classes(code, label) AS {_values(fv.EVENT_CLASSES)}"""


def world_events(spark, sf):
    """Line items as landed world events: text columns, one-digit codes without their leading zero."""
    code = v.pick(F.col("l_partkey") % len(_CODES), _CODES)
    items = v.table(spark, sf, "lineitem")
    supplier = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    customer = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    owner = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = items.join(owner, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").withColumn("code", code)
    return joined.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("GLOBALEVENTID"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("SQLDATE"),
        F.when(F.length("code") == 2, F.regexp_replace("code", "^0", "")).otherwise(F.col("code")).alias("EventCode"),
        F.substring("code", 1, 2).alias("EventRootCode"),
        v.pick(F.col("l_suppkey") % len(_PLACES), _PLACES).alias("Actor1Geo_CountryCode"),
        v.pick((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % len(_PLACES), _PLACES).alias("Actor2Geo_CountryCode"),
        F.col("s_nationkey").cast("string").alias("Actor1CountryCode"), F.col("c_nationkey").cast("string").alias("Actor2CountryCode"),
        F.col("l_linenumber").cast("string").alias("Actor1Type1Code"),
        F.col("l_discount").cast("string").alias("GoldsteinScale"), F.col("l_quantity").cast("int").cast("string").alias("NumMentions"),
        F.col("l_tax").cast("string").alias("AvgTone"),
    )


@query("code_lookup_enrich", with_ctes("""
SELECT codes.description AS event_description, classes.label AS quad_description, a.name AS actor1_country_name, b.name AS actor2_country_name,
       n1.n_name AS actor1_nationality, n2.n_name AS actor2_nationality, r.r_name AS actor1_type, count(*) AS events,
       CAST(sum(l_quantity) AS BIGINT) AS mentions
FROM world LEFT JOIN codes ON codes.code = world.code
LEFT JOIN classes ON classes.code = CASE WHEN world.code[1:2] BETWEEN '01' AND '05' THEN '1' WHEN world.code[1:2] BETWEEN '06' AND '08' THEN '2'
  WHEN world.code[1:2] BETWEEN '09' AND '14' THEN '3' WHEN world.code[1:2] BETWEEN '15' AND '20' THEN '4' ELSE '0' END
LEFT JOIN countries a ON a.code = place1 LEFT JOIN countries b ON b.code = place2
LEFT JOIN nation n1 ON n1.n_nationkey = s_nationkey LEFT JOIN nation n2 ON n2.n_nationkey = c_nationkey
LEFT JOIN region r ON r.r_regionkey = l_linenumber
GROUP BY 1, 2, 3, 4, 5, 6, 7""", WORLD))
def code_lookup_enrich(spark, sf):
    """Events with the labels of seven lookups, counted by label."""
    nation = v.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    region = v.table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("code"), "r_name")
    rows = enrich.enrich_events(
        world_events(spark, sf), landed.code_list(spark, fv.EVENT_CODES, "code", "description"),
        landed.code_list(spark, fv.COUNTRY_CODES, "code", "name"), landed.code_list(spark, fv.EVENT_CLASSES, "code", "label"),
        region, nation,
    )
    labels = ["event_description", "quad_description", "actor1_country_name", "actor2_country_name", "actor1_nationality",
              "actor2_nationality", "actor1_type"]
    return rows.groupBy(*labels).agg(F.count("*").alias("events"), F.sum("mention_count").alias("mentions"))


@query("code_prefix_filter", with_ctes(f"""
SELECT code AS event_code, count(*) AS events FROM world WHERE code[1:2] IN {tuple(fv.POLITICAL_ROOT_CODES)} GROUP BY 1""", WORLD))
def code_prefix_filter(spark, sf):
    rows = enrich.political_events(world_events(spark, sf))
    return rows.groupBy(F.col("EventCode").alias("event_code")).agg(F.count("*").alias("events"))


_THEME_SET = ("ELECTION_2024", "GOV_REFORM", "ECON_TRADE_DEAL", "SPORT_FINAL", "HEALTH_CARE", "WEATHER", "United_NATIONS", "PEACE_TALKS", "MUSIC", "ELECT")


@query("list_prefix_filter", f"""
WITH t AS (SELECT doc_id, [({v.sql_list(_THEME_SET)})[(doc_id % 10) + 1], ({v.sql_list(_THEME_SET)})[((doc_id * 3) % 10) + 1]] AS themes FROM documents)
SELECT doc_id FROM t WHERE len(list_filter(themes, lambda x: regexp_matches(x, '^({"|".join(fv.POLITICAL_THEME_PREFIXES)})'))) > 0""")
def list_prefix_filter(spark, sf):
    """Records of which any theme starts with a kept prefix."""
    themes = [v.pick(i % 10, _THEME_SET) for i in (F.col("doc_id"), F.col("doc_id") * 3)]
    packed = F.concat_ws(";", *[F.concat(t, F.lit(","), F.lit(str(n))) for n, t in enumerate(themes)])
    rows = v.table(spark, sf, "documents").select("doc_id", packed.alias("V2Themes"))
    return enrich.political_records(rows).select("doc_id")


_OR_WORDS = " OR ".join("contains(lower(title), '" + w.replace("'", "''") + "')" for w in fv.TITLE_EXCLUSIONS)
_TITLED_PARTS = """
titled AS (SELECT p_partkey, p_brand, p_type, p_name || CASE WHEN p_partkey % 9 = 0 THEN ' Golf Open' WHEN p_partkey % 13 = 0 THEN ' Box Office'
  WHEN p_partkey % 17 = 0 THEN ' vote' ELSE '' END AS title FROM part)"""


def _titled_parts(spark, sf):
    key = F.col("p_partkey")
    end = F.when(key % 9 == 0, " Golf Open").when(key % 13 == 0, " Box Office").when(key % 17 == 0, " vote").otherwise("")
    return v.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.concat("p_name", end).alias("title"))


@query("title_exclusion", with_ctes(f"SELECT p_partkey, title FROM titled WHERE NOT ({_OR_WORDS})", _TITLED_PARTS))
def title_exclusion(spark, sf):
    return _titled_parts(spark, sf).where(~contains_any(F.col("title"), fv.TITLE_EXCLUSIONS)).select("p_partkey", "title")


@query("category_fallback", with_ctes(f"""
SELECT p_partkey, category FROM (
  SELECT p_partkey, title, trim(coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'Politics' WHEN p_partkey % 3 = 1 THEN NULL ELSE s.category END, s.category, '')) AS category
  FROM titled LEFT JOIN (SELECT p_brand, CASE WHEN min(p_partkey) % 2 = 0 THEN 'Politics' ELSE 'Sports' END AS category FROM part GROUP BY p_brand) s USING (p_brand))
WHERE category IN ('Politics') AND NOT ({_OR_WORDS})""", _TITLED_PARTS))
def category_fallback(spark, sf):
    """Category of the market, else of its series (here: the brand)."""
    own = v.pick(F.col("p_partkey") % 3, ("Politics", None, "  "))
    markets = _titled_parts(spark, sf).select("p_partkey", "title", F.col("p_brand").alias("series_ticker"), own.alias("category"))
    series = v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("series_ticker")).agg(
        F.when(F.min("p_partkey") % 2 == 0, "Politics").otherwise("Sports").alias("category")
    )
    return enrich.political_markets(markets, series).select("p_partkey", "category")


@query("settled_recency", """
SELECT o_orderkey, o_orderstatus FROM orders
WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 30 DAY END IS NULL
   OR CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 30 DAY END >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY""")
def settled_recency(spark, sf):
    """Markets settled (else closed) within 90 days; those without a time are kept."""
    kind = F.col("o_orderkey") % 3
    rows = v.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.lit("order").alias("title"), F.when(kind == 0, F.col("o_orderdate")).alias("settlement_ts"),
        F.when(kind == 1, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("close_time"),
    )
    return enrich.recently_settled(rows, v.orders_anchor(spark, sf) - F.expr("INTERVAL 90 DAYS")).select("o_orderkey", "o_orderstatus")


@query("status_union", """
SELECT status_pulled, count(*) AS markets, count(DISTINCT o_custkey) AS series FROM (
  SELECT *, 'closed' AS status_pulled FROM orders WHERE o_orderstatus IN ('F', 'P') UNION ALL SELECT *, 'settled' FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
UNION ALL SELECT 'all', count(*), count(DISTINCT o_custkey) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))""")
def status_union(spark, sf):
    """Two status passes with a tag, and the set union of their series."""
    rows = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    closed = rows.where(F.col("o_orderstatus").isin("F", "P")).withColumn("status_pulled", F.lit("closed"))
    done = rows.where(F.col("o_orderstatus") == "F").withColumn("status_pulled", F.lit("settled"))
    passes = closed.unionByName(done).groupBy("status_pulled").agg(
        F.count("*").alias("markets"), F.count_distinct("o_custkey").alias("series")
    )
    series = closed.select("o_custkey").union(done.select("o_custkey")).distinct()
    return passes.unionByName(series.agg(F.lit("all").alias("status_pulled"), F.count("*").alias("markets"), F.count("*").alias("series")))


_DRIFT = "ticker string, yes_bid double, yes_ask double, floor_strike double, cap_strike double, status string"


@query("type_normalise_union", """
SELECT 'T' || o_orderkey AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100) / 100 WHEN o_orderkey % 10 = 1 THEN NULL ELSE (o_orderkey % 64) / 64 END AS yes_bid,
       CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100 + 1) / 100 END AS yes_ask,
       CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7)::DOUBLE ELSE (o_orderkey % 7) / 2 END AS floor_strike, NULL::DOUBLE AS cap_strike,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS status FROM orders""")
def type_normalise_union(spark, sf):
    """Two landed halves whose column names and types drift, under one schema."""
    rows = v.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    name = F.concat(F.lit("T"), key.cast("string"))
    new = rows.where(key % 2 == 0).select(
        name.alias("ticker"), (key % 100 / 100).alias("yes_bid_dollars"), ((key % 100 + 1) / 100).cast("string").alias("yes_ask_dollars"),
        F.lit(0.5).alias("yes_bid"), (key % 7).alias("floor_strike"),
    )
    old = rows.where(key % 2 == 1).select(
        name.alias("ticker"), F.when(key % 10 == 1, "n/a").otherwise((key % 64 / 64).cast("string")).alias("yes_bid"),
        (key % 7 / 2).alias("floor_strike"), F.col("o_orderstatus").alias("status"),
    )
    return schemas.union_by_name([new, old], schemas._struct(_DRIFT), spark)


@query("bill_keys", """
SELECT '119_' || lower(CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' ELSE p_type END) || '_' || CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE p_partkey::VARCHAR END || '_' ||
       CASE WHEN p_partkey % 3 = 0 THEN '0000-00-00' ELSE '2026-01-02' END AS bill_id, count(*) AS n FROM part GROUP BY 1""")
def bill_keys(spark, sf):
    """Compound ids with defaults for missing parts."""
    key = F.col("p_partkey")
    rows = v.table(spark, sf, "part").select(bill_key(
        F.lit(119), F.when(key % 5 != 0, F.col("p_type")), F.when(key % 7 != 0, key.cast("string")), F.when(key % 3 != 0, "2026-01-02")
    ).alias("bill_id"))
    return rows.groupBy("bill_id").agg(F.count("*").alias("n"))


@query("unseen_keys", """
SELECT count(*) AS new_links, count(DISTINCT source) AS sources FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unseen_keys(spark, sf):
    """Articles whose link has not been taken before (here: labelled documents count as taken)."""
    seen = v.table(spark, sf, "labels").select("doc_id")
    new = v.table(spark, sf, "documents").select("doc_id", "source").join(seen, "doc_id", "left_anti")
    return new.agg(F.count("*").alias("new_links"), F.count_distinct("source").alias("sources"))


_PAGE = "html"
for _block in ("script", "style", "nav", "head", "footer"):
    _PAGE = f"regexp_replace({_PAGE}, '(?is)<{_block}[ >].*?</{_block}>', ' ', 'g')"
_PAGE = f"regexp_replace(regexp_replace({_PAGE}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _mark, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_mark}', '{_char}')"
_PAGE = f"trim(regexp_replace({_PAGE}, '[ \\t\\n\\r]+', ' ', 'g'))"


@query("page_text_fallback", f"""
SELECT page_id, length(full_text) AS chars, md5(full_text) AS text_md5, scraped, md5(title) AS title_md5 FROM (
  SELECT page_id, coalesce(nullif(t, ''), url) AS full_text, t <> '' AS scraped, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title
  FROM (SELECT page_id, url, html, {_PAGE} AS t FROM pages))""")
def page_text_fallback(spark, sf):
    """Visible page text, the feed summary (here: the address) where a page has none."""
    rows = enrich.page_articles(v.table(spark, sf, "pages").withColumn("summary", F.col("url")), "summary")
    return rows.select("page_id", F.length("full_text").cast("bigint").alias("chars"), F.md5("full_text").alias("text_md5"), "scraped",
                       F.md5("title").alias("title_md5"))


@query("json_flatten", """
WITH c AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 6 AS k FROM conversations)
SELECT conv_id, turn, md5(CASE k WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '[' || upper(role) || '] ' || text WHEN 3 THEN text || ' ' || role
       WHEN 4 THEN text WHEN 5 THEN '{' || text END) AS flat_md5 FROM c""")
def json_flatten(spark, sf):
    """Nested answers to one line: plain text, known keys, tags, lists, JSON inside JSON, broken JSON."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    text, role = F.col("text"), F.col("role")
    nested = F.to_json(F.struct(F.to_json(F.struct(F.struct(text.alias("text")).alias("reason"))).alias("verdict"), role.alias("other")))
    value = (
        F.when(k == 0, text).when(k == 1, F.to_json(F.struct(role.alias("note"), text.alias("description"))))
        .when(k == 2, F.to_json(F.struct(role.alias("direction"), text.alias("note"))))
        .when(k == 3, F.to_json(F.array(F.struct(text.alias("note")), F.struct(role.alias("note")))))
        .when(k == 4, nested).otherwise(F.concat(F.lit("{"), text))
    )
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", value.alias("value"))
    return rows.select("conv_id", "turn", F.md5(readable(F.col("value"))).alias("flat_md5"))


@query("payload_flatten", """
SELECT 'E' || event_id AS ticker, value AS yes_bid, '{"k":' || json_extract_string(props, '$.k') || '}' AS detail, 'U' || user_id AS series_ticker, 'open' AS status_pulled
FROM events""")
def payload_flatten(spark, sf):
    """Landed API pages (one JSON line per series with an array of markets) to market rows with nested values as text."""
    folder = shared_folder(spark, "payload")
    market = F.struct(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ticker"), F.col("value").alias("yes_bid"),
                      F.from_json("props", "k bigint").alias("detail"))
    events = v.table(spark, sf, "events")
    pages = events.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("series"),
                           F.floor(F.col("event_id") / 200).alias("page")).agg(F.collect_list(market).alias("markets"))
    pages.withColumn("ingested_at", F.lit("2024-02-01T00:00:00Z")).write.json(folder)
    schema = "series string, ingested_at string, markets array<struct<ticker: string, yes_bid: double, detail: struct<k: bigint>>>"
    rows = landed.payload_rows(landed.read_json_lines(spark, folder, schema), "series", "ingested_at", "open")
    return rows.select("ticker", "yes_bid", "detail", "series_ticker", "status_pulled")


@query("csv_tsv_roundtrip", with_ctes("""
SELECT 'csv' AS kind, count(*) AS n, count(DISTINCT o_custkey) AS keys, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM orders
UNION ALL SELECT 'events', count(*), count(DISTINCT code), CAST(sum(l_quantity) AS BIGINT) FROM world
UNION ALL SELECT 'records', count(*), count(DISTINCT source), CAST(sum(n_chars) AS BIGINT) FROM documents""", WORLD))
def csv_tsv_roundtrip(spark, sf):
    """Header CSV, the 61-column event file and the 27-column record file written and read back."""
    base = shared_folder(spark, "delimited")
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    orders.write.csv(f"{base}/csv", header=True)
    events = world_events(spark, sf)
    events.select(*[F.col(c) if c in events.columns else F.lit("").alias(c) for c in fv.EVENT_COLUMNS]).write.csv(f"{base}/events", sep="\t")
    docs = v.table(spark, sf, "documents").select(
        F.concat(F.lit("r\""), F.col("doc_id").cast("string")).alias("GKGRECORDID"), F.col("source").alias("SourceCommonName"),
        F.col("n_chars").cast("string").alias("Counts"),
    )
    line = F.concat_ws("\t", *[F.col(c) if c in docs.columns else F.lit("-") for c in fv.RECORD_COLUMNS])
    docs.select(line.alias("value")).write.text(f"{base}/records")
    csv = spark.read.csv(f"{base}/csv", header=True, schema="o_orderkey bigint, o_custkey bigint, o_orderpriority string")
    back, records = landed.read_events(spark, f"{base}/events"), landed.read_records(spark, f"{base}/records")
    return (
        csv.agg(F.lit("csv").alias("kind"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("keys"), F.sum("o_orderkey").alias("checksum"))
        .union(back.agg(F.lit("events"), F.count("*"), F.count_distinct(enrich.pad_code(F.col("EventCode"))), F.sum(F.col("NumMentions").cast("bigint"))))
        .union(records.agg(F.lit("records"), F.count("*"), F.count_distinct("SourceCommonName"), F.sum(F.col("Counts").cast("bigint"))))
    )


@query("jsonl_scan", f"""
SELECT user_id, count(*) AS n, CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS k_sum, {fx('max(value)', 4)} AS top_value FROM events GROUP BY user_id""")
def jsonl_scan(spark, sf):
    """Events written as JSON lines and read back under a declared schema."""
    folder = shared_folder(spark, "jsonl")
    v.table(spark, sf, "events").select("user_id", "value", F.from_json("props", "k bigint").alias("props")).write.json(folder)
    rows = landed.read_json_lines(spark, folder, "user_id bigint, value double, props struct<k: bigint>")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("props.k").alias("k_sum"), fixed(F.max("value"), 4).alias("top_value"))


@query("drifting_files", """
SELECT o_orderstatus AS status, count(*) AS markets, sum(o_orderkey % 100) / 100 AS bid_sum, count(*) FILTER (WHERE o_orderstatus = 'F') AS with_strike
FROM orders GROUP BY 1""")
def drifting_files(spark, sf):
    """Snapshot files of three schemas (integer, double and text prices; a column that comes and goes) read as one table."""
    base = shared_folder(spark, "drift")
    key = F.col("o_orderkey")
    rows = v.table(spark, sf, "orders").select(F.concat(F.lit("T"), key.cast("string")).alias("ticker"), "o_orderstatus", key)
    forms = {
        "F": [(key % 100).cast("bigint").alias("yes_bid"), (key % 5).cast("bigint").alias("floor_strike")],
        "O": [(key % 100).cast("double").alias("yes_bid")], "P": [(key % 100).cast("string").alias("yes_bid_dollars")],
    }
    for status, columns in forms.items():
        rows.where(F.col("o_orderstatus") == status).select("ticker", F.col("o_orderstatus").alias("status"), *columns).write.parquet(f"{base}/{status}")
    back = landed.read_drifting(spark, base, schemas._struct(_DRIFT))
    return back.groupBy("status").agg(F.count("*").alias("markets"), (F.sum("yes_bid") / 100).alias("bid_sum"), F.count("floor_strike").alias("with_strike"))


@query("rejected_files", """
SELECT 'read' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'rejected', count(DISTINCT o_orderpriority) FROM orders""")
def rejected_files(spark, sf):
    """Snapshot files beside as many broken ones as there are priorities: the rows read, and the files rejected with their reason."""
    base = shared_folder(spark, "broken")
    rows = v.table(spark, sf, "orders").select(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("ticker"), "o_orderpriority")
    rows.select("ticker").write.parquet(f"{base}/good")
    broken = rows.select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("name"), F.lit("no footer").alias("value"))
    broken.coalesce(1).write.partitionBy("name").text(f"{base}/broken")
    back, rejected = landed.drifting_and_rejects(spark, base, schemas._struct(_DRIFT), pattern="part-*")
    return back.agg(F.lit("read").alias("kind"), F.count("ticker").alias("n")).union(rejected.where("error IS NOT NULL").agg(F.lit("rejected"), F.count("*")))


@query("landed_rejects", """
SELECT 'records' AS kind, count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS kept, count(*) FILTER (WHERE doc_id % 7 = 0 OR doc_id % 11 = 0) AS rejected,
       CAST(sum(n_chars) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS BIGINT) AS checksum, count(*) AS lines FROM documents
UNION ALL SELECT 'json', count(*) FILTER (WHERE event_id % 5 <> 0 AND event_id % 13 <> 0), count(*) FILTER (WHERE event_id % 5 = 0 OR event_id % 13 = 0),
       CAST(sum(user_id) FILTER (WHERE event_id % 5 <> 0 AND event_id % 13 <> 0) AS BIGINT), count(*) FROM events""")
def landed_rejects(spark, sf):
    """Lines with too few or too many columns and lines that are no JSON or have another type, kept apart in the scan that reads the rest."""
    base = shared_folder(spark, "rejects")
    key = F.col("doc_id")
    columns = {"GKGRECORDID": key.cast("string"), "Counts": F.col("n_chars").cast("string")}
    full = F.concat_ws("\t", *[columns.get(c, F.lit("-")) for c in fv.RECORD_COLUMNS])
    line = F.when(key % 7 == 0, F.concat(key.cast("string"), F.lit("\tcut off"))).when(key % 11 == 0, F.concat(full, F.lit("\tmore\tcolumns"))).otherwise(full)
    v.table(spark, sf, "documents").select(line.alias("value")).write.text(f"{base}/records")
    event = F.col("event_id")
    whole = F.to_json(F.struct("event_id", "user_id"))
    text = F.when(event % 5 == 0, F.substring(whole, 1, 9)).when(event % 13 == 0, F.concat(F.lit('{"event_id":"none","user_id":'), F.col("user_id").cast("string"), F.lit("}")))
    v.table(spark, sf, "events").select(text.otherwise(whole).alias("value")).write.text(f"{base}/json")
    records = landed.records_and_rejects(spark, f"{base}/records", f"{base}/records-parted")
    events = landed.json_and_rejects(spark, f"{base}/json", schemas._struct("event_id bigint, user_id bigint"), f"{base}/json-parted")

    def counted(kind: str, both, value):
        kept, rejected = both
        rows = kept.select(F.lit(1).alias("k"), F.lit(0).alias("r"), value.alias("x")).union(rejected.select(F.lit(0), F.lit(1), F.lit(None).cast("bigint")))
        return rows.agg(F.lit(kind).alias("kind"), F.sum("k").alias("kept"), F.sum("r").alias("rejected"), F.sum("x").alias("checksum"), F.count("*").alias("lines"))

    return counted("records", records, F.col("Counts").cast("bigint")).union(counted("json", events, F.col("user_id")))


@query("two_level_skip", """
SELECT event_type, count(*) AS n FROM events
WHERE epoch_us(ts) > (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events) GROUP BY 1""")
def two_level_skip(spark, sf):
    """Two landings, one long before the watermark and one after it with rows on both sides: the first is not opened, the rows are cut."""
    base = shared_folder(spark, "skip")
    events = v.table(spark, sf, "events").select("event_id", "ts", "event_type")
    mark = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(F.expr("timestamp_micros((unix_micros(low) + unix_micros(high)) div 2)").alias("mark"))
    mark.write.parquet(f"{base}/watermark")
    persisted = spark.read.parquet(f"{base}/watermark")
    at = persisted.agg(F.max("mark")).scalar()
    old = F.col("ts") <= at - F.expr("INTERVAL 1 HOUR")
    for name, part in (("old", old), ("new", ~old)):
        events.where(part).write.parquet(f"{base}/landed/{name}")
    seconds = persisted.select(F.unix_seconds("mark")).first()[0]
    _written_at(spark, f"{base}/landed/old", seconds - 3 * 3600)
    fresh = landed.read_behind(spark, f"{base}/landed", schemas._struct("event_id bigint, ts timestamp, event_type string"), "ts", persisted)
    return fresh.groupBy("event_type").agg(F.count("*").alias("n"))


def _written_at(spark, folder: str, seconds: int) -> None:
    """Sets the time of writing of a folder's files, as if they had landed then."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(place):
        store.setTimes(status.getPath(), seconds * 1000, -1)


@query("recent_files", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def recent_files(spark, sf):
    """Three snapshots land one after the other beside ``latest.parquet``; the newest two are read."""
    base = shared_folder(spark, "landing")
    rows = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        rows.where(F.col("o_orderstatus") == status).write.parquet(f"{base}/{status}")
    rows.limit(0).write.parquet(f"{base}/latest.parquet")
    newest = spark.read.parquet(*landed.newest_folders(spark, base, 2, "part-*.parquet"))
    return newest.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("feed_watermarks", """
WITH done AS (SELECT source, max(1704067200 + 97 * doc_id) AS mark FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND source <> 'src3' GROUP BY source)
SELECT source AS feed_key, count(*) AS fresh FROM documents LEFT JOIN done USING (source) WHERE mark IS NULL OR 1704067200 + 97 * doc_id > mark GROUP BY 1""")
def feed_watermarks(spark, sf):
    """Feed folders in one scan, each cut at the newest article of its own that was already taken."""
    base = shared_folder(spark, "feeds")
    docs = v.table(spark, sf, "documents").select("doc_id", F.col("source").alias("feed"), F.timestamp_seconds(F.lit(v.EPOCH) + F.col("doc_id") * 97).alias("ingested_at"))
    docs.withColumn("link", F.col("doc_id").cast("string")).select("feed", "link", "ingested_at").withColumn(
        "title", F.lit("t")).repartition("feed").write.partitionBy("feed").parquet(base)
    good = v.table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    done = docs.join(good, "doc_id", "left_semi").where(F.col("feed") != "src3").withColumn("feed_key", F.concat(F.lit("feed="), F.col("feed")))
    fields = T.StructType([f for f in schemas.ARTICLE.fields if f.name in ("title", "link", "ingested_at")])
    fresh = landed.read_feeds(spark, base, fields, landed.source_watermarks(done, "feed_key", "ingested_at"))
    return fresh.groupBy(F.regexp_replace("feed_key", "^feed=", "").alias("feed_key")).agg(F.count("*").alias("fresh"))


@query("union_by_name_files", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders")
def union_by_name_files(spark, sf):
    """Files whose columns differ, read as one table."""
    base = shared_folder(spark, "by-name")
    rows = v.table(spark, sf, "orders")
    rows.where(F.col("o_orderstatus") == "F").select("o_orderkey").write.parquet(f"{base}/a")
    rows.where(F.col("o_orderstatus") != "F").select("o_orderpriority", "o_orderkey").write.parquet(f"{base}/b")
    return landed.read_union_by_name(spark, f"{base}/*").select("o_orderkey", "o_orderpriority")


@query("behind_watermark", """
SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0) - INTERVAL 5 DAY GROUP BY 1""")
def behind_watermark(spark, sf):
    """Events strictly behind one global instant, here five days before the newest purchase taken."""
    events = v.table(spark, sf, "events")
    taken = events.where((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0))
    fresh = landed.newer_than(events, "ts", taken.agg(F.max("ts") - F.expr("INTERVAL 5 DAY")).scalar())
    return fresh.groupBy("event_type").agg(F.count("*").alias("n"))


@query("code_list_csv", "SELECT CAST(p_size AS VARCHAR) AS code, min(p_type) AS label FROM part GROUP BY 1")
def code_list_csv(spark, sf):
    """A reference list kept as CSV, one row per code."""
    path = shared_folder(spark, "codes")
    v.table(spark, sf, "part").select(F.col("p_size").cast("string").alias("code"), F.col("p_type").alias("label")).write.csv(path, header=True)
    return landed.read_code_list(spark, path, "code", "label")


@query("emptiness_probe", """
SELECT status, count(*) > 0 AS has_rows FROM (VALUES ('F'), ('O'), ('P'), ('none')) s(status) JOIN orders ON o_orderstatus = status GROUP BY 1
UNION ALL SELECT 'none', false""")
def emptiness_probe(spark, sf):
    """Whether any order has a status, by the first row found of each."""
    orders = v.table(spark, sf, "orders")
    found = None
    for status in ("F", "O", "P", "none"):
        probe = orders.where(F.col("o_orderstatus") == status).limit(1).agg(F.lit(status).alias("status"), (F.count("*") > 0).alias("has_rows"))
        found = probe if found is None else found.union(probe)
    return found


@query("old_record_columns", """
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents)
SELECT 'r-' || doc_id AS record_id, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 3)) AS persons,
       len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]') AND length(x) >= 9)) AS themes,
       len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]') AND length(x) BETWEEN 7 AND 8)) AS orgs,
       len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]') AND length(x) = 6)) AS locs, 0::BIGINT AS names FROM t""")
def old_record_columns(spark, sf):
    """Records of the older feed, whose list columns have the names without a version."""
    old = v.raw_records(spark, sf)
    for name in ("Persons", "Themes", "Organizations", "Locations"):
        old = old.withColumnRenamed(f"V2{name}", name)
    rows = enrich.clean_records(old)
    return rows.select("record_id", *[F.size(c).cast("bigint").alias(c) for c in ("persons", "themes", "orgs", "locs", "names")])


@query("layer_projection", """
SELECT 'T' || o_orderkey AS ticker, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 64) / 64 END AS yes_bid, 0.5::DOUBLE AS open_interest_fp, o_orderstatus AS status,
       CASE WHEN o_orderkey % 4 <> 0 THEN epoch_us(o_orderdate) // 1000000 END AS close_sec, epoch_us(o_orderdate) // 1000000 AS ingested_sec, true AS strikes_missing FROM orders""")
def layer_projection(spark, sf):
    """Landed text columns under the declared snapshot layer: prices and times cast, unreadable ones null, missing columns typed or at a default."""
    key, at = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    landed_rows = v.table(spark, sf, "orders").select(
        F.concat(F.lit("T"), key.cast("string")).alias("ticker"), F.when(key % 6 == 0, "n/a").otherwise((key % 64 / 64).cast("string")).alias("yes_bid"),
        F.col("o_orderstatus").alias("status"), F.when(key % 4 == 0, "soon").otherwise(at).alias("close_time"), at.alias("ingested_at"), F.lit("x").alias("not in the layer"),
    )
    rows = schemas.conform(landed_rows, schemas.SNAPSHOT, {"open_interest_fp": 0.5})
    missing = F.col("floor_strike").isNull() & F.col("cap_strike").isNull() & F.col("series_ticker").isNull()
    return rows.select("ticker", "yes_bid", "open_interest_fp", "status", F.unix_seconds("close_time").alias("close_sec"),
                       F.unix_seconds("ingested_at").alias("ingested_sec"), missing.alias("strikes_missing"))


@query("newest_snapshot", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def newest_snapshot(spark, sf):
    """Of three snapshots the one that landed last is read."""
    base = shared_folder(spark, "snapshots")
    rows = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("O", "F", "P"):
        rows.where(F.col("o_orderstatus") == status).write.parquet(f"{base}/{status}")
    newest = spark.read.parquet(*landed.newest_folders(spark, base, 1, "part-*.parquet"))
    return newest.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
