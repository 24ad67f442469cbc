"""The given tables and the views derived from them, each in Spark and as a SQL common table expression.

Derived prices, scores and tones are whole numbers over a power of two, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.text import runs_of
from sigloft.operators.keyed import latest_per_key
from sigloft.session import pin_utc, spread
from sigloft.sources.landed import fixed_rows

EPOCH = 1704067200  # 2024-01-01

_TIMED = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp",
}


_LONG_TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; zone-less times are read as UTC instants."""
    reader = pin_utc(spark).read
    if name in _TIMED:
        reader = reader.schema(_TIMED[name])
    rows = reader.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name in _LONG_TEXTS else rows


def hashed(key: str, factor: int, modulus: int, shift: int = 0) -> Column:
    """((factor * key) mod modulus) + shift, a repeatable spread of an integer key."""
    return (F.lit(factor) * F.col(key)) % modulus + shift


def pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- quotes over time -----------------------------------------------------------------------------------------------
SNAP = """
snap AS (
  SELECT event_id AS snap_id, epoch_us(ts) AS pos, epoch_us(ts) // 1000000 AS sec, user_id, event_type,
         'S' || (user_id % 20) || '-' || user_id AS ticker, 'S' || (user_id % 20) AS series,
         least(1003::DOUBLE, greatest(10::DOUBLE, floor(value * 8))) / 1024 AS bid,
         (least(1003::DOUBLE, greatest(10::DOUBLE, floor(value * 8))) + 20) / 1024 AS ask,
         (event_id % 997)::DOUBLE AS volume,
         CASE event_type WHEN 'error' THEN 'closed' WHEN 'click' THEN 'active' ELSE 'open' END AS status
  FROM events)"""


def snap(spark: SparkSession, sf: str) -> DataFrame:
    """Quote snapshots: one market per user, one series per twenty users."""
    tick = F.least(F.lit(1003.0), F.greatest(F.lit(10.0), F.floor(F.col("value") * 8).cast("double")))
    series = F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("snap_id"), F.unix_micros("ts").alias("pos"), F.unix_seconds("ts").alias("sec"),
        "user_id", "event_type", F.concat_ws("-", series, F.col("user_id").cast("string")).alias("ticker"),
        series.alias("series"), (tick / 1024).alias("bid"), ((tick + 20) / 1024).alias("ask"),
        (F.col("event_id") % 997).cast("double").alias("volume"),
        F.when(F.col("event_type") == "error", "closed").when(F.col("event_type") == "click", "active").otherwise("open").alias("status"),
    )


MSNAP = """
msnap AS MATERIALIZED (
  SELECT 'S' || (item % 8) || '-' || item AS ticker, 'S' || (item % 8) AS series, item, snap_id, pos, sec, bid AS yes_bid,
         ask AS yes_ask, volume, status
  FROM (SELECT *, user_id % (SELECT count(*) FROM benchmark) AS item FROM snap))"""


def market_snap(spark: SparkSession, sf: str) -> DataFrame:
    """The same snapshots with one market per benchmark item, which gives the market its title."""
    items = table(spark, sf, "benchmark").agg(F.count("*")).scalar()
    series = F.concat(F.lit("S"), (F.col("item") % 8).cast("string"))
    return snap(spark, sf).withColumn("item", F.col("user_id") % items).select(
        F.concat_ws("-", series, F.col("item").cast("string")).alias("ticker"), series.alias("series"), "item", "snap_id",
        "pos", "sec", F.col("bid").alias("yes_bid"), F.col("ask").alias("yes_ask"), "volume", "status",
    )


TONES = """
tones AS (
  SELECT event_id, epoch_us(ts) // 1000000 AS sec, event_type AS code, user_id,
         ((5 * event_id) % 41 - 20) / 2::DOUBLE AS impact, ((11 * event_id) % 81 - 40) / 4::DOUBLE AS tone
  FROM events)"""


def tones(spark: SparkSession, sf: str) -> DataFrame:
    """World events with impact and tone."""
    return table(spark, sf, "events").select(
        "event_id", F.unix_seconds("ts").alias("sec"), F.col("event_type").alias("code"), "user_id",
        (hashed("event_id", 5, 41, -20) / 2).alias("impact"), (hashed("event_id", 11, 81, -40) / 4).alias("tone"),
    )


# -- articles and records -------------------------------------------------------------------------------------------
ARTICLES = f"""
articles AS (
  SELECT doc_id, source, source AS feed_key, lang, 'doc-' || doc_id AS link, text AS title, {EPOCH} + 97 * doc_id AS sec,
         ((37 * doc_id) % 257 - 128) / 128::DOUBLE AS sentiment_score
  FROM documents)"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles; the whole text is the headline that is searched for keywords."""
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.col("source").alias("feed_key"), "lang",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("link"), F.col("text").alias("title"),
        (F.lit(EPOCH) + F.col("doc_id") * 97).alias("sec"), (hashed("doc_id", 37, 257, -128) / 128).alias("sentiment_score"),
    )


RECORDS = f"""
record_tokens AS (
  SELECT doc_id, {EPOCH} + 97 * doc_id AS sec, ((53 * doc_id) % 161 - 80) / 8::DOUBLE AS tone,
         unnest(string_split(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), ' ')) AS w
  FROM documents),
entity_mentions AS MATERIALIZED (
  SELECT CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'person' WHEN length(w) >= 9 THEN 'theme'
              WHEN length(w) >= 7 THEN 'organization' ELSE 'location' END AS entity_type,
         CASE WHEN NOT regexp_matches(w, '^[A-Z]') AND length(w) >= 9 THEN upper(w) ELSE w END AS entity_name, doc_id, sec, tone
  FROM record_tokens
  WHERE CASE WHEN regexp_matches(w, '^[A-Z]') THEN length(w) > 3 ELSE length(w) >= 6 END)"""


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Document records as they land: packed 'name,offset;...' lists made of the words of the whole text."""
    words = runs_of(F.col("text"), "[A-Za-z0-9]+")

    def packed(keep, show=lambda w: w, place: bool = False) -> Column:
        kept = F.filter(F.col("_w"), keep)
        block = lambda w, i: (
            F.concat(F.lit("1#"), show(w), F.lit("#XX#"), i.cast("string")) if place
            else F.concat(show(w), F.lit(","), i.cast("string"))
        )
        return F.array_join(F.transform(kept, block), ";")

    upper = lambda w: F.ascii(w).between(65, 90)
    return table(spark, sf, "documents").withColumn("_w", words).select(
        F.concat(F.lit("r-"), F.col("doc_id").cast("string")).alias("GKGRECORDID"),
        F.concat(F.lit("2024"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("01")).alias("DATE"),
        F.concat(F.lit("http://news.example.com/"), F.col("doc_id").cast("string")).alias("SOURCEURL"),
        packed(lambda w: upper(w) & (F.length(w) > 3)).alias("V2Persons"),
        packed(lambda w: ~upper(w) & (F.length(w) >= 9), F.upper).alias("V2Themes"),
        packed(lambda w: ~upper(w) & F.length(w).between(7, 8)).alias("V2Organizations"),
        packed(lambda w: ~upper(w) & (F.length(w) == 6), place=True).alias("V2Locations"),
        F.concat_ws(",", (hashed("doc_id", 53, 161, -80) / 8).cast("string"), F.lit("2.5"), F.lit("1.0")).alias("V2Tone"),
        (F.lit(EPOCH) + F.col("doc_id") * 97).alias("sec"), "doc_id",
    )


#: series, entity type, entity name, pattern
BRIDGE_ROWS = (
    ("S0", "person", "That", ""), ("S1", "theme", "ORANTION", ""), ("S2", "organization", "thereth", "^the"),
    ("S3", "location", "inoran", ""), ("S4", "theme", "eration", "(tion|ing)$"), ("S5", "person", "thanthat", None),
    ("S6", "location", "ononst", "^x"), ("S7", "organization", "hereing", None), ("S1", "location", "hehely", "HE"),
)
BRIDGE = "bridge(series_ticker, entity_type, entity_name, required_regex) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in BRIDGE_ROWS
) + ")"


def bridge(spark: SparkSession) -> DataFrame:
    return fixed_rows(spark, BRIDGE_ROWS, ("series_ticker", "entity_type", "entity_name", "required_regex"))


# -- scored quotes, briefs, settlements, fills (from orders, customer and lineitem) ----------------------------------
QUOTES = """
quotes AS (
  SELECT o_orderkey, 'S' || (o_custkey % 50) || '-' || o_orderkey AS ticker, 'S' || (o_custkey % 50) AS series,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'How many urgent orders' WHEN '5-LOW' THEN 'Total number of low orders'
              ELSE 'Will order ' || o_orderkey || ' clear' END AS title,
         ((7919 * o_orderkey) % 1023 + 1) / 1024::DOUBLE AS yes_bid,
         least(1023, (7919 * o_orderkey) % 1023 + 21) / 1024::DOUBLE AS yes_ask,
         o_totalprice / 5000 AS mispricing_score, o_totalprice / 5000 > 80 AS flagged_candidate,
         ((17 * o_orderkey) % 129 - 64) / 256::DOUBLE AS delta_15m, ((13 * o_orderkey) % 41) / 4::DOUBLE AS max_spike_multiplier,
         ((31 * o_orderkey) % 257 - 128) / 128::DOUBLE AS sentiment_signal, o_orderdate AS scored_at,
         o_orderdate + to_days((o_orderkey % 500)::INTEGER) AS close_time
  FROM orders),
quotes_anchor AS (SELECT max(o_orderdate) AS anchor FROM orders)"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """One scored market per order."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    series = F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.concat_ws("-", series, key.cast("string")).alias("ticker"), series.alias("series"),
        F.when(priority == "1-URGENT", "How many urgent orders").when(priority == "5-LOW", "Total number of low orders")
        .otherwise(F.concat(F.lit("Will order "), key.cast("string"), F.lit(" clear"))).alias("title"),
        (hashed("o_orderkey", 7919, 1023, 1) / 1024).alias("yes_bid"),
        (F.least(F.lit(1023), hashed("o_orderkey", 7919, 1023, 21)) / 1024).alias("yes_ask"),
        (F.col("o_totalprice") / 5000).alias("mispricing_score"),
        (F.col("o_totalprice") / 5000 > fv.SCORE_FLAG).alias("flagged_candidate"),
        (hashed("o_orderkey", 17, 129, -64) / 256).alias("delta_15m"),
        (hashed("o_orderkey", 13, 41) / 4).alias("max_spike_multiplier"),
        (hashed("o_orderkey", 31, 257, -128) / 128).alias("sentiment_signal"), F.col("o_orderdate").alias("scored_at"),
        F.date_add(F.to_date("o_orderdate"), (key % 500).cast("int")).cast("timestamp").alias("close_time"),
    )


def orders_anchor(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "orders").agg(F.max("o_orderdate")).scalar()


TITLES = (
    "Will Jerome Powell resign", "Ukraine ceasefire this year", "Gaza aid deal", "Will Trump sign the bill",
    "Interest rate cut in June", "Elon Musk steps down", "Quiet county race", "Local ballot measure",
    "Zuckerberg testifies", "NYPD chief named",
)
VERDICTS = (
    None, "Error: no answer", "GHOST PUMP: no news", "No trade", "neutral", "", "Buy NO on weak data",
    "Buy NO, the news is priced in", "Buy YES on strong data", "Buy YES, momentum holds", "Leaning on polls", "No trade today",
)
BRIEFS = f"""
briefs AS (
  SELECT o_orderkey AS brief_id, o_custkey, 'C' || (o_custkey % 40) || '-' || o_custkey AS ticker,
         ({sql_list(TITLES)})[(o_custkey % {len(TITLES)}) + 1] AS title,
         epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 AS sec,
         ((31 * o_orderkey) % 65 + 63) / 128::DOUBLE AS confidence,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS recommended_side,
         ((7919 * o_orderkey) % 1023 + 1) / 1024::DOUBLE AS odds, ((17 * o_orderkey) % 129 - 64) / 256::DOUBLE AS odds_delta,
         o_totalprice / 5000 AS mispricing_score,
         ({sql_list(VERDICTS)})[(o_orderkey % {len(VERDICTS)}) + 1] AS verdict,
         ([NULL, 'model-a', 'model-b'])[(o_orderkey % 3) + 1] AS replay_model
  FROM orders),
briefs_anchor AS (SELECT max(epoch_us(o_orderdate)) // 1000000 AS anchor FROM orders)"""


def customer_ticker(key: str) -> Column:
    return F.concat(F.lit("C"), (F.col(key) % 40).cast("string"), F.lit("-"), F.col(key).cast("string"))


def briefs(spark: SparkSession, sf: str) -> DataFrame:
    """One brief per order, one market per customer."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("brief_id"), "o_custkey", customer_ticker("o_custkey").alias("ticker"),
        pick(F.col("o_custkey") % len(TITLES), TITLES).alias("title"),
        (F.unix_seconds("o_orderdate") + key % 86_400).alias("sec"),
        (hashed("o_orderkey", 31, 65, 63) / 128).alias("confidence"),
        F.when(key % 29 == 0, F.lit(None)).when(key % 2 == 0, "yes").otherwise("no").alias("recommended_side"),
        (hashed("o_orderkey", 7919, 1023, 1) / 1024).alias("odds"), (hashed("o_orderkey", 17, 129, -64) / 256).alias("odds_delta"),
        (F.col("o_totalprice") / 5000).alias("mispricing_score"), pick(key % len(VERDICTS), VERDICTS).alias("verdict"),
        pick(key % 3, (None, "model-a", "model-b")).alias("replay_model"),
    )


def briefs_anchor(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "orders").agg(F.unix_seconds(F.max("o_orderdate"))).scalar()


SETTLED = """
settled AS (
  SELECT 'C' || (c_custkey % 40) || '-' || c_custkey AS ticker, CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS result
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
results AS (SELECT ticker, min(lower(result)) AS result FROM settled WHERE lower(result) IN ('yes', 'no') GROUP BY ticker),
live AS (
  SELECT 'C' || (c_custkey % 40) || '-' || c_custkey AS ticker, ((613 * c_custkey) % 1000 + 2) / 1024::DOUBLE AS live_bid,
         ((613 * c_custkey) % 1000 + 22) / 1024::DOUBLE AS live_ask,
         (SELECT max(epoch_us(o_orderdate)) // 1000000 FROM orders) + (c_custkey % 40) * 43200 AS close_sec
  FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))"""


def settled(spark: SparkSession, sf: str) -> DataFrame:
    """Two customer segments are settled markets."""
    return table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        customer_ticker("c_custkey").alias("ticker"), F.when(F.col("c_nationkey") % 2 == 0, "Yes").otherwise("no").alias("result")
    )


def live(spark: SparkSession, sf: str) -> DataFrame:
    """The other customers but one segment are live markets."""
    tick = hashed("c_custkey", 613, 1000, 2)
    return table(spark, sf, "customer").where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).select(
        customer_ticker("c_custkey").alias("ticker"), (tick / 1024).alias("live_bid"), ((tick + 20) / 1024).alias("live_ask"),
        (briefs_anchor(spark, sf) + (F.col("c_custkey") % 40) * 43_200).alias("close_sec"),
    )


FILLS = """
fills AS (
  SELECT 'C' || (o_custkey % 40) || '-' || o_custkey AS ticker, CASE l_returnflag WHEN 'A' THEN 'yes' ELSE 'no' END AS side,
         CASE WHEN l_discount < 0.005 THEN 'sell' ELSE 'buy' END AS action, l_quantity AS count,
         (l_partkey % 125 + 1) / 128::DOUBLE AS price, epoch_us(l_shipdate) // 1000000 AS pos, l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def fills(spark: SparkSession, sf: str) -> DataFrame:
    """One fill per line item, on the market of the ordering customer."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", "l_quantity", "l_partkey", "l_shipdate")
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return items.join(owners, "l_orderkey").select(
        customer_ticker("o_custkey").alias("ticker"), F.when(F.col("l_returnflag") == "A", "yes").otherwise("no").alias("side"),
        F.when(F.col("l_discount") < 0.005, "sell").otherwise("buy").alias("action"), F.col("l_quantity").alias("count"),
        ((F.col("l_partkey") % 125 + 1) / 128).alias("price"), F.unix_seconds("l_shipdate").alias("pos"), "l_orderkey",
    )


# -- briefs and settlements on the user markets of ``snap`` -----------------------------------------------------------
USER_BRIEFS = """
user_briefs AS (
  SELECT snap_id AS brief_id, ticker, series, user_id, pos, sec, bid AS odds, ((31 * snap_id) % 65 + 63) / 128::DOUBLE AS confidence,
         CASE WHEN snap_id % 2 = 0 THEN 'yes' ELSE 'no' END AS recommended_side
  FROM snap WHERE event_type = 'signup'),
ticks AS (SELECT * FROM snap WHERE event_type <> 'signup'),
user_settled AS (
  SELECT DISTINCT ticker, CASE WHEN (user_id // 3) % 2 = 0 THEN 'yes' ELSE 'no' END AS result FROM snap WHERE user_id % 3 <> 0),
user_live AS (
  SELECT ticker, bid AS live_bid, ask AS live_ask FROM snap
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC, snap_id DESC) = 1)"""


def user_briefs(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-up events act as briefs of their user's market."""
    return snap(spark, sf).where(F.col("event_type") == "signup").select(
        F.col("snap_id").alias("brief_id"), "ticker", "series", "user_id", "pos", "sec", F.col("bid").alias("odds"),
        (hashed("snap_id", 31, 65, 63) / 128).alias("confidence"),
        F.when(F.col("snap_id") % 2 == 0, "yes").otherwise("no").alias("recommended_side"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """All other events are quotes."""
    return snap(spark, sf).where(F.col("event_type") != "signup")


def user_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three user markets are settled."""
    return snap(spark, sf).where(F.col("user_id") % 3 != 0).select(
        "ticker", F.when(F.floor(F.col("user_id") / 3) % 2 == 0, "yes").otherwise("no").alias("result")
    ).distinct()


def user_live(spark: SparkSession, sf: str) -> DataFrame:
    newest = latest_per_key(snap(spark, sf).select("ticker", "pos", "snap_id", "bid", "ask"), ["ticker"], "pos", "snap_id")
    return newest.select("ticker", F.col("bid").alias("live_bid"), F.col("ask").alias("live_ask"))


# -- vectors ----------------------------------------------------------------------------------------------------------
VECTORS = f"""
vec AS (
  SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN 'news' ELSE 'records' END AS collection, {EPOCH} + 600 * vec_id AS doc_time,
         embedding::DOUBLE[] AS v
  FROM embeddings),
asks AS (
  SELECT vec_id AS query_id, doc_time AS as_of, v AS qv FROM vec
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_time DESC, vec_id DESC) = 1),
pairs AS (
  SELECT query_id, as_of, collection, vec_id AS doc_id, doc_time,
         floor((1 - list_inner_product(qv, v) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(v, v)))) * 1000000000 + 0.5)
           / 1000000000 AS distance
  FROM asks, vec WHERE vec_id <> query_id)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "label", F.when(F.col("label") % 2 == 0, "news").otherwise("records").alias("collection"),
        (F.lit(EPOCH) + F.col("vec_id") * 600).alias("doc_time"), F.col("embedding").alias("vector"),
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The newest vector of every label asks for its neighbours."""
    return latest_per_key(vectors(spark, sf), ["label"], "doc_time", "doc_id").select(
        F.col("doc_id").alias("query_id"), F.col("doc_time").alias("as_of"), "vector"
    )
