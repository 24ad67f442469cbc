"""Articles and records: cleaning, velocity, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.functions.text import (
    first_date, first_number, record_sentence, runs_of, scrub_number, scrub_text, sentiment_label, unpack_names, unpack_places,
)
from sigloft.plans import enrich, lexicon as lexicon_plan, mentions
from sigloft.operators.keyed import latest_per_key
from sigloft.operators.velocity import cross_source
from sigloft.plans.serving import top_rows


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


KEYWORDS = f"""
article_words AS MATERIALIZED (
  SELECT feed_key, link, sec, sentiment_score AS tone, unnest(string_split(lower(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g')), ' ')) AS keyword
  FROM articles),
kw AS MATERIALIZED (SELECT * FROM article_words WHERE length(keyword) > 3 AND keyword NOT IN {in_list(fv.VELOCITY_STOPWORDS)} AND NOT regexp_matches(keyword, '^[0-9]')),
kw_anchor AS (SELECT max(sec) AS a FROM articles)"""


def _velocity_cte(name: str, source: str, keys: str, floor: int, anchor: str) -> str:
    return f"""
{name}_framed AS (
  SELECT {keys}, sec, count(*) OVER w15 AS v15, count(*) OVER w24 AS v24, avg(tone) OVER w15 AS t15, avg(tone) OVER w24 AS t24
  FROM {source} WHERE sec >= ({anchor}) - 86400
  WINDOW w15 AS (PARTITION BY {keys} ORDER BY sec RANGE BETWEEN 900 PRECEDING AND CURRENT ROW),
         w24 AS (PARTITION BY {keys} ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)),
{name}_profile AS (
  SELECT {keys}, max(v15) AS vol_15m, max(v24) AS vol_24h, arg_max(t15, sec) AS tone_15m, arg_max(t24, sec) AS tone_24h
  FROM {name}_framed GROUP BY {keys}),
{name}_base AS (SELECT {keys}, count(*) AS vol_90d FROM {source} WHERE sec >= ({anchor}) - 7776000 GROUP BY {keys}),
{name} AS MATERIALIZED (
  SELECT p.*, coalesce(vol_90d, 0) AS vol_90d,
         CASE WHEN coalesce(vol_90d, 0) >= {floor} THEN least(10.0::DOUBLE, vol_15m / (vol_90d / 8640.0::DOUBLE)) ELSE 0 END AS vol_spike_multiplier
  FROM {name}_profile p LEFT JOIN {name}_base b USING ({keys}))"""


KEYWORD_VELOCITY = _velocity_cte("kwv", "kw", "feed_key, keyword", fv.KEYWORD_BASELINE_FLOOR, "SELECT a FROM kw_anchor")
ENTITY_VELOCITY = _velocity_cte("env", "entity_mentions", "entity_type, entity_name", fv.ENTITY_BASELINE_FLOOR,
                                f"SELECT max({v.EPOCH} + 97 * doc_id) FROM documents")
SOURCE_VELOCITY = _velocity_cte("srv", "src", "feed_key", fv.SOURCE_BASELINE_FLOOR, "SELECT max(sec) FROM articles")
CROSS = """
crossed AS (
  SELECT keyword, max(tone_15m) - min(tone_15m) AS tone_divergence,
         greatest(count(*) FILTER (WHERE tone_15m < 0), count(*) FILTER (WHERE tone_15m > 0)) / count(feed_key) AS tone_consensus
  FROM kwv GROUP BY keyword)"""
_SHOWN = f"vol_15m, vol_24h, {fx('tone_15m', 6)} AS tone_15m, {fx('tone_24h', 6)} AS tone_24h, vol_90d, {fx('vol_spike_multiplier', 6)} AS vol_spike_multiplier"


def _shown(rows, *keys, extra=()):
    return rows.select(
        *keys, "vol_15m", "vol_24h", "vol_90d",
        *[fixed(c, 6).alias(c) for c in ("tone_15m", "tone_24h", "vol_spike_multiplier", *extra)],
    )


def article_velocity(spark, sf):
    rows = v.articles(spark, sf)
    return mentions.keyword_velocity(rows, rows.agg(F.max("sec")).scalar())


def timed_records(spark, sf):
    """Records with cleaned lists beside their time."""
    raw = v.raw_records(spark, sf)
    return raw.select(
        "sec", F.col("V2Tone").alias("raw_tone"), unpack_names(F.col("V2Persons")).alias("persons"),
        unpack_names(F.col("V2Themes")).alias("themes"), unpack_names(F.col("V2Organizations")).alias("orgs"),
        unpack_places(F.col("V2Locations")).alias("locs"),
    )


def record_velocity(spark, sf):
    rows = timed_records(spark, sf)
    return mentions.entity_velocity(rows, rows.agg(F.max("sec")).scalar())


@query("keyword_velocity", with_ctes(
    f"SELECT feed_key, keyword, {_SHOWN}, {fx('tone_divergence', 6)} AS tone_divergence, {fx('tone_consensus', 6)} AS tone_consensus "
    "FROM kwv JOIN crossed USING (keyword)", v.ARTICLES, KEYWORDS, KEYWORD_VELOCITY, CROSS))
def keyword_velocity(spark, sf):
    return _shown(article_velocity(spark, sf), "feed_key", "keyword", extra=("tone_divergence", "tone_consensus"))


@query("entity_velocity", with_ctes(f"SELECT entity_type, entity_name, {_SHOWN} FROM env", v.RECORDS, ENTITY_VELOCITY))
def entity_velocity(spark, sf):
    return _shown(record_velocity(spark, sf), "entity_type", "entity_name")


@query("source_velocity", with_ctes(f"SELECT feed_key, {_SHOWN} FROM srv", v.ARTICLES,
                                    "src AS (SELECT feed_key, sec, sentiment_score AS tone FROM articles)", SOURCE_VELOCITY))
def source_velocity(spark, sf):
    rows = v.articles(spark, sf).select("feed_key", "link", "sec", "sentiment_score")
    return _shown(mentions.source_velocity(rows, rows.agg(F.max("sec")).scalar()), "feed_key")


@query("cross_source_divergence", with_ctes(
    f"SELECT lang, {fx('max(m) - min(m)', 6)} AS tone_divergence, "
    f"{fx('greatest(count(*) FILTER (WHERE m < 0), count(*) FILTER (WHERE m > 0)) / count(feed_key)', 6)} AS tone_consensus "
    "FROM (SELECT lang, feed_key, avg(sentiment_score) AS m FROM articles GROUP BY ALL) GROUP BY lang", v.ARTICLES))
def cross_source_divergence(spark, sf):
    """Spread and agreement of the feeds' mean tone, per language."""
    means = v.articles(spark, sf).groupBy("lang", "feed_key").agg(F.avg("sentiment_score").alias("tone_15m"))
    crossed = cross_source(means, "lang", "feed_key")
    return crossed.select("lang", *[fixed(c, 6).alias(c) for c in ("tone_divergence", "tone_consensus")]).distinct()


@query("list_clean_explode", with_ctes(
    "SELECT entity_type, entity_name, count(*) AS mentions, count(DISTINCT doc_id) AS records, min(sec) AS first_sec FROM entity_mentions GROUP BY ALL",
    v.RECORDS))
def list_clean_explode(spark, sf):
    """Names unpacked from the landed lists, with mention and record counts."""
    rows = timed_records(spark, sf)
    seen = mentions.entity_mentions(rows).groupBy("entity_type", "entity_name", "sec").agg(F.count("*").alias("_n"))
    return seen.groupBy("entity_type", "entity_name").agg(
        F.sum("_n").cast("bigint").alias("mentions"), F.count("*").alias("records"), F.min("sec").alias("first_sec")
    )


@query("record_sentences", f"""
WITH t AS (SELECT doc_id, ((53 * doc_id) % 161 - 80) / 8::DOUBLE AS tone, string_split(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), ' ') AS w FROM documents),
l AS (SELECT doc_id, tone,
  list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 3)[1:5] AS p,
  list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]') AND length(x) >= 9)[1:5] AS th,
  list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]') AND length(x) BETWEEN 7 AND 8)[1:4] AS o FROM t)
SELECT 'r-' || doc_id AS record_id, concat_ws('. ',
  CASE WHEN len(p) > 0 THEN 'People involved: ' || array_to_string(list_transform(p, lambda x: upper(x[1:1]) || lower(x[2:])), ', ') END,
  CASE WHEN len(th) > 0 THEN 'Themes: ' || array_to_string(list_transform(th, lambda x: upper(x[1:1]) || lower(x[2:])), ', ') END,
  CASE WHEN len(o) > 0 THEN 'Organizations: ' || array_to_string(list_transform(o, lambda x: upper(x[1:1]) || lower(x[2:])), ', ') END,
  'Tone: ' || CASE WHEN tone > 1 THEN 'positive' WHEN tone < -1 THEN 'negative' ELSE 'neutral' END) AS sentence
FROM l""")
def record_sentences(spark, sf):
    """A readable sentence per record."""
    rows = enrich.clean_records(v.raw_records(spark, sf))
    return rows.select("record_id", record_sentence(
        F.col("persons"), F.col("themes"), F.col("orgs"), first_number(F.col("raw_tone"))).alias("sentence"))


_LEXICON = """
lexicon AS (
  SELECT word, ((ascii(word) * 7 + length(word) * 3) % 17 - 8) / 4::DOUBLE AS valence
  FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g')), ' +')) AS word FROM benchmark) WHERE word <> ''),
doc_words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g')), ' +')) AS word FROM documents),
doc_sum AS (SELECT doc_id, sum(valence) AS s FROM doc_words JOIN lexicon USING (word) GROUP BY doc_id)"""


def _lexicon(spark, sf):
    words = v.table(spark, sf, "benchmark").select(F.explode(runs_of(F.col("text"), "[a-zA-Z0-9]+")).alias("word"))
    return words.select(F.lower("word").alias("word")).distinct().withColumn("valence", ((F.ascii("word") * 7 + F.length("word") * 3) % 17 - 8) / 4)


@query("lexicon_sentiment", with_ctes(f"""
SELECT doc_id, {fx('s / sqrt(s * s + 15)', 6)} AS sentiment_score,
       CASE WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'Positive' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label
FROM (SELECT doc_id, coalesce(s, 0) AS s FROM documents LEFT JOIN doc_sum USING (doc_id))""", _LEXICON))
def lexicon_sentiment(spark, sf):
    """Documents scored with a word list (here: the benchmark words with a valence by rule)."""
    scored = enrich.lexicon_sentiment(v.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _lexicon(spark, sf))
    return scored.withColumn("sentiment_score", fixed("sentiment_score", 6))


_DENY = (*fv.NEGATIONS, "of", "die", "que")
_DEGREES = fv.DEGREES | {"in": fv.MORE, "on": fv.LESS, "le": fv.MORE, "zu": fv.LESS}
_CONTRAST = "and"


def _any_of(word: str, words) -> str:
    return f"coalesce({word} IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "), false)"


def _caps(word: str) -> str:
    return f"(regexp_matches({word}, '[A-Z]') AND NOT regexp_matches({word}, '[a-z\u00df-\u00ff]'))"


def _before(k: int) -> str:
    """One step of the rules in SQL: from valence v{k-1} to v{k}, by the word k places before."""
    word, old, far = f"lower(w{k})", f"v{k - 1}", fv.DISTANCE[k - 1]
    degree = f"CASE WHEN {_any_of(word, [w for w, x in _DEGREES.items() if x > 0])} THEN {fv.MORE}::DOUBLE WHEN {_any_of(word, [w for w, x in _DEGREES.items() if x < 0])} THEN {fv.LESS}::DOUBLE END"
    loud = f"CASE WHEN {_caps(f'w{k}')} AND emphasis THEN CASE WHEN {old} > 0 THEN {fv.CAPITALS}::DOUBLE ELSE -{fv.CAPITALS}::DOUBLE END ELSE 0 END"
    step = f"({old} + coalesce((CASE WHEN {old} < 0 THEN -({degree}) ELSE {degree} END + {loud}) * {far}::DOUBLE, 0))"
    nearer = [f"lower(w{j})" for j in range(1, k)]
    special = "" if k == 1 else (
        f"WHEN coalesce({word} = 'never', false) AND ({' OR '.join(_any_of(w, ('so', 'this')) for w in nearer)}) THEN {step} * {fv.NEVER_SO}::DOUBLE "
        f"WHEN coalesce({word} = 'without', false) AND ({' OR '.join(_any_of(w, ('doubt',)) for w in nearer)}) THEN {step} ")
    deny = f"WHEN {_any_of(word, _DENY)} OR coalesce(contains({word}, 'n''t'), false) THEN {step} * ({fv.DENIAL}::DOUBLE)"
    return f"CASE WHEN w{k} IS NULL OR known{k} THEN {old} {special} {deny} ELSE {step} END AS v{k}"


_SENTENCES = f"""
split AS (
  SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> ''),
    lambda x: CASE WHEN length(trim(x, '{fv.SIGNS.replace("'", "''")}')) <= 2 THEN x ELSE trim(x, '{fv.SIGNS.replace("'", "''")}') END) AS w FROM documents),
whole AS (SELECT *, nullif(list_position(list_transform(w, lambda x: lower(x)), '{_CONTRAST}'), 0) AS turn, len(list_filter(w, lambda x: {_caps('x')})) AS loud FROM split),
placed AS (SELECT doc_id, turn, loud > 0 AND loud < len(w) AS emphasis, i, w[i] AS w0, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w2,
    CASE WHEN i > 3 THEN w[i - 3] END AS w3 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM whole)),
met AS (SELECT p.*, valence FROM placed p JOIN lexicon l ON l.word = lower(p.w0)),
neighbours AS (SELECT *, lag(i, 1) OVER o AS p1, lag(i, 2) OVER o AS p2, lag(i, 3) OVER o AS p3 FROM met WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
known AS (SELECT *, {', '.join(f"coalesce(p1 = i - {k}, false) OR coalesce(p2 = i - {k}, false) OR coalesce(p3 = i - {k}, false) AS known{k}" for k in (1, 2, 3))},
    CASE WHEN {_caps('w0')} AND emphasis THEN valence + CASE WHEN valence > 0 THEN {fv.CAPITALS}::DOUBLE ELSE -{fv.CAPITALS}::DOUBLE END ELSE valence END AS v0 FROM neighbours),
s1 AS (SELECT *, {_before(1)} FROM known), s2 AS (SELECT *, {_before(2)} FROM s1), s3 AS (SELECT *, {_before(3)} FROM s2),
summed AS (SELECT doc_id, sum(floor((CASE WHEN coalesce(lower(w1) = 'least', false) AND NOT known1 AND NOT {_any_of('lower(w2)', ('at', 'very'))} THEN v3 * ({fv.DENIAL}::DOUBLE) ELSE v3 END)
    * CASE WHEN i < turn THEN 0.5 WHEN i > turn THEN 1.5 ELSE 1.0 END::DOUBLE * 1e6::DOUBLE + 0.5)::BIGINT) AS total FROM s3 GROUP BY doc_id),
pushed AS (SELECT doc_id, coalesce(total, 0)::DOUBLE / 1e6 AS s, least(length(text) - length(replace(text, '!', '')), 4) * {fv.EXCLAMATION}::DOUBLE
    + CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN {fv.MANY_QUESTIONS}::DOUBLE
           WHEN length(text) - length(replace(text, '?', '')) > 1 THEN (length(text) - length(replace(text, '?', ''))) * {fv.QUESTION}::DOUBLE ELSE 0 END AS marks
  FROM documents LEFT JOIN summed USING (doc_id)),
scores AS (SELECT doc_id, s / sqrt(s * s + 15) AS score FROM (SELECT doc_id, CASE WHEN s > 0 THEN s + marks WHEN s < 0 THEN s - marks ELSE 0 END AS s FROM pushed))"""


@query("sentence_sentiment", with_ctes(f"""
SELECT doc_id, {fx('score', 6)} AS sentiment_score, CASE WHEN score >= 0.05 THEN 'Positive' WHEN score <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label FROM scores""",
    _LEXICON.split("doc_words AS")[0].rstrip().rstrip(","), _SENTENCES))
def sentence_sentiment(spark, sf):
    """Documents scored by the position rules. Beside the published words some frequent ones of the documents deny or tell a degree, so that the rules have work."""
    scored = lexicon_plan.sentence_sentiment(v.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _lexicon(spark, sf), _DENY, _DEGREES, _CONTRAST)
    return scored.withColumn("sentiment_score", fixed("sentiment_score", 6))


@query("feed_articles", with_ctes(f"""
SELECT feed_key, count(*) AS article_count, {fx('avg(sentiment_score)', 6)} AS avg_sentiment FROM articles WHERE lower(title) LIKE '%tion%' GROUP BY feed_key""", v.ARTICLES))
def feed_articles(spark, sf):
    rows = v.articles(spark, sf).where(F.lower("title").contains("tion"))
    return rows.groupBy("feed_key").agg(F.count("*").alias("article_count"), fixed(F.avg("sentiment_score"), 6).alias("avg_sentiment"))


@query("top_impact", with_ctes("SELECT event_id, code, impact, tone FROM tones ORDER BY abs(impact) DESC, event_id LIMIT 10", v.TONES))
def top_impact(spark, sf):
    """The ten events of the largest impact, either sign."""
    return v.tones(spark, sf).select("event_id", "code", "impact", "tone").orderBy(F.abs("impact").desc(), "event_id").limit(10)


@query("top_deduplicated", with_ctes("""
SELECT event_id, code, user_id, impact FROM (SELECT * FROM tones QUALIFY row_number() OVER (PARTITION BY user_id, code ORDER BY sec DESC, event_id DESC) = 1)
ORDER BY abs(impact) DESC, event_id LIMIT 20""", v.TONES))
def top_deduplicated(spark, sf):
    """The twenty strongest events after each user's events of a code are reduced to the newest."""
    once = latest_per_key(v.tones(spark, sf), ["user_id", "code"], "sec", "event_id")
    return top_rows(once.select("event_id", "code", "user_id", "impact"), [F.abs("impact").desc(), F.col("event_id")], 20)


@query("date_multi_parse", f"""
SELECT doc_id, CASE doc_id % 8 WHEN 6 THEN {v.EPOCH} + 97 * doc_id WHEN 7 THEN NULL
  WHEN 4 THEN ({v.EPOCH} + 97 * doc_id) // 86400 * 86400 WHEN 5 THEN ({v.EPOCH} + 97 * doc_id) // 86400 * 86400
  WHEN 1 THEN {v.EPOCH} + 97 * doc_id - 19800 ELSE {v.EPOCH} + 97 * doc_id END AS published_sec FROM documents""")
def date_multi_parse(spark, sf):
    """Publish times written in eight ways over three candidate columns."""
    at = F.timestamp_seconds(F.lit(v.EPOCH) + F.col("doc_id") * 97)
    kind = F.col("doc_id") % 8
    text = (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss '+0530'"))
        .when(kind == 2, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 4, F.date_format(at, "MMMM d, yyyy")).when(kind == 5, F.date_format(at, "MM/dd/yyyy"))
        .when(kind == 6, F.lit("not a date")).otherwise(F.lit("  "))
    )
    rows = v.table(spark, sf, "documents").select(
        "doc_id", text.alias("published_at"), F.when(kind == 6, F.date_format(at, "dd MMM yyyy HH:mm:ss 'EST'")).alias("pubDate"),
        F.lit(None).cast("string").alias("date"),
    )
    when = first_date(F.col("published_at"), F.col("pubDate"), F.col("date"))
    return rows.select("doc_id", F.unix_seconds(when).alias("published_sec"))


@query("text_pick", """
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'full_text' WHEN doc_id % 4 = 2 THEN 'summary' ELSE 'title' END AS sentiment_source,
       length(CASE WHEN doc_id % 4 < 2 THEN text WHEN doc_id % 4 = 2 THEN 'S ' || text ELSE source END) AS picked_chars FROM documents""")
def text_pick(spark, sf):
    """The scored text is the body, else the summary, else the title."""
    kind = F.col("doc_id") % 4
    rows = v.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.when(kind < 2, F.col("text")).when(kind == 2, "  ").alias("full_text"),
        F.when(kind <= 2, F.concat(F.lit("S "), F.col("text"))).otherwise("").alias("summary"),
    )
    picked = enrich.article_text(rows)
    return picked.select("doc_id", "sentiment_source", F.length("picked_text").cast("bigint").alias("picked_chars"))


@query("sentinel_scrub", """
SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN NULL ELSE source END AS clean_source,
       CASE WHEN doc_id % 5 < 2 THEN NULL ELSE doc_id / 4 END AS clean_score FROM documents""")
def sentinel_scrub(spark, sf):
    """Placeholder texts and not-a-number values become null."""
    text = v.pick(F.col("doc_id") % 6, ("NaN", " none ", "NaT", "", "keep", "keep"))
    number = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("doc_id") / 4)
    rows = v.table(spark, sf, "documents").select(
        "doc_id", F.when(text == "keep", F.col("source")).otherwise(text).alias("source"), number.alias("score")
    )
    return rows.select("doc_id", scrub_text(F.col("source")).alias("clean_source"), scrub_number(F.col("score")).alias("clean_score"))


@query("sentiment_labels", with_ctes("""
SELECT CASE WHEN sentiment_score >= 0.05 THEN 'Positive' WHEN sentiment_score <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label,
       count(*) AS articles FROM articles GROUP BY 1""", v.ARTICLES))
def sentiment_labels(spark, sf):
    return v.articles(spark, sf).groupBy(sentiment_label(F.col("sentiment_score")).alias("sentiment_label")).agg(F.count("*").alias("articles"))
