"""Text, list and date expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import blank_to_null


def cut_out(text: Column, pattern: str, joint: str = "") -> Column:
    """Every match of the pattern replaced by plain text, by splitting and joining."""
    return F.array_join(F.split(text, pattern), joint)


def runs_of(text: Column, pattern: str) -> Column:
    """All matches of the pattern, in order. Collecting the long wanted runs takes a third of the time of replacing the
    many unwanted characters between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# -- headlines ------------------------------------------------------------------------------------------------------
def headline_words(title: Column) -> Column:
    """Lower-case words after all characters but letters, digits and blanks are taken out."""
    return F.split(F.lower(F.array_join(runs_of(title, "[a-zA-Z0-9 ]+"), "")), " ")


def is_topic(word: Column, stopwords: tuple[str, ...], digits_lead: bool) -> Column:
    keep = (F.length(word) > 3) & ~word.isin(*stopwords)
    return keep if digits_lead else keep & ~word.rlike("^[0-9]")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """One alternation over the lower-cased text instead of one scan per word."""
    escaped = "|".join(w.replace(".", "\\.") for w in words)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(escaped)


def series_theme(ticker: Column, title: Column) -> Column:
    """First matching keyword decides; otherwise the series prefix of the ticker."""
    text = F.lower(F.coalesce(title, F.lit("")))
    chain = reduce(
        lambda c, kt: c.when(text.contains(kt[0]), kt[1]),
        fv.THEME_KEYWORDS[1:],
        F.when(text.contains(fv.THEME_KEYWORDS[0][0]), fv.THEME_KEYWORDS[0][1]),
    )
    prefix = F.lower(F.trim(F.split_part(F.coalesce(ticker, F.lit("")), F.lit("-"), F.lit(1))))
    return chain.otherwise(F.coalesce(blank_to_null(prefix), F.lit("untagged")))


# -- articles -------------------------------------------------------------------------------------------------------
def pick_text(full_text: Column, summary: Column, title: Column) -> Column:
    """struct(text, source): the first of the three that is not blank, title as the last resort."""
    return (
        F.when(blank_to_null(full_text).isNotNull(), F.struct(full_text.alias("text"), F.lit("full_text").alias("source")))
        .when(blank_to_null(summary).isNotNull(), F.struct(summary.alias("text"), F.lit("summary").alias("source")))
        .otherwise(F.struct(F.coalesce(title, F.lit("")).alias("text"), F.lit("title").alias("source")))
    )


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.05, "Positive").when(score <= -0.05, "Negative").otherwise("Neutral")


def scrub_text(value: Column) -> Column:
    """Placeholders such as 'NaN' or blanks become null."""
    return F.when(~F.lower(F.trim(value)).isin(*fv.MISSING_MARKERS), value)


def scrub_number(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_when(text: Column) -> Column:
    """Free-form date text to an instant; text without a zone is UTC, unreadable text is null.

    ISO forms go through the built-in cast. Mail-style dates lose the weekday first, because the pattern letters
    for weekdays are refused when parsing; zone names other than GMT/UTC count as UTC.
    """
    bare = F.regexp_replace(F.trim(text), "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\\s+", "")
    zoned = F.regexp_replace(bare, "\\s*(GMT|UTC|Z)$", " +0000")
    unzoned = F.regexp_replace(bare, "\\s+[A-Z]{2,5}$", "")
    attempts = [F.trim(text).try_cast("timestamp")]
    attempts += [F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")]
    attempts += [
        F.try_to_timestamp(unzoned, F.lit(p))
        for p in (
            "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMM d, yyyy HH:mm",
            "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy",
        )
    ]
    return F.coalesce(*attempts)


def first_date(*candidates: Column) -> Column:
    """The first candidate column that can be read as a date."""
    return F.coalesce(*[parse_when(blank_to_null(c)) for c in candidates])


def page_text(html: Column) -> Column:
    """Visible paragraph text of a page: scripts, styles, navigation and tags removed, spaces collapsed."""
    body = html
    for block in ("script", "style", "nav", "head", "footer"):
        body = cut_out(body, f"(?is)<{block}[ >].*?</{block}>", " ")
    body = cut_out(body, "(?s)<!--.*?-->", " ")
    body = cut_out(body, "(?s)<[^>]*>", " ")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(mark), F.lit(char))
    return F.trim(cut_out(body, "[ \\t\\n\\r]+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1))


# -- packed lists ---------------------------------------------------------------------------------------------------
def unpack_names(packed: Column) -> Column:
    """'Name,12;Other,40' -> [Name, Other]; null stays null."""
    names = F.transform(F.split(packed, ";"), lambda x: F.substring_index(x, ",", 1))
    return F.filter(names, lambda x: x != "")


def unpack_places(packed: Column) -> Column:
    """'1#Name#CC#...;4#Other#CC#...' -> [Name, Other]; blocks without '#' keep their text up to the comma."""
    names = F.transform(
        F.split(packed, ";"),
        lambda x: F.when(x.contains("#"), F.split_part(x, F.lit("#"), F.lit(2))).otherwise(F.substring_index(x, ",", 1)),
    )
    return F.filter(names, lambda x: x != "")


def has_theme(packed: Column, prefixes: tuple[str, ...]) -> Column:
    pattern = "^(" + "|".join(prefixes) + ")"
    return F.coalesce(F.exists(F.split(packed, ";"), lambda x: x.rlike(pattern)), F.lit(False))


def first_number(packed: Column) -> Column:
    return F.split_part(packed, F.lit(","), F.lit(1)).try_cast("double")


def record_sentence(persons: Column, themes: Column, orgs: Column, tone: Column) -> Column:
    """A readable sentence from the first names of each list."""

    def part(label: str, names: Column, n: int, unscore: bool) -> Column:
        clean = F.filter(names, lambda x: F.trim(x) != "")
        shown = F.transform(
            F.slice(clean, 1, n),
            lambda x: F.initcap(F.replace(F.trim(x), F.lit("_"), F.lit(" ")) if unscore else F.trim(x)),
        )
        return F.when(F.size(clean) > 0, F.concat(F.lit(f"{label}: "), F.array_join(shown, ", ")))

    mood = F.when(tone > 1, "positive").when(tone < -1, "negative").otherwise("neutral")
    return F.concat_ws(
        ". ",
        part("People involved", persons, 5, False),
        part("Themes", themes, 5, True),
        part("Organizations", orgs, 4, False),
        F.concat(F.lit("Tone: "), mood),
    )


def joined_text(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(p, F.lit("")) for p in parts])


def bill_key(congress: Column, kind: Column, number: Column, action_date: Column) -> Column:
    return F.concat_ws(
        "_",
        congress.cast("string"),
        F.lower(F.coalesce(kind, F.lit("UNKNOWN"))),
        F.coalesce(number, F.lit("0")),
        F.coalesce(action_date, F.lit("0000-00-00")),
    )


# -- event codes ----------------------------------------------------------------------------------------------------
def pad_code(code: Column) -> Column:
    """One-digit codes get a leading zero; longer codes are kept (``lpad`` alone would cut them)."""
    return F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)


def event_class(root_code: Column) -> Column:
    root = root_code.try_cast("int")
    return (
        F.when(root.between(1, 5), "1").when(root.between(6, 8), "2").when(root.between(9, 14), "3")
        .when(root.between(15, 20), "4").otherwise("0")
    )


# -- verdicts -------------------------------------------------------------------------------------------------------
def verdict_is_usable(verdict: Column) -> Column:
    text = F.trim(verdict)
    return (
        verdict.isNotNull() & ~verdict.contains("Error") & ~verdict.contains("GHOST PUMP") & (verdict != "")
        & ~F.lower(text).isin(*fv.EMPTY_VERDICTS) & (F.length(text) > 5)
    )


def side_from_verdict(verdict: Column, odds_delta: Column) -> Column:
    text = F.lower(F.coalesce(verdict, F.lit("")))
    return (
        F.when(text.contains("buy no"), "no").when(text.contains("buy yes"), "yes")
        .when(F.coalesce(odds_delta, F.lit(0.0)) < -0.05, "no").otherwise("yes")
    )


def stated_side(side: Column, verdict: Column) -> Column:
    """The named side, else the one in the verdict; null when neither names one."""
    named = F.lower(F.trim(side))
    text = F.lower(verdict)
    return F.when(named.isin("yes", "no"), named).when(text.contains("buy no"), "no").when(text.contains("buy yes"), "yes")


def _looks_nested(text: Column) -> Column:
    return F.coalesce(text.rlike("^\\s*[{\\[]"), F.lit(False))


def _as_piece(text: Column, is_open: Column, in_list: Column) -> Column:
    return F.struct(text.alias("text"), is_open.alias("open"), in_list.alias("in_list"))


def _piece(raw: Column, typed: Column, in_list: Column) -> Column:
    """A value inside JSON as struct(text, open, in_list); ``open``: it is nested and not taken apart yet."""
    kind = F.coalesce(F.schema_of_variant(typed), F.lit("VOID"))
    shown = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(raw)).otherwise(raw)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY") | ((kind == "STRING") & _looks_nested(raw))
    return _as_piece(shown, F.coalesce(nested, F.lit(False)), in_list)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _object_pieces(text: Column, in_list: Column) -> Column:
    """The value of the first telling key of an object, else all its values, tags in brackets and blanks left out."""

    def of(both: Column) -> Column:
        raw, typed = both["raw"], both["typed"]
        telling = F.filter(F.array(*map(F.lit, fv.TEXT_KEYS)), lambda k: F.map_contains_key(raw, k))
        only = in_list & (F.size(F.map_keys(raw)) == 1)

        def value(key: Column) -> Column:
            piece = _piece(raw[key], typed[key], only)
            tag = _as_piece(F.concat(F.lit("["), F.upper(piece["text"]), F.lit("]")), F.lit(False), F.lit(False))
            return F.when(key.isin(*fv.TAG_KEYS), tag).otherwise(piece)

        values = F.filter(F.transform(F.map_keys(raw), value), lambda p: p["open"] | (p["text"] != ""))
        blank = F.array(_as_piece(F.lit(""), F.lit(False), in_list))
        first = F.get(telling, F.lit(0))
        return (
            F.when(F.size(telling) > 0, F.array(_piece(raw[first], typed[first], in_list)))
            .when(F.size(values) == 0, blank).otherwise(values)
        )

    return _bound(F.struct(F.from_json(text, "map<string,string>").alias("raw"), F.from_json(text, "map<string,variant>").alias("typed")), of)


def _list_pieces(text: Column, in_list: Column) -> Column:
    """The elements of a list, in order; a list without any is one blank."""

    def of(both: Column) -> Column:
        pieces = F.zip_with(both["raw"], both["typed"], lambda r, t: _piece(r, t, F.lit(True)))
        return F.when(F.size(pieces) == 0, F.array(_as_piece(F.lit(""), F.lit(False), in_list))).otherwise(pieces)

    return _bound(F.struct(F.from_json(text, "array<string>").alias("raw"), F.from_json(text, "array<variant>").alias("typed")), of)


def _one_level(pieces: Column) -> Column:
    """Every open piece replaced by what it consists of; one that is no JSON after all stays as it is."""

    def apart(p: Column) -> Column:
        text, in_list = p["text"], p["in_list"]
        inside = F.when(F.ltrim(text).startswith("{"), _object_pieces(text, in_list)).otherwise(_list_pieces(text, in_list))
        plain = F.array(_as_piece(text, F.lit(False), in_list))
        return F.when(~p["open"], F.array(p)).when(F.try_parse_json(text).isNull(), plain).otherwise(inside)

    return F.flatten(F.transform(pieces, apart))


def readable(text: Column) -> Column:
    """Nested JSON text, also JSON inside JSON strings, to one readable line; other text as it is.

    The text is a list of pieces that is taken apart level by level until none is open. A level costs at least one opening bracket, so
    their number bounds the rounds; rounds after the last level do nothing.
    """
    start = F.array(_as_piece(text, F.lit(True), F.lit(True)))
    rounds = F.sequence(F.lit(1), F.length(text) - F.length(F.translate(text, "{[", "")) + 1)

    def step(state: Column, _: Column) -> Column:
        deeper = _bound(_one_level(state["pieces"]), lambda p: F.struct(p.alias("pieces"), F.exists(p, lambda x: x["open"]).alias("open")))
        return F.when(state["open"], deeper).otherwise(state)

    done = F.reduce(rounds, F.struct(start.alias("pieces"), F.lit(True).alias("open")), step, lambda s: s["pieces"])
    shown = F.filter(done, lambda p: p["in_list"] | (p["text"] != ""))
    return F.when(_looks_nested(text), F.array_join(F.transform(shown, lambda p: p["text"]), " ")).otherwise(text)


def answer_fields(answer: Column) -> Column:
    """A model answer in JSON as a struct; an answer that cannot be read keeps its text as the reason and confidence 50 %.

    The stated percentage may be a number or text; anything else counts as 50.
    """
    get = lambda key: F.get_json_object(answer, f"$.{key}")
    readable_json = F.try_parse_json(answer).isNotNull() & F.trim(answer).startswith("{")
    percent = F.coalesce(F.when(readable_json, get("confidence_pct").try_cast("double")), F.lit(50.0))
    return F.struct(
        readable_json.alias("parsed"),
        F.when(readable_json, F.coalesce(get("verdict"), F.lit(""))).otherwise("Error: unreadable answer").alias("verdict"),
        F.when(readable_json, F.lower(F.trim(get("recommended_side")))).alias("side"),
        (percent / 100.0).alias("confidence"),
    )
