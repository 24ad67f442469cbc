"""SQL text of the sizing and side rules, for the checks."""

from __future__ import annotations

from sigloft.catalog.registry import fx
from sigloft.functions import fixed_values as fv


def kelly_sql(conf: str, price: str, bankroll: float, resolved: str | None = None, days: str | None = None) -> dict[str, str]:
    win = f"(0.5::DOUBLE + 0.5::DOUBLE * ({conf} - 0.5::DOUBLE))"
    full = f"({win} - (1 - {win}) / ((1 - {price}) / {price}))"
    edge = f"coalesce({price} > 0 AND {price} < 1 AND {conf} > 0 AND {full} > 0, false)"
    short = f"coalesce({days} < 7, false)" if days else "false"
    unproven = f"coalesce({resolved} < 20, false)" if resolved else "false"
    flat = f"({unproven} OR {conf} < 0.7::DOUBLE)"
    share = f"least({full} * 0.25::DOUBLE, CASE WHEN {short} THEN 0.025::DOUBLE ELSE 0.05::DOUBLE END)"
    sized = fx(f"{share} * {bankroll}::DOUBLE", 2)
    bet = f"(CASE WHEN {flat} THEN least({sized}, 10::DOUBLE) ELSE {sized} END)"
    capped = f"(CASE WHEN {flat} THEN {fx(f'{bet} / {bankroll}::DOUBLE', 6)} ELSE {share} END)"
    on_edge = lambda e: f"CASE WHEN {edge} THEN {e} ELSE 0 END"
    return {
        "edge": edge, "fraction": on_edge(fx(full)), "quarter": on_edge(fx(f"{full} * 0.25::DOUBLE")),
        "capped": on_edge(fx(capped)), "bet": on_edge(bet), "win": fx(win), "short": f"({edge} AND {short})",
        "rails": f"CASE WHEN {edge} THEN concat_ws(',', CASE WHEN {short} THEN 'short_dated' END, CASE WHEN {unproven} THEN 'uncalibrated' END, "
                 f"CASE WHEN {conf} < 0.7::DOUBLE THEN 'low_confidence' END) ELSE '' END",
    }


def theme_sql(ticker: str, title: str) -> str:
    whens = " ".join(f"WHEN contains(lower({title}), '{k}') THEN '{t}'" for k, t in fv.THEME_KEYWORDS)
    return f"(CASE {whens} ELSE lower(split_part({ticker}, '-', 1)) END)"


USABLE = (
    "verdict IS NOT NULL AND NOT contains(verdict, 'Error') AND NOT contains(verdict, 'GHOST PUMP') AND verdict <> '' "
    f"AND lower(trim(verdict)) NOT IN {tuple(fv.EMPTY_VERDICTS)} AND length(trim(verdict)) > 5"
)
NAMED = "verdict IS NOT NULL AND NOT contains(verdict, 'Error') AND verdict <> '' AND recommended_side IN ('yes', 'no')"
