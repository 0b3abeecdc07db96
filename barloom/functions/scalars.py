"""Column helpers: numbers, text, dates and status arrays."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdicts from worst to best, with their severity.
VERDICT_SEVERITY = {
    "RED_DATA_OR_MODEL_ERROR": 0,
    "RED_DATA_INSUFFICIENT": 0,
    "ZERO_RISK_PLAN_FAILED": 0,
    "RED_NOT_RECOMMENDED": 1,
    "AMBER_REVIEW_ONLY": 2,
    "AMBER_WATCHLIST": 2,
    "ELIGIBLE_RECOMMENDATION": 3,
    "ACCUMULATE_RECOMMENDATION": 3,
}

# The coefficients of Acklam's inverse normal distribution.
_PPF_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
_PPF_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
_PPF_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_PPF_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NaN and infinite values become ``low``."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(low)), F.lit(high))).otherwise(F.lit(low))


def bounded(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is zero."""
    return x / F.nullif(y, F.lit(0.0))


def change(now: Column, then: Column) -> Column:
    return ratio(now, then) - 1.0


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson's r of the rows that have both; null without variance. ``over``: a window."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    of = (lambda f: f) if over is None else (lambda f: f.over(over))
    scale = of(F.stddev_pop(a)) * of(F.stddev_pop(b))
    return F.when(scale > 1e-24, of(F.covar_pop(a, b)) / F.nullif(scale, F.lit(0.0)))


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def normal_cdf(x: Column) -> Column:
    """Hart's rational approximation, to about 1e-15, as Spark has no error function."""
    a = F.abs(x)
    top = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
    low = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
    tail = F.exp(-a * a / 2) * _horner(top, a) / _horner(low, a)
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, tail).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def normal_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function, to about 1e-9; null outside (0, 1)."""
    q, edge = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    r = q * q
    middle = _horner(_PPF_A, r) * q / _horner((*_PPF_B, 1.0), r)
    tail = _horner(_PPF_C, edge) / _horner((*_PPF_D, 1.0), edge)
    inside = F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(middle)
    return F.when((p > 0) & (p < 1), inside)


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    pairs = F.create_map(*(F.lit(x) for item in table.items() for x in item))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def normalised(x: Column) -> Column:
    """Upper case with underscores."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(x.cast("string"), F.lit("")))), "[- ]", "_")


def strip_market(ticker: Column) -> Column:
    return F.regexp_replace(ticker, r"\.(KS|KQ)$", "")


def is_krx(ticker: Column) -> Column:
    return F.upper(ticker).endswith(".KS") | F.upper(ticker).endswith(".KQ")


def mentions(ticker: Column, text: Column) -> Column:
    """The ticker as a word, in any case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?i)\b\Q"), ticker, F.lit(r"\E\b")))


def to_utc(moment: Column, zone: str) -> Column:
    """A local wall-clock time of ``zone`` as UTC without a zone."""
    return F.to_utc_timestamp(moment.cast("timestamp"), zone).cast("timestamp_ntz")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def period_start(period: str, today: date) -> date:
    """First day of "5d", "6mo", "1y", "ytd" or "max", counted back from ``today``."""
    text = period.strip().lower()
    if text == "max":
        return date(1900, 1, 1)
    if text == "ytd":
        return date(today.year, 1, 1)
    m = re.fullmatch(r"(\d+)(d|wk|mo|y)", text)
    if not m:
        raise ValueError(f"no period: {period!r}")
    n = int(m[1])
    days = {"d": 1, "wk": 7, "mo": 30, "y": 365}[m[2]]
    return today - timedelta(days=n * days)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y", "t", "on"), F.lit(False))


def falsy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("false", "0", "no", "n", "f", "off"), F.lit(False))


def first_number(*xs: Column) -> Column:
    return F.coalesce(*(x.cast("string").try_cast("double") for x in xs))


def first_object(text: Column) -> Column:
    """The first {...} of a text, from the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def spread(values: Column) -> Column:
    """Range of an array without its nulls; null for fewer than two."""
    v = F.array_compact(values)
    return F.when(F.size(v) >= 2, F.array_max(v) - F.array_min(v))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for when, name in rules)))


def severity(verdict: Column) -> Column:
    return lookup(verdict, VERDICT_SEVERITY, 0)


def worst_verdict(a: Column, b: Column) -> Column:
    return F.when(severity(a) <= severity(b), a).otherwise(b)


def mask_secrets(text: Column, key: Column | None = None) -> Column:
    """Values of sensitive keys, ``name=value`` pairs of such names, and bearer tokens become ***."""
    names = "api[_-]?key|token|secret|password|passwd|authorization|credential"
    out = F.regexp_replace(text, rf"(?i)\b([\w-]*(?:{names})[\w-]*)\s*[=:]\s*[^\s,;&]+", "$1=***")
    out = F.regexp_replace(out, r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer ***")
    return out if key is None else F.when(key.rlike(f"(?i){names}"), F.lit("***")).otherwise(out)


def stable_sha(*xs: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*xs)), 256)


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.25, "bullish").when(score <= -0.25, "bearish").otherwise("neutral")


def expected_value_pct(prob: Column, reward: Column, risk: Column) -> Column:
    return (prob * reward - (1 - prob) * risk) * 100
