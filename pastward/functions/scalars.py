"""Column expressions: outcomes, guarded arithmetic, text keys, lenient parsing."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class labels in their fixed order, and points per result.
HOME, DRAW, AWAY = "H", "D", "A"
LABELS = (HOME, DRAW, AWAY)
WIN_POINTS, DRAW_POINTS, LOSS_POINTS = 3, 1, 0

# Accepted spellings of truth values and of missing text.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
MISSING_WORDS = ("", "nan", "None")


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def outcome(goals_for, goals_against) -> Column:
    """H, D or A seen from the first side."""
    a, b = _c(goals_for), _c(goals_against)
    return F.when(a > b, HOME).when(a < b, AWAY).when(a == b, DRAW)


def points_for(goals_for, goals_against) -> Column:
    a, b = _c(goals_for), _c(goals_against)
    return (
        F.when(a > b, F.lit(WIN_POINTS)).when(a == b, F.lit(DRAW_POINTS)).when(a < b, F.lit(LOSS_POINTS))
    )


def event_time(kickoff, date) -> Column:
    """Start of the event; midnight of its date where no start is known."""
    return F.coalesce(_c(kickoff), _c(date).cast("timestamp"))


def half_up(value, scale: int) -> Column:
    """Round in decimal, half away from zero, so that engines agree on ties."""
    return F.round(_c(value).cast("decimal(38,10)"), scale).cast("double")


def ratio(numerator, denominator, scale: int | None = None) -> Column:
    """Quotient, NULL for a zero denominator."""
    quotient = F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))
    return quotient if scale is None else half_up(quotient, scale)


def zero_if_undefined(numerator, denominator) -> Column:
    """Quotient, 0 for a zero denominator."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def clip(value, low=None, high=None) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    col = _c(value)
    limited = col
    if low is not None:
        limited = F.greatest(limited, F.lit(low))
    if high is not None:
        limited = F.least(limited, F.lit(high))
    return F.when(col.isNotNull(), limited)


def diff_or_null(left, right) -> Column:
    return _c(left) - _c(right)


def max_or_null(*values) -> Column:
    """Largest known value; NULL when none is known."""
    return F.greatest(*[_c(v) for v in values])


def season_order(label) -> Column:
    """Sort key of a season label such as '2021-22'."""
    return F.substring(_c(label).cast("string"), 1, 4).cast("int")


def season_bounds(start_year) -> tuple[Column, Column]:
    """First and last day of a season: 1 August to 31 May."""
    year = _c(start_year)
    return F.make_date(year, F.lit(8), F.lit(1)), F.make_date(year + 1, F.lit(5), F.lit(31))


def _single_letter_folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one ASCII letter or digit."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def _ligatures() -> dict[str, str]:
    """Latin ligatures and digraphs with several ASCII letters for a decomposition."""
    out = {}
    for code in [*range(0x80, 0x250), *range(0xFB00, 0xFB07)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) > 1 and base.isascii() and base.isalpha():
            out[chr(code)] = base
    return out


_FOLD_FROM, _FOLD_TO = _single_letter_folds()
_LIGATURES = _ligatures()
assert sys.maxunicode > 0xFFFF


def strip_accents(text) -> Column:
    """Fold accented and width variants to ASCII inside the JVM.

    Covers every character of the basic plane that decomposes to one letter or digit, and Latin
    ligatures and digraphs; marks that stand alone are dropped.
    """
    plain = F.regexp_replace(F.translate(_c(text), _FOLD_FROM, _FOLD_TO), r"\p{M}+", "")
    unfolded = plain
    for letter, letters in _LIGATURES.items():
        unfolded = F.replace(unfolded, F.lit(letter), F.lit(letters))
    return F.when(plain.rlike("[" + "".join(_LIGATURES) + "]"), unfolded).otherwise(plain)


def normalize_name(text) -> Column:
    """Comparison form of a name: no accents, lower case, words split by one
    space, without a trailing number; '' for a missing name."""
    plain = F.lower(strip_accents(F.coalesce(_c(text), F.lit(""))))
    words = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(words, " [0-9]+$", ""))


def text_key(text) -> Column:
    """Light lookup key: lower case, without apostrophes, dots and spaces."""
    return F.replace(F.regexp_replace(F.lower(_c(text)), "['. ]", ""), F.lit("&"), F.lit("and"))


def same_text(left, right) -> Column:
    return F.lower(_c(left)) == F.lower(_c(right))


def blank_to_null(text) -> Column:
    """Trimmed text; blank and the spelled-out missing markers become NULL."""
    cleaned = F.trim(_c(text).cast("string"))
    return F.when(~cleaned.isin(*MISSING_WORDS), cleaned)


def is_present(text) -> Column:
    col = _c(text)
    return col.isNotNull() & (F.trim(col.cast("string")) != "")


def lenient_number(text, kind: str = "double") -> Column:
    """Number from text, NULL where it does not parse; integers are truncated."""
    number = F.trim(_c(text).cast("string")).try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number if kind == "double" else number.cast(kind)


def lenient_boolean(text) -> Column:
    word = F.lower(F.trim(_c(text).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_naive_utc(text) -> Column:
    """Timestamp without zone in UTC from ISO text, NULL where it does not parse."""
    return F.to_utc_timestamp(_c(text).cast("string").try_cast("timestamp"), F.expr("current_timezone()")).cast(
        "timestamp_ntz"
    )


def json_int(text, key: str) -> Column:
    return F.get_json_object(_c(text), f"$.{key}").try_cast("int")


def align_score(result, home, away) -> tuple[Column, Column]:
    """Bring a predicted score in line with a predicted result."""
    r, h, a = _c(result), _c(home), _c(away)
    level = F.floor((h + a) / 2).cast("int")
    return (
        F.when((r == HOME) & (h <= a), a + 1).when(r == DRAW, level).otherwise(h),
        F.when((r == AWAY) & (a <= h), h + 1).when(r == DRAW, level).otherwise(a),
    )
