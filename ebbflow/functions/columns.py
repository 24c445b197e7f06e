"""Column -> Column helpers.  All built-in expressions: they stay inside
whole-stage codegen and never leave the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# strings treated as a missing id.
MISSING_TOKENS = ("", "none", "nan", "0")
# accuracy grade bands (MAPE upper bounds, inclusive) and their labels
GRADE_BANDS = ((10, "Excellent"), (20, "Good"), (30, "Fair"), (50, "Poor"))
GRADE_WORST = "Very Poor"
EPS = 1e-6


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c) -> Column:
    """Lower + trim."""
    return F.lower(F.trim(col(c)))


def canon_id(c) -> Column:
    """Lower, trim, drop non-alphanumerics, then leading zeros."""
    x = F.regexp_replace(F.lower(F.trim(col(c))), "[^0-9a-z]", "")
    return F.regexp_replace(x, "^0+", "")


def is_missing_token(c) -> Column:
    """True when a value is null or one of the missing-like strings."""
    x = F.lower(F.trim(col(c).cast("string")))
    return x.isNull() | x.isin(*MISSING_TOKENS)


def safe_float(c) -> Column:
    """Null / NaN / +-inf / unparsable -> 0.0."""
    x = col(c).try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def weekday0(ds) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ds))


def calendar_columns(ds) -> dict[str, Column]:
    """Calendar features of a date column."""
    d = col(ds)
    return {
        "order_year": F.year(d),
        "order_month": F.month(d),
        "order_day": F.dayofmonth(d),
        "order_day_of_week": F.weekday(d),
        "quarter": F.quarter(d),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    }


def cyclical_columns(ds) -> dict[str, Column]:
    """sin/cos of month/12, weekday/7, day/31 (rounded to 9 places)."""
    d = col(ds)
    two_pi = 2 * 3.141592653589793
    out = {}
    for name, num, den in (("month", F.month(d), 12.0), ("dow", F.weekday(d), 7.0),
                           ("day", F.dayofmonth(d), 31.0)):
        out[f"{name}_sin"] = F.round(F.sin(num * two_pi / den), 9)
        out[f"{name}_cos"] = F.round(F.cos(num * two_pi / den), 9)
    return out


def grade(mape) -> Column:
    """Accuracy grade of a MAPE percentage; null -> 'N/A'."""
    m = col(mape)
    out = F.when(m.isNull() | F.isnan(m), F.lit("N/A"))
    for bound, label in GRADE_BANDS:
        out = out.when(m <= bound, F.lit(label))
    return out.otherwise(F.lit(GRADE_WORST))


def half_even(c, digits: int = 0) -> Column:
    """Python/NumPy rounding (banker's)."""
    return F.bround(col(c), digits)


def half_up(c) -> Column:
    """JavaScript Math.round."""
    return F.floor(col(c) + 0.5)


def round_to(c, digits: int = 6) -> Column:
    """Half-up rounding written as ``floor(x * 10^n + 0.5) / 10^n``.

    The same IEEE operations in any SQL engine give the same double, unlike
    ``round`` whose tie handling differs between engines."""
    scale = float(10 ** digits)
    return F.floor(col(c) * scale + 0.5) / scale


def r6(c) -> Column:
    return round_to(c, 6)


#: Date forms tried in order on text that is not ISO (month before day, as in
#: the raw order files); a value takes the first that fits.
DATE_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d")
#: Fields of a date form that are read from digits alone.
DIGIT_FIELDS = {"yyyy", "M", "MM", "d", "dd", "H", "HH", "mm", "ss"}


def _shape(form: str) -> str:
    """Pattern of every text that a date form of digits can fit: a number for
    each run of letters, the rest as it is."""
    return "^" + "".join("[+-]?[0-9]+" if run[0].isalpha() else re.escape(run) for run in re.findall("[A-Za-z]+|[^A-Za-z]+", form)) + "$"


def parse_timestamp(c, formats=DATE_FORMATS) -> Column:
    """Text to timestamp: ISO first, then ``formats`` in order; null when no
    form fits.  A form of digits is only tried on text of its shape: a failed
    try costs an exception, many times what the pattern does."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)

    def tried(form):
        t = F.try_to_timestamp(text, F.lit(form))
        return F.when(text.rlike(_shape(form)), t) if set(re.findall("[A-Za-z]+", form)) <= DIGIT_FIELDS else t
    return F.coalesce(F.try_to_timestamp(text), *[tried(f) for f in formats])
