"""Text to double with the exporter format's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number texts the format allows. Underscores may stand between digits.
_DIGITS = r"[0-9](?:_?[0-9])*"
_HEX_DIGITS = r"[0-9a-fA-F](?:_?[0-9a-fA-F])*"
NUMBER_TEXT = (
    r"\A[+-]?(?:"
    rf"(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    rf"|0[xX](?:_?{_HEX_DIGITS}(?:\.(?:{_HEX_DIGITS})?)?|\.{_HEX_DIGITS})[pP][+-]?{_DIGITS}"
    r")\z"
)
WORDS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan"]


def parse_double(text: Column) -> Column:
    """Double of a number text, NULL where it is not one.

    Spark's cast alone takes more than the format does (blanks, a ``d`` suffix,
    numbers too large for a double), so the text is checked first and a finite
    text that overflows is refused.
    """
    number = F.translate(text, "_", "").try_cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    # Short expressions keep the generated code of a whole row small enough to be compiled.
    return F.when(F.when(text.rlike(NUMBER_TEXT), ~infinite).otherwise(F.lower(text).isin(WORDS)), number)


def is_finite(number: Column) -> Column:
    """True for a double that is neither NaN nor infinite."""
    return ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
