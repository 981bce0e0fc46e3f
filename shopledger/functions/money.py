"""Exact amounts.

The domain is DECIMAL(18,6): at most 12 integer digits and 6 fraction digits once trailing zeros are
dropped. Text outside it is *invalid* (null plus an issue tag), never rounded. It is narrower than
arbitrary-precision decimals so that products (scale 12) and their sums stay exact in 38 digits.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 6)
PRODUCT = DecimalType(38, 12)

_PLAIN = r"^[+-]?(0*[0-9]{1,12}(\.[0-9]{0,6}0*)?|\.[0-9]{1,6}0*)$"
_EXPONENT = r"^[+-]?[0-9]{1,12}(\.[0-9]{0,6})?[eE][+-]?(0?[0-9]|1[0-2])$"


def number_text(c: Column) -> Column:
    """Trimmed text without the underscores allowed between digits."""
    text = F.trim(c)
    return F.when(text.contains("_"), F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")).otherwise(text)


def money(c: Column) -> Column:
    """Parse text to an exact decimal; null when it is not a number of the domain."""
    text = number_text(c)
    value = text.try_cast(MONEY)
    wide = text.try_cast(DecimalType(38, 18))
    return F.when(text.rlike(_PLAIN), value).when(text.rlike(_EXPONENT) & (value == wide), value)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).cast(PRODUCT)


def sign_text(c: Column) -> Column:
    """Decimal text for row identity: scale is kept, so 1.0 and 1 stay different."""
    text = number_text(c)
    # a text that begins with one of 1 to 9 has nothing to drop
    return F.when(text.substr(1, 1).between("1", "9"), text).otherwise(F.regexp_replace(text, r"^(-?)\+?0*(?=[0-9])", "$1"))
