"""Text as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType

# Accented letters and their plain forms.
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def canonical(df: DataFrame, name: str) -> Column:
    """A column as category text: trimmed; whole numbers without decimals; booleans as True and False; null stays null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(c), None).when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, NumericType):
        return c.cast("string")
    return F.trim(c.cast("string"))


def folded(c: Column) -> Column:
    """Small letters without accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def slug(c: Column) -> Column:
    """Folded, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(folded(c), "[^a-z0-9]+", "_"), F.lit("_"))


def readable(c: Column) -> Column:
    """A column name to show: only names with underscores change, to spaces and one capital."""
    spaced = F.trim(F.regexp_replace(c, "[_\\s]+", " "))
    shown = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 1_000_000)))
    return F.when(~F.contains(c, F.lit("_")) | (spaced == ""), c).otherwise(shown)


def number(c: Column, decimals: int = 2, signed_zero: bool = False) -> Column:
    """A number with points between thousands, a decimal comma and no trailing zeros; what rounds to a negative zero is 0, or -0 with ``signed_zero``."""
    plain = F.translate(F.format_number(c.cast("double"), decimals), ",.", ".,")
    short = F.regexp_replace(F.regexp_replace(plain, r"(,\d*?)0+$", "$1"), ",$", "") if decimals else plain
    return short if signed_zero else F.regexp_replace(short, "^-0$", "0")


def decimals_of(low: float, high: float) -> int:
    """Decimals to show a variable with by its range: none for counts up to 100."""
    return sum(abs(high - low) <= most for most in (20, 2))


def percent(c: Column, decimals: int = 1) -> Column:
    return F.concat(number(c, decimals), F.lit(" %"))


def signed(c: Column, decimals: int = 2) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), number(c, decimals))


def listed(c: Column) -> Column:
    """An array as "a, b y c"."""
    n = F.size(c)
    return F.when(n == 0, "").when(n == 1, F.get(c, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(c, F.lit(1), n - 1), ", "), F.lit(" y "), F.element_at(c, -1)))


def contains(c: Column, value: str) -> Column:
    """Literal, in whatever case."""
    return F.contains(F.lower(c), F.lit(value.lower()))


def first_number(c: Column) -> Column:
    """The first run of digits as a double; null without one."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("double")
