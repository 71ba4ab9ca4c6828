"""Cell-level rules as native Column expressions.

Everything here is a Column -> Column function that stays inside the JVM; the
physical type is passed along because the rule for "empty" or "numeric"
depends on it.  No function triggers a job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text forms accepted as a number, and the characters treated
# as blank space (Unicode white space and the four separators 1c-1f).
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
ODD_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = " " + ODD_BLANKS
# the same characters as patterns: one-byte ones, the range that holds the others
# (a cheap first test), and the others themselves
NARROW_ODD_BLANK = r"[\t-\r\x1c-\x1f\x85\xa0]"
WIDE_RANGE = r"[\u1680-\u3000]"
WIDE_ODD_BLANK = r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK_ONLY = r"^[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*\z"

MATCH_TOLERANCE = 1e-4

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL + _FRACTIONAL)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def can_be_nan(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_null_like(col: Column, dtype: T.DataType) -> Column:
    """NULL, NaN, or text that holds only blank space.  Never NULL itself."""
    if is_text(dtype):
        # text that starts with a printable ASCII character needs no pattern
        printable = (col >= "!") & (col < "\x7f")
        blank = F.when(printable, F.lit(False)).otherwise(col.rlike(BLANK_ONLY))
        return col.isNull() | F.coalesce(blank, F.lit(True))
    if can_be_nan(dtype):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def not_null_like(col: Column, dtype: T.DataType) -> Column:
    return ~is_null_like(col, dtype)


def to_number(col: Column, dtype: T.DataType) -> Column:
    """The cell as a finite double, or NULL when it does not read as a number.

    Text goes through the pattern first: a plain cast would accept '1d' or
    'Infinity', and would pay for an exception on every ordinary word.  Text
    beyond the range of a double is no number.
    """
    if is_text(dtype):
        number = col.try_cast("double")
        return F.when(col.rlike(NUMERIC_TEXT) & (F.abs(number) < F.lit(float("inf"))), number)
    if can_be_nan(dtype):
        # NaN sorts above infinity, so it fails this test as well
        return F.when(F.abs(col) < F.lit(float("inf")), col.cast("double"))
    if is_numeric(dtype):
        return col.cast("double")
    return F.lit(None).cast("double")


def is_castable(col: Column, dtype: T.DataType) -> Column:
    return to_number(col, dtype).isNotNull()


def is_whole(number: Column) -> Column:
    return (number % 1) == 0


def has_odd_blank(col: Column) -> Column:
    """Any blank other than the plain space."""
    return col.rlike(NARROW_ODD_BLANK) | (col.rlike(WIDE_RANGE) & col.rlike(WIDE_ODD_BLANK))


def squeeze_blanks(col: Column) -> Column:
    """One plain space between words, none at the ends."""
    plain = F.translate(col, ODD_BLANKS, " " * len(ODD_BLANKS))
    return F.trim(F.regexp_replace(plain, "  +", " "))


def is_untidy(col: Column) -> Column:
    """True where squeeze_blanks would change the text; a search, not a rewrite.

    That is a space at an end, two spaces in a row, or any other blank.
    """
    space = F.lit(" ")
    found = F.startswith(col, space) | F.endswith(col, space) | F.contains(col, F.lit("  ")) | has_odd_blank(col)
    return F.coalesce(found, F.lit(False))


def strip_blanks(col: Column) -> Column:
    """Both ends trimmed; the general trim only runs on text with unusual blanks."""
    return F.when(has_odd_blank(col), F.btrim(col, F.lit(BLANKS))).otherwise(F.trim(col))


def fold_key(col: Column, dtype: T.DataType) -> Column:
    """Case- and padding-blind comparison key."""
    if is_text(dtype):
        return F.lower(strip_blanks(col))
    return F.lower(col.cast("string"))


def values_match(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """Loose equality: numbers within a relative tolerance, else folded text."""
    na, nb = to_number(a, a_type), to_number(b, b_type)
    # a relative distance is zero for equal values, infinities included
    close = (na == nb) | (F.abs(na - nb) <= MATCH_TOLERANCE * F.greatest(F.abs(na), F.abs(nb)))
    if is_numeric(a_type) and is_numeric(b_type):
        present = close
    else:
        present = F.when(na.isNotNull() & nb.isNotNull(), close).otherwise(
            fold_key(a, a_type) == fold_key(b, b_type)
        )
    a_gone = a.isNull() | F.isnan(a) if can_be_nan(a_type) else a.isNull()
    b_gone = b.isNull() | F.isnan(b) if can_be_nan(b_type) else b.isNull()
    return F.when(a_gone & b_gone, F.lit(True)).when(a_gone | b_gone, F.lit(False)).otherwise(present)


def guess_dtype(col: Column, dtype: T.DataType) -> Column:
    """Logical type of one value: int, float, str, or unknown when it is NULL."""
    n = to_number(col, dtype)
    return (
        F.when(col.isNull(), F.lit("unknown"))
        .when(n.isNull(), F.lit("str"))
        .when(is_whole(n), F.lit("int"))
        .otherwise(F.lit("float"))
    )


def as_column_type(value: Column, target: T.DataType) -> Column:
    """A repair value in the type of the column it goes into.

    Whole numbers written as '28.0' must fit an integer column, so integral
    targets fall back from a direct cast (which keeps large longs exact) to the
    number if it is whole.  A value that does not fit gives NULL; `widened` makes
    room for numbers that are not whole.
    """
    if is_text(target):
        return value.cast("string")
    if is_integral(target):
        number = value.try_cast("double")
        return F.when(is_whole(number), F.coalesce(value.try_cast(target), number.try_cast(target)))
    return value.try_cast(target)


def widened(types: Mapping[str, T.DataType], values: Mapping[str, object]) -> dict[str, T.DataType]:
    """Column types in which integral columns that get a number that is not whole are doubles."""

    def split(value) -> bool:
        try:
            return float(value) % 1 != 0 and abs(float(value)) != float("inf")
        except (TypeError, ValueError):
            return False

    return {c: T.DoubleType() if c in values and is_integral(t) and split(values[c]) else t for c, t in types.items()}


def round_to(col: Column, digits: int) -> Column:
    """Half-up rounding on the decimal value.

    Scores are sums of short decimals, so exact ties are common; going through a
    decimal keeps binary noise from deciding them.
    """
    return F.round(col.cast("decimal(38,10)"), digits).cast("double")


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def issue_id(table: Column, row_id: Column, column: Column, issue_type: Column) -> Column:
    return F.concat_ws(
        "_", table, row_id.cast("string"), F.coalesce(column, F.lit("row")), issue_type
    )
