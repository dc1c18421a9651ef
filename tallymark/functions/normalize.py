"""Value normalisation and equality as SQL expressions, decided from the column types when the plan is built."""

from __future__ import annotations

from pyspark.sql import types as T

from tallymark.functions.text import concat

TOLERANCE = "1e-9D"

# Every character that counts as a Unicode blank: the set a full text strip removes.
_BLANK_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
BLANK_TEXT = "".join(chr(code) for first, last in _BLANK_RANGES for code in range(first, last + 1))
_BLANKS = "'" + "".join(f"\\u{ord(blank):04X}" for blank in BLANK_TEXT) + "'"

# Upper-casing expands ligatures and the small sharp s, and joins all letters of one fold. The dotless i folds to itself, so it is put aside.
_DOTLESS, _ASIDE, _CAPITAL_SHARP_S, _SHARP_S, _FINAL_SIGMA, _SIGMA = "\u0131", "\uFFFF", "\u1E9E", "\u00DF", "\u03C2", "\u03C3"

INTEGER, NUMBER, DATE, TIMESTAMP, TEXT = "integer", "number", "date", "timestamp", "text"
_NUMERIC = {INTEGER, NUMBER}


def kind_of(dtype: T.DataType) -> str:
    """Class of values a type holds. A boolean is a number (true = 1); a decimal without scale is an integer."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return INTEGER
    if isinstance(dtype, T.DecimalType):
        return INTEGER if dtype.scale == 0 else NUMBER
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return NUMBER
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    return TEXT


def strip(value: str) -> str:
    """Remove all leading and trailing Unicode blanks (``trim`` alone removes only U+0020)."""
    return f"btrim({value}, {_BLANKS})"


def folded(value: str) -> str:
    """Text without differences of case, by full Unicode folding: ``Stra\u00dfe`` and ``STRASSE``, both small sigmas, ``\ufb01`` and ``fi`` fall together.

    Only good for comparing: the folded text may differ from that of other tools, equal ones are equal there too.
    """
    upper = f"upper(translate({value}, '{_DOTLESS}{_CAPITAL_SHARP_S}', '{_ASIDE}{_SHARP_S}'))"
    return f"translate(lower(translate({upper}, '{_ASIDE}', '{_DOTLESS}')), '{_FINAL_SIGMA}', '{_SIGMA}')"


def without_nan(value: str, dtype: T.DataType) -> str:
    return f"if(isnan({value}), null, {value})" if isinstance(dtype, (T.FloatType, T.DoubleType)) else value


def as_text(value: str, dtype: T.DataType) -> str:
    """Display text of a value; a timestamp shows six fractional digits or none."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole, full = "'yyyy-MM-dd HH:mm:ss'", "'yyyy-MM-dd HH:mm:ss.SSSSSS'"
        is_whole = f"date_format({value}, 'SSSSSS') = '000000'"
        return f"if({is_whole}, date_format({value}, {whole}), date_format({value}, {full}))"
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return f"to_json({value})"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _plain_number(value)
    return f"cast({value} as string)"


def _plain_number(value: str) -> str:
    """Text of a float without exponent from 1e-4 up to below 1e16, where Spark would write one above 1e7 and below 1e-3."""
    text, size = f"cast({value} as string)", f"abs({value})"
    exact = f"cast(cast({text} as decimal(38,21)) as string)"
    plain = f"regexp_replace(rtrim('0', {exact}), '[.]$', '.0')"
    return f"if(({size} >= 1e7D and {size} < 1e16D) or ({size} < 1e-3D and {size} >= 1e-4D), {plain}, {text})"


def shown(value: str, dtype: T.DataType) -> str:
    """Display text in which a missing value is visible."""
    return f"coalesce({as_text(value, dtype)}, 'None')"


def normalised(value: str, dtype: T.DataType) -> str:
    """The comparable form of a value: double for numbers, text for dates, stripped text (empty = NULL) otherwise."""
    kind = kind_of(dtype)
    if kind in _NUMERIC:
        return f"cast({without_nan(value, dtype)} as double)"
    if kind in (DATE, TIMESTAMP):
        return as_text(value, dtype)
    return f"nullif({strip(as_text(value, dtype))}, '')"


def _same_native_type(left: T.DataType, right: T.DataType) -> bool:
    return kind_of(left) in (DATE, TIMESTAMP) and type(left) is type(right)


def _integer_type(*dtypes: T.DataType) -> str:
    return "decimal(38,0)" if any(isinstance(d, T.DecimalType) for d in dtypes) else "bigint"


def _as_integer(value: str, dtype: T.DataType, other: T.DataType) -> str:
    wanted = _integer_type(dtype, other)
    return value if dtype.simpleString() == wanted else f"cast({value} as {wanted})"


def values_equal(
    left: str,
    left_type: T.DataType,
    right: str,
    right_type: T.DataType,
    case_insensitive: bool = False,
    exact_decimals: bool = False,
) -> str:
    """True where both values are NULL or equal; never NULL itself.

    Integers are compared exactly. Other numbers are equal within an absolute tolerance after a cast to double;
    ``exact_decimals`` compares two decimals without it. Values of different kinds are equal only when both are NULL.
    """
    kinds = {kind_of(left_type), kind_of(right_type)}
    if kinds == {INTEGER}:
        return f"{_as_integer(left, left_type, right_type)} <=> {_as_integer(right, right_type, left_type)}"
    if exact_decimals and isinstance(left_type, T.DecimalType) and isinstance(right_type, T.DecimalType):
        return f"{left} <=> {right}"
    if _same_native_type(left_type, right_type):
        return f"{left} <=> {right}"

    a, b = normalised(left, left_type), normalised(right, right_type)
    both_null = f"({a} is null and {b} is null)"
    if kinds <= _NUMERIC:
        return f"({both_null} or coalesce(abs({a} - {b}) < {TOLERANCE}, false))"
    if kinds & _NUMERIC:
        return both_null
    # most texts are equal as they stand, or in lower case: those need neither stripping nor folding
    same = f"{left} <=> {right} or " if isinstance(left_type, T.StringType) and isinstance(right_type, T.StringType) else ""
    if case_insensitive:
        return f"({same}{a} <=> {b} or lower({a}) <=> lower({b}) or {folded(a)} <=> {folded(b)})"
    return f"({same}{a} <=> {b})"


def key_value(value: str, dtype: T.DataType, other: T.DataType | None = None) -> str:
    """Normalised key: exact, case-sensitive, without tolerance, and of one type on both sides.

    Integer keys stay integers, so two different 64-bit ids never fall together. When one side is numeric and the
    other is text, the tagged texts can only meet in NULL.
    """
    other = dtype if other is None else other
    kinds = {kind_of(dtype), kind_of(other)}
    if kinds == {INTEGER}:
        return _as_integer(value, dtype, other)
    if kinds <= _NUMERIC:
        return normalised(value, dtype)
    if _same_native_type(dtype, other):
        return value
    if kinds & _NUMERIC:
        tag = "'number:'" if kind_of(dtype) in _NUMERIC else "'text:'"
        return concat(tag, f"cast({normalised(value, dtype)} as string)")
    return normalised(value, dtype)
