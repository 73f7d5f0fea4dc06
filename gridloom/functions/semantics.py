"""What a loosely typed cell means: numbers, dates, canonical text, casts. All as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import SheetError

_SPACE = r"[ \t\n\r\x0B\f]*"
NUMERIC = rf"{_SPACE}[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?{_SPACE}"
#: Seconds from 1899-12-30 to 1970-01-01, and the days by which the other epoch is later.
EPOCH_SECONDS = 2209161600
DAYS_1904 = 1462
LAST_SERIAL = 2958465


def is_numeric(text: Column) -> Column:
    """Decimal or exponent notation, with spaces around; no hexadecimal, no names, no type suffixes."""
    return text.rlike(f"^{NUMERIC}$")


def numeric_view(df: DataFrame, name: str, booleans: bool = False) -> Column:
    """A column's cells as doubles; cells that aren't numeric are null. ``booleans``: count them as 0 and 1."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double") if booleans else F.lit(None).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return serial_of(col)
    if isinstance(kind, T.StringType):
        number = F.when(is_numeric(col), F.expr(f"try_cast(trim(BOTH ' \\t\\n\\r\\u000B\\f' FROM `{name}`) AS DOUBLE)"))
        return number
    if isinstance(kind, T.NumericType):
        number = col.cast("double")
        return F.when(~F.isnan(number), number)
    raise SheetError("unsupportedType", f"column {name} has cells of type {kind.simpleString()}")


def serial_of(ts: Column) -> Column:
    """Days since 1899-12-30, with the time as a fraction."""
    return (F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) + F.lit(EPOCH_SECONDS)) / F.lit(86400.0)


def whole_seconds(ts: Column) -> Column:
    """A timestamp to the nearest second, halves to the later one.

    Of microseconds, which are exact: a serial is a double, and those of a day of this
    century are 0.6 microseconds apart, so half a second can't be told from a bit less.
    """
    return F.date_trunc("second", ts.cast("timestamp") + F.expr("INTERVAL '0.5' SECOND"))


def moment_of(serial: Column, date1904: bool = False) -> Column:
    """The timestamp of a serial, to whole seconds. Before 1899-12-30 serials are negative."""
    days = F.floor(serial)
    seconds = F.round((serial - days) * 86400)
    shift = DAYS_1904 if date1904 else 0
    return F.timestamp_seconds((days + F.lit(shift)) * 86400 + seconds - F.lit(EPOCH_SECONDS))


def datetime_of(serial: Column, date1904: bool = False) -> Column:
    """The timestamp of a serial, to whole seconds; null outside of 0 .. 2,958,465."""
    return F.when((serial >= 0) & (serial <= LAST_SERIAL), moment_of(serial, date1904))


def date_of(serial: Column, date1904: bool = False) -> Column:
    return datetime_of(F.floor(serial).cast("double"), date1904).cast("date")


def calendar_bucket(serial: Column, unit: str) -> Column:
    """YYYY, YYYYMM or YYYYMMDD of a serial, in UTC, seconds cut off."""
    formats = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd"}
    if unit not in formats:
        raise SheetError("badBucket", f"no calendar bucket is called {unit}")
    seconds = F.floor(serial * 86400).cast("long") - F.lit(EPOCH_SECONDS)
    return F.date_format(F.timestamp_seconds(seconds), formats[unit]).cast("int")


def keeps_text(text: Column) -> Column:
    """A numeric text that is written as text: it would lose a leading zero, a plus or digits."""
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[^0-9]", ""))
    return is_numeric(text) & (text.rlike(r"^[+-]?0[0-9]") | text.startswith("+") | (digits > 15))


def canonical_text(df: DataFrame, name: str) -> Column:
    """The text by which cells are distinct; null where a cell is empty. Integral doubles have no fraction."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.when(col, "1").when(~col, "0")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _number_text(col.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _number_text(serial_of(col))
    text = col.cast("string")
    return F.when(text != "", text)


def _number_text(number: Column) -> Column:
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


def cast_cell(df: DataFrame, name: str, kind: str, date1904: bool = False, zone: str | None = None) -> Column:
    """A column under one of the built-in casts; what can't be cast is null, but false for bool."""
    number = numeric_view(df, name)
    if kind == "float":
        return number
    if kind == "int":
        inside = (number >= -(2.0**63)) & (number < 2.0**63)
        return F.when(inside, number.cast("long"))
    if kind == "bool":
        if isinstance(df.schema[name].dataType, T.BooleanType):
            return F.coalesce(F.col(f"`{name}`"), F.lit(False))
        return F.coalesce(F.col(f"`{name}`").cast("string").isin("1", "true"), F.lit(False))
    if kind in ("date", "datetime"):
        made = datetime_of(number, date1904)
        if zone:
            made = F.from_utc_timestamp(made, zone)
        return made if kind == "datetime" else (F.to_date(made) if zone else date_of(number, date1904))
    raise SheetError("badCast", f"no cast is called {kind}")


def column_index(letters: str) -> int:
    """A is 0, XFD is 16383."""
    if not re.fullmatch("[A-Z]{1,3}", letters):
        raise SheetError("badColumn", f"{letters!r} is no column")
    at = 0
    for letter in letters:
        at = at * 26 + ord(letter) - 64
    if at > 16384:
        raise SheetError("badColumn", f"{letters} is beyond XFD")
    return at - 1


def column_letters(index: int) -> str:
    if not 0 <= index < 16384:
        raise SheetError("badColumn", f"no column has the index {index}")
    out, at = "", index + 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def letters_index_sql(column: str) -> Column:
    """``column_index`` for a column of letters."""
    return F.expr(f"aggregate(split({column}, ''), 0, (a, c) -> IF(c = '', a, a * 26 + ascii(c) - 64), a -> a - 1)")


_CONTROL = re.compile(r"(?![\t\n\r])[\x00-\x1f]")
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def xml_escape(text: str) -> str:
    text = _CONTROL.sub("", text)
    for plain, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = text.replace(plain, f"&{name};")
    return text


def xml_decode(text: str) -> str:
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


def is_date_format(code: str) -> bool:
    """A number format shows a date or a time: a y, m, d, h or s outside of quotes, brackets and escapes."""
    if re.search(r"\[(?:h+|m+|s+)\]", code, re.I):
        return True
    bare = re.sub(r'"[^"]*"?|\\.|_.|\*.|\[[^\]]*\]?', "", code)
    return bool(re.search("[ymdhs]", bare.split(";")[0], re.I)) and "general" not in bare.lower()


def clean_sheet_name(name: str) -> str:
    return re.sub(r"[:*?/\\\[\]]", "_", name)[:31] or "Sheet"
