"""Byte sequences, as Columns of BinaryType. Indexes count from 0; ends of slices are excluded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _signed(value: Column) -> Column:
    """0 to 255 as the byte of that pattern."""
    return F.when(value > 127, value - 256).otherwise(value).cast("tinyint")


def empty() -> Column:
    return F.lit(b"")


def fill(n: int | Column, byte: int) -> Column:
    return F.unhex(F.repeat(F.lit(f"{byte & 255:02X}"), _col(n)))


def of(*values: int) -> Column:
    return F.lit(bytes(v & 255 for v in values))


def of_array(values: Column) -> Column:
    """Bytes of an array of integers, the low 8 bits of each."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(255)), 2, "0")), ""))


def encode_string(text: Column, charset: str = "UTF-8") -> Column:
    from millrace.functions.text import encode

    return encode(text, charset)


def encode_string_strict(text: Column, charset: str = "UTF-8") -> Column:
    from millrace.functions.text import encode

    return encode(text, charset, "report")


def size(b: Column) -> Column:
    return F.octet_length(b)


def byte_at(b: Column, i: int | Column) -> Column:
    """The byte at i as -128 to 127; the job fails out of range."""
    fails = F.raise_error(F.lit("index out of range")).cast("tinyint")
    return F.when((_col(i) < 0) | (_col(i) >= size(b)), fails).otherwise(lift(b, i))


def lift(b: Column, i: int | Column) -> Column:
    """byte_at(), null out of range."""
    value = F.conv(F.hex(F.substring(b, _col(i) + 1, F.lit(1))), 16, 10).cast("int")
    return F.when((_col(i) >= 0) & (_col(i) < size(b)), _signed(value))


def index_of_slice(b: Column, part: Column, start: int | Column = 0) -> Column:
    """Where part first lies in b from start on, or -1."""
    # as characters of a set that has one for each byte, so places are those of bytes
    whole, wanted, at = F.decode(b, "ISO-8859-1"), F.decode(part, "ISO-8859-1"), F.greatest(_col(start).cast("int"), F.lit(0))
    found = F.position(wanted, whole, at + 1)
    return F.when(at > size(b), F.lit(-1)).otherwise(found - 1).cast("long")


def contains_slice(b: Column, part: Column) -> Column:
    return F.contains(b, part)


def starts_with(b: Column, part: Column) -> Column:
    return F.startswith(b, part)


def ends_with(b: Column, part: Column) -> Column:
    return F.endswith(b, part)


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def append(b: Column, byte: int) -> Column:
    return F.concat(b, of(byte))


def prepend(byte: int, b: Column) -> Column:
    return F.concat(of(byte), b)


def take(b: Column, n: int | Column) -> Column:
    return F.substring(b, F.lit(1), F.greatest(_col(n), F.lit(0)))


def drop(b: Column, n: int | Column) -> Column:
    return F.substring(b, F.greatest(_col(n), F.lit(0)) + 1, size(b))


def take_right(b: Column, n: int | Column) -> Column:
    return drop(b, size(b) - _col(n))


def drop_right(b: Column, n: int | Column) -> Column:
    return take(b, size(b) - F.greatest(_col(n), F.lit(0)))


def slice_(b: Column, start: int | Column, end: int | Column) -> Column:
    return drop(take(b, end), start)


def split_at(b: Column, n: int | Column) -> tuple[Column, Column]:
    return take(b, n), drop(b, n)


def _some(b: Column, then: Column) -> Column:
    return F.when(size(b) == 0, F.raise_error(F.lit("NoSuchElement: no bytes")).cast("binary")).otherwise(then)


def head(b: Column) -> Column:
    return byte_at(b, 0)


def last(b: Column) -> Column:
    return byte_at(b, size(b) - 1)


def head_option(b: Column) -> Column:
    return lift(b, 0)


def last_option(b: Column) -> Column:
    return lift(b, size(b) - 1)


def tail(b: Column) -> Column:
    return _some(b, drop(b, 1))


def init(b: Column) -> Column:
    return _some(b, drop_right(b, 1))


def patch(b: Column, start: int | Column, part: Column, replaced: int | Column) -> Column:
    """part in place of replaced bytes from start on."""
    return F.concat(take(b, start), part, drop(b, _col(start) + _col(replaced)))


def update(b: Column, i: int | Column, byte: int) -> Column:
    return patch(b, i, of(byte), 1)


def insert(b: Column, i: int | Column, part: Column) -> Column:
    return patch(b, i, part, 0)


def splice(b: Column, i: int | Column, part: Column) -> Column:
    """part over the bytes from i on."""
    return patch(b, i, part, size(part))


def _padded(b: Column, n: int, pad: Column) -> Column:
    fails = F.raise_error(F.lit("longer than the padded length")).cast("binary")
    return F.when(size(b) > n, fails).otherwise(pad)


def pad_left(b: Column, n: int) -> Column:
    return _padded(b, n, F.concat(fill(F.greatest(F.lit(n) - size(b), F.lit(0)), 0), b))


def pad_right(b: Column, n: int) -> Column:
    return _padded(b, n, F.concat(b, fill(F.greatest(F.lit(n) - size(b), F.lit(0)), 0)))


def to_array(b: Column) -> Column:
    """The bytes as an array of tinyint."""
    return F.transform(F.regexp_extract_all(F.hex(b), F.lit(".."), F.lit(0)), lambda h: _signed(F.conv(h, 16, 10).cast("int")))


def reverse(b: Column) -> Column:
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(b), F.lit(".."), F.lit(0))), ""))


def map_(b: Column, function: Callable[[Column], Column]) -> Column:
    return of_array(F.transform(to_array(b), function))


def map_i(b: Column, function: Callable[[Column], Column]) -> Column:
    """The array of function of each byte, as integers."""
    return F.transform(to_array(b), lambda x: function(x).cast("int"))


def fold_left(b: Column, zero: Column, function: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(to_array(b), zero, function)


def fold_right(b: Column, zero: Column, function: Callable[[Column, Column], Column]) -> Column:
    """function(byte, folded so far), from the last byte."""
    return F.aggregate(F.reverse(to_array(b)), zero, lambda acc, x: function(x, acc))


def decode_utf8(b: Column) -> Column:
    return F.decode(b, "UTF-8")


def decode_ascii(b: Column) -> Column:
    return F.decode(b, "US-ASCII")


def decode_string(b: Column, charset: str) -> Column:
    """Text of bytes in charset; the job fails for bytes that aren't."""
    from millrace.functions.text import decode

    return decode(b, charset)
