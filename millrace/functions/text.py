"""Text and bytes of text, as Columns."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Character sets that Spark's own functions know.
_OWN = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def utf8_decode(data: Column) -> Column:
    """Text of UTF-8 bytes; the job fails for others. Join a text's chunks first."""
    return F.decode(data, "UTF-8")


def utf8_encode(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def decode(data: Column, charset: str, on_malformed: str = "report") -> Column:
    """Text of bytes in charset. on_malformed: report (the job fails), replace (U+FFFD) or ignore."""
    if on_malformed not in ("report", "replace", "ignore"):
        raise ValueError("report, replace or ignore")
    if charset.upper() in _OWN and on_malformed == "report":
        return F.decode(data, charset.upper())
    name, errors = codecs.lookup(charset).name, {"report": "strict"}.get(on_malformed, on_malformed)

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: bytes(x).decode(name, errors), na_action="ignore")

    return run(data)


def encode(text: Column, charset: str, on_unmappable: str = "replace") -> Column:
    """Bytes of text in charset. on_unmappable: replace (?), report or ignore."""
    if on_unmappable not in ("report", "replace", "ignore"):
        raise ValueError("report, replace or ignore")
    if charset.upper() == "UTF-8":
        return F.encode(text, "UTF-8")
    name, errors = codecs.lookup(charset).name, {"report": "strict"}.get(on_unmappable, on_unmappable)

    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x.encode(name, errors), na_action="ignore")

    return run(text)


def lines(text: Column) -> Column:
    """The array of lines: cut at \\n alone; a last \\n adds no empty line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
