"""Types, value ranges and errors shared by every module."""
from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Identifiers are unsigned 32-bit numbers; Spark's IntegerType cannot hold them.
U32_MAX = 4294967295

REFS = T.StructType([
    T.StructField("tax_id", T.LongType()), T.StructField("gi", T.LongType()),
    T.StructField("ord", T.LongType()), T.StructField("seq", T.StringType()),
])
READS = T.StructType([
    T.StructField("read_ord", T.LongType()), T.StructField("read_id", T.StringType()),
    T.StructField("desc", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()),
])
MAPPING = T.StructType([
    T.StructField("header", T.StringType()), T.StructField("tax_id", T.LongType()), T.StructField("gi", T.LongType()),
])
HIT = "struct<tax_id:bigint,gi:bigint,offset:bigint,edit:bigint>"


class ReadloomError(Exception):
    """Base of all errors raised by this package."""


class InvalidHeader(ReadloomError):
    """A record name that is not GI-TAXID."""


class InvalidInteger(ReadloomError):
    """A token that should be an unsigned 32-bit number."""


class MissingMapping(ReadloomError):
    """A record without an entry in the mapping file."""


class InvalidMapping(ReadloomError):
    """A mapping file that cannot be used."""


class MissingFile(ReadloomError):
    """A path that is absent or of the wrong kind."""


class InvalidParameter(ReadloomError):
    """A parameter out of its range."""


def u32(token: Column) -> Column:
    """The number a token spells, NULL unless it is digits (with an optional plus) within 32 bits."""
    value = F.when(token.rlike(r"^\+?[0-9]+\z"), token.try_cast("decimal(38,0)"))
    return F.when(value <= U32_MAX, value.cast("bigint"))


def u32_or_fail(token: Column, what: str) -> Column:
    """As u32, but a bad token ends the query with a message that shows it."""
    value = u32(token)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(token, F.lit("(null)"))))).otherwise(value)
