"""Host SQL types and how Spark holds them: native types where they exist, encodings with range checks where they don't."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])

SIMPLE: dict[str, T.DataType] = {
    "NULL": T.NullType(),
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "UTINYINT": T.ShortType(),
    "USMALLINT": T.IntegerType(),
    "UINTEGER": T.LongType(),
    "UBIGINT": T.DecimalType(20, 0),
    "HUGEINT": T.StringType(),
    "UHUGEINT": T.StringType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "BLOB": T.BinaryType(),
    "UUID": T.StringType(),
    "DATE": T.DateType(),
    "TIME": T.LongType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP_S": T.TimestampNTZType(),
    "TIMESTAMP_MS": T.TimestampNTZType(),
    "TIMESTAMP_NS": T.LongType(),
    "TIMESTAMPTZ": T.TimestampType(),
    "INTERVAL": INTERVAL,
}
SYNONYMS = {"INT": "INTEGER", "INT4": "INTEGER", "INT8": "BIGINT", "LONG": "BIGINT", "SHORT": "SMALLINT", "BOOL": "BOOLEAN", "STRING": "VARCHAR", "TEXT": "VARCHAR", "CHAR": "VARCHAR", "BYTEA": "BLOB", "BINARY": "BLOB", "REAL": "FLOAT", "TIMESTAMP_NTZ": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ", "NUMERIC": "DECIMAL"}
#: Inclusive ranges of integers; Spark's next wider type holds the unsigned ones.
RANGES = {"TINYINT": (-(1 << 7), (1 << 7) - 1), "SMALLINT": (-(1 << 15), (1 << 15) - 1), "INTEGER": (-(1 << 31), (1 << 31) - 1), "BIGINT": (-(1 << 63), (1 << 63) - 1)}
RANGES |= {"UTINYINT": (0, (1 << 8) - 1), "USMALLINT": (0, (1 << 16) - 1), "UINTEGER": (0, (1 << 32) - 1), "UBIGINT": (0, (1 << 64) - 1), "HUGEINT": (-(1 << 127), (1 << 127) - 1), "UHUGEINT": (0, (1 << 128) - 1)}
#: Digits of 2**128 - 1; padded texts of this many digits sort as numbers do.
WIDE = 39
MICROS_PER_DAY = 86_400_000_000


class EnumRegistry:
    """ENUM types: a name and its labels in order of declaration. With a catalogue they are kept beside the tables, and outlive the session."""

    def __init__(self, catalogue=None):
        self.labels: dict[str, tuple[str, ...]] = {}
        self.catalogue = catalogue

    def create(self, name: str, labels: list[str]) -> None:
        if self.get(name):
            raise ValueError(f"type {name} already exists")
        if len(set(labels)) != len(labels) or not labels:
            raise ValueError("an ENUM needs labels, each once")
        if self.catalogue:
            self.catalogue.put("types", name, {"labels": labels})
        self.labels[name.lower()] = tuple(labels)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if not self.get(name) and not if_exists:
            raise ValueError(f"type {name} does not exist")
        self.labels.pop(name.lower(), None)
        if self.catalogue:
            self.catalogue.drop("types", name)

    def get(self, name: str) -> tuple[str, ...] | None:
        if name.lower() not in self.labels and self.catalogue and name.isidentifier() and (kept := self.catalogue.get("types", name)):
            self.labels[name.lower()] = tuple(kept["labels"])
        return self.labels.get(name.lower())


def spark_type(host: str, enums: EnumRegistry | None = None) -> T.DataType:
    """Spark's type for a host type's name: simple ones, DECIMAL(p, s), T[] and LIST(T), names of ENUMs."""
    name = " ".join(host.strip().upper().split())
    if name.endswith("[]"):
        return T.ArrayType(spark_type(host.strip()[:-2], enums))
    if m := re.fullmatch(r"(?i)\s*(?:LIST|ARRAY)\s*[(<](.*)[)>]\s*", host):
        return T.ArrayType(spark_type(m[1], enums))
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)(?:\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", name):
        return T.DecimalType(int(m[1] or 18), int(m[2] or (0 if m[1] else 3)))
    name = re.sub(r"^(VARCHAR|CHAR)\s*\(.*\)$", "VARCHAR", name)
    name = SYNONYMS.get(name, name)
    if name in SIMPLE:
        return SIMPLE[name]
    if enums and enums.get(host.strip()):
        return T.StringType()
    raise ValueError(f"unknown type {host}")


def base_name(host: str) -> str:
    name = " ".join(host.strip().upper().split())
    return SYNONYMS.get(name, name)


def checked(column: Column, host: str, enums: EnumRegistry | None = None) -> Column:
    """The column cast to a host type for storage; values outside an integer's range or an ENUM's labels raise."""
    name = base_name(host)
    if enums and (labels := enums.get(host.strip())):
        known = column.isNull() | column.isin(*labels)
        return F.when(known, column).otherwise(F.raise_error(F.concat(F.lit(f"{host} has no label "), column)))
    if name in ("HUGEINT", "UHUGEINT"):
        return wide_text(column, signed=name == "HUGEINT")
    if name == "UUID":
        text = F.lower(column.cast("string"))
        return F.when(column.isNull() | text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), text).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), text)))
    if name in ("TIMESTAMP_S", "TIMESTAMP_MS"):
        return F.date_trunc("second" if name == "TIMESTAMP_S" else "millisecond", column).cast("timestamp_ntz")
    if name.startswith("U") and name in RANGES:
        low, high = RANGES[name]
        value = column.cast("decimal(38,0)")
        return F.when(value.isNull() | value.between(F.lit(low), F.lit(Decimal(high))), value).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {name}: "), column.cast("string")))).cast(SIMPLE[name])
    return column.cast(spark_type(host, enums))


def wide_text(column: Column, signed: bool = True) -> Column:
    """A 128-bit integer's decimal text as a sign digit and WIDE digits, which sort as the numbers do.

    Negative numbers are written as their distance from 10**WIDE, digit by digit.
    """
    text = column.cast("string")
    digits = F.lpad(F.regexp_replace(text, "^[+-]", ""), WIDE, "0")
    negative = text.startswith("-")
    below = F.translate(digits, "0123456789", "9876543210")
    largest = F.lit(str((1 << 127 if signed else 1 << 128) - 1).zfill(WIDE))
    fits = F.when(negative, (digits <= F.lit(str(1 << 127).zfill(WIDE))) & F.lit(signed)).otherwise(digits <= largest) & text.rlike(r"^[+-]?[0-9]{1,39}$")
    return F.when(text.isNull(), None).when(fits, F.when(negative, F.concat(F.lit("0"), below)).otherwise(F.concat(F.lit("1"), digits))).otherwise(F.raise_error(F.concat(F.lit("out of range for a 128-bit integer: "), text)))


def wide_number(column: Column) -> Column:
    """The decimal text of what ``wide_text`` has written."""
    digits = F.substring(column, 2, WIDE)
    plain = lambda c: F.regexp_replace(c, "^0+(?=[0-9])", "")
    return F.when(column.startswith("1"), plain(digits)).otherwise(F.concat(F.lit("-"), plain(F.translate(digits, "0123456789", "9876543210"))))


def time_micros(text: Column) -> Column:
    """Microseconds of the day of a time's text (HH:MM:SS[.ffffff])."""
    h, m = F.substring(text, 1, 2).cast("long"), F.substring(text, 4, 2).cast("long")
    s = F.substring(text, 7, 9).cast("decimal(9,6)")
    return (h * 3600 + m * 60) * 1_000_000 + (s * 1_000_000).cast("long")


def time_text(micros: Column) -> Column:
    s = F.floor(micros / 1_000_000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    part = F.pmod(micros, F.lit(1_000_000))
    return F.when(part == 0, clock).otherwise(F.concat(clock, F.lit("."), F.lpad(part.cast("string"), 6, "0")))


def interval(months: int = 0, days: int = 0, micros: int = 0) -> Column:
    return F.struct(F.lit(months).cast("int").alias("months"), F.lit(days).cast("int").alias("days"), F.lit(micros).cast("long").alias("micros"))


def interval_micros(value: Column) -> Column:
    """What intervals are compared by: a month counts as 30 days."""
    days = value["months"].cast("decimal(38,0)") * 30 + value["days"]
    return days * MICROS_PER_DAY + value["micros"]
