"""Partition transforms: a Column expression, a result type, and the same on one Python value."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import struct
import uuid
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PartitionError
from ..model import values
from ..model.types import Primitive, Type

TEMPORAL = ("date", "timestamp", "timestamptz")
#: Source types of each transform.
SOURCES = {
    "year": TEMPORAL, "month": TEMPORAL, "day": TEMPORAL, "hour": ("timestamp", "timestamptz"),
    "bucket": ("int", "long", "decimal", "date", "time", "timestamp", "timestamptz", "string", "uuid", "fixed", "binary"),
    "truncate": ("int", "long", "decimal", "string", "binary"),
}


#: Spark's hash of several columns takes each one's hash as the next one's seed, and of whole numbers it is MurmurHash3; of
#: this number (seed 42) it is 0, the seed of buckets.
ZERO_SEED = -1693959553


def murmur3(data: bytes, seed: int = 0) -> int:
    """The 32-bit x86 form of the public-domain hash MurmurHash3, unsigned."""
    c1, c2, m = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF

    def scrambled(k: int) -> int:
        k = k * c1 & m
        return (k << 15 | k >> 17) * c2 & m

    h, whole = seed, len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h ^= scrambled(k)
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    if tail := data[whole:]:
        h ^= scrambled(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def hash_bytes(v: Any, t: Primitive) -> bytes:
    """What a bucket hashes: whole numbers as longs, decimals unscaled, text in UTF-8."""
    if t.name in ("int", "long", "date"):
        return struct.pack("<q", v if t.name != "date" else (v - dt.date(1970, 1, 1)).days)
    return values.to_bytes(v, t)


@dataclass(frozen=True)
class Transform:
    """void, identity, year, month, day, hour, bucket[n] or truncate[w]."""

    name: str
    width: int = 0

    def __str__(self) -> str:
        return f"{self.name}[{self.width}]" if self.width else self.name

    @classmethod
    def parse(cls, text: str) -> Transform:
        if m := re.fullmatch(r"(bucket|truncate)\[(\d+)\]", text):
            return cls(m[1], int(m[2]))
        if text in ("void", "identity", "year", "month", "day", "hour"):
            return cls(text)
        raise PartitionError(f"no such transform: {text}")

    def result_type(self, source: Type) -> Primitive:
        if not isinstance(source, Primitive):
            raise PartitionError("only primitive fields can be transformed")
        if self.name in SOURCES and source.name not in SOURCES[self.name]:
            raise PartitionError(f"{self} does not apply to {source}")
        if self.name in ("void", "identity", "truncate"):
            return source
        return Primitive("int")

    def column(self, c: Column, source: Primitive) -> Column:
        """The transform of a column; null stays null."""
        kind = self.result_type(source).to_spark()
        if self.name == "void":
            return F.lit(None).cast(kind)
        if self.name == "identity":
            return c
        if self.name == "year":
            return (F.year(c) - 1970).cast("int")
        if self.name == "month":
            return ((F.year(c) - 1970) * 12 + F.month(c) - 1).cast("int")
        if self.name == "day":
            return F.unix_date(F.to_date(c))
        if self.name == "hour":
            return (F.unix_date(F.to_date(c)) * 24 + F.hour(c)).cast("int")
        if self.name == "bucket":
            return self._bucket(c, source)
        if source.name in ("int", "long"):
            return (c - F.pmod(c, F.lit(self.width))).cast(kind)
        if source.name == "decimal":
            step = F.lit(decimal.Decimal(self.width).scaleb(-source.scale))
            return (c - F.pmod(c, step)).cast(kind)
        return F.substring(c, 1, self.width)

    def _bucket(self, c: Column, source: Primitive) -> Column:
        n = self.width
        whole = {"int": lambda: c.cast("long"), "long": lambda: c, "date": lambda: F.unix_date(c).cast("long")}
        if source.name in whole:
            hashed = F.hash(F.lit(ZERO_SEED), whole[source.name]()).bitwiseAND(0x7FFFFFFF) % n
            return F.when(c.isNotNull(), hashed).cast("int")

        @F.pandas_udf("int")
        def bucket(v: pd.Series) -> pd.Series:
            def one(x: Any) -> int | None:
                if x is None or x is pd.NaT:
                    return None
                if isinstance(x, pd.Timestamp):
                    x = x.to_pydatetime()
                return (murmur3(hash_bytes(x, source)) & 0x7FFFFFFF) % n

            # Distinct values are hashed once.
            known = {x: one(x) for x in v.dropna().unique()}
            return v.map(known).astype("Int32")

        return bucket(c)

    def apply(self, v: Any, source: Primitive) -> Any:
        """The transform of one value."""
        self.result_type(source)
        if v is None or self.name == "void":
            return None
        if self.name == "identity":
            values.to_bytes(v, source)
            return v
        if self.name in ("year", "month", "day", "hour"):
            if not isinstance(v, dt.date):
                raise PartitionError(f"{v!r} is not a {source}")
            if isinstance(v, dt.datetime) and v.tzinfo:
                v = v.astimezone(dt.UTC)
            days = ((v.date() if isinstance(v, dt.datetime) else v) - dt.date(1970, 1, 1)).days
            return {"year": v.year - 1970, "month": (v.year - 1970) * 12 + v.month - 1, "day": days, "hour": days * 24 + getattr(v, "hour", 0)}[self.name]
        if self.name == "bucket":
            if isinstance(v, uuid.UUID):
                v = v.bytes
            return (murmur3(hash_bytes(v, source)) & 0x7FFFFFFF) % self.width
        if source.name in ("int", "long"):
            return v - v % self.width
        if source.name == "decimal":
            unscaled = int(v.scaleb(source.scale))
            return decimal.Decimal(unscaled - unscaled % self.width).scaleb(-source.scale)
        return v[: self.width]
