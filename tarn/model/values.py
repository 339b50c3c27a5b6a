"""Single values: JSON, binary and display forms, all by type."""

from __future__ import annotations

import datetime as dt
import decimal
import struct
import uuid
from typing import Any

from ..errors import BadValue
from .types import Field, ListType, MapType, Primitive, StructType, Type

EPOCH = dt.datetime(1970, 1, 1)
_PACK = {"int": "<i", "long": "<q", "float": "<f", "double": "<d"}


def _micros(v: dt.datetime) -> int:
    if v.tzinfo is not None:
        v = v.astimezone(dt.UTC).replace(tzinfo=None)
    return (v - EPOCH) // dt.timedelta(microseconds=1)


def _time_micros(v: dt.time) -> int:
    return ((v.hour * 60 + v.minute) * 60 + v.second) * 1_000_000 + v.microsecond


def to_bytes(v: Any, t: Type) -> bytes:
    """The binary form that bounds have."""
    if not isinstance(t, Primitive):
        raise BadValue("nested values have no binary form")
    try:
        if t.name == "boolean":
            return b"\x01" if v else b"\x00"
        if t.name in _PACK:
            return struct.pack(_PACK[t.name], v)
        if t.name == "date":
            return struct.pack("<i", (v - EPOCH.date()).days)
        if t.name == "time":
            return struct.pack("<q", _time_micros(v))
        if t.name in ("timestamp", "timestamptz"):
            return struct.pack("<q", _micros(v))
        if t.name == "string":
            return v.encode()
        if t.name == "uuid":
            return v.bytes if isinstance(v, uuid.UUID) else bytes(v)
        if t.name == "decimal":
            unscaled = int(decimal.Decimal(v).scaleb(t.scale))
            return unscaled.to_bytes(max(1, (unscaled + (unscaled < 0)).bit_length() // 8 + 1), "big", signed=True)
        if t.name == "fixed" and len(v) != t.length:
            raise BadValue(f"{len(v)} bytes for {t}")
        return bytes(v)
    except (struct.error, AttributeError, TypeError) as e:
        raise BadValue(f"{v!r} is not a {t}") from e


def from_bytes(b: bytes, t: Type) -> Any:
    if not isinstance(t, Primitive):
        raise BadValue("nested values have no binary form")
    if t.name == "boolean":
        return b != b"\x00"
    if t.name in _PACK:
        if t.name == "long" and len(b) == 4:  # bounds from before a promotion
            return struct.unpack("<i", b)[0]
        if t.name == "double" and len(b) == 4:
            return struct.unpack("<f", b)[0]
        return struct.unpack(_PACK[t.name], b)[0]
    if t.name == "date":
        return EPOCH.date() + dt.timedelta(days=struct.unpack("<i", b)[0])
    if t.name == "time":
        return (EPOCH + dt.timedelta(microseconds=struct.unpack("<q", b)[0])).time()
    if t.name in ("timestamp", "timestamptz"):
        v = EPOCH + dt.timedelta(microseconds=struct.unpack("<q", b)[0])
        return v.replace(tzinfo=dt.UTC) if t.name == "timestamptz" else v
    if t.name == "string":
        return b.decode()
    if t.name == "uuid":
        return uuid.UUID(bytes=b)
    if t.name == "decimal":
        return decimal.Decimal(int.from_bytes(b, "big", signed=True)).scaleb(-t.scale)
    return b


def to_json(v: Any, t: Type) -> Any:
    """The JSON form: times at microseconds, bytes as lower-case hexadecimal digits."""
    if v is None:
        return None
    if isinstance(t, StructType):
        return {f.name: to_json(v.get(f.name), f.type) for f in t.fields}
    if isinstance(t, ListType):
        return [to_json(x, t.element) for x in v]
    if isinstance(t, MapType):
        return {"keys": [to_json(k, t.key) for k in v], "values": [to_json(x, t.value) for x in v.values()]}
    if t.name == "date":
        return v.isoformat()
    if t.name == "time":
        return v.isoformat("microseconds")
    if t.name == "timestamp":
        return v.isoformat(timespec="microseconds")
    if t.name == "timestamptz":
        return v.astimezone(dt.UTC).isoformat(timespec="microseconds")
    if t.name in ("uuid", "decimal"):
        return str(v)
    return bytes(v).hex() if t.name in ("fixed", "binary") else v


def from_json(j: Any, t: Type) -> Any:
    if j is None:
        return None
    try:
        if isinstance(t, StructType):
            return {f.name: from_json(j.get(f.name), f.type) for f in t.fields}
        if isinstance(t, ListType):
            return [from_json(x, t.element) for x in j]
        if isinstance(t, MapType):
            return {from_json(k, t.key): from_json(x, t.value) for k, x in zip(j["keys"], j["values"], strict=True)}
        parse = {
            "date": dt.date.fromisoformat, "time": dt.time.fromisoformat, "timestamp": dt.datetime.fromisoformat,
            "timestamptz": dt.datetime.fromisoformat, "uuid": uuid.UUID, "decimal": decimal.Decimal,
            "fixed": bytes.fromhex, "binary": bytes.fromhex, "float": float, "double": float,
        }
        return parse.get(t.name, lambda x: x)(j)
    except (ValueError, TypeError, AttributeError, KeyError) as e:
        raise BadValue(f"{j!r} is not a {t}") from e


def display(v: Any, t: Type) -> str:
    """The form that partition paths show; null is null."""
    if v is None:
        return "null"
    if not isinstance(t, Primitive):
        raise BadValue("nested values are not shown")
    if t.name == "boolean":
        return "true" if v else "false"
    return str(to_json(v, t))


def infer(v: Any) -> Type:
    """The type of a Python value; a list's is that of its first element that is not null."""
    kinds = [(bool, "boolean"), (int, "long"), (float, "double"), (str, "string"), (dt.datetime, None), (dt.date, "date"), (dt.time, "time"), (uuid.UUID, "uuid"), (bytes, "binary")]
    for kind, name in kinds:
        if isinstance(v, kind):
            return Primitive(name or ("timestamptz" if v.tzinfo else "timestamp"))
    if isinstance(v, decimal.Decimal):
        _, digits, exponent = v.as_tuple()
        return Primitive("decimal", max(len(digits), -exponent), max(0, -exponent))
    if isinstance(v, list):
        first = next((x for x in v if x is not None), None)
        if first is None:
            raise BadValue("a list without elements has no type")
        return ListType(0, False, infer(first))
    if isinstance(v, dict):
        return StructType(tuple(Field(0, k, False, infer(x)) for k, x in v.items()))
    raise BadValue(f"no type for {v!r}")
