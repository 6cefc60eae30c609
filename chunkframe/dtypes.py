"""Element types: format name, numpy form, Spark type, fill values and saturating casts."""

from __future__ import annotations

import base64
import math
import re
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark.sql import types as T

from .errors import InvalidFillValue, InvalidMetadata, ShapeMismatch, TypeMismatch, UnsupportedDataType, CellValueError

# Scalar types of the format, their numpy codes and Spark types.
_PLAIN = {
    "bool": ("?", T.BooleanType()),
    "int8": ("i1", T.ByteType()),
    "int16": ("i2", T.ShortType()),
    "int32": ("i4", T.IntegerType()),
    "int64": ("i8", T.LongType()),
    "uint8": ("u1", T.ShortType()),
    "uint16": ("u2", T.IntegerType()),
    "uint32": ("u4", T.LongType()),
    "uint64": ("u8", T.DecimalType(20, 0)),
    "float16": ("f2", T.FloatType()),
    "float32": ("f4", T.FloatType()),
    "float64": ("f8", T.DoubleType()),
    "complex64": ("c8", T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())])),
    "complex128": ("c16", T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])),
}
_ALIASES = {"bytes": "variable_length_bytes", "logical": "bool", "double": "float64", "single": "float32"}
_TIME = re.compile(r"(datetime64|timedelta64)\[(\w+)\]")
NAT = np.iinfo(np.int64).min


@dataclass(frozen=True)
class DType:
    name: str
    kind: str  # bool int uint float complex string bytes time utf32 struct
    config: dict = field(default_factory=dict, hash=False, compare=True)
    fields: tuple = ()  # of struct: (name, DType)

    # -- shape of one element ------------------------------------------------
    @property
    def variable(self) -> bool:
        return self.kind in ("string", "bytes")

    @property
    def numpy(self) -> np.dtype:
        if self.variable:
            return np.dtype(object)
        if self.kind == "time":
            return np.dtype("<i8")
        if self.kind == "utf32":
            return np.dtype(f"<U{self.config['length_bytes'] // 4}")
        if self.kind == "struct":
            return np.dtype([(n, d.numpy) for n, d in self.fields])
        return np.dtype("<" + _PLAIN[self.name][0]) if self.name not in ("bool", "int8", "uint8") else np.dtype(_PLAIN[self.name][0])

    @property
    def itemsize(self) -> int:
        return 1 if self.variable else self.numpy.itemsize

    @property
    def spark(self) -> T.DataType:
        if self.kind == "time":
            return T.LongType()
        if self.kind in ("string", "utf32"):
            return T.StringType()
        if self.kind == "bytes":
            return T.BinaryType()
        if self.kind == "struct":
            return T.StructType([T.StructField(n, d.spark) for n, d in self.fields])
        return _PLAIN[self.name][1]

    @property
    def json(self):
        return {"name": self.name, "configuration": self.config} if self.config else self.name

    # -- fill values ---------------------------------------------------------
    def default_fill(self):
        if self.kind == "time":
            return np.int64(NAT)
        if self.kind == "string":
            return ""
        if self.kind == "bytes":
            return b""
        if self.kind == "struct":
            return np.zeros((), self.numpy)[()]
        return np.zeros((), self.numpy)[()]

    def decode_fill(self, value):
        """A fill value from its JSON form."""
        try:
            return self._decode(value)
        except InvalidFillValue:
            raise
        except (ValueError, TypeError, OverflowError, KeyError) as e:
            raise InvalidFillValue(f"{value!r} is no fill value of {self.name}: {e}") from e

    def _decode(self, value):
        if value is None:
            return self.default_fill() if self.kind != "time" else np.int64(0)
        if self.kind == "time":
            return np.int64(NAT) if value == "NaT" else np.int64(int(value))
        if self.kind in ("string", "utf32"):
            if not isinstance(value, str):
                raise InvalidFillValue(f"{value!r} is no string")
            return value if self.kind == "string" else np.array(value, self.numpy)[()]
        if self.kind == "bytes":
            return base64.b64decode(value, validate=True) if isinstance(value, str) else bytes(value)
        if self.kind == "struct":
            raw = base64.b64decode(value, validate=True)
            if len(raw) != self.itemsize:
                raise InvalidFillValue(f"a record of {self.itemsize} bytes is needed")
            return np.frombuffer(raw, self.numpy)[0]
        if self.kind == "bool":
            return np.bool_(value)
        if self.kind in ("int", "uint"):
            number = int(value) if not isinstance(value, float) else int(Decimal(value))
            info = np.iinfo(self.numpy)
            if not info.min <= number <= info.max:
                raise InvalidFillValue(f"{value!r} is out of range")
            return self.numpy.type(number)
        if self.kind == "complex":
            part = DType("float32" if self.name == "complex64" else "float64", "float")
            re_, im = (part._decode(v) for v in value)
            out = np.zeros((), self.numpy)
            out.real, out.imag = re_, im
            return out[()]
        if isinstance(value, str):
            special = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
            if value in special:
                return self.numpy.type(special[value])
            if not re.fullmatch(r"0[xX][0-9a-fA-F]+", value) or len(value) != 2 + 2 * self.itemsize:
                raise InvalidFillValue(f"{value!r} is no bit pattern of {self.name}")
            bits = int(value, 16).to_bytes(self.itemsize, "little")
            return np.frombuffer(bits, self.numpy)[0]
        with np.errstate(over="ignore"):
            return self.numpy.type(value)

    def encode_fill(self, value):
        """The JSON form of a fill value; NaN keeps its payload as a bit pattern."""
        if self.kind in ("string", "utf32"):
            return str(value)
        if self.kind == "bytes":
            return base64.b64encode(bytes(value)).decode()
        if self.kind == "struct":
            return base64.b64encode(np.array(value, self.numpy).tobytes()).decode()
        if self.kind == "bool":
            return bool(value)
        if self.kind == "time":
            return "NaT" if int(value) == NAT else int(value)
        if self.kind in ("int", "uint"):
            return int(value)
        if self.kind == "complex":
            part = DType("float32" if self.name == "complex64" else "float64", "float")
            v = np.array(value, self.numpy)
            return [part.encode_fill(v.real[()]), part.encode_fill(v.imag[()])]
        v = self.numpy.type(value)
        if np.isnan(v):
            raw, plain = np.array(v).tobytes(), np.array(self.numpy.type(math.nan)).tobytes()
            return "NaN" if raw == plain else "0x" + raw[::-1].hex()
        if np.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        return float(v)

    def filled(self, shape, fill) -> np.ndarray:
        out = np.empty(shape, self.numpy)
        if self.variable:
            out.fill(fill)
        else:
            out[...] = fill
        return out

    def fills(self, flat: np.ndarray, fill) -> np.ndarray:
        """Which cells of a rank-1 block equal the fill value, as ``is_fill`` compares."""
        if self.kind in ("float", "complex"):
            want, out = np.array(fill, self.numpy), np.ones(flat.shape, bool)
            for part in ("real", "imag") if self.kind == "complex" else ("real",):
                a, b = getattr(flat, part), getattr(want, part)
                out &= np.isnan(a) if np.isnan(b) else (a == b) & (np.signbit(a) == np.signbit(b))
            return out
        if self.kind == "struct":
            raw = np.ascontiguousarray(flat).view(np.uint8).reshape(len(flat), -1)
            return (raw == np.frombuffer(np.array(fill, self.numpy).tobytes(), np.uint8)).all(1)
        return np.asarray(flat == self.filled((), fill)[()], bool)

    def is_fill(self, block: np.ndarray, fill) -> bool:
        """All cells equal the fill value bit by bit (any NaN equals a NaN fill)."""
        if block.size > 4096 and self.kind in ("bool", "int", "uint", "float", "time") and not self.is_fill(block[(*(slice(0, 1),) * (block.ndim - 1), slice(0, 4096))], fill):
            return False  # most blocks show it in their first row
        if self.kind in ("float", "complex"):
            want = np.array(fill, self.numpy)
            for part in ("real", "imag") if self.kind == "complex" else ("real",):
                a, b = getattr(block, part), getattr(want, part)
                same = np.isnan(a) if np.isnan(b) else (a == b) & (np.signbit(a) == np.signbit(b))
                if not same.all():
                    return False
            return True
        if self.kind == "struct":
            return np.ascontiguousarray(block).tobytes() == np.array(fill, self.numpy).tobytes() * block.size
        return bool((block == self.filled((), fill)[()]).all()) if block.size else True

    # -- coercion on write ---------------------------------------------------
    def coerce(self, values) -> np.ndarray:
        """``values`` in this type: integers round half away from zero and saturate, NaN
        becomes 0, missing strings become ''."""
        if self.kind == "string":
            return _objects(values, lambda v: "" if v is None else str(v))
        if self.kind == "bytes":
            return _objects(values, self._bytes)
        if self.kind == "utf32":
            flat = _objects(values, lambda v: "" if v is None else str(v))
            most = self.config["length_bytes"] // 4
            if any(len(v) > most for v in flat.reshape(-1)):
                raise CellValueError(f"a string of more than {most} characters")
            return flat.astype(self.numpy)
        if self.kind == "struct":
            return self._records(values)
        a = np.asarray(values)
        if a.dtype.kind in "OUS" and a.size and not (a.dtype.kind == "O" and self.kind != "complex"):
            raise TypeMismatch(f"{a.dtype} values for {self.name}")
        if a.dtype.kind == "O":
            try:
                a = _numbers(a)
            except (TypeError, ValueError) as e:
                raise TypeMismatch(f"values that are no numbers for {self.name}") from e
        if a.dtype.kind == "M" or a.dtype.kind == "m":
            a = a.astype("i8")
        if self.kind == "bool":
            return np.isnan(a) | (a != 0) if a.dtype.kind == "f" else a != 0
        if self.kind in ("int", "uint", "time"):
            return saturate(a, self.numpy)
        with np.errstate(over="ignore", invalid="ignore"):
            return a.astype(self.numpy)

    @staticmethod
    def _bytes(v):
        if v is None:
            return b""
        if isinstance(v, (bytes, bytearray, memoryview)):
            return bytes(v)
        raise TypeMismatch(f"{type(v).__name__} where bytes are needed")

    def _records(self, values) -> np.ndarray:
        a = np.asarray(values)
        if a.dtype.names is None:
            rows = _objects(values, lambda v: v)
            out = np.zeros(rows.shape, self.numpy)
            if any(not isinstance(r, (dict, tuple)) for r in rows.reshape(-1)):
                raise TypeMismatch("records are needed")
            for j, (n, d) in enumerate(self.fields):
                cells = np.empty(rows.size, object)
                cells[:] = [r[n] if isinstance(r, dict) else r[j] for r in rows.reshape(-1)]
                out[n] = d.coerce(cells.tolist() if d.kind == "struct" or not d.variable else cells).reshape(rows.shape)
            return out
        out = np.zeros(a.shape, self.numpy)
        for n, d in self.fields:
            out[n] = d.coerce(a[n])
        return out


def _objects(values, one) -> np.ndarray:
    a = values if isinstance(values, np.ndarray) and values.dtype == object else None
    if a is None:
        a = np.empty(np.shape(values) if isinstance(values, np.ndarray) else _list_shape(values), object)
        flat = values.reshape(-1) if isinstance(values, np.ndarray) else _flatten(values)
        a.reshape(-1)[:] = list(flat)
    out = np.empty(a.size, object)
    out[:] = [one(v) for v in a.reshape(-1)]
    return out.reshape(a.shape)


def _list_shape(v) -> tuple:
    return (len(v), *_list_shape(v[0])) if isinstance(v, list) and v else ((0,) if isinstance(v, list) else ())


def _flatten(v):
    if isinstance(v, list):
        for x in v:
            yield from _flatten(x)
    else:
        yield v


def _numbers(a: np.ndarray) -> np.ndarray:
    flat = [0 if v is None else v for v in a.reshape(-1)]
    if all(isinstance(v, (int, np.integer, bool, Decimal)) and v == int(v) for v in flat):
        flat = [int(v) for v in flat]
        big = max(flat, default=0) > np.iinfo(np.int64).max
        return np.array([max(v, 0) if big else v for v in flat], np.uint64 if big else np.int64).reshape(a.shape)
    return np.array([float(v) for v in flat], np.float64).reshape(a.shape)


def saturate(a: np.ndarray, to: np.dtype) -> np.ndarray:
    """Round half away from zero, NaN to 0, and clip to the range of the integer type."""
    info = np.iinfo(to)
    if a.dtype.kind == "b":
        return a.astype(to)
    if a.dtype.kind in "iu":
        own = np.iinfo(a.dtype)
        lo, hi = max(info.min, own.min), min(info.max, own.max)
        return np.clip(a, a.dtype.type(lo), a.dtype.type(hi)).astype(to)
    if a.dtype.kind == "c":
        a = a.real
    a = a.astype(np.float64)
    whole = np.trunc(a)
    with np.errstate(invalid="ignore"):
        r = np.where(np.isfinite(a) & (np.abs(a - whole) >= 0.5), whole + np.sign(a), whole)
        # the bounds of 64-bit types are no doubles: compare before the cast
        high, low = r >= float(info.max), r <= float(info.min)
        out = np.where(high | low | np.isnan(r), 0, r).astype(to)
    out[high], out[low] = info.max, info.min
    return out


def parse(data_type) -> DType:
    """A ``DType`` from its metadata form, a name, an alias, or a Spark StructType."""
    if isinstance(data_type, DType):
        return data_type
    if isinstance(data_type, T.StructType):
        return _from_spark(data_type)
    if isinstance(data_type, (np.dtype, type)) and not isinstance(data_type, dict):
        data_type = np.dtype(data_type).name
    if isinstance(data_type, str):
        name, config = _ALIASES.get(data_type, data_type), {}
        if m := _TIME.fullmatch(name):
            name, config = f"numpy.{m[1]}", {"unit": m[2], "scale_factor": 1}
    elif isinstance(data_type, dict) and isinstance(data_type.get("name"), str):
        name, config = _ALIASES.get(data_type["name"], data_type["name"]), dict(data_type.get("configuration") or {})
    else:
        raise InvalidMetadata(f"no data type: {data_type!r}")
    if name in _PLAIN:
        letter = _PLAIN[name][0][0]
        return DType(name, {"?": "bool", "i": "int", "u": "uint", "f": "float", "c": "complex"}[letter])
    if name == "string":
        return DType(name, "string")
    if name == "variable_length_bytes":
        return DType(name, "bytes")
    if name in ("numpy.datetime64", "numpy.timedelta64"):
        if "unit" not in config:
            raise InvalidMetadata(f"{name} needs a unit")
        return DType(name, "time", {"unit": config["unit"], "scale_factor": int(config.get("scale_factor", 1))})
    if name == "fixed_length_utf32":
        length = config.get("length_bytes")
        if not isinstance(length, int) or length <= 0 or length % 4:
            raise InvalidMetadata(f"length_bytes {length!r}")
        return DType(name, "utf32", {"length_bytes": length})
    if name in ("structured", "struct"):
        fields = []
        for f in config.get("fields", ()):
            n, d = (f["name"], f["data_type"]) if isinstance(f, dict) else f
            sub = parse(d)
            if sub.variable:
                raise UnsupportedDataType(f"field {n} of variable length")
            fields.append((n, sub))
        if not fields:
            raise InvalidMetadata("a record without fields")
        return DType("structured", "struct", {"fields": [[n, d.json] for n, d in fields]}, tuple(fields))
    raise UnsupportedDataType(name)


def _from_spark(schema: T.StructType, utf32_bytes: int = 128) -> DType:
    names = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}
    fields = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, T.StructType):
            sub = _from_spark(f.dataType).json
        elif kind == "string":
            sub = {"name": "fixed_length_utf32", "configuration": {"length_bytes": utf32_bytes}}
        elif kind in names:
            sub = names[kind]
        else:
            raise UnsupportedDataType(f"field {f.name}: {kind}")
        fields.append([f.name, sub])
    return parse({"name": "structured", "configuration": {"fields": fields}})


def shape_of(values, rank: int) -> tuple[int, ...]:
    shape = np.shape(values)
    if len(shape) != rank:
        raise ShapeMismatch(f"rank {len(shape)} where {rank} is needed")
    return shape
