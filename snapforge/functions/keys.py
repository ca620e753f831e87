"""Encodings of keys and values as binary Columns. All of them are built-in expressions but for `callable_value`."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.errors import ConfigError

ENCODINGS = ("u64be", "u32be", "utf8", "raw")


def encode_key(key: Column, encoding: str) -> Column:
    """u64be and u32be: unsigned big-endian integers, out of range is an error; utf8: strings; raw: bytes."""
    if encoding in ("u64be", "u32be"):
        digits = 16 if encoding == "u64be" else 8
        bad = (key < 0) | (key >= F.lit(1 << 32)) if encoding == "u32be" else key < 0
        encoded = F.unhex(F.lpad(F.hex(key.cast("long")), digits, "0"))
        return F.when(bad, F.raise_error(F.concat(F.lit(f"key out of range for {encoding}: "), key.cast("string"))).cast("binary")).otherwise(encoded)
    if encoding == "utf8":
        return F.encode(key, "UTF-8")
    if encoding == "raw":
        return key
    raise ConfigError(f"no such key encoding: {encoding}; there are {', '.join(ENCODINGS)}")


def decode_key(encoded: Column, encoding: str, kind: str) -> Column:
    """The key, of a Spark type, that encode_key made this of."""
    if encoding in ("u64be", "u32be"):
        return F.conv(F.hex(encoded), 16, 10).cast("decimal(20,0)").cast(kind)
    return F.decode(encoded, "UTF-8") if encoding == "utf8" else encoded


def check_encoding(kind: str, encoding: str) -> None:
    """An error where keys of a Spark type can't have an encoding."""
    fits = {"u64be": ("tinyint", "smallint", "int", "bigint"), "utf8": ("string",), "raw": ("binary",)}
    fits["u32be"] = fits["u64be"]
    if encoding not in fits:
        raise ConfigError(f"no such key encoding: {encoding}; there are {', '.join(ENCODINGS)}")
    if kind not in fits[encoding]:
        raise ConfigError(f"{kind} keys can't be encoded as {encoding}")


def lookup_key(key: int | str | bytes, encoding: str) -> bytes:
    """The encoding of one key that is looked up. The integer encodings also take bytes of their length."""
    size = {"u64be": 8, "u32be": 4}.get(encoding)
    if size and isinstance(key, (bytes, bytearray)):
        if len(key) != size:
            raise ConfigError(f"{encoding} keys have {size} bytes")
        return bytes(key)
    if size:
        if not isinstance(key, int) or not 0 <= key < 1 << 8 * size:
            raise ConfigError(f"not a key for {encoding}: {key!r}")
        return key.to_bytes(size, "big")
    if encoding == "utf8" and isinstance(key, str):
        return key.encode()
    if encoding == "raw" and isinstance(key, (bytes, bytearray)):
        return bytes(key)
    raise ConfigError(f"not a key for {encoding}: {key!r}")


def parse_key(text: str, encoding: str) -> int | str | bytes:
    """A key as typed on a command line: decimal for the integer encodings, hex digits for raw."""
    return int(text) if encoding in ("u64be", "u32be") else bytes.fromhex(text) if encoding == "raw" else text


def show_value(value: Column, form: str = "base64") -> Column:
    if form == "base64":
        return F.base64(value)
    if form == "hex":
        return F.lower(F.hex(value))
    if form == "utf8":
        return F.decode(value, "UTF-8")
    raise ConfigError(f"no such form of values: {form}")


def binary_value(column: Column, kind: str = "string") -> Column:
    """A string's UTF-8 or the bytes themselves; null is the empty value."""
    return F.coalesce(column if kind == "binary" else F.encode(column, "UTF-8"), F.lit(b""))


def json_value(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The columns as compact ASCII JSON, by name, nulls kept.

    Integers, booleans and strings are written by Spark, with other characters than ASCII escaped
    by an Arrow function; where a column's text differs from Python's json, such as a double's, the whole
    value is written there.
    """
    names = sorted(columns if columns is not None else df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if missing := [n for n in names if n not in kinds]:
        raise ConfigError(f"no such columns: {missing}")
    row = F.struct(*[F.col(n) for n in names])
    if all(kinds[n] in ("tinyint", "smallint", "int", "bigint", "boolean") for n in names):
        return F.encode(F.to_json(row, {"ignoreNullFields": "false"}), "UTF-8")

    @F.arrow_udf("binary")
    def dump(rows: pa.Array) -> pa.Array:
        return pa.array([json.dumps(r, sort_keys=True, separators=(",", ":")).encode() for r in rows.to_pylist()], pa.binary())

    return dump(row)


def callable_value(columns: Sequence[str], encode: Callable[[dict], bytes]) -> Column:
    """Any Python function of a row's columns, over Arrow batches."""

    @F.arrow_udf("binary")
    def call(rows: pa.Array) -> pa.Array:
        return pa.array([encode(r) for r in rows.to_pylist()], pa.binary())

    return call(F.struct(*[F.col(c) for c in columns]))
