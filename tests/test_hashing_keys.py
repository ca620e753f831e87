import json
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapforge.errors import ConfigError
from snapforge.functions import hashing, keys

#: XXH3 digests, seed 0.
GOLDEN = {
    0: 14374147212387527897, 1: 3439722301264460078, -1: 5841669975847748627, 42: 15395265915043915720, 2147483648: 7714710879142532484,
    9223372036854775807: 11687913294787043142, -9223372036854775808: 9407778237848358495, "": 3244421341483603138, "a": 16629034431890738719,
    "hello": 10760762337991515389, "a" * 241: 17784696633448601904, "emoji😀face": 13452851664269582556, b"\x00\x01\x02": 6864218090047839419,
}


@pytest.mark.parametrize("key", GOLDEN)
def test_golden(key):
    assert hashing.digest(key) == GOLDEN[key] and hashing.shard_of(key, 7) == GOLDEN[key] % 7


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20))
def test_integers_in_numpy(values):
    assert hashing.hash_integers(np.array(values, np.int64)).tolist() == [xxhash.xxh3_64_intdigest(v.to_bytes(8, "little", signed=True)) for v in values]


@pytest.mark.parametrize(("kind", "values"), [
    ("int", [0, 1, -5, 2**31 - 1, None]), ("bigint", [0, -1, 2**63 - 1, None]), ("string", ["", "a", "é" * 200, "x" * 300, None, "a"]), ("binary", [b"", b"\xff\x00", None]), ("smallint", [3, -3]),
])
def test_columns_agree_with_single_keys(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    for n in (1, 5, 7, 1023):
        got = [r[0] for r in df.select(hashing.hash_shard(F.col("k"), n)).collect()]
        assert got == [None if v is None else hashing.shard_of(v, n) for v in values]
    assert [r[0] for r in df.select(hashing.hash_digest(F.col("k"))).collect()] == [None if v is None else hashing.digest(v) for v in values]


def test_key_encodings(spark):
    df = spark.createDataFrame([(0, "é", b"\x00"), (2**31, "", b"")], "i long, s string, b binary")
    rows = df.select(keys.encode_key(F.col("i"), "u64be"), keys.encode_key(F.col("i"), "u32be"), keys.encode_key(F.col("s"), "utf8"), keys.encode_key(F.col("b"), "raw")).collect()
    assert [tuple(map(bytes, r)) for r in rows] == [(bytes(8), bytes(4), "é".encode(), b"\x00"), ((2**31).to_bytes(8, "big"), (2**31).to_bytes(4, "big"), b"", b"")]
    for value, encoding in ((-1, "u64be"), (-1, "u32be"), (2**32, "u32be")):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(value,)], "i long").select(keys.encode_key(F.col("i"), encoding)).collect()


def test_lookup_keys():
    assert keys.lookup_key(5, "u64be") == bytes(7) + b"\x05" == keys.lookup_key(bytes(7) + b"\x05", "u64be")
    assert keys.lookup_key("é", "utf8") == "é".encode() and keys.lookup_key(b"x", "raw") == b"x"
    assert keys.parse_key("12", "u32be") == 12 and keys.parse_key("0aff", "raw") == b"\x0a\xff" and keys.parse_key("x", "utf8") == "x"
    for key, encoding in ((-1, "u64be"), (2**32, "u32be"), ("a", "u64be"), (1, "utf8"), (b"123", "u32be"), (1, "other")):
        with pytest.raises(ConfigError):
            keys.lookup_key(key, encoding)
    for kind, encoding in (("string", "u64be"), ("bigint", "utf8"), ("binary", "nope")):
        with pytest.raises(ConfigError):
            keys.check_encoding(kind, encoding)


def test_values(spark):
    rows = [(1, "plain", None, True, 1.0), (2, 'quote " é   😀', 0.1, False, float(random.Random(1).random()))]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean, f double")
    for columns in (["i", "b"], None, ["s", "i"], ["d"]):
        got = [bytes(r[0]) for r in df.select(keys.json_value(df, columns)).collect()]
        names = columns or df.columns
        assert got == [json.dumps({c: v for c, v in zip(df.columns, r, strict=True) if c in names}, sort_keys=True, separators=(",", ":")).encode() for r in rows]
    nulls = spark.createDataFrame([(None, None)], "s string, b binary").select(keys.binary_value(F.col("s")), keys.binary_value(F.col("b"), "binary")).first()
    assert tuple(map(bytes, nulls)) == (b"", b"")
    called = df.select(keys.callable_value(["i", "s"], lambda r: f"{r['i']}:{len(r['s'])}".encode())).collect()
    assert [bytes(r[0]) for r in called] == [f"{r[0]}:{len(r[1])}".encode() for r in rows]
    with pytest.raises(ConfigError):
        keys.json_value(df, ["nope"])
