import pytest
from pyspark.sql import functions as F

from snapforge.errors import ConfigError
from snapforge.functions.expressions import by_columns, check_columns, check_routing_values, compile_expression
from snapforge.functions.hashing import digest, shard_of

COLUMNS = {"key": "int", "name": "string", "raw": "bytes", "x": "double", "flag": "bool", "u": "uint"}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(10, "hello", b"ab", 1.0, True, 5), (-7, "wörld", b"", 2.5, False, 0), (80, "", b"\xff", -0.5, True, 9)]
    return spark.createDataFrame(data, "key long, name string, raw binary, x double, flag boolean, u long")


CASES = [
    ("key % 4", lambda r: int(abs(r.key) % 4 * (1 if r.key >= 0 else -1))),
    ("key < 25 ? 0 : key < 50 ? 1 : key < 75 ? 2 : 3", lambda r: 0 if r.key < 25 else 3),
    ("key / 3 + 2 * key - -1", lambda r: int(r.key / 3) + 2 * r.key + 1),
    ("(key + 1) * 2", lambda r: (r.key + 1) * 2),
    ("shard_hash(key) % 4u", lambda r: shard_of(r.key, 4)),
    ("shard_hash(name) % 100u", lambda r: shard_of(r.name, 100)),
    ("shard_hash(raw) % 7u", lambda r: shard_of(bytes(r.raw), 7)),
    ("shard_hash(name)", lambda r: digest(r.name)),
    ("shard_hash(name + \":\" + string(key)) % 13u", lambda r: shard_of(f"{r.name}:{r.key}", 13)),
    ("string(x)", lambda r: {1.0: "1", 2.5: "2.5", -0.5: "-0.5"}[r.x]),
    ("string(flag)", lambda r: str(r.flag).lower()),
    ("name + 'a\\n\\x41\\u00e9\"'", lambda r: r.name + 'a\nAé"'),
    ("size(name) + name.size()", lambda r: 2 * len(r.name)),
    ("name in ['hello', \"x\"] ? 1 : 0", lambda r: int(r.name == "hello")),
    ("flag && !(key > 50) || name == '' ? 1 : 0", lambda r: int(r.flag and r.key <= 50 or r.name == "")),
    ("name.startsWith('he') ? 1 : name.endsWith('ld') ? 2 : name.contains('x') ? 3 : 4", lambda r: {"hello": 1, "wörld": 2}.get(r.name, 4)),
    ("name.matches('^h.*o$') ? 1 : 0", lambda r: int(r.name == "hello")),
    ("raw + b'\\x00z'", lambda r: bytes(r.raw) + b"\x00z"),
    ("bytes(name)", lambda r: r.name.encode()),
    ("int(x) + int('12') + int(u)", lambda r: int(r.x) + 12 + r.u),
    ("u + 1u", lambda r: r.u + 1),
    ("uint(3) * u", lambda r: 3 * r.u),
    ("x >= 1.0 ? 0x10 : 2", lambda r: 16 if r.x >= 1 else 2),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_values(rows, text, want):
    made = compile_expression(text, COLUMNS)
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else int(v) if made.type in ("int", "uint") else v
    assert [plain(r["got"]) for r in rows.select("*", made.column.alias("got")).collect()] == [want(r) for r in rows.collect()]


@pytest.mark.parametrize("text", [
    "", "key %", "nope", "key + u", "key == 'a'", "x", "flag", "key % 2.0", "x % 2.0", "name.upper()", "size(key)", "shard_hash(x)", "shard_hash(flag)", "key ? 1 : 2",
    "flag ? 1 : 'a'", "'\\q'", "key in ['a']", "key # 2", "1 2", "in", "99999999999999999999", "string(key, key)", "bytes(key)", "!key", "-name", "flag < true",
])
def test_refused(spark, text):
    with pytest.raises(ConfigError):
        compile_expression(text, COLUMNS)


@pytest.mark.parametrize("text", ["u - 1u", "key * 9223372036854775807", "key / (key - key)", "uint(key)"])
def test_run_time_errors(rows, text):
    with pytest.raises(Exception, match=r"(?i)overflow|out of range|zero"):
        rows.select(compile_expression(text, COLUMNS).column).collect()


def test_builders(spark):
    assert by_columns({"a": "string"}, 4) == "shard_hash(a) % 4u"
    assert by_columns({"a": "double"}, 4) == "shard_hash(string(a)) % 4u"
    assert by_columns({"a": "string"}) == "a"
    for mark in (":", '"', "\\", "\n"):
        made = compile_expression(by_columns({"a": "string", "b": "int"}, 5, mark), {"a": "string", "b": "int"})
        assert made.used == ("a", "b")
        df = spark.createDataFrame([("x", 3)], "a string, b long")
        assert int(df.select(made.column.alias("v")).first()[0]) == shard_of(f"x{mark}3", 5)
    with pytest.raises(ConfigError):
        by_columns({})
    df = spark.createDataFrame([(1, "a")], "i int, s string").withColumn("d", F.lit(1.5))
    check_columns(df, {"i": "int", "s": "string", "d": "double"})
    for bad in ({"z": "int"}, {"s": "int"}, {"d": "int"}):
        with pytest.raises(ConfigError):
            check_columns(df, bad)
    check_routing_values(["a", "b"])
    for bad in ([1, "a"], [None], [True], ["a", "a"], [1.5]):
        with pytest.raises(ConfigError):
            check_routing_values(bad)
