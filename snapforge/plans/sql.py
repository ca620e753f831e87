"""DuckDB SQL that states what the registered queries return."""

XXH3_SECRET_MIX = 0xC73AB174C5ECD5A2
XXH3_PRIME = 0x9FB21C651E98DF25
WRAP = "18446744073709551616::UHUGEINT"


def turn(x: str, n: int) -> str:
    return f"xor(({x} * {1 << n}::UHUGEINT) % {WRAP}, {x} // {1 << (64 - n)}::UHUGEINT)"


def hashed(table: str, key: str, columns: str = "*", where: str = "TRUE") -> str:
    """A query over table with h, the XXH3 digest of a non-negative integer key. Each step is a subquery so nothing is computed twice."""
    steps = f"SELECT {columns}, {key}::UHUGEINT AS k FROM {table} WHERE {where}"
    steps = f"SELECT *, xor((k // 4294967296::UHUGEINT) + (k * 4294967296::UHUGEINT) % {WRAP}, {XXH3_SECRET_MIX}::UHUGEINT) AS x0 FROM ({steps})"
    steps = f"SELECT *, xor(x0, xor({turn('x0', 49)}, {turn('x0', 24)})) AS x1 FROM ({steps})"
    steps = f"SELECT *, wrapped_mul(x1) AS x2 FROM ({steps})"
    steps = f"SELECT *, wrapped_mul(xor(x2, (x2 // 34359738368::UHUGEINT) + 8)) AS x3 FROM ({steps})"
    made = f"SELECT * EXCLUDE (k, x0, x1, x2, x3), xor(x3, x3 // 268435456::UHUGEINT) AS h FROM ({steps})"
    # x * PRIME mod 2**64 in 128 bits: the factor's halves, as the whole product may not fit
    low, high = XXH3_PRIME & 0xFFFFFFFF, XXH3_PRIME >> 32
    for name in ("x1", "xor(x2, (x2 // 34359738368::UHUGEINT) + 8)"):
        made = made.replace(f"wrapped_mul({name})", f"((({name} * {low}::UHUGEINT) + ((({name} % 4294967296::UHUGEINT) * {high}::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % {WRAP})")
    return made
