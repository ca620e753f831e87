"""Routing expressions: a typed subset of CEL, compiled to Columns.

Columns are declared with their types: int, uint, string, bytes, double, bool. Supported: literals,
lists on the right of `in`, ?:, || && !, comparisons, + - * / %, in, string() int() uint() double()
bytes() bool() size(), the methods contains startsWith endsWith matches size, and shard_hash(). As in
CEL there is no implicit conversion between number types, and overflow is an error. uint is
decimal(20, 0). A result is an int, uint, string or bytes; anything else is refused at compile time,
and so is whatever is not in this list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.errors import ConfigError
from snapforge.functions.hashing import hash_digest, hash_shard

TYPES = ("int", "uint", "string", "bytes", "double", "bool")
ROUTABLE = ("int", "uint", "string", "bytes")
#: Spark types that a declared type can be read from.
READS = {
    "int": ("tinyint", "smallint", "int", "bigint"), "uint": ("tinyint", "smallint", "int", "bigint", "decimal(20,0)"), "string": ("string",),
    "bytes": ("binary",), "double": ("float", "double"), "bool": ("boolean",),
}

TOKEN = re.compile(
    r"\s*(?:(?P<double>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<uint>(?:0x[0-9a-fA-F]+|\d+)[uU])|(?P<int>0x[0-9a-fA-F]+|\d+)"
    r"|(?P<text>[bB]?(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%<>!?:().,\[\]])|(?P<end>\Z))"
)
ESCAPE = re.compile(r"\\(?:([abfnrtv\\\"'`?])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-3][0-7]{2}))")
ESCAPED = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
#: How tightly binary operators bind.
BINDS = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
RESERVED = frozenset(("true", "false", "null", "in", "as", "break", "const", "continue", "else", "for", "function", "if", "import", "let", "loop", "package", "namespace", "return", "var", "void", "while"))


@dataclass(frozen=True)
class Term:
    """A typed Column. literal: its value where it is one. hashed: what a shard_hash() is of."""

    column: Column
    type: str
    literal: object = None
    hashed: Column | None = None


@dataclass(frozen=True)
class Compiled:
    text: str
    column: Column
    type: str
    used: tuple[str, ...]


def _unquote(text: str) -> str | bytes:
    raw = text[0] in "bB"
    body = text[2:-1] if raw else text[1:-1]
    at, out = 0, []
    while (i := body.find("\\", at)) >= 0:
        m = ESCAPE.match(body, i)
        if not m:
            raise ConfigError(f"bad escape in {text}")
        out += [body[at:i], ESCAPED.get(m[1], m[1]) if m[1] else chr(int(m[2] or m[3] or m[4], 16) if not m[5] else int(m[5], 8))]
        at = m.end()
    made = "".join([*out, body[at:]])
    if not raw:
        return made
    try:
        return made.encode("latin-1") if "\\" in body else made.encode()
    except UnicodeEncodeError as error:
        raise ConfigError(f"not bytes: {text}") from error


class _Parser:
    def __init__(self, text: str, columns: Mapping[str, str], source: Callable[[str], Column]):
        self.text, self.columns, self.source, self.used = text, columns, source, []
        self.tokens, at = [], 0
        while not self.tokens or self.tokens[-1][0] != "end":
            m = TOKEN.match(text, at)
            if not m:
                raise ConfigError(f"can't read {text[at:].strip()[:20]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        kind, value = self.tokens[self.at]
        return value if kind in ("op", "name") else ""

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, op: str) -> None:
        kind, value = self.take()
        if (kind, value) != ("op", op):
            raise ConfigError(f"{op!r} expected, not {value!r}, in {self.text!r}")

    def whole(self) -> Term:
        term = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise ConfigError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return term

    def ternary(self) -> Term:
        test = self.binary(1)
        if self.peek() != "?":
            return test
        self.take()
        self.need(test, "bool")
        yes = self.binary(1)
        self.expect(":")
        no = self.ternary()
        if yes.type != no.type:
            raise ConfigError(f"both sides of ?: need one type, not {yes.type} and {no.type}, in {self.text!r}")
        refuse = F.raise_error(F.lit("a condition is null")).cast(_kind(yes.type))
        return Term(F.when(test.column, yes.column).when(~test.column, no.column).otherwise(refuse), yes.type)

    def binary(self, least: int) -> Term:
        left = self.unary()
        while BINDS.get(op := self.peek(), 0) >= least:
            self.take()
            if op == "in":
                left = self.member(left)
            else:
                left = self.combine(op, left, self.binary(BINDS[op] + 1))
        return left

    def member(self, left: Term) -> Term:
        self.expect("[")
        items: list[Term] = []
        while self.peek() != "]":
            items.append(self.ternary())
            if self.peek() != "]":
                self.expect(",")
        self.take()
        for x in items:
            self.need(x, left.type)
        return Term(left.column.isin(*[x.column for x in items]) if items else F.lit(False), "bool")

    def combine(self, op: str, a: Term, b: Term) -> Term:
        if op in ("||", "&&"):
            self.need(a, "bool")
            self.need(b, "bool")
            return Term(a.column | b.column if op == "||" else a.column & b.column, "bool")
        if a.type != b.type:
            raise ConfigError(f"{a.type} {op} {b.type} is not defined in {self.text!r}")
        if BINDS[op] == 3:
            if a.type == "bool" and op not in ("==", "!="):
                raise ConfigError(f"bool {op} bool is not defined in {self.text!r}")
            return Term({"==": a.column == b.column, "!=": a.column != b.column, "<": a.column < b.column, "<=": a.column <= b.column, ">": a.column > b.column, ">=": a.column >= b.column}[op], "bool")
        if op == "+" and a.type in ("string", "bytes"):
            return Term(F.concat(a.column, b.column), a.type)
        if a.type not in ("int", "uint", "double") or op == "%" and a.type == "double":
            raise ConfigError(f"{a.type} {op} {b.type} is not defined in {self.text!r}")
        if op == "%" and a.hashed is not None and isinstance(b.literal, int) and 0 < b.literal < 1 << 31:
            return Term(hash_shard(a.hashed, b.literal).cast("decimal(20,0)"), "uint")
        if op == "/" and a.type != "double":
            made = F.call_function("div", a.column, b.column)
        else:
            made = {"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column, "/": a.column / b.column, "%": a.column % b.column}[op]
        return Term(_unsigned(made) if a.type == "uint" else made, a.type)

    def unary(self) -> Term:
        op = self.peek()
        if op == "!":
            self.take()
            term = self.unary()
            self.need(term, "bool")
            return Term(~term.column, "bool")
        if op == "-":
            self.take()
            term = self.unary()
            if term.type not in ("int", "double"):
                raise ConfigError(f"-{term.type} is not defined in {self.text!r}")
            return Term(-term.column, term.type)
        return self.methods(self.primary())

    def methods(self, term: Term) -> Term:
        while self.peek() == ".":
            self.take()
            name = self.take()[1]
            args = self.arguments()
            if name == "size" and not args:
                term = self.size(term)
                continue
            if name not in ("contains", "startsWith", "endsWith", "matches") or len(args) != 1:
                raise ConfigError(f"no method {name}() of {len(args)} arguments in {self.text!r}")
            self.need(term, "string")
            self.need(args[0], "string")
            term = Term({"contains": term.column.contains, "startsWith": term.column.startswith, "endsWith": term.column.endswith, "matches": lambda p, c=term.column: F.regexp_like(c, p)}[name](args[0].column), "bool")
        return term

    def arguments(self) -> list[Term]:
        self.expect("(")
        args: list[Term] = []
        while self.peek() != ")":
            args.append(self.ternary())
            if self.peek() != ")":
                self.expect(",")
        self.take()
        return args

    def primary(self) -> Term:
        kind, value = self.take()
        if kind == "op" and value == "(":
            term = self.ternary()
            self.expect(")")
            return term
        if kind in ("int", "uint"):
            n = int(value.rstrip("uU"), 0)
            if n >= 1 << (63 if kind == "int" else 64):
                raise ConfigError(f"{value} is out of range")
            return Term(F.lit(str(n)).cast(_kind(kind)), kind, n)
        if kind == "double":
            return Term(F.lit(float(value)), "double", float(value))
        if kind == "text":
            made = _unquote(value)
            return Term(F.lit(made), "bytes" if isinstance(made, bytes) else "string", made)
        if kind != "name":
            raise ConfigError(f"unexpected {value or 'end'!r} in {self.text!r}")
        if value in ("true", "false"):
            return Term(F.lit(value == "true"), "bool", value == "true")
        if self.peek() == "(":
            return self.call(value, self.arguments())
        if value in RESERVED or value not in self.columns:
            raise ConfigError(f"no such column: {value}; declared are {', '.join(self.columns)}")
        if value not in self.used:
            self.used.append(value)
        own = self.source(value)
        return Term(own.cast(_kind(self.columns[value])), self.columns[value])

    def call(self, name: str, args: list[Term]) -> Term:
        if len(args) != 1:
            raise ConfigError(f"{name}() takes one argument in {self.text!r}")
        x = args[0]
        if name == "size":
            return self.size(x)
        if name == "shard_hash":
            if x.type not in ROUTABLE:
                raise ConfigError(f"shard_hash({x.type}) is not defined: wrap it in string()")
            key = x.column.cast("long") if x.type == "uint" else x.column
            return Term(hash_digest(key), "uint", hashed=key)
        if name == "string":
            whole = F.when((x.column == F.floor(x.column)) & (F.abs(x.column) < 1e15), x.column.cast("long").cast("string")) if x.type == "double" else None
            made = F.decode(x.column, "UTF-8") if x.type == "bytes" else x.column.cast("string")
            return Term(made if whole is None else whole.otherwise(made), "string")
        if name == "bytes" and x.type in ("string", "bytes"):
            return Term(F.encode(x.column, "UTF-8") if x.type == "string" else x.column, "bytes")
        if name in ("int", "uint", "double", "bool") and (x.type in ("int", "uint", "double", "string") and name != "bool" or name == "bool" and x.type in ("bool", "string")):
            made = x.column.cast(_kind(name))
            return Term(_unsigned(F.floor(x.column).cast("decimal(20,0)") if x.type == "double" else made) if name == "uint" else made, name)
        raise ConfigError(f"{name}({x.type}) is not defined in {self.text!r}")

    def size(self, x: Term) -> Term:
        if x.type not in ("string", "bytes"):
            raise ConfigError(f"size({x.type}) is not defined in {self.text!r}")
        return Term(F.length(x.column).cast("long"), "int")

    def need(self, term: Term, kind: str) -> None:
        if term.type != kind:
            raise ConfigError(f"{kind} expected, not {term.type}, in {self.text!r}")


def _kind(name: str) -> str:
    return {"int": "bigint", "uint": "decimal(20,0)", "string": "string", "bytes": "binary", "double": "double", "bool": "boolean"}[name]


def _unsigned(column: Column) -> Column:
    bad = (column < 0) | (column > F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"))
    return F.when(bad, F.raise_error(F.lit("uint out of range")).cast("decimal(20,0)")).otherwise(column.cast("decimal(20,0)"))


def compile_expression(text: str, columns: Mapping[str, str], source: Callable[[str], Column] = F.col) -> Compiled:
    """text over declared columns {name: type} as a Column. `source` gives the Column of a name."""
    if unknown := {k: t for k, t in columns.items() if t not in TYPES}:
        raise ConfigError(f"no such types: {unknown}")
    parser = _Parser(text, columns, source)
    term = parser.whole()
    if term.type not in ROUTABLE:
        raise ConfigError(f"a routing expression gives an int, uint, string or bytes, not {term.type}: {text!r}")
    return Compiled(text, term.column, term.type, tuple(parser.used))


def check_columns(df: DataFrame, columns: Mapping[str, str]) -> None:
    """An error where declared columns are missing or of other types."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    for name, kind in columns.items():
        if name not in kinds:
            raise ConfigError(f"no such column: {name}")
        if kinds[name] not in READS[kind]:
            raise ConfigError(f"column {name} is {kinds[name]}, which {kind} can't be read from")


def by_columns(columns: Mapping[str, str], num_shards: int | None = None, separator: str = ":") -> str:
    """The expression that routes by columns: by the hash of one or of several joined, or without num_shards by value."""
    if not columns:
        raise ConfigError("no columns")
    as_text = lambda c, t: c if t == "string" else f"string({c})"
    if len(columns) == 1:
        (name, kind), = columns.items()
        value = name if kind in ROUTABLE else f"string({name})"
    else:
        mark = f" + {json.dumps(separator)} + " if separator else " + "
        value = reduce(lambda a, b: f"{a}{mark}{b}", (as_text(c, t) for c, t in columns.items()))
    return value if num_shards is None else f"shard_hash({value}) % {int(num_shards)}u"


def check_routing_values(values: Sequence) -> None:
    """Categories are integers, strings or bytes of one type, without null, bool or repetition."""
    if any(v is None or isinstance(v, bool) or not isinstance(v, (int, str, bytes)) for v in values):
        raise ConfigError("routing values are integers, strings or bytes")
    if len({type(v) for v in values}) > 1:
        raise ConfigError("routing values need one type")
    if len(set(values)) < len(values):
        raise ConfigError("routing values repeat")
