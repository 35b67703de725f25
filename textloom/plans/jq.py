"""A subset of jq compiled to columns.

Supported: . .name ."name" ["name"] [index], literals, == != < <= > >=, and or, | with not length type, + - * / on numbers, // and
if-then-elif-else-end, parentheses.  Each expression has one output.  As in jq, indexing null or a scalar by a further step is an error
that fails the query.  Anything else raises JqError when the plan is made.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonpath import variant_path


class JqError(ValueError):
    """The program uses a form that isn't supported."""


_TOKEN = re.compile(r'\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<op>==|!=|<=|>=|//|[-<>+*/|()\[\].])|(?P<word>[A-Za-z_]\w*))')


class Value:
    """An expression: as JSON text for comparisons, as a number, and its jq type."""

    def __init__(self, kind: Column, number: Column, string: Column, json: Column, length: Column, true: Column, path: tuple[Column, list] | None = None):
        self.kind, self.number, self.string, self.json, self.length, self.true, self.path = kind, number, string, json, length, true, path


def literal(x) -> Value:
    kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
    json = {"null": "null", "boolean": str(x).lower(), "string": "s" + str(x), "number": ""}[kind]
    null = F.lit(None)
    number = F.lit(float(x)) if kind == "number" else null.cast("double")
    size = {"null": 0.0, "string": float(len(x or "")) if kind == "string" else 0.0, "number": abs(x) if kind == "number" else 0.0, "boolean": None}[kind]
    return Value(F.lit(kind), number, F.lit(x) if kind == "string" else null.cast("string"), F.lit(json), F.lit(size).cast("double"), F.lit(x is not None and x is not False))


def _bool(c: Column) -> Value:
    return Value(F.lit("boolean"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.when(c, "true").otherwise("false"), F.lit(None).cast("double"), c)


def _number(c: Column) -> Value:
    return Value(F.lit("number"), c, F.lit(None).cast("string"), F.lit(""), F.abs(c), F.lit(True))


def of_path(doc: Column, steps: list[str | int]) -> Value:
    v = F.try_variant_get(doc, variant_path(steps), "variant") if steps else doc
    for k in range(1, len(steps)):
        above = F.try_variant_get(doc, variant_path(steps[:k]), "variant")
        name = F.coalesce(F.schema_of_variant(above), F.lit("VOID"))
        v = F.when(name.startswith("OBJECT") | name.startswith("ARRAY"), v).otherwise(F.raise_error(F.lit(f"jq: cannot index {variant_path(steps[:k])} with {steps[k]}")).cast("variant"))
    name = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    kind = F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    get = lambda t: F.try_variant_get(v, "$", t)
    number = F.when(kind == "number", get("double"))
    string = F.when(kind == "string", get("string"))
    json = F.when(kind == "string", F.concat(F.lit("s"), string)).when(kind == "number", F.lit("")).otherwise(F.coalesce(F.to_json(v), F.lit("null")))
    size = F.when(kind == "null", 0).when(kind == "string", F.length(string)).when(kind == "number", F.abs(number)).when(kind == "array", F.size(get("array<variant>"))).when(kind == "object", F.size(get("map<string,variant>")))
    true = (kind != "null") & ~((kind == "boolean") & ~F.coalesce(get("boolean"), F.lit(False)))
    return Value(kind, number, string, json, size.cast("double"), true, (doc, steps))


_ORDER = {"null": 0, "boolean": 1, "number": 2, "string": 3, "array": 4, "object": 5}


def _rank(kind: Column) -> Column:
    out = F.lit(9)
    for k, n in _ORDER.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def compare(a: Value, op: str, b: Value) -> Value:
    same = (a.kind == b.kind) & F.when(a.kind == "number", a.number == b.number).otherwise(a.json == b.json)
    same = F.coalesce(same, F.lit(False))
    less = F.when(a.kind != b.kind, _rank(a.kind) < _rank(b.kind)).when(a.kind == "number", a.number < b.number).when(a.kind == "string", a.string < b.string).otherwise(a.json < b.json)
    less = F.coalesce(less, F.lit(False))
    return _bool({"==": same, "!=": ~same, "<": less, "<=": less | same, ">": ~less & ~same, ">=": ~less}[op])


def choose(test: Column, a: Value, b: Value) -> Value:
    pick = lambda x, y: F.when(test, x).otherwise(y)
    return Value(*(pick(getattr(a, k), getattr(b, k)) for k in ("kind", "number", "string", "json", "length", "true")))


class Parser:
    def __init__(self, program: str):
        self.tokens, at = [], 0
        while program[at:].strip():
            m = _TOKEN.match(program, at)
            if not m:
                raise JqError(f"not understood: {program[at:]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise JqError("the program ends too early")
        kind, text, _ = self.tokens[self.at]
        if want and text != want:
            raise JqError(f"{want} is missing before {text}")
        self.at += 1
        return kind, text

    def parse(self) -> Callable[[Value], Value]:
        out = self.pipe()
        if self.at < len(self.tokens):
            raise JqError(f"not understood: {self.peek()}")
        return out

    def pipe(self):
        f = self.alternative()
        while self.peek() == "|":
            self.take()
            f = self._then(f, self.alternative())
        return f

    @staticmethod
    def _then(f, g):
        return lambda v: g(f(v))

    def alternative(self):
        f = self.either()
        if self.peek() == "//":
            self.take()
            g = self.alternative()
            return lambda v: (lambda a: choose(a.true, a, g(v)))(f(v))
        return f

    def _chain(self, words: tuple[str, ...], below, make):
        f = below()
        while self.peek() in words:
            op = self.take()[1]
            f = (lambda f, op, g: lambda v: make(f(v), op, g(v)))(f, op, below())
        return f

    def either(self):
        return self._chain(("or",), self.both, lambda a, _, b: _bool(a.true | b.true))

    def both(self):
        return self._chain(("and",), self.comparison, lambda a, _, b: _bool(a.true & b.true))

    def comparison(self):
        return self._chain(("==", "!=", "<", "<=", ">", ">="), self.sum, compare)

    @staticmethod
    def _arithmetic(a: Value, op: str, b: Value) -> Value:
        fail = F.raise_error(F.lit(f"jq: {op} needs numbers")).cast("double")
        x, y = (F.when(v.kind == "number", v.number).otherwise(F.when(v.kind == "null", 0.0).otherwise(fail) if op == "+" else fail) for v in (a, b))
        return _number({"+": x + y, "-": x - y, "*": x * y}[op] if op != "/" else x / y)

    def sum(self):
        return self._chain(("+", "-"), self.product, self._arithmetic)

    def product(self):
        return self._chain(("*", "/"), self.term, self._arithmetic)

    def term(self):
        kind, text = self.take()
        if text == "-":
            f = self.term()
            return lambda v: self._arithmetic(literal(0), "-", f(v))
        if kind == "num":
            return lambda v, x=float(text): literal(x)
        if kind == "str":
            return lambda v, x=_unquote(text): literal(x)
        if text == "(":
            f = self.pipe()
            self.take(")")
            return f
        if text in ("true", "false", "null"):
            return lambda v, x={"true": True, "false": False, "null": None}[text]: literal(x)
        if text == "if":
            return self.condition()
        if text == "not":
            return lambda v: _bool(~v.true)
        if text == "length":
            return lambda v: _number(F.when(v.kind == "boolean", F.raise_error(F.lit("jq: a boolean has no length")).cast("double")).otherwise(v.length))
        if text == "type":
            return lambda v: Value(F.lit("string"), F.lit(None).cast("double"), v.kind, F.concat(F.lit("s"), v.kind), F.length(v.kind).cast("double"), F.lit(True))
        if text == ".":
            return self.path()
        raise JqError(f"not supported: {text}")

    def condition(self):
        test = self.pipe()
        self.take("then")
        yes = self.pipe()
        word = self.take()[1]
        if word == "elif":
            no = self.condition()
            return lambda v: choose(test(v).true, yes(v), no(v))
        if word == "else":
            no = self.pipe()
            self.take("end")
            return lambda v: choose(test(v).true, yes(v), no(v))
        if word == "end":
            return lambda v: choose(test(v).true, yes(v), v)
        raise JqError(f"else or end is missing before {word}")

    def path(self):
        steps: list[str | int] = []
        first = True
        while True:
            nxt = self.peek()
            if nxt == "[":
                self.take()
                kind, text = self.take()
                if kind not in ("num", "str"):
                    raise JqError("only names and numbers in brackets are supported")
                steps.append(_unquote(text) if kind == "str" else int(text))
                self.take("]")
            elif first and nxt is not None and self.tokens[self.at][0] in ("word", "str") and self._adjacent():
                kind, text = self.take()
                steps.append(_unquote(text) if kind == "str" else text)
            elif nxt == "." and not first:
                self.take()
                if self.peek() == "[":
                    continue
                kind, text = self.take()
                if kind not in ("word", "str"):
                    raise JqError(f"no name: {text}")
                steps.append(_unquote(text) if kind == "str" else text)
            else:
                break
            first = False

        def run(v: Value) -> Value:
            if not steps:
                return v
            if v.path is None:
                raise JqError("only the document and its parts have fields")
            return of_path(v.path[0], v.path[1] + steps)

        return run

    def _adjacent(self) -> bool:
        """Whether the next token follows the dot without a blank."""
        return self.tokens[self.at][2] == self.tokens[self.at - 1][2] + 1


def _unquote(text: str) -> str:
    import json

    return json.loads(text)


def truthy(doc: Column, program: str) -> Column:
    """Whether the program's output is true as filters have it: not null, false, 0, "", [] or {}."""
    v = Parser(program).parse()(of_path(doc, []))
    empty = F.when(v.kind == "number", v.number == 0).when(v.kind.isin("string", "array", "object"), v.length == 0).otherwise(F.lit(False))
    return F.coalesce(v.true & ~empty, F.lit(False))


def text(doc: Column, program: str) -> Column:
    """The program's output as text: a string itself, a number without a needless point, nothing for null."""
    v = Parser(program).parse()(of_path(doc, []))
    number = F.when(v.number == F.floor(v.number), F.floor(v.number).cast("string")).otherwise(v.number.cast("string"))
    return F.when(v.kind == "null", "").when(v.kind == "string", v.string).when(v.kind == "number", number).otherwise(v.json)
