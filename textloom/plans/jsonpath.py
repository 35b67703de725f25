"""A subset of JSONPath compiled to columns.

A path is over the document as JSON (a VARIANT column).  Supported: $ . .name ['name'] [index] [*] and one filter
[?(...)] with @ paths, && || !, parentheses, the comparisons == != < <= > >= and literals.  Anything else raises PathError.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class PathError(ValueError):
    """The path uses a form that isn't supported."""


_STEP = re.compile(r"\.(?P<name>[A-Za-z_][\w-]*)|\[\s*'(?P<quoted>[^']*)'\s*\]|\[\s*\"(?P<double>[^\"]*)\"\s*\]|\[(?P<index>\d+)\]|(?P<all>\[\*\])|(?P<filter>\[\?\()")
_TOKEN = re.compile(r"\s*(?:(?P<op>&&|\|\||==|!=|<=|>=|<|>|!|\(|\))|(?P<path>@(?:\.[A-Za-z_][\w-]*|\['[^']*'\]|\[\d+\])*)|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>'[^']*'|\"[^\"]*\")|(?P<word>true|false|null))")


def variant_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)


def _steps(text: str) -> tuple[list[str | int], str]:
    """Plain steps at the head of a path, and the rest."""
    steps: list[str | int] = []
    while m := _STEP.match(text):
        if m["all"] or m["filter"]:
            break
        steps.append(int(m["index"]) if m["index"] is not None else next(x for x in (m["name"], m["quoted"], m["double"]) if x is not None))
        text = text[m.end() :]
    return steps, text


def get(doc: Column, steps: list[str | int], kind: str = "variant") -> Column:
    return F.try_variant_get(doc, variant_path(steps), kind) if steps else doc


class _Filter:
    """Recursive descent over a filter's tokens."""

    def __init__(self, text: str, item: Column):
        self.item, self.tokens, at = item, [], 0
        while at < len(text):
            if not text[at:].strip():
                break
            m = _TOKEN.match(text, at)
            if not m:
                raise PathError(f"not understood: {text[at:]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str] | tuple[None, None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self) -> tuple[str, str]:
        token = self.peek()
        if token[0] is None:
            raise PathError("a filter ends too early")
        self.at += 1
        return token

    def parse(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise PathError(f"not understood: {self.peek()[1]}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek()[1] == "||":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.unary()
        while self.peek()[1] == "&&":
            self.take()
            out = out & self.unary()
        return out

    def unary(self) -> Column:
        if self.peek()[1] == "!":
            self.take()
            return ~self.unary()
        if self.peek()[1] == "(":
            self.take()
            out = self.either()
            if self.take()[1] != ")":
                raise PathError("a parenthesis isn't closed")
            return out
        return self.comparison()

    def comparison(self) -> Column:
        left = self.take()
        op = self.peek()[1]
        if op not in ("==", "!=", "<", "<=", ">", ">="):
            if left[0] != "path":
                raise PathError(f"{left[1]} is no condition")
            return self._exists(left[1])
        self.take()
        right = self.take()
        if left[0] != "path":
            left, right = right, left
            op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if left[0] != "path":
            raise PathError("a comparison needs a path")
        return self._compare(left[1], op, right)

    def _of(self, path: str, kind: str) -> Column:
        steps, rest = _steps(path[1:])
        if rest:
            raise PathError(f"not understood: {rest}")
        return get(self.item, steps, kind)

    def _exists(self, path: str) -> Column:
        value = self._of(path, "variant")
        return value.isNotNull()

    def _compare(self, path: str, op: str, right: tuple[str, str]) -> Column:
        kind, text = right
        if kind == "path":
            a, b = F.to_json(self._of(path, "variant")), F.to_json(self._of(text, "variant"))
            x, y = self._of(path, "double"), self._of(text, "double")
            same = F.coalesce(x == y, a == b, F.lit(False))
            if op in ("==", "!="):
                return same if op == "==" else ~same
            return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))
        # a number equals numbers alone, a string strings alone: the JSON type of the value decides
        name = F.schema_of_variant(self._of(path, "variant"))
        number = name.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        if kind == "num":
            v, want, typed = self._of(path, "double"), F.lit(float(text)), number
        elif kind == "str":
            v, want, typed = self._of(path, "string"), F.lit(text[1:-1]), name == "STRING"
        elif text == "null":
            isnull = F.coalesce(F.is_variant_null(self._of(path, "variant")), F.lit(False))
            return isnull if op == "==" else ~isnull
        else:
            v, want, typed = self._of(path, "boolean"), F.lit(text == "true"), name == "BOOLEAN"
        test = {"==": v == want, "!=": v != want, "<": v < want, "<=": v <= want, ">": v > want, ">=": v >= want}[op]
        return F.coalesce(typed & test, F.lit(op == "!="))


def _split_filter(text: str) -> tuple[str, str]:
    """The inside of [?( ... )] at the head of a text, and what follows."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                if text[i + 1 : i + 2] != "]":
                    break
                return text[3:i], text[i + 2 :]
    raise PathError(f"a filter isn't closed: {text}")


def matches(doc: Column, path: str) -> Column:
    """Whether the path finds anything but null in the document."""
    if not path.startswith("$"):
        raise PathError(f"a path begins with $: {path}")
    steps, rest = _steps(path[1:])
    here = get(doc, steps)
    real = lambda v: F.coalesce(v.isNotNull() & ~F.is_variant_null(v), F.lit(False))
    if not rest:
        return real(here)
    items = F.coalesce(get(doc, steps, "array<variant>"), F.array().cast("array<variant>"))
    single = F.coalesce(F.schema_of_variant(here).startswith("OBJECT"), F.lit(False))
    if rest.startswith("[*]"):
        more, left = _steps(rest[3:])
        if left:
            raise PathError(f"not understood: {left}")
        values = F.coalesce(F.map_values(get(doc, steps, "map<string,variant>")), F.array().cast("array<variant>"))
        test = lambda v: real(get(v, more))
        return F.exists(items, test) | (single & F.exists(values, test))
    if rest.startswith("[?("):
        inside, left = _split_filter(rest)
        more, after = _steps(left)
        if after:
            raise PathError(f"not understood: {after}")
        test = lambda v: _Filter(inside, v).parse() & (real(get(v, more)) if more else F.lit(True))
        # a filter over an object tests the object itself, over an array each of its items
        return F.coalesce(F.exists(items, test), F.lit(False)) | F.coalesce(single & test(here), F.lit(False))
    raise PathError(f"not understood: {rest}")


def select(doc: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path of plain steps, null if there is none."""
    steps, rest = _steps(path[1:])
    if not path.startswith("$") or rest:
        raise PathError(f"only plain paths select: {path}")
    return get(doc, steps, kind)
