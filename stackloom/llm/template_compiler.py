"""A small sandboxed template language, compiled to Python closures.

    text {{ expression }} {% for x in list %}...{% endfor %} {% if c %}...{% elif c %}...{% else %}...{% endif %}
    {% set name = expression %} {% generation %}...{% endgeneration %}

Expressions: string, integer, true, false, none, names, ``a.b`` and ``a['b']`` (dictionary keys only), ``~`` and ``+``,
``== != < > <= >= in``, ``and or not``, parentheses, filters ``x | trim``. In a loop ``loop.index``, ``loop.index0``,
``loop.first`` and ``loop.last`` are known. There are no calls and no attributes of Python objects, so a template reaches
nothing but its own values and the filters it is compiled with. A missing key or name is empty text.

Source text is parsed to a tree; constant parts of it are evaluated once (filters marked pure too) and neighbouring
constant text is joined; the tree becomes one closure, a generator of (text, inside a generation block).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template can't be parsed, or uses what the sandbox doesn't have."""


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Key:
    of: object
    key: object


@dataclass
class Binary:
    op: str
    left: object
    right: object


@dataclass
class Not:
    of: object


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Out:
    of: object


@dataclass
class For:
    name: str
    of: object
    body: list = field(default_factory=list)


@dataclass
class If:
    cases: list  # of (condition, body)


@dataclass
class Set:
    name: str
    of: object


@dataclass
class Generation:
    body: list = field(default_factory=list)


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[~+.<>|()\[\]=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_CONSTANTS = {"true": True, "false": False, "none": None}


def _lex(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise TemplateError(f"can't read {text[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~", "+"))

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        made = self.level(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return made

    def level(self, i: int):
        if i == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[i] == ("not",):
            return Not(self.level(i)) if self.take("not") else self.level(i + 1)
        left = self.level(i + 1)
        while (op := self.peek()) in self.LEVELS[i]:
            self.at += 1
            left = Binary(op, left, self.level(i + 1))
        return left

    def filtered(self):
        made = self.atom()
        while True:
            if self.take("."):
                made = Key(made, Const(self.name()))
            elif self.take("["):
                made = Key(made, self.level(0))
                self.need("]")
            elif self.take("|"):
                made = Filter(self.name(), made)
            else:
                return made

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind == "name" and text not in ("and", "or", "not", "in"):
            return Const(_CONSTANTS[text]) if text in _CONSTANTS else Name(text)
        if text == "(":
            made = self.level(0)
            self.need(")")
            return made
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """Syntax tree: a list of nodes, where text is ``Out(Const(text))``."""
    top: list = []
    stack: list[tuple[str, object, list]] = [("", None, top)]
    for i, part in enumerate(_PARTS.split(source)):
        body = stack[-1][2]
        if not part or i % 2 and part.startswith("{#"):
            continue
        if not i % 2:  # text between tags
            if any(x in part for x in ("{{", "{%", "{#")):
                raise TemplateError("a tag isn't closed")
            body.append(Out(Const(part)))
        elif part.startswith("{{"):
            body.append(Out(_Expression(_lex(part[2:-2])).whole()))
        elif part.startswith("{%"):
            tokens = _lex(part[2:-2].strip().removeprefix("-").removesuffix("-"))
            if not tokens:
                raise TemplateError("an empty tag")
            word, e = tokens[0][1], _Expression(tokens[1:])
            if word == "for":
                name = e.name()
                e.need("in")
                node = For(name, e.whole())
                body.append(node)
                stack.append(("for", node, node.body))
            elif word == "if":
                node = If([(e.whole(), [])])
                body.append(node)
                stack.append(("if", node, node.cases[0][1]))
            elif word in ("elif", "else"):
                kind, node, _ = stack.pop()
                if kind != "if":
                    raise TemplateError(f"{word} without if")
                node.cases.append((e.whole() if word == "elif" else Const(True), []))
                stack.append(("if", node, node.cases[-1][1]))
            elif word == "set":
                name = e.name()
                e.need("=")
                body.append(Set(name, e.whole()))
            elif word == "generation":
                if any(kind == "generation" for kind, _, _ in stack):
                    raise TemplateError("a generation block inside another")
                node = Generation()
                body.append(node)
                stack.append(("generation", node, node.body))
            elif word in ("endfor", "endif", "endgeneration"):
                if stack[-1][0] != word[3:]:
                    raise TemplateError(f"unexpected {word}")
                stack.pop()
            else:
                raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return top


def _text(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _apply(op: str, a: object, b: object) -> object:
    match op:
        case "~":
            return _text(a) + _text(b)
        case "+":
            return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
        case "==":
            return a == b
        case "!=":
            return a != b
        case "in":
            return a in b if isinstance(b, (str, dict, list)) and not (isinstance(b, str) and not isinstance(a, str)) else False
        case "<":
            return a < b
        case ">":
            return a > b
        case "<=":
            return a <= b
    return a >= b


def _key(of: object, key: object) -> object:
    """Keys of dictionaries only: no attribute of any object can be reached."""
    return of.get(key) if isinstance(of, dict) else None


FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower}


def fold(node, filters: dict[str, Callable[[str], str]]):
    """The node with its constant parts evaluated."""
    if isinstance(node, list):
        out: list = []
        for x in (fold(n, filters) for n in node):
            if isinstance(x, list):
                made = x
            else:
                made = [x]
            for y in made:
                if isinstance(y, Out) and isinstance(y.of, Const):
                    y = Out(Const(_text(y.of.value)))
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].of, Const):
                        out[-1] = Out(Const(out[-1].of.value + y.of.value))
                        continue
                    if not y.of.value:
                        continue
                out.append(y)
        return out
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if node.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const) and node.op not in ("and", "or"):
            return Const(_apply(node.op, left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Not):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Out):
        return Out(fold(node.of, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.of, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        cases = []
        for condition, body in node.cases:
            c = fold(condition, filters)
            if isinstance(c, Const) and not c.value:
                continue
            cases.append((c, fold(body, filters)))
            if isinstance(c, Const):
                break
        if not cases:
            return []
        return cases[0][1] if isinstance(cases[0][0], Const) else If(cases)
    return node


def _value(node, filters) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Key):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda scope: _key(of(scope), key(scope))
    if isinstance(node, Not):
        of = _value(node.of, filters)
        return lambda scope: not of(scope)
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda scope: f(_text(of(scope)))
    left, right, op = _value(node.left, filters), _value(node.right, filters), node.op
    if op == "and":
        return lambda scope: left(scope) and right(scope)
    if op == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope: _apply(op, left(scope), right(scope))


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _body(nodes: list, filters) -> Render:
    steps = [_step(n, filters) for n in nodes]

    def run(scope: dict, inside: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope, inside)

    return run


def _step(node, filters) -> Render:
    if isinstance(node, Out):
        of = _value(node.of, filters)

        def out(scope, inside):
            if text := _text(of(scope)):
                yield text, inside

        return out
    if isinstance(node, Set):
        of, name = _value(node.of, filters), node.name

        def put(scope, inside):
            scope[name] = of(scope)
            return iter(())

        return put
    if isinstance(node, Generation):
        body = _body(node.body, filters)
        return lambda scope, inside: body(scope, True)
    if isinstance(node, If):
        cases = [(_value(c, filters), _body(b, filters)) for c, b in node.cases]

        def choose(scope, inside):
            for condition, body in cases:
                if condition(scope):
                    yield from body(scope, inside)
                    return

        return choose
    of, name, body = _value(node.of, filters), node.name, _body(node.body, filters)

    def loop(scope, inside):
        made = of(scope)
        items = iter(made if isinstance(made, Iterable) and not isinstance(made, (str, dict)) else ())
        own, end = dict(scope), object()
        item, i = next(items, end), 0
        while item is not end:  # one item ahead, so a list is never held as a whole
            after = next(items, end)
            own[name] = item
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is end}
            yield from body(own, inside)
            item, i = after, i + 1

    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's variables that yields (text, inside a generation block)."""
    filters = FILTERS | (filters or {})
    run = _body(fold(parse(source), filters), filters)
    return lambda **variables: run(dict(variables), False)
