"""A small sandboxed template language, compiled to Python closures.

    text {{ expression }} {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in e %} {% endfor %} {% generation %} {% endgeneration %}

Expressions: string and integer literals, names, ``a.b`` and ``a['b']`` (dictionary fields only), ``+`` and
``~`` (join), ``==``, ``!=``, ``and``, ``or``, ``not``, brackets and filters from a fixed table.  There are no
calls and no access to Python attributes.  In a loop ``loop.first``, ``loop.last``, ``loop.index0`` are set.

A template is parsed to a tree, constant parts are folded (joined texts, constant expressions, decided
branches) and the rest becomes nested closures.  Rendering is lazy: it yields (text, generated) pieces while
it walks an iterator of messages, so a conversation of any length is rendered in constant memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

Piece = tuple[str, bool]
Env = dict[str, object]

TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.S)
LEXEME = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().\[\]+~|]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template cannot be compiled."""


def lexemes(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 10]!r}")
        string, number, name, sign = m.groups()
        if string is not None:
            out.append(("string", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
        else:
            out.append(("number", number) if number else ("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class Expressions:
    """Recursive descent over the lexemes of one tag; nodes are tuples."""

    def __init__(self, source: str, filters: dict[str, Callable[[str], str]]):
        self.items, self.at, self.filters = lexemes(source), 0, filters

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *wanted: tuple[str, str]) -> tuple[str, str] | None:
        if self.peek() in wanted:
            self.at += 1
            return self.items[self.at - 1]
        return None

    def need(self, kind: str, value: str | None = None) -> str:
        found = self.peek()
        if found[0] != kind or value is not None and found[1] != value:
            raise TemplateError(f"expected {value or kind}, found {found[1]!r}")
        self.at += 1
        return found[1]

    def whole(self) -> tuple:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return fold(node)

    def either(self) -> tuple:
        node = self.both()
        while self.take(("name", "or")):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take(("name", "and")):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while op := self.take(("sign", "=="), ("sign", "!=")):
            node = (op[1], node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take(("sign", "+"), ("sign", "~")):
            node = ("join", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take(("sign", "|")):
            name = self.need("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", node, self.filters[name])
        return node

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "string":
            node: tuple = ("const", value)
        elif kind == "number":
            node = ("const", int(value))
        elif kind == "name":
            node = ("const", {"true": True, "false": False}[value]) if value in ("true", "false") else ("name", value)
        elif (kind, value) == ("sign", "("):
            node = self.either()
            self.need("sign", ")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.take(("sign", ".")):
                node = ("field", node, self.need("name"))
            elif self.take(("sign", "[")):
                node = ("field", node, self.need("string"))
                self.need("sign", "]")
            else:
                return node


def fold(node: tuple) -> tuple:
    """Evaluate what holds only constants."""
    if node[0] in ("const", "name"):
        return node
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "const" for x in parts[1:] if isinstance(x, tuple)) and node[0] != "field":
        return ("const", evaluator(parts)({}))
    return parts


def evaluator(node: tuple) -> Callable[[Env], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n, "")
    if kind == "field":
        inner, key = evaluator(node[1]), node[2]

        def field(env: Env) -> object:
            value = inner(env)
            return value.get(key, "") if type(value) is dict else ""

        return field
    if kind == "filter":
        return lambda env, f=evaluator(node[1]), g=node[2]: g(str(f(env)))
    if kind == "not":
        return lambda env, f=evaluator(node[1]): not f(env)
    a, b = evaluator(node[1]), evaluator(node[2])
    return {
        "join": lambda env: str(a(env)) + str(b(env)),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
    }[kind]


def parse(source: str, filters: dict[str, Callable[[str], str]]) -> list[tuple]:
    """The tree of a template: text, show, if, for and generation nodes."""
    tokens, at = [], 0
    for m in TAG.finditer(source):
        tokens.append(("text", source[at : m.start()]))
        tokens.append(("show", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    tokens.append(("text", source[at:]))
    place = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal place
        out: list[tuple] = []
        while place < len(tokens):
            kind, value = tokens[place]
            place += 1
            if kind == "text":
                out.append(("text", value))
            elif kind == "show":
                out.append(("show", Expressions(value, filters).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, value
                if word == "if":
                    out.append(branch(rest))
                elif word == "for":
                    name, _, iterable = rest.strip().partition(" in ")
                    if not name.strip().isidentifier():
                        raise TemplateError(f"bad loop {value!r}")
                    body, _ = block("endfor")
                    out.append(("for", name.strip(), Expressions(iterable, filters).whole(), body))
                elif word == "generation":
                    out.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return out, ""

    def branch(condition: str) -> tuple:
        test = Expressions(condition, filters).whole()
        body, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", test, body, [branch(end[4:])])
        return ("if", test, body, block("endif")[0] if end == "else" else [])

    return block()[0]


def folded(nodes: list[tuple]) -> list[tuple]:
    """Join neighbouring constant texts and decide constant branches."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "show" and node[1][0] == "const":
            node = ("text", str(node[1][1]))
        if node[0] == "if":
            node = ("if", node[1], folded(node[2]), folded(node[3]))
        elif node[0] == "for":
            node = (*node[:3], folded(node[3]))
        elif node[0] == "generation":
            node = ("generation", folded(node[1]))
        chosen = [node]
        if node[0] == "if" and node[1][0] == "const":
            chosen = node[2] if node[1][1] else node[3]
        for x in chosen:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


Render = Callable[[Env, bool], Iterator[Piece]]


def with_last(items: Iterator) -> Iterator[tuple[object, bool]]:
    items = iter(items)
    for held in items:
        for x in items:
            yield held, False
            held = x
        yield held, True


def closure(nodes: list[tuple]) -> Render:
    steps = [step(n) for n in nodes]

    def render(env: Env, marked: bool) -> Iterator[Piece]:
        for s in steps:
            yield from s(env, marked)

    return render


def step(node: tuple) -> Render:
    kind = node[0]
    if kind == "text":
        return lambda env, marked, t=node[1]: iter(((t, marked),))
    if kind == "show":
        value = evaluator(node[1])
        return lambda env, marked: iter(((str(value(env)), marked),))
    if kind == "generation":
        inner = closure(node[1])
        return lambda env, marked: inner(env, True)
    if kind == "if":
        test, yes, no = evaluator(node[1]), closure(node[2]), closure(node[3])
        return lambda env, marked: (yes if test(env) else no)(env, marked)
    name, items, body = node[1], evaluator(node[2]), closure(node[3])

    def loop(env: Env, marked: bool) -> Iterator[Piece]:
        for i, (item, last) in enumerate(with_last(items(env))):
            yield from body({**env, name: item, "loop": {"first": i == 0, "last": last, "index0": i}}, marked)

    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[Env], Iterator[Piece]]:
    """A function from variables to (text, generated) pieces."""
    render = closure(folded(parse(source, filters or {})))
    return lambda env: render(env, False)
