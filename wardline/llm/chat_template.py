"""A small sandboxed template language for conversations, compiled to Python closures.

    {% for m in messages %}<turn>{{ m.role | field }}
    {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}...{% endif %}{% endfor %}

Statements: ``for x in messages``, ``if`` / ``elif`` / ``else``, ``set name = expr``, ``generation``. Expressions:
strings, whole numbers, ``true``, ``false``, names, ``x.field`` of a message or of ``loop`` (``first``, ``index``),
``==``, ``!=``, ``+``, ``and``, ``or``, ``not``, parentheses, and filters from a fixed list. There are no calls, no
indexing and no access to Python attributes, so a template can only read the messages it is given.

``parse`` gives a syntax tree, ``fold`` evaluates what does not depend on the messages and joins neighbouring
texts, ``generate`` turns the tree into closures that write to an output: text, and marks where a generation
begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """A template that the language does not allow."""


# ---- syntax tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: str
    name: str


@dataclass(frozen=True)
class Op:
    """``op`` applied to ``args``: ==, !=, +, and, or, not, or a filter's name."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple = ()


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parsing ---------------------------------------------------------------------------------

PARTS = re.compile(r"(\{%.*?%\}|\{\{.*?\}\})", re.S)
TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|(==|!=|[+|.()])|([A-Za-z_]\w*))")
ESCAPES = {"n": "\n", "t": "\t"}
FIELDS = {"role", "text", "turn"}
LOOP = {"first", "index"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: Iterable[str]):
        self.tokens: list[tuple[str, str]] = []
        self.filters, self.at, source = set(filters), 0, source.rstrip()
        while self.at < len(source):
            found = TOKENS.match(source, self.at)
            if not found:
                raise TemplateError(f"not understood: {source[self.at :]!r}")
            self.tokens.append((("string", "number", "sign", "word")[found.lastindex - 1], found[found.lastindex]))
            self.at = found.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "word") and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Any:
        value = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"not expected: {self.tokens[self.at][1]!r}")
        return value

    def either(self) -> Any:
        value = self.both()
        while self.peek("or"):
            self.take()
            value = Op("or", (value, self.both()))
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.peek("and"):
            self.take()
            value = Op("and", (value, self.negated()))
        return value

    def negated(self) -> Any:
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        value = self.sum()
        while self.peek("==", "!="):
            value = Op(self.take()[1], (value, self.sum()))
        return value

    def sum(self) -> Any:
        value = self.filtered()
        while self.peek("+"):
            self.take()
            value = Op("+", (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            value = Op(name, (value,))
        return value

    def atom(self) -> Any:
        kind, word = self.take()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(word))
        if word == "(":
            value = self.either()
            if self.take()[1] != ")":
                raise TemplateError("a bracket is not closed")
            return value
        if kind == "sign" or word in ("and", "or", "not"):
            raise TemplateError(f"not expected: {word!r}")
        if word in ("true", "false"):
            return Const(word == "true")
        if self.peek("."):
            self.take()
            name = self.take()[1]
            if name not in (LOOP if word == "loop" else FIELDS):
                raise TemplateError(f"no field {word}.{name}")
            return Field(word, name)
        return Name(word)


def parse(source: str, filters: Iterable[str]) -> tuple:
    """Syntax tree of a template. A line break directly behind a statement tag belongs to the tag."""
    parts = PARTS.split(source)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Print(_Expression(part[2:-2], filters).whole()))
            elif part.startswith("{%"):
                if at < len(parts) and parts[at].startswith("\n"):
                    parts[at] = parts[at][1:]
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(statement(word, rest))
            elif part:
                out.append(Text(part))
        if "" not in ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), "", ""

    def statement(word: str, rest: str) -> Any:
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            if not found:
                raise TemplateError("a loop runs over the messages: for x in messages")
            return For(found[1], block(("endfor",))[0])
        if word == "if":
            test = _Expression(rest, filters).whole()
            then, word, rest = block(("elif", "else", "endif"))
            if word == "elif":
                return If(test, then, (statement("if", rest),))
            return If(test, then, block(("endif",))[0] if word == "else" else ())
        if word == "generation":
            return Generation(block(("endgeneration",))[0])
        if word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not name.strip().isidentifier():
                raise TemplateError("set needs a name and a value")
            return Assign(name.strip(), _Expression(value, filters).whole())
        raise TemplateError(f"no statement {word!r}")

    return block(("",))[0]


# ---- folding ---------------------------------------------------------------------------------

OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else str(a) + str(b),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _fold_value(value: Any, filters: dict[str, Callable]) -> Any:
    if not isinstance(value, Op):
        return value
    args = tuple(_fold_value(a, filters) for a in value.args)
    if all(isinstance(a, Const) for a in args):
        return Const((OPERATORS | filters)[value.op](*(a.value for a in args)))
    if value.op in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (value.op == "and") else args[0]
    return Op(value.op, args)


def fold(nodes: tuple, filters: dict[str, Callable]) -> tuple:
    """The same template with constants evaluated, dead branches gone and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Print):
            value = _fold_value(node.value, filters)
            more = [Text(str(value.value))] if isinstance(value, Const) else [Print(value)]
        elif isinstance(node, Assign):
            more = [Assign(node.name, _fold_value(node.value, filters))]
        elif isinstance(node, If):
            test = _fold_value(node.test, filters)
            then, other = fold(node.then, filters), fold(node.other, filters)
            more = list(then if test.value else other) if isinstance(test, Const) else [If(test, then, other)]
        elif isinstance(node, For):
            more = [For(node.name, fold(node.body, filters))]
        elif isinstance(node, Generation):
            more = [Generation(fold(node.body, filters))]
        else:
            more = [node]
        for x in more:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + x.value)
            elif not (isinstance(x, Text) and not x.value):
                out.append(x)
    return tuple(out)


# ---- closures --------------------------------------------------------------------------------


class Output:
    """The text written since the last ``take``, and the spans of it under the generation mark."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.size = 0
        self.since: int | None = None

    def text(self, value: str) -> None:
        self.pieces.append(value)
        self.size += len(value)

    def loss(self, on: bool) -> None:
        if self.since is not None and self.size > self.since:
            self.spans.append((self.since, self.size))
        self.since = self.size if on else None

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        marked = self.since is not None
        self.loss(False)
        out = "".join(self.pieces), self.spans
        self.pieces, self.spans, self.size, self.since = [], [], 0, 0 if marked else None
        return out


Chunk = tuple[str, list[tuple[int, int]]]
Step = Callable[[dict, Output], Iterator[Chunk]]


def _value(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n, "")
    if isinstance(node, Field):
        return lambda env, o=node.of, n=node.name: env.get(o, {}).get(n, "")
    args = tuple(_value(a, filters) for a in node.args)
    if node.op in ("and", "or"):
        left, right = args
        return (lambda env: left(env) and right(env)) if node.op == "and" else (lambda env: left(env) or right(env))
    call = (OPERATORS | filters)[node.op]
    if len(args) == 1:
        return lambda env, a=args[0]: call(a(env))
    return lambda env, a=args[0], b=args[1]: call(a(env), b(env))


def _simple(act: Callable[[dict, Output], None]) -> Step:
    def step(env: dict, out: Output) -> Iterator[Chunk]:
        act(env, out)
        return iter(())

    return step


def generate(nodes: tuple, filters: dict[str, Callable]) -> Step:
    """A closure that writes the nodes and yields a chunk after every message, so no conversation is held whole."""
    steps: list[Step] = []
    for node in nodes:
        if isinstance(node, Text):
            steps.append(_simple(lambda env, out, v=node.value: out.text(v)))
        elif isinstance(node, Print):
            steps.append(_simple(lambda env, out, v=_value(node.value, filters): out.text(str(v(env)))))
        elif isinstance(node, Assign):
            steps.append(_simple(lambda env, out, n=node.name, v=_value(node.value, filters): env.__setitem__(n, v(env))))
        elif isinstance(node, If):
            test, then, other = _value(node.test, filters), generate(node.then, filters), generate(node.other, filters)
            steps.append(lambda env, out, t=test, a=then, b=other: a(env, out) if t(env) else b(env, out))
        elif isinstance(node, Generation):

            def marked(env: dict, out: Output, body: Step = generate(node.body, filters)) -> Iterator[Chunk]:
                out.loss(True)
                yield from body(env, out)
                out.loss(False)

            steps.append(marked)
        else:

            def loop(env: dict, out: Output, name: str = node.name, body: Step = generate(node.body, filters)) -> Iterator[Chunk]:
                for i, message in enumerate(env["messages"]):
                    env[name] = message
                    env["loop"] = {"first": i == 0, "index": i + 1}
                    yield from body(env, out)
                    yield out.take()

            steps.append(loop)

    def run(env: dict, out: Output) -> Iterator[Chunk]:
        for step in steps:
            yield from step(env, out)

    return run


def compile_template(source: str, filters: dict[str, Callable]) -> Callable[[Iterable[dict]], Iterator[Chunk]]:
    """``render(messages)`` yields (text, spans) once a message, and at last what stands behind the messages."""
    run = generate(fold(parse(source, filters), filters), filters)

    def render(messages: Iterable[dict]) -> Iterator[Chunk]:
        out = Output()
        yield from run({"messages": iter(messages)}, out)
        if out.pieces:
            yield out.take()

    return render
