"""Chat formatting with a compiled template.

A small template language, sandboxed by having nothing but what is listed here, is parsed into a
syntax tree; constants are folded; the tree becomes nested Python generators that yield
pieces of text with a mark whether a model learns from them.

    text {{ expression }} {% for x in messages %}...{% endfor %}
    {% if e %}...{% elif e %}...{% else %}...{% endif %} {% generation %}...{% endgeneration %}

Expressions: names, fields (m.role), strings, integers, true, false, ``+ == != and or not``, parentheses, and
filters ``| escape``, ``| trim``, ``| upper``, ``| lower``. No calls, no other attributes, no loops but over a
list that the caller gives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Turns are "### Role: text </turn>" and a line end. Inside roles and texts, codes stand for # : < and backslashes.
HEAD, COLON, END = "### ", ": ", " </turn>\n"
TEMPLATE = "{% for m in messages %}### {{ m.role | escape }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %} </turn>\n{% endfor %}"

#: What stands for characters that control strings have, and for the backslash itself.
_CODES = {"\\": "\\\\", "#": "\\h", ":": "\\c", "<": "\\l"}
_CHARACTERS = {v[1]: k for k, v in _CODES.items()}
_TABLE = str.maketrans(_CODES)


def escape(text: str) -> str:
    """The text with a code for each character that a control string has: none can occur in it, and ``unescape``
    gives the text back."""
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _CHARACTERS[m[1]], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Branch:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_WORD = re.compile(r"\s*(?:([A-Za-z][A-Za-z0-9_]*)|(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(==|!=|[+|.()]))")
_ESCAPES = {"n": "\n", "t": "\t"}


def _lex(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _WORD.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("name", m[1]))
        elif m[2] is not None:
            out.append(("const", int(m[2])))
        elif m[3] is not None or m[4] is not None:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[3] if m[3] is not None else m[4])))
        else:
            out.append(("sign", m[5]))
    return out


class _Expression:
    """Precedence climbing: or, and, not, == !=, +, filters."""

    def __init__(self, source: str):
        self.words, self.at = _lex(source), 0

    def parse(self):
        found = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return found

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] != "const" and self.words[self.at][1] in wanted:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.added()
        while sign := self.take("==", "!="):
            left = Op(sign, (left, self.added()))
        return left

    def added(self):
        left = self.filtered()
        while self.take("+"):
            left = Op("+", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            kind, name = self.words[self.at] if self.at < len(self.words) else ("", None)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Filter(name, value)
        return value

    def atom(self):
        if self.take("("):
            found = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return found
        if self.at >= len(self.words) or self.words[self.at][0] == "sign":
            raise TemplateError("missing value")
        kind, value = self.words[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if value in ("true", "false"):
            return Const(value == "true")
        path = [value]
        while self.take("."):
            kind, part = self.words[self.at] if self.at < len(self.words) else ("", None)
            if kind != "name":
                raise TemplateError("missing field after .")
            path.append(part)
            self.at += 1
        return Name(tuple(path))


def parse(template: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at = 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            stack[-1][2].append(Text(template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Out(_Expression(m[1]).parse()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        kind, head, body = stack[-1]
        if word == "for":
            name, _, over = rest.partition(" in ")
            if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError(f"can't loop by {name!r}")
            stack.append(("for", (name.strip(), _Expression(over).parse()), []))
        elif word == "if":
            stack.append(("if", [(_Expression(rest).parse(), [])], []))
            stack[-1] = ("if", stack[-1][1], stack[-1][1][0][1])
        elif word in ("elif", "else") and kind == "if":
            head.append((_Expression(rest).parse() if word == "elif" else Const(True), []))
            stack[-1] = ("if", head, head[-1][1])
        elif word == "generation":
            if any(k == "generation" for k, _, _ in stack):
                raise TemplateError("generation inside generation")
            stack.append(("generation", None, []))
        elif word == f"end{kind}" and kind:
            stack.pop()
            made = Loop(*head, tuple(body)) if kind == "for" else Generation(tuple(body)) if kind == "generation" else Branch(tuple((c, tuple(b)) for c, b in head))
            stack[-1][2].append(made)
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't ended")
    if at < len(template):
        stack[-1][2].append(Text(template[at:]))
    return tuple(stack[-1][2])


# ---------------------------------------------------------------- folding

_OPERATIONS: dict[str, Callable] = {"+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _show(a) + _show(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _show(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def _fold_value(x):
    if isinstance(x, Filter):
        arg = _fold_value(x.arg)
        return Const(FILTERS[x.name](_show(arg.value))) if isinstance(arg, Const) else Filter(x.name, arg)
    if not isinstance(x, Op):
        return x
    args = tuple(map(_fold_value, x.args))
    if x.kind in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.kind == "and") else args[0]
        return Op(x.kind, args)
    if all(isinstance(a, Const) for a in args):
        values = [a.value for a in args]
        return Const(not values[0]) if x.kind == "not" else Const(_OPERATIONS[x.kind](*values))
    return Op(x.kind, args)


def fold(body: Iterable) -> tuple:
    """Constant expressions computed, dead branches gone, neighbouring texts joined."""
    out: list = []
    for x in body:
        if isinstance(x, Out):
            value = _fold_value(x.value)
            made = [Text(_show(value.value))] if isinstance(value, Const) else [Out(value)]
        elif isinstance(x, Loop):
            made = [Loop(x.name, _fold_value(x.over), fold(x.body))]
        elif isinstance(x, Generation):
            made = [Generation(fold(x.body))]
        elif isinstance(x, Branch):
            arms = []
            for condition, inner in x.arms:
                condition = _fold_value(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                arms.append((condition, fold(inner)))
                if isinstance(condition, Const):
                    break
            made = list(arms[0][1]) if arms and isinstance(arms[0][0], Const) else [Branch(tuple(arms))] if arms else []
        else:
            made = [x]
        for m in made:
            if isinstance(m, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + m.value)
            elif not isinstance(m, Text) or m.value:
                out.append(m)
    return tuple(out)


# ---------------------------------------------------------------- generation of closures

Piece = tuple[str, bool]


def _value(x) -> Callable[[dict], Any]:
    if isinstance(x, Const):
        return lambda scope: x.value
    if isinstance(x, Name):
        first, rest = x.path[0], x.path[1:]

        def name(scope: dict):
            found = scope.get(first)
            for part in rest:
                found = found.get(part) if isinstance(found, dict) else None
            return found

        return name
    if isinstance(x, Filter):
        apply, arg = FILTERS[x.name], _value(x.arg)
        return lambda scope: apply(_show(arg(scope)))
    args = tuple(map(_value, x.args))
    if x.kind == "not":
        return lambda scope: not args[0](scope)
    if x.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if x.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    apply = _OPERATIONS[x.kind]
    return lambda scope: apply(args[0](scope), args[1](scope))


def _block(body: tuple, learned: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_node(x, learned) for x in body]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _node(x, learned: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(x, Text):
        piece = (x.value, learned)
        return lambda scope: iter((piece,))
    if isinstance(x, Out):
        value = _value(x.value)
        return lambda scope: iter(((_show(value(scope)), learned),))
    if isinstance(x, Generation):
        return _block(x.body, True)
    if isinstance(x, Loop):
        over, body = _value(x.over), _block(x.body, learned)

        def loop(scope: dict) -> Iterator[Piece]:
            for item in over(scope) or ():
                yield from body(scope | {x.name: item})

        return loop
    arms = [(_value(c), _block(b, learned)) for c, b in x.arms]

    def branch(scope: dict) -> Iterator[Piece]:
        for condition, body in arms:
            if condition(scope):
                yield from body(scope)
                return

    return branch


def compile_template(template: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from names to pieces (text, whether it is learned from). Loops read their list as they go."""
    return _block(fold(parse(template)), False)


# ---------------------------------------------------------------- reading back

_TURN = re.compile(re.escape(HEAD) + r"([^\\:]*+(?:\\.[^\\:]*+)*+)" + re.escape(COLON) + r"((?:[^\\< ]++|\\.| (?!</turn>))*+)" + re.escape(END), re.S)


def read_turns(formatted: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, where the text starts and ends) of each turn of what TEMPLATE made."""
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn: {formatted[at : at + 80]!r}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


# ---------------------------------------------------------------- over a table

_PROBE = "\\### Assistant: </turn> ok"


def _ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conversation, its rows) one after another, read as they come: a conversation is never held whole."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
    ahead = next(rows, None)

    def turns(key) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            yield {"role": ahead[1], "text": ahead[2]}
            ahead = next(rows, None)

    while ahead is not None:
        one = turns(ahead[0])
        yield ahead[0], one
        for _ in one:  # whatever the template left
            pass


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, formatted, loss) per conversation: its text by ``template`` and the spans (code points) learned from.

    Rows go by turn; ties by role, then text. Null roles and texts are empty, a null conversation is one
    like others, repeated rows are turns of their own. Other columns are ignored. One conversation's text has to fit in a row.
    """
    render = template
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compile_template(render)
        for key, turns in _streams(batches):
            pieces, spans, at, n = [], [], 0, 0

            def counted(turns=turns):
                nonlocal n
                for t in turns:
                    n += 1
                    yield t

            for piece, learned in made({"messages": counted()}):
                if learned and piece:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] += len(piece)
                    else:
                        spans.append({"start": at, "end": at + len(piece)})
                pieces.append(piece)
                at += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array(["".join(pieces)]), pa.array([spans], kind)], ["conv", "n_turns", "formatted", "loss"])

    return map_batches(_ordered(conversations, conv, turn, role, text), run, "conv long, n_turns long, formatted string, loss array<struct<start:long,end:long>>").withColumnRenamed("conv", conv)


class _Reader:
    """Reads formatted text back as it comes, holding one turn at most: from its characters and the spans learned from alone."""

    def __init__(self):
        self.buffer: list[str] = []
        self.tail, self.at, self.chars = "", 0, 0  # the last characters, where the buffer starts, all characters
        self.spans: list[list[int]] = []
        self.turns = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, learned: bool) -> None:
        """The next characters, however they are cut, and whether they are in a span."""
        start, self.chars = self.chars, self.chars + len(text)
        if learned and text:
            if self.spans and self.spans[-1][1] == start:
                self.spans[-1][1] = self.chars
            else:
                self.spans.append([start, self.chars])
        self.buffer.append(text)
        seen = self.tail + text
        self.tail = seen[1 - len(END) :]
        if END in seen:
            self._read()

    def _read(self) -> None:
        text, done = "".join(self.buffer), 0
        while (stop := text.find(END, done) + len(END)) >= len(END):
            m = _TURN.fullmatch(text, done, stop)
            if not m:
                raise ValueError(f"not a turn: {text[done : done + 80]!r}")
            self.turns += 1
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            low, high = self.at + done, self.at + stop
            learned = unescape("".join(text[max(a, low) - self.at : min(b, high) - self.at] for a, b in self.spans if a < high and b > low))
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
            done = stop
        self.buffer, self.at = [text[done:]], self.at + done
        self.tail = self.buffer[0][1 - len(END) :]
        self.spans = [s for s in self.spans if s[1] > self.at]

    def end(self) -> None:
        if any(self.buffer):
            raise ValueError("text after the last turn")


def digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted text.

    The output of TEMPLATE is parsed while it is made, from its characters and its spans alone: memory holds
    one turn, however long a conversation is. Order, nulls and ties are those of ``format_conversations``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out = compile_template(TEMPLATE), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for key, turns in _streams(batches):
            reader = _Reader()
            for piece, learned in made({"messages": turns}):
                reader.add(piece, learned)
            reader.end()
            out.append((key, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) == 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    shape = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(_ordered(conversations, conv, turn, role, text), run, shape).withColumnRenamed("conv", conv)


def with_probe(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows and those of conversation -7, whose user and assistant both say what looks like control strings."""
    rows = conversations.select(F.col(conv).cast("long").alias(conv), F.col(turn).cast("long").alias(turn), role, text)
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], f"{conv} long, {turn} long, {role} string, {text} string")
    return rows.unionByName(probe)
