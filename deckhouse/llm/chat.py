"""Chat formatting: a small sandboxed template language compiled to Python closures.

Language: ``{{ expr }}``, ``{% for x in expr %}..{% else %}..{% endfor %}``,
``{% if %}..{% elif %}..{% else %}..{% endif %}``, ``{% set x = expr %}``,
``{% generation %}..{% endgeneration %}`` and ``{# comment #}``; a dash inside a tag
strips the white space beside it. Expressions: strings, integers, ``true/false/none``,
names, ``a.b`` and ``a['b']`` on mappings only, ``+ ~ == != < <= > >= in not and or``,
conditional ``a if c else b`` and filters ``x|name``. There are no calls and no
attribute access on Python objects, so a template reaches nothing but its variables.

``compile_template`` parses to a syntax tree, folds constants (pure expressions over
literals, adjacent texts, decided branches) and builds closures that yield pieces
``(text, in_generation)`` lazily, so a conversation of any length streams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# ---------------------------------------------------------------- lexer and parser

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.\[\]()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template is not in the language."""


def _lex(source: str) -> Iterator[tuple[str, str]]:
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if strip:
            text = text.lstrip()
        if m[0][2] == "-":
            text = text.rstrip()
        if text:
            yield "text", text
        if m[1] is not None:
            yield "expr", m[1]
        elif m[2] is not None:
            yield "tag", m[2].strip()
        at, strip = m.end(), m[0][-3] == "-"
    rest = source[at:].lstrip() if strip else source[at:]
    if rest:
        yield "text", rest


class _Expr:
    """Precedence-climbing parser; nodes are tuples headed by their kind."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            kind = ("int", "str", "name", "op")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise TemplateError(f"expected {value or 'an expression'}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def accept(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def whole(self) -> tuple:
        node = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.accept("if"):
            condition = self.either()
            other = self.choice() if self.accept("else") else ("const", "")
            return ("choice", condition, node, other)
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.accept("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.accept("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.accept("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.accept("==", "!=", "<", "<=", ">", ">=", "in"):
            node = ("binary", op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while op := self.accept("+", "~", "-"):
            node = ("binary", op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.accept("|"):
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def reached(self) -> tuple:
        node = self.atom()
        while op := self.accept(".", "["):
            if op == ".":
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError("a name must follow the dot")
                node = ("get", node, ("const", name))
            else:
                node = ("get", node, self.choice())
                self.take("]")
        return node

    def atom(self) -> tuple:
        kind, value = self.take()
        if kind == "int":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            literal = {"true": True, "false": False, "none": None}
            return ("const", literal[value]) if value in literal else ("name", value)
        if value == "(":
            node = self.choice()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """Source text to a syntax tree: ``("block", [node, ...])``."""
    tokens = list(_lex(source))
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(tokens):
            kind, value = tokens[at]
            at += 1
            if kind == "text":
                nodes.append(("text", value))
                continue
            if kind == "expr":
                nodes.append(("out", _Expr(value).whole()))
                continue
            head, _, rest = value.partition(" ")
            if head in ends:
                return ("block", nodes), value
            if head == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"bad loop {value!r}")
                body, end = block("endfor", "else")
                other = block("endfor")[0] if end == "else" else ("block", [])
                nodes.append(("for", m[1], _Expr(m[2]).whole(), body, other))
            elif head == "if":
                arms: list[tuple] = []
                condition = rest
                while True:
                    body, end = block("elif", "else", "endif")
                    arms.append((_Expr(condition).whole(), body))
                    if end.startswith("elif"):
                        condition = end[4:]
                        continue
                    other = block("endif")[0] if end == "else" else ("block", [])
                    break
                node = other
                for condition_, body in reversed(arms):
                    node = ("if", condition_, body, node)
                nodes.append(node)
            elif head == "set":
                name, eq, expr = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError(f"bad assignment {value!r}")
                nodes.append(("set", name.strip(), _Expr(expr).whole()))
            elif head == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return ("block", nodes), ""

    return block()[0]


# ---------------------------------------------------------------- constant folding

_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b),
}


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def escape(text: str) -> str:
    """Make the control strings of CHAT_TEMPLATE unwritable in a text; ``unescape`` undoes it."""
    return text.replace("\\", "\\\\").replace("</turn>", "\\c").replace("<turn>", "\\o")


def escape_line(text: str) -> str:
    """``escape`` for a one-line field: line feeds go too."""
    return escape(text).replace("\n", "\\n")


_BACK = {"\\\\": "\\", "\\c": "</turn>", "\\o": "<turn>", "\\n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\[\\con]", lambda m: _BACK[m[0]], text) if "\\" in text else text


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda x: escape(_text(x)), "escape_line": lambda x: escape_line(_text(x)), "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x), "string": _text,
}


def fold(node: tuple) -> tuple:
    """Evaluate what holds no variable, join adjacent texts, cut decided branches."""
    kind = node[0]
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1]):
            for x in child[1] if child[0] == "block" else [child]:
                if x[0] == "out" and x[1][0] == "const":
                    x = ("text", _text(x[1][1]))
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", out)
    if kind == "out":
        return ("out", fold(node[1]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]), fold(node[4]))
    if kind == "if":
        condition = fold(node[1])
        if condition[0] == "const":
            return fold(node[2] if condition[1] else node[3])
        return ("if", condition, fold(node[2]), fold(node[3]))
    if kind in ("const", "name", "text"):
        return node
    parts = [fold(x) if isinstance(x, tuple) else x for x in node[1:]]
    folded = (kind, *parts)
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind == "choice" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        try:
            return ("const", _evaluate(folded)({}))
        except (TypeError, ValueError, KeyError, IndexError):
            return folded  # it fails when rendered, as it would unfolded
    return folded


# ---------------------------------------------------------------- closures

Scope = dict[str, object]
Pieces = Iterator[tuple[str | None, bool]]  # no text: a generation span opens here


def _evaluate(node: tuple) -> Callable[[Scope], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda s: value
    if kind == "name":
        name = node[1]
        return lambda s: s.get(name)
    if kind == "get":
        base, key = _evaluate(node[1]), _evaluate(node[2])

        def get(s: Scope) -> object:
            b, k = base(s), key(s)
            if isinstance(b, dict):
                return b.get(k)
            if isinstance(b, (list, tuple, str)) and isinstance(k, int):
                return b[k] if -len(b) <= k < len(b) else None
            return None

        return get
    if kind == "filter":
        function, inner = FILTERS[node[1]], _evaluate(node[2])
        return lambda s: function(inner(s))
    if kind == "not":
        inner = _evaluate(node[1])
        return lambda s: not inner(s)
    if kind == "choice":
        condition, yes, no = map(_evaluate, node[1:])
        return lambda s: yes(s) if condition(s) else no(s)
    if kind == "binary":
        operation, a, b = _BINARY[node[1]], _evaluate(node[2]), _evaluate(node[3])
        return lambda s: operation(a(s), b(s))
    a, b = _evaluate(node[1]), _evaluate(node[2])
    return (lambda s: a(s) and b(s)) if kind == "and" else (lambda s: a(s) or b(s))


def _render(node: tuple, marked: bool) -> Callable[[Scope], Pieces]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], marked)
        return lambda s: iter((piece,))
    if kind == "out":
        value = _evaluate(node[1])
        return lambda s: iter(((_text(value(s)), marked),))
    if kind == "set":
        name, value = node[1], _evaluate(node[2])

        def assign(s: Scope) -> Pieces:
            s[name] = value(s)
            return iter(())

        return assign
    if kind == "generation":
        inner = _render(node[1], True)

        def generation(s: Scope) -> Pieces:
            yield None, True  # opens a span, even an empty one
            yield from inner(s)

        return generation
    if kind == "if":
        condition, yes, no = _evaluate(node[1]), _render(node[2], marked), _render(node[3], marked)
        return lambda s: yes(s) if condition(s) else no(s)
    if kind == "for":
        name, items, body, other = node[1], _evaluate(node[2]), _render(node[3], marked), _render(node[4], marked)

        def loop(s: Scope) -> Pieces:
            source = iter(items(s) or ())
            none = object()
            item, index = next(source, none), 0
            if item is none:
                yield from other(s)
            while item is not none:
                after = next(source, none)  # one row ahead, for loop.last
                inner = {**s, name: item, "loop": {"index0": index, "index": index + 1, "first": not index, "last": after is none}}
                yield from body(inner)
                item, index = after, index + 1

        return loop
    children = [_render(x, marked) for x in node[1]]

    def block(s: Scope) -> Pieces:
        for child in children:
            yield from child(s)

    return block


def compile_template(source: str) -> Callable[[Scope], Pieces]:
    """Template to a closure from variables to lazily made pieces ``(text, in_generation)``."""
    return _render(fold(parse(source)), False)


# ---------------------------------------------------------------- the operator

#: Marks each turn, keeps the role on its first line, puts assistant texts under the loss mask.
CHAT_TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role|escape_line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</turn>{{ '\\n' }}{% endfor %}"
)

FORMATTED = "conv_id long, part int, text string, spans array<struct<start:long,end:long>>, last boolean"


def format_conversations(df: DataFrame, template: str = CHAT_TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = 4 << 20) -> DataFrame:
    """Render every conversation: ``conv_id, part, text, spans, last``.

    A conversation of up to ``part_chars`` characters is one row (part 0, last true). A longer
    one continues in further parts, cut between template pieces, so no task ever holds more
    than a part, whatever share of the rows one conversation has. ``spans`` are the generation
    markers as code point offsets into the whole conversation. Rows are taken by turn (nulls
    first), then role and text; null roles and texts are empty, repeated rows are repeated
    turns, a null conv_id is a conversation of its own. An empty table gives no rows. Only the
    four named columns are read.
    """
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One exchange by conversation; Spark's external sort spills, Python only sees the stream.
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        yield from _in_batches(_parts(_conversations(batches), render, part_chars))

    return rows.mapInArrow(run, FORMATTED)


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    def stream() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)

    rows = stream()
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def messages() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                row, ahead = ahead, next(rows, None)
                yield {"role": row[1], "text": row[2]}

        mine = messages()
        yield key, mine
        for _ in mine:  # what a template left unread
            pass


def _parts(conversations: Iterator, render: Callable, most: int) -> Iterator[tuple]:
    for key, messages in conversations:
        buffer: list[str] = []
        spans: list[dict] = []
        at = held = part = 0
        inside = False
        for text, marked in render({"messages": messages}):
            if text is None:
                spans.append({"start": at, "end": at})
                text, inside = "", False
            if held and held + len(text) > most and not inside:
                last_span = spans.pop() if marked else None
                yield key, part, "".join(buffer), spans, False
                buffer, spans, held, part = [], [last_span] if last_span else [], 0, part + 1
            buffer.append(text)
            at += len(text)
            held += len(text)
            inside = marked
            if marked:
                spans[-1]["end"] = at
        yield key, part, "".join(buffer), spans, True


def _in_batches(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("spans", span), ("last", pa.bool_())])
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse CHAT_TEMPLATE output (parts in stream order) back to turns and loss text, as digests per conversation. Null ids are one
    conversation; null texts were formatted as empty ones and come back so; no parts give no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            pass_rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            out = [x for row in pass_rows if (x := reader.take(*row)) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).cast(_DIGEST_ARROW)

    return formatted.mapInArrow(run, DIGESTS)


_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Reader:
    """Reads one conversation after another; holds at most the open turn besides the current part."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def take(self, conv_id: int | None, part: int, text: str, spans: list[dict], last: bool) -> tuple | None:
        if not part:
            self.clear()
        for span in spans:
            loss = unescape(text[span["start"] - self.chars : span["end"] - self.chars])
            self.loss_chars += len(loss)
            self.loss_hash.update(loss.encode())
        self.chars += len(text)
        *turns, self.rest = (self.rest + text).split("</turn>\n")
        for turn in turns:
            role, _, body = turn.removeprefix("<turn>").partition("\n")
            self.turns_hash.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
        self.turns += len(turns)
        if not last:
            return None
        return conv_id, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


#: The conversation that the contract adds: both texts hold control strings.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(planted)))


OP2_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\c'), '<turn>', '\o') AS etext,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\c'), '<turn>', '\o'), chr(10), '\n') AS erole
  FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(erole) + length(etext) + 15)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
