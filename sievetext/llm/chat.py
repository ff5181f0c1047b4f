"""Chat formatting with a small sandboxed template language.

A template is compiled in three steps: the text is parsed into a syntax tree,
constants are folded, and the tree becomes nested Python closures.  Rendering
appends text pieces to a list and notes the spans of generated text, from which
the loss mask is read.

    {{ expr }}                        output
    {% for x in turns %} .. {% endfor %}
    {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}

Expressions know texts in quotes, whole numbers, true, false, names, fields of
a turn (``turn.role``), ``+ == != and or not``, brackets and the filters of
:data:`FILTERS`.  Nothing else of Python can be reached.

Defined cases: null texts and roles count as empty; turns are ordered by turn,
then role, then text, null turns first; repeated rows are turns of their own;
rows without conversation id form one conversation; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

# The control strings of the template below.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for turn in turns %}"
    '{{ "<s>" + "[INST]" }}{{ turn.role | escape }}[/INST]'
    '{% if turn.role == "assistant" %}{% generation %}{{ turn.text | escape }}{% endgeneration %}'
    "{% else %}{{ turn.text | escape }}{% endif %}"
    "</s>{% endfor %}")
TURN_FIELDS = ("role", "text")
#: Formatted characters after which a long conversation starts a new part.
PART_CHARS = 4_000_000

# A mark goes behind the first character of a control string, wherever one
# begins; marks of the text itself are doubled.
_OPENS = re.compile("[<\\[](?=(?:" + "|".join(sorted({re.escape(c[1:]) for c in CONTROL})) + "))")
_MARKED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """No control string occurs in the result; :func:`unescape` undoes it."""
    return _OPENS.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}


class TemplateError(ValueError):
    """The template does not follow the language."""


# --- syntax tree ---------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Attr:
    of: object
    name: str


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class Cond:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(\"[^\"]*\"|'[^']*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|()]))")
_LEVELS = (("or",), ("and",), ("not",), ("==", "!="), ("+",))


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()

    def take(self, *wanted: str) -> str | None:
        if self.tokens and (not wanted or self.tokens[0] in wanted):
            return self.tokens.pop(0)
        return None

    def whole(self):
        out = self.binary(0)
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0]!r}")
        return out

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.value()
        if _LEVELS[level] == ("not",):
            return Op("not", (self.binary(level),)) if self.take("not") else self.binary(level + 1)
        left = self.binary(level + 1)
        while sign := self.take(*_LEVELS[level]):
            left = Op(sign, (left, self.binary(level + 1)))
        return left

    def value(self):
        out = self.atom()
        while sign := self.take(".", "|"):
            name = self.take()
            if not name or not name.isidentifier():
                raise TemplateError(f"a name must follow {sign!r}")
            if sign == "|" and name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            if sign == "." and name not in TURN_FIELDS:
                raise TemplateError(f"unknown field {name!r}")
            out = Filter(out, name) if sign == "|" else Attr(out, name)
        return out

    def atom(self):
        token = self.take()
        if token is None or token in ("==", "!=", "+", ".", "|", ")", "and", "or"):
            raise TemplateError("an expression is missing")
        if token == "(":
            out = self.binary(0)
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return out
        if token[0] in "\"'":
            return Const(token[1:-1])
        if token.isdigit():
            return Const(int(token))
        return Const(token == "true") if token in ("true", "false") else Name(token)


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at:m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    parts.reverse()

    def block(ends: tuple[str, ...]):
        body = []
        while parts:
            kind, text = parts.pop()
            if kind == "text":
                if "{%" in text or "{{" in text:
                    raise TemplateError("a tag is not closed")
                body.append(Output(Const(text)))
            elif kind == "out":
                body.append(Output(_Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(body), word, rest
                body.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), "", ""

    def condition(rest: str):
        test = _Expression(rest).whole()
        then, word, more = block(("elif", "else", "endif"))
        if word == "elif":
            return Cond(test, then, (condition(more),))
        return Cond(test, then, block(("endif",))[0] if word == "else" else ())

    def statement(word: str, rest: str):
        if word == "if":
            return condition(rest)
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest)
            if not m:
                raise TemplateError(f"cannot read loop {rest!r}")
            return Loop(m[1], _Expression(m[2]).whole(), block(("endfor",))[0])
        if word == "generation":
            return Generation(block(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block(())[0]


# --- constant folding ----------------------------------------------------

def _apply(sign: str, *values):
    if sign == "+":
        return _shown(values[0]) + _shown(values[1])
    if sign == "==":
        return values[0] == values[1]
    if sign == "!=":
        return values[0] != values[1]
    if sign == "not":
        return not values[0]
    return (values[0] and values[1]) if sign == "and" else (values[0] or values[1])


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold_expr(node):
    """``node`` with constant parts computed."""
    if isinstance(node, Filter):
        of = fold_expr(node.of)
        return Const(FILTERS[node.name](_shown(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Attr):
        return Attr(fold_expr(node.of), node.name)
    if isinstance(node, Op):
        args = tuple(map(fold_expr, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_apply(node.sign, *[a.value for a in args]))
        return Op(node.sign, args)
    return node


def fold(body: tuple) -> tuple:
    """``body`` with constants computed, constant conditions decided, empty
    nodes gone and neighbouring constant texts joined."""
    flat: list = []
    for node in body:
        if isinstance(node, Output):
            flat.append(Output(fold_expr(node.expr)))
        elif isinstance(node, Cond):
            test, then, other = fold_expr(node.test), fold(node.then), fold(node.other)
            if isinstance(test, Const):
                flat += then if test.value else other
            else:
                flat.append(Cond(test, then, other))
        elif isinstance(node, Loop):
            flat.append(Loop(node.name, fold_expr(node.over), fold(node.body)))
        else:
            flat.append(Generation(fold(node.body)))
    out: list = []
    for node in flat:
        if isinstance(node, Output) and isinstance(node.expr, Const):
            text = _shown(node.expr.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                out[-1] = Output(Const(out[-1].expr.value + text))
            elif text:
                out.append(Output(Const(text)))
        else:
            out.append(node)
    return tuple(out)


# --- closures ------------------------------------------------------------

class Sheet:
    """What a rendering writes: pieces, their length, generated spans."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str):
        self.pieces.append(text)
        self.size += len(text)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Attr):
        of, name = _value(node.of), node.name
        return lambda env: (of(env) or {}).get(name)
    if isinstance(node, Filter):
        of, run = _value(node.of), FILTERS[node.name]
        return lambda env: run(_shown(of(env)))
    args, sign = [_value(a) for a in node.args], node.sign
    return lambda env: _apply(sign, *[a(env) for a in args])


def _action(node) -> Callable[[dict, Sheet], None]:
    if isinstance(node, Output):
        if isinstance(node.expr, Const):
            text = node.expr.value
            return lambda env, sheet: sheet.put(text)
        value = _value(node.expr)
        return lambda env, sheet: sheet.put(_shown(value(env)))
    if isinstance(node, Cond):
        test, then, other = _value(node.test), _block(node.then), _block(node.other)
        return lambda env, sheet: then(env, sheet) if test(env) else other(env, sheet)
    if isinstance(node, Loop):
        name, over, body = node.name, _value(node.over), _block(node.body)

        def loop(env, sheet):
            for item in over(env) or ():
                body({**env, name: item}, sheet)
        return loop
    body = _block(node.body)

    def generation(env, sheet):
        start = sheet.size
        body(env, sheet)
        sheet.spans.append((start, sheet.size))
    return generation


def _block(body: tuple) -> Callable[[dict, Sheet], None]:
    actions = [_action(n) for n in body]

    def run(env, sheet):
        for a in actions:
            a(env, sheet)
    return run


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """``render(turns) -> (text, generated spans)`` of a template."""
    run = _block(fold(parse(source)))

    def render(turns: list[dict]):
        sheet = Sheet()
        run({"turns": turns}, sheet)
        return "".join(sheet.pieces), sheet.spans
    return render


def read_turns(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn of a text formatted with :data:`TEMPLATE`."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


# --- Spark ---------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_PART_DDL = "part int, formatted string, loss array<struct<start:int,end:int>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id",
                         part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv_id, part, formatted, loss)``: the formatted text of every
    conversation and its generated spans (code points of the part).

    Turns are streamed in order, so a task holds one part at a time; a
    conversation longer than ``part_chars`` has several parts, each of whole
    turns, which follow each other in one partition.  Templates must format a
    turn by itself, as one loop over ``turns`` does."""
    compile_template(template)  # errors show here, not in a task
    key = free_name(rows, "conversation")
    kind = rows.select(F.col(conv_col)).schema[0].dataType.simpleString()
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TURN_FIELDS]
    ordered = (small_batches(rows).select(F.col(conv_col).alias(key), "turn", *text)
               .repartition(key).sortWithinPartitions(key, "turn", *TURN_FIELDS))

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in kinds:
        raise ValueError(f"conversation ids of type {kind} are not supported")
    key_type = kinds[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        done: list[tuple] = []
        now, part, turns, size = None, 0, [], 0

        def close():
            text, spans = render(turns)
            done.append((now[0], part, text, [{"start": a, "end": b} for a, b in spans]))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3)]
            for conv, role, body in zip(*columns, strict=True):
                if now != (conv,):
                    if now:
                        close()
                    now, part, turns, size = (conv,), 0, [], 0
                elif size >= part_chars:
                    close()
                    part, turns, size = part + 1, [], 0
                turns.append({"role": role, "text": body})
                size += len(role) + len(body)
            if done:
                yield _batch(done, key_type)
                done = []
        if now:
            close()
            yield _batch(done, key_type)

    return ordered.mapInArrow(run, f"`{key}` {kind}, {_PART_DDL}").withColumnRenamed(key, conv_col)


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], key), pa.array(columns[1], pa.int32()),
         pa.array(columns[2], pa.string()), pa.array(columns[3], _SPANS)],
        names=["conversation", "part", "formatted", "loss"])


_DIGEST_DDL = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
               "loss_sha256 string, formatted_chars bigint")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests per conversation from its formatted parts, in order."""
    fields = _DIGEST_DDL.replace(",", "").split()
    names = fields[::2]
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64())
                        for n, t in zip(names, fields[1::2], strict=True)])
    now, done = None, []

    def close():
        done.append(dict(zip(names, (now["conv"], now["turns"], now["said"].hexdigest(), now["chars"],
                                     now["loss"].hexdigest(), now["size"]), strict=True)))

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv"] != r["conv_id"]:
                if now:
                    close()
                now = {"conv": r["conv_id"], "turns": 0, "said": hashlib.sha256(), "chars": 0,
                       "loss": hashlib.sha256(), "size": 0}
            text = r["formatted"]
            for role, body in read_turns(text):
                now["turns"] += 1
                now["said"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for s in r["loss"]:
                body = unescape(text[s["start"]:s["end"]])
                now["chars"] += len(body)
                now["loss"].update(body.encode("utf-8", "surrogatepass"))
            now["size"] += len(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if now:
        close()
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The rows of the registered query, read back from the formatted text.
    SHA-256 has no merge, so the turns of one conversation are hashed in order
    by one task, part by part."""
    said = "</s>[INST] ok [/INST]"
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                 F.col("turn").cast("long").alias("turn"), *TURN_FIELDS)
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string")
    formatted = format_conversations(plain.unionByName(probe))
    return formatted.mapInArrow(_read_back, _DIGEST_DDL)


ORACLE_SQL = """
with said as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
plain as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from said),
sized as (
  select *, length(role) + length(text) + 20
    + (select sum((length(b) - length(replace(b, c, ''))) // length(c))
       from (values (role), (text)) as bodies(b),
            (values ('\\'), ('<s>'), ('</s>'), ('[INST]'), ('[/INST]'), ('<<SYS>>'), ('<</SYS>>')) as cs(c)) as chars
  from plain)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""
