"""Chat formatting: a compiler for a small, sandboxed template language.

The language: text; ``{{ expression }}``; ``{% for x in expression %} ... {% endfor %}``; ``{% if %} ... {% elif %} ... {% else %} ... {% endif %}``;
``{% set name = expression %}``; ``{% generation %} ... {% endgeneration %}`` around what a model is to learn. Expressions: string, whole-number
and true/false/none literals, names, ``x.name``, ``x['name']``, ``+ == != < > <= >= in not and or``, parentheses and the filters
``escape trim lower upper length``. A name gives only what the template was handed; ``.name`` looks up a mapping's key,
never an attribute, so nothing of Python can be reached.

Text is parsed into a syntax tree; operations on literals are folded, branches with a known condition are resolved and
neighbouring texts are merged; then each node becomes a Python closure that appends to a list, and generation blocks note
where they begin and end in code points.

Control strings inside texts are escaped reversibly: a backslash follows the first character of what would be a
control string, or of what would be one but for backslashes there; unescaping takes one off.

Nulls: a null text or role is an empty one. Rows of a conversation are ordered by turn (null first), role and text; rows with a null conv_id form
one conversation. Repeated rows are turns each. A role that the template does not know is written in its own marks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of the format. Fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]")

TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ ' ' }}{{ m.text | escape }}{{ ' ' }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE][TURN]{{ m.text | escape }}[/TURN]{% endif %}{% endfor %}"
)

_INNER = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_INNER})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_INNER})")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class TemplateError(ValueError):
    """A template that the language does not allow, or a value that an operation can't take."""


# Syntax tree: tuples of a kind and its parts. Expressions: const, name, item, op, not, filter. Statements: text, out, for, if, set, generation.

_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[+<>().\[\]|])|(\S))""")
_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+",))


def _need(value: object, kind: type) -> object:
    if not isinstance(value, kind):
        raise TemplateError(f"expected {kind.__name__}")
    return value


def _length(x: object) -> int:
    if not isinstance(x, str | list | dict):
        raise TemplateError("length of neither a text, a list nor a mapping")
    return len(x)


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda x: escape(_need(x, str)), "trim": lambda x: _need(x, str).strip(), "lower": lambda x: _need(x, str).lower(),
    "upper": lambda x: _need(x, str).upper(), "length": _length,
}


def _add(a: object, b: object) -> object:
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


def _compare(f: Callable[[object, object], bool]) -> Callable[[object, object], bool]:
    def run(a: object, b: object) -> bool:
        if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
            return f(a, b)
        raise TemplateError("an order is defined between two texts or two numbers")

    return run


def _in(a: object, b: object) -> bool:
    if isinstance(b, str) and isinstance(a, str) or isinstance(b, list | dict):
        return a in b
    raise TemplateError("in takes a text, a list or a mapping")


OPERATORS: dict[str, Callable[[object, object], object]] = {
    "+": _add, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _compare(lambda a, b: a < b), ">": _compare(lambda a, b: a > b),
    "<=": _compare(lambda a, b: a <= b), ">=": _compare(lambda a, b: a >= b), "in": _in,
}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(text.rstrip()):
            kind = ("number", "text", "word", "sign", "bad")[m.lastindex - 1]
            if kind == "bad":
                raise TemplateError(f"unexpected {m[0].strip()!r}")
            self.tokens.append((kind, m[m.lastindex]))
        self.at = 0

    def parse(self) -> tuple:
        tree = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.at += 1
            return True
        return False

    def level(self, k: int) -> tuple:
        if k == len(_LEVELS):
            return self.unary()
        if k == 2 and self.take("not"):
            return ("not", self.level(2))
        left = self.level(k + 1)
        while self.peek() in _LEVELS[k]:
            sign = self.peek()
            self.at += 1
            left = ("op", sign, left, self.level(k + 1))
        return left

    def unary(self) -> tuple:
        tree = self.primary()
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "word":
                    raise TemplateError("a name must follow the dot")
                self.at += 1
                tree = ("item", tree, ("const", name))
            elif self.take("["):
                tree = ("item", tree, self.level(0))
                if not self.take("]"):
                    raise TemplateError("] is missing")
            elif self.take("|"):
                name = self.peek()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name}")
                self.at += 1
                tree = ("filter", name, tree)
            else:
                return tree

    def primary(self) -> tuple:
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("const", int(value))
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "word":
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        if value == "(":
            tree = self.level(0)
            if not self.take(")"):
                raise TemplateError(") is missing")
            return tree
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """Statements of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("tag", m[1]) if m[1] is not None else ("out", m[2]))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pieces.reverse()

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        while pieces:
            kind, value = pieces.pop()
            if kind == "text":
                out.append(("text", value))
            elif kind == "out":
                out.append(("out", _Expression(value).parse()))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in ends:
                    return out, value
                out.append(statement(word, value[len(word) :].strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return ("for", m[1], _Expression(m[2]).parse(), body(("endfor",))[0])
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
            return ("set", m[1], _Expression(m[2]).parse())
        if word == "generation" and not rest:
            return ("generation", body(("endgeneration",))[0])
        if word == "if":
            inner, end = body(("elif", "else", "endif"))
            if end.startswith("elif"):
                return ("if", _Expression(rest).parse(), inner, [statement("if", end[4:].strip())])
            return ("if", _Expression(rest).parse(), inner, body(("endif",))[0] if end == "else" else [])
        raise TemplateError(f"unknown statement {word!r}")

    return body(())[0]


def fold(node: tuple) -> tuple:
    """An expression with its constant parts computed. What would fail stays, to fail only if it is reached."""
    kind = node[0]
    if kind == "op":
        left, right = fold(node[2]), fold(node[3])
        if node[1] in ("and", "or") and left[0] == "const":
            return right if bool(left[1]) == (node[1] == "and") else left
        if node[1] in OPERATORS and left[0] == right[0] == "const":
            try:
                return ("const", OPERATORS[node[1]](left[1], right[1]))
            except TemplateError:
                pass
        return ("op", node[1], left, right)
    if kind == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold(node[2])
        if inner[0] == "const":
            try:
                return ("const", FILTERS[node[1]](inner[1]))
            except TemplateError:
                pass
        return ("filter", node[1], inner)
    if kind == "item":
        return ("item", fold(node[1]), fold(node[2]))
    return node


def fold_all(nodes: list[tuple]) -> list[tuple]:
    """Statements with folded expressions, known branches resolved and neighbouring texts merged."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            x = fold(node[1])
            add(("text", _shown(x[1])) if x[0] == "const" else ("out", x))
        elif node[0] == "if":
            x = fold(node[1])
            if x[0] == "const":
                for inner in fold_all(node[2] if x[1] else node[3]):
                    add(inner)
            else:
                add(("if", x, fold_all(node[2]), fold_all(node[3])))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2]), fold_all(node[3])))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2])))
        elif node[0] == "generation":
            add(("generation", fold_all(node[1])))
        else:
            add(node)
    return out


def _shown(x: object) -> str:
    return x if isinstance(x, str) else "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(_need(x, int))


class _Out:
    """Rendered pieces, their length in code points, and generation spans."""

    __slots__ = ("pieces", "size", "spans")

    def __init__(self) -> None:
        self.pieces, self.size, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]

        def look_up(env: dict) -> object:
            if name not in env:
                raise TemplateError(f"unknown name {name}")
            return env[name]

        return look_up
    if kind == "item":
        of, key = _expression(node[1]), _expression(node[2])

        def item(env: dict) -> object:
            x, k = of(env), key(env)
            if isinstance(x, dict) and k in x:
                return x[k]
            if isinstance(x, list) and isinstance(k, int) and -len(x) <= k < len(x):
                return x[k]
            raise TemplateError(f"no item {k!r}")

        return item
    if kind == "not":
        inner = _expression(node[1])
        return lambda env: not inner(env)
    if kind == "filter":
        f, inner = FILTERS[node[1]], _expression(node[2])
        return lambda env: f(inner(env))
    left, right, sign = _expression(node[2]), _expression(node[3]), node[1]
    if sign == "and":
        return lambda env: left(env) and right(env)
    if sign == "or":
        return lambda env: left(env) or right(env)
    f = OPERATORS[sign]
    return lambda env: f(left(env), right(env))


def _statement(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.add(text)
    if kind == "out":
        f = _expression(node[1])
        return lambda env, out: out.add(_shown(f(env)))
    if kind == "set":
        name, f = node[1], _expression(node[2])

        def put(env: dict, out: _Out) -> None:
            env[name] = f(env)

        return put
    if kind == "if":
        test, yes, no = _expression(node[1]), _block(node[2]), _block(node[3])
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if kind == "generation":
        inner = _block(node[1])

        def mark(env: dict, out: _Out) -> None:
            begin = out.size
            inner(env, out)
            out.spans.append((begin, out.size))

        return mark
    name, items, inner = node[1], _expression(node[2]), _block(node[3])

    def loop(env: dict, out: _Out) -> None:
        values = items(env)
        if not isinstance(values, list):
            raise TemplateError("a loop needs a list")
        before, had = env.get(name), name in env
        for value in values:
            env[name] = value
            inner(env, out)
        env.pop(name, None)
        if had:
            env[name] = before

    return loop


def _block(nodes: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_statement(n) for n in nodes]

    def run(env: dict, out: _Out) -> None:
        for step in steps:
            step(env, out)

    return run


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dicts with role and text) to the formatted text and its generation spans."""
    run = _block(fold_all(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run({"messages": messages}, out)
        return "".join(out.pieces), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of text that ``TEMPLATE`` formatted."""
    turns: list[tuple[str, str]] = []
    at, role = len("<s>"), ""

    def until(mark: str) -> str:
        nonlocal at
        end = formatted.index(mark, at)
        text, at = formatted[at:end], end + len(mark)
        return unescape(text)

    while at < len(formatted):
        m = _CONTROL.match(formatted, at)
        mark = m[0] if m else ""
        if mark == "[INST]":
            at = m.end() + 1
            turns.append(("user", until(" [/INST]")))
        elif mark == "<<SYS>>":
            at = m.end()
            turns.append(("system", until("<</SYS>>")))
        elif mark == "[ROLE]":
            at = m.end()
            role = until("[/ROLE]")
            at += len("[TURN]")
            turns.append((role, until("[/TURN]")))
        else:
            turns.append(("assistant", until("</s>")))
    return turns


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, and spans of the loss mask in code points.

    A conversation is one training text, so its turns meet in one row; rows are aggregated before the shuffle and sorted as arrays.
    """
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        render = compile_template(template)
        for batch in batches:
            done = [render(m) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([[{"begin": a, "end": b} for a, b in s] for _, s in done], to_arrow_schema(schema).field("spans").type)], names=schema.names)

    return grouped.select("conv_id", "messages").mapInArrow(run, schema)


def digest_report(formatted: DataFrame) -> DataFrame:
    """What is read back from ``format_conversations``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = T.StructType([formatted.schema["conv_id"], *(T.StructField(n, k) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                for column, value in zip(out, (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(out, schema.names[1:]))], names=schema.names)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, schema)
