"""Chat formatting: a compiler for a small sandboxed template language, and conversations rendered as streams.

The language: text, {{ expression }}, {% for x in seq %} ... {% endfor %}, {% if e %} ... {% elif e %} ... {% else %} ... {% endif %},
{% set name = e %}, {% generation %} ... {% endgeneration %} (marks what a model is to learn), {# comment #}. Expressions have
strings, integers, true, false, none, names, .field, [index], + - ~ == != < <= > >= in, not, and, or, parentheses, and the
filters of FILTERS. There are no calls, no attributes but mapping keys and the fields of loop, and no names but those given: a
template reaches nothing of Python. compile_template() parses it into a tree, folds constant parts and joins literal text, and
returns a closure that yields (text, learned) pieces; a for loop takes any iterator, so a conversation of any length streams.

Cases: null text and null role are empty; rows of a conversation run by turn (null first), then role, then text, so ties and repeated
rows have a fixed order; rows without conv_id form one conversation; extra columns are ignored; an empty table gives only the fixed conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, table

Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


# --- control strings inside texts -------------------------------------------------------------------------------------

#: Strings that a tokenizer reads as control tokens start with one of these; the escape breaks them up with a mark.
MARK = "\u241b"
CONTROLS = ("<s>", "</s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)|" + MARK, re.S)
_ESCAPED = re.compile(MARK + "(.)", re.S)


def escape(text: str) -> str:
    """Puts MARK and - after the first character of each control string, overlapping ones too, and = after MARK itself; unescape() turns it back."""
    return _CONTROL.sub(lambda m: MARK + "=" if m[1] is None else m[1] + MARK + "-", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: MARK if m[1] == "=" else "", text)


FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "escape": lambda x: escape(str(x)), "string": str}

# --- lexer and parser -------------------------------------------------------------------------------------------------

_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|=]))""", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expressions:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"))

    def __init__(self, code: str):
        self.rest = _tokens(code)

    def peek(self) -> str | None:
        return self.rest[0][1] if self.rest and self.rest[0][0] != "str" else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if not self.rest or want is not None and self.peek() != want:
            raise TemplateError(f"expected {want or 'an expression'}")
        return self.rest.pop(0)

    def whole(self) -> tuple:
        node = self.level(0)
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")
        return node

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.filtered()
        ops = self.LEVELS[n]
        if ops == ("not",):
            if self.peek() == "not":
                self.take()
                return ("not", self.level(n))
            return self.level(n + 1)
        node = self.level(n + 1)
        while self.peek() in ops:
            op = self.take()[1]
            node = ("op", op, node, self.level(n + 1))
        return node

    def filtered(self) -> tuple:
        node = self.postfix()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
        return node

    def postfix(self) -> tuple:
        node = self.atom()
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                kind, name = self.take()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"bad field {name}")
                node = ("item", node, ("const", name))
            else:
                node = ("item", node, self.level(0))
                self.take("]")
        return node

    def atom(self) -> tuple:
        kind, value = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _PLAIN.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        if value == "(":
            node = self.level(0)
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("out", e), ("for", name, e, body), ("if", [(e, body)...]), ("set", name, e), ("gen", body)."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _PART.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if m[1] or m[4] else text))
        strip = bool(m[3] or m[6])
        at = m.end()
        if m[2] is not None:
            parts.append(("out", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[list[tuple], str]:
        body: list[tuple] = []
        while parts:
            kind, value = parts.pop()
            if kind == "text":
                body += [("text", value)] if value else []
            elif kind == "out":
                body.append(("out", _Expressions(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, value
                if word == "for" and (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    body.append(("for", f[1], _Expressions(f[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    arms, test = [], _Expressions(rest).whole()
                    while True:
                        inner, end = block("elif", "else", "endif")
                        arms.append((test, inner))
                        if end.startswith("elif"):
                            test = _Expressions(end[4:]).whole()
                        elif end == "else":
                            arms.append((("const", True), block("endif")[0]))
                            break
                        else:
                            break
                    body.append(("if", arms))
                elif word == "set" and (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)):
                    body.append(("set", f[1], _Expressions(f[2]).whole()))
                elif word == "generation":
                    body.append(("gen", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return body, ""

    return block()[0]


# --- folding and code generation --------------------------------------------------------------------------------------

_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: f"{_shown(a)}{_shown(b)}"}


def _shown(x) -> str:
    return "" if x is None else str(x)


def fold(node: tuple) -> tuple:
    """An expression with its constant parts computed. What would fail is left to fail where it is rendered."""
    kind = node[0]
    if kind == "op":
        node = ("op", node[1], fold(node[2]), fold(node[3]))
        left = node[2]
        if node[1] in ("and", "or") and left[0] == "const":
            return node[3] if bool(left[1]) == (node[1] == "and") else left
        ready = left[0] == node[3][0] == "const"
    elif kind in ("not", "filter", "item"):
        node = (*node[:-1], fold(node[-1])) if kind != "item" else (kind, fold(node[1]), fold(node[2]))
        ready = node[-1][0] == "const" and (kind != "item" or node[1][0] == "const")
    else:
        return node
    if ready:
        try:
            return ("const", _expression(node)({}))
        except Exception:
            return node
    return node


def fold_body(body: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "out":
            e = fold(node[1])
            new = [("text", _shown(e[1]))] if e[0] == "const" else [("out", e)]
        elif kind == "for":
            new = [("for", node[1], fold(node[2]), fold_body(node[3]))]
        elif kind == "if":
            arms: list[tuple] = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            new = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        elif kind == "set":
            new = [("set", node[1], fold(node[2]))]
        elif kind == "gen":
            new = [("gen", fold_body(node[1]))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "item":
        of, key = _expression(node[1]), _expression(node[2])
        return lambda env: _item(of(env), key(env))
    if kind == "not":
        inner = _expression(node[1])
        return lambda env: not inner(env)
    if kind == "filter":
        f, inner = FILTERS[node[1]], _expression(node[2])
        return lambda env: f(inner(env))
    a, b = _expression(node[2]), _expression(node[3])
    if node[1] == "and":
        return lambda env: a(env) and b(env)
    if node[1] == "or":
        return lambda env: a(env) or b(env)
    op = _OPS[node[1]]
    return lambda env: op(a(env), b(env))


def _looped(seq: Iterable) -> Iterator[tuple[dict, object]]:
    """Items with the fields of loop; looks one item ahead, so loop.last is known."""
    it, i, previous = iter(seq or ()), 0, None
    try:
        item = next(it)
    except StopIteration:
        return
    while True:
        try:
            after, last = next(it), False
        except StopIteration:
            after, last = None, True
        yield {"index0": i, "index": i + 1, "first": i == 0, "last": last, "previtem": previous, "nextitem": after}, item
        if last:
            return
        previous, item, i = item, after, i + 1


def _body(body: list[tuple], learned: bool) -> Callable[[dict], Iterator[Piece]]:
    steps: list[Callable[[dict], Iterator[Piece]]] = [_step(node, learned) for node in body]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return steps[0] if len(steps) == 1 else run


def _step(node: tuple, learned: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], learned)
        return lambda env: iter((piece,))
    if kind == "out":
        e = _expression(node[1])
        return lambda env: iter(((_shown(e(env)), learned),))
    if kind == "gen":
        return _body(node[1], True)
    if kind == "set":
        name, e = node[1], _expression(node[2])

        def put(env: dict) -> Iterator[Piece]:
            env[name] = e(env)
            return iter(())

        return put
    if kind == "for":
        name, e, inner = node[1], _expression(node[2]), _body(node[3], learned)

        def loop(env: dict) -> Iterator[Piece]:
            for state, item in _looped(e(env)):
                yield from inner({**env, name: item, "loop": state})

        return loop
    arms = [(_expression(test), _body(inner, learned)) for test, inner in node[1]]

    def choose(env: dict) -> Iterator[Piece]:
        for test, inner in arms:
            if test(env):
                return inner(env)
        return iter(())

    return choose


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    run = _body(fold_body(parse(source)), False)
    return lambda **env: run(env)


#: Role, escaped, stands in the header; every turn is closed. Nothing but the assistant's text is learned.
TEMPLATE = """{{ '<s>' }}{% for m in messages %}{{ '<|' ~ (m.role | escape) ~ '|>' }}{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ '</s>' }}{% endfor %}"""


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, learned text) of each turn of TEMPLATE's output, read from the joined text: <s> (<|role|> text </s>)*.

    Holds one turn at a time. Escaped texts hold no control string, so the first `</s>` after a header closes the turn.
    """
    held, marks, at, begun = "", [], 0, False
    for text, learned in pieces:
        if learned and text:
            marks.append((len(held), len(held) + len(text)))
        held += text
        if not begun and held.startswith("<s>"):
            held, begun = held[3:], True
            marks = [(a - 3, b - 3) for a, b in marks]
        while (end := held.find("</s>", at)) >= 0:
            bar = held.index("|>", 2)
            if not held.startswith("<|"):
                raise ValueError("not a turn")
            yield unescape(held[2:bar]), unescape(held[bar + 2 : end]), unescape("".join(held[a:b] for a, b in marks if b <= end))
            marks = [(a - end - 4, b - end - 4) for a, b in marks if b > end]
            held, at = held[end + 4 :], 0
        at = max(0, len(held) - 3)
    if held:
        raise ValueError(f"{len(held)} characters after the last turn")


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, text, learned): the pieces of each rendered conversation, in order of part; rows: conv_id, turn, role, text."""
    return _each(rows, template, "conv_id string, part long, text string, learned boolean", _pieces)


def digest_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row per conversation: what read_turns() finds in its rendered text, as digests. Holds one turn at a time."""
    return _each(rows, template, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", _digest)


def _pieces(conv_id, pieces: Iterator[Piece]) -> Iterator[tuple]:
    for i, (text, learned) in enumerate(pieces):
        yield conv_id, i, text, learned


def _digest(conv_id, pieces: Iterator[Piece]) -> Iterator[tuple]:
    size = 0

    def counted() -> Iterator[Piece]:
        nonlocal size
        for p in pieces:
            size += len(p[0])
            yield p

    n, chars, turns, loss = 0, 0, hashlib.sha256(), hashlib.sha256()
    for role, text, learned in read_turns(counted()):
        n, chars = n + 1, chars + len(learned)
        turns.update(f"{role}\n{text}\n".encode())
        loss.update(learned.encode())
    yield conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size


def _each(rows: DataFrame, template: str, schema: str, make: Callable) -> DataFrame:
    """One sort brings a conversation's rows together in order; they stream through the template, whatever their number."""
    Batches.small(rows.sparkSession, 1000)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)

        def turns() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b["conv_id"], b["role"].fillna(""), b["text"].fillna(""), strict=True)

        ahead: list[tuple] = []
        source = turns()

        def messages(conv) -> Iterator[dict]:
            while ahead:
                if ahead[0][0] != conv:
                    return
                _, role, text = ahead.pop()
                ahead.extend(x for x in [next(source, None)] if x)
                yield {"role": role, "text": text}

        ahead.extend(x for x in [next(source, None)] if x)
        out: list[tuple] = []
        while ahead:
            conv = ahead[0][0]
            for x in make(conv, render(messages=messages(conv))):
                out.append(x)
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            for _ in messages(conv):  # what the template left unread
                pass
        if out:
            yield pd.DataFrame(out, columns=names)

    d = rows.select(F.col("conv_id").cast("string"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    d = d.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    # ids travel as text: pandas would turn whole numbers beside nulls into floats
    return d.select("conv_id", "role", "text").mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast("long"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, :said AS text UNION ALL SELECT -7, 1, 'assistant', :said", {"said": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_conversations(rows)


ORACLE_OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, list_sum(list_transform(['<s>', '</s>', '<|', '|>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
    lambda x: (length(role || chr(10) || text) - length(replace(role || chr(10) || text, x, ''))) // length(x))) AS controls,
  length(role || text) - length(replace(role || text, chr(9243), '')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(8 + length(role) + length(text) + 2 * controls + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
