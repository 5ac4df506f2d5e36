r"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}``, ``{% for name in name %}``, ``{% if expression %}``,
``{% elif expression %}``, ``{% else %}``, ``{% endfor %}``, ``{% endif %}`` and
``{% generation %} ... {% endgeneration %}``, which marks what a model learns to say.
An expression has strings in double quotes, ``true`` and ``false``, names, ``name.field``,
``==``, ``!=``, ``not``, ``and``, ``or`` and ``+`` for text.  There are no calls, no indexes and no
attributes of Python objects: a field is looked up in a turn's mapping alone, so a
template can do nothing but put text together.

``compile_template`` parses the source into a syntax tree, folds constants
(joined text, comparisons of constants, branches never taken), and generates nested
Python closures.  Rendering returns the text and the spans of generated text.

Control strings of the template (``CONTROLS``) inside texts are escaped: ``\`` becomes
``\\`` and the first character of a control string gets a ``\`` before it.
``parse`` reads the turns back, so formatting is reversible for any text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the default template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>")

#: User turns between instruction marks, assistant turns closed by an end mark, any other role named.
TEMPLATE = """{% for turn in turns %}{% if turn.role == "user" %}<s>[INST] {{ turn.text }} [/INST]
{% elif turn.role == "assistant" %}{% generation %}{{ turn.text }}{% endgeneration %}</s>
{% else %}<<ROLE>>{{ turn.role }}<</ROLE>>{{ turn.text }}</s>
{% endif %}{% endfor %}"""


class TemplateError(ValueError):
    """The template isn't in the language."""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Put:
    item: object


@dataclass(frozen=True)
class Block:
    items: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, block)
    otherwise: Block


@dataclass(frozen=True)
class For:
    name: str
    over: Name
    body: Block


@dataclass(frozen=True)
class Generation:
    body: Block


_TAG = regex.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", regex.DOTALL)
_WORD = regex.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<op>==|!=|\+|\(|\))|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(?P<bad>\S))')
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression's words."""

    def __init__(self, source: str):
        self.words = []
        for m in _WORD.finditer(source):
            if m.lastgroup == "bad":
                raise TemplateError(f"unexpected {m['bad']!r} in {source.strip()!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
        self.at = 0

    def peek(self) -> tuple[str, str] | tuple[None, None]:
        return self.words[self.at] if self.at < len(self.words) else (None, None)

    def take(self, *values: str) -> str | None:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def whole(self) -> object:
        found = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return found

    def either(self) -> object:
        found = self.both()
        while self.take("or"):
            found = Binary("or", found, self.both())
        return found

    def both(self) -> object:
        found = self.negated()
        while self.take("and"):
            found = Binary("and", found, self.negated())
        return found

    def negated(self) -> object:
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> object:
        found = self.joined()
        if op := self.take("==", "!="):
            found = Binary(op, found, self.joined())
        return found

    def joined(self) -> object:
        found = self.single()
        while self.take("+"):
            found = Binary("+", found, self.single())
        return found

    def single(self) -> object:
        if self.take("("):
            found = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return found
        kind, word = self.peek()
        if kind is None or kind == "op" or word in ("and", "or", "not"):
            raise TemplateError("an expression is incomplete")
        self.at += 1
        if kind == "text":
            return Text(regex.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=regex.DOTALL))
        return {"true": True, "false": False}.get(word, Name(tuple(word.split("."))))


def parse_template(source: str) -> Block:
    """The syntax tree of a template."""
    stack: list[tuple[str, list, object]] = [("", [], None)]  # (tag, items so far, what the tag has)

    def close(tag: str) -> tuple[list, object]:
        if stack[-1][0] != tag:
            raise TemplateError(f"{{% end{tag} %}} closes {stack[-1][0] or 'nothing'}")
        _, items, has = stack.pop()
        return items, has

    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(Put(Text(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Put(_Expression(m[1]).whole()))
            continue
        word, _, more = m[2].strip().partition(" ")
        if word == "for":
            if not (f := regex.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)\s*", more)):
                raise TemplateError(f"not a loop: {m[2].strip()!r}")
            stack.append(("for", [], (f[1], Name((f[2],)))))
        elif word == "if":
            stack.append(("if", [], ([], _Expression(more).whole())))
        elif word in ("elif", "else"):
            items, (arms, condition) = close("if")
            if condition is None:
                raise TemplateError("a branch after {% else %}")
            stack.append(("if", [], ([*arms, (condition, Block(tuple(items)))], _Expression(more).whole() if word == "elif" else None)))
        elif word == "endif":
            items, (arms, condition) = close("if")
            body = Block(tuple(items))
            stack[-1][1].append(If(tuple(arms), body) if condition is None else If((*arms, (condition, body)), Block(())))
        elif word == "endfor":
            items, (name, over) = close("for")
            stack[-1][1].append(For(name, over, Block(tuple(items))))
        elif word == "generation":
            if any(tag == "generation" for tag, _, _ in stack):
                raise TemplateError("{% generation %} inside {% generation %}")
            stack.append(("generation", [], None))
        elif word == "endgeneration":
            items, _ = close("generation")
            stack[-1][1].append(Generation(Block(tuple(items))))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if at < len(source):
        stack[-1][1].append(Put(Text(source[at:])))
    if len(stack) > 1:
        raise TemplateError(f"{{% {stack[-1][0]} %}} isn't closed")
    return Block(tuple(stack[0][1]))


def _constant(x: object) -> bool:
    return isinstance(x, (Text, bool))


def _value(x: object) -> object:
    return x.value if isinstance(x, Text) else x


def fold(node: object) -> object:
    """The tree with what is known before rendering worked out."""
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if _constant(left) and _constant(right):
            a, b = _value(left), _value(right)
            done = {"==": lambda: a == b, "!=": lambda: a != b, "and": lambda: bool(a) and bool(b), "or": lambda: bool(a) or bool(b), "+": lambda: str(a) + str(b)}[node.op]()
            return Text(done) if isinstance(done, str) else done
        if node.op in ("and", "or") and _constant(left):
            return bool(_value(left)) if bool(_value(left)) == (node.op == "or") else Not(Not(right))
        return Binary(node.op, left, right)
    if isinstance(node, Not):
        item = fold(node.item)
        return not _value(item) if _constant(item) else Not(item)
    if isinstance(node, Put):
        return Put(fold(node.item))
    if isinstance(node, Block):
        items: list = []
        for item in map(fold, node.items):
            for x in item.items if isinstance(item, Block) else (item,):
                if isinstance(x, Put) and items and isinstance(items[-1], Put) and _constant(x.item) and _constant(items[-1].item):
                    items[-1] = Put(Text(str(_value(items[-1].item)) + str(_value(x.item))))
                else:
                    items.append(x)
        return Block(tuple(items))
    if isinstance(node, If):
        arms, otherwise = [], fold(node.otherwise)
        for condition, body in node.arms:
            condition = fold(condition)
            if _constant(condition):
                if _value(condition):
                    otherwise = fold(body)
                    break
                continue
            arms.append((condition, fold(body)))
        return If(tuple(arms), otherwise) if arms else otherwise
    if isinstance(node, For):
        return For(node.name, node.over, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


class _Output:
    """Rendered text with the spans of generated text, in characters."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _get(path: tuple[str, ...]) -> Callable[[dict], object]:
    if len(path) == 1:
        return lambda scope, n=path[0]: scope.get(n, "")

    def field(scope: dict, n: str = path[0], k: str = path[1]) -> object:
        has = scope.get(n)
        return has.get(k, "") if type(has) is dict else ""

    return field


def _expression(node: object) -> Callable[[dict], object]:
    if _constant(node):
        return lambda scope, v=_value(node): v
    if isinstance(node, Name):
        return _get(node.path)
    if isinstance(node, Not):
        item = _expression(node.item)
        return lambda scope: not item(scope)
    left, right = _expression(node.left), _expression(node.right)
    return {
        "==": lambda scope: left(scope) == right(scope),
        "!=": lambda scope: left(scope) != right(scope),
        "and": lambda scope: bool(left(scope)) and bool(right(scope)),
        "or": lambda scope: bool(left(scope)) or bool(right(scope)),
        "+": lambda scope: str(left(scope)) + str(right(scope)),
    }[node.op]


def _closure(node: object) -> Callable[[dict, _Output], None]:
    if isinstance(node, Put):
        if _constant(node.item):
            return lambda scope, out, v=str(_value(node.item)): out.put(v)
        item = _expression(node.item)
        return lambda scope, out: out.put(str(item(scope)))
    if isinstance(node, Block):
        items = [_closure(x) for x in node.items]

        def block(scope: dict, out: _Output) -> None:
            for item in items:
                item(scope, out)

        return block
    if isinstance(node, If):
        arms, otherwise = [(_expression(c), _closure(b)) for c, b in node.arms], _closure(node.otherwise)

        def branch(scope: dict, out: _Output) -> None:
            for condition, body in arms:
                if condition(scope):
                    return body(scope, out)
            return otherwise(scope, out)

        return branch
    if isinstance(node, For):
        over, body, name = _get(node.over.path), _closure(node.body), node.name

        def loop(scope: dict, out: _Output) -> None:
            items = over(scope)
            for item in items if type(items) is list else ():
                body(scope | {name: item}, out)

        return loop
    body = _closure(node.body)

    def generation(scope: dict, out: _Output) -> None:
        start = out.length
        body(scope, out)
        out.spans.append((start, out.length))

    return generation


@cache
def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names to the rendered text and its generated spans."""
    run = _closure(fold(parse_template(source)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run(names, out)
        return "".join(out.parts), out.spans

    return render


_CONTROL = regex.compile(r"\\|" + "|".join(f"(?={regex.escape(c)})" for c in CONTROLS))
_UNESCAPE = regex.compile(r"\\(.)", regex.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation of (role, text) turns and the spans under the loss mask."""
    scope = {"turns": [{"role": role if role in ("user", "assistant") else escape(role), "text": escape(text)} for role, text in turns]}
    return compile_template(template)(scope)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation that the default template rendered."""
    turns, at = [], 0
    while at < len(formatted):
        turn, at = _parse_turn(formatted, at)
        turns.append(turn)
    return turns


def _until(formatted: str, at: int, control: str) -> tuple[str, int]:
    """The unescaped text from ``at`` to the next ``control``, and where that ends."""
    k = at
    while True:
        end = formatted.find(control, k)
        if end < 0:
            raise ValueError(f"no {control} after character {at}")
        back = end
        while back > at and formatted[back - 1] == "\\":
            back -= 1
        if (end - back) % 2 == 0:
            return unescape(formatted[at:end]), end + len(control)
        k = end + 1


def _parse_turn(formatted: str, at: int) -> tuple[tuple[str, str], int]:
    opening, role_opening = "<s>[INST] ", "<<ROLE>>"
    if formatted.startswith(opening, at):
        text, at = _until(formatted, at + len(opening), " [/INST]\n")
        return ("user", text), at
    if formatted.startswith(role_opening, at):
        role, at = _until(formatted, at + len(role_opening), "<</ROLE>>")
        text, at = _until(formatted, at, "</s>\n")
        return (role, text), at
    text, at = _until(formatted, at, "</s>\n")
    return ("assistant", text), at


def format_conversations(turns: DataFrame, template: str = TEMPLATE, key_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", reversible: bool = False) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation rendered, its turns by ``turn``.

    Control strings inside texts are escaped as the default template needs it, so only what that one renders can be read
    back by ``read_back``.  Another template is the caller's to reverse; with ``reversible`` it is an error.

    ``loss_spans`` are [start, end) code points of ``formatted`` that the loss mask covers.

    - A null text is empty; a null role is the empty role.
    - Turns with equal or null numbers follow each other by role and text, nulls first.
    - Rows with a null key are one conversation with a null key.
    - Repeated rows are repeated turns.  Other columns aren't read.  An empty table gives an empty table.

    Turns meet in one sorted array a conversation: a conversation is one formatted text anyway.
    """
    if reversible and template != TEMPLATE:
        raise TemplateError("only the default template can be read back")
    ordered = turns.select(
        F.col(key_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    whole = ordered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in own.as_py()], template) for own in batch.column(1)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text for text, _ in done], pa.string()), spans], names=["conv_id", "formatted", "loss_spans"])

    return whole.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) from what ``format_conversations`` returned with the default template, texts unescaped.

    - A null ``formatted`` gives null turns and a null loss text; a text that the template can't have rendered gives null turns.
    - Null spans cover nothing; spans beyond the text end with it.
    - A null key stays null, repeated rows are read alike, texts of any length whole.  An empty table gives an empty table.
    """

    def turns_of(text: str) -> list[dict] | None:
        try:
            return [{"role": role, "text": said} for role, said in parse(text)]
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, losses = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append(None if text is None else turns_of(text))
                losses.append(None if text is None else "".join(unescape(text[s["start"] : s["end"]]) for s in spans or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(losses, pa.string()), batch.column(1)], names=["conv_id", "turns", "loss_text", "formatted"])

    return formatted.mapInArrow(run, "conv_id long, turns array<struct<role: string, text: string>>, loss_text string, formatted string")
