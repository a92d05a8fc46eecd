"""The query language: text to a checked tree. Pure Python; nothing here touches Spark.

A query is an OR of ANDs (spoken or implied) of primaries, each possibly negated by NOT or ``-``: a group, a
field predicate (``field:value``, ``field:>v``, ``field:[a TO b]``, ``field:*``), a word or a quoted phrase.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta


class QueryError(ValueError):
    """A query that cannot be understood, with the place where."""

    def __init__(self, message: str, at: int = 0) -> None:
        super().__init__(f"{message} (at {at})")
        self.at = at


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass(frozen=True)
class Equals:
    name: str
    value: str


@dataclass(frozen=True)
class Compare:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Between:
    name: str
    low: str
    high: str
    low_in: bool = True
    high_in: bool = True


@dataclass(frozen=True)
class Exists:
    name: str


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class All:
    of: tuple[Node, ...]


@dataclass(frozen=True)
class Any_:
    of: tuple[Node, ...]


Node = Term | Equals | Compare | Between | Exists | Not | All | Any_


@dataclass(frozen=True)
class Field:
    """A field of the language. ``layer`` is source, record or request; ``kind`` enum, text, path, whole or date."""

    name: str
    layer: str
    kind: str
    values: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    ordered: bool = False


#: Agents, scopes, kinds and efforts that a query may name; fixed values.
AGENTS = ("codex", "claude", "cursor-cli", "cursor-ide", "gemini", "grok", "pi", "opencode", "vscode", "antigravity-cli", "antigravity-ide", "windsurf")
SCOPES = ("prompts", "conversations", "all")
KINDS = ("prompt", "history")
EFFORTS = {"prompt": "prompt", "targeted": "targeted", "deep": "targeted", "exhaustive": "exhaustive"}

FIELDS = [
    Field("agent", "source", "enum", AGENTS), Field("store", "source", "text"), Field("adapter_id", "source", "text", also=("adapter",)), Field("path", "source", "path"),
    Field("mtime", "source", "date", ordered=True), Field("scope", "record", "enum", SCOPES), Field("kind", "record", "enum", KINDS),
    Field("timestamp", "record", "date", also=("date",), ordered=True), Field("model", "record", "text"), Field("role", "record", "text"), Field("cwd", "record", "descendant"),
    Field("repo", "record", "descendant"), Field("worktree", "record", "descendant"), Field("branch", "record", "whole"), Field("project", "record", "whole"), Field("cwd_hash", "record", "whole"),
    Field("text", "record", "text"), Field("depth", "request", "enum", tuple(EFFORTS), also=("effort",)),
]


class Registry:
    """Known fields by name and other name; own fields may be added, taken names are rejected."""

    def __init__(self, fields: list[Field] | None = None) -> None:
        self.by_name: dict[str, Field] = {}
        for one in FIELDS if fields is None else fields:
            self.add(one)

    def add(self, one: Field) -> None:
        for name in (one.name, *one.also):
            if name in self.by_name:
                raise ValueError(f"field {name!r} is taken")
        for name in (one.name, *one.also):
            self.by_name[name] = one

    def get(self, name: str) -> Field | None:
        return self.by_name.get(name)

    def nearest(self, name: str) -> str | None:
        """The known name most like a mistyped one."""
        return next(iter(difflib.get_close_matches(name, self.by_name, n=1, cutoff=0.6)), None)


_FIELD = re.compile(r"[+-]?\(*([a-z_][a-z0-9_]*):", re.I)


def engages(text: str, registry: Registry | None = None) -> bool:
    """Whether a text is a query rather than plain terms: a leading quote, an upper-case AND, OR or NOT alone, or a known field."""
    known = registry or Registry()
    if text.lstrip().startswith('"'):
        return True
    for word in text.split():
        if word.strip("()") in ("AND", "OR", "NOT"):
            return True
        found = _FIELD.match(word)
        if found and known.get(found.group(1).lower()):
            return True
    return False


def unknown_fields(text: str, registry: Registry | None = None) -> list[tuple[str, str | None]]:
    """Lower-case ``name:`` prefixes that are no field and no start of an address, with the field they may mean."""
    known, out = registry or Registry(), []
    for word in text.split():
        found = re.match(r"[+-]?\(*([a-z_][a-z0-9_]*):(?!//)(\S+)", word)
        if found and not known.get(found.group(1)) and (found.group(1), known.nearest(found.group(1))) not in out:
            out.append((found.group(1), known.nearest(found.group(1))))
    return out


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


_PLAIN = re.compile(r'[^\s()"\[\]{}]+')


def tokenize(text: str) -> list[Token]:
    """Words, phrases, groups, operators and the parts of field predicates, each with its place."""
    return list(_tokens(text))


def _tokens(text: str) -> Iterator[Token]:
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c.isspace():
            at += 1
        elif c in "()":
            yield Token(c, c, at)
            at += 1
        elif c in "+-" and at + 1 < n and not text[at + 1].isspace():
            if c == "-":
                yield Token("NOT", "-", at)
            at += 1
        elif c == '"':
            phrase, end = _quoted(text, at)
            yield Token("PHRASE", " ".join(phrase.split()), at)
            at = end
        else:
            found = re.match(r"([A-Za-z_][A-Za-z0-9_]*):", text[at:])
            if found and not text[at + found.end() :].startswith("//"):
                yield Token("FIELD", found.group(1).lower(), at)
                at += found.end()
                value, end = _value(text, at)
                yield value
                at = end
                continue
            found = _PLAIN.match(text, at)
            word = found.group() if found else c
            yield Token(word.upper() if word.upper() in ("AND", "OR", "NOT") else "WORD", word, at)
            at += len(word)


def _quoted(text: str, at: int) -> tuple[str, int]:
    out, k = [], at + 1
    while k < len(text):
        if text[k] == "\\" and k + 1 < len(text):
            out.append(text[k + 1])
            k += 2
        elif text[k] == '"':
            return "".join(out), k + 1
        else:
            out.append(text[k])
            k += 1
    raise QueryError("a quote is not closed", at)


def _value(text: str, at: int) -> tuple[Token, int]:
    if at >= len(text) or text[at].isspace():
        raise QueryError("a field has no value", at)
    if text[at] == '"':
        value, end = _quoted(text, at)
        return Token("VALUE", value, at), end
    if text[at] in "[{":
        close = min((k for k in (text.find("]", at), text.find("}", at)) if k >= 0), default=-1)
        if close < 0:
            raise QueryError("a range is not closed", at)
        return Token("RANGE", text[at : close + 1], at), close + 1
    found = re.match(r"(>=|<=|>|<)?([^\s()]+)", text[at:])
    if not found:
        raise QueryError("a field has no value", at)
    if found.group(1):
        return Token("CMP", found.group(), at), at + found.end()
    return Token("VALUE", found.group(2), at), at + found.end()


class _Parser:
    def __init__(self, tokens: list[Token], registry: Registry) -> None:
        self.tokens, self.registry, self.at = tokens, registry, 0

    def peek(self) -> str | None:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else None

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek() == "OR":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Any_(tuple(parts))

    def both(self) -> Node:
        parts = [self.negated()]
        while self.peek() not in (None, "OR", ")"):
            if self.peek() == "AND":
                self.take()
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def negated(self) -> Node:
        if self.peek() == "NOT":
            self.take()
            return Not(self.negated())
        return self.primary()

    def primary(self) -> Node:
        kind = self.peek()
        if kind is None:
            raise QueryError("the query ends too early", self.tokens[-1].at if self.tokens else 0)
        token = self.take()
        if kind == "(":
            inner = self.either()
            if self.peek() != ")":
                raise QueryError("a group is not closed", token.at)
            self.take()
            return inner
        if kind == "WORD":
            return Term(token.text)
        if kind == "PHRASE":
            return Term(token.text, True)
        if kind != "FIELD":
            raise QueryError(f"{token.text!r} is not expected here", token.at)
        known = self.registry.get(token.text)
        if known is None:
            near = self.registry.nearest(token.text)
            raise QueryError(f"unknown field {token.text!r}" + (f", perhaps {near!r}" if near else ""), token.at)
        value = self.take()
        if value.kind == "CMP":
            op = re.match(r">=|<=|>|<", value.text).group()
            return Compare(known.name, op, value.text[len(op) :])
        if value.kind == "RANGE":
            found = re.fullmatch(r"([\[{])\s*(\S+)\s+TO\s+(\S+)\s*([\]}])", value.text)
            if not found:
                raise QueryError("a range needs two bounds and TO", value.at)
            return Between(known.name, found.group(2), found.group(3), found.group(1) == "[", found.group(4) == "]")
        return Exists(known.name) if value.text == "*" else Equals(known.name, value.text)


def parse(text: str, registry: Registry | None = None) -> Node:
    """The checked tree of a query; raises QueryError."""
    known = registry or Registry()
    tokens = tokenize(text)
    if not tokens:
        raise QueryError("the query is empty")
    parser = _Parser(tokens, known)
    tree = parser.either()
    if parser.at < len(tokens):
        raise QueryError(f"{tokens[parser.at].text!r} is not expected here", tokens[parser.at].at)
    check(tree, known)
    return tree


def check(node: Node, registry: Registry, under: bool = False) -> None:
    """Raises where an enum value, a date, a comparison, a range or a request field under NOT or OR makes no sense."""
    if isinstance(node, Not):
        check(node.of, registry, True)
    elif isinstance(node, All | Any_):
        for one in node.of:
            check(one, registry, under or isinstance(node, Any_))
    elif not isinstance(node, Term):
        known = registry.get(node.name)
        if known.layer == "request" and under:
            raise QueryError(f"{node.name} applies to the whole query and may not stand under NOT or OR")
        if isinstance(node, Equals) and known.kind == "enum" and node.value.lower() not in known.values:
            raise QueryError(f"{node.name} is one of {', '.join(known.values)}")
        if isinstance(node, Compare | Between) and not known.ordered:
            raise QueryError(f"{node.name} has no order")
        if known.kind == "date":
            if isinstance(node, Equals):
                window(node.value)
            elif isinstance(node, Compare):
                instant(node.value)
            elif isinstance(node, Between):
                for bound in (node.low, node.high):
                    if bound != "*":
                        instant(bound)


_now: list[Callable[[], datetime]] = [lambda: datetime.now(UTC)]


def set_now(provider: Callable[[], datetime] | None) -> None:
    """Pins the present for relative dates; None lets it run again."""
    _now[0] = provider or (lambda: datetime.now(UTC))


_STEP = {"d": 1, "w": 7, "m": 30, "y": 365}


def instant(text: str) -> datetime:
    """The instant of a date (its start) or of a relative or full time, in UTC."""
    return window(text)[0]


def window(text: str) -> tuple[datetime, datetime]:
    """The half-open window that a date literal means; both ends are equal for an instant."""
    now = _now[0]()
    low = text.strip().lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    named = {"today": 0, "yesterday": -1, "tomorrow": 1}
    if low in named:
        start = midnight + timedelta(days=named[low])
        return start, start + timedelta(days=1)
    if low == "now":
        return now, now
    found = re.fullmatch(r"(\d+)([dwmy])(?:\s*(ago|from now))?", low)
    if found:
        span = timedelta(days=int(found.group(1)) * _STEP[found.group(2)])
        at = now + span if found.group(3) == "from now" else now - span
        return at, at
    found = re.fullmatch(r"(\d{4})(?:-(\d\d))?(?:-(\d\d))?", low)
    try:
        if found:
            year, month, day = int(found.group(1)), found.group(2), found.group(3)
            start = datetime(year, int(month or 1), int(day or 1), tzinfo=UTC)
            if day:
                return start, start + timedelta(days=1)
            if month:
                return start, datetime(year + (int(month) == 12), int(month) % 12 + 1, 1, tzinfo=UTC)
            return start, datetime(year + 1, 1, 1, tzinfo=UTC)
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        raise QueryError(f"{text!r} is no date") from None
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    return at, at


def terms(node: Node, negated: bool = False) -> list[str]:
    """The text terms of a tree, those under NOT only with ``negated``."""
    if isinstance(node, Term):
        return [node.text]
    if isinstance(node, Not):
        return terms(node.of, negated) if negated else []
    return [t for one in node.of for t in terms(one, negated)] if isinstance(node, All | Any_) else []


def names(node: Node) -> set[str]:
    """The fields that a tree names."""
    if isinstance(node, Not):
        return names(node.of)
    if isinstance(node, All | Any_):
        return {n for one in node.of for n in names(one)}
    return set() if isinstance(node, Term) else {node.name}


def effort(node: Node) -> str | None:
    """The one effort a query asks for; raises where it asks for two."""
    found = {EFFORTS[n.value.lower()] for n in _leaves(node) if isinstance(n, Equals) and n.name == "depth"}
    if len(found) > 1:
        raise QueryError("depth is given twice")
    return next(iter(found), None)


def _leaves(node: Node) -> Iterator[Node]:
    if isinstance(node, Not):
        yield from _leaves(node.of)
    elif isinstance(node, All | Any_):
        for one in node.of:
            yield from _leaves(one)
    else:
        yield node


def wanted_scope(node: Node, scope: str) -> str:
    """The narrowest scope that serves an inline ``scope:``: all where the query names another one than asked."""
    named = {n.value.lower() for n in _leaves(node) if isinstance(n, Equals) and n.name == "scope"}
    return scope if not named or named == {scope} else next(iter(named)) if len(named) == 1 and scope == "prompts" else "all"


def admitted(effort_: str | None, scope: str) -> str:
    """The effort that holds for a scope; raises where the two exclude each other."""
    chosen = effort_ or ("prompt" if scope == "prompts" else "exhaustive")
    if chosen == "prompt" and scope != "prompts":
        raise QueryError("effort prompt serves only scope prompts")
    if chosen == "targeted" and scope == "prompts":
        raise QueryError("effort targeted serves scope conversations or all")
    return chosen


@dataclass(frozen=True)
class Request:
    """One search: the text, whether it is a query or literal terms, and how to order and cut the result."""

    text: str = ""
    scope: str = "all"
    effort: str | None = None
    any_term: bool = False
    regex: bool = False
    case_sensitive: bool = False
    order: str = "newest"
    limit: int | None = None
    dedupe: bool = True
    text_only: bool = False
    tree: Node | None = field(default=None, compare=False)

    def resolved(self, registry: Registry | None = None) -> Request:
        """With the tree, the scope and the effort that hold; raises for what makes no sense."""
        if self.order not in ("newest", "relevance", "scan"):
            raise QueryError(f"order {self.order!r} is not known")
        if not self.regex and engages(self.text, registry):
            tree = parse(self.text, registry)
            scope = wanted_scope(tree, self.scope)
            return replace(self, tree=tree, scope=scope, effort=admitted(effort(tree) or self.effort, scope))
        return replace(self, effort=admitted(self.effort, self.scope))
