"""What a search opens, and what it reports about itself: effort and scope, counters, status, next steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skeinlog.plans.query import All, Any_, Equals, Node, Not, QueryError, Request, Term, admitted, terms

PROMPT_ROLES, CHAT_ROLES = ("prompt_history",), ("primary_chat", "supplementary_chat")
#: Stores that hold conversations although their role says otherwise; fixed values.
CONVERSATION_STORES = ("codex.state_db", "pi.context_mode_db")
SEARCHABLE = ("default_search", "inspectable")
#: Conversations that targeted effort opens at most, where the request names no other number; fixed value.
TARGETED = 25
EFFORT_ORDER = ("prompt", "targeted", "exhaustive")


def serves_conversations(role: Column, store: Column) -> Column:
    """Whether a store serves the scope of conversations: by its role, or by the list."""
    return role.isin(*CHAT_ROLES) | store.isin(*CONVERSATION_STORES)


def opened(scope: str, effort: str | None = None) -> Column:
    """Whether a source (``coverage, role, store``) is opened for a scope and an effort; raises where they exclude each other.

    prompt: default prompt histories. targeted: prompt histories, and what may be routed to. exhaustive: for
    prompts these and chats, for conversations what serves them, for all every searchable source.
    """
    chosen = admitted(effort, scope)
    role, store, known = F.col("role"), F.col("store"), F.col("coverage").isin(*SEARCHABLE)
    prompts, talks = role.isin(*PROMPT_ROLES), serves_conversations(role, store)
    if chosen == "prompt":
        return prompts & (F.col("coverage") == "default_search")
    if chosen == "targeted":
        return known & (prompts | talks)
    return known & {"prompts": prompts | role.isin(*CHAT_ROLES), "conversations": talks, "all": F.lit(True)}[scope]


def without_history(sources: DataFrame) -> DataFrame:
    """Agents of which no prompt history was found: their chats stand in for it."""
    have = sources.where(F.col("role").isin(*PROMPT_ROLES)).select("agent").distinct()
    return sources.select("agent").distinct().join(have, "agent", "left_anti")


def possible_kinds(node: Node) -> set[str]:
    """The kinds of record (prompt, history) for which a query can hold at all."""
    both = {"prompt", "history"}
    if isinstance(node, Not):
        return both
    if isinstance(node, All):
        return set.intersection(both, *map(possible_kinds, node.of))
    if isinstance(node, Any_):
        return set().union(*map(possible_kinds, node.of))
    if isinstance(node, Equals) and node.name == "kind":
        return both & {node.value.lower()}
    if isinstance(node, Equals) and node.name == "scope" and node.value.lower() == "prompts":
        return {"prompt"}
    return both


def only_terms(node: Node) -> bool:
    """Whether a query is nothing but terms that all must occur."""
    return isinstance(node, Term) or (isinstance(node, All) and all(map(only_terms, node.of)))


def unsupported_for_sources(node: Node, fields: set[str], below: bool = False) -> str | None:
    """Why a listing of sources cannot evaluate a query: a term under NOT or OR, or a field of records; None where it can."""
    if isinstance(node, Term):
        return "a text term under NOT or OR has no meaning for sources" if below else None
    if isinstance(node, Not):
        return unsupported_for_sources(node.of, fields, True)
    if isinstance(node, All | Any_):
        return next((r for n in node.of if (r := unsupported_for_sources(n, fields, below or isinstance(node, Any_)))), None)
    return None if node.name in fields else f"{node.name} is not known of sources"


def without_depth(text: str) -> str:
    """A query without its words ``depth:...`` and ``effort:...``; other blanks stay."""
    return " ".join(w for w in text.split() if not w.lower().startswith(("depth:", "effort:")))


def joined(words: list[Node], filters: list[Node]) -> tuple[Node | None, Node | None]:
    """All filters and words as one tree, and the tree of the words alone; None for none."""
    both = lambda parts: None if not parts else parts[0] if len(parts) == 1 else All(tuple(parts))
    return both([*filters, *words]), both(words)


def planned(records: DataFrame, request: Request, matched: Callable, routed: Callable, conversations: int | None = None) -> DataFrame:
    """The records that a request's effort opens; ``records`` has ``store_role`` and ``kind``.

    prompt: those of prompt histories. targeted: these and the whole conversations to which the newest evidence
    leads, at most ``conversations`` of them: the limit is the effort's. exhaustive: all. Evidence are prompts with any of
    the positive words.
    """
    ready = request.resolved() if request.tree is None else request
    chosen = admitted(ready.effort, ready.scope)
    if chosen != "targeted":
        if conversations is not None:
            raise QueryError("a number of conversations needs effort targeted")
        return records if chosen == "exhaustive" else records.where(F.col("store_role").isin(*PROMPT_ROLES))
    if conversations is not None and conversations < 1:
        raise QueryError("the number of conversations is at least 1")
    words = terms(ready.tree) if ready.tree is not None else ready.text.split()
    seen = records.where(F.col("store_role").isin(*PROMPT_ROLES) | (F.col("kind") == "prompt"))
    evidence = matched(seen, Request(" ".join(words), any_term=True)) if words else seen
    chats = routed(evidence, records.where(F.col("store_role").isin(*CHAT_ROLES)), conversations or TARGETED)
    return records.where(F.col("store_role").isin(*PROMPT_ROLES)).unionByName(chats) if ready.scope == "all" else chats


@dataclass(frozen=True)
class Coverage:
    """Counters of one run. What is eligible was discovered, what is planned eligible, what is opened planned."""

    discovered: int = 0
    eligible: int = 0
    planned: int = 0
    opened: int = 0
    failed: int = 0
    unsupported: int = 0
    bounded: int = 0
    cancelled: int = 0
    skipped: int = 0
    records: int = 0
    matches: int = 0
    conversations: int = 0
    stops: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        chain = (self.discovered, self.eligible, self.planned, self.opened)
        if any(n < 0 for n in (*chain, self.records, self.matches)) or any(a < b for a, b in zip(chain, chain[1:], strict=False)) or self.matches > self.records:
            raise ValueError("the counters contradict each other")


@dataclass(frozen=True)
class Summary:
    """How a run ended and what it is worth."""

    requested: str
    completed: str | None
    state: str
    reason: str | None
    conditions: tuple[str, ...]
    outcome: str
    next_efforts: tuple[str, ...]
    confirm: bool
    coverage: Coverage = field(default_factory=Coverage)
    matches: int = 0
    order: str = "newest"
    limit: int | None = None

    def payload(self) -> dict:
        """As plain values, for JSON."""
        return asdict(self)


def observed(records: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """``records`` that count themselves while they are read: no second pass."""
    seen = Observation(name)
    return records.observe(seen, F.count(F.lit(1)).alias("records")), seen


def summary(request: Request, coverage: Coverage, matches: int, *, failed: bool = False, cancelled: bool = False, truncated: bool = False, approximate: bool = False,
            answered_early: bool = False, limit_reached: bool = False, scope_given: bool = False) -> Summary:
    """The end of a run. A state goes before those behind it: failed, cancelled, truncated, approximate, bounded, complete."""
    effort = admitted(request.effort, request.scope)
    guess = "heuristic_candidate_selection" if effort == "targeted" else "approximate_execution"
    rough = approximate or effort == "targeted"
    wrong = [c for c, here in (("source_failure", coverage.failed), ("unsupported_adapter", coverage.unsupported), ("engine_failure", failed)) if here]
    internal = ("failure_cleanup", "source_failure", "unsupported_adapter")
    stops = [s for s in dict.fromkeys(coverage.stops) if s not in internal]
    given = [("cancelled", cancelled), ("response_truncated", truncated), ("answer_now", answered_early), ("result_limit", limit_reached)]
    conditions = [*wrong, *(c for c, here in given if here), *stops, *([guess] if rough else [])]
    cut_short = answered_early or limit_reached or coverage.bounded or (request.limit is not None and coverage.skipped)
    bound = "answer_now" if answered_early else "result_limit" if limit_reached else next(iter(stops), "bounded_execution")
    ladder = [("failed", wrong, wrong[0] if wrong else None), ("cancelled", cancelled, "cancelled"), ("truncated", truncated, "response_truncated"), ("approximate", rough, guess), ("bounded", cut_short, bound)]
    state, _, reason = next((step for step in ladder if step[1]), ("complete", True, None))
    partly = bool(answered_early or approximate or coverage.bounded or coverage.cancelled or (request.limit is not None and coverage.skipped))
    completed: str | None = effort
    if state in ("failed", "cancelled", "truncated") or partly:
        completed, outcome = None, "matches" if approximate and matches and state == "approximate" else "undetermined"
    elif matches:
        outcome = "matches"
    elif effort == "targeted":
        outcome = "no_selected_conversation_match" if coverage.conversations else "no_candidate_conversation"
    else:
        outcome = {"prompt": "no_prompt_match", "exhaustive": "no_exhaustive_match"}[effort]
    deeper = EFFORT_ORDER[EFFORT_ORDER.index(effort) + 1 :] if completed and (effort == "targeted" or state in ("complete", "bounded")) else ()
    return Summary(effort, completed, state, reason, tuple(conditions), outcome, deeper, bool(deeper) and scope_given, coverage, matches, request.order, request.limit)


def coverage_of(sources: DataFrame, request: Request) -> DataFrame:
    """``agent, discovered, searchable, opened``: how many sources of each agent a request leaves at each step, in one pass."""
    ready = request.resolved() if request.tree is None else request
    one = lambda keep: F.sum(keep.cast("bigint"))
    return sources.groupBy("agent").agg(
        F.count("*").alias("discovered"), one(F.col("coverage").isin(*SEARCHABLE)).alias("searchable"), one(F.coalesce(opened(ready.scope, ready.effort), F.lit(False))).alias("opened"))
