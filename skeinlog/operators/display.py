"""How records, lines, paths and times are shown. Columns where a plan can say it, plain functions where one value is shown."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _some(text: Column, pattern: str) -> Column:
    return F.exists(_lines(text), lambda line: line.rlike(pattern))


def _twice_in_a_row(text: Column, pattern: str) -> Column:
    """Whether two lines that follow each other both match."""
    lines = _lines(text)
    return F.exists(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line, k: line.rlike(pattern) & F.get(lines, k).rlike(pattern)), lambda both: both)


def has_heading(text: Column) -> Column:
    """A line of one to six number signs, a blank and a title."""
    return _some(text, r"^#{1,6} \S")


def has_fence(text: Column) -> Column:
    """A line that opens a block of code with three backticks."""
    return _some(text, "^```")


def has_strong(text: Column) -> Column:
    """Words between two pairs of stars on one line, without a blank after the first pair."""
    return _some(text, r"\*{2}(?=[^\s*])[^*]+\*{2}")


def has_quote(text: Column) -> Column:
    """A quoted line: a sign of greater after at most blanks, a blank or tab, and something."""
    return _some(text, r"^ *>[\t ]\S")


def has_link(text: Column) -> Column:
    """A label in brackets with its target in parentheses right behind; both may run on over no line end."""
    return _some(text, r"\[[^\]]+\]\([^)]+\)")


def has_bullets(text: Column) -> Column:
    """Two bullet items in a row, indented or not."""
    return _twice_in_a_row(text, r"^[\t ]*[*+-] \S")


def has_numbers(text: Column) -> Column:
    """Two numbered items in a row, indented or not."""
    return _twice_in_a_row(text, r"^[\t ]*[0-9]+\. \S")


def has_table(text: Column) -> Column:
    """A row between pipes, followed by a line that rules off the head: dashes behind pipes, colons and blanks only."""
    lines = _lines(text)
    head, rule = r"^ *\|.+\|", r"^ *\|?[\s|:-]*--"
    return F.exists(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line, k: line.rlike(rule) & F.get(lines, k).rlike(head)), lambda both: both)


def content_format(text: Column) -> Column:
    """json, markdown (where the text has some structure of it) or text; empty and null texts are text."""
    braced = F.ltrim(F.regexp_replace(text, r"^\s+", "")).rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull()
    marked = has_fence(text)
    for test in (has_heading, has_strong, has_quote, has_link, has_bullets, has_numbers, has_table):
        marked = marked | test(text)
    return F.when(F.coalesce(text, F.lit("")) == "", "text").when(braced, "json").when(marked, "markdown").otherwise("text")


#: Words that begin a line of code, by what must follow them; fixed values.
CODE_STARTS = {
    r" [\w.]+": ["import", "from"],
    r" +\w": ["def", "class", "func", "fn", "struct", "enum", "trait", "impl", "public", "private", "protected", "static"],
    r" +\w+\s*[=(]": ["function", "const", "let", "var"],
    r" +[\w:.]+": ["package", "namespace", "module", "use"],
}
DIRECTIVES = ["include", "define", "pragma"]


def looks_like_code(text: Column) -> Column:
    """Whether some line begins like a declaration or import, is a directive, or ends in a brace or semicolon."""
    found = _some(text, r"[{};] *$") | _some(text, rf"^\s*#(?:{'|'.join(DIRECTIVES)})\b")
    for behind, words in CODE_STARTS.items():
        found = found | _some(text, rf"^[\t ]*(?:{'|'.join(words)}){behind}")
    return F.coalesce(found, F.lit(False))


TAG = re.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<rest>[^<>]*)>")


def looks_like_markup(text: str | None) -> bool:
    """Whether a text has two paired tags at least: an open one with its close, or two that close themselves."""
    opened: Counter[str] = Counter()
    closed: Counter[str] = Counter()
    alone = 0
    for m in TAG.finditer(text or ""):
        rest = m["rest"]
        if rest.strip() not in ("", "/") and not rest[0].isspace():
            continue
        if m["end"]:
            closed[m["name"]] += 1
        elif rest.endswith("/"):
            alone += 1
        else:
            opened[m["name"]] += 1
    return alone + 2 * sum(min(n, opened[name]) for name, n in closed.items()) >= 2


def relative_time(at: Column, now: Column, written: Column | None = None) -> Column:
    """now, Nm, Nh, Nd, Nw, Nmo or Ny ago; what is in the future or no time stays as ``written`` (null without it)."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    verbatim = F.lit(None).cast("string") if written is None else written
    out = F.when(s.isNull() | (s < 0), verbatim).when(s < 60, "now")
    for most, per, unit in ((3600, 60, "m"), (86_400, 3600, "h"), (604_800, 86_400, "d"), (2_592_000, 604_800, "w"), (31_536_000, 2_592_000, "mo")):
        out = out.when(s < most, F.concat(F.floor(s / per).cast("string"), F.lit(f"{unit} ago")))
    return out.otherwise(F.concat(F.floor(s / 31_536_000).cast("string"), F.lit("y ago")))


def log_time(written: Column) -> Column:
    """ISO text as ``yyyy-MM-dd HH:mm +hhmm`` of the session's zone; empty for null, what is no time clipped to 22 signs."""
    at = F.try_to_timestamp(written)
    shown = F.date_format(at, "yyyy-MM-dd HH:mm xx")
    return F.when(F.coalesce(written, F.lit("")) == "", "").otherwise(F.coalesce(shown, F.substring(written, 1, 22)))


def first_match_line(text: Column, patterns: list[str]) -> Column:
    """Place, from 0, of the first line that one of the patterns of the JVM matches; null without one."""
    if not patterns:
        return F.lit(None).cast("int")
    any_of = "|".join(f"(?:{p})" for p in patterns)
    at = F.array_position(F.transform(_lines(text), lambda line: line.rlike(any_of)), True)
    return F.when(at > 0, (at - 1).cast("int"))


def usable(patterns: list[str]) -> list[str]:
    """The patterns that compile; others are left out, as a search shows what it can."""
    kept = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        kept.append(p)
    return kept


def highlighted(text: Column, patterns: list[str], begin: str = "<<", end: str = ">>") -> Column:
    """The text with marks around what the patterns match; empty matches are not marked."""
    if not patterns:
        return text
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"({'|'.join(f'(?:{p})' for p in patterns)})(?<=.)", f"{safe(begin)}$1{safe(end)}")


def grep_line(number: Column, line: Column, column: Column | None = None, show_number: bool = True) -> Column:
    """``line``, ``number:line`` or ``number:column:line``; a column shows the number too."""
    if column is not None:
        return F.concat_ws(":", number.cast("string"), F.coalesce(column, F.lit(1)).cast("string"), line)
    return F.concat_ws(":", number.cast("string"), line) if show_number else line


def heading(agent: Column, written: Column, path: Column) -> Column:
    """Agent, time (where there is one) and path, two blanks apart."""
    return F.concat_ws("  ", agent, F.when(written != "", written), path)


def bounded_lines(text: Column, most: int, characters: int | None = None) -> Column:
    """The first ``most`` lines of the first ``characters``, with a note of what is left out."""
    if most <= 0 or (characters is not None and characters <= 0):
        return F.lit("")
    cut = text if characters is None else F.substring(text, 1, characters)
    long = F.lit(False) if characters is None else F.char_length(text) > characters
    lines = _lines(cut)
    shown = F.array_join(F.slice(lines, 1, most), "\n")
    more = F.size(lines) - most
    return F.when(long, F.concat(shown, F.lit("\n… (more content)"))).when(more > 0, F.concat(shown, F.lit("\n… (+"), more.cast("string"), F.lit(" more lines)"))).otherwise(F.coalesce(text, F.lit("")))


def compact_path(path: str, width: int) -> str:
    """A path in at most ``width`` signs: first part, parent and name; then parent and name; then the name, cut if need be."""
    if width <= 0 or len(path) <= width:
        return path
    head = "~/" if path.startswith("~/") else "/" if path.startswith("/") else ""
    parts = path[len(head) :].split("/")
    clipped = lambda s: s if len(s) <= width else s[: width - 1] + "…"
    if len(parts) < 3:
        return clipped(path)
    tail = f"…/{parts[-2]}/{parts[-1]}"
    return next((x for x in (f"{head}{parts[0]}/{tail}", tail) if len(x) <= width), clipped(parts[-1]))


def elapsed(seconds: float) -> str:
    """Whole seconds as ``32s``, ``7m 32s`` or ``1h 02m``; never negative."""
    minutes, s = divmod(max(0, int(seconds)), 60)
    hours, m = divmod(minutes, 60)
    return f"{hours}h {m:02d}m" if hours else f"{m}m {s}s" if minutes else f"{s}s"
