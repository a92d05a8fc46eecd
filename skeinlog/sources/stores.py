"""The catalogue of stores as a small table, and discovery of their files."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    """One kind of file: who writes it, how it reads, what it holds and where it lies below a home directory."""

    agent: str
    store: str
    reader: str
    role: str
    coverage: str
    kind: str
    where: str

    adapter: str = ""

    @property
    def adapter_id(self) -> str:
        """The id under which records of the store are known: of the catalogue, where it has one."""
        return self.adapter or next(iter(CATALOGUE[self.store].adapters), f"{self.store}.v1") if self.store in CATALOGUE else self.adapter or f"{self.store}.v1"

    def below(self, home: str) -> str:
        """The glob of its files below a home directory, moved where an environment variable names another root."""
        for root, variable in ROOTS.items():
            if self.where.startswith(root) and os.environ.get(variable):
                return os.environ[variable].rstrip("/") + self.where[len(root) :]
        return f"{home.rstrip('/')}/{self.where}"


@dataclass(frozen=True)
class Known:
    """One row of the catalogue of stores, those without a reader included."""

    store: str
    role: str
    format: str
    coverage: str
    adapters: tuple[str, ...]

    @property
    def agent(self) -> str:
        return self.store.partition(".")[0]


def _catalogue() -> dict[str, Known]:
    rows = [line.split() for line in (Path(__file__).parent / "catalogue.txt").read_text().splitlines() if line and not line.startswith("#")]
    return {name: Known(name, role, shape, coverage, tuple(ids.split(",")) if ids != "-" else ()) for name, role, shape, coverage, ids in rows}


CATALOGUE = _catalogue()
#: Environment variables that move a root; fixed values.
ROOTS = {".claude": "CLAUDE_CONFIG_DIR", ".codex": "CODEX_HOME", ".gemini": "GEMINI_CLI_HOME", ".grok": "GROK_HOME", ".local/share": "XDG_DATA_HOME", ".pi/agent": "PI_CODING_AGENT_DIR"}


#: Stores with a reader; fixed values. ``where`` is a glob below the home directory.
STORES = [
    Store("codex", "codex.history", "codex_history", "prompt_history", "default_search", "jsonl", ".codex/history.jsonl"),
    Store("codex", "codex.sessions", "codex_sessions", "primary_chat", "default_search", "jsonl", ".codex/sessions/**/rollout-*.jsonl"),
    Store("codex", "codex.state_db", "codex_state", "prompt_history", "default_search", "sqlite", ".codex/state_*.sqlite"),
    Store("claude", "claude.history", "claude_history", "prompt_history", "default_search", "jsonl", ".claude/history.jsonl"),
    Store("claude", "claude.projects.session", "claude_session", "primary_chat", "default_search", "jsonl", ".claude/projects/*/*.jsonl"),
    Store("claude", "claude.projects.subagent", "claude_session", "supplementary_chat", "default_search", "jsonl", ".claude/projects/*/*/subagents/*.jsonl"),
    Store("cursor-cli", "cursor-cli.transcripts", "cursor_transcripts", "primary_chat", "default_search", "jsonl", ".cursor/projects/*/agent-transcripts/**/*.jsonl"),
    Store("cursor-cli", "cursor-cli.prompt_history", "string_list", "prompt_history", "default_search", "json", ".cursor/prompt_history.json"),
    Store("gemini", "gemini.tmp.chats", "gemini_chats", "primary_chat", "default_search", "jsonl", ".gemini/tmp/*/chats/*.jsonl"),
    Store("gemini", "gemini.tmp.logs", "gemini_logs", "prompt_history", "default_search", "json", ".gemini/tmp/*/logs.json"),
    Store("grok", "grok.prompt_history", "grok_prompts", "prompt_history", "default_search", "jsonl", ".grok/sessions/*/prompt_history.jsonl"),
    Store("grok", "grok.sessions", "grok_sessions", "primary_chat", "default_search", "jsonl", ".grok/sessions/*/*/chat_history.jsonl"),
    Store("grok", "grok.subagents", "grok_subagents", "supplementary_chat", "default_search", "json", ".grok/sessions/*/*/subagents/*/meta.json"),
    Store("antigravity-cli", "antigravity-cli.history", "antigravity_history", "prompt_history", "default_search", "jsonl", ".gemini/antigravity-cli/history.jsonl"),
    Store("pi", "pi.sessions", "pi_sessions", "primary_chat", "default_search", "jsonl", ".pi/agent/sessions/*/*.jsonl"),
    Store("vscode", "vscode.chat_sessions", "vscode_chats", "primary_chat", "default_search", "json", ".config/Code/User/workspaceStorage/*/chatSessions/*.json"),
    Store("vscode", "vscode.chat_sessions.log", "vscode_log", "primary_chat", "default_search", "jsonl", ".config/Code/User/workspaceStorage/*/chatSessions/*.jsonl"),
    Store("vscode", "vscode.inline_history", "key_values", "prompt_history", "default_search", "sqlite", ".config/Code/User/globalStorage/state.vscdb"),
    Store("cursor-ide", "cursor-ide.state_vscdb", "key_values", "primary_chat", "default_search", "sqlite", ".config/Cursor/User/globalStorage/state.vscdb"),
    Store("cursor-ide", "cursor-ide.workspace_state", "key_values", "primary_chat", "inspectable", "sqlite", ".config/Cursor/User/workspaceStorage/*/state.vscdb"),
    Store("cursor-cli", "cursor-cli.subagent_transcripts", "cursor_transcripts", "supplementary_chat", "default_search", "jsonl", ".cursor/projects/*/agent-transcripts/*/subagents/*.jsonl"),
    Store("cursor-cli", "cursor-cli.chats", "binary_blobs", "primary_chat", "inspectable", "sqlite", ".config/cursor/chats/*/*/store.db"),
    Store("antigravity-cli", "antigravity-cli.conversations", "binary_blobs", "primary_chat", "inspectable", "sqlite", ".gemini/antigravity-cli/conversations/*.db"),
    Store("antigravity-cli", "antigravity-cli.transcript", "walked_lines", "supplementary_chat", "inspectable", "jsonl", ".gemini/antigravity-cli/brain/*/.system_generated/logs/transcript_full.jsonl"),
    Store("codex", "codex.sessions", "walked_values", "primary_chat", "default_search", "json", ".codex/sessions/**/rollout-*.json", "codex.sessions_legacy_json.v1"),
    Store("codex", "codex.history", "walked_values", "prompt_history", "default_search", "json", ".codex/history.json", "codex.history_json.v1"),
    Store("codex", "codex.session_index", "titles", "app_state", "inspectable", "jsonl", ".codex/session_index.jsonl"),
    Store("codex", "codex.external_agent_imports", "summaries", "app_state", "inspectable", "json", ".codex/external_agent_session_imports.json"),
    Store("gemini", "gemini.tmp.chats_legacy", "walked_values", "primary_chat", "default_search", "json", ".gemini/tmp/*/chats/*.json"),
    Store("claude", "claude.store_db", "store_messages", "primary_chat", "inspectable", "sqlite", ".claude/__store.db"),
    Store("claude", "claude.tasks", "todos", "todo", "inspectable", "json", ".claude/tasks/*/*.json"),
    Store("claude", "claude.todos", "todos", "todo", "inspectable", "json", ".claude/todos/*.json"),
    *(Store(s.partition(".")[0], s, reader, CATALOGUE[s].role, CATALOGUE[s].coverage, kind, where, adapter) for s, reader, kind, where, adapter in (
        ("claude.projects.memory", "whole_text", "text", ".claude/projects/*/memory/*.md", ""), ("claude.memory_files", "whole_text", "text", ".claude/CLAUDE.md", ""), ("claude.plans", "whole_text", "text", ".claude/plans/*.md", ""),
        ("claude.projects.workflows", "whole_text", "text", ".claude/projects/*/*/workflows/scripts/*.js", ""), ("claude.projects.session_memory", "whole_text", "text", ".claude/projects/*/*/session-memory/summary.md", ""), ("claude.skills", "whole_text", "text", ".claude/skills/**/*.md", ""),
        ("claude.commands", "whole_text", "text", ".claude/commands/**/*.md", ""), ("claude.usage_data", "summaries", "json", ".claude/usage-data/facets/*.json", ""), ("claude.settings", "summaries", "json", ".claude/settings*.json", ""), ("claude.teams", "summaries", "json", ".claude/teams/*/config.json", ""),
        ("claude.sessions", "summaries", "json", ".claude/sessions/*.json", ""), ("claude.stats_cache", "summaries", "json", ".claude/stats-cache.json", ""), ("claude.ide", "summaries", "json", ".claude/ide/*.json", ""), ("claude.jobs", "summaries", "json", ".claude/jobs/*.json", ""), ("claude.chrome", "summaries", "json", ".claude/chrome/*.json", ""),
        ("claude.update_state", "summaries", "json", ".claude/.last-update-result.json", ""), ("claude.shell_snapshots", "file_facts", "text", ".claude/shell-snapshots/*.sh", ""), ("claude.debug_logs", "file_facts", "text", ".claude/debug/*", ""),
        ("grok.session_search", "grok_search", "sqlite", ".grok/sessions/session_search.sqlite", ""), ("cursor-cli.ai_tracking", "summarized_talks", "sqlite", ".cursor/ai-tracking/ai-code-tracking.db", ""),
        ("codex.goals_db", "codex_goals", "sqlite", ".codex/goals_*.sqlite", ""), ("codex.memories_db", "codex_memories", "sqlite", ".codex/memories_*.sqlite", ""), ("codex.logs_db", "codex_logs", "sqlite", ".codex/logs_*.sqlite", ""),
        ("codex.instructions", "whole_text", "text", ".codex/instructions.md", ""), ("codex.memories", "whole_text", "text", ".codex/memories/**/*.md", ""), ("codex.skills", "whole_text", "text", ".codex/skills/**/*.md", ""), ("codex.rules", "whole_text", "text", ".codex/rules/**/*.rules", ""),
        ("codex.config", "toml_summaries", "text", ".codex/*.toml", ""), ("codex.config_backups", "toml_summaries", "text", ".codex/config.toml.b*", ""), ("codex.update_check", "summaries", "json", ".codex/update-check.json", ""), ("codex.version_file", "summaries", "json", ".codex/version.json", ""),
        ("codex.model_cache", "summaries", "json", ".codex/models_cache.json", ""), ("codex.internal_storage", "summaries", "json", ".codex/internal_storage.json", ""), ("codex.hooks", "summaries", "json", ".codex/hooks.json", ""), ("codex.shell_snapshots", "file_facts", "text", ".codex/shell_snapshots/*", ""),
        ("codex.log_files", "file_facts", "text", ".codex/log/*", ""), ("codex.process_manager", "summaries", "json", ".codex/process_manager/*.json", ""),
        ("cursor-cli.skills", "whole_text", "text", ".cursor/skills/*/SKILL.md", ""), ("cursor-cli.uploads", "whole_text", "text", ".cursor/projects/*/uploads/*.md", ""), ("cursor-cli.agent_tools", "whole_text", "text", ".cursor/projects/*/agent-tools/*.txt", ""),
        ("gemini.memory", "whole_text", "text", ".gemini/GEMINI.md", ""), ("gemini.tool_outputs", "whole_text", "text", ".gemini/tmp/*/tool-outputs/*/*.txt", ""), ("grok.memory", "whole_text", "text", ".grok/memory/**/MEMORY.md", ""), ("grok.plans", "whole_text", "text", ".grok/sessions/*/*/plan.md", ""),
        ("antigravity-cli.brain", "whole_text", "text", ".gemini/antigravity-cli/brain/**/*.md", ""), ("antigravity-ide.brain", "whole_text", "text", ".gemini/antigravity/brain/**/*.md", ""), ("antigravity-ide.brain_resolved", "whole_text", "text", ".gemini/antigravity/brain/*/task.md.resolved", ""), ("antigravity-ide.skills", "whole_text", "text", ".gemini/antigravity/skills/**/*.md", ""),
    )),
    Store("opencode", "opencode.db", "opencode", "primary_chat", "default_search", "sqlite", ".local/share/opencode/opencode.db"),
]
# Role and coverage are those of the catalogue, where it knows the store.
STORES = [replace(s, role=CATALOGUE[s.store].role, coverage=CATALOGUE[s.store].coverage) if s.store in CATALOGUE else s for s in STORES]
BY_NAME = {s.store: s for s in reversed(STORES)}


def catalogue(spark: SparkSession) -> DataFrame:
    """The stores with a reader as a table."""
    return spark.createDataFrame([(s.agent, s.store, s.adapter_id, s.role, s.coverage, s.kind, s.where) for s in STORES], "agent string, store string, adapter_id string, role string, coverage string, source_kind string, path_glob string")


def whole_catalogue(spark: SparkSession) -> DataFrame:
    """``agent, store, role, format, coverage, adapters, readable`` of every known store, private and merely catalogued ones included."""
    rows = [(k.agent, k.store, k.role, k.format, k.coverage, list(k.adapters), k.store in BY_NAME) for k in CATALOGUE.values()]
    return spark.createDataFrame(rows, "agent string, store string, role string, format string, coverage string, adapters array<string>, readable boolean")


def inferred_coverage(written: str | None, by_default: bool, discovered: bool) -> str:
    """The coverage of a store: as written, else by whether it is searched by default or found at all."""
    return written or ("default_search" if by_default else "inspectable" if discovered else "catalog_only")


def discover(spark: SparkSession, home: str, agents: list[str] | None = None, roles: list[str] | None = None, default_only: bool = False) -> DataFrame:
    """``agent, store, adapter_id, path, path_kind, source_kind, search_root, mtime_ns, coverage, role`` of the files below ``home``.

    Spark lists the files; nothing of their content is read. Stores without files give no rows. ``default_only`` leaves
    out those that are searched on demand only; private stores have no reader and are never listed.
    """
    parts = []
    for s in STORES:
        if (agents and s.agent not in agents) or (roles and s.role not in roles) or (default_only and s.coverage != "default_search"):
            continue
        found = files(spark, s.below(home))
        if found is not None:
            parts.append(found.select(
                F.lit(s.agent).alias("agent"), F.lit(s.store).alias("store"), F.lit(s.adapter_id).alias("adapter_id"), "path",
                F.lit("history_file" if s.role == "prompt_history" else "sqlite_db" if s.kind == "sqlite" else "session_file").alias("path_kind"),
                F.lit(s.kind).alias("source_kind"), F.lit(home).alias("search_root"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(s.coverage).alias("coverage"), F.lit(s.role).alias("role")))
    schema = "agent string, store string, adapter_id string, path string, path_kind string, source_kind string, search_root string, mtime_ns bigint, coverage string, role string"
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["store", "path"])


def files(spark: SparkSession, glob: str) -> DataFrame | None:
    """Path and time of the files of a glob (``**`` is any depth); None where there are none."""
    root, _, rest = glob.partition("/**/")
    reader = spark.read.format("binaryFile")
    if rest:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", rest)
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not found:
        return None
    return reader.load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "modificationTime", "length")
