"""Queries of the problems of text (3, 4, 5, 8, 9, 10) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions.ids import clean_id
from skeinlog.llm.conversations import conversations, infer_role, reciprocal, split_by_gaps
from skeinlog.llm.defects import answer_text, defective_pairs
from skeinlog.llm.lookalikes import lookalike_classes, lookalike_pairs, plain_text
from skeinlog.llm.mixing import mix, phase_shares, shares
from skeinlog.llm.pii import found_items, mask_text
from skeinlog.llm.tokens import encode, encode_with_offsets
from skeinlog.operators.instants import normalize_instants
from skeinlog.runtime import table


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, question, answer`` of the requests in vscode_chats."""
    requests = table(spark, sf_dir, "vscode_chats").select(F.explode("requests").alias("r")).where("r is not null")
    return requests.select(F.col("r.requestId").alias("request_id"), F.col("r.message.text").alias("question"), answer_text(F.col("r.response")).alias("answer"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: requests with a defective answer."""
    return defective_pairs(chat_pairs(spark, sf_dir))


def free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, row_key, texts``: the free texts of the three tables, those of a message in one array with nulls at their places."""
    history = table(spark, sf_dir, "codex_history").select(F.lit("codex_history").alias("tbl"), F.col("row_id").cast("string").alias("row_key"), F.array("text").alias("texts"))
    prompts = table(spark, sf_dir, "grok_prompts").select(F.lit("grok_prompts").alias("tbl"), F.col("row_id").cast("string").alias("row_key"), F.array("prompt").alias("texts"))
    said = table(spark, sf_dir, "claude_messages").select(F.lit("claude_messages").alias("tbl"), clean_id(F.col("uuid")).alias("row_key"), F.transform("message.content", lambda e: e["text"]).alias("texts"))
    return history.unionByName(prompts).unionByName(said)


def personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, row_key, texts`` of the rows with a key and texts, without null texts."""
    return free_texts(spark, sf_dir).where("row_key is not null and texts is not null").withColumn("texts", F.filter("texts", lambda t: t.isNotNull()))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: one row per item of personal information. Repeated rows are dropped where items are few: at the end."""
    return found_items(personal_texts(spark, sf_dir), "texts").distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: the texts of the three tables with typed placeholders, as arrays with the places of ``free_texts``."""
    rows = free_texts(spark, sf_dir).where("row_key is not null or texts is not null")
    return mask_text(rows, "texts").select("tbl", "row_key", F.col("texts").alias("masked")).distinct()


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, uuid, parent, role, at, has_text, channel`` of claude_messages."""
    machines = table(spark, sf_dir, "machines").select("machine", "tz", "date_order")
    rows = table(spark, sf_dir, "claude_messages").where("uuid is not null").join(machines, "machine", "left")
    said = F.exists(F.coalesce("message.content", F.array()), lambda e: (e["type"] == "text") & F.coalesce(e["text"], F.lit("")).rlike(r"[^\s\x{85}\x{a0}\x{200b}\x{feff}\p{Z}]"))
    picked = rows.select(
        clean_id(F.col("sessionId")).alias("session_id"), clean_id(F.col("uuid")).alias("uuid"), clean_id(F.col("parentUuid")).alias("parent"),
        infer_role(F.col("message.role"), F.col("type")).alias("role"), F.coalesce(said, F.lit(False)).alias("has_text"),
        F.col("cwd").alias("channel"), "timestamp", "tz", "date_order",
    )
    return normalize_instants(picked, "timestamp", out="at").drop("timestamp", "tz", "date_order")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: the messages of every kept conversation in order, with roles."""
    return conversations(chat_messages(spark, sf_dir))


def p5_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: messages by directory (without one, by session), parted at calibrated inactivity gaps; only parts with question and reply."""
    rows = chat_messages(spark, sf_dir).select(F.coalesce("channel", "session_id").alias("channel"), "uuid", "role", "at").distinct()
    return reciprocal(split_by_gaps(rows, "channel", "at", "uuid"), ["channel", "part"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: token ids of every document."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: token ids with the byte where each starts."""
    return encode_with_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def curriculum(targets: DataFrame, swing: float = 0.5) -> list[tuple[float, dict[str, float]]]:
    """A schedule of three phases whose integral is the target weights: the heaviest source is rarer at first and more frequent at the end.

    ``targets`` has one row per source. The middle phase has the target weights; the first and the last, equally
    long, differ from them by ``swing`` of the smaller of the two sides in opposite directions.
    """
    weight = {r["source"]: max(0.0, float(r["weight"] or 0)) for r in targets.where("source is not null").collect()}
    total = sum(weight.values())
    if not total:
        return [(1.0, weight)]
    share = {s: w / total for s, w in weight.items()}
    top = max(share, key=lambda s: (share[s], s))
    moved = swing * min(share[top], 1 - share[top])
    rest = 1 - share[top]
    shift = lambda sign: {s: q + sign * (moved if s == top else -moved * q / rest) for s, q in share.items()} if rest else share
    return [(0.3, shift(-1)), (0.7, share), (1.0, shift(1))]


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: the documents of the mix in training order, by a schedule of three phases."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix(table(spark, sf_dir, "documents"), targets, curriculum(targets))


def p9_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: the share of each source in each phase of the schedule, planned and reached."""
    return phase_shares(p9_mix(spark, sf_dir), curriculum(table(spark, sf_dir, "mix_targets")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: target and actual shares of the mix."""
    return shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: pairs of documents that look the same but differ in code points."""
    return lookalike_pairs(table(spark, sf_dir, "documents").select("doc_id", "text")).toDF("doc_id_a", "doc_id_b")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: of each document the class of those that look the same and its number of links."""
    return lookalike_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: the one form of each document."""
    return plain_text(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "form")


QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_masked": p4_masked,
    "p5_found": p5_found,
    "p5_channels": p5_channels,
    "p8_ids": p8_ids,
    "p8_offsets": p8_offsets,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_phases": p9_phases,
    "p10_found": p10_found,
    "p10_forms": p10_forms,
    "p10_classes": p10_classes,
}
SQL: dict[str, str] = {}
