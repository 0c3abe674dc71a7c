"""Chat logs: one JSON object per line, parsed with built-in JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,text:string,thinking:string>>"
DROPPED = ("progress", "system", "file-history-snapshot", "queue-operation", "summary")


def line_text(line: Column) -> Column:
    """Text of a chat line: its content string, or its text and thinking blocks joined by newlines."""
    content = F.get_json_object(line, "$.message.content")
    blocks = F.from_json(content, BLOCKS)
    parts = F.filter(F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"])), lambda t: t.isNotNull() & (t != ""))
    return F.when(content.startswith("["), F.array_join(parts, "\n")).otherwise(content)


def line_role(line: Column) -> Column:
    """``user`` or ``assistant`` by the line's type; null for lines that are no turn."""
    kind = F.get_json_object(line, "$.type")
    return F.when(kind.isin("user", "assistant"), kind)


def skill_name(text: Column) -> Column:
    """Last folder of a skill announcement; null for other texts."""
    hit = F.regexp_extract(text, r"^Base directory for this skill: \S*/([^/\s]+)", 1)
    return F.when(hit != "", hit)


def chat_chunks(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with text, role, timestamp and skill of every turn that has a text."""
    c = F.col(line)
    rows = lines.select("*", line_text(c).alias("text"), line_role(c).alias("role"), F.get_json_object(c, "$.timestamp").alias("timestamp"))
    return rows.filter("role is not null and text <> ''").withColumn("skill", skill_name(F.col("text")))


def transcript(lines: DataFrame, line: str = "line", tools: bool = False, thinking: bool = False, sidechain: bool = False) -> DataFrame:
    """Blocks of a chat, filtered by kind, one row per block."""
    c = F.col(line)
    blocks = F.from_json(F.get_json_object(c, "$.message.content"), BLOCKS)
    rows = lines.select("*", F.coalesce(F.get_json_object(c, "$.isSidechain"), F.lit("false")).alias("side"), F.posexplode_outer(blocks).alias("at", "b"))
    kinds = ["text"] + (["tool_use", "tool_result"] if tools else []) + (["thinking"] if thinking else [])
    rows = rows.filter(F.col("b.type").isin(*kinds))
    rows = rows if sidechain else rows.filter("side <> 'true'")
    return rows.withColumn("body", F.coalesce("b.text", "b.thinking")).drop("b", "side")


def session_logs(paths: DataFrame, sessions: list[str]) -> DataFrame:
    """Paths of the JSON-lines logs of the given sessions."""
    hit = F.lit(False)
    for s in sessions:
        hit = hit | F.col("path").endswith(f"{s}.jsonl")
    return paths.filter(hit)
