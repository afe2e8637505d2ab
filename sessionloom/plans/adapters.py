"""Star-schema tables as captured events, so that the operators run on any warehouse's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources that the event types of the `events` table stand for.
SOURCE_OF_TYPE = {"click": "codex_exec", "view": "claude_code_history", "purchase": "gemini_cli_history", "error": "codex_history"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as envelopes: an actor is a user, a session a user's day, an item type the event type."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    source = F.lit("codex_sdk")
    for kind, name in SOURCE_OF_TYPE.items():
        source = F.when(F.col("event_type") == kind, name).otherwise(source)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), source.alias("source"), F.lit("repo").alias("repo_id"), user.alias("actor_id"), F.concat(user, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.when(F.col("event_type") != "error", F.concat(user, F.lit(":"), F.col("event_type"))).alias("thread_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("event_type"), F.col("props").alias("payload_json"),
        F.lit("unavailable").alias("reasoning_availability"), F.col("event_id").alias("arrival_seq"), "value",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as events of a session, ordered by turn: users prompt, assistants answer, the system reasons."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("arrival_seq"), F.format_string("%06d", "turn").alias("ts"), role.alias("actor_id"), F.col("text"),
        (role == "user").alias("is_prompt"), (role == "system").alias("is_thought"), (role == "assistant").alias("is_answer"),
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` with `part` as file changes: a session is an order, a path a part's brand, a kind the return flag."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    kind = F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "delete").otherwise("update")
    return table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("session_id"), F.col("p_brand").alias("path"), kind.alias("kind"), F.lit("").alias("ts"), F.col("l_linenumber").cast("long").alias("arrival_seq"), F.lit(0).alias("position"))


def order_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as prompts: a session is a customer, a prompt an order, an actor the order's priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("prompt_id"), F.col("o_orderpriority").alias("actor_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"))
