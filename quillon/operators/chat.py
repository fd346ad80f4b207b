"""Chat records: projection, role normalisation, masks and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

# Role names and the kinds that stand for them.
ROLES = {"assistant": "assistant", "gpt": "assistant", "model": "assistant", "user": "user", "human": "user", "system": "system"}
EOS = "<|im_end|>"
SEQUENCE_LENGTHS = {"chat": 2048, "nq": 8192, "amazon": 1024, "msmarco": 2048}


def to_chat(df: DataFrame, text: str = "text", answer: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Two-turn records: the text asks, the id answers; with the columns to keep."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))
    return df.select(*keep, F.array(turn("user", text), turn("assistant", answer)).alias("conversations"))


def question_and_answer(df: DataFrame) -> DataFrame:
    """Add ``question`` and ``golden`` from flat rows, or from the first two turns of chat rows."""
    chat = F.col("conversations")
    return df.withColumns({"question": F.when(chat.isNull(), F.col("text")).otherwise(chat[0]["content"]), "golden": F.when(chat.isNull(), F.col("doc_id")).otherwise(chat[1]["content"])})


def normal_role(role: Column) -> Column:
    """The standard name of a role; null for unknown ones."""
    return F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[role]


def train_mask(role: Column) -> Column:
    """Whether a turn is trained on: the assistant's are."""
    return F.coalesce(normal_role(role) == "assistant", F.lit(False))


def rendered_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit(EOS + "\n"))


def render(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(by, turns, rendered): each conversation as one string, turns in order."""
    each = F.struct(F.col(order).alias("o"), rendered_turn(normal_role(F.col(role)), F.col(content)).alias("s"))
    grouped = turns.groupBy(by).agg(F.array_sort(F.collect_list(each)).alias("all"))
    return grouped.select(by, F.size("all").alias("turns"), F.array_join(F.transform("all", lambda x: x["s"]), "").alias("rendered"))


def within_length(turns: DataFrame, limit: int, by: str = "conv_id", content: str = "text") -> DataFrame:
    """(by, n_words) of conversations of at most ``limit`` words."""
    return turns.groupBy(by).agg(F.sum(F.coalesce(F.size(words(F.col(content))), F.lit(0))).alias("n_words")).where(F.col("n_words") <= limit)


def first_exchange(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(by, question, answer): the first user and assistant turns, where a system turn may come first."""
    name = normal_role(F.col(role))
    first = lambda who: F.min_by(F.when(name == who, F.col(content)), F.when(name == who, F.col(order)))
    return turns.groupBy(by).agg(first("user").alias("question"), first("assistant").alias("answer"))
