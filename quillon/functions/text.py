"""String expressions: projections of raw records, prompts, and cleaning of generated ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns that results depend on.
STOP_MARKERS = ("</s>", "<|endoftext|>", "<|im_end|>", "<|im_start|>")
THINK_OPEN = "<think>"
# The bars are alternations here, so the text after a thought ends at the first "<", "im_end", ">" or "</s>".
THINK_TAIL = r"(?s)</think>\s*(.*?)(?:<|im_end|>|</s>|$)"
SEMANTIC_TOKEN = r"<\|d\d+_\d+\|>"
TOKEN_START = "<|d"
QUESTION_PREFIX = "question: "
CHAT_TURN = "<|im_start|>{role}\n{content}<|im_end|>\n"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space (as Unicode has it) at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def without(text: Column, parts: tuple[str, ...]) -> Column:
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return text


def clean_docid(raw: Column) -> Column:
    """The id in a generated string.

    In this order: strip, drop stop markers, keep what follows a closed thought,
    then the semantic tokens joined by spaces; without any, the stripped text, or
    for ids of another kind the text without token delimiters.
    """
    bare = without(strip(raw), STOP_MARKERS)
    after = F.when(bare.contains(THINK_OPEN) & bare.rlike(THINK_TAIL), strip(F.regexp_extract(bare, THINK_TAIL, 1))).otherwise(bare)
    tokens = F.regexp_extract_all(after, F.lit(SEMANTIC_TOKEN), F.lit(0))
    return F.when(after.contains(TOKEN_START), F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(strip(after))).otherwise(strip(without(after, ("<|", "|>"))))


def document_text(text: Column) -> Column:
    """The second ``:``-separated part, as items of the question-answering kind carry it; null without a colon."""
    return F.get(F.split(text, ":"), F.lit(1))


def embedding_text(kind: str, text: Column, description: Column | None = None) -> Column:
    """The text to embed, by the kind of data set: ``amazon`` (checked first) or ``NQ`` as part of its name."""
    if "amazon" in kind:
        return description
    if "NQ" in kind:
        return document_text(text)
    raise ValueError(f"no text projection for data set {kind!r}")


def question(text: Column) -> Column:
    """The form in which evaluation asks a question."""
    return F.concat(F.lit(QUESTION_PREFIX), text)


def chat_prompt(text: Column) -> Column:
    """A user turn and an opened assistant turn."""
    return F.concat(F.lit("<|im_start|>user\n"), text, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def words(text: Column) -> Column:
    """Lower-cased words between white space; empty array for none."""
    return F.filter(F.split(F.lower(strip(text)), r"(?U)\s+"), lambda w: w != "")
