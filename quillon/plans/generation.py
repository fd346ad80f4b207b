"""From questions to ranked ids: prompts, scores, constrained search, cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.docids import semantic_docid
from ..functions.text import chat_prompt, clean_docid
from ..operators import beam
from ..operators.chat import EOS


def generate_ids(questions: DataFrame, trie: DataFrame, scorer: Callable[[DataFrame], DataFrame], levels: int, num_beams: int = beam.NUM_BEAMS, codes: int | None = None) -> DataFrame:
    """(query, rank, text, doc_id, score) of (query, text) questions.

    scorer: maps (query, prompt) rows to a scorer table of ``beam.search``; language
    models live outside.  ``text`` is what was generated, with its end mark; ``doc_id``
    is the id cleaned from it.
    """
    asked = questions.select("query", chat_prompt(F.col("text")).alias("prompt"))
    found = beam.search(asked.select("query"), trie, scorer(asked), levels, num_beams, query_id="query", codes=codes)
    text = F.concat(semantic_docid(F.col("ids")), F.lit(EOS))
    return found.select("query", "rank", text.alias("text"), clean_docid(text).alias("doc_id"), "score")
