"""Token counts without token ids in the result: each distinct pre-token is encoded once.

1. A scan cuts texts into pre-tokens and sends each chunk's distinct ones, packed
   by hash bucket.
2. A bucket's task encodes every distinct pre-token once and returns, to each
   chunk, the numbers of pieces in the order in which they were sent.
3. A second scan cuts the texts again, counts each document's pre-tokens, joins
   the frequencies to the numbers and sums the products.

Neither texts nor frequencies are shuffled, and a pre-token that every document
has is sent once per chunk.

A SentencePiece BPE model merges inside pre-tokens only if no piece spans their
borders.  ``Splitter`` proves that from the vocabulary: borders are in front of
runs of spaces if no piece has a space after another character, and around line
feeds if no piece holds one next to anything.  Where a model gives no such proof,
the whole text is one pre-token, which is slower and still right.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: The library's mark for a space.
SPACE = "▁"
#: Pre-tokens encoded at a time, characters of a text cut at a time, distinct pre-tokens of a chunk, bytes of text behind a bucket.
FEW = 4096
PART = 1_000_000
CHUNK = 300_000
BUCKET_BYTES = 32 << 20


class Splitter:
    """Cuts a text into pre-tokens, and counts the pieces of pre-tokens."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        normal = [p.piece for p in proto.pieces if p.type == 1]
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap and not proto.trainer_spec.treat_whitespace_as_suffix
        # BPE, and no piece that is matched before the merges
        self.exact = plain and proto.trainer_spec.model_type == 2 and 4 not in kinds and proto.trainer_spec.byte_fallback and not any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and p != "\n") for p in normal)
        # the sign in front keeps the library from adding its space to a pre-token that has none
        self.sign = len(self.library.encode("\n"))

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens that together are the text as the library sees it."""
        if not text:
            return
        if not self.exact:
            yield [text]
            return
        text = " " + text.replace(SPACE, " ")
        at = 0
        while len(text) - at > PART and (cut := _BORDER.search(text, at + PART)):
            yield _PRE_TOKEN.findall(text[at : cut.start()])
            at = cut.start()
        yield _PRE_TOKEN.findall(text[at:])

    def pieces(self, tokens: list[str]) -> np.ndarray:
        """How many pieces each pre-token has; the ids of a few are made at a time, only to be counted."""
        out = np.empty(len(tokens), np.int32)
        for at in range(0, len(tokens), FEW):
            few = tokens[at : at + FEW]
            if self.exact:
                out[at : at + FEW] = [len(x) - self.sign for x in self.library.encode(["\n" + t for t in few], num_threads=1)]
            else:
                out[at : at + FEW] = [len(x) for x in self.library.encode(few, num_threads=1)]
        return out


#: A line feed, or spaces and what follows them, or spaces alone.
_PRE_TOKEN = re.compile("\n| *[^ \n]+| +")
_BORDER = re.compile("\n|(?<! ) ")


@lru_cache(maxsize=2)
def splitter(model: str) -> Splitter:
    return Splitter(model)


def _checksum(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


class Sent(dict):
    """The distinct pre-tokens of a chunk, by bucket in the order of their first use."""

    def __init__(self, n: int):
        self.n, self.lists = n, {}

    def __missing__(self, token: str) -> int:
        self.lists.setdefault(_checksum(token) % self.n, []).append(token)
        self[token] = 0
        return 0


class Known(dict):
    """The same, with the numbers of pieces that came back, each beside its pre-token's checksum."""

    def __init__(self, n: int, back: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.n, self.back = n, {b: iter(zip(x.tolist(), y.tolist(), strict=True)) for b, (x, y) in back.items()}

    def __missing__(self, token: str) -> int:
        checksum = _checksum(token)
        found, sent = next(self.back.get(checksum % self.n, iter(())), (0, -1))
        if sent != checksum & 0xFFFF:
            raise RuntimeError("the input was dealt out anew between two scans; write it before this operator")
        self[token] = found
        return found


def _send(model: str, n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, chunk, s, sent = TaskContext.get().partitionId(), 0, splitter(model), Sent(n)

        def rows() -> pa.RecordBatch:
            full = sorted(sent.lists)
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([pid] * len(full), pa.int64()), pa.array([chunk] * len(full), pa.int64()), pa.array([sent.lists[b] for b in full], pa.list_(pa.string()))], names=["bucket", "pid", "chunk", "tokens"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                for part in s.parts(text or ""):
                    _touch(sent, part)
                    if len(sent) >= CHUNK:
                        yield rows()
                        chunk, sent = chunk + 1, Sent(n)
        yield rows()

    return scan


def _touch(known: dict, part: list[str]) -> None:
    """Look up all in the order of the text, so that both scans meet new ones in the same order."""
    deque(map(known.__getitem__, part), maxlen=0)


def _encode(model: str):
    def count(t: pa.Table) -> pa.Table:
        lists = t.column("tokens").to_pylist()
        distinct = list(dict.fromkeys(x for tokens in lists for x in tokens))
        pieces = dict(zip(distinct, splitter(model).pieces(distinct).tolist(), strict=True))
        back = [np.array([pieces[x] for x in tokens], np.int32).tobytes() for tokens in lists]
        marks = [np.array([_checksum(x) & 0xFFFF for x in tokens], np.uint16).tobytes() for tokens in lists]
        return pa.table({"pid": t.column("pid"), "chunk": t.column("chunk"), "bucket": t.column("bucket"), "pieces": pa.array(back, pa.binary()), "marks": pa.array(marks, pa.binary())})

    return count


def _sum(model: str, n: int, back_dir: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, side = splitter(model), shared.read_side(back_dir, TaskContext.get().partitionId())
        back: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        if side is not None:
            for chunk, bucket, pieces, marks in zip(*(side.column(c).to_pylist() for c in ("chunk", "bucket", "pieces", "marks")), strict=True):
                back.setdefault(chunk, {})[bucket] = np.frombuffer(pieces, np.int32), np.frombuffer(marks, np.uint16)
        chunk = 0
        known = Known(n, back.pop(0, {}))
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for part in s.parts(text or ""):
                    frequency = Counter(part)  # keeps the order of first use
                    totals[i] += sum(map(operator.mul, frequency.values(), map(known.__getitem__, frequency)))
                    if len(known) >= CHUNK:
                        chunk += 1
                        known = Known(n, back.pop(chunk, {}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals)], names=["doc_id", "n_bytes", "n_tokens"])

    return scan


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the SentencePiece model at this path gives them.

    No begin, end or added special tokens; strings that look like special tokens
    are ordinary text; nothing is cut off or padded.  Returns doc_id, n_bytes
    (UTF-8), n_tokens.

    Defined cases: null and empty texts have no bytes and no tokens; repeated rows
    and ids are counted one by one; rows without id keep a null id; an empty table
    gives no rows; other columns of the input are ignored.  The model's file has to
    be at the same path on all machines.  The input has to give the same rows in the
    same partitions each time it is read, as files do; else an error is raised.
    """
    spark = df.sparkSession
    shared.prepare(spark)
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    n = 1 + (rows.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES
    back_dir = shared.work_dir(spark, "pieces")
    sent = rows.mapInArrow(_send(model, n), "bucket long, pid long, chunk long, tokens array<string>")
    shared.write_side(sent.groupBy("bucket").applyInArrow(_encode(model), "pid long, chunk long, bucket long, pieces binary, marks binary"), back_dir)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_sum(model, n, back_dir), f"doc_id {id_type}, n_bytes long, n_tokens long")
