"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

A SentencePiece BPE model whose pieces hold a space mark only at their start never merges across the start of a run
of spaces, and a line end that is in no piece is a token of its own. So the count of a text is the sum over its
pre-tokens (a run of spaces and what follows it up to the next space or line end). Lengths of the pre-tokens that are frequent in
the corpus are broadcast; others are encoded once per worker and kept in a bounded cache. Neither tier changes a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

_PIECES = re.compile(r" *[^ \n]+| +|\n")
_LONGEST_KEPT = 64


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the space that the model puts before it. The space mark itself counts as a space."""
    return _PIECES.findall(" " + text.replace("▁", " ")) if text else []


class Lengths(dict):
    """Tokens per pre-token: the frequent ones, and a bounded number of others as they come."""

    def __init__(self, model: str, frequent: dict[str, int], most: int):
        super().__init__(frequent)
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        self.frequent, self.most = frequent, len(frequent) + most

    def __missing__(self, piece: str) -> int:
        if piece == "\n":
            length = 1
        elif piece[0] == " ":
            length = len(self.encoder.encode(piece[1:])) if len(piece) > 1 else 1
        else:  # after a line end: the model's own space and the line end are two tokens
            length = len(self.encoder.encode("\n" + piece)) - 2
        if len(piece) <= _LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[piece] = length
        return length


def check_model(model: str) -> None:
    """Refuse a model for which counts by pre-token would be wrong."""
    encoder = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [encoder.id_to_piece(i) for i in range(encoder.get_piece_size()) if not encoder.is_byte(i)]
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or encoder.encode("a  b ") == encoder.encode("a b"):
        raise ValueError(f"{model}: pieces cross spaces or line ends, so texts can't be counted by pre-token")


def frequent_lengths(docs: DataFrame, model: str, text: str, share: float, most: int) -> dict[str, int]:
    """Lengths of at most `most` pre-tokens, each at least `share` of the pre-tokens of some partition.

    Partitions count their own pre-tokens and send on those frequent there: at most 1 / share rows each.
    """
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for value in batch.column(0):
                if (value := value.as_py()) is not None:
                    found = pre_tokens(value)
                    counts.update(found)
                    total += len(found)
            if len(counts) > 20 / share:
                counts = Counter({k: n for k, n in counts.items() if n >= share * total / 4})
        chosen = [(k, n) for k, n in counts.items() if n > 1 and n >= share * total and len(k) <= _LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in chosen], pa.string()), pa.array([n for _, n in chosen], pa.int64())], ["piece", "n"])

    found = (docs.select(F.col(text).cast("string").alias("text")).mapInArrow(heads, "piece string, n long")
             .groupBy("piece").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "piece").limit(most).select("piece").collect())
    lengths = Lengths(model, {}, most)
    return {row.piece: lengths[row.piece] for row in found}


def count_tokens(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", limit: int = 4096,
                 share: float = 5e-5, frequent: int = 50_000, cached: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than `limit`) for every row of `docs`, whole texts.

    A NULL text counts as empty: 0 bytes, 0 tokens. Ids may be NULL or repeat; each row is counted by itself. Other
    columns are not read. `share`, `frequent` and `cached` bound the two tiers and change no count.
    """
    check_model(model)
    spark = docs.sparkSession
    lengths = spark.sparkContext.broadcast(frequent_lengths(docs, model, text, share, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of = Lengths(model, lengths.value, cached).__getitem__
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([sum(map(length_of, pre_tokens(t.as_py() or ""))) for t in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
