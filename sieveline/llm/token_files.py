"""Documents as token ids in ORC files, written and read back stripe by stripe.

Ids are stored as integers with run-length encoding, with a row index and a Bloom filter on the document id, so a reader can
take stripes in parallel and skip those that cannot hold an id. Files are in ascending order of the ids; each row
carries its file's number and its place among the ids of that file, so its place in the whole is known from one sum
per file, without sorting again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from sieveline.llm.common import partitions, small
from sieveline.sources.shared import written

_SPACES = re.compile(r"[ \t\n\r]+")
#: Lower case within Latin-1, and its lower-case letters.
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")
_PLAIN = re.compile("[a-zß-öø-ÿ]+".encode("latin-1")).fullmatch
_LONGEST_KEPT = 64
_FILE_SCHEMA = "doc_id long, file int, place long, n_tokens long, tokens array<int>"


def _words_only(encoder: Tokenizer) -> Tokenizer | None:
    """The same model for lower-case Latin-1 letters and spaces alone, without the passes that change nothing in these.

    None where the tokenizer heeds case or the place of stops, or marks the ends of words in no way that tells them apart.
    """
    def ids(text: str) -> list[int]:
        return encoder.encode(text, add_special_tokens=False).ids

    letters = [chr(i) for i in range(256) if _PLAIN(bytes([i]))]
    if ids("One, twÖ. Three") != [i for word in ("one", ",", "twö", ".", "three") for i in ids(word)]:
        return None
    parts = json.loads(encoder.to_str())
    byte_level = [p for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "ByteLevel"]
    parts |= {"normalizer": None, "added_tokens": [], "post_processor": None,
              "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *byte_level]}}
    plain = Tokenizer.from_str(json.dumps(parts))
    suffix = parts["model"].get("end_of_word_suffix")
    words = letters + [a + b for a in letters for b in "aeiouérstn"] + ["straße", "naïveté", "ÿþð".lower()]
    found = [e.ids for e in plain.encode_batch_fast(words, add_special_tokens=False)]
    same = found == [e.ids for e in encoder.encode_batch_fast(words, add_special_tokens=False)]
    return plain if suffix and same and all(plain.id_to_token(f[-1]).endswith(suffix) for f in found) else None


class WordIds:
    """The ids of texts as bytes (little-endian, 32 bits each), by the library, with those of a bounded number of words kept.

    The tokenizer must treat the words between spaces, tabs, line and page ends by themselves, as those do that drop white space.
    """

    def __init__(self, tokenizer: str, most: int):
        self.encoder, self.most = Tokenizer.from_file(tokenizer), most
        self.special = [t.content.encode("latin-1", "ignore").translate(_LOWER) for t in self.encoder.get_added_tokens_decoder().values()]
        self.stops = {s: np.array(self.encoder.encode(s.decode(), add_special_tokens=False).ids, "<u4").tobytes() for s in (b".", b",")}
        self.plain = _words_only(self.encoder)
        if self.plain:
            suffix = self.plain.model.end_of_word_suffix
            vocabulary = self.plain.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.kept: dict[bytes | str, bytes] = {"": b""}

    def words(self, text: str) -> list[bytes] | list[str]:
        """The words of a text; as lower-case Latin-1 bytes where that changes no id."""
        if self.plain:
            try:
                low = text.encode("latin-1").translate(_LOWER)
            except UnicodeEncodeError:
                return _SPACES.split(text)
            if not any(token in low for token in self.special):
                return low.split()
        return _SPACES.split(text)

    def _learn(self, new: list[bytes | str]) -> None:
        """Keep the ids of new words.

        Words of letters alone are encoded some in one text and told apart by the ends of words. A stop or comma after
        letters has ids of its own.
        """
        kept, letters, stopped, others = self.kept, [], [], []
        for word in new:
            if isinstance(word, str):
                others.append(word)
            elif _PLAIN(word):
                letters.append(word)
            elif word[-1:] in (b".", b",") and _PLAIN(word[:-1]):
                stopped.append(word)
            else:
                others.append(word)
        bare = {word[:-1] for word in stopped}.difference(kept, letters)
        letters += bare
        if letters:
            lines = [b" ".join(letters[i:i + 20]).decode("latin-1") for i in range(0, len(letters), 20)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)])
            data, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(letters):
                raise ValueError("ends of words do not tell the words apart")
            kept.update((word, data[a:b]) for word, a, b in zip(letters, [0, *stops], stops, strict=False))
        for word in stopped:
            kept[word] = kept[word[:-1]] + self.stops[word[-1:]]
        for word in bare:
            del kept[word]
        texts = [word if isinstance(word, str) else word.decode("latin-1") for word in others]
        for word, found in zip(others, self.encoder.encode_batch_fast(texts, add_special_tokens=False)):
            kept[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words that are not kept are encoded once for all texts."""
        cut = [self.words(t) for t in texts]
        new = list(set().union(*cut).difference(self.kept))
        self._learn(new)
        rows = [b"".join(map(self.kept.__getitem__, words)) for words in cut]
        if len(self.kept) > self.most:
            self.kept = {"": b""}
        else:
            for word in new:
                if len(word) > _LONGEST_KEPT:
                    del self.kept[word]
        return rows


@lru_cache(1)
def word_ids(tokenizer: str, most: int) -> WordIds:
    """One for all tasks of a Python worker, which Spark uses again. Tasks are the threads, so the library needs none of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(tokenizer, most)


def check_tokenizer(tokenizer: str) -> None:
    """Refuse a tokenizer that does not treat words by themselves."""
    encoder = Tokenizer.from_file(tokenizer)
    words = ["Don't", "stop!!", "naïve", "x1-2y", "ΟΔΟΣ", "<|endoftext|>", "é"]
    for mark in (" ", "\t", "\n", "\r", "\x0b", "\x0c", "  \n\t "):
        whole = encoder.encode(mark + mark.join(words) + mark, add_special_tokens=False).ids
        if whole != [i for w in words for i in encoder.encode(w, add_special_tokens=False).ids]:
            raise ValueError(f"{tokenizer}: ids of a text are not those of its words")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id",
                 text: str = "text", cached: int = 400_000, stripe_bytes: int = 32 << 20, index_rows: int = 1000) -> None:
    """Write every row of `docs` as its token ids and `end_id`, in ascending order of the ids (NULL first).

    A NULL text counts as empty: one row with the end id alone. Rows with equal ids are ordered by a hash of the text;
    equal rows stay, one after another. Other columns are not read.
    """
    check_tokenizer(tokenizer)
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, file, place = word_ids(tokenizer, cached), TaskContext.get().partitionId(), 0
        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, len(whole), 200)):
            rows = [row + end for row in ids.encode([t or "" for t in batch.column(1).to_pylist()])]
            bounds = np.zeros(len(rows) + 1, np.int64)
            np.cumsum([len(r) // 4 for r in rows], out=bounds[1:])
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(rows), file, np.int32)), pa.array(place + bounds[:-1]), pa.array(np.diff(bounds)), tokens],
                ["doc_id", "file", "place", "n_tokens", "tokens"])
            place += int(bounds[-1])

    order = ["doc_id", "text_hash"]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    (rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(partitions(spark), *order)
     .sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, _FILE_SCHEMA)
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows).option("compression", "zstd")
     .orc(folder))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files. A filter on doc_id skips the stripes and row groups that cannot hold it."""
    return spark.read.schema(_FILE_SCHEMA).orc(folder)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """file, first: how many ids stand in the files before. One row per file."""
    ends = read_tokens(spark, folder).groupBy("file").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all rows before), n_tokens (with the end id), ids_crc32, for every row of the files."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            bounds = tokens.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    rows = (read_tokens(spark, folder).select("doc_id", "file", "place", "tokens")
            .mapInArrow(digest, "doc_id long, file int, place long, n_tokens long, ids_crc32 long"))
    return (rows.join(small(written(file_starts(spark, folder))), "file")
            .select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"))
