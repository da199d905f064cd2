"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased, everything but letters becomes one space, and n-grams of one to three characters are counted
over the whole text. Its most frequent n-grams, in order, are compared to those of each language: an n-gram costs the
distance between its two places, or the profile's length if the language's profile lacks it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.llm.common import held_out

PROFILE = 300
_BITS = 21  # a code point; three of them fill an n-gram's 63 bits


@lru_cache(2)
def _letters(kinds: str) -> np.ndarray:
    """For each code point whether it is of these general categories: L are letters, M marks on them."""
    return np.fromiter((unicodedata.category(chr(i))[0] in kinds for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str | None) -> np.ndarray:
    """The n-grams of a text as integers, repeats included; none if it has no letter (marks alone are none)."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    if not _letters("L")[points].any():
        return np.empty(0, np.int64)
    points = np.concatenate([[32], np.where(_letters("LM")[points], points, 32), [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    two = points[:-1] << _BITS | points[1:]
    return np.concatenate([points[points != 32], two, two[:-1] << _BITS | points[2:]])


def top_grams(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by code."""
    grams, counts = np.unique(codes, return_counts=True)
    if len(grams) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:most]


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language from all rows of `docs` with a language.

    Each task sums the n-grams of its rows, so what is shuffled grows with the alphabet, and the driver gets `most`
    n-grams per language. Ties by code. Rows without a text or a language teach nothing.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(name: str) -> None:
            grams, counts = np.unique(np.concatenate(held.pop(name)), return_counts=True)
            if name in sums:
                grams, place = np.unique(np.concatenate([sums[name][0], grams]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([sums[name][1], counts])).astype(np.int64)
            sums[name] = grams, counts

        for batch in batches:
            waiting: dict[str, int] = {}
            for name, value in zip(batch.column(0), batch.column(1)):
                codes = gram_codes(value.as_py())
                name = name.as_py()
                held.setdefault(name, []).append(codes)
                waiting[name] = waiting.get(name, 0) + len(codes)
                if waiting[name] > 2_000_000:
                    fold(name)
                    waiting[name] = 0
            for name in list(held):
                fold(name)
        for name, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                                             ["lang", "gram", "n"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = (docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
            .where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("place", rank).where(F.col("place") <= most)
            .orderBy("lang", "place").collect())
    profiles: dict[str, list[int]] = {}
    for row in rows:
        profiles.setdefault(row.lang, []).append(row.gram)
    return {name: np.array(grams, np.int64) for name, grams in sorted(profiles.items())}


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], id_column: str = "doc_id", text: str = "text",
                      most: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`, from whole texts.

    score is 1 less the out-of-place distance as a share of the largest possible one. Ties go to the language that
    sorts first. `und` with score 0 where the text is NULL, empty or without a letter, or nothing was learned.
    """
    names = list(profiles)
    flat = np.concatenate([*profiles.values(), np.empty(0, np.int64)])
    sorted_grams, column = np.unique(flat, return_inverse=True)
    places = np.full((len(names), len(sorted_grams)), -1, np.int64)
    at = 0
    for i, grams in enumerate(profiles.values()):
        places[i, column[at:at + len(grams)]] = np.arange(len(grams))
        at += len(grams)

    def best(text: str | None) -> tuple[str, float]:
        grams = top_grams(gram_codes(text), most)
        if not len(grams) or not names:
            return "und", 0.0
        spot = np.minimum(np.searchsorted(sorted_grams, grams), len(sorted_grams) - 1)
        place = np.where(sorted_grams[spot] == grams, places[:, spot], -1)
        distances = np.where(place < 0, most, np.abs(place - np.arange(len(grams)))).sum(axis=1)
        chosen = int(distances.argmin())
        return names[chosen], 1.0 - float(distances[chosen]) / (most * len(grams))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")

