"""Ids of texts by a byte-level tokenizer of the tokenizers library, with those of a bounded number of words kept.

Such a tokenizer cuts a text by a pattern in which a space before a word belongs to it, and merges bytes within the cuts only. So a
space after anything but white space starts a stretch whose ids do not depend on what stands before. Each batch of texts is cut
there, its different stretches are looked up once, and those not met before are cut by the pattern and encoded, plain
words many in one text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_CUT = re.compile(r"(?<=\S) ")
#: A space after white space, in the words of Arrow's patterns.
_CROWDED = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: The library's pattern for texts within Latin-1: letters, numbers and white space as Unicode has them there.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_LATIN = re.compile(r"[\x00-\xff]*").fullmatch
_LONGEST_KEPT, TOGETHER = 64, 50


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each row has."""
    return np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4


class ByteIds:
    """`encode` gives the ids of texts, whatever is kept."""

    def __init__(self, tokenizer: str, most: int):
        self.encoder, self.most = Tokenizer.from_file(tokenizer), most
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        parts = json.loads(self.encoder.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if parts["normalizer"] is not None or {k: (parts["pre_tokenizer"] or {}).get(k) for k in plain} != plain:
            raise ValueError(f"{tokenizer} is not a plain byte-level tokenizer")
        # Of words of letters, each after a space, the first id of a word, and no other, stands for a piece with the mark of a space.
        vocabulary = self.encoder.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.stops = dict(zip(".,?!:;", self._library(list(".,?!:;"))))
        self.kept: dict[str, bytes] = {}  # by the stretch without the space before it
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, new: list[str]) -> None:
        """Keep the ids of words of Latin-1 letters after a space."""
        if not new:
            return
        lines = [" " + " ".join(new[i:i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
        ids, _ = _joined(self._library(lines))
        data, starts = ids.tobytes(), (4 * np.flatnonzero(self.starts[ids])).tolist()
        if len(starts) != len(new):
            raise ValueError("marks of spaces do not tell the words apart")
        self.words.update((word, data[a:b]) for word, a, b in zip(new, starts, [*starts[1:], len(data)]))

    def _of_parts(self, texts: list[str]) -> list[bytes]:
        """The ids of texts within Latin-1, by their parts."""
        cut = [_PARTS.findall(t) for t in texts]
        every = set().union(*cut)
        rest = [p for p in every if p[0] != " " or not p[1:].isalpha()]
        words = every.difference(rest)
        self._learn_words([w for p in words if (w := p[1:]) not in self.words])
        ids = dict(zip(rest, self._library(rest)))
        ids.update((p, self.words[p[1:]]) for p in words)
        return [b"".join([ids[p] for p in parts]) for parts in cut]

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of stretches, given without the space before them."""
        words, stopped, others, odd = [], [], [], []
        for s in new:
            if not s.isascii() and not _LATIN(s):
                odd.append(s)
            elif s.isalpha():
                words.append(s)
            elif s[-1:] in self.stops and s[:-1].isalpha():
                stopped.append(s)
            else:
                others.append(s)
        bare = [s[:-1] for s in stopped]
        self._learn_words(list({*words, *bare}.difference(self.words)))
        known, kept = self.words, self.kept
        kept.update(zip(words, map(known.__getitem__, words)))
        for s, w in zip(stopped, bare):
            kept[s] = known[w] + self.stops[s[-1]]
        kept.update(zip(others, self._of_parts([" " + s for s in others])))
        kept.update(zip(odd, self._library([" " + s for s in odd])))

    def _looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches without the space before them, and how many each has."""
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.kept.get, different))
        new = [s for s, ids in zip(different, found) if ids is None]
        if new:
            self._learn(new)
            found = list(map(self.kept.get, different))
        ids, size = _joined(found)
        if len(self.kept) + len(self.words) > self.most:
            self.kept, self.words = {}, {}
        else:
            for s in new:
                if len(s) > _LONGEST_KEPT:
                    self.kept.pop(s, None)
                    self.words.pop(s, None)
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[which]
        first = (np.cumsum(size) - size)[which]
        ends = np.cumsum(sizes)
        return ids[np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], sizes

    def _first(self, texts: list[str]) -> list[bytes]:
        """The ids of stretches at the start of a text."""
        latin = [s if s.isascii() or _LATIN(s) else "" for s in texts]
        return [ids if s or not t else self._library([t])[0] for s, t, ids in zip(latin, texts, self._of_parts(latin))]

    def _stretched(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts in which any space starts a stretch."""
        lists = pc.split_pattern(texts, " ")
        bounds, pieces = lists.offsets.to_numpy(), lists.flatten()
        bounds = bounds - bounds[0]
        firsts = pieces.take(pa.array(bounds[:-1])).to_pylist()
        before = self._first(firsts)
        later = np.ones(len(pieces), bool)
        later[bounds[:-1]] = False
        ids, sizes = self._looked_up(pieces.filter(pa.array(later)))
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds - np.arange(len(bounds))]
        return [b + ids[i:j].tobytes() for b, i, j in zip(before, ends[:-1], ends[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as bytes (little-endian, 32 bits each)."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        crowded = pc.match_substring_regex(texts, _CROWDED).to_numpy(zero_copy_only=False) & ~special
        found: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(special).tolist():
            found[i] = self._library([texts[i].as_py()])[0]
        if crowded.any():
            # Cut where a space starts a stretch, and put together again after they are encoded one by one.
            where = np.flatnonzero(crowded).tolist()
            cut = [_CUT.split(texts[i].as_py()) for i in where]
            ids, sizes = self._looked_up(pa.array([s for c in cut for s in c[1:]], pa.string()))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            for i, first, n in zip(where, self._first([c[0] for c in cut]), map(len, cut)):
                found[i] = first + ids[ends[at]:ends[at + n - 1]].tobytes()
                at += n - 1
        usual = np.flatnonzero(~(special | crowded))
        for i, row in zip(usual.tolist(), self._stretched(texts.take(pa.array(usual)))):
            found[i] = row
        return found


@lru_cache(1)
def byte_ids(tokenizer: str, most: int) -> ByteIds:
    """One for all tasks of a Python worker, which Spark uses again. Tasks are the threads, so the library needs none of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteIds(tokenizer, most)
