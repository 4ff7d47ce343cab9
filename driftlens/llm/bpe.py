"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that are not yet known are laid out as one flat array of symbols. Each round
looks every adjacent pair up in the sorted pair keys by binary search, takes the lowest-ranked pair
of each word, and merges its occurrences in all words at once; words without a mergeable pair drop
out. Finished words are kept in a bounded per-process table.

Defined results: a null text is encoded as the empty text, with no ids; texts are read whole; the
special token's string becomes its id, as the tokenizer file defines it; equal texts get equal ids;
extra columns are never read. The tokenizer file is a parameter and must exist on every machine.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import held, slices, tidy

#: Fixed by the byte-level pre-tokenizer: contractions, letters, numbers, other symbols, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of Latin characters only, in the quicker standard engine.
LATIN_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Latin letters, ASCII and common punctuation: characters on which both patterns agree.
LATIN_ONLY = r"[\t\n\r -~À-ÖØ-öø-ſ‘-„–—…]*"
KNOWN_WORDS = 600_000
NO_RANK = np.int64(1) << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Merges:
    """Merge tables of one tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbol_byte = {c: b for b, c in enumerate(byte_symbols())}
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(merges))[order], made[order]
        size = max(vocab.values()) + 1 + len(spec["added_tokens"])
        self.piece: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(symbol_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.piece[i] = content.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each (non-empty) word."""
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            usable = (self.keys[slot] == key) & (word[:-1] == word[1:])
            rank = np.where(usable, self.rank[slot], NO_RANK)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            # the last symbol of a word starts no pair; give it a neutral rank so reduceat has a slot for each word
            best = np.minimum.reduceat(np.append(rank, NO_RANK), first)
            live = np.repeat(best < NO_RANK, np.diff(np.append(first, len(ids))))
            if not live.all():
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                if not live.any():
                    break
                pair_live = live[:-1]
                # a dropped word's pairs go with it; pairs across words are unusable anyway
                rank, slot = rank[pair_live], slot[pair_live]
                ids, word = ids[live], word[live]
                if len(rank) == len(ids):  # the final symbol was dropped, so the last kept pair starts at the new final symbol
                    rank, slot = rank[:-1], slot[:-1]
                best = best[best < NO_RANK]
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(best, np.diff(np.append(first, len(ids))))[:-1]
            take = rank == lowest
            take &= rank < NO_RANK
            # of overlapping occurrences (a a a) the leftmost wins: keep every other one of a run
            at = np.flatnonzero(take)
            if len(at) > 1:
                adjacent = np.concatenate([[False], at[1:] == at[:-1] + 1])
                run_start = np.maximum.accumulate(np.where(adjacent, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            ids = ids.copy()
            ids[at] = self.made[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return []
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])


class Coder:
    """Encoder and decoder with a bounded table of finished words."""

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        self.any_split = regex.compile(PATTERN).findall
        self.latin_split = re.compile(LATIN_PATTERN).findall
        self.latin = re.compile(LATIN_ONLY).fullmatch
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.latin_split(text) if self.latin(text) else self.any_split(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token stands for itself, marked by a leading NUL pair."""
        if not self.merges.split_special or "<|" not in text:
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.merges.split_special.split(text)):
            if i % 2:
                out.append("\0\0" + part)
            elif part:
                out += self.split(part)
        return out

    def _learn(self, split: list[list[str]]) -> None:
        """Encode unknown words; the table starts anew when it is full."""
        fresh = set(filterfalse(self.known.__contains__, chain.from_iterable(split)))
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known, fresh = {}, set(chain.from_iterable(split))
        plain = []
        for w in fresh:
            if w.startswith("\0\0") and w[2:] in self.merges.special:
                self.known[w] = np.array([self.merges.special[w[2:]]], np.uint32).tobytes()
            else:
                plain.append(w)
        if plain:
            for w, ids in zip(plain, self.merges.encode_words([w.encode() for w in plain]), strict=True):
                self.known[w] = ids.astype(np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids (uint32) of each text."""
        split = [self.words(t) for t in texts]
        self._learn(split)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.uint32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; invalid UTF-8 becomes replacement characters."""
        return b"".join(map(self.merges.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")


def coder(path: str) -> Coder:
    """This worker's coder; it goes when a task of another operator starts."""
    return held(path, lambda: Coder(path))


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids (array<int>) of every document."""
    schema = documents.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            ids = coder(path).encode([t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=schema.names)

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, holds=path), schema)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text decoded from them."""
    schema = documents.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            numbers, ids_hash, text_hash = [], [], []
            for ids in coder(path).encode([t or "" for t in batch.column("text").to_pylist()]):
                numbers.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                text_hash.append(hashlib.sha256(coder(path).decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(tidy(run, holds=path), schema)
