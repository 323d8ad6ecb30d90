"""Byte-level BPE: encoding in batched numpy merge rounds, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.llm.tokens import BYTE_CHARS, texts

#: Distinct stretches of text a worker remembers; longer ones than LONGEST never.
REMEMBERED, LONGEST = 200_000, 100
#: Symbols merged together, and characters of text taken, at a time.
BLOCK, PORTION = 1 << 18, 1 << 20
NEVER = np.iinfo(np.int64).max


class Merges:
    """A vocabulary file's merges, as sorted pair keys."""

    #: The split pattern of byte-level vocabularies.
    PIECES = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    )
    #: White space around a blank, where splitting before blanks isn't the same.
    WIDE = regex.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary = stored["model"]["vocab"]
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in
                  stored["model"]["merges"]]
        self.special = special
        self.split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len)[::-1])) + ")")
            if special
            else None
        )
        self.size = max(chain(vocabulary.values(), special.values())) + 1
        char_bytes = {c: b for b, c in BYTE_CHARS.items()}
        self.bytes = [b""] * self.size
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(char_bytes[c] for c in token)
        for token, number in special.items():
            self.bytes[number] = token.encode("utf-8")
        self.first = np.array([vocabulary[BYTE_CHARS[b]] for b in range(256)], np.int64)
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.known: dict[str, bytes] = {}  # a stretch with a blank before it
        self.pieces: dict[str, bytes] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NEVER where the pair has no merge."""
        key = left * self.size + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        return np.where(hit, self.ranks[place], NEVER), self.made[place]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 4-byte integers.

        All words are one flat array of symbols. In a round, each word's pairs
        of lowest rank are merged, from left to right where they overlap, all
        words at once; only pairs beside a merge are looked up again. A word
        with no pair left is taken out. Every merge's result has a higher rank
        than the merge, so merging equal pairs together changes nothing.
        """
        found: list[bytes] = [b""] * len(words)
        length = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), length)
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(symbol), NEVER)  # of the pair that starts here
        made = np.zeros(len(symbol), np.int64)
        stale = np.ones(len(symbol), bool)
        while len(symbol):
            inner = np.zeros(len(symbol), bool)
            inner[:-1] = owner[1:] == owner[:-1]
            rank[stale & ~inner] = NEVER
            look = np.flatnonzero(stale & inner)
            rank[look], made[look] = self._lookup(symbol[look], symbol[look + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbol)])
            done = lowest == NEVER
            if done.any():
                packed = symbol.astype("<u4").tobytes()
                for i in np.flatnonzero(done):
                    at = starts[i]
                    found[owner[at]] = packed[4 * at : 4 * (at + sizes[i])]
            chosen = (rank == np.repeat(lowest, sizes)) & (rank != NEVER)
            if chosen.any():
                # a pair of equal symbols may overlap itself: take every other one of a run
                place = np.arange(len(symbol))
                begins = chosen & ~np.r_[False, chosen[:-1]]
                run = np.maximum.accumulate(np.where(begins, place, 0))
                chosen &= (place - run) % 2 == 0
            symbol = np.where(chosen, made, symbol)
            stale = chosen | np.r_[chosen[1:], False]
            keep = ~np.r_[False, chosen[:-1]] & ~np.repeat(done, sizes)
            # the pair before a merged one is the symbol that stays before it
            before = np.r_[False, chosen[:-1]]
            stale |= np.r_[before[1:], False]
            symbol, owner, rank, made, stale = (
                a[keep] for a in (symbol, owner, rank, made, stale)
            )
        return found

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces not met before, in blocks of bounded size."""
        block, size = [], 0
        for number, piece in enumerate(pieces):
            block.append(piece)
            size += len(piece)
            if size >= BLOCK or number + 1 == len(pieces):
                raw = [p.encode("utf-8") for p in block]
                self.pieces.update(zip(block, self.merge(raw), strict=True))
                block, size = [], 0

    def split(self, text: str) -> list[str]:
        """Pieces of a text; special tokens stand alone."""
        if self.split_special is None:
            return self.PIECES.findall(text)
        parts = self.split_special.split(text)
        return list(
            chain.from_iterable(
                [part] if part in self.special else self.PIECES.findall(part) for part in parts
            )
        )

    def encode(self, portion: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian 4-byte integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        for token, number in self.special.items():
            self.pieces[token] = np.array([number], "<u4").tobytes()
        plain: list[list[str] | None] = []  # stretches between blanks
        odd: dict[int, list[str]] = {}  # pieces of texts that can't be split so
        for number, text in enumerate(portion):
            if any(token in text for token in self.special) or self.WIDE.search(text):
                plain.append(None)
                odd[number] = self.split(text)
            else:
                plain.append(text.split(" "))
                odd[number] = self.PIECES.findall(plain[-1][0])
        met = set(chain.from_iterable(p[1:] for p in plain if p))
        new = {word: self.PIECES.findall(" " + word) for word in met.difference(self.known)}
        wanted = set(chain.from_iterable(new.values())).union(*odd.values())
        self.learn(list(wanted.difference(self.pieces)))
        ids = {word: b"".join(map(self.pieces.__getitem__, own)) for word, own in new.items()}
        self.known.update(ids)
        found = []
        for number, words in enumerate(plain):
            head = b"".join(map(self.pieces.__getitem__, odd[number]))
            tail = b"".join(map(self.known.__getitem__, words[1:])) if words else b""
            found.append(head + tail)
        for word in [w for w in ids if len(w) > LONGEST]:
            del self.known[word]
        for piece in [p for p in wanted if len(p) > LONGEST]:
            self.pieces.pop(piece, None)
        return found


_LOADED: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The worker's own merges of the vocabulary file; loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Merges(path)
    return _LOADED[path]


def _portions(values: Iterator[str]) -> Iterator[list[str]]:
    portion, size = [], 0
    for value in values:
        portion.append(value)
        size += len(value)
        if size >= PORTION:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every whole text.

    A special token's string in a text is that token, as in the public
    library. A null or empty text has no ids; repeated rows and null keys stay;
    no rows give no rows. Other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary)
        for batch in batches:
            at = 0
            for portion in _portions(texts(batch, "text")):
                coded = table.encode(portion)
                flat = np.frombuffer(b"".join(coded), "<i4")
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                keys = batch.column("key").slice(at, len(portion))
                at += len(portion)
                yield pa.RecordBatch.from_arrays([keys, ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"{key} {kind}, ids ARRAY<INT>")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """Add ``text``: the ids' bytes as UTF-8, with replacement marks where the
    ids cut a character. Ids out of the vocabulary and nulls give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary)
        known = dict(enumerate(table.bytes))
        for batch in batches:
            # a few documents at a time, as the numbers are wider than the text
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                decoded = [
                    b"".join([known.get(i, b"") for i in ids.values.to_numpy(False).tolist()])
                    .decode("utf-8", "replace")
                    if ids.is_valid
                    else ""
                    for ids in part.column("ids")
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column("ids"), pa.array(decoded, pa.string())],
                    names=[key, "ids", "text"],
                )

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(
        run, f"{key} {kind}, ids ARRAY<INT>, text STRING"
    )


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The digest rows of the query: encoded, then decoded from the ids."""
    both = decode(encode(docs, vocabulary), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
