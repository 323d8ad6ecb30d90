"""Token ids of whole texts, by the tokenizers library, inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct words a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Longer stretches are encoded each time they come, not remembered.
LONGEST = 100
#: Bytes of texts whose words are looked up at a time.
PORTION = 8 << 20

#: The byte-to-character table of byte-level vocabularies (a public format):
#: printable characters stand for themselves, the others follow from U+0100.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))
}


class WordIds(dict):
    """From a stretch of text without white space to its ids, as bytes.

    The vocabulary's pattern never matches across white space and its
    normaliser works on characters, so the ids of a text are the ids of its
    stretches one after another, and a stretch is encoded once for all its
    occurrences. Stretches that are normal already skip the library's
    normaliser, which would only lower their letters; the merges are always the
    library's.
    Stretches with a special token's text, or with a character that Python's tables
    do not name, go through the library whole.

    ``of_texts`` looks up each distinct word of many texts once, and of words of
    Latin letters with marks behind them only the distinct heads.
    """

    #: The vocabulary's own split pattern.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Letters that Python lowers by their place in a word, and the library doesn't.
    LOWERED_BY_PLACE = re.compile("\u03a3")
    ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    #: Two pieces at most, normal in any text: all code points are below U+0300.
    PLAIN = r"^(?P<head>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.added)) or "(?!)").search
        self.pieces: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        whole = np.arange(size, dtype="<u4").tobytes()
        self.written = [whole[i : i + 4] for i in range(0, len(whole), 4)]

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii()
        if self.special(word) or not plain and self.unknown(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes()
        elif plain and word.isprintable():
            found = self.joined(self.ASCII_PIECES.findall(word.lower()))
        elif is_normalized("NFC", word) and not self.LOWERED_BY_PLACE.search(word):
            found = self.joined(self.PIECES.findall(word.lower()))
        else:
            found = self.joined(self.PIECES.findall(self.normalizer.normalize_str(word)))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self[""] = b""
            self[word] = found
        return found

    @staticmethod
    def unknown(word: str) -> bool:
        """Whether a character may be newer than Python's tables, which the library's
        may know."""
        return not word.isascii() and any(category(c) == "Cn" for c in word)

    def joined(self, pieces: list[str]) -> bytes:
        return self.piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.piece, pieces))

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            coded = piece if piece.isascii() and piece.isprintable() else _coded(piece)
            found = b"".join([self.written[token.id] for token in self.model.tokenize(coded)])
            if len(piece) <= LONGEST:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, flat.split(" ")))

    def of_words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, as bytes."""
        parts = pc.extract_regex(words, self.PLAIN)
        plain = parts.is_valid()
        for token in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, token)))
        parts = parts.filter(plain)
        heads = pc.utf8_lower(parts.field("head")).dictionary_encode()
        tails = parts.field("tail").dictionary_encode()
        known = pa.array(list(map(self.piece, _strings(heads.dictionary))), pa.large_binary())
        marks = [self.piece(tail) if tail else b"" for tail in _strings(tails.dictionary)]
        marks = pa.array(marks, pa.large_binary())
        joined = pc.binary_join_element_wise(
            known.take(heads.indices), marks.take(tails.indices), pa.scalar(b"", pa.large_binary())
        )
        others = list(map(self.__getitem__, _strings(words.filter(pc.invert(plain)))))
        first = plain.to_numpy(zero_copy_only=False)
        place = np.where(first, np.cumsum(first) - 1, len(joined) + np.cumsum(~first) - 1)
        return pa.concat_arrays([joined, pa.array(others, pa.large_binary())]).take(pa.array(place))

    def of_texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each portion of the texts the ids, one text's after another's, and each
        text's number of ids; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + PORTION, "right")))
            words = pc.ascii_split_whitespace(texts.slice(start, end - start))
            distinct = words.flatten().dictionary_encode()
            found = self.of_words(distinct.dictionary).take(distinct.indices)
            ends = np.cumsum(np.r_[0, pc.binary_length(found).to_numpy()]) // 4
            at = ends[words.offsets.to_numpy()]
            yield np.frombuffer(found.buffers()[2] or b"", "<u4", int(at[-1])), np.diff(at)
            start = end


def _strings(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _coded(piece: str) -> str:
    return piece.encode("utf-8").decode("latin-1").translate(BYTE_CHARS)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own encoder of the vocabulary file; loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch one by one; a null is an empty text."""
    for value in batch.column(column):
        yield value.as_py() or ""
