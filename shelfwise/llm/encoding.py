"""Token ids of whole texts from a public tokenizer whose tokens never cross white space.

The ids of a text are those of its words, one after the other, so each task encodes a
word once, with the tokenizer's own BPE model, and keeps its ids as bytes in a
bounded table. A text of Latin letters is lower-cased and split into words in one
pass; other texts go by white-space chunks, and chunks beyond Latin letters through
the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

#: A task's table starts anew at so many chunks and drops those not met again by the next time; longer chunks are not kept.
KEPT_CHUNKS, KEPT_LENGTH = 400_000, 64

#: The word pattern of the tokenizer (a fixed value of its file), for chunks without white space.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_ASCII_PLAIN = re.compile(r"[!-~]+")
_LATIN_PLAIN = re.compile("[!-~¡-ɏ]+")
#: A text of Latin letters, their numbers and marks, and white space: its words are found in one pass.
_LATIN_TEXT = re.compile("[ \t\n\r\f\v!-~¡-ɏ]*")


def _latin_words() -> re.Pattern:
    """The word pattern for lower-cased Latin text, its classes by the categories of U+0021..U+024F (and what they become in lower case)."""
    text = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]))
    own = sorted(set(text + text.lower()))
    letters = re.escape("".join(c for c in own if unicodedata.category(c)[0] == "L"))
    numbers = re.escape("".join(c for c in own if unicodedata.category(c)[0] == "N"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^ \t\n\r\f\v{letters}{numbers}]+")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _chunks(text: str) -> list[str]:
    for space in "\n\t\r\f\v":
        text = text.replace(space, " ")
    return text.split(" ")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 up."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """word -> its ids as bytes, filled on demand."""

    def __init__(self, model) -> None:
        self._model = model
        self._letters = _byte_letters()
        self._older: dict[str, bytes] = {}

    def trim(self) -> None:
        if len(self) > KEPT_CHUNKS:
            self._older = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if word in self._older:
            ids = self[word] = self._older[word]
            return ids
        known = word if word.isascii() else "".join(map(self._letters.__getitem__, word.encode()))
        ids = array("I", [t.id for t in self._model.tokenize(known)]).tobytes()
        if len(word) <= KEPT_LENGTH:
            self[word] = ids
        return ids


class _ChunkIds(dict):
    """chunk without white space -> its ids as bytes, filled on demand."""

    def __init__(self, tokenizer) -> None:
        import regex

        self._tokenizer = tokenizer
        self._words = _Words(tokenizer.model)
        self._older: dict[str, bytes] = {}
        self._text_words = _latin_words()
        self._latin_words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __missing__(self, chunk: str) -> bytes:
        if chunk in self._older:
            ids = self._older[chunk]
        elif _ASCII_PLAIN.fullmatch(chunk):
            ids = b"".join(map(self._words.__getitem__, _ASCII_WORDS.findall(chunk.lower())))
        elif _LATIN_PLAIN.fullmatch(chunk):
            # of these letters none is composed by NFC, so lower case is all that the normaliser does
            ids = b"".join(map(self._words.__getitem__, self._latin_words.findall(chunk.lower())))
        else:
            ids = array("I", self._tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= KEPT_LENGTH:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if _LATIN_TEXT.fullmatch(text):
            return b"".join(map(self._words.__getitem__, self._text_words.findall(text.lower())))
        return b"".join(map(self.__getitem__, _chunks(text)))

    def trim(self) -> None:
        if len(self) > KEPT_CHUNKS:
            self._older = dict(self)
            self.clear()
        self._words.trim()


class ChunkEncoder:
    """Encodes texts to unsigned 32-bit ids (machine order, little-endian here), without special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._ids = _ChunkIds(tokenizer)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        known = self._ids
        for text in texts:
            known.trim()
            yield known.of(text or "")
