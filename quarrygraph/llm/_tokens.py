"""Exact, cached word-BPE encoding for batches of texts inside a Python worker."""

from __future__ import annotations

import unicodedata
from array import array

import regex

from quarrygraph.llm._frames import hold

#: The tokenizer's own split rule, as its file states it (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Control characters, capital sigma and dotted I, added tokens and rarer scripts go through the library as whole texts.
PLAIN = regex.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9fΣİ  Ⰰ-\U0010ffff]|<\|")
#: Entries of either cache; both stop growing there, so a worker's memory is bounded.
CACHE = 300_000


def default_vocabulary() -> str:
    """Path of the public vocabulary file; looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None) -> "WordBpe":
    """One encoder per worker process, until another operator's task comes."""
    path = path or default_vocabulary()
    return hold(("word-bpe", path), lambda: WordBpe(path))


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level BPE, by its published rule."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(moved)) for b in range(256)]


class WordBpe:
    """``ids(text)`` equals ``encode(text, add_special_tokens=False).ids`` as little-endian uint32 bytes.

    The vocabulary's rules never cross white space, so a text's ids are those of its words in turn.
    Words and then their pieces are looked up in bounded caches; only unseen pieces reach the merge
    table.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            letters = piece if piece.isascii() else "".join(map(self._letters.__getitem__, piece.encode()))
            found = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
            if len(self._pieces) < CACHE:
                self._pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        normal = word if word.isascii() else unicodedata.normalize("NFC", word)
        found = b"".join(map(self._piece, PIECES.findall(normal.lower())))
        if len(self._words) < CACHE:
            self._words[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if PLAIN.search(text):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        get, make = self._words.get, self._word
        return b"".join([get(w) or make(w) for w in text.split()])
