"""Encoding with the tokenizers library, memoised by word."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Texts in which a space does not surely begin a pre-token, or which may hold a special token, are encoded whole.
_WHOLE = re.compile(r" (?:\s|\Z)|<\|")
#: Words of other characters, on whose classes two regular expression libraries might differ, go to the library as they are.
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-\xac\xae-\u024f]*")
#: The usual word: letters, then perhaps punctuation; these are its two pre-tokens.
_USUAL = re.compile(r"(\x20?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)")
_LONG_WORD = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Values made on demand; emptied when it holds `entries`. Long keys aren't kept."""

    def __init__(self, make: Callable[[str], bytes], entries: int) -> None:
        self._make, self._entries = make, entries

    def __missing__(self, key: str) -> bytes:
        value = self._make(key)
        if len(key) <= _LONG_WORD:
            if len(self) >= self._entries:
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Ids of texts by a byte-level BPE tokenizer, as little-endian unsigned 32-bit bytes.

    A byte-level pre-tokenizer always cuts before a space that a non-space follows, and merges never cross a cut.
    So a text's ids are those of its words between such spaces, and frequent words are encoded once. Each of the two memos, of
    words and of pre-tokens, holds at most `entries`.
    """

    def __init__(self, path: str | None = None, entries: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._library = Tokenizer.from_file(path or default_path())
        self._tokens = self._library.model.tokenize
        self._cut = regex.compile(public_tokenizers.PATTERN).findall
        self._letters = {i: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0] for i in range(128)}
        self._letters |= {i: self._high(i) for i in range(128, 256)}
        self._words = _Memo(lambda x: self._word(f" {x}"), entries)
        self._parts = _Memo(self._part, entries // 2)

    @staticmethod
    def _high(byte: int) -> str:
        """The letter that byte-level models use for a byte above 127: itself if printable in Latin-1, else one from U+0100 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(byte) if byte in plain else chr(256 + [x for x in range(256) if x not in plain].index(byte))

    def _whole(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        if text.isascii() and text.isprintable() and " " not in text[1:]:
            mapped = text.replace(" ", "\u0120")
        else:
            mapped = text.encode().decode("latin-1").translate(self._letters)
        return array("I", [x.id for x in self._tokens(mapped)]).tobytes()

    def _word(self, text: str) -> bytes:
        if usual := _USUAL.fullmatch(text):
            return self._parts[usual[1]] + self._parts[usual[2]] if usual[2] else self._part(text)
        if _PLAIN.fullmatch(text):
            return b"".join(map(self._parts.__getitem__, self._cut(text)))
        return self._whole(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _WHOLE.search(text):
            return self._whole(text)
        head, *tail = text.split(" ")
        return self._word(head) + b"".join(map(self._words.__getitem__, tail))


@lru_cache(4)
def encoder(path: str | None = None, entries: int = 1_000_000) -> WordEncoder:
    """This process's encoder; Python workers that are used again keep their memos."""
    return WordEncoder(path, entries)
