"""Pre-tokens of the byte-level vocabularies, found once for each word that recurs."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Collection

import public_tokenizers
import regex

#: White space as the tokenizers have it; str.split() has four control characters more.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space but for its last character (all of it at the end), a word with the space before it, or another
#: single white space character.  A pre-token lies in one of these, and none looks past the end of its own.
_CUT = re.compile(f"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]")
#: The public pattern for texts of ASCII alone, where its classes are these.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Bytes of words and results that one worker keeps between batches, by an estimate of what an entry takes beside its
#: own, and the length beyond which a word is forgotten after its batch.
CACHE_BYTES, ENTRY_BYTES, LONG = 96 << 20, 160, 64


@functools.cache
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def pre_tokens(text: str) -> list[str]:
    return _ASCII.findall(text) if text.isascii() else pattern().findall(text)


class Words(dict):
    """word -> its result (bytes) by ``make_many``, which gets all unknown words of a batch at once.

    What is kept between batches is bounded in bytes: beyond ``most`` all is forgotten, and long words always are.
    """

    def __init__(self, make_many: Callable[[list[str]], list[bytes]], most: int = CACHE_BYTES):
        super().__init__()
        self.make_many, self.most, self.bytes, self.long = make_many, most, 0, []

    def of(self, texts: list[list[str]]) -> None:
        """From now until the next call, every word of ``texts`` is a key."""
        self.learn(set().union(*texts))

    def learn(self, words: Collection[str]) -> None:
        """The same for words that are distinct."""
        for w in self.long:
            self.pop(w, None)
        unknown = [w for w in words if w not in self]
        if self.bytes > self.most:
            self.clear()
            self.bytes, unknown = 0, list(words)
        found = self.make_many(unknown)
        self.update(zip(unknown, found, strict=True))
        self.long = [w for w in unknown if len(w) > LONG]
        self.bytes += sum(map(len, unknown)) + sum(map(len, found)) + ENTRY_BYTES * len(unknown)


def chunks(text: str) -> list[str]:
    """Pieces whose pre-tokens, one piece after another, are those of ``text``: words, and runs of white space."""
    return _CUT.findall(text)
