"""Token ids of texts by a public tokenizer's file, word by word.

The vocabulary's tokenizer folds case and composition, parts a text into words and drops white space; each word is
tokenized by itself. So words are looked up: a task asks the tokenizer for each distinct word once. That holds for
text of printable ASCII and Latin-1 letters, whose case and composition are plain; any stretch with other characters, or
with what may be a special token, goes through the whole tokenizer as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

#: Words a task remembers at most, before it begins anew.
HELD_WORDS = 1 << 19
#: Long texts are taken in stretches of about so many characters.
STRETCH = 1 << 20

#: Fixed: how the word vocabularies of this kind part lower-cased text, here for the characters that are looked up.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-`{-~×÷]+")
_OTHER = re.compile(r"[^ \n!-~À-ÿ]|<\|")


class WordIds(dict):
    """word -> its ids as bytes (unsigned 32-bit, little-endian), filled as words are asked for."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        plain = word if word.isascii() else self._bytes.pre_tokenize_str(word)[0][0]
        self[word] = out = np.array([t.id for t in self.whole.model.tokenize(plain)], "<u4").tobytes()
        return out

    def _stretch(self, text: str) -> bytes:
        if _OTHER.search(text):
            parts = text.replace("\n", " ").split(" ")
            return b"".join(self._by_whole(x) if _OTHER.search(x) else self._by_word(x) for x in parts)
        return self._by_word(text)

    def _by_word(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _WORD.findall(text.lower())))

    def _by_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """All ids of a text, without special tokens around it."""
        if len(self) > HELD_WORDS:
            self.clear()
        return b"".join(map(self._stretch, _stretches(text)))


def _stretches(text: str) -> Iterator[str]:
    """A text cut where a space or line break stands; a longer stretch without any stays whole."""
    at = 0
    while len(text) - at > STRETCH:
        ends = [x for x in (text.find(" ", at + STRETCH), text.find("\n", at + STRETCH)) if x >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]
