"""Token ids of whole texts with the tokenizers library, encoding each distinct word once in a while."""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: Between two characters that are not white space, a space always starts a new pre-token.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: White space other than space and new line; in ASCII, and all.
_ASCII_BLANKS = [chr(c) for c in range(128) if chr(c).isspace() and chr(c) not in " \n"]
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
#: Punctuation that ends most words; no apostrophe, which may begin a pre-token of letters.
_MARKS = ".,!?;:$#%&*()-"
#: The characters that byte-level vocabularies write for the 256 bytes (printable ones stand for themselves).
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_LEVEL = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


def _odd(text: str) -> bool:
    """Whether a text's white space is more than single spaces and one or two new lines between words: it is cut by _SAFE alone."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[:1].isspace() or text[-1:].isspace():
        return True
    return any(c in text for c in (_ASCII_BLANKS if text.isascii() else _BLANKS))


class _Known(dict):
    """Ids of stretches; a new one is encoded when it is asked for."""

    def __init__(self, encode):
        self.encode = encode
        super().__init__({"": b""})

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.encode(part)
        return ids


class Encoder:
    """ids(text) as uint16 or uint32 bytes. `spaces_matter`: False if the tokenizer drops white space.

    Strings of special tokens in a text get their ids, as the library gives them by default; with ordinary=True they are
    ordinary text. Pre-tokens never reach over a cut made here, so the ids of a text are those of its stretches put
    together. About `keep` stretches of each kind are remembered. A new one goes through the tokenizer's own normaliser,
    pre-tokenizer and model. Most are a word of Latin letters, perhaps with marks after it, whose pre-tokens are plain:
    these skip the first two, which take most of the time, and words and marks are remembered apart.
    """

    def __init__(self, path: str, spaces_matter: bool, ordinary: bool = False, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        self.special = added
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.normalizer, self.pre_tokenizer, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.spaces_matter, self.keep = spaces_matter, keep
        self.plain, self.spaced = _Known(self._fresh), _Known(self._spaced)
        self.lead = "\u0120" if spaces_matter else ""

    def _model(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _spaced(self, word: str) -> bytes:
        """Of a word after a space; of one that begins with a new line, instead of that."""
        if word.isalpha():
            if word.isascii():
                return self._model(self.lead + (word if self.spaces_matter else word.lower()))
            if max(word) < "\u0100":
                word = word if self.spaces_matter else word.lower()
                return self._model(self.lead + "".join([_LEVEL[b] for b in word.encode()]))
        elif word[0] == "\n":
            return self.plain["\n"] + self.plain[word[1:]]
        else:
            bare = word.rstrip(_MARKS)
            if bare.isalpha() and max(bare) < "\u0100":
                return self.spaced[bare] + self.plain[word[len(bare) :]]
        return self._fresh(" " + word if self.spaces_matter else word)

    def _fresh(self, part: str) -> bytes:
        if self.normalizer is not None:
            part = self.normalizer.normalize_str(part)
        return b"".join([self._model(piece) for piece, _ in self.pre_tokenizer.pre_tokenize_str(part)])

    def _ids(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not self.spaces_matter:
            return b"".join(map(self.spaced.__getitem__, text.replace("\n", " ").split(" ")))
        if _odd(text):
            return b"".join(map(self.plain.__getitem__, _SAFE.split(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([self.plain[first], *map(self.spaced.__getitem__, rest)])

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        for known in (self.plain, self.spaced):
            if len(known) > self.keep:
                known.clear()
                known[""] = b""
        gc.disable()  # nothing made here is cyclic, and it is much
        try:
            return [self._ids(t) for t in texts]
        finally:
            gc.enable()


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaces_matter: bool, ordinary: bool = False) -> Encoder:
    """One for each Python worker, kept from task to task."""
    key = (path, spaces_matter, ordinary)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
