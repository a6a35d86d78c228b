"""Token ids of whole texts, by the tokenizers library, with a bounded word cache."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Letters, numbers and white space of Latin-1 by Unicode's categories L, N and White_Space.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: Fixed value: the byte-level split, as the tokenizer file's pre-tokenizer defines it, over Latin-1.
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Words that a worker's cache holds; it is emptied when full, which changes no result.
CACHE_WORDS = 250_000


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


#: For each Latin-1 character, its UTF-8 bytes in the byte alphabet.
LATIN_TO_BYTES = {c: "".join(byte_alphabet()[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer encodes each word of its split by itself, so the ids of a text are those of its words in
    order. Texts in Latin-1 without an added token are split here, and each distinct word is encoded by the library
    once; every other text, and every other kind of tokenizer, goes to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = []
        split: list[list[str]] = []
        for text in texts:
            text = text or ""
            fast = self.by_word and not any(a in text for a in self.added)
            if fast:
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    fast = False
            out.append(None if fast else self.whole(text))
            if fast:
                split.append(LATIN_WORDS.findall(text))
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = self.words
        missing = [w for w in set().union(*split) if w not in words] if split else []
        merge = self.tokenizer.model.tokenize
        for w in missing:
            words[w] = np.array([t.id for t in merge(w.translate(LATIN_TO_BYTES))], dtype="<u4").tobytes()
        get, at = words.__getitem__, iter(split)
        return [b"".join(map(get, next(at))) if x is None else x for x in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)
