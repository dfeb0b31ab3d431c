"""Byte-level BPE ids of whole texts, by the tokenizers library, with a table of words already encoded.

The library cuts a text into words before it merges, and a word's ids don't depend on its neighbours. So each
distinct word goes to the library once and its ids are kept. Texts whose characters all lie in ``PLAIN``, where the
classes of Python's ``re`` and of the library's pattern are the same, are cut here; every other text, and every text
that holds a special token's string, goes to the library whole.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from .common import held

#: The range in which both patterns' character classes agree, and the word pattern of byte-level BPE.
PLAIN = r"[\t\n\r -~¡-¬®-ɏ]*"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words kept at most; when more come, the table starts anew (about 180 bytes a word).
KEPT_WORDS = 600_000
#: Words of a long text that are held at once.
WORDS_AT_ONCE = 200_000


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable characters of Latin-1 stand for themselves, other bytes for U+0100 onwards."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


ALPHABET = _alphabet()


def _class(kind: str) -> str:
    return "".join(c for c in map(chr, range(0xA1, 0x250)) if unicodedata.category(c)[0] == kind)


LETTERS, NUMBERS = "A-Za-z" + _class("L"), "0-9" + _class("N")
_WORD = re.compile("|".join([*(f"'{c}" for c in CONTRACTIONS), f" ?[{LETTERS}]+", f" ?[{NUMBERS}]+", rf" ?[^\s{LETTERS}{NUMBERS}]+", r"\s+(?!\S)", r"\s+"]))
_PLAIN = re.compile(PLAIN)


class ByteBPE:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        #: the same merges, for words that are cut and spelt in the byte-level alphabet already
        self.merger = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "added_tokens": []}))
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)
        self.kept_words = kept_words
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        odd: list[int] = []
        for i, text in enumerate(texts):
            if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
                odd.append(i)
            elif len(text) > 4 * WORDS_AT_ONCE:
                out[i] = self._encode_long(text)
            else:
                cut.append((i, _WORD.findall(text)))
        self._learn(words for _, words in cut)
        known = self.words
        for i, words in cut:
            out[i] = b"".join([known[w] for w in words])
        if odd:
            for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _encode_long(self, text: str) -> bytes:
        parts, matches = [], (m.group() for m in _WORD.finditer(text))
        while words := list(itertools.islice(matches, WORDS_AT_ONCE)):
            self._learn([words])
            parts.append(b"".join([self.words[w] for w in words]))
        return b"".join(parts)

    def _learn(self, lists) -> None:
        lists = list(lists)
        new = list(set().union(*lists).difference(self.words))
        if len(self.words) + len(new) > self.kept_words:
            self.words = {}
            new = list(set().union(*lists))
        if not new:
            return
        # plain text has no zero byte; the byte-level alphabet has a character for each byte
        cut = "\0".join(new).encode().decode("latin-1").translate(ALPHABET).split(ALPHABET[0])
        (e,) = self.merger.encode_batch_fast([cut], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        # where the bytes of a word end, so do its ids
        word_bytes = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        ends = (np.searchsorted(np.cumsum(self.token_bytes[ids]), word_bytes) + 1) * 4
        ids, start = ids.tobytes(), 0
        for word, end in zip(new, ends.tolist(), strict=True):
            self.words[word] = ids[start:end]
            start = end


def byte_bpe(path: str) -> ByteBPE:
    """A Python worker's encoder."""
    return held(("byte_bpe", path), lambda: ByteBPE(path))
