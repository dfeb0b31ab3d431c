"""Operator 3: BPE encoding and decoding, long texts by tree concatenation.

A text longer than ``LEAF`` characters is not scanned from end to end. It is cut at fixed places into leaves, halves
of halves, whatever stands there; the leaves of a batch are encoded together, in parallel by the library; and
neighbours are joined level by level. At a join, a window around the cut is encoded again. It grows until a token of
the window lies exactly on a token of the left side and another exactly on a token of the right side (same id, same
span, character boundary before it); the left side up to the first, the window, and the right side from the second
are then the ids of the joined text.

Why that is exact. Ids of a word are right when every two adjacent ids are what BPE makes of their own bytes, and the
word pattern reads no further back than the start of a match. Each adjacent pair of the result stands next to each
other in one of three right encodings (left, window, right), since the two anchors belong to two of them each. A
window that has grown over both sides is the text itself.

The leaves of all texts of a batch are encoded together, and so are the windows of a level. Pieces of plain characters
share a table of words met before (ids, and the characters that each covers), and each new word goes to the library once;
the other pieces go to the library in one call, which uses several threads once ``THREADED`` characters are there; below
that, tasks are parallel enough and threads would only wait for each other. Texts of one leaf have nothing to join.

Characters are normalised once over the whole text by the library's normaliser (composition, white space, lower case),
because a cut must not fall between characters that it would join. Strings of special tokens are found before that,
as the library does, and are not cut. Decoding gives the library's decode; of a long list of ids the parts are decoded
and joined by the space that the library puts between tokens when a tokenizer has no decoder.

Defined cases: null text counts as empty: no ids, an empty decoded text; repeated rows are rows of the result each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import documents, held, slices, whole_text
from .tokens import ALPHABET, LETTERS, NUMBERS

LEAF = 2048
WINDOW = 48
#: Ids that are decoded in one call.
DECODED = 1 << 16
#: Characters of long texts in a batch from which the library's threads are used.
THREADED = 1 << 20
#: Words kept at most; when more come, the table starts anew.
KEPT_WORDS = 400_000
#: The pattern of words, within the range of characters where both libraries' classes agree.
PLAIN = re.compile(r"[\t\n\r -~¡-¬®-įı-ɏ]*")
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
END_OF_WORD = "</w>"

Span = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, starts, ends, in characters of the whole text


class TreeBPE:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        self.leaf, self.window = leaf, window
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        bare = spec | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        for t in (self.whole, self.bare):
            t.no_truncation()
            t.no_padding()
        special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.joins_by_space = self.whole.decoder is None
        #: merges alone, for words that are cut and spelt in the byte-level alphabet already
        self.merger = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": None}))
        self.merger.no_truncation()
        self.merger.no_padding()
        self.is_end = np.zeros(self.whole.get_vocab_size(), bool)
        self.token_bytes = np.zeros(self.whole.get_vocab_size(), np.int64)
        for token, i in self.whole.get_vocab().items():
            self.is_end[i] = token.endswith(END_OF_WORD)
            self.token_bytes[i] = len(token.removesuffix(END_OF_WORD))
        #: of a word, for each id: the id, and where in the word its characters begin and end
        self.words: dict[str, bytes] | None = {} if spec["model"].get("end_of_word_suffix") == END_OF_WORD else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: those of one leaf as they are, all others by tree concatenation."""
        out: list = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.leaf]
        plain = [i for i in short if self.words is not None and PLAIN.fullmatch(texts[i]) and not (self.special and self.special.search(texts[i]))]
        for i, ids in zip(plain, self._by_words([WORD.findall(texts[i].lower()) for i in plain]), strict=True):
            out[i] = ids
        rest = [i for i in short if out[i] is None]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int64)
        long = [i for i in range(len(texts)) if out[i] is None]
        sections: list[tuple[int, str]] = []
        known: dict[int, list] = {i: [] for i in long}
        for i in long:
            for k, part in enumerate(self.special.split(texts[i]) if self.special else [texts[i]]):
                if k % 2:
                    known[i].append(np.array([self.whole.token_to_id(part)]))
                elif part:
                    known[i].append(len(sections))
                    sections.append((i, self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part))
        encoded = self._trees([s for _, s in sections])
        for i in long:
            out[i] = np.concatenate([np.zeros(0, np.int64), *(encoded[p] if isinstance(p, int) else p for p in known[i])])
        return out

    def _learn(self, lists: list[list[str]]) -> None:
        new = list(set().union(*lists).difference(self.words))
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words = {}
            new = list(set().union(*lists))
        if not new:
            return
        # plain text has no zero byte; the byte-level alphabet has a character for each byte
        spelt = "\0".join(new).encode().decode("latin-1").translate(ALPHABET).split(ALPHABET[0])
        (e,) = self.merger.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        lasts = np.nonzero(self.is_end[ids])[0] + 1
        firsts = np.concatenate([[0], lasts[:-1]])
        ends = np.cumsum(self.token_bytes[ids])
        before = np.repeat(np.concatenate([[0], ends[lasts[:-1] - 1]]), lasts - firsts)
        triples = np.stack([ids, ends - self.token_bytes[ids] - before, ends - before], axis=1).astype("<i4")
        whole = triples.tobytes()
        for word, cut, a, b in zip(new, spelt, firsts.tolist(), lasts.tolist(), strict=True):
            if len(cut) == len(word):
                self.words[word] = whole[12 * a : 12 * b]
            else:  # characters of several bytes: a token covers all that it has a byte of
                character = np.repeat(np.arange(len(word), dtype="<i4"), [len(c.encode()) for c in word])
                own = triples[a:b]
                self.words[word] = np.stack([own[:, 0], character[own[:, 1]], character[own[:, 2] - 1] + np.int32(1)], axis=1).tobytes()

    def _by_words(self, lists: list[list[str]]) -> list[np.ndarray]:
        self._learn(lists)
        known = self.words
        return [np.frombuffer(b"".join([known[w] for w in words]), "<i4")[::3].astype(np.int64) for words in lists]

    def _spans(self, parts: list[tuple[str, int]]) -> list[Span]:
        """Encodings of pieces of text that begin at the given characters."""
        out: list = [None] * len(parts)
        plain = [k for k, (p, _) in enumerate(parts) if self.words is not None and PLAIN.fullmatch(p)]
        lists = [WORD.findall(parts[k][0]) for k in plain]
        if plain:
            self._learn(lists)
        for k, words in zip(plain, lists, strict=True):
            known = [self.words[w] for w in words]
            found = np.frombuffer(b"".join(known), "<i4").reshape(-1, 3).astype(np.int64)
            # the words are all that is no white space, one after another
            solid = np.nonzero(np.frombuffer(parts[k][0].encode("utf-32-le"), "<u4") > 32)[0]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            first = np.repeat(solid[np.cumsum(sizes) - sizes] + parts[k][1], np.fromiter(map(len, known), np.int64, len(known)) // 12)
            out[k] = found[:, 0], found[:, 1] + first, found[:, 2] + first
        rest = [k for k in range(len(parts)) if out[k] is None]
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if sum(len(parts[k][0]) for k in rest) >= THREADED else "false"
        for k, e in zip(rest, self.bare.encode_batch([parts[k][0] for k in rest], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2) + parts[k][1]
            out[k] = np.array(e.ids, np.int64), offsets[:, 0], offsets[:, 1]
        return out

    def _trees(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [list(range(0, max(1, len(t)), self.leaf)) for t in texts]
        leaves = iter(self._spans([(t[a : a + self.leaf], a) for t, at in zip(texts, cuts, strict=True) for a in at]))
        level = [[(a, min(a + self.leaf, len(t)), next(leaves)) for a in at] for t, at in zip(texts, cuts, strict=True)]
        while any(len(nodes) > 1 for nodes in level):
            pairs = [(k, j) for k, nodes in enumerate(level) for j in range(0, len(nodes) - 1, 2)]
            joined = dict(zip(pairs, self._join([(texts[k], level[k][j], level[k][j + 1]) for k, j in pairs]), strict=True))
            level = [[joined.get((k, j)) or nodes[j] for j in range(0, len(nodes), 2)] for k, nodes in enumerate(level)]
        return [nodes[0][2][0] for nodes in level]

    def _join(self, pairs: list[tuple]) -> list[tuple]:
        """Join neighbours; the windows of all joins of a level are encoded together, and those that don't agree grow."""
        out: list = [None] * len(pairs)
        waiting, width = list(range(len(pairs))), self.window
        while waiting:
            bounds = [(max(pairs[p][1][0], pairs[p][1][1] - width), min(pairs[p][2][1], pairs[p][1][1] + width)) for p in waiting]
            windows = self._spans([(pairs[p][0][a:b], a) for p, (a, b) in zip(waiting, bounds, strict=True)])
            still = []
            for p, (a, b), w in zip(waiting, bounds, windows, strict=True):
                _, (from_, cut, left), (_, to, right) = pairs[p]
                i = self._anchor(left, w, a, cut, first=True) if a > from_ else (0, 0)
                j = self._anchor(right, w, cut, b, first=False) if b < to else (len(right[0]), len(w[0]))
                if i is None or j is None:
                    still.append(p)
                    continue
                out[p] = (from_, to, tuple(np.concatenate([x[: i[0]], y[i[1] : j[1]], z[j[0] :]]) for x, y, z in zip(left, w, right, strict=True)))
            waiting, width = still, width * 2
        return out

    @staticmethod
    def _anchor(side: Span, window: Span, low: int, high: int, first: bool) -> tuple[int, int] | None:
        """Places in ``side`` and ``window`` of the first (or last) token with the same id and span in [low, high]."""

        def between(s: Span) -> dict[tuple[int, int, int], int]:
            ids, starts, ends = s
            a, b = np.searchsorted(starts, low, "left"), np.searchsorted(starts, high, "right")
            clean = np.ones(len(ids), bool)
            clean[1:] = ends[:-1] <= starts[1:]  # begins where a character does
            return {(int(starts[k]), int(ends[k]), int(ids[k])): int(k) for k in range(a, b) if clean[k] and ends[k] <= high}

        ours, theirs = between(side), between(window)
        both = ours.keys() & theirs.keys()
        if not both:
            return None
        at = min(both) if first else max(both)
        return ours[at], theirs[at]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        parts, owner = [], []
        for i, x in enumerate(ids):
            step = DECODED if self.joins_by_space else max(1, len(x))
            for a in range(0, max(1, len(x)), step):
                parts.append(x[a : a + step].tolist())
                owner.append(i)
        texts: list[list[str]] = [[] for _ in ids]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for i, t in zip(owner, self.whole.decode_batch(parts, skip_special_tokens=False), strict=True):
            texts[i].append(t)
        return [" ".join(t) for t in texts]


def tree_bpe(path: str) -> TreeBPE:
    """A Python worker's encoder."""
    return held(("tree_bpe", path), lambda: TreeBPE(path))


def encode_decode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text and, if asked to ``keep``, ids and decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path)
        # the numbers as text, for the digest of the ids
        names = np.array([str(i) for i in range(bpe.whole.get_vocab_size())], object)
        for batch in slices(batches):
            ids = bpe.encode(batch.column("text").to_pylist())
            decoded = bpe.decode(ids)
            columns = [
                batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(" ".join(names[x].tolist()).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
            ]
            if keep:
                columns += [pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return whole_text(docs).mapInArrow(run, schema)


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
