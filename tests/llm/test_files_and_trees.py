import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webloom.llm import token_files as T
from webloom.llm import tree_bpe


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=12), st.integers(1, 16))
@settings(max_examples=150, deadline=None)
def test_round_trip(docs, block):
    out = io.BytesIO()
    writer = T.PlaneWriter(out, block)
    for k, ids in enumerate(docs):
        writer.add(None if k == 3 else k * 10, np.array(ids, "<u4"))
    writer.close()
    reader = T.PlaneReader(out)
    flat = [x for d in docs for x in d]
    got = list(reader.documents())
    assert [g[2].tolist() for g in got] == docs
    assert [g[0] for g in got] == [None if k == 3 else k * 10 for k in range(len(docs))]
    for a in range(0, len(flat), 5):
        assert reader.ids(a, min(7, len(flat) - a)).tolist() == flat[a : a + 7]


def test_broken_files():
    with pytest.raises(ValueError, match="not a file"):
        T.PlaneReader(io.BytesIO(b"something else entirely, and long enough"))
    out = io.BytesIO()
    writer = T.PlaneWriter(out)
    writer.add(1, np.arange(100, dtype="<u4"))
    writer.close()
    with pytest.raises(ValueError, match="ends early"):
        T.PlaneReader(io.BytesIO(out.getvalue()[:-3]))


def test_token_files(odd, nothing, some, bpe_path):
    tokenizer = Tokenizer.from_file(bpe_path)
    for df in (odd, some):
        rows = T.read_token_files(T.write_token_files(df, bpe_path, block=1000)).collect()
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in df.collect())
        got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
        assert [g[1] for g in got] == [w[0] for w in want]
        assert sorted((g[1], g[2], g[3]) for g in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
        place = 0
        for start, _, n, _ in got:
            assert start == place
            place += n
    assert T.read_token_files(T.write_token_files(nothing, bpe_path)).count() == 0


ALPHABETS = [["a", "b", "the", "ing", " ", "  ", "\n", "'", "'s", "'ll", "*", "é", "é", "ß", "İ", "1", "23", "日本", "😀", "́", "ﬁ", "<|endoftext|>", "<|start", " ", "\x1c", "가"], ["a", "b", "e", "t"], ["'", "s", "*", "ll"], ["er", "in", "the", "an"], ["日", "😀", "é", "́"]]


def test_tree_concatenation_is_exact(word_path):
    bpe, rng = tree_bpe.TreeBPE(word_path, leaf=32, window=4), random.Random(5)
    for k in range(1500):
        text = "".join(rng.choice(ALPHABETS[k % len(ALPHABETS)]) for _ in range(rng.randint(10, 200)))
        want = bpe.whole.encode(text, add_special_tokens=False).ids
        (got,) = bpe.encode([text])
        assert got.tolist() == want, text
        assert bpe.decode([got]) == [bpe.whole.decode(want, skip_special_tokens=False)]


def test_encode_decode(odd, nothing, some, word_path):
    tokenizer = Tokenizer.from_file(word_path)
    for df in (odd, some):
        want = []
        for r in df.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((str(r["doc_id"]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tree_bpe.encode_decode(df, word_path).collect()]
        assert sorted(got) == sorted(want)
    assert tree_bpe.encode_decode(nothing, word_path, keep=True).count() == 0
