import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webloom.llm import packing
from webloom.llm.tokens import ByteBPE

TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" '\n\t.,!?abcstdrmlveTHE019éßñ²ªİ日 \u0085\x1c\x00😀")), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def encoders(bpe_path):
    return ByteBPE(bpe_path, kept_words=50), Tokenizer.from_file(bpe_path)


@given(texts=st.lists(TEXT, max_size=4))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_library_s(encoders, texts):
    ours, theirs = encoders
    for got, text in zip(ours.encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_special_and_long_texts(encoders, monkeypatch):
    from webloom.llm import tokens

    ours, theirs = encoders
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 7)
    for text in ("a<|endoftext|>b", "it's  a\n\n test. " * 40, "<|endoftext|>"):
        assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=200, deadline=None)
def test_combinations_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    used = np.zeros(65, int)
    for items, times in packing.combinations(counts):
        assert sum(items) <= 64
        for x in items:
            used[x] += times
    assert (used == counts).all()


def test_packing_is_tight():
    rng = random.Random(0)
    counts = np.bincount([rng.randint(1, 1023) for _ in range(20_000)], minlength=1025)
    total = int((counts * np.arange(1025)).sum())
    assert sum(t for _, t in packing.combinations(counts)) <= -(-total // 1024) * 1.002


def test_exact_complements_come_first():
    counts = np.zeros(11, int)
    counts[[7, 3, 6, 4, 5, 2]] = [1, 1, 1, 1, 1, 1]  # 7+3, 6+4, 5+2
    assert sorted(i for i, _ in packing.combinations(counts)) == [(5, 2), (6, 4), (7, 3)]


def check_packed(rows, bpe_path, docs):
    tokenizer = Tokenizer.from_file(bpe_path)
    held, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, texts in docs.items():
        want = []
        for text in texts:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            n = len(ids)
            cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)] if n > 1024 else [0, n]
            want += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]) == sorted(want)


def by_id(df):
    docs = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        docs[r["doc_id"]].append(r["text"])
    return docs


@pytest.mark.parametrize("groups", [100_000, 3])
def test_packed_documents(odd, nothing, some, bpe_path, monkeypatch, groups):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", groups)
    for df in (odd, some):
        check_packed(packing.pack_documents(df, bpe_path).collect(), bpe_path, by_id(df))
    assert packing.pack_documents(nothing, bpe_path).count() == 0


def test_ids_on_request(odd, bpe_path):
    rows = packing.pack_documents(odd, bpe_path, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_index_of_sums_stays_in_step_with_the_counts(lengths):
    index = packing.Complements(np.bincount(lengths, minlength=33))
    while index.counts.any():
        anew = packing.Complements(index.counts.copy())
        assert (index.pairs == anew.pairs).all() and (index.made_by == anew.made_by).all() and (index.triples == anew.triples).all()
        there = [x for x in range(33) for _ in range(min(3, int(index.counts[x])))]
        for gap in range(1, 33):
            for n, look_up in ((1, index.single), (2, index.pair), (3, index.triple)):
                found = look_up(gap, {})
                assert (found is None) == (gap not in {sum(c) for c in itertools.combinations(there, n)})
                assert found is None or sum(found) == gap
        index.use({int(np.nonzero(index.counts)[0][0]): 1}, 1)
