import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import exact_dedup, near_copies, simhash


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check_exact(df, rows):
    groups = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        groups[plain(r["text"])].append((r["doc_id"], r["text"] or ""))
    want = []
    for members in groups.values():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want += [(str(i), str(keep), len(members), i == keep) for i, _ in members]
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows) == sorted(want)


def test_exact(odd, nothing, some):
    for df in (odd, some):
        check_exact(df, exact_dedup.exact_dedup(df).collect())
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_colliding_hashes_are_told_apart(odd, some):
    weak = lambda text: F.substring(F.md5(text.cast("binary")), 1, 1)
    for df in (odd, some):
        check_exact(df, exact_dedup.exact_dedup(df, weak).collect())


def test_drop_copies(odd, nothing):
    rows = exact_dedup.drop_copies(odd).collect()
    assert rows[0].asDict().keys() == set(odd.columns)
    assert sorted(plain(r["text"]) for r in rows) == sorted({plain(r["text"]) for r in odd.collect()})
    assert exact_dedup.drop_copies(nothing).count() == 0


def reference_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[a : a + k]).encode(), 42) for a in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[root(b)] = root(a)
    return {f: root(f) for f in fps}


def check_simhash(df, rows):
    docs = [(r["doc_id"], reference_fingerprint(r["text"])) for r in df.collect()]
    roots = components({f for _, f in docs})
    least = defaultdict(list)
    for i, f in docs:
        if i is not None:
            least[roots[f]].append(i)
    want = [(str(i), f"{f:016x}", str(min(least[roots[f]], default=None))) for i, f in docs]
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == sorted(want)


def test_simhash(odd, nothing, some):
    for df in (odd, some):
        check_simhash(df, simhash.simhash_components(df).collect())
    assert simhash.simhash_components(nothing).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_keys_meet(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, bits, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    kx, rx, _ = simhash.keys(x.view(np.int64))
    ky, ry, home = simhash.keys(y.view(np.int64))
    near = set(zip(rx.tolist(), kx.tolist(), strict=True))
    assert {r for r, k, h in zip(ry.tolist(), ky.tolist(), home.tolist(), strict=True) if h and (r, k) in near} == set(range(2000))


def test_every_word_is_near_a_codeword():
    own = simhash.codewords(np.arange(1 << 14, dtype=np.int64) * 509)
    assert (own[:, 0] >= 0).all()
    assert {int(n) for n in (own >= 0).sum(axis=1)} == {1, 6}


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_of_dense_groups(spark, tile):
    rng = random.Random(tile)
    fps = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(60):
            f = center
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    edges = simhash.links(spark.createDataFrame([(f, [f]) for f in signed], "node long, fps array<long>"), tile=tile)
    found = {(signed[r["u"]], signed[r["v"]]) for r in edges.collect()}
    assert all((u ^ v).bit_count() <= 3 for u, v in found)
    roots = {signed[r["node"]]: signed[r["root"]] for r in simhash.components(edges).collect()}
    want = components(fps)
    groups, wanted = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[roots.get(f, f)].add(f)
        wanted[want[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 150)]
    random.Random(1).shuffle(chain)
    rows = simhash.components(spark.createDataFrame(chain + star, "u long, v long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert {roots[k] for k in range(1, 201)} == {0}
    assert {roots[1000 + k] for k in range(1, 150)} == {1000}


def test_drop_near_copies(spark, odd, nothing):
    base = " ".join(f"w{k}" for k in range(600))
    docs = spark.createDataFrame([(1, base, "x"), (2, base + " tail", "y"), (3, "something else altogether here", "z"), (3, "another text under the same id", "q"), (4, None, None)], "doc_id long, text string, extra string")
    rows = near_copies.drop_near_copies(docs).collect()
    assert sorted((r["doc_id"], r["extra"] or "") for r in rows) == [(2, "y"), (3, "q"), (3, "z"), (4, "")]
    assert set(rows[0].asDict()) == {"doc_id", "text", "extra"}
    assert near_copies.drop_near_copies(nothing).count() == 0
    assert near_copies.drop_near_copies(odd).columns == odd.columns


def test_near_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    docs, originals = [], 150
    for i in range(originals):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        docs.append((i, " ".join(words)))
        changed = list(words)
        for _ in range(max(1, len(words) // 100)):  # about 0.9 similar
            changed[rng.randrange(len(words))] = "changed"
        docs.append((1000 + i, " ".join([*changed, "more"])))
    left = {r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(i in left or 1000 + i in left for i in range(originals))
    assert len(left) <= originals * 1.05


def shingle_set(text, k=5):
    words = text.lower().split()
    return {" ".join(words[a : a + k]) for a in range(max(1, len(words) - k + 1))} if words else set()


def check_groups(spark, texts, least=0.8):
    """Groups against components of all pairs compared by brute force."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) / len(a | sets[j]) >= least or texts[i] == texts[j]:
                parent[root(i)] = root(j)
    got, want = defaultdict(set), defaultdict(set)
    for r in near_copies.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["root"]].add(r["doc_id"])
    for i in range(len(texts)):
        want[root(i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    return len(want)


def with_words_replaced(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(words)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_around_an_original_and_reordered_texts(spark):
    rng = random.Random(11)
    texts = []
    for g in range(6):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(300)]
        texts += [" ".join(words), *(with_words_replaced(rng, words, rng.randint(3, 9)) for _ in range(12))]
        for _ in range(3):  # the same words, other shingles
            texts.append(" ".join(rng.sample(words, len(words))))
        texts.append(" ".join([*words[150:], *words[:150]]))
    texts += [texts[0], texts[1], "", "a b", "a b"]
    assert check_groups(spark, texts) > 6


def test_candidates_of_small_vocabularies(spark):
    rng = random.Random(12)
    texts = []
    for g in range(60):
        words = [f"g{g}w{rng.randrange(60)}" for _ in range(350)]
        texts += [" ".join(words), " ".join([*words, *(f"g{g}v{k}" for k in range(rng.randint(20, 60)))])]
    assert check_groups(spark, texts) == 60


def test_the_threshold_is_exact(spark):
    texts = []
    for g in range(60):  # 404 words have 400 shingles; n words cut from the end leave 400 - n
        words = [f"g{g}w{k}" for k in range(404)]
        texts += [" ".join(words), " ".join(words[: 404 - (80 if g % 2 else 81)])]
    assert check_groups(spark, texts) == 60 + 30


@pytest.mark.parametrize("tile", [7])
def test_dense_groups_and_common_passages(spark, monkeypatch, tile):
    """Many copies of one text, many of them below 0.8 to most others, and a passage that a third of all texts quote."""
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(13)
    words = [f"d{rng.randrange(10**6)}" for _ in range(130)]
    texts = [with_words_replaced(rng, words, rng.randint(1, 5)) for _ in range(90)]
    passage = [f"p{k}" for k in range(60)]
    for _ in range(60):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 20, 80]))]
        texts.append(" ".join([*own, *passage]))
    assert check_groups(spark, texts) > 30


@pytest.mark.parametrize("length", [30, 300])
def test_recall_by_similarity(spark, length):
    """Of pairs of distinct texts at 0.8 or more, in every band of similarity all share a group."""
    rng = random.Random(length)
    texts, family = [], []
    for g in range(25):
        words = [f"f{g}w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(6):
            texts.append(with_words_replaced(rng, words, rng.randint(0, max(1, length // 40))))
            family.append(g)
    roots = {r["doc_id"]: r["root"] for r in near_copies.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, found = [shingle_set(t) for t in texts], defaultdict(list)
    for i, a in enumerate(sets):
        for j in range(i):
            if family[i] == family[j] and texts[i] != texts[j] and (similar := len(a & sets[j]) / len(a | sets[j])) >= 0.8:
                found[int(similar * 50)].append(roots[i] == roots[j])
    assert sum(map(len, found.values())) >= 10 and all(all(f) for f in found.values())


def test_counts_of_shingles_order_the_prefix():
    hashes, often = np.array([5, 1, 9, 3, 7], np.uint64), np.array([1, 3, 1, 2, 9])
    assert near_copies.prefix(hashes, often, 0.8).tolist() == [0, 2]  # 5 - 4 + 1 of the rarest, by hash
    assert near_copies.prefix(hashes[:0], often[:0]).tolist() == []


def test_arrays_travel_whole():
    from webloom.llm import dealt

    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 2**63, 100).astype("<u8"), np.zeros(0, "<i4"), rng.integers(0, 99, 7).astype("u1")]
    got = dealt.unpacked(dealt.packed(*arrays), "<u8", "<i4", "u1")
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(arrays, got, strict=True))
    hashes = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    parts = dealt.part_of(hashes, 7)
    assert (np.diff(parts) >= 0).all() and set(parts.tolist()) == set(range(7))
