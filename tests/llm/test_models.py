import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import chargrams, language, pii, suffix_tree, toxicity
from webloom.llm.common import fold


def test_folds(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in (0, 1, 17, 123456, None)], "i long").select("i", fold("i", 5).alias("f")).collect()
    assert all(r["f"] == (0 if r["i"] is None else zlib.crc32(str(r["i"]).encode()) % 5) for r in rows)


def test_grams():
    h, owner = chargrams.grams(["ab", "c"], (2, 3), 40)
    assert sorted(owner.tolist()) == [0, 0, 0, 0, 0, 1, 1, 1]  # " a" "ab" "b " " ab" "ab " / " c" "c " " c "
    same, _ = chargrams.grams(["c", "ab"], (2, 3), 40)
    assert sorted(h.tolist()) == sorted(same.tolist())
    assert len(chargrams.grams([], (2,), 20)[0]) == 0


def test_word_table_starts_anew_when_full():
    table = chargrams.WordTable(lambda words: np.array([float(len(w)) for w in words]), kept=4)
    for words in (["a", "bb"], ["ccc", "a"], ["dddd", "eeeee", "a"], []):
        at, rows = table.look_up([words])
        assert [rows[i] for i in at[0]] == [len(w) for w in words]


# ---- toxicity ----


def toxic_tables(spark, n=400):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = "scoundrel" + rng.choice(["", "s", "ly", "ed"])
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_generalises(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).join(docs.select(F.col("doc_id").alias("i"), fold("doc_id", 5).alias("f")), F.col("doc_id") == F.col("i")).collect()}
    held = [r for r in rows.values() if r["f"] == 0]
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    kept = toxicity.drop_toxic(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if not r["predicted"]}
    assert kept.columns == docs.columns


def test_toxicity_score_is_the_sum_of_its_weights(spark):
    docs, labels = toxic_tables(spark, 100)
    model = toxicity.train(docs, labels)
    for r in toxicity.toxicity(docs, model).join(docs, "doc_id").limit(20).collect():
        f, n = toxicity.features(r["text"])
        z = model.intercept + sum(float(model.weights[i]) * c for i, c in zip(f, n, strict=True))
        assert r["score"] == pytest.approx(toxicity.sigmoid(z), rel=1e-6)


def test_ratios_and_fit_against_plain_loops(spark):
    """Counts, log-count ratios, the cut of features and the gradient steps, anew from the texts."""
    docs, labels = toxic_tables(spark, 160)
    model = toxicity.train(docs, labels)
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    learnt = [(marked[r["doc_id"]], r["text"]) for r in sorted(docs.withColumn("f", fold("doc_id", 5)).filter("f <> 0").collect(), key=lambda r: r["doc_id"])]

    def values(text):
        found = Counter()
        for w in {w for w in re.findall(r"\w+", text.lower())}:
            for n in toxicity.SIZES:
                padded = f" {w} "
                for a in range(len(padded) - n + 1):
                    found[padded[a : a + n]] += 1
        return found

    rows = [(y, values(t)) for y, t in learnt]
    hashed = {}
    for _, v in rows:
        for g in v:
            hashed.setdefault(g, one_gram(g))
    by_hash = [(y, sum((Counter({hashed[g]: n}) for g, n in v.items()), Counter())) for y, v in rows]
    p, q, df = Counter(), Counter(), Counter()
    for y, v in by_hash:
        for h, n in v.items():
            (p if y else q)[h] += n
            df[h] += 1
    often = [h for h in df if df[h] >= toxicity.LEAST_ROWS]
    size, one = 1 << toxicity.BITS, toxicity.SMOOTHING
    sum_p, sum_q = sum(p[h] for h in often), sum(q[h] for h in often)
    ratio = {h: math.log((p[h] + one) / (sum_p + one * size)) - math.log((q[h] + one) / (sum_q + one * size)) for h in often}
    ratio = {h: r for h, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO}
    share = sum(y for y, _ in by_hash) / len(by_hash)
    w, past, b, past_b = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-8), math.log(share / (1 - share)), 1e-8
    for _ in range(toxicity.STEPS):
        grad, grad_b = {h: toxicity.PENALTY * w[h] for h in ratio}, 0.0
        for y, v in by_hash:
            off = (toxicity.sigmoid(b + sum(w[h] * n * ratio[h] for h, n in v.items() if h in ratio)) - y) / len(by_hash)
            grad_b += off
            for h, n in v.items():
                if h in ratio:
                    grad[h] += off * n * ratio[h]
        for h in ratio:
            past[h] += grad[h] ** 2
            w[h] -= toxicity.RATE * grad[h] / math.sqrt(past[h])
        past_b += grad_b**2
        b -= toxicity.RATE * grad_b / math.sqrt(past_b)
    assert {int(h) for h in np.nonzero(model.weights)[0]} == {h for h in ratio if w[h] * ratio[h] != 0}
    assert model.intercept == pytest.approx(b, rel=1e-6)
    assert all(model.weights[h] == pytest.approx(w[h] * ratio[h], rel=1e-4, abs=1e-7) for h in ratio)


def one_gram(gram):
    """The hash of one n-gram, by the definition: a polynomial of its characters, mixed; its highest bits."""
    h, mask = len(gram), (1 << 64) - 1
    for c in gram:
        h = (h * int(chargrams._STEP) + ord(c)) & mask
    h ^= h >> 29
    return (h * int(chargrams._MIX) & mask) >> (64 - toxicity.BITS)


def test_rows_repeated_with_one_id_count_once(spark):
    docs, labels = toxic_tables(spark, 60)
    model = toxicity.train(docs, labels)
    again = docs.unionByName(docs.filter("doc_id % 3 = 1")).unionByName(docs.filter("doc_id = 4"))
    same = toxicity.train(again, labels)
    assert same.intercept == pytest.approx(model.intercept) and np.allclose(same.weights, model.weights)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    docs, labels = toxic_tables(spark, 100)
    model = toxicity.train(docs, labels)
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)} == {toxicity.sigmoid(model.intercept)}
    assert toxicity.toxicity(nothing, model).count() == 0
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(docs, toxicity.train(docs, none)).collect()} == {0.0}
    clean = labels.withColumn("toxic", F.lit(0))
    assert max(r["score"] for r in toxicity.toxicity(docs, toxicity.train(docs, clean)).collect()) < 1e-9
    noisy = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], labels.schema))
    assert toxicity.train(docs, noisy).intercept == pytest.approx(model.intercept)


# ---- language ----


def test_language(some, odd, nothing):
    model = language.train(some)
    assert model.names == ["de", "en", "es", "fr"]
    rows = language.identify(some, model).join(some.select("doc_id", "lang", fold("doc_id", 5).alias("f")), "doc_id").filter("f = 0").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    got = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0.0) for r in language.identify(odd, model).collect()}
    assert {g for g in got if g[0] in (3, 4, 5)} == {(3, True, True), (4, True, True), (5, True, True)}
    assert language.identify(nothing, model).count() == 0
    unknown = language.train(nothing)
    assert {r["lang_pred"] for r in language.identify(some, unknown).collect()} == {"und"}


def test_letters_are_the_categories_of_letters():
    import sys
    import unicodedata

    letters = {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"}
    assert set("".join(language.WORDS.findall(" ".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))))) == letters


def test_words_are_counted_without_the_pattern_of_all_numbers(monkeypatch):
    import sys
    from collections import Counter

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    text = every + " " + "x".join(every) + " a½b a½b Ünlü"
    assert language.count_words(text) == Counter(language.WORDS.findall(text.lower()))
    monkeypatch.setattr(language, "WORDS", None)  # it takes six times as long; runs of letters do without
    assert language.count_words("Der Bär, der 2 Ñandús_sah") == {"der": 2, "bär": 1, "ñandús": 1, "sah": 1}


def test_number_signs_are_no_letters(spark, some):
    model = language.train(some)
    rows = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ"), (3, "12 ٣ _"), (4, "Ⅷ the house and the garden ½")], "doc_id long, text string")
    assert {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language.identify(rows, model).collect()} == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True)}


def test_mixtures_of_two_languages(spark, some):
    model = language.train(some)
    own = {k: " ".join(r["text"] for r in some.filter(F.col("lang") == k).limit(6).collect()).split()[:300] for k in ("fr", "de")}
    mixed = spark.createDataFrame([(1, " ".join(own["fr"][:200] + own["de"][:100])), (2, " ".join(own["de"]))], "doc_id long, text string")
    rows = {r["doc_id"]: {m["lang"]: m["share"] for m in r["mixture"]} for r in language.identify(mixed, model, mixture=True).collect()}
    assert rows[1]["fr"] == pytest.approx(2 / 3, abs=0.08)
    assert rows[1]["de"] == pytest.approx(1 / 3, abs=0.08)
    assert rows[2]["de"] > 0.95


def test_em_against_a_plain_loop():
    rng = np.random.default_rng(0)
    logs, weight = rng.normal(-5, 3, (30, 3)), rng.integers(1, 5, 30).astype(float)
    share, fit = language.mixtures(logs, weight, np.array([0, 12]), np.ones((2, 3), bool), steps=20)
    for d, (a, b) in enumerate(((0, 12), (12, 30))):
        p = np.full(3, 1 / 3)
        for _ in range(20):
            r = np.exp(logs[a:b]) * p
            r = r / r.sum(axis=1, keepdims=True) * weight[a:b, None]
            p = r.sum(axis=0) / weight[a:b].sum()
        assert share[d] == pytest.approx(p)
        assert fit[d] == pytest.approx((weight[a:b] * np.log((np.exp(logs[a:b]) * p).sum(axis=1))).sum())


# ---- suffix tree ----


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("bucket", [1_000_000, 500])
def test_scores(spark, some, odd, nothing, bucket, monkeypatch):
    import zlib

    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(suffix_tree, "PART_TOKENS", 10 * bucket)
    for df in (some, odd):
        docs = [(r["doc_id"], words(r["text"])) for r in df.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        counts = Counter()
        for i, ws in docs:
            if not held(i):
                counts.update([*ws, None])
        n, v = sum(counts.values()), len(counts)
        want = [(str(i), held(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]), 4)) for i, ws in docs]
        rows = suffix_tree.lm_scores(df).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == sorted(want)
        assert all(r["score"] < 0 for r in rows)
    assert suffix_tree.lm_scores(nothing).count() == 0


def walked(docs, held, shrink=suffix_tree.SHRINK):
    """Scores by brute force: counts of all contexts, the test of each, and the longest kept one at each place."""
    sequences = {i: [None, *ws, None] for i, ws in docs}  # None: the end, also before the beginning
    learnt = [s for i, s in sequences.items() if not held(i)]
    unigram = Counter(w for s in learnt for w in s[1:])
    n, v = sum(unigram.values()), len(unigram)
    follow = [defaultdict(Counter), defaultdict(Counter)]
    for s in learnt:
        for p in range(1, len(s)):
            for k in (1, 2):
                if p >= k:
                    follow[k - 1][tuple(s[p - k : p])][s[p]] += 1
    kept = set()

    def chance(context, w):
        while context and context not in kept:
            context = context[1:]
        return own(context, w, chance(context[1:], w)) if context else (unigram[w] + 1) / (n + v + 1)

    def own(context, w, below):
        seen, weight = follow[len(context) - 1][context], shrink[len(context) - 1]
        total, often = sum(seen.values()), sum(c for c in seen.values() if c > 1)
        return ((seen[w] if seen[w] > 1 else 0) + (weight + total - often) * below) / (total + weight)

    for k in (1, 2):
        for context, seen in follow[k - 1].items():
            total, weight = sum(seen.values()), shrink[k - 1]
            if total < 2:
                continue
            rest = sum(c for c in seen.values() if c == 1)
            gain = rest * math.log((weight + rest) / (total + weight))
            for w, c in seen.items():
                if c > 1:
                    p = 10 ** -(int(suffix_tree.in_steps(np.array([chance(context[1:], w)]))[0]) / suffix_tree.STEPS)
                    gain += c * math.log((c + weight * p) / ((total + weight) * p))
            if gain >= suffix_tree.LEAST_GAIN:
                kept.add(context)
    return {i: sum(math.log10(chance(tuple(s[max(0, p - 2) : p]), s[p])) for p in range(1, len(s))) for i, s in sequences.items()}, kept, chance, [*unigram]


@pytest.mark.parametrize("small", [False, True])
def test_scores_agree_with_walking_the_contexts(spark, some, small, monkeypatch):
    import zlib

    if small:  # many buckets and parts, and contexts in several slices
        for name, value in (("BUCKET_TOKENS", 3000), ("PART_TOKENS", 500), ("PART_GRAMS", 1000), ("SPLIT", 20)):
            monkeypatch.setattr(suffix_tree, name, value)
    rows = some.limit(90)
    docs = [(r["doc_id"], words(r["text"])) for r in rows.collect()]
    want, kept, chance, vocabulary = walked(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    assert {len(c) for c in kept} == {1, 2}
    got = {r["doc_id"]: r["score"] for r in suffix_tree.lm_scores(spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
    for context in sorted(kept, key=str)[:40]:  # each distribution sums to 1, unknown tokens being one symbol
        assert sum(chance(context, w) for w in [*vocabulary, "unknown"]) == pytest.approx(1)


def test_features_are_counted_in_the_workers():
    import pyarrow as pa

    rows = [(10, 1, [3, 5, 9], [1, 2, 4]), (11, 0, [5], [7]), (12, 0, [], []), (13, 1, [9, 70_000], [1, 1]), (14, 0, [3, 9], [5, 6])]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "label", "f", "n"])
    batches = [whole.slice(0, 2), whole.slice(2)]  # the second doesn't begin where its lists' values do
    want = defaultdict(lambda: [0, 0, 0])
    for _, y, fs, ns in rows:
        for f, n in zip(fs, ns, strict=True):
            want[f] = [want[f][0] + n * y, want[f][1] + n * (1 - y), want[f][2] + 1]
    (got,) = toxicity.count(iter(batches))
    assert {r["f"]: [r["p"], r["q"], r["rows"]] for r in got.to_pylist()} == want
    kept = np.zeros(1 << toxicity.BITS, bool)
    kept[[5, 9]] = True
    chosen = [tuple(r.values()) for b in toxicity.only(iter(batches), kept) for r in b.to_pylist()]
    assert chosen == [(i, f, n) for i, _, fs, ns in rows for f, n in zip(fs, ns, strict=True) if f in (5, 9)]


def test_what_a_worker_keeps_goes_with_the_next_stage():
    from webloom.llm import common

    common.held(("here",), dict)
    common.release()
    assert not common._held
    first, second = common.held(("a",), list), common.held(("b",), list)
    assert list(common._held) == [("b",)] and first is not second is common.held(("b",), dict)
    common.release()


def test_texts_are_read_in_small_batches(spark):
    from webloom.llm.common import ROWS_READ, small_batches

    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4096")
        small_batches(spark)
        assert spark.conf.get(key) == str(ROWS_READ)
        spark.conf.set(key, "2000")  # one's own stays
        small_batches(spark)
        assert spark.conf.get(key) == "2000"
    finally:
        spark.conf.set(key, before)


def test_keys_in_order():
    rng = np.random.default_rng(3)
    for most in (0, 5, 1 << 40, (1 << 62) - 1):  # the last doesn't fit beside a place
        keys = rng.integers(0, most + 1, 1000)
        assert suffix_tree.in_order(keys, most).tolist() == np.argsort(keys, kind="stable").tolist()
        for found, first, inverse in (suffix_tree.distinct(keys), suffix_tree.distinct(keys, most)):
            assert found.tolist() == np.unique(keys).tolist() == keys[first].tolist()
            assert (found[inverse] == keys).all()


def test_a_part_tests_the_contexts_that_it_holds_whole():
    # two contexts in one slice each, and a slice of a third; the second question repeats the first
    n = np.array([10, 4000, suffix_tree.SPLIT])
    asked = suffix_tree.packed(np.array([1, 2, 3], np.uint64), n, np.array([1, 1, 1], np.int32), np.array([7, 8, 9], np.uint32), np.array([5, 1, 40], np.int32), np.array([40, 2, 40], np.uint8))
    answers = suffix_tree.sum_grams([asked, asked], 1.0)
    assert answers[0] == answers[1]
    gain, often, count = suffix_tree.unpacked(answers[0], *suffix_tree.ANSWER)
    assert count.tolist() == often.tolist() == [10, 2, 80]
    assert gain.tolist()[:2] == [suffix_tree.KEPT, -suffix_tree.KEPT]
    p = 10 ** (-40 / suffix_tree.STEPS)
    assert gain[2] == pytest.approx(80 * math.log((80 + p) / ((suffix_tree.SPLIT + 1) * p)))


def test_a_bucket_needs_few_bytes_a_token(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(suffix_tree, "TaskContext", Task)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 30_000) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([k % 7 == 2 for k in range(1000)]), pa.array(texts)], ["doc_id", "held", "text"])
    rows = pa.Table.from_batches(suffix_tree.gather(iter([batch]), 1))
    own = suffix_tree.unpacked(rows.column("data")[0].as_py(), "u1", "<i8")[1]
    state = rows.slice(1)
    assert rows.column("part").to_pylist() == [0, -1]
    tracemalloc.start()
    bucket = suffix_tree.Bucket(state, 1, 1)
    level = bucket.root({0: suffix_tree.packed(own)}, int(own.sum()), int((own > 0).sum()))
    answer = suffix_tree.sum_grams([data for _, data in bucket.question(level).messages()], 200.0)[0]
    level = bucket.question(level).answered({0: answer}, 200.0)
    list(bucket.question(level).messages())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * len(bucket.symbols)


def test_the_tree_beats_the_baseline_and_grows(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    held = suffix_tree.lm_scores(spark.read.parquet(f"{folder}/documents.parquet")).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > 0.96 * held[0]


# ---- personal data ----


def reference_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans():
    rng = random.Random(1)
    parts = ["a", "@", "b.c", "-", "1", "22", "255", "4111 1111 1111 1111", ".", "+1", "(", "555", " ", "é", "x@y.z", "_", "0", "٣", "\n"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == reference_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000, "@" * 300_000):
        pii.base_spans(text)


def test_parts_of_addresses_with_thousands_of_digits():
    zeros, large = "0" * 5000 + "1.2.3.4", "7" * 5000 + ".1.1.1"
    assert pii.base_spans(zeros) == [(1, 0, len(zeros))]
    assert pii.base_spans(large) == []
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_free_spans_against_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        taken = [(rng.randrange(4), a, a + rng.randint(1, 8)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 6)))]
        cuts = sorted(rng.sample(range(70), 2 * rng.randint(0, 8)))
        more = [(rng.randrange(4), a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        assert pii.free_spans(taken, more) == [m for m in more if all(m[2] <= a or b <= m[1] for _, a, b in taken)]


def test_very_long_numbers_stay_in_memory(field):
    import tracemalloc

    text = "call (415) 555-2671 or 12 34 5678 9 " * 6_000  # 220 kB, one sequence
    short = ["room 12 of 14"] * 255
    tracemalloc.start()
    found = pii.find_pii(field, [text, *short])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert len(found) == 256
    spans = {(text[a:b], k) for k, a, b in found[0][1]}
    assert ("(415) 555-2671", 3) in spans


def test_the_field_learns_its_table(field):
    for text, spans in pii.examples():
        assert sorted(pii.field_spans(field, [text])[0]) == sorted(spans), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("phone (415) 555-2671 now", [("phone", "(415) 555-2671")]), ("bob [at] example.com wrote", [("email", "bob [at] example.com")]), ("card 4242 4242 4242 4242 ok", [("card", "4242 4242 4242 4242")]),
        ("Licensed under the Apache License, Version 2.0. All", []), ("in 2019 and 2020 he said 3.14", []), ('token = "ae6a82ddc37541d4fc99369cfbe7240720bcb6c5" the', []), ("", []), ("no numbers at all", []),
        ("x +1 (269) 555-3296 4524132264652876 y", [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]),
    ],
)
def test_found(field, text, want):
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_pii(field, [text])[0][1]] == want


def test_viterbi_against_all_paths(field):
    from itertools import product

    rng = np.random.default_rng(3)
    small = pii.Field(["a", "b"])
    small.emit[:, :, :3], small.move[:3, :3] = rng.normal(size=(5, 3, 3)), rng.normal(size=(3, 3))
    small.emit[:, :, 3:] = -50
    seqs = [small.numbers(list(rng.choice(["a", "b", "c"], n))) for n in (1, 2, 5, 6, 3)]
    for seq, got in zip(seqs, small.decode(seqs), strict=True):
        scores = small.scores(seq)
        best = max(product(range(3), repeat=len(seq)), key=lambda p: sum(scores[t, y] for t, y in enumerate(p)) + sum(small.move[x, y] for x, y in zip(p, p[1:], strict=False)))
        assert got.tolist() == list(best)


def test_pii_rows(odd, nothing, field):
    rows = pii.pii(odd, field).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[11]["spans"].startswith("email:") and by_id[11]["n_phone"] == 1
    assert by_id[3]["spans"] == "" and by_id[4]["n_email"] == 0
    assert pii.pii(nothing, field).count() == 0


def test_masking(spark, odd, nothing, field):
    docs = spark.createDataFrame([(1, "mail a.b@c.de or +1 (555) 010-4477.", "k"), (2, None, None), (3, "clean text", "m")], "doc_id long, text string, extra string")
    rows = {r["doc_id"]: r for r in pii.mask_pii(docs, field).collect()}
    assert rows[1]["text"] == "mail [EMAIL] or [PHONE]." and rows[1]["extra"] == "k"
    assert rows[2]["text"] is None and rows[3]["text"] == "clean text"
    assert pii.mask_pii(odd, field).columns == odd.columns
    assert pii.mask_pii(nothing, field).count() == 0
