import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from llm_cases import awkward

from bramble.llm import maxent
from bramble.llm.common import load


def words(text):
    return [*(text or "").encode().lower().split(), b""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def expected(rows):
    seen = Counter()
    for i, t in rows:
        if not held(i):
            seen.update(words(t))
    n, v = sum(seen.values()), len(seen)
    return sorted(((i, held(i), len(words(t)), sum(seen[w] > 0 for w in words(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for i, t in rows), key=repr)


def check(got, rows):
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == expected(rows)
    assert all(r["score"] < 0 for r in got)


def test_query_and_held_out_gain(spark, small):
    got = maxent.op9_maxent(spark, small).collect()
    check(got, [(r["doc_id"], r["text"]) for r in load(spark, small, "documents").collect()])
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_rare_words_are_joined(spark, small, monkeypatch):
    whole = {r["doc_id"]: r for r in maxent.op9_maxent(spark, small).collect()}
    monkeypatch.setattr(maxent, "FREQUENT", 700)
    docs = load(spark, small, "documents")
    got = maxent.op9_maxent(spark, small).collect()
    check(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(abs(r["base_score"] - whole[r["doc_id"]]["base_score"]) < 1e-6 * abs(r["base_score"]) for r in got)


def test_awkward_texts(spark, docs_folder):
    check(maxent.op9_maxent(spark, docs_folder()).collect(), [r[:2] for r in awkward()])


def test_empty_table(spark, docs_folder):
    assert maxent.op9_maxent(spark, docs_folder([])).count() == 0


def test_shares_sum_to_one():
    listed = sorted([("", 50), *((f"w{i}", 40 - i % 30) for i in range(600))], key=lambda x: (x[0] != "", -x[1], x[0]))
    lexicon = maxent.Lexicon(listed, maxent.CLASSES * maxent.CLASS)
    model = list(maxent.start(listed, [3] * maxent.CLASSES, lexicon))
    r = np.random.default_rng(4)
    model[0] += r.normal(size=model[0].shape).astype(np.float32)
    model[1] += r.normal(size=model[1].shape).astype(np.float32)
    x = r.integers(0, len(listed), 400)
    ends = np.zeros(400, bool)
    ends[[99, 399]] = True
    f = maxent.histories(x, ends, lexicon)
    _, p, _, _, _, p2 = maxent.forward(x, f, tuple(model), lexicon)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and np.allclose(p2.sum(axis=1), 1, atol=1e-4)
    # a history begins anew with each document
    again = maxent.histories(x[100:], ends[100:], lexicon)
    assert (f[:, 100:] == again).all()


def test_last_two_words_and_all_skips_count_in_both_softmaxes():
    listed = [("", 50), *((f"w{i}", 40) for i in range(600))]
    lexicon = maxent.Lexicon(listed, maxent.CLASSES * maxent.CLASS)
    model = maxent.start(listed, [3] * maxent.CLASSES, lexicon)
    of = lambda x: maxent.histories(np.array(x), np.zeros(len(x), bool), lexicon)[:, 3]
    one, other, third = of([5, 6, 7, 8]), of([5, 9, 7, 8]), of([4, 6, 7, 8])
    assert (one != other).tolist() == [False, True, True, False]  # the last two words together, and the word two back
    assert (one != third).tolist() == [False, False, False, True]
    _, _, inner, _, at2, _ = maxent.forward(np.array([8]), one[:, None], model, lexicon)
    assert len(inner) and len(at2) == 4
    assert (maxent.NAMED, maxent.ENDINGS, maxent.BUCKETS) >= (8192, 4096, 32768) and len(maxent.ROUNDS) == 3


def test_what_is_learnt_grows_with_the_input():
    assert maxent.sizes_for(10_000, 0) == (512, maxent.NAMED, maxent.BUCKETS)
    told, named, rows = maxent.sizes_for(5_000_000_000, 200_000)
    assert told == named == 200_000 and rows > 4 * maxent.BUCKETS
    listed = [("", 5000), *((f"w{i}", 4000 - i // 2) for i in range(2999))]
    for modelled in (512, 700, 2500, 3000):
        lexicon = maxent.Lexicon(listed, modelled, 2 * maxent.NAMED)
        model = maxent.start(listed, [30] * maxent.CLASSES, lexicon, 1 << 17)
        x = np.arange(len(listed) + 50)
        f = maxent.histories(x, np.zeros(len(x), bool), lexicon)
        _, p, inner, k, _, p2 = maxent.forward(x, f, model, lexicon)
        assert (np.bincount(inner, minlength=len(x)) > 0).sum() == modelled
        # words have ways of their own, and shares of all sum to one
        s = p[np.arange(len(x)), lexicon.cls[x]].astype(float)
        way = [[] for _ in x]
        for i, a, b, c in zip(inner, k, lexicon.steps(x)[2], p2):
            s[i] *= c[b]
            way[i].append((a, b))
        assert len(set(map(tuple, way[:modelled]))) == modelled
        assert abs(s[:modelled].sum() + p[0, maxent.CLASSES : 2 * maxent.CLASSES].sum() - 1) < 1e-3
        assert np.allclose(s[:modelled], [(c + 1) / (sum(c for _, c in listed[:modelled]) + 30 * maxent.CLASSES) for _, c in listed[:modelled]], rtol=0.2)


def test_history_tells_rarer_words_apart(spark, docs_folder, monkeypatch):
    monkeypatch.setattr(maxent, "LEARNT", 8)
    filler = [f"f{i}" for i in range(600) for _ in range(2)]
    pairs = [f"left{i} right{i}" for i in range(40)]
    texts = [" ".join(filler) for _ in range(40)] + [" ".join(pairs) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = maxent.op9_maxent(spark, docs_folder(rows)).collect()
    seen = [r for r in got if r["n_tokens"] == 81]
    assert len(seen) == 60 and sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen) + 60


def test_rests():
    f = np.array([[0, 1, 31, 32, (1 << 64) - 1], [65503, 65504, 65505, 1 << 63, 12345678901234567890]], np.uint64)
    for n in (1, 31, 65504, 32736):
        assert (maxent.rest(f, n) == f % np.uint64(n)).all()


def test_driver_holds_listed_words_in_arrays(spark, docs_folder):
    texts = [" ".join(f"word{j}" for j in range(i, 120_000, 30)) for i in range(30)]
    folder = docs_folder([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    tracemalloc.start()
    try:
        maxent.op9_maxent(spark, folder)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20  # 90 with a row, a tuple and a string for each word
    finally:
        tracemalloc.stop()


def test_listed_words_are_in_order(spark):
    rows = [("", 2), ("b", 2), ("\uffee", 7), ("\U0001f600", 7), ("a.", 7), ("\u00e9", 2)]
    got = maxent.Counted.collected(spark.createDataFrame(rows, "word string, c long").repartition(3))
    want = maxent.Counted.of([rows[i] for i in (0, 4, 2, 3, 1, 5)])
    assert (got.data, got.sizes.tolist(), got.counts.tolist()) == (want.data, want.sizes.tolist(), want.counts.tolist())
    assert len(maxent.Counted.collected(spark.createDataFrame([], "word string, c long"))) == 0
