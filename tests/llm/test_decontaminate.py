import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward

from bramble.llm import decontaminate as d
from bramble.llm.common import load

ITEMS = "item_id long, text string, doc_id string, label string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=6))
def test_search_is_exact(text, item):
    best, first, end = d.matched(text, item)
    assert best == min(edits(text[i:j], item) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert edits(text[first:end], item) == best


def test_repetitions():
    n = d.repetitions(0.95, 0.25)
    assert 1 - (1 - 0.75**d.SAMPLE) ** n >= 0.95 > 1 - (1 - 0.75**d.SAMPLE) ** (n - 1)


def test_query_against_exact_search(spark, small):
    docs = [(r["doc_id"], d.words(r["text"])) for r in load(spark, small, "documents").collect()]
    items = [(r["item_id"], d.words(r["text"])) for r in load(spark, small, "benchmark").collect()]
    want = set()
    for i, text in docs:
        for k, item in items:
            if len(set(item) & set(text)) >= 0.4 * len(set(item)) and d.search(text, item)[0] <= int(0.15 * len(item)):
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in d.op2_decontamination(spark, small).collect()} == want and want


def test_edited_leaks_are_found(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randrange(12, 60)))) for k in range(40)]
    rows, want = [], set()
    for i in range(400):
        k, item = r.choice(items)
        leak = item.split()
        for _ in range(r.randrange(0, int(0.1 * len(leak)) + 1)):
            at = r.randrange(len(leak))
            leak[at : at + r.randrange(2)] = r.choices(vocabulary, k=r.randrange(2))
        body = r.choices(vocabulary, k=r.randrange(0, 300))
        at = r.randrange(len(body) + 1)
        if i % 4:
            body[at:at] = [w.upper() + "," for w in leak]
            want.add((i, k))
        rows.append((i, " ".join(body)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in d.leaks(docs, bench).collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want
    monkeypatch.setattr(d.blocks_of, "__defaults__", (7, d.CHARACTERS))
    again = {(x["doc_id"], x["item_id"]) for x in d.leaks(docs, bench).collect()}  # other blocks, other walks
    assert len(again & want) >= 0.95 * len(want) and not again - want
    assert {x["doc_id"] for x in d.filtered(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in again}


def test_long_items_are_found_at_the_full_ratio():
    r = random.Random(7)
    vocabulary = [b"w%d" % i for i in range(5000)]
    for m in (8, 15, 59, 100, 200):
        items = [r.choices(vocabulary, k=m) for _ in range(20)]
        texts, want = [], set()
        for k, item in enumerate(items * 3):
            leak = list(item)
            # as edits go that no longer count as known pairs: spread over the item, or all at its start
            n = int(0.15 * m)
            spots = range(1, 2 * n, 2) if k % 3 == 0 else r.sample(range(m), n)
            for at in sorted(spots, reverse=True):
                leak[at : at + r.randrange(2)] = [b"other"] if k % 2 else r.choices(vocabulary, k=r.randrange(2))
            body = r.choices(vocabulary, k=r.randrange(0, 100))
            at = r.randrange(len(body) + 1)
            texts.append(body[:at] + leak + body[at:])
        known = d.Items([(k, b" ".join(x).decode()) for k, x in enumerate(items)], 0.15, 8, d.repetitions(0.99, 0.25))
        for i, text in enumerate(texts):
            want |= {(i, k) for k, item in enumerate(items) if k == i % 20 and d.search(text, item)[0] <= int(0.15 * m)}
        assert {x[:2] for x in known.find(texts, 0.15)} == want and len(want) > 50


def test_very_long_items_take_bounded_memory():
    r = random.Random(8)
    vocabulary = [b"w%d" % i for i in range(5000)]
    item = r.choices(vocabulary, k=2000)
    leak = list(item)
    for at in r.sample(range(2000), 150):
        leak[at] = b"other"
    short = r.choices(vocabulary, k=20)
    texts = [r.choices(vocabulary, k=300) + leak, r.choices(vocabulary, k=3000), item[:1500], short + [b"x"]]
    tracemalloc.start()
    known = d.Items([(0, b" ".join(item).decode()), (1, b" ".join(short).decode())], 0.15, 8, d.repetitions(0.99, 0.25))
    got = {x[:2] for x in known.find(texts, 0.15)}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(0, 0), (3, 1)} and most < 200e6


def test_blocks_are_bounded(spark):
    texts = ["word " * 10] * 30 + ["long " * 400] + [None]
    items = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 50
    blocks = list(d.blocks_of(spark.createDataFrame(items, "item_id long, text string"), 8, 300))
    assert sorted(i for b in blocks for i, _ in b) == list(range(len(texts)))
    assert all(len(b) == 1 or len(b) <= 8 and sum(len(t or "") for _, t in b) <= 300 for b in blocks) and len(blocks) <= 8


def test_short_items_are_found_as_they_are(spark):
    short = [(1, "What is NaCl?"), (2, "forty-two"), (3, "one two three four five six seven"), (4, "What is NaCl?"), (5, "?!")]
    long = [(9, "one two three four five six seven eight nine ten")]
    rows = [(1, "so: what is NaCl"), (2, "what is the NaCl"), (3, "forty"), (4, "it is Forty two, one two three four five six seven"), (5, None), (6, "one two three four five six eight"), (7, "what is"), (8, "nacl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 1, 0, 1, 3), (1, 4, 0, 1, 3), (4, 2, 0, 2, 3), (4, 3, 0, 4, 10)}
    for items in (short, short + long):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = [(r["doc_id"], r["item_id"], r["distance"], r["first_word"], r["last_word"]) for r in d.leaks(docs, bench).collect()]
        assert sorted(got) == sorted(want)
        assert {r["doc_id"] for r in d.filtered(docs, bench).collect()} == {2, 3, 5, 6, 7, 8}


def test_awkward_texts(spark, docs_folder):
    item = "one two three four five six seven eight nine ten"
    rows = [*awkward(), (50, "so " + item, "en", "s", 1), (50, "so " + item, "en", "s", 1), (None, item, None, None, None)]
    bench = ([(1, item, "", ""), (2, item, "", ""), (3, None, "", ""), (4, "", "", ""), (5, "too short", "", ""), (None, "other " + item, "", "")], ITEMS)
    folder = docs_folder(rows, benchmark=bench)
    got = [(r["doc_id"], r["item_id"], r["distance"]) for r in d.op2_decontamination(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted([(i, k, n) for i in (50, 50, None) for k, n in ((1, 0), (2, 0), (None, 1))], key=repr)
    docs = load(spark, folder, "documents")
    kept = d.filtered(docs, load(spark, folder, "benchmark"))
    assert kept.columns == docs.columns and kept.count() == len(awkward())


def test_empty_tables(spark, docs_folder):
    assert d.op2_decontamination(spark, docs_folder([], benchmark=([(1, "a b c d e f g h i", "", "")], ITEMS))).count() == 0
    folder = docs_folder(None, benchmark=([], ITEMS))
    assert d.op2_decontamination(spark, folder).count() == 0
    assert d.filtered(load(spark, folder, "documents"), load(spark, folder, "benchmark")).count() == len(awkward())
