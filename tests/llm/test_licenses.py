import random

from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.llm import licenses

from llm_cases import awkward


@settings(deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12))
def test_longest_increasing_run(values):
    run = licenses.increasing(list(enumerate(values)))
    best = 0
    for mask in range(1 << len(values)):
        some = [v for i, v in enumerate(values) if mask >> i & 1]
        if all(a < b for a, b in zip(some, some[1:])):
            best = max(best, len(some))
    assert len(run) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:]))


@settings(deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=15), st.lists(st.sampled_from("abcdef"), max_size=15))
def test_alignment_is_a_common_subsequence(text, template):
    got = licenses.align(text, template)
    assert all(text[i] == template[j] for i, j in got) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
    if text == template:
        assert len(got) == len(template)


def test_finds_whole_and_damaged_licenses(spark):
    random.seed(1)
    noise = [f"w{random.randrange(3000)}" for _ in range(20_000)]
    mit = licenses.TEMPLATES["MIT"].split()
    damaged = [w for i, w in enumerate(mit) if i % 11]
    half = mit[: len(mit) // 2]
    rows = [(1, " ".join(noise[:9000] + mit + noise[9000:])), (2, " ".join(noise[:50] + damaged + noise[50:90])), (3, " ".join(half)), (4, " ".join(random.sample(mit, len(mit)))), (5, " ".join(noise))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["license"] == "MIT"}
    assert set(got) == {1, 2}
    assert got[1]["coverage"] == 1 and got[1]["first_word"] == 9000 and got[2]["coverage"] > 0.85


def test_copies_close_together_are_found(spark):
    random.seed(2)
    notice, mit = licenses.TEMPLATES["Apache-2.0-notice"], licenses.TEMPLATES["MIT"].split()
    damaged = [w for i, w in enumerate(mit) if i % 11]
    longer = [x for i, w in enumerate(mit) for x in ([w, "inserted"] if i % 4 == 0 else [w])]
    rows = [(n, f"Read the notes first. {' '.join([notice] * n)} See the file for more.") for n in range(1, 6)]
    for k, copy in ((10, mit), (20, damaged), (30, longer)):
        for n in (2, 3):
            between = [random.choice(["the", "of", "software", "x", "y"]) for _ in range(10)]
            rows.append((k + n, " ".join(["see", "the", "note", *((copy + between) * n), "of", "the", "file"])))
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(1, 6):
        r = got[n, "Apache-2.0-notice"]
        assert r["coverage"] == 1 and (r["first_word"], r["last_word"]) == (4, 10)
    for n in (2, 3):
        assert got[10 + n, "MIT"]["coverage"] == 1 and got[10 + n, "MIT"]["first_word"] == 3
        assert got[20 + n, "MIT"]["coverage"] > 0.85 and got[30 + n, "MIT"]["coverage"] > 0.95


def test_awkward_texts(spark, docs_folder):
    notice = licenses.TEMPLATES["MIT-notice"]
    rows = [*awkward(), (20, notice, "en", "s", 0), (20, notice, "en", "s", 0), (None, notice.upper(), None, None, None)]
    got = licenses.op4_licenses(spark, docs_folder(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in got) == [(0, "MIT-notice"), (20, "MIT-notice"), (20, "MIT-notice")]


def test_empty_table(spark, docs_folder):
    assert licenses.op4_licenses(spark, docs_folder([])).count() == 0
