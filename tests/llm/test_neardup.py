import random

import numpy as np
from llm_cases import awkward

from bramble.llm import neardup
from bramble.llm.common import Workspace, load
from bramble.llm.components import stars

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().translate(UPPER).split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def components(rows, k, percent=80):
    """(n, component, kept) of each row, by all pairs."""
    s = sets([r[1] for r in rows], k)
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    by = {}
    for i, x in enumerate(s):
        by.setdefault(x, []).append(i)
    firsts = [v[0] for x, v in by.items() if x]
    for x, v in by.items():
        if x:
            for i in v:
                at[root(i)] = root(v[0])
    for n, i in enumerate(firsts):
        for j in firsts[:n]:
            shared = len(s[i] & s[j])
            if 100 * shared >= percent * (len(s[i]) + len(s[j]) - shared):
                at[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    out = []
    for i, r in enumerate(rows):
        c = least.get(root(i)) if s[i] else r[0]
        out.append((r[0], len(s[i]), c, c is not None and r[0] == c))
    return sorted(out, key=repr)


def variants(seed=5, groups=6, size=25):
    """Texts and edited copies around the threshold, some of them edited again."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(groups):
        base = r.choices(words, k=r.randrange(5, 200))
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w))
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, small, "documents").collect()]
    assert sorted(map(tuple, neardup.op8_near_duplicates(spark, small).collect()), key=repr) == components(rows, 4)


def test_variants_and_tiles(spark, monkeypatch):
    rows = variants()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows, 5)
    assert sorted(map(tuple, neardup.near_duplicates(frame).collect()), key=repr) == want
    monkeypatch.setattr(neardup, "TILE", 3)  # many tiles a bucket
    assert sorted(map(tuple, neardup.near_duplicates(frame).collect()), key=repr) == want


def test_awkward_texts(spark, docs_folder):
    got = neardup.op8_near_duplicates(spark, docs_folder()).collect()
    assert sorted(map(tuple, got), key=repr) == components([r[:2] for r in awkward()], 4)


def test_one_of_each_group_stays_with_its_columns(spark, docs_folder):
    folder = docs_folder()
    docs = load(spark, folder, "documents")
    got = neardup.deduplicated(docs)
    assert got.columns == docs.columns
    want = {i for i, _, _, kept in components([r[:2] for r in awkward()], 5) if kept}
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(want)
    assert got.filter("doc_id is null").count() == 1


def test_one_id_with_several_texts(spark):
    """Rows that share an id are documents of their own: a near copy of another document goes, whatever its id keeps."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, base), (5, base + " more"), (5, other), (5, other + " tail"), (9, other), (5, ""), (5, None), (None, base), (None, other), (2, "x y z")]
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, text_hash string, ID string")
    got = neardup.deduplicated(frame)
    assert got.columns == frame.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None), key=repr)
    assert [k for k in kept if k[0] != 5] == [(2, "x y z"), (3, base)]
    fives = [t for i, t in kept if i == 5]
    assert sorted(t or "" for t in fives if not t) == ["", ""] and len([t for t in fives if t]) == 1 and next(t for t in fives if t).startswith(other)
    want = components(rows, 5)
    assert sorted(map(tuple, neardup.near_duplicates(frame).collect()), key=repr) == want


def test_rows_without_ids(spark):
    """Null ids meet by their texts, not each with every other."""
    rows = [(None, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(0, 400, 2)] + [(7, " ".join(f"w{j}" for j in range(1, 41)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(frame).collect()), key=repr) == components(rows, 5)


def test_empty_table(spark, docs_folder):
    assert neardup.op8_near_duplicates(spark, docs_folder([])).count() == 0


def test_pruning_bound():
    for n in (32, 128, 512):
        least = neardup.least_matches(n, 0.8, 1e-5)
        r = np.random.default_rng(1).binomial(n, 0.8, 100_000)
        assert (r < least).mean() < 2e-4 and least > n * 0.4


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    at = {}

    def root(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    got = stars(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "g").collect()
    assert {r["hi"]: r["lo"] for r in got} == {x: root(x) for x in at if root(x) != x}
    assert len(got) == len({r["hi"] for r in got})
