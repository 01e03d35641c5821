import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.llm import packing
from bramble.llm.common import load

from llm_cases import awkward


@pytest.fixture(scope="module")
def ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, ids):
    """Every id of every document lies in one piece, and sequences are full or powers of two."""
    by, sequences, have = {}, {}, {}
    for doc, text in texts:
        by.setdefault(doc, []).append(np.array(ids(text), "<u4"))
    for r in rows:
        have.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(have)
    for doc, lists in by.items():
        assert sum(r["length"] for r in have[doc]) == sum(map(len, lists))
        assert {r["doc_tokens"] for r in have[doc]} == {len(x) for x in lists}
        if len(lists) == 1:
            at = 0
            for r in sorted(have[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0
                assert r["ids_crc32"] == zlib.crc32(lists[0][at : at + r["length"]].tobytes())
                at += r["length"]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_ids_and_pieces(spark, small, ids):
    texts = [tuple(r) for r in load(spark, small, "documents").select("doc_id", "text").collect()]
    check(packing.op5_packing(spark, small).collect(), texts, ids)


def test_awkward_texts(spark, docs_folder, ids):
    rows = [*awkward(), (20, "a <|endoftext|> b<|endoftext|>", None, "s", 1), (21, "x" * 5000 + "<|endoftext|>" + " " * 3000 + "1" * 2000, None, "s", 1), (22, "<|endoftext|", None, "s", 1)]
    check(packing.op5_packing(spark, docs_folder(rows)).collect(), [r[:2] for r in rows], ids)


def test_empty_table(spark, docs_folder):
    assert packing.op5_packing(spark, docs_folder([])).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60))
def test_balanced(lengths):
    pieces = packing.balance(lengths, 64, 1.0, 1 / 64)
    fill, cover = {}, {}
    for d, start, n, s, offset in pieces:
        assert offset == fill.get(s, 0)
        fill[s] = offset + n
        cover.setdefault(d, []).append((start, n))
    assert all(n <= 64 and n & (n - 1) == 0 for n in fill.values())
    assert len(fill) == len(packing.room(sum(lengths), 64))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(cover[d]):
            assert start == at
            at += size
        assert at == n


def test_small_buffers_and_ids(spark):
    rows = spark.createDataFrame([(i, "some words here " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    got = packing.pack(rows, *packing.default_files(), buffer_tokens=500, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    with pytest.raises(ValueError):
        packing.pack(rows, "", "", capacity=1000)


def plainly(lengths, capacity, linear, quadratic):
    """The rule by looking at every sequence for every piece."""
    out, sequence, tails = [], 0, []
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((n % capacity, d, n - n % capacity))
    left = packing.room(sum(t[0] for t in tails), capacity)
    sizes, cost = list(left), [0.0] * len(left)
    while tails:
        n, d, start = tails.pop(tails.index(min(tails, key=lambda t: (-t[0], t[1:]))))
        s = min((s for s in range(len(left)) if left[s] >= n), key=lambda s: (cost[s], s), default=None)
        if s is None:
            s = min((s for s in range(len(left)) if left[s]), key=lambda s: (cost[s], s))
        take = min(n, left[s])
        out.append((d, start, take, sequence + s, sizes[s] - left[s]))
        left[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            tails.append((n - take, d, start + take))
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 150), max_size=80), st.sampled_from([(1.0, 1 / 64), (0.0, 1.0), (1.0, 0.0)]))
def test_least_cost_among_all(lengths, weights):
    assert packing.balance(lengths, 64, *weights) == plainly(lengths, 64, *weights)


@settings(deadline=None, max_examples=300)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sx1<|")), max_size=60))
def test_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not _both:
        _both.extend((packing.encoder(*packing.default_files()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))))
    fast, named = _both
    for t in (text, f"{text}<|endoftext|>{text}", text * 40):
        assert fast(t) == named.encode(t, add_special_tokens=False).ids


_both: list = []
