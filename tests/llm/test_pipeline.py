import re

from llm_cases import awkward
from test_neardup import components
from test_packing import check

import corpus_pipeline
from bramble.llm import decontaminate, packing, quality
from bramble.llm.common import Workspace, load


def ids(text):
    return [*packing.encoder(*packing.default_files())(text or ""), 0]


def test_stages(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    work = Workspace(spark, "stages")
    docs = load(spark, small, "documents")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = work.table(stage(spark, docs, small), name)
        if k < 4:
            assert docs.columns == seen[0].columns
        seen.append(docs)
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in seen[:5]]
    assert 0.7 * len(texts[0]) < len(texts[1]) < len(texts[0]) and texts[1].items() <= texts[0].items()
    assert set(texts[2]) == {i for i, _, _, kept in components(list(texts[1].items()), 5) if kept}
    items = [decontaminate.words(r["text"]) for r in load(spark, small, "benchmark").collect()]
    for i, t in texts[2].items():
        w = decontaminate.words(t)
        leaks = any(len(set(x) & set(w)) > 0.4 * len(set(x)) and decontaminate.search(w, x)[0] <= int(0.15 * len(x)) for x in items)
        assert leaks == (i not in texts[3])
    assert set(texts[4]) == set(texts[3])
    private = re.compile(r"\S+@\S+\.\w+|\b[0-9a-fA-F]{40}\b|(?<!\d)\d{16}(?!\d)")
    before = {x for t in texts[3].values() for x in private.findall(t)}
    assert before and not before & {x for t in texts[4].values() for x in private.findall(t)}
    check(seen[5].collect(), list(texts[4].items()), ids)
    run = corpus_pipeline.run(spark, small)
    assert run.count() == seen[5].count() and run.select("doc_id", "doc_tokens").distinct().exceptAll(seen[5].select("doc_id", "doc_tokens").distinct()).count() == 0


def test_awkward_documents(spark, docs_folder):
    labels = ([(i, 1, 0) for i in (3, 5, 7, 10)], "doc_id long, quality int, toxic int")
    bench = ([(1, "nothing of this is in any text at all")], "item_id long, text string")
    folder = docs_folder(labels=labels, benchmark=bench)
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert {None, 5, 7, 9}.issubset(got | {7}) and got <= {r[0] for r in awkward()}
    assert corpus_pipeline.run(spark, docs_folder([], labels=labels, benchmark=bench)).count() == 0


def test_quality_stage_learns_all_trusted_texts(spark, docs_folder, monkeypatch):
    """Bounds of a sample don't reach the pipeline: junk is rejected in every language."""
    monkeypatch.setattr(quality, "LANGUAGES", 1)
    monkeypatch.setattr(quality, "TRAINED", 1)
    words = {"en": "the cat dog sat on mat ran and to a".split(), "de": "der hund die katze und lief zu dem haus".split()}
    rows = [(2 * i + (g == "de"), " ".join(words[g][(i * j + j) % len(words[g])] for j in range(20)), g, "s", 1) for i in range(40) for g in words]
    rows += [(100, "#qz xv##" * 9, "en", "s", 1), (101, "#qz xv##" * 9, "de", "s", 1)]
    folder = docs_folder(rows, labels=([(r[0], 1, 0) for r in rows if r[0] < 100], "doc_id long, quality int, toxic int"))
    docs = load(spark, folder, "documents")
    kept = {x["doc_id"] for x in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    assert not kept & {100, 101} and len(kept) >= 70
