import math
import random
from collections import Counter

from llm_cases import awkward

from bramble.llm import quality
from bramble.llm.common import Workspace, load

LABELS = "doc_id long, quality int, toxic int, lang string"


class Plain:
    """The model written out over dictionaries."""

    def __init__(self, texts):
        n = quality.ORDER
        top = Counter()
        for t in texts:
            t = "\x02" * (n - 1) + t + "\x03"
            top.update(t[i : i + n] for i in range(len(t) - n + 1))
        self.c = {n: top}
        for k in range(n - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d = {}
        for k, c in self.c.items():
            m = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
            y = m[0] / (m[0] + 2 * m[1])
            raw = (1 - 2 * y * m[1] / m[0], 2 - 3 * y * m[2] / m[1], 3 - 4 * y * m[3] / m[2])
            self.d[k] = [0] + [min(max(x, 0.1), most) for x, most in zip(raw, (0.9, 1.9, 2.9))]
        self.kinds = len(self.c[1]) + 1
        self.under = {}
        for k, c in self.c.items():
            for g, v in c.items():
                self.under.setdefault(g[:-1], []).append(v)

    def p(self, gram):
        p = 1 / self.kinds
        for k in range(1, len(gram) + 1):
            part = gram[len(gram) - k :]
            under = self.under.get(part[:-1])
            if under:
                v, d = self.c[k].get(part, 0), self.d[k]
                p = max(v - d[min(v, 3)], 0) / sum(under) + sum(d[min(x, 3)] for x in under) / sum(under) * p
        return p

    def perplexity(self, text):
        n = quality.ORDER
        t = "\x02" * (n - 1) + text + "\x03"
        logs = [math.log10(self.p(t[i : i + n])) for i in range(len(t) - n + 1)]
        return 10 ** (-sum(logs) / len(logs))


TEXTS = ["the cat sat on the mat and the dog sat on the cat", "a man and a dog and a cat ran to the mat", "dogs ran, cats sat"]


def test_perplexity_against_dictionaries(spark):
    rows = spark.createDataFrame([("en", t) for t in TEXTS] + [("xx", "qqqq zzzz qqqq")], "lang string, text string")
    model, plain = quality.Model(quality.kneser_ney(quality.grams(rows), Workspace(spark, "test")).toArrow()), Plain(TEXTS)
    some = ["the cat ran", "zebra!", "the dog sat on the mat and ran", "x", "ünï", "the cat " * 300]
    for text, got in zip(some, model.perplexities(["en"] * len(some), some)):
        assert math.isclose(got, plain.perplexity(text), rel_tol=1e-4)
    assert model.perplexities(["de", "en", "en"], ["the", "", None]) == [None, None, None]


def test_slices_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([("en", t) for t in TEXTS], "lang string, text string")
    model = quality.Model(quality.kneser_ney(quality.grams(rows), Workspace(spark, "test")).toArrow())
    whole = model.perplexities(["en"] * 3, [TEXTS[0] * 5, TEXTS[1], TEXTS[2]])
    monkeypatch.setattr(quality, "SLICE", 17)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(model.perplexities(["en"] * 3, [TEXTS[0] * 5, TEXTS[1], TEXTS[2]]), whole))


def test_shares_sum_to_one(spark):
    plain = Plain(TEXTS)
    for context in ("the ", "zzzz", "at o", "\x02\x02\x02\x02"):
        assert math.isclose(sum(plain.p(context + c) for c in plain.c[1]) + plain.p(context + "\x00"), 1, rel_tol=1e-9)


def test_junk_is_rejected_and_clean_text_kept(spark):
    folder = "/root/testdata/sf0.01"
    quality_of = {r["doc_id"]: (r["quality"], r["toxic"]) for r in load(spark, folder, "labels").collect()}
    got = quality.op1_quality(spark, folder).collect()
    assert len(got) == 1000
    clean = [r["kept"] for r in got if quality_of.get(r["doc_id"]) == (1, 0)]
    junk = [r["kept"] for r in got if quality_of.get(r["doc_id"], (1, 0))[0] == 0]
    assert sum(clean) > 0.95 * len(clean) and sum(junk) < 0.15 * len(junk)


def test_verdicts_against_dictionaries(spark, docs_folder, monkeypatch):
    """Model, limits and verdicts of whole tables, worked out again over dictionaries from the sample that was drawn."""
    r = random.Random(4)
    words = {"en": "the cat dog sat on mat ran and to a".split(), "de": "der hund die katze und lief zu dem haus".split()}
    rows = [(i, " ".join(r.choices(words[g], k=r.randrange(4, 30))) if i % 7 else "".join(r.choices("qzxv #", k=40)), g, "s", 1) for i in range(160) for g in [("en", "de")[i % 2]]]
    rows += [(500, rows[3][1], "de", "s", 1), (501, "", "en", "s", 1), (502, None, "de", "s", 1), (503, "bonjour", "fr", "s", 1), (504, "salut", "it", "s", 1)]
    told = [(i, int(i % 7 > 0), 0, "x") for i in range(0, 160) if i % 3] + [(503, 1, 0, ""), (504, 0, 0, "")]
    folder = docs_folder(rows, labels=(told, LABELS))
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    place, trusted = quality.trained(docs, labels, Workspace(spark, "again"), 20)
    seen = {x["doc_id"]: x["seen"] for x in trusted.collect()}
    assert set(seen) == {t[0] for t in told if t[1]} and 30 <= sum(seen.values()) <= 41
    want = {}
    for g in ("en", "de", "fr"):
        plain = Plain([x[1] for x in rows if x[2] == g and seen.get(x[0])])
        score = {x[0]: plain.perplexity(x[1]) if x[1] else None for x in rows if x[2] == g}
        new = sorted(score[i] for i in score if seen.get(i) is False) or sorted(score[i] for i in score if i in seen)
        limit = new[max(0, math.ceil(0.9 * len(new)) - 1)]
        want |= {i: (p, limit, p is not None and p <= limit * (1 + 1e-6)) for i, p in score.items()}
    want[504] = (None, None, True)
    got = quality.judge(docs, labels, sample=20, quantile=0.9).collect()
    assert len(got) == len(rows)
    for x in got:
        p, limit, kept = want[x["doc_id"]]
        assert x["kept"] == kept and (p is None) == (x["perplexity"] is None) and (limit is None) == (x["limit"] is None)
        assert p is None or math.isclose(x["perplexity"], p, rel_tol=1e-4) and math.isclose(x["limit"], limit, rel_tol=1e-4)
    kept = quality.filtered(docs, labels, sample=20, quantile=0.9)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i in want if want[i][2])
    monkeypatch.setattr(quality, "LANGUAGES", 1)  # the one with most trusted texts
    few = {x["lang"]: x["limit"] is None for x in quality.judge(docs, labels, sample=20).collect()}
    assert sum(not x for x in few.values()) == 1


def test_clashing_columns(spark, docs_folder):
    rows = spark.createDataFrame([(1, "some text", "en", "p", "l", 2.0), (2, "", "en", "p", "l", 2.0)], "doc_id long, text string, lang string, Perplexity string, perplexity_lang string, judged_limit double")
    got = quality.filtered(rows, spark.createDataFrame([(1, 1, 0, "")], LABELS)).collect()
    assert [tuple(x) for x in got] == [(1, "some text", "en", "p", "l", 2.0)]


def test_awkward_texts(spark, docs_folder):
    labels = [(i, 1, 0, "clash") for i in (1, 2, 3, 5, 5, 7, 10, 11)] + [(6, 1, 1, ""), (9, 0, 0, ""), (None, 1, 0, ""), (77, None, None, "")]
    folder = docs_folder(labels=(labels, LABELS))
    got = quality.op1_quality(spark, folder).collect()
    assert len(got) == len(awkward())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["kept"], r["perplexity"] is None, r["limit"] is None))
    assert by[1] == by[2] == {(False, True, False)}
    assert by[6] == by[9] == by[8] == {(True, True, True)}  # no trusted text in these languages
    assert len(by[5]) == 1
    docs = load(spark, folder, "documents")
    kept = quality.filtered(docs, load(spark, folder, "labels"))
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_empty_tables(spark, docs_folder):
    assert quality.op1_quality(spark, docs_folder([], labels=([], LABELS))).count() == 0
    got = quality.op1_quality(spark, docs_folder(None, labels=([], LABELS))).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {1, 2}


def test_counts_of_any_text(monkeypatch):
    """Counts of texts of all sizes of characters, with pads inside, and where keys don't fit 64 bits."""
    r = random.Random(5)
    texts = ["\x02" * 4 + t + "\x03" for t in ["", "a\x02\x02b\x03", "ü€𝄞" * 5, "".join(chr(r.choice([r.randrange(3, 0xD800), r.randrange(0x10000, 0x20000)])) for _ in range(9000))] * 2]
    want = Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))
    found, times = quality.count(texts)
    assert len(found) == len(want) and dict(zip(found.to_pylist(), times.tolist())) == want


def test_all_trusted_texts_are_learnt(spark, docs_folder, monkeypatch):
    """Model, limits and verdicts over dictionaries from every trusted text, each tested by the other half's model; also from parts of the model."""
    r = random.Random(6)
    words = {"en": "the cat dog sat on mat ran and to a".split(), "de": "der hund die katze und lief zu dem haus".split()}
    rows = [(i, " ".join(r.choices(words[g], k=r.randrange(4, 30))) if i % 7 else "".join(r.choices("qzxv #", k=40)), g, "s", 1) for i in range(120) for g in [("en", "de")[i % 2]]]
    rows += [(500, rows[3][1], "de", "s", 1), (501, "", "en", "s", 1), (502, None, "de", "s", 1), (503, "bonjour", "fr", "s", 1), (504, "salut", "it", "s", 1)]
    told = [(i, int(i % 7 > 0), 0, "x") for i in range(0, 120) if i % 3] + [(503, 1, 0, ""), (504, 0, 0, ""), (501, 1, 0, "")]
    folder = docs_folder(rows, labels=(told, LABELS))
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    half_of = {x["doc_id"]: x["half"] for x in docs.select("doc_id", quality.half().alias("half")).collect()}
    good = {t[0] for t in told if t[1]}
    want = {}
    for g in ("en", "de", "fr"):
        own = [x for x in rows if x[2] == g]
        learnt = [x for x in own if x[0] in good and x[1]]
        plain, halves = Plain([x[1] for x in learnt]), [[x[1] for x in learnt if half_of[x[0]] == h] for h in (0, 1)]
        assert g == "fr" or all(len(x) > 5 for x in halves)
        models = [Plain(x) for x in halves] if g != "fr" else [plain, plain]
        new = sorted(models[1 - half_of[x[0]]].perplexity(x[1]) for x in learnt)
        limit = new[max(0, math.ceil(0.9 * len(new)) - 1)]
        score = {x[0]: plain.perplexity(x[1]) if x[1] else None for x in own}
        want |= {i: (p, limit, p is not None and p <= limit * (1 + 1e-6)) for i, p in score.items()}
    want[504] = (None, None, True)

    def check():
        got = quality.judge(docs, labels, quantile=0.9).collect()
        assert len(got) == len(rows)
        for x in got:
            p, limit, kept = want[x["doc_id"]]
            assert x["kept"] == kept and (p is None) == (x["perplexity"] is None) and (limit is None) == (x["limit"] is None)
            assert p is None or math.isclose(x["perplexity"], p, rel_tol=1e-4) and math.isclose(x["limit"], limit, rel_tol=1e-4)

    check()
    monkeypatch.setattr(quality, "HELD", 300)
    monkeypatch.setattr(quality, "IDS", 10)
    check()


def test_parts_and_slices_change_nothing(spark, monkeypatch):
    work = Workspace(spark, "test")
    table = quality.kneser_ney(quality.grams(spark.createDataFrame([(g, t) for g in ("en", "de") for t in TEXTS[g == "de" :]], "lang string, text string")), work)
    monkeypatch.setattr(quality, "HELD", 200)
    places = quality.in_parts(table, work.sub("model"), work, "part")
    assert len(places) > 2 and quality.judged(tuple(places)) == {"en", "de"}
    langs, some = ["en", "de", "de", "en"], ["the cat ran", "zebra! the dog", "ünï the mat", TEXTS[1] * 3]
    whole = quality.Model(table.toArrow()).perplexities(langs, some)
    monkeypatch.setattr(quality, "SLICE", 17)
    for most in (23, 1000):
        got = quality.perplexities(lambda *args: quality.logs_in_parts(places, *args), langs, some, most)
        assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(got, whole))
