import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from bramble.llm import urls
from bramble.llm.common import Workspace, load
from bramble.plans.advisor import plan_text

PAGES = "page_id long, url string, html string, rule string, verdict string"
LABELS = "doc_id long, quality int, toxic int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def rule(host, path, rules):
    fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None)


ODD = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://example.org/es/x", "https://a.example.org/en/1?q", "http://x.com/de/#f", "http://x.com?/de/", "http://x.com#/de/", "http://notexample.org/es/", "http://com/fr/", "a://b://c/d", "http://ÄÖ.org/p", "http://h\n/x", "http://x.example.net/fr/" + "y" * 100_000]


def test_hosts_paths_and_rules(spark, folder):
    rows = [(i, u, None, "a", "b") for i, u in enumerate(ODD)] + [(4, ODD[4], None, "a", "b"), (None, ODD[5], None, None, None)]
    got = urls.op10_url_filter(spark, folder(pages=(rows, PAGES), labels=([(0, 1, 0), (1, None, None), (None, 0, 1), (1, 0, 0)], LABELS))).collect()
    want = []
    for i, u, *_ in rows:
        h, p = parts(u)
        r = rule(h, p, urls.RULES)
        want.append((i, h, p, r))
        mine = [x for x in got if x["page_id"] == i and (x["host"], x["path"]) == (h, p)]
        assert mine and all(x["verdict"] == urls.RULES[r] if r else x["verdict"] in ("allow", "block") for x in mine)
    assert sorted(((x["page_id"], x["host"], x["path"], x["rule"]) for x in got), key=repr) == sorted(want, key=repr)


def test_query(spark, small):
    pages = {r["page_id"]: r["url"] for r in load(spark, small, "pages").collect()}
    got = urls.op10_url_filter(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        h, p = parts(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (h, p, rule(h, p, urls.RULES))
    assert len(urls.op10_url_filter(spark, small).columns) == 6


@pytest.fixture
def labelled(spark):
    rows = []
    for i in range(300):
        spam = i % 3 == 0
        rows.append((f"https://{'www' if i % 2 else 'm'}.site{i % 7}.example.com/{'casino' if spam else 'news'}/{'win' if spam and i % 2 else 'a'}/{i}?ref={i}", "block" if spam else "allow"))
    return spark.createDataFrame(rows, "url string, verdict string")


def counted(baskets, support, confidence, longest):
    """All rules of up to ``longest`` tokens by counting, but those no surer than one on all their tokens but one."""
    least, found = max(urls.FLOOR, support * len(baskets)), {}
    every = sorted({x for b, _ in baskets for x in b})
    for n in range(1, longest + 1):
        for some in combinations(every, n):
            have = [v for b, v in baskets if b.issuperset(some)]
            for v in ("allow", "block"):
                if have.count(v) >= least and have.count(v) >= confidence * len(have):
                    found[frozenset(some), v] = (round(have.count(v) / len(have), 9), round(have.count(v) / len(baskets), 9))
    return {(some, v): x for (some, v), x in found.items() if all(x[0] > found[some - {t}, v][0] for t in some if (some - {t}, v) in found)}


def written_out(rules):
    """Rules token by token: a part stands for any of its tokens."""
    return {(frozenset(some), r["verdict"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in rules for some in product(*r["tokens"])}


def test_rules_against_counting(spark, labelled):
    support, confidence = 0.02, 0.7
    baskets = [(frozenset(r["t"]), r["verdict"]) for r in labelled.select(urls.tokens(F.col("url")).alias("t"), "verdict").collect()]
    got = written_out(urls.mine(labelled, support=support, confidence=confidence).collect())
    want = counted(baskets, support, confidence, 3)
    assert want and {k: v for k, v in got.items() if len(k[0]) <= 3} == want


def test_random_rules_against_counting(spark):
    r = random.Random(3)
    rows = []
    for _ in range(240):
        words = [w for i, w in enumerate("abcdefgh") if r.random() < (0.15, 0.5, 0.8)[i % 3]]
        bad = "a" in words and "b" in words or r.random() < 0.15
        rows.append((f"http://{r.choice(('x', 'y'))}.org/{'/'.join(words)}", "block" if bad else "allow"))
    frame = spark.createDataFrame(rows, "url string, verdict string")
    baskets = [(frozenset(r["t"]), r["verdict"]) for r in frame.select(urls.tokens(F.col("url")).alias("t"), "verdict").collect()]
    got = written_out(urls.mine(frame, support=0.03, confidence=0.75).collect())
    want = counted(baskets, 0.03, 0.75, 3)
    assert len(want) > 5 and {k: v for k, v in got.items() if len(k[0]) <= 3} == want


def test_long_addresses_and_templates_end(spark):
    """One address of 40 words, and a template of 30 on many rows, some of whose words occur elsewhere."""
    rows = [(f"https://site{i % 5}.org/a/{'news' if i % 2 else 'shop'}", "allow") for i in range(100)]
    rows += [("https://site1.org/" + "/".join(f"w{'abcdefghij'[i % 10]}{'klmn'[i // 10]}" for i in range(40)), "block")]
    words = "/".join(f"t{'abcdefghij'[i % 10]}{'klm'[i // 10]}" for i in range(30))
    rows += [(f"https://site2.org/{words}", "block" if i % 4 else "allow") for i in range(24)] + [("https://site3.org/tak/tbk", "allow")] * 3
    rules = urls.mine(spark.createDataFrame(rows, "url string, verdict string"), confidence=0.7).collect()
    assert len(rules) < 200 and any(r["verdict"] == "block" and any(len(p) > 20 for p in r["tokens"]) for r in rules)


def test_verdicts_against_all_rules(spark, labelled):
    rules = Workspace(spark, "test").table(urls.mine(labelled, support=0.02), "rules")
    kept = [(some, v, *x, len(some)) for (some, v), x in written_out(rules.collect()).items()]
    new = Workspace(spark, "new").table(spark.createDataFrame([(1, "https://m.other.example.com/casino/9"), (2, "https://x.example.com/news/1"), (3, "ftp://elsewhere.example.org/plain"), (4, None)], "id long, url string"), "urls")
    told = {r["id"]: set(r["t"]) for r in new.select("id", urls.tokens(F.col("url")).alias("t")).collect()}
    out = urls.judge(new, rules, {})
    for r in out.collect():
        fit = [(c, s, n, v) for t, v, c, s, n in kept if t <= told[r["id"]]]
        assert r["verdict"] == (max(fit)[3] if fit else "allow")
    assert {r["id"]: r["verdict"] for r in out.collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    text = plan_text(out)
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "ExistingRDD]"))


def test_ties_long_addresses_and_clashing_columns(spark):
    tie = [("http://a.org/left/right", "allow"), ("http://a.org/left/right", "block"), ("http://b.org/left", "allow"), ("http://b.org/right", "block")] * 4
    rules = Workspace(spark, "test").table(urls.mine(spark.createDataFrame(tie, "url string, verdict string"), confidence=0.5), "rules")
    rows = spark.createDataFrame([(1, "http://c.org/left/right", "h", "v", "x"), (2, "http://c.org/" + "y/" * 100_000 + "left", None, None, None)], "id long, url string, Host string, verdict string, url_tokens string")
    got = {r["id"]: r for r in urls.judge(rows, rules, {}).collect()}
    assert list(got[1].asDict()) == ["id", "url", "url_tokens", "host", "path", "rule", "verdict", "confidence"]
    assert got[1]["host"] == "c.org" and got[1]["url_tokens"] == "x" and got[1]["verdict"] == "block" and len(got[2]["path"]) == 200_005


def test_empty_tables(spark, folder):
    f = folder(pages=([], PAGES), labels=([], LABELS))
    assert urls.op10_url_filter(spark, f).count() == 0


def test_a_label_that_takes_four_tokens_is_learnt(spark):
    rows = []
    for i in range(160):
        a, b, c, d = (i >> k & 1 for k in range(4))
        rows.append((f"{'http' if a else 'https'}://{'shop' if b else 'blog'}.{'one' if c else 'two'}.org/{'win' if d else 'read'}", "block" if a and b and c and d else "allow"))
    frame = spark.createDataFrame(rows, "url string, verdict string")
    rules = Workspace(spark, "test").table(urls.mine(frame), "rules")
    block = [r for r in rules.collect() if r["verdict"] == "block"]
    assert block and all(len(r["tokens"]) >= 4 for r in block)
    got = {(r["url"], r["verdict"]) for r in urls.judge(frame.select("url"), rules, {}).collect()}
    assert got == set(rows)
