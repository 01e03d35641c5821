import hashlib
import re
import zlib
from html import unescape

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from bramble.llm import media
from bramble.llm.common import load

from llm_cases import awkward


@settings(deadline=None)
@given(st.binary(max_size=1000))
def test_images_are_lossless(data):
    payload = media.pad(data)
    assert payload and len(payload) % 64 == 0 and payload.rstrip(b"\0") == data.rstrip(b"\0")
    assert media.from_png(media.to_png(payload)) == payload


def test_query_against_hashing(spark, docs_folder):
    got = media.op3_media(spark, docs_folder()).collect()
    want = []
    for doc_id, text, *_ in awkward():
        data = (text or "").encode()
        payload = media.pad(data)
        stored = media.to_png(payload)
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.describe(payload)))
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, docs_folder):
    assert media.op3_media(spark, docs_folder([])).count() == 0


def test_items_keep_order_and_captions():
    html = """<p>One <b>bold</b></p><figure><img src="sha256:a"><img src="b.png" alt="alt"><figcaption>Two &amp; two</figcaption></figure>
    tail<script>no</script><img src="c" alt="loose"><figure><figcaption>alone</figcaption></figure><img>"""
    got = [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.items(html)]
    assert got == [
        (0, "text", "One bold", None), (1, "media", "sha256:a", "Two & two"), (2, "media", "b.png", "Two & two"), (3, "text", "tail", None),
        (4, "media", "c", "loose"), (5, "text", "alone", None),
    ]
    assert media.items(None) == [] and media.items("") == [] and media.items("<p></p>") == []


def test_references_resolve_in_place(spark):
    known, unknown = "a" * 64, "b" * 64
    html = f'<p>before</p><img src="sha256:{known}" alt="k"><p>between</p><img src="sha256:{unknown}" alt="u"><p>after</p><img src="sha256:{known}">'
    parsed = media.parse(spark.createDataFrame([(1, html), (2, html)], "row long, html string"))
    payloads = spark.createDataFrame([(known, 7)], "digest string, size long")
    for r in media.resolve(parsed, payloads).collect():
        assert [(i.item.kind, i.item.caption, i.media and i.media.size) for i in r["items"]] == [("text", None, None), ("media", "k", 7), ("text", None, None), ("media", "u", None), ("text", None, None), ("media", None, 7)]
    assert isinstance(r, Row)


def seen(html):
    return [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.items(html)]


def test_captions_in_any_place():
    assert seen('<figure><figcaption>cap</figcaption><img src="a" alt="alt"></figure>') == [("media", "a", "cap")]
    assert seen('<figure><img src="a"><figcaption>cap</figcaption><img src="b" alt="x"></figure>after') == [("media", "a", "cap"), ("media", "b", "cap"), ("text", "after", None)]
    nested = '<figure><img src="o"><figure><img src="i"><figcaption>in</figcaption></figure><figure><img src="j"></figure><figcaption>out</figcaption></figure>'
    assert seen(nested) == [("media", "o", "out"), ("media", "i", "in"), ("media", "j", "out")]
    assert seen('<p>a</p><figure><figure><img src="i"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure><p>b</p>') == [("text", "a", None), ("media", "i", "in"), ("text", "out", None), ("text", "b", None)]
    assert seen('<figcaption>loose</figcaption><figure><img src="a"><figcaption>open') == [("text", "loose", None), ("media", "a", "open")]
    assert seen("</figure></figcaption>x") == [("text", "x", None)]


def test_pages_keep_their_order(spark, small):
    """All pages: the words and references of a page, in the order of its source."""
    pages = load(spark, small, "pages").select(F.col("page_id").alias("row"), "html")
    html = {r["row"]: r["html"] for r in pages.collect()}
    got = media.resolve(media.parse(pages), spark.createDataFrame([], "digest string, size long")).collect()
    assert {r["row"] for r in got} == set(html)
    for r in got:
        assert [i.position for i in r["items"]] == list(range(len(r["items"])))
        at, source = 0, " ".join(unescape(html[r["row"]]).split())
        for i in r["items"]:
            for word in (i.item.text or i.item.ref).split():
                at = source.find(word, at)
                assert at >= 0
        assert sum(i.item.kind == "media" for i in r["items"]) == len(re.findall(r"<(?:img|video|audio|source)\b[^>]*\bsrc=[^>]", html[r["row"]]))


def test_empty_pages_and_repeated_digests(spark):
    digest = "c" * 64
    parsed = media.parse(spark.createDataFrame([(1, None), (2, ""), (3, f'<img src="sha256:{digest}">')], "row long, html string"))
    got = {r["row"]: r["items"] for r in media.resolve(parsed, spark.createDataFrame([(digest, 1), (digest, 1)], "digest string, size long")).collect()}
    assert got[1] == got[2] == [] and [i.media.size for i in got[3]] == [1]
