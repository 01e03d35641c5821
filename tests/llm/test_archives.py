import base64
import gzip
import hashlib
import io
import random

from bramble.llm import archives
from bramble.llm.common import load

PAGES = "page_id long, url string, html string, digest string, refers_to string, path string"


def expected(rows):
    largest = {}
    for page, html in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        top = largest.get(html or "")
        revisit = page is not None and page != top
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_query(spark, small):
    rows = [(r["page_id"], r["html"]) for r in load(spark, small, "pages").collect()]
    assert sorted(map(tuple, archives.op7_warc(spark, small).collect()), key=repr) == expected(rows)


def test_awkward_pages(spark, folder):
    long = "<p>long</p>" * 30_000
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b/\r\nX: y", "same"), (4, "u", "same"), (4, "u", "same"), (9, "u", "same"), (9, "u", "same"), (None, "u", "same"), (None, None, "lone"), (-5, "é ü", long), (2**62, "z", long), (6, "w", "WARC/1.1 \x1f\x8b")]
    wide = [(*r, "x", "y", "z") for r in rows]
    got = archives.op7_warc(spark, folder(pages=(wide, PAGES))).collect()
    assert sorted(map(tuple, got), key=repr) == expected([(r[0], r[2]) for r in rows])


def test_empty_table(spark, folder):
    assert archives.op7_warc(spark, folder(pages=([], PAGES))).count() == 0


def test_ids_in_records():
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        assert archives.page_of(f"<{archives.record_id(n)}>") == n
    assert archives.page_of(archives.record_id(None)) is None


class File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_any_split_owns_each_record_once():
    random.seed(2)
    raw = [archives.record(i, f"http://h/{i}", random.randbytes(random.randrange(300)).hex().encode(), None if i % 3 else 1, "2024-01-01T00:00:00Z") for i in range(60)]
    data = b"".join(gzip.compress(r) for r in raw)
    whole = io.BytesIO(data)
    assert gzip.GzipFile(fileobj=whole).read() == b"".join(raw)
    for step in (37, 211, 1000, len(data)):
        got = [x for a in range(0, len(data), step) for x in archives.members(File(data), len(data), a, min(len(data), a + step), block=64)]
        assert got == raw


def test_magic_inside_a_member_is_no_record():
    inner = gzip.compress(b"not a record at all")
    payload = random.Random(3).randbytes(5000) + inner + b"\x1f\x8b\x08" * 50
    raw = [archives.record(i, "u", payload, None, "d") for i in range(3)]
    data = b"".join(gzip.compress(r, 0) for r in raw)  # stored: the magic shows in the file
    got = [x for a in range(0, len(data), 500) for x in archives.members(File(data), len(data), a, min(len(data), a + 500), block=512)]
    assert got == raw and archives.parse(got[0])[2] == len(payload)
