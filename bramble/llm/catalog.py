"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bramble.llm.archives import op7_warc
from bramble.llm.decontaminate import op2_decontamination
from bramble.llm.licenses import op4_licenses
from bramble.llm.maxent import op9_maxent
from bramble.llm.media import op3_media
from bramble.llm.neardup import op8_near_duplicates
from bramble.llm.packing import op5_packing
from bramble.llm.pii import op6_pii
from bramble.llm.quality import op1_quality
from bramble.llm.urls import op10_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_decontamination, op3_media, op4_licenses, op5_packing, op6_pii, op7_warc, op8_near_duplicates, op9_maxent, op10_url_filter)}


BITS = "".join(f"{i:04b}" for i in range(16))
#: A digest in hexadecimal digits, four bits each, read again in base32's five.
OP7 = f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(1, 41), lambda i: substr('{BITS}', 4 * (strpos('0123456789abcdef', substr(sha1(html), i, 1)) - 1) + 1, 4)), '') AS bits, html FROM p),
g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT d.page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN d.page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN d.page_id < top THEN top END AS refers_to
FROM d JOIN g ON d.html = g.html"""
OP8 = r"""
WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
h AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""


def oracle_sql() -> dict[str, str]:
    """SQL for the two whose rows it can express; the others are tested against brute force, round trips or held-out text."""
    return {"op7_warc": OP7, "op8_near_duplicates": OP8}
