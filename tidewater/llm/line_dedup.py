"""Site-relative line deduplication of web pages.

A page's html becomes lines of text (scripts, styles and comments go, block tags end a
line, other tags go, lines are trimmed of spaces, empty ones dropped). Per host, a line's
frequency is the number of pages that have it divided by the host's pages; lines above
``RATIO`` that at least ``MIN_PAGES`` pages have are boilerplate and go from every page.

Pages are parsed once, by a scan that is linear in the page whatever it leaves open, and
written with the hashes of their lines (64 bits; lines of one host with equal hashes would
count as one). Counts are partial sums over (host, line hash). A host's boilerplate is short (its lines
are on more than ``RATIO`` of the pages, so there are at most an average page's lines
divided by ``RATIO``); it meets the pages in an equi-join on host and one of ``SALTS``
parts of the host, so that a host with a third of all pages is spread.

Defined cases: a null url has the empty host; null or tagless html is text as it is, null
gives no lines; a line that a page repeats counts once; repeated rows are pages each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RATIO, MIN_PAGES, SALTS = 0.3, 3, 32

# Fixed patterns; the SQL statement of the result has the same.
DROP = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
BREAK = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|nav|article|header|footer|section|table|tr|td|th|br|title|head|body|html|main|aside|pre|blockquote)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


_OPEN = re.compile(r"<(?:(script|style)\b|!--)", re.I | re.A)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I | re.A) for k in ("script", "style")} | {"": re.compile("-->")}
_BREAK, _TAG = re.compile(BREAK, re.A), re.compile(TAG)


def _dropped(html: str) -> str:
    """``html`` with scripts, styles and comments (the pattern DROP) as line ends, in linear time.

    An element without an end is no match, and once one kind has no end any more, no later
    element of that kind has one; so no part of the text is searched again and again."""
    out, at, look, endless = [], 0, 0, set()
    while len(endless) < 3:
        m = _OPEN.search(html, look)
        if m is None:
            break
        kind, look = (m[1] or "").lower(), m.end()
        if kind in endless:
            continue
        body = m.end() if not kind else html.find(">", m.end()) + 1
        end = _CLOSE[kind].search(html, body) if body else None
        if end is None:
            endless.add(kind)
            continue
        out += (html[at : m.start()], "\n")
        at = look = end.end()
    return "".join([*out, html[at:]])


def _replaced(pattern, by: str, text: str) -> str:
    """Every tag that ``pattern`` starts ends at the next ``>``, so what follows the last one is left out."""
    end = text.rfind(">") + 1
    return pattern.sub(by, text[:end]) + text[end:]


def lines_of(html: str | None) -> list[str]:
    text = _replaced(_TAG, "", _replaced(_BREAK, "\n", _dropped(html or "")))
    return [x for x in (x.strip(" ") for x in text.split("\n")) if x]


_PAGE = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("lines", pa.list_(pa.string())), ("keys", pa.list_(pa.int64()))])


def _parsed(batches):
    """Lines of each page, and the distinct hashes of the lines."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            lines = [lines_of(html) for html in part.column(2).to_pylist()]
            keys = [sorted({xxh64_intdigest(x) - (1 << 63) for x in own}) for own in lines]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lines, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], schema=_PAGE)


_KEPT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])


def _cut(batches):
    """Pages without the lines whose hashes are in their ``gone``."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows = []
            part = batch.slice(a, 256)
            for page, host, lines, gone in zip(*(c.to_pylist() for c in part.columns)):
                kept = lines
                if gone:
                    gone = set(gone)
                    kept = [x for x in lines if xxh64_intdigest(x) - (1 << 63) not in gone]
                rows.append((page, host, len(lines), len(lines) - len(kept), "\n".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KEPT.types)], schema=_KEPT)


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, salts: int = SALTS) -> DataFrame:
    """Per page: page_id, host, n_lines, n_dropped, text (the kept lines).

    Pages are parsed once and written; counts and the last step read that table."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    rows = written(rows.mapInArrow(_parsed, "page_id long, host string, lines array<string>, keys array<long>"), "pages")
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"))
    seen = rows.select("host", F.explode("keys").alias("line"))
    seen = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = seen.join(hosts, "host").where(F.col("n") > F.col("pages") * F.lit(ratio)).groupBy("host").agg(F.collect_list("line").alias("common"))
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(salts)).cast("int"))
    met = salted.join(common, ["host", "salt"], "left")
    gone = F.array_intersect("keys", "common")  # by a hash set, linear in both
    return met.select("page_id", "host", "lines", gone.alias("gone")).mapInArrow(_cut, "page_id long, host string, n_lines long, n_dropped long, text string")


ORACLE = f"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id,
         lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{DROP}', chr(10), 'g'), '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g') AS t
  FROM pages),
l AS (SELECT k, page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM p),
n AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT k, host, unnest(lines) AS line FROM l) GROUP BY host, line HAVING count(*) >= {MIN_PAGES}),
b AS (SELECT c.host, list(c.line) AS common FROM c JOIN n ON c.host = n.host WHERE c.n > n.pages * CAST({RATIO} AS DOUBLE) GROUP BY c.host),
m AS (SELECT l.page_id, l.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM l LEFT JOIN b ON l.host = b.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM m
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))
