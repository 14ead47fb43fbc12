"""WARC fixity audit with Merkle trees over records and ordered offset ranges.

An archive is files of records at byte offsets. Level 0 of the tree has a digest per record, level 1
one per range of RANGE_BYTES bytes of a file, level 2 one per FANOUT ranges, level 3 one per file, levels 4,
5 and 6 one per FILES nodes of the level below, level 7 the root. A node's digest is taken over its children in
order of offset, with their bounds; no node has more children than fit its range, and the root FILES at most for
4 billion files, so nothing unbounded meets in a row.

Two replicas are compared from the root down: the children of nodes that differ are joined, and only
they, until the records of the ranges that differ are compared one by one.

Edge cases: null urls and bodies count as empty; records with null ids stand in NULL_FILES files before the others, by a
hash of the url, and without one by a hash of the body, so that an altered one counts as missing and extra; of records that
repeat an id those with equal digests are paired first, and what is left of them by the order in which they stand, so one altered
record is one line; two empty archives have equal roots and the audit is empty; a record that only moved, because what stands before it changed size, isn't corrupt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import materialise

RANGE_BYTES = 1 << 18
FANOUT = 64
FILES = 256
RECORDS_PER_FILE = 512
NULL_FILES = 1024
LEVELS = 7
# (expression of the parent's a, of its b) for the nodes of each level; a: files, b: ranges.
PARENTS = {1: ("a", f"b div {FANOUT}"), 2: ("a", "0L"), **{level: (f"a div {FILES}", "0L") for level in (3, 4, 5)}, 6: ("0L", "0L")}


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Records as a WARC file has them: file, record, nth (of equal ids), offset, size, digest.

    A file holds per_file ids in order; a record's digest is the SHA-256 of all its bytes.
    """
    text = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce(body, F.lit(""))).cast("string"),
        F.lit("\r\n\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"),
    )
    raw = pages.select(F.expr(f"coalesce(cast(`{key}` AS bigint) div {per_file}, -1 - pmod(xxhash64(coalesce(`{url}`, `{body}`, '')), {NULL_FILES}))").alias("file"), F.col(key).cast("long").alias("record"), text.alias("t"))
    hashed = raw.select("file", "record", F.octet_length("t").cast("long").alias("size"), F.sha2("t", 256).alias("digest"))
    order = "PARTITION BY file ORDER BY record, digest"
    return hashed.selectExpr(
        "file", "record", "size", "digest",
        f"coalesce(sum(size) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset",
        "row_number() OVER (PARTITION BY file, record ORDER BY digest) AS nth",
    )


def tree(records: DataFrame, range_bytes: int = RANGE_BYTES) -> list[DataFrame]:
    """The levels of the tree, 0 to LEVELS, each written to the shared folder: the next is made of it, and so plans stay short."""
    leaves = records.selectExpr("file AS a", f"offset div {range_bytes} AS b", "record", "nth", "offset", "offset + size AS until", "digest")
    levels = [materialise(leaves, "fixity-records")]
    children = "struct(offset, record, nth, until, digest)"
    for level in range(1, LEVELS + 1):
        a, b = PARENTS.get(level - 1, ("a", "b"))
        up = levels[-1].selectExpr(f"{a} AS a", f"{b} AS b", "offset", "until", "digest", "record" if level == 1 else "a AS record", "nth" if level == 1 else "b AS nth")
        up = up.groupBy("a", "b").agg(F.expr(f"array_sort(collect_list({children}))").alias("c"), F.min("offset").alias("offset"), F.max("until").alias("until"))
        joined = "concat_ws(';', transform(c, x -> concat_ws(',', x.offset, x.until, x.digest)))"
        up = up.selectExpr("a", "b", "offset", "until", f"sha2({joined}, 256) AS digest")
        levels.append(materialise(up, f"fixity-level{level}"))
    return levels


def audit(mine: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """file, record, offset and status (altered, missing or extra in the other replica) of what differs."""
    keys, bad = ["a", "b"], None
    for level in range(LEVELS, 0, -1):
        left, right = mine[level], other[level]
        if bad is not None:
            pa, pb = PARENTS[level]
            parents = bad.withColumnsRenamed({"a": "pa", "b": "pb"})
            left, right = (x.withColumns({"pa": F.expr(pa), "pb": F.expr(pb)}).join(parents, ["pa", "pb"], "left_semi") for x in (left, right))
        left, right = left.select(*keys, F.col("digest").alias("x")), right.select(*keys, F.col("digest").alias("y"))
        bad = materialise(left.join(right, keys, "full").where("NOT x <=> y").select(*keys), "fixity-differ")
    left, right = (x[0].join(bad, keys, "left_semi") for x in (mine, other))
    twins = "row_number() OVER (PARTITION BY a, record, digest ORDER BY offset)"
    left = left.selectExpr("a AS file", "record", "offset AS oa", "digest AS x", f"{twins} AS ta")
    right = right.selectExpr("a AS f", "record AS r", "offset AS ob", "digest AS y", f"{twins} AS tb")
    equal = F.expr("file = f AND record <=> r AND x = y AND ta = tb")
    only_left = left.join(right, equal, "left_anti").selectExpr("*", "row_number() OVER (PARTITION BY file, record ORDER BY oa) AS nth")
    only_right = right.join(left, equal, "left_anti").selectExpr("*", "row_number() OVER (PARTITION BY f, r ORDER BY ob) AS n")
    both = only_left.join(only_right, F.expr("file = f AND record <=> r AND nth = n"), "full")
    status = "CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'extra' ELSE 'altered' END AS status"
    return both.selectExpr("coalesce(file, f) AS file", "coalesce(record, r) AS record", "coalesce(oa, ob) AS offset", status)


def op1_fixity(spark, sf_dir: str) -> DataFrame:
    """Audit of the pages against a replica with rot: where the url's MD5 begins with 00 the body's first letter is
    overwritten, where it begins with 01 the record is lost."""
    from convlake.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = "substr(md5(coalesce(url, '')), 1, 2)"
    rotten = f"CASE WHEN {fate} = '00' THEN overlay(coalesce(html, '') PLACING '\\u007f' FROM 1 FOR 1) ELSE html END AS html"
    replica = pages.where(f"{fate} <> '01'").selectExpr("page_id", "url", rotten)
    out = audit(tree(warc_records(pages)), tree(warc_records(replica)))
    return out.selectExpr("record AS page_id", "file", "offset", "status")


OP1_SQL = f"""
WITH r AS (
  SELECT page_id, page_id // {RECORDS_PER_FILE} AS file, substr(md5(coalesce(url, '')), 1, 2) AS fate,
         strlen('WARC/1.1__WARC-Type: response__WARC-Target-URI: ' || coalesce(url, '') || '__Content-Length: '
                || strlen(coalesce(html, ''))::varchar || '____' || coalesce(html, '') || '____') AS size
  FROM pages
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset" FROM r
)
SELECT page_id, file, "offset", CASE fate WHEN '00' THEN 'altered' ELSE 'missing' END AS status FROM o WHERE fate IN ('00', '01')
"""
