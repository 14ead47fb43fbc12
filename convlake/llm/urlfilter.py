"""URL filters: a broadcast trie over reversed host labels and then path segments.

A rule is (action, host, path). It fits its host and every subdomain if the url's path begins with
the rule's path, letter by letter; the last segment of a rule's path may thus end inside one of the
url's. The longest rule that fits wins: most host labels, then longest path. Where no rule fits, the
verdict is `default`. Rules are given by the caller; MAX_RULES bounds what is broadcast.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased;
the path what follows up to `?`, `#` or the end.

Edge cases: a null url, or one without `://`, has an empty host and path and gets the default; rules
with an empty host never fit; of two rules for the same place the later counts; repeated rows are
judged one by one; extra columns pass through.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_RULES = 1_000_000
URL = re.compile(r"[^/?#]*")
PATH = re.compile(r"[^?#]*")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# The rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = URL.match(rest)[0]
    return host.translate(LOWER), PATH.match(rest, len(host))[0]


class Trie:
    """Nodes are dicts: a host label leads to the next node; the key "" to the trie of the paths."""

    def __init__(self, rules):
        self.root: dict = {}
        for action, host, path in rules:
            if not host:
                continue
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("", {"next": {}, "ends": {}})
            *whole, last = path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, {"next": {}, "ends": {}})
            node["ends"][last] = (action, host + path)

    @staticmethod
    def _by_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            fits = [e for e in node["ends"] if segment.startswith(e)] if node["ends"] else []
            best = node["ends"][max(fits, key=len)] if fits else best
            node = node["next"].get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            if "" in node:
                best = self._by_path(node[""], segments) or best
        return best


def judge(df: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict of every url."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    sent = df.sparkSession.sparkContext.broadcast(Trie(rules))
    names = ["host", "path", "rule", "verdict"]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.StringType()) for n in names])

    def run(batches):
        find = sent.value.find
        for batch in batches:
            rows = []
            for u in batch.column(url).to_pylist():
                host, path = split_url(u)
                action, rule = find(host, path) or (default, None)
                rows.append((host, path, rule, action))
            made = [pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return df.select(*keep).mapInArrow(run, schema)


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT s.page_id, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY s.page_id ORDER BY len(string_split(rhost, '.')) DESC, length(rpath) DESC) AS k
  FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM s LEFT JOIN m ON m.page_id = s.page_id AND m.k = 1
"""
