"""URL rules by a trie over reversed host labels and path segments, with the longest match deciding.

A rule (`host/path`) fits its host and all its subdomains if the url's path starts with the rule's path. Of the rules
that fit, the one with the most host labels wins, then the longest path; if one text is both blocked and allowed, block
wins. Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and gets the default
verdict; an empty rule list leaves every url with it. A very long url is one row and is judged whole. Repeated rows are
judged alike; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import map_batches, prepare, written

#: Fixed rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters of the rules in one broadcast trie. A trie takes up to about 60 bytes for each (measured on rules that share
#: nothing), so some 250 MB in a worker at most; longer lists are applied in turns, with the same result.
MAX_RULE_CHARS = 4 << 20


class RuleTrie:
    """Nodes are dicts: host labels from the right, then, below `paths`, whole path segments.

    A rule's path ends in a prefix of a segment: `ends` maps such prefixes to (rule, verdict), and `sizes` has their
    lengths, the longest first, so that a segment is looked up once for each length, however many rules there are."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {"kids": {}, "paths": None}
        nodes = []
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node["kids"].setdefault(label, {"kids": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"kids": {}, "ends": {}}
            at = node["paths"]
            *whole, last = (slash + path).split("/")
            for segment in whole:
                at = at["kids"].setdefault(segment, {"kids": {}, "ends": {}})
            if at["ends"].get(last, ("", ""))[1] != "block":
                at["ends"][last] = (rule, verdict)
                nodes.append(at)
        for at in nodes:
            at["sizes"] = sorted({len(e) for e in at["ends"]}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides and its verdict."""
        found = self.ranked(host, path)
        return found and found[2:]

    def ranked(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """Labels and characters of the path that the longest match has, its rule and verdict."""
        best, node, segments = None, self.root, None
        for n, label in enumerate(reversed(host.split(".")), 1):
            node = node["kids"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                segments = path.split("/") if segments is None else segments
                found = self._path(node["paths"], segments)
                best = (n, *found) if found else best
        return best

    @staticmethod
    def _path(at: dict, segments: list[str]) -> tuple[int, str, str] | None:
        best, before = None, 0
        for segment in segments:
            ends = at["ends"]
            if ends and (size := next((k for k in at["sizes"] if k <= len(segment) and segment[:k] in ends), None)) is not None:
                best = before + size, *ends[segment[:size]]
            at = at["kids"].get(segment)
            if at is None:
                break
            before += len(segment) + 1
        return best


def _parts(rules: Iterable[tuple[str, str]], most: int) -> list[list[tuple[str, str]]]:
    """The rules in lists of at most `most` characters each (or of one rule)."""
    out: list[list[tuple[str, str]]] = [[]]
    size = 0
    for verdict, rule in rules:
        if out[-1] and size + len(rule) > most:
            out.append([])
            size = 0
        out[-1].append((verdict, rule))
        size += len(rule)
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rule_chars: int = MAX_RULE_CHARS) -> DataFrame:
    """id, host, path, rule and verdict of every row; see the module's text for the defined cases."""
    spark = pages.sparkSession
    prepare(spark)
    out = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    fields = [*out.schema.fields, T.StructField("labels", T.IntegerType()), T.StructField("chars", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    parts = _parts(rules, max_rule_chars)
    for turn, part in enumerate(parts):
        trie = spark.sparkContext.broadcast(RuleTrie(part))

        def judge(batch: pa.RecordBatch, trie=trie, turn=turn) -> pa.RecordBatch:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [trie.value.ranked(h, p) for h, p in zip(hosts, paths, strict=True)]
            if turn:  # the longer match of this turn and those before; of two as long, block
                before = zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True)
                rank = lambda f: (f[0], f[1], f[3] == "block")
                found = [b if b[2] is not None and (f is None or rank(b) >= rank(f)) else f for f, b in zip(found, before, strict=True)]
            columns = [pa.array([f[k] if f else None for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[f.name for f in fields])

        out = map_batches(out, judge, T.StructType(fields))
        if turn < len(parts) - 1:
            out = written(out)  # one turn's trie in memory at a time
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT *, '.' || host AS h,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
