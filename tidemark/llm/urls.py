"""URL filters by a sort-merge range join (operator 4).

A host is written with its labels reversed, each ended by a separator that sorts before any
label character. A rule's host then covers one interval of keys: those that start with its
own key, which are the host and all its subdomains. Pages are range-partitioned and sorted by
that key; a sweep over a partition keeps a stack of the rule hosts whose intervals are open,
nested by construction, and each page looks only at the rules on the stack.

Rules aren't broadcast: cut points between partitions come from the pages' keys (with a hash
of the page behind them, so one host with a third of all pages spreads over many partitions),
and each rule goes to every partition that its interval meets. Only the cut points reach the
driver, a fixed number per partition.

Defined cases: null url or one without ``://`` has host and path empty and no rule; no fitting
rule gives the default verdict; equal rules collapse, and where allow and block rules are
equally long, block wins; repeated pages give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

SEP = "\x01"
#: (rule, verdict) of the production query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
SAMPLES_A_PARTITION = 40
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def host_key(host: str) -> str:
    return "".join(label + SEP for label in reversed(host.split("."))) if host else ""


def _split_columns(pages: DataFrame) -> DataFrame:
    """host, path and the sort key, with built-in functions only."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pages = pages.withColumn("host", low).withColumn("path", path)
    labels = F.reverse(F.split("host", r"\."))
    key = F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(labels, SEP), F.lit(SEP)))
    return pages.withColumn("_key", key).withColumn("_salt", F.hex(F.xxhash64("page_id", "path")))


class _Node:
    """A rule host with its rules by path."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths = key, host, {}
        self.order: list[str] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths.get(path) != "block":
            self.paths[path] = verdict

    def seal(self) -> None:
        """Sorts the paths and links each to the longest other path that is its prefix."""
        self.order = sorted(self.paths)
        self.up: list[int] = []
        stack: list[int] = []
        for i, p in enumerate(self.order):
            while stack and not p.startswith(self.order[stack[-1]]):
                stack.pop()
            self.up.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> str | None:
        i = bisect_right(self.order, path) - 1
        while i >= 0 and not path.startswith(self.order[i]):
            i = self.up[i]
        return self.order[i] if i >= 0 else None


def sweep(nodes: list[_Node], keys: list[tuple[str, str, str]]) -> list[tuple[str | None, str | None]]:
    """(rule, verdict) for each (key, host, path); keys sorted, nodes sorted by key."""
    out, stack, at = [], [], 0
    for key, host, path in keys:
        while at < len(nodes) and nodes[at].key <= key:
            while stack and not nodes[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(nodes[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        best: tuple[int, int, str, str] | None = None
        for node in stack:
            if host == node.host or host.endswith("." + node.host):
                if (p := node.longest(path)) is not None:
                    found = (len(node.host) + len(p), node.paths[p] == "block", node.host + p, node.paths[p])
                    best = max(best, found) if best else found
        out.append((best[2], best[3]) if best else (None, None))
    return out


def _nodes(rules: list[tuple[str, str]]) -> list[_Node]:
    by: dict[str, _Node] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        host = host.translate(_UPPER)
        by.setdefault(host, _Node(host_key(host), host)).add(slash + path, verdict)
    for node in by.values():
        node.seal()
    return sorted(by.values(), key=lambda n: n.key)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; ``rules`` has columns rule (``host/path``) and verdict."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _split_columns(columns(pages, "page_id", "url"))
    total = keyed.count()
    # cut points, as a range partitioner finds them: a bounded number for each partition
    share = min(1.0, SAMPLES_A_PARTITION * n / max(total, 1))
    seen = keyed.where(F.pmod(F.xxhash64("_key", "_salt"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    points = sorted({(r[0], r[1]) for r in seen.select("_key", "_salt").limit(SAMPLES_A_PARTITION * n * 2).collect()})
    cuts = [points[len(points) * i // n] for i in range(1, n)] if len(points) >= n else points
    cuts = sorted(set(cuts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(b.column("_key").to_pylist(), b.column("_salt").to_pylist(), strict=True)
            part = pa.array([bisect_right(cuts, k) for k in keys], pa.int32())
            nulls = pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([part, *b.columns, nulls, nulls], names=[*SCHEMA])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rule, verdict in zip(b.column("rule").to_pylist(), b.column("verdict").to_pylist(), strict=True):
                key = host_key(rule.partition("/")[0].translate(_UPPER))
                first, last = bisect_right(cuts, (key, "")), bisect_right(cuts, (key + "\U0010ffff", ""))
                rows += [(i, None, "", "", key, "", rule, verdict) for i in range(first, last + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)] if rows else [pa.array([], t) for t in KINDS], names=[*SCHEMA])

    SCHEMA = ["part", "page_id", "host", "path", "_key", "_salt", "rule", "verdict"]
    KINDS = [pa.int32(), pa.int64(), *[pa.string()] * 6]
    ddl = "part int, page_id bigint, host string, path string, _key string, _salt string, rule string, verdict string"
    left = keyed.select("page_id", "host", "path", "_key", "_salt").mapInArrow(deal, ddl)
    right = rules.select(F.col("rule").cast("string"), F.col("verdict").cast("string")).where("rule is not null").mapInArrow(deal_rules, ddl)
    both = left.unionByName(right).repartitionById(n, "part").sortWithinPartitions("part", F.col("rule").isNull(), "_key", "_salt")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rules_here, nodes = None, [], None
        for b in batches:
            c = b.to_pydict()
            rows: list[tuple[str, str, str]] = []
            kept: list[int] = []
            done: list[tuple[str | None, str | None]] = []
            for i in range(b.num_rows):
                if c["part"][i] != part:
                    done += sweep(nodes or [], rows)
                    rows, part, rules_here, nodes = [], c["part"][i], [], None
                if c["rule"][i] is not None:
                    rules_here.append((c["rule"][i], c["verdict"][i]))
                    continue
                if nodes is None:
                    nodes = _nodes(rules_here)
                rows.append((c["_key"][i], c["host"][i], c["path"][i]))
                kept.append(i)
            done += sweep(nodes or [], rows)
            took = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [took.column("page_id"), took.column("host"), took.column("path"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] or default for d in done], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return both.mapInArrow(join, "page_id bigint, host string, path string, rule string, verdict string")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, (SELECT max_by(r.rule, length(r.rule)) FROM r
    WHERE (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)) AS rule FROM h
)
SELECT page_id, host, path, m.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM m LEFT JOIN r ON m.rule = r.rule
"""
