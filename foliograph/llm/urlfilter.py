"""URL filters by a sort-merge range join.

A host's labels reversed make a key under which all its subdomains are one interval, so
a rule is an interval and rules on a host contain those on its subdomains. Keys are cut
into cells at quantiles of a bounded sample; a rule goes to every cell that its interval
meets, a url to one. Each cell is sorted by key, rules first, and swept once with a
stack of the rules whose intervals are open: the innermost host that has a fitting path
decides, the longest path first.

Cells only deal out the work and have no effect on verdicts. A key that is frequent
enough to be several cells' bounds is spread over all of them, so neither a host nor a
single url that a third of all pages share meets in one task. A task holds the stack and
one Arrow batch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, smallest_hashes

#: Keys that are gathered to choose the bounds of cells.
SAMPLE = 4096
DEFAULT = "allow"
_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of each url."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("u")).select("page_id", F.expr("if(instr(u, '://') > 0, substring(u, instr(u, '://') + 3), '')").alias("rest"))
    cut = cut.select("page_id", "rest", F.regexp_extract("rest", r"^[^/?#]*", 0).alias("h"))
    return cut.select("page_id", F.translate("h", *_A_Z).alias("host"), F.regexp_extract(F.expr("substring(rest, length(h) + 1)"), r"^[^?#]*", 0).alias("path"))


def reversed_host(host: str) -> str:
    """a.example.com as com.example.a. (no host: empty)."""
    return ".".join(host.split(".")[::-1]) + "." if host else ""


def sort_key(host: str, path: str) -> bytes:
    return (reversed_host(host) + "\0" + path).encode()


def interval(host: str) -> tuple[bytes, bytes]:
    """The keys of a host and its subdomains: from the first up to the second."""
    key = reversed_host(host).encode()
    return key, key[:-1] + b"/" if key else b"\xff"


class Sweep:
    """The stack of open rules while keys go up."""

    def __init__(self) -> None:
        self.open: list[tuple[bytes, bytes, list]] = []

    def at(self, key: bytes) -> None:
        while self.open and key >= self.open[-1][1]:
            self.open.pop()

    def rule(self, low: bytes, high: bytes, host: str, path: str, action: str) -> None:
        self.at(low)
        if not self.open or self.open[-1][0] != low:
            self.open.append((low, high, []))
        rules = self.open[-1][2]
        rules.append((-len(path), path, action != "block", action, host + path))
        rules.sort()

    def verdict(self, key: bytes, path: str) -> tuple[str | None, str]:
        self.at(key)
        for _, _, rules in reversed(self.open):
            for _, start, _, action, name in rules:
                if path.startswith(start):
                    return name, action
        return None, DEFAULT


def judged(pages: DataFrame, rules: DataFrame, cells: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages.

    rules: (host, path, action), action block or allow. A url without :// or null has an
    empty host and path. A rule fits its host and the subdomains if the url's path
    starts with the rule's; the longest host decides, then the longest path, and of
    equal rules block wins. Rules with a null in any column are left out. Repeated rows
    are judged each for itself; empty tables give no rows, or verdicts by default.
    """
    spark = pages.sparkSession
    parts = host_and_path(pages)
    cells = min(cells or 2 * shuffle_partitions(spark), SAMPLE)
    sample = smallest_hashes(parts, SAMPLE, "page_id", "host", "path").select("host", "path").collect()
    keys = sorted(sort_key(r["host"], r["path"]) for r in sample)
    bounds = [keys[len(keys) * k // cells] for k in range(1, cells)] if keys else []
    schema = "cell int, key binary, kind int, page_id long, host string, path string, action string"

    def page_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [sort_key(h, p) for h, p in zip(hosts, paths, strict=True)]
            at = []
            for key, spread in zip(found, batch.column("spread").to_pylist(), strict=True):
                i, j = bisect_left(bounds, key), bisect_right(bounds, key)
                at.append(i + spread % (j - i + 1))
            n = len(at)
            yield pa.record_batch({"cell": pa.array(at, pa.int32()), "key": pa.array(found, pa.binary()), "kind": pa.array([1] * n, pa.int32()), "page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"), "action": pa.nulls(n, pa.string())})

    def rule_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = interval(host)
                rows.extend((cell, low, 0, None, host, path, action) for cell in range(bisect_left(bounds, low), bisect_left(bounds, high) + 1))
            names, kinds = ("cell", "key", "kind", "page_id", "host", "path", "action"), (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, stack = None, Sweep()
        for batch in batches:
            out = []
            for own, key, kind, page_id, host, path, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != cell:
                    cell, stack = own, Sweep()
                if kind == 0:
                    stack.rule(key, interval(host)[1], host, path, action)
                else:
                    out.append((page_id, host, path, *stack.verdict(key, path)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["page_id", "host", "path", "rule", "verdict"])

    ruled = rules.select(F.translate(F.col("host"), *_A_Z).alias("host"), "path", "action").dropna().distinct().mapInArrow(rule_cells, schema)
    placed = parts.withColumn("spread", F.pmod(F.xxhash64("page_id"), F.lit(1 << 30))).mapInArrow(page_cells, schema)
    sorted_ = placed.unionByName(ruled).repartition("cell").sortWithinPartitions("cell", "key", "kind")
    return sorted_.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

JUDGED_SQL = rf"""
WITH rules(h, p, action) AS (VALUES {", ".join(map(str, RULES))}
), cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), parts AS (SELECT page_id, translate(raw, '{_A_Z[0]}', '{_A_Z[1]}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, row_number() OVER () AS row FROM split
), fits AS (
  SELECT row, h || p AS rule, action, row_number() OVER (PARTITION BY row ORDER BY length(h) DESC, length(p) DESC) AS nth
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (row)
"""
