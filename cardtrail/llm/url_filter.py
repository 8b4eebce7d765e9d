"""URL filters: allow and block rules over hosts and paths, longest match first.

A rule has a verdict, a host and a path, written ``host/path``. It fits a url whose host
is the rule's or a subdomain of it, and whose path starts with the rule's. Of the rules
that fit, the one with the most host labels decides; among those of one host, the one
with the longest path. Of two rules for the same host and path, block wins. A url that
no rule fits gets ``default``.

The rules form a trie: first the host's labels from last to first, then, at the node where
a rule's host ends, the path's segments. A rule's last segment need not be whole (``/en``
fits ``/english``; ``/en/`` ends in the empty segment, which starts every segment). A
lookup walks down once per part and climbs back to the deepest rule that fits.

The trie is broadcast if the rules are few enough (``max_rules`` rules and
``max_bytes`` bytes, both measured before); above that bound the urls meet the rules in a
join on (host, folder), with the same results.

Host and path: the host is what stands after the first ``://`` up to ``/ ? #`` or the
end, with A-Z lower-cased, ports and user names included; the path follows it up to ``?``,
``#`` or the end. Null urls and those without ``://`` have both empty; an empty host fits
only rules without host, which fit every url whose path they start. Rows are kept as they
come (repeated rows repeat, null ids stay null, ids never change); no row of the input is
looked at beside its url. An empty table gives an empty result, an empty rule list gives
every url the default.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardtrail.llm.common import map_arrow

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query (fixed values).
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _lower(text: str) -> str:
    return text.translate(str.maketrans(*LOWER))


class Trie:
    """The rules by reversed host labels, then path segments. Nodes are numbers, and the
    links (node, label or segment) -> node are flat tables, so that any depth can be sent.
    A path's nodes start at the node of its host."""

    def __init__(self, rules: Iterable[Rule]):
        self.hosts: dict[tuple[int, str], int] = {}
        self.paths: dict[tuple[int, str], int] = {}
        self.ends: dict[tuple[int, str], Rule] = {}
        lengths: dict[int, set[int]] = {}
        nodes = 1
        for rule in rules:
            rule = Rule(rule.verdict, _lower(rule.host), rule.path)
            node = 0
            *whole, start = rule.path.split("/")
            for links, keys in ((self.hosts, reversed(rule.host.split(".")) if rule.host else ()), (self.paths, whole)):
                for key in keys:
                    node = links.setdefault((node, key), nodes)
                    nodes = max(nodes, node + 1)
            if rule.verdict == "block" or (node, start) not in self.ends:
                self.ends[node, start] = rule
                lengths.setdefault(node, set()).add(len(start))
        self.lengths = {node: sorted(n, reverse=True) for node, n in lengths.items()}

    def match(self, host: str, path: str) -> Rule | None:
        """The rule that decides, if one fits."""
        found = [0]
        for label in reversed(host.split(".")) if host else ():
            node = self.hosts.get((found[-1], label))
            if node is None:
                break
            found.append(node)
        segments = path.split("/")
        return next((rule for rule in (self._longest(node, segments) for node in reversed(found)) if rule), None)

    def _longest(self, node: int, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            best = next((self.ends[node, segment[:n]] for n in self.lengths.get(node, ()) if (node, segment[:n]) in self.ends), best)
            node = self.paths.get((node, segment))
            if node is None:
                break
        return best


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with columns host and path in place of any of these names."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return pages.withColumns({"host": F.coalesce(host, empty), "path": F.coalesce(path, empty)})


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame = RULES, default: str = "allow",
                max_rules: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule (``host/path``, null if none fits), verdict of every row.

    ``rules`` may be a DataFrame (verdict, host, path); nulls in it count as empty."""
    urls = split_url(pages.select("page_id", "url")).select("page_id", "host", "path")
    if isinstance(rules, DataFrame):
        table = rules.select(*(F.coalesce(c, F.lit("")).alias(c) for c in Rule._fields))
        n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
        if n > max_rules or size > max_bytes:
            return _by_join(urls, table, default)
        rules = (Rule(*r) for r in table.toLocalIterator())
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches):
        trie = shared.value
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            found = [trie.match(h, p) for h, p in zip(host.to_pylist(), path.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), host, path,
                 pa.array([r and r.host + r.path for r in found], pa.string()),
                 pa.array([r.verdict if r else default for r in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return map_arrow(urls, run, "page_id long, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules beyond the broadcast bound. Every distinct (host, path) asks for
    the rules of its suffixes and folders, no deeper than the deepest rule; the path's
    start is checked after the join, and the longest rule of each (host, path) stays."""
    rules = rules.withColumns({"host": F.translate("host", *LOWER), "folder": F.regexp_extract("path", r"^(?s:.*)/", 0)})
    rules = rules.groupBy("host", "path", "folder").agg(F.max("verdict").alias("verdict"))  # block after allow
    labels, depth = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("folder", "/")))).first()
    names, segments = F.split("host", r"\."), F.split("path", "/")
    # n = 0: rules without host; folders: "" (no slash at all), "/", "/a/", ...
    n = F.explode(F.sequence(F.lit(0), F.least(F.when(F.col("host") == "", F.lit(0)).otherwise(F.size(names)), F.lit(labels))))
    d = F.explode(F.sequence(F.lit(0), F.least(F.size(segments) - 1, F.lit(depth - 1))))
    asked = urls.select("host", "path").distinct().withColumn("n", n).withColumn("d", d)
    asked = asked.select(
        "host", "path", "n",
        F.when(F.col("n") == 0, F.lit("")).otherwise(F.expr("array_join(slice(split(host, '\\\\.'), -n, n), '.')")).alias("rule_host"),
        F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr("concat(array_join(slice(split(path, '/'), 1, d), '/'), '/')")).alias("folder"))
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "folder", "verdict")
    fits = asked.join(named, ["rule_host", "folder"]).where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max_by(
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct("n", F.length("rule_path").alias("l"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
