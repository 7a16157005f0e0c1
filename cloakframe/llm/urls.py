"""Allow and block rules for URLs, in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast; a larger table is refused.
MAX_RULES = 1_000_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RESULTS = "page_id bigint, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as they stand; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class RuleTrie:
    """Longest-match lookup; more host labels win, then the longer path, then block over allow.

    A node is a dict of its children; a path's last part without a closing slash stays a plain prefix, so a rule fits
    exactly the paths that start with its own.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label has a slash: here the path begins
            *segments, rest = (slash + path).split("/")
            for segment in segments:
                node = node.setdefault(segment + "/", {})
            old = node.setdefault("", {}).get(rest)  # no segment is empty: rules that end here, by what remains
            if old is None or verdict == "block":
                node[""][rest] = (verdict, rule)

    def _in_path(self, node: dict, path: str) -> tuple[str, str] | None:
        best = None
        parts = path.split("/")
        for depth in range(len(parts)):
            if ends := node.get(""):
                rest = "/".join(parts[depth:])
                fits = [r for r in ends if rest.startswith(r)]
                if fits:
                    best = ends[max(fits, key=len)]
            if depth == len(parts) - 1 or (node := node.get(parts[depth] + "/")) is None:
                break
        return best

    def lookup(self, host: str, path: str) -> tuple[str, str] | None:
        """``(verdict, rule)`` of the longest rule that fits."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None or label == "/":
                break
            if "/" in node:
                best = self._in_path(node["/"], path) or best
        return best


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages (page_id, url)``.

    ``rules`` are ``(verdict, host/path)``. A rule fits its host and all subdomains if the path starts with the rule's. Where
    none fits, rule is NULL and the verdict ``default``. NULL urls and those without ``://`` have empty host and path, which no
    rule with a host fits. Ports and user names stay part of the host. Repeated rows are judged alike; other columns
    are ignored. The trie is broadcast, bounded by MAX_RULES.
    """
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(list(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(url) for url in batch.column(1).to_pylist()]
            found = [trie.lookup(*x) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in (
                    [h for h, _ in parts], [p for _, p in parts],
                    [f and f[1] for f in found], [f[0] if f else default for f in found]))],
                names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("bigint"), "url").mapInArrow(run, RESULTS)
