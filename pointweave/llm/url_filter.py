"""URL filters: a trie over reversed host labels, with a trie of path segments below each host, broadcast to all tasks.

A rule (host, path, allow or block) fits a url whose host is the rule's or a subdomain of it, and whose path starts with
the rule's. Of all rules that fit, the one of the longest host wins, then the one of the longest path; a block entry wins
over an allow entry of the same host and path. A url that no rule fits gets the default verdict.

Both tries are flat arrays: an edge is (node, label number), sorted, so a batch of urls walks down one level at a time,
all urls at once. The last piece of a rule's path may be part of a segment ("/en" fits "/english"); such ends hang on
the node of the whole segments before it.

The trie goes to the tasks by broadcast while the rules' text is below a bound (`most_bytes`); more rules are joined by
host, by length and by path instead, with the same results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import worker_memory
from .near_duplicates import lookup
from .textscan import slices

ALLOW, BLOCK = "allow", "block"
#: Text of rules that one broadcast may hold; about four times as much lies in a worker's memory.
MOST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z in small letters; all other characters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, in small letters. Path: from there up to ?, # or the end.

    Both are empty where the url is null or has no ://. Ports, user names and dots at the end belong to the host.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class _Edges:
    """(node, label number) -> child, as sorted keys."""

    def __init__(self):
        self.children: dict[tuple[int, int], int] = {}

    def child(self, node: int, label: int, make) -> int:
        if (node, label) not in self.children:
            self.children[node, label] = make()
        return self.children[node, label]

    def flat(self, labels: int) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([n * labels + k for n, k in self.children], np.int64)
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.children.values(), np.int64, len(keys))[order]


def _follow(keys: np.ndarray, to: np.ndarray, labels: int, node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The child of each node along its label, -1 where there is none."""
    out = np.full(len(node), -1, np.int64)
    known = np.flatnonzero(label >= 0)
    if len(keys) and len(known):
        want = node[known] * labels + label[known]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        out[known] = np.where(keys[at] == want, to[at], -1)
    return out


class Trie:
    """Rules as flat tries. names: each rule's host and path together; verdicts: whether it blocks."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        label: dict[str, int] = {}
        number = lambda text: label.setdefault(text, len(label))
        hosts, paths = _Edges(), _Edges()
        n_hosts, root_of = 1, {}
        n_paths = 0
        self.names, self.blocks = [], []
        ends: dict[tuple[int, str], int] = {}

        def new_host() -> int:
            nonlocal n_hosts
            n_hosts += 1
            return n_hosts - 1

        def new_path() -> int:
            nonlocal n_paths
            n_paths += 1
            return n_paths - 1

        # Block entries come first, so of equal hosts and paths they stay.
        for host, path, verdict in sorted(rules, key=lambda r: (r[2] != BLOCK, r[0], r[1])):
            node = 0
            for part in reversed(host.split(".")):
                node = hosts.child(node, number(part), new_host)
            if node not in root_of:
                root_of[node] = new_path()
            at = root_of[node]
            *whole, last = path.split("/")
            for part in whole:
                at = paths.child(at, number(part), new_path)
            if (at, last) not in ends:
                ends[at, last] = len(self.names)
                self.names.append(host + path)
                self.blocks.append(verdict == BLOCK)
        self.labels = pa.array(list(label), pa.large_string())
        self.n = max(len(label), 1)
        self.hosts, self.paths = hosts.flat(self.n), paths.flat(self.n)
        self.root = np.full(n_hosts, -1, np.int64)
        self.root[list(root_of)] = list(root_of.values())
        self.whole = np.full(n_paths, -1, np.int64)  # the rule that ends with a slash or is empty here
        self.parts: dict[int, dict[str, int]] = {}
        for (at, last), rule in ends.items():
            if last:
                self.parts.setdefault(at, {})[last] = rule
            else:
                self.whole[at] = rule
        self.partial = np.zeros(n_paths, bool)
        self.partial[list(self.parts)] = True

    def _split(self, texts: pa.Array, by: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        pieces = pc.split_pattern(texts.cast(pa.large_string()), by)
        at = pieces.offsets.to_numpy()
        flat = pieces.flatten()
        return flat, pc.index_in(flat, self.labels).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), at - at[0]

    def match(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """The winning rule of each url, -1 where none fits."""
        n = len(hosts)
        best = np.full(n, -1, np.int64)
        _, label, at = self._split(hosts, ".")
        url, node, depth, pairs = np.arange(n), np.zeros(n, np.int64), 0, []
        while len(url):  # one label further to the left in each round
            depth += 1
            more = at[url] + depth <= at[url + 1]
            url, node = url[more], node[more]
            node = _follow(*self.hosts, self.n, node, label[at[url + 1] - depth])
            url, node = url[node >= 0], node[node >= 0]
            root = self.root[node]
            pairs.append((url[root >= 0], root[root >= 0]))
        piece, label, at = self._split(paths, "/")
        for url, node in pairs:  # longer hosts come later and win
            depth = 0
            longest = np.full(n, -1, np.int64)
            while len(url):
                some = self.whole[node] >= 0
                longest[url[some]] = self.whole[node[some]]
                for u, v in zip(url[self.partial[node]].tolist(), node[self.partial[node]].tolist(), strict=True):
                    text, ends = piece[int(at[u]) + depth].as_py(), self.parts[v]
                    hit = next((ends[text[:k]] for k in range(len(text), 0, -1) if text[:k] in ends), -1)
                    if hit >= 0:
                        longest[u] = hit
                more = at[url] + depth + 1 < at[url + 1]  # the last segment of a path is no whole one
                url, node = url[more], node[more]
                node = _follow(*self.paths, self.n, node, label[at[url] + depth])
                url, node = url[node >= 0], node[node >= 0]
                depth += 1
            best = np.where(longest >= 0, longest, best)
        return best


def checked(rules: Iterable[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Rules with hosts in small letters; what is no rule is an error."""
    out = []
    for host, path, verdict in rules:
        if not host or path is None or (path and not path.startswith("/")) or verdict not in (ALLOW, BLOCK) or "/" in host:
            raise ValueError(f"no rule: {(host, path, verdict)}")
        out.append(("".join(_LOWER[_UPPER.index(c)] if c in _UPPER else c for c in host), path, verdict))
    return out


def _rule_table(spark: SparkSession, rules) -> DataFrame:
    """(host, path, verdict): one row a host and path; block wins. Rows that are no rules are left out of a table."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(checked(rules), "host string, path string, verdict string")
    rules = rules.select(lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict"))
    fit = (F.length("host") > 0) & ~F.contains("host", F.lit("/")) & ((F.col("path") == "") | F.startswith("path", F.lit("/"))) & F.col("verdict").isin(ALLOW, BLOCK)
    return rules.where(fit).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is the greater word


def _by_trie(rows: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(rules)
    token = ("url-trie", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_memory(token, lambda: Trie(shared.value))
        names = pa.array([*trie.names, None], pa.string())
        verdicts = pa.array([BLOCK if b else ALLOW for b in trie.blocks] + [default], pa.string())
        for batch in batches:
            for lo, hi in slices(batch.column("path")):
                part = batch.slice(lo, hi - lo)
                rule = pa.array(trie.match(part.column("host"), part.column("path")))
                place = pc.if_else(pc.less(rule, 0), len(trie.names), rule)
                yield pa.RecordBatch.from_arrays([*part.columns, names.take(place), verdicts.take(place)], names=[*part.schema.names, "rule", "verdict"])

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, rule string, verdict string")


def _by_join(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins: each different host and path with its suffixes, the lengths of their rules' paths, and the rules."""
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = urls.where("host != ''").select("host", "path", F.explode(suffixes).alias("at"))
    lengths = rules.groupBy(F.col("host").alias("at")).agg(F.collect_set(F.length("path")).alias("lengths"))  # as many as paths have characters, at most
    tried = lookup(asked, lengths, "at").select("host", "path", "at", F.explode("lengths").alias("k")).where(F.col("k") <= F.length("path"))
    keyed = tried.select("host", "path", F.length("at").alias("h"), "k", F.struct("at", F.substring("path", F.lit(1), F.col("k")).alias("start")).alias("key"))
    facts = rules.select(F.struct(F.col("host").alias("at"), F.col("path").alias("start")).alias("key"), "verdict")
    won = lookup(keyed, facts, "key").groupBy("host", "path").agg(F.max_by(F.struct(F.concat("key.at", "key.start").alias("rule"), "verdict"), F.struct("h", "k")).alias("w"))
    won = won.select(F.struct("host", "path").alias("url"), F.col("w.rule").alias("rule"), F.col("w.verdict").alias("v"))
    judged = lookup(rows.withColumn("url", F.struct("host", "path")), won, "url", "left")
    return judged.select(*rows.columns, "rule", F.coalesce("v", F.lit(default)).alias("verdict"))


def _judged(rows: DataFrame, rules, default: str, most_bytes: int) -> DataFrame:
    """rows with host and path, and for each the winning rule and the verdict."""
    if default not in (ALLOW, BLOCK):
        raise ValueError(f"no verdict: {default}")
    table = _rule_table(rows.sparkSession, rules)
    size = table.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
    if size > most_bytes:
        return _by_join(rows, table, default)
    return _by_trie(rows, [tuple(r) for r in table.collect()], default)


def judge(pages: DataFrame, rules, default: str = ALLOW, most_bytes: int = MOST_BYTES, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row for each row of pages: its key, host, path, rule (host and path together; null: none fits), verdict.

    rules: tuples (host, path, "allow" or "block") or a table with these columns. A null url has an empty host and path,
    which no rule fits. Urls of any length are taken whole. Repeated rows and null keys are rows of their own, other
    columns are ignored, whatever their names; empty tables of pages or of rules are fine.
    """
    host, path = host_and_path(F.col(url))
    return _judged(pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")), rules, default, most_bytes).withColumnRenamed("key", key)


def keep_allowed(pages: DataFrame, rules, default: str = ALLOW, most_bytes: int = MOST_BYTES, url: str = "url") -> DataFrame:
    """The rows of pages that aren't blocked, with their columns as they are. Other cases as in judge()."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*pages.columns).alias("row"), host.alias("host"), path.alias("path"))
    # The verdict depends on host and path alone: rows don't go through Python.
    urls = rows.select("host", "path").distinct()
    blocked = _judged(urls, rules, default, most_bytes).where(F.col("verdict") == BLOCK).select("host", "path")
    return rows.join(blocked, ["host", "path"], "left_anti").select("row.*")
