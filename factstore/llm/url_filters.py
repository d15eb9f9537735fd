"""URL filters: a trie over reversed host labels and path segments, sent to every task.

A rule ``(host, path, verdict)`` fits a url whose host is the rule's host or one of its
subdomains, if the url's path starts with the rule's path. Hosts go into the trie label by
label from the right, and each host node carries a trie of path segments, cut behind each
slash; a rule whose path ends inside a segment stands at the node before it, by the length
of its last piece. A look-up goes down the host's labels once and follows the path from each
node that has rules. Of all rules that fit, the longest wins (characters of host and path,
then of the host); a rule given both ways blocks. Where no rule fits, ``default`` holds,
which allows, as a filter list names what is unwanted.

Rules up to ``RULE_BYTES`` travel as a trie. Beyond that bound the two levels of the trie
become joins: on the host's suffixes, then on the path's prefixes of the lengths that the
host's rules have.

The host of a url stands behind the first ``://``, up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased (in rules as well); the path goes on to ``?``, ``#`` or the end. A null url,
or one without ``://``, has an empty host and path, which only a rule with an empty host can
fit. A rule with a null in it, or a verdict other than allow and block, is left out; repeated
rules count once. Every row gets its row, repeated and null ids among them; extra columns do
not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factstore.llm.common import fresh_name

ALLOW, BLOCK = "allow", "block"
#: Text of the rules that may travel with the tasks.
RULE_BYTES = 16_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEGMENT = re.compile("[^/]*/")


def _behind_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _clean(rules: DataFrame) -> DataFrame:
    """``rule_host, rule_path, verdict``, each host and path once."""
    usable = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
    # The larger of the two verdicts is the one that blocks.
    return (usable.groupBy(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
            .agg(F.max("verdict").alias("verdict")))


class Trie:
    """Plain lists and dictionaries, so that tasks need no code to read them.

    A host node is ``[below by label, paths or None]``; a path node is ``[rule or None, below by
    segment, rules that end inside the next segment by length and text]``.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        # A rule's place in this order is its precedence.
        self.rules = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r))
        self.root: list = [{}, None]
        for rank, (host, path, _) in enumerate(self.rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [None, {}, {}]
            paths, segments = node[1], _SEGMENT.findall(path)
            for segment in segments:
                paths = paths[1].setdefault(segment, [None, {}, {}])
            rest = path[sum(map(len, segments)):]
            if rest:
                paths[2].setdefault(len(rest), {})[rest] = rank
            else:
                paths[0] = rank


def longest(root: list, host: str, path: str) -> int:
    """The place of the rule that wins, or -1."""
    best, segments, node = -1, None, root
    for label in reversed(host.split(".")):
        node = node[0].get(label)
        if node is None:
            break
        paths = node[1]
        if paths is None:
            continue
        if segments is None:
            segments = _SEGMENT.findall(path)
            segments.append(path[sum(map(len, segments)):])
        for segment in segments:
            rule, below, inside = paths
            if rule is not None and rule > best:
                best = rule
            for size, found in inside.items():
                rank = found.get(segment[:size])
                if rank is not None and rank > best:
                    best = rank
            paths = below.get(segment)
            if paths is None:
                break
    return best


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``).

    ``rules`` has ``host, path, verdict``.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = _clean(rules)
    size = listed.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 16)).first()[0] or 0
    if size > rule_bytes:
        return _judge_by_joins(parts, listed, default)
    trie = Trie([tuple(r) for r in listed.collect()])
    shared = pages.sparkSession.sparkContext.broadcast((trie.rules, trie.root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, root = shared.value
        names = [host + path for host, path, _ in every] + [None]
        verdicts = [verdict for _, _, verdict in every] + [default]
        for batch in batches:
            found = [longest(root, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array([names[i] for i in found], pa.string()),
                                   pa.array([verdicts[i] for i in found], pa.string())],
                                  ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judge_by_joins(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins; equal urls meet the rules once, and a hot host is split by adaptive execution."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first()["n"]
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    name = F.split("host", r"\.")
    # No rule has more labels than ``labels``, so no longer suffix is tried.
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(name), F.lit(labels))),
                           lambda n: F.array_join(F.slice(name, -n, n), "."))
    tried = (parts.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
             .join(lengths, "rule_host")
             .select("host", "path", "rule_host", F.explode("lengths").alias("size")).where(F.col("size") <= F.length("path"))
             .select("host", "path", "rule_host", F.substr("path", F.lit(1), F.col("size")).alias("rule_path")))
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = (tried.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path")
            .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("best")))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """The rows of ``pages`` that are allowed, with all their columns."""
    listed = fresh_name(pages.columns, "verdict")
    # A url is judged once however many rows have it.
    urls = pages.select(F.col("url").alias("page_id"), "url").distinct()
    found = judge(urls, rules, default).select(F.col("page_id").alias(f"{listed}_url"), F.col("verdict").alias(listed))
    return (pages.join(found, F.col("url").eqNullSafe(F.col(f"{listed}_url"))).where(F.col(listed) == ALLOW)
            .select(*pages.columns))
