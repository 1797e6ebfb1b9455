"""Documents of several sources mixed to target shares of the total size in tokens.

A text that stands in several sources is one text with several memberships. Texts are aggregated by membership pattern;
tokens flow from patterns to source quotas, the k-th use of a pattern's tokens at cost k - 1, so that texts are repeated
only where a quota asks for it, and shared texts go where they save a repetition. The network has as many nodes as there
are patterns and sources, whatever the number of documents, and is solved on the driver. Along a seeded order of a
pattern's texts each source then takes its stretch of tokens, whole texts each. A text that a source holds in several
documents offers the tokens of all of them; its uses fill one document up to the source's limit, then the next.

Sizes come from a public tokenizer whose file is a parameter. Texts without tokens, null texts and documents of sources
without target are not used. A source without documents reaches nothing; the report says so. Unless a total is given,
it is the greatest at which every source that has documents meets its quota.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import written

DEFAULT_RANKS = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the tokenizer of that file cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_PATTERNS = 1 << 16
SLOTS = 4096


@lru_cache(2)
def encoder(ranks: str, pattern: str):
    """The tokenizer, and its table of byte strings."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), table


#: The tokenizer's own scanner runs out of stack on longer stretches of white space.
LONG_BLANK = re.compile(r"\s{1000}")


def merged(piece: bytes, table: Mapping[bytes, int]) -> int:
    """Number of tokens of one piece: of all neighbours that make a token the one of least rank is merged first, leftmost on a tie."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live, count = [True] * n, n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        rank = table.get(piece[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    queue = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i]
        if not live[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        live[j], end[i], after[i], count = False, end[j], after[j], count - 1
        if after[j] < n:
            before[after[j]] = i
        queue_at = [i] if before[i] < 0 else [before[i], i]
        for k in queue_at:
            if p := pair(k):
                heapq.heappush(queue, p)
    return count


def n_tokens(enc: tuple, text: str, pattern: str) -> int:
    """Number of tokens of a text, with long blanks too: only there the pieces are cut and merged here."""
    if not LONG_BLANK.search(text):
        return len(enc[0].encode_ordinary(text))
    return sum(merged(p.encode(), enc[1]) for p in regex.findall(pattern, text))


class Flow:
    """Min-cost flow by successive shortest paths, with integer capacities and costs of at least 0."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # from, to, free, cost; arc i ^ 1 is its reverse
        self.out: dict[int, list[int]] = {}

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, room, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([x, y, room, c])
        return len(self.arcs) - 2

    def used(self, arc: int) -> int:
        return self.arcs[arc ^ 1][2]

    def run(self, source: int, sink: int) -> int:
        """Sends as much as fits, at least cost; returns how much."""
        potential = dict.fromkeys(self.out, 0)
        sent = 0
        while True:
            far, via = {source: 0}, {}
            queue, done = [(0, source)], set()
            while queue:
                d, x = heapq.heappop(queue)
                if x in done:
                    continue
                done.add(x)
                for i in self.out[x]:
                    _, y, room, cost = self.arcs[i]
                    if room > 0 and y not in done and (e := d + cost + potential[x] - potential[y]) < far.get(y, 1 << 62):
                        far[y], via[y] = e, i
                        heapq.heappush(queue, (e, y))
            if sink not in done:
                return sent
            for x in potential:
                potential[x] += min(far.get(x, far[sink]), far[sink])
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.arcs[via[x]][0]
            push = min(self.arcs[i][2] for i in path)
            for i in path:
                self.arcs[i][2] -= push
                self.arcs[i ^ 1][2] += push
            sent += push


Sizes = Mapping[tuple[tuple[str, ...], str], int]


def route(patterns: Mapping[tuple[str, ...], int], quotas: Mapping[str, int], repeats: Mapping[str, int], sizes: Sizes | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens sent in all, and per (pattern, source). ``sizes``: tokens of a source's documents in a pattern, where not the pattern's."""
    f = Flow()
    names = sorted(quotas)
    node = {s: 2 + i for i, s in enumerate(names)}
    ties = {}
    for s in names:
        f.add(node[s], 1, quotas[s], 0)
    for j, (p, tokens) in enumerate(sorted(patterns.items())):
        at = 2 + len(names) + j
        for use in range(sum(repeats[s] for s in p)):
            f.add(0, at, tokens, use)
        for s in p:
            ties[p, s] = f.add(at, node[s], (tokens if sizes is None else sizes[p, s]) * repeats[s], 0)
    f.out.setdefault(0, [])
    f.out.setdefault(1, [])
    sent = f.run(0, 1)
    return sent, {k: n for k, i in ties.items() if (n := f.used(i))}


def largest_total(patterns: Mapping[tuple[str, ...], int], shares: Mapping[str, float], repeats: Mapping[str, int], sizes: Sizes | None = None) -> int:
    """The greatest total at which all quotas of sources that have texts are met."""
    have = {s for p in patterns for s in p if shares[s] > 0}
    low, high = 0, int(sum(n * sum(repeats[s] for s in p) for p, n in patterns.items()) / max(sum(shares[s] for s in have), 1e-12)) if have else 0
    while low < high:
        total = (low + high + 1) // 2
        quotas = {s: int(shares[s] * total) for s in have}
        if route({p: n for p, n in patterns.items()}, quotas | {s: 0 for s in shares if s not in have}, repeats, sizes)[0] >= sum(quotas.values()):
            low = total
        else:
            high = total - 1
    return low


class Mixture:
    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, ranks: str = DEFAULT_RANKS, pattern: str = PATTERN):
        """``docs``: doc_id, text, source. ``targets``: source, target_share, max_repeats; one row per source, the first by share if there are several."""
        self.seed = seed
        spark = docs.sparkSession
        # one row per source: as many as there are sources, and no more than the limit
        listed = targets.where("source is not null and target_share >= 0 and max_repeats >= 1").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x"))
        rows = listed.limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS:
            raise ValueError("more sources than a mixture can have")
        self.shares = {r.source: float(r.x.target_share) for r in rows}
        self.repeats = {r.source: int(r.x.max_repeats) for r in rows}
        self.sized = written(self._sized(docs.join(F.broadcast(spark.createDataFrame([(s,) for s in self.shares], "source string")), "source"), ranks, pattern), "token-sizes")
        self.documents = self.sized.where("tokens > 0").groupBy("h1", "h2", "source", "doc_id").agg(F.max("tokens").alias("tokens"))
        members = self.documents.groupBy("h1", "h2", "source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("tokens").alias("tokens"))
        texts = members.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("source")).alias("pattern"))
        self.members = members.join(texts, ["h1", "h2"])
        found = self.members.groupBy("pattern", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens")).limit(MAX_PATTERNS + 1).collect()
        if len(found) > MAX_PATTERNS:
            raise ValueError("more membership patterns than the driver takes")
        self.sizes = {(tuple(r.pattern), r.source): int(r.tokens) for r in found}
        self.patterns: dict[tuple[str, ...], int] = {}
        for (p, _), n in self.sizes.items():
            self.patterns[p] = max(n, self.patterns.get(p, 0))
        self.total = largest_total(self.patterns, self.shares, self.repeats, self.sizes) if total_tokens is None else total_tokens
        self.quotas = {s: int(share * self.total) for s, share in self.shares.items()}
        _, self.routed = route(self.patterns, self.quotas, self.repeats, self.sizes)

    @staticmethod
    def _sized(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
        name = os.path.basename(ranks)
        docs.sparkSession.sparkContext.addFile(ranks)  # executors need not have it

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            enc = encoder(SparkFiles.get(name), pattern)
            for b in batches:
                yield b.assign(tokens=[n_tokens(enc, t, pattern) for t in b.pop("text")])

        rows = docs.where("text is not null").select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
        return rows.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, h1 long, h2 long, tokens long")

    def stretches(self, spark: SparkSession) -> DataFrame:
        """pattern, source, start, end, size, limit: the tokens each source takes of its texts in a pattern, laid end to end and round.

        A source begins at the share of the round at which the one before it ended.
        """
        rows, at = [], {}
        for (p, s), n in sorted(self.routed.items()):
            begin, size = at.get(p, Fraction(0)), self.sizes[p, s]
            start = int(begin % 1 * size)
            rows.append((list(p), s, start, start + n, size, self.repeats[s]))
            at[p] = begin + Fraction(n, size)
        return spark.createDataFrame(rows, "pattern array<string>, source string, start long, end long, size long, limit long")

    def placed(self) -> DataFrame:
        """Members with the tokens of their source before them in their pattern's seeded order. Ordered slot by slot, never as a whole."""
        texts = self.members.withColumn("order", F.xxhash64(F.lit(self.seed), "h1", "h2")).withColumn("slot", F.pmod("order", F.lit(SLOTS))).withColumn("offered", F.col("copies") * F.col("tokens"))
        slots = texts.groupBy("pattern", "source", "slot").agg(F.sum("offered").alias("slot_tokens"))
        along = W.partitionBy("pattern", "source").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
        slots = slots.withColumn("before_slot", F.sum("slot_tokens").over(along) - F.col("slot_tokens")).drop("slot_tokens")
        inside = W.partitionBy("pattern", "source", "slot").orderBy("order", "h1", "h2").rowsBetween(W.unboundedPreceding, 0)
        return texts.join(slots, ["pattern", "source", "slot"]).withColumn("before", F.col("before_slot") + F.sum("offered").over(inside) - F.col("offered"))

    def selected(self) -> DataFrame:
        """doc_id, source, tokens, uses: documents used, and how often."""
        stretch = self.stretches(self.sized.sparkSession)
        # the copies that begin before a point of the round, each at before + i * tokens, + size for every round
        until = lambda x: F.expr(f"copies * ({x} div size) + greatest(0, least(copies, ({x} % size - before + tokens - 1) div tokens))")
        taken = self.placed().join(F.broadcast(stretch), ["pattern", "source"]).withColumn("uses", (until("end") - until("start")).cast("long")).where("uses > 0")
        cols = ["doc_id", "source", "tokens", "uses"]
        return taken.where("copies = 1").select(*cols).unionByName(self._over_copies(taken.where("copies > 1")).select(*cols))

    def _over_copies(self, taken: DataFrame) -> DataFrame:
        """The uses of texts with several documents, document by document. Ranked slot by slot, as one text can have most documents."""
        text = ["h1", "h2", "source"]
        rows = self.documents.join(taken.select(*text, "uses", "limit"), text).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
        slots = rows.groupBy(*text, "slot").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(W.partitionBy(*text).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        slots = slots.withColumn("before", before).drop("n")
        rank = F.col("before") + F.row_number().over(W.partitionBy(*text, "slot").orderBy("doc_id")) - 1
        left = F.col("uses") - rank * F.col("limit")
        return rows.join(slots, [*text, "slot"]).withColumn("uses", F.least(left, F.col("limit")).cast("long")).where("uses > 0")

    def shares_reached(self) -> DataFrame:
        """source, target_share, max_repeats, available, quota, reached, share, n_docs, n_uses: one row per target."""
        spark = self.sized.sparkSession
        plan = spark.createDataFrame([(s, self.shares[s], self.repeats[s], self.quotas[s]) for s in sorted(self.shares)], "source string, target_share double, max_repeats long, quota long")
        have = self.members.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("available"))
        got = self.selected().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached"), F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        out = plan.join(have, "source", "left").join(got, "source", "left").select("source", "target_share", "max_repeats", zero("available"), "quota", zero("reached"), zero("n_docs"), zero("n_uses"))
        return out.withColumn("share", F.col("reached") / F.sum("reached").over(W.partitionBy()))
