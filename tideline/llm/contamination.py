"""Which documents contain passages of held-out items, and the same documents without them.

Items are cut into runs of ``n`` words; their distinct hashes are broadcast, at most ``broadcast_grams`` of them. Every
document is scanned window by window; a window whose hash is known is compared word by word with the item's run. With
more runs than that, windows and runs meet in a join on their 128-bit hashes instead, after windows that no item can have
were taken out by a Bloom filter of all runs: a broadcast of fixed size, so few windows move and no words do.

Null and empty texts have no words; items of fewer than ``n`` words cannot be found; repeated documents each count;
an empty item table finds nothing. Texts are read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import words, words_at
from tideline.session import written

BLOOM_BITS = 1 << 27  # 16 MB

_MUL = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers stay invertible


class Grams:
    """All runs of ``n`` words of some passages, by a rolling hash over word numbers; word 0 is any word that no passage has."""

    def __init__(self, passages: list[tuple[object, str]], n: int):
        self.n = n
        self.number: dict[str, int] = {}
        runs: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in passages:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for k in range(len(ids) - n + 1):
                runs[tuple(ids[k : k + n])].add(item)
        self.runs = dict(runs)
        with np.errstate(over="ignore"):
            self.weights = np.array([pow(int(_MUL), n - 1 - j, 1 << 64) for j in range(n)], np.uint64)
            self.scramble = np.random.default_rng(7).integers(1, 1 << 63, len(self.number) + 1, dtype=np.uint64)
        hashes = [self.hashes(np.array(r))[0] for r in self.runs]
        self.known = np.unique(np.array(hashes, np.uint64))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """One hash per window of ``n``."""
        x = self.scramble[ids]
        m = len(ids) - self.n + 1
        with np.errstate(over="ignore"):
            h = np.zeros(max(m, 0), np.uint64)
            for j in range(self.n if m > 0 else 0):
                h += x[j : j + m] * self.weights[j]
        return h

    def hits(self, texts: list[list[str]]) -> Iterator[tuple[int, int, set]]:
        """(text, window start, items) of every window that some passage has, over a batch at once."""
        get = self.number.get
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, int(lengths.sum()))
        if len(ids) < self.n or not len(self.known):
            return
        h = self.hashes(ids)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        whole = unknown[self.n :] == unknown[: len(h)]
        at = np.flatnonzero(whole)
        at = at[self.known[np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)] == h[at]]
        ends = np.cumsum(lengths)
        of = np.searchsorted(ends, at, side="right")
        inside = at + self.n <= ends[of]
        for k, t in zip(at[inside].tolist(), of[inside].tolist()):
            items = self.runs.get(tuple(ids[k : k + self.n].tolist()))
            if items:
                yield t, k - int(ends[t] - lengths[t]), items


def _passes(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which rows of two 64-bit hashes have both bits set."""
    out = np.ones(len(hashes), bool)
    for j in range(2):
        p = np.mod(hashes[:, j], BLOOM_BITS)
        out &= (filled[p >> 6] >> (p & 63)) & 1 == 1
    return out


def stretches(text: str, starts: list[int], n: int) -> list[dict[str, int]]:
    """start, end, n_words of what windows of ``n`` words cover, in order; windows that overlap or touch are one."""
    at = words_at(text)[1]
    out = []
    run = [starts[0], starts[0] + n]
    for k in [*starts[1:], None]:
        if k is not None and k <= run[1]:
            run[1] = k + n
        else:
            out.append({"start": at[run[0]][0], "end": at[run[1] - 1][1], "n_words": run[1] - run[0]})
            run = [k, (k or 0) + n]
    return out


class Contamination:
    def __init__(self, items: DataFrame, item: str = "item_id", passage: str = "passage", n: int = 13, broadcast_grams: int = 2_000_000):
        self.n, self.items = n, items.select(F.col(item).cast("long").alias("item_id"), F.col(passage).alias("passage")).where("item_id is not null and passage is not null")
        spark = items.sparkSession
        size = self.items.agg(F.sum(F.length("passage"))).first()[0] or 0
        self.grams = self._known = self._bloom = None
        if size // 2 <= broadcast_grams:  # a run of words starts at every second character at most
            self.grams = spark.sparkContext.broadcast(Grams([tuple(r) for r in self.items.collect()], n))

    def matches(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, item_id, distinct: documents with a run of ``n`` words of the item."""
        rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
        if self.grams is None:
            return self._by_join(rows)
        grams = self.grams

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = grams.value
            for b in batches:
                found = {(t, i) for t, _, items in g.hits([words(x) for x in b["text"]]) for i in items}
                ids = b["doc_id"].to_numpy()
                if found:
                    yield pd.DataFrame({"doc_id": [ids[t] for t, _ in found], "item_id": [i for _, i in found]})

        kind = dict(rows.dtypes)["doc_id"]
        return rows.mapInPandas(scan, f"doc_id {kind}, item_id long").distinct()

    # -- more runs than are broadcast -----------------------------------------------------------------------------------

    def _windows(self, rows: DataFrame, keys: list[str], bloom=None) -> DataFrame:
        """keys, k, h1, h2: where each run of ``n`` words begins, and its hash; only those the filter lets through."""
        n = self.n

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    w = words(r[-1])
                    if len(w) < n:
                        continue
                    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(w[k : k + n])) for k in range(len(w) - n + 1)), np.int64).reshape(-1, 2)
                    at = np.arange(len(raw)) if bloom is None else np.flatnonzero(_passes(bloom.value, raw))
                    if len(at):
                        yield pd.DataFrame({k: [v] * len(at) for k, v in zip(keys, r)} | {"k": at, "h1": raw[at, 0], "h2": raw[at, 1]})

        kinds = dict(rows.dtypes)
        return rows.select(*keys, rows.columns[-1]).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "k long, h1 long, h2 long"]))

    def _runs(self) -> DataFrame:
        """item_id, h1, h2 of all items, as a table, and the filter of their hashes."""
        if self._known is None:
            known = written(self._windows(self.items, ["item_id"]).drop("k").distinct(), "item-runs")
            place = F.explode(F.array(*(F.pmod(h, F.lit(BLOOM_BITS)) for h in ("h1", "h2"))))
            bits = known.select(place.alias("p")).groupBy(F.call_function("div", F.col("p"), F.lit(64).cast("long")).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
            filled = np.zeros(BLOOM_BITS // 64, np.int64)
            for r in bits.toPandas().itertuples(index=False):  # BLOOM_BITS / 64 rows at most
                filled[r.w] = r.b
            self._known, self._bloom = known, known.sparkSession.sparkContext.broadcast(filled)
        return self._known

    def _by_join(self, rows: DataFrame) -> DataFrame:
        known = self._runs()
        return self._windows(rows, ["doc_id"], self._bloom).join(known, ["h1", "h2"]).select("doc_id", "item_id").distinct()

    def _spanned(self, rows: DataFrame) -> DataFrame:
        """The rows with ``spans``: start, end, n_words of the leaked stretches of ``text``, null or empty without any."""
        kind = "array<struct<start: bigint, end: bigint, n_words: bigint>>"
        n = self.n
        if self.grams is not None:
            grams = self.grams

            @F.pandas_udf(kind)
            def scan(text: pd.Series) -> pd.Series:
                texts = [t or "" for t in text]
                starts = defaultdict(list)
                for t, k, _ in grams.value.hits([words(x) for x in texts]):
                    starts[t].append(k)
                return pd.Series([stretches(texts[t], starts[t], n) if t in starts else None for t in range(len(texts))], dtype=object)

            return rows.withColumn("spans", scan("text"))

        @F.pandas_udf(kind)
        def join(text: pd.Series, starts: pd.Series) -> pd.Series:
            return pd.Series([None if k is None else stretches(t, list(k), n) for t, k in zip(text, starts)], dtype=object)

        # where the runs stand follows from the text, so each text is looked up once and by what it says
        known = self._runs().select("h1", "h2").distinct()
        keyed = rows.withColumn("h1_", F.xxhash64("text")).withColumn("h2_", F.xxhash64(F.lit(1), "text"))
        texts = keyed.where("text is not null").groupBy("h1_", "h2_").agg(F.first("text").alias("text"))
        found = self._windows(texts, ["h1_", "h2_"], self._bloom).join(known, ["h1", "h2"]).groupBy("h1_", "h2_").agg(F.sort_array(F.collect_set("k")).alias("starts_"))
        return keyed.join(found, ["h1_", "h2_"], "left").withColumn("spans", join("text", "starts_")).drop("h1_", "h2_", "starts_")

    def spans(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, start, end, n_words: the stretches of text covered by leaked runs, overlapping ones as one, in characters."""
        rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
        return self._spanned(rows).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")

    def cleaned(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, text, n_removed: every document, leaked spans replaced by one blank each, whatever its doc_id."""
        rows = self._spanned(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))
        first = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
        cut = lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(" ")).alias("kept"), s["end"].alias("at"))
        rest = F.aggregate("spans", first, cut, lambda acc: F.concat(acc["kept"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
        # offsets count code points, as Spark's substring does
        return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest).alias("text"), F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_removed"))
