"""Texts that stop before their end, and how often each source cuts them.

Per source and column, exact histograms of text length in characters and in bytes show how a source cuts: many texts of
exactly the greatest length or of another one that stands far out of its neighbours, a heap just below such a limit (cut
back to a word, a mark added), or too many whole multiples of a block size, which the histogram gives: the greatest
common divisor of the heaps, or a power of two, whichever explains most. Copies of a text make no heap at another length.

At a length at which its source cuts, a text that does not end like a whole one (a stop, or the end of its structure) is
flagged by that limit; just below one, a text that breaks off or ends in an omission mark. Away from any limit no
histogram can tell; there a text is flagged only where its structure is left open: an environment, group or formula, an
unended command, a last sentence without its stop. Each flag carries which of the three found it.

Null texts are no texts; an empty text is whole; repeated rows each count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.ordered import join_same
from tideline.session import written

BROADCAST_ROWS = 100_000
NEIGHBOURS = 64  # lengths on either side of one that are looked at for how many texts it would have by chance

LEAST_BLOCK, POWERS = 64, range(6, 25)  # blocks that are looked for: heaps' divisors from there on, and powers of two

#: What flags a text.
LIMIT, NEAR, STRUCTURE = "limit", "near_limit", "structure"
#: How a text ends.
WHOLE, UNSURE, MARKED, CUT = 0, 1, 2, 3

_ENV = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}")
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_ESCAPED = re.compile(r"\\(?:\\(?:\[[^\]\n]*\])?|[{}$%])")
_MARK = re.compile(r"(?:\[\s*(?:…|\.\.\.|truncated|cut)\s*\]|\((?:…|\.\.\.|truncated)\)|…|\.\.\.)$", re.I)
_STOP = re.compile(r"[.!?][)\]}'\"”’»$]*$|[.!?]\s*\\(?:qed|hfill\S*)$")
_COMMANDS_ONLY = re.compile(r"(?:\\[A-Za-z@]+\*?(?:\s*\[[^\]]*\]|\s*\{[^{}]*\})*\s*|\$\\[A-Za-z]+\$\s*)+$")
_BARE = re.compile(r"\\([A-Za-z@]+)\*?$")
_DISPLAY_END = re.compile(r"(?:\\\]|\$\$|\\end\s*\{[^{}]*\})$")
_ELLIPSIS = re.compile(r"\\[lcd]?dots(?:\{\})?$")
_KEYWORDS = re.compile(r"\s*(?:\\(?:textbf|textit|emph|paragraph)\{)?(?:key\s?words?|index terms|schl(?:ü|\\\"u)sselw(?:ö|\\\"o)rter|mots[- ]cl(?:é|\\'e)s|palavras[- ]chave)\b", re.I)

#: Commands that may stand last in a whole text, without and with arguments.
LAST_COMMANDS = frozenset("ldots dots cdots qed qedhere qedsymbol square blacksquare Box endinput bye end printbibliography printindex maketitle appendix clearpage newpage cleardoublepage tableofcontents bigskip medskip smallskip hfill vfill null par noindent relax".split())

LAST_WITH_ARGUMENT = frozenset("bibliography bibliographystyle input include printbibliography nocite".split())


def _open_environment(body: str) -> bool:
    stack: list[str] = []
    for m in _ENV.finditer(body):
        kind, name = m.groups()
        if name == "document":
            continue
        if kind == "begin":
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return bool(stack)


def ending(text: str | None) -> int:
    """WHOLE, CUT, or what depends on the length: UNSURE, MARKED (an omission mark stands last)."""
    if not text or not text.strip():
        return WHOLE
    if text.endswith("\ufffd"):
        return CUT
    s = text.rstrip()
    body = _COMMENT.sub("", text) if "%" in text else text
    flat = _ESCAPED.sub("", body)
    if _open_environment(body) or flat.count("{") > flat.count("}") or flat.count("$") % 2 or flat.count("\\[") > flat.count("\\]"):
        return CUT
    if s.endswith("\\end{document}"):
        return WHOLE
    lines = s.split("\n")
    last = lines[-1].strip()
    if last.startswith("%"):
        # commented-out prose has a stop like any other; a note of one line need not
        block = [last]
        for line in reversed(lines[:-1]):
            if not line.lstrip().startswith("%"):
                break
            block.append(line)
        before = "\n".join(lines[: -len(block)]).rstrip()
        return WHOLE if _STOP.search(last) or before.endswith("\\end{document}") else CUT if len(block) > 1 else UNSURE
    last = _COMMENT.sub("", last).rstrip() or last  # a note behind the text
    if _MARK.search(last):
        return MARKED
    if _STOP.search(last) or _DISPLAY_END.search(last):
        return WHOLE
    if _KEYWORDS.match(last) or (_ELLIPSIS.search(last) and not last.startswith("\\")):
        return UNSURE
    if last.startswith(("\\", "$")) and _COMMANDS_ONLY.match(last):
        bare, name = _BARE.search(last), re.findall(r"\\([A-Za-z@]+)", last)[-1]
        if name in LAST_COMMANDS or (name in LAST_WITH_ARGUMENT and not bare):
            return WHOLE
        return CUT if bare else UNSURE
    return UNSURE if last.endswith("$") else CUT


class Truncation:
    def __init__(self, df: DataFrame, source: str = "source", columns: Sequence[str] = ("text",), least: int = 3, band: float = 0.03):
        """``least``: texts that make a heap. ``band``: how far below the limit, as a share, a text cut back to a word may end."""
        self.df, self.source, self.columns, self.least, self.band = df, source, list(columns), least, band

    def _long(self, keep: Sequence[str], *values: tuple[str, callable]) -> DataFrame:
        """One row per text, with its column's name."""
        out = None
        for c in self.columns:
            text = F.col(f"`{c}`")
            part = self.df.where(text.isNotNull()).select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{self.source}`").alias("src"), F.lit(c).alias("col"), *(f(text).alias(n) for n, f in values))
            out = part if out is None else out.unionByName(part)
        return out

    def histograms(self) -> DataFrame:
        """src, col, unit (chars, bytes), length, n, texts: exact counts of every length, of rows and of different texts."""
        rows = self._long([], ("chars", F.length), ("bytes", F.octet_length), ("hash", F.xxhash64))
        unit = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("length")) for u in ("chars", "bytes"))))
        return rows.groupBy("src", "col", "chars", "bytes", "hash").agg(F.count(F.lit(1)).alias("n")).select("src", "col", unit.alias("x"), "n").groupBy("src", "col", "x.unit", "x.length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))

    def heaps(self, hist: DataFrame) -> DataFrame:
        """src, col, unit, and the lengths, whether the greatest or not, at which and just below which texts heap up beyond chance.

        Chance is the denser side of the neighbourhood and six deviations; a heap below a length is listed at the least one that shows it.
        """
        of = W.partitionBy("src", "col", "unit")
        texts = lambda over: F.coalesce(F.sum("texts").over(over), F.lit(0))
        beyond = lambda n, chance: (n >= self.least) & (n > chance + 6 * F.sqrt(chance) + 2)
        by_length, by_log = of.orderBy("length"), of.orderBy("log")
        side = F.greatest(texts(by_length.rangeBetween(-NEIGHBOURS, -1)) / F.least(F.col("length"), F.lit(NEIGHBOURS)), texts(by_length.rangeBetween(1, NEIGHBOURS)) / NEIGHBOURS)
        step = lambda share: round(math.log(share) * 1e9)
        one, four = step(1 - self.band), step(1 - 4 * self.band)
        h = hist.where("length > 0").withColumn("log", F.round(F.log("length") * 1e9).cast("long")).withColumn("side", side)
        near = texts(by_log.rangeBetween(one + 1, 0))
        around = F.greatest(texts(by_log.rangeBetween(four, one)), texts(by_log.rangeBetween(1, step(1 + 3 * self.band)))) / 3
        h = h.withColumn("at", beyond(F.col("texts"), F.col("side"))).withColumn("near", near).withColumn("around", around + 0.5)
        h = h.withColumn("below", beyond(F.col("near"), F.col("around")))
        h = h.withColumn("again", F.coalesce(F.bool_or("below").over(by_log.rangeBetween(one, -1)), F.lit(False)))
        return h.groupBy("src", "col", "unit").agg(F.collect_list(F.when(F.col("at"), F.col("length"))).alias("at"), F.collect_list(F.when(F.col("below") & ~F.col("again"), F.col("length"))).alias("below"))

    def blocks(self, hist: DataFrame, heaps: DataFrame) -> DataFrame:
        """src, col, block: the size of whose multiples a source has far more byte lengths than chance, if there is one.

        Of all sizes that do, the greatest that explains nearly as many texts as the best: multiples of 1024 are multiples of 512.
        """
        divisor = lambda a, b: F.aggregate(F.sequence(F.lit(0), F.lit(96)), F.struct(a.alias("a"), b.alias("b")), lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % F.when(x["b"] == 0, F.lit(1)).otherwise(x["b"])).alias("b"))), lambda x: x["a"])
        common = F.aggregate("at", F.lit(0).cast("long"), lambda acc, x: divisor(acc, x))
        powers = F.array(*(F.lit(1 << k).cast("long") for k in POWERS))
        of_bytes = heaps.where("unit = 'bytes'").select(F.col("src").alias("src_"), F.col("col").alias("col_"), F.array_distinct(F.array_append(powers, common)).alias("sizes"))
        h = hist.where("unit = 'bytes' and length > 0").join(of_bytes, F.expr("src <=> src_ and col = col_"))
        tried = h.select("src", "col", "length", "texts", F.explode(F.filter("sizes", lambda x: x >= LEAST_BLOCK)).alias("block"))
        per = tried.groupBy("src", "col", "block").agg(F.sum(F.when(F.col("length") % F.col("block") == 0, F.col("texts")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("length") >= F.col("block"), F.col("texts")).otherwise(0)).alias("all_"))
        chance = F.col("all_") / F.col("block")
        per = per.where((F.col("hits") >= self.least) & (F.col("hits") > chance + 6 * F.sqrt(chance) + 2))
        best = F.max("hits").over(W.partitionBy("src", "col"))  # a row per size
        return per.where("hits > 0").withColumn("best", best).where(F.col("hits") >= 0.75 * F.col("best")).groupBy("src", "col").agg(F.max("block").alias("block"))

    def spikes(self) -> DataFrame:
        """src, col, and per unit: the limits at which texts heap up exactly, the limits just below which they do; and the size of blocks."""
        hist = written(self.histograms(), "length-histograms")
        top = hist.groupBy("src", "col", "unit").agg(F.max("length").alias("top"))
        h = join_same(hist, top, ["src", "col", "unit"])
        n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        x = F.col("length") / F.col("top")
        near, below = x > 1 - self.band, (x <= 1 - self.band) & (x > 1 - 4 * self.band)
        per = h.groupBy("src", "col", "unit", "top").agg(n(x == 1).alias("n_top"), n(near).alias("n_near"), n(below).alias("n_below"))
        heap = lambda c: (F.col(c) >= self.least)
        more = written(self.heaps(hist), "length-heaps")
        per = join_same(per, more, ["src", "col", "unit"], "left")
        limits = lambda top, more: F.array_union(F.when(top, F.array("top")).otherwise(F.array().cast("array<bigint>")), F.coalesce(more, F.array().cast("array<bigint>")))
        per = per.select("src", "col", "unit", limits(heap("n_top"), F.col("at")).alias("exact"), limits(heap("n_near") & (F.col("n_near") > F.col("n_below")), F.col("below")).alias("about"))
        of = lambda u, c: F.max(F.when(F.col("unit") == u, F.col(c)))
        out = per.groupBy("src", "col").agg(of("chars", "exact").alias("exact_chars"), of("bytes", "exact").alias("exact_bytes"), of("chars", "about").alias("about_chars"), of("bytes", "about").alias("about_bytes"))
        return join_same(out, self.blocks(hist, more), ["src", "col"], "left")

    def flags(self, *keep: str) -> DataFrame:
        """keep, src, col, chars, bytes, at_limit, ending, reason, truncated: one row per text; reason is null for whole ones."""

        @F.pandas_udf("byte")
        def read(text: pd.Series) -> pd.Series:
            return text.map(ending).astype("int8")

        rows = self._long(keep, ("chars", F.length), ("bytes", F.octet_length), ("ending", read))
        s = written(self.spikes().withColumnsRenamed({"src": "src_", "col": "col_"}), "length-spikes")
        if s.count() <= BROADCAST_ROWS:  # a row per source and column
            s = F.broadcast(s)
        flagged = lambda c: F.coalesce(c, F.lit(False))
        exact: Column = flagged(F.array_contains("exact_chars", F.col("chars").cast("long"))) | flagged(F.exists("exact_bytes", lambda x: F.col("bytes").between(x - 3, x))) | flagged((F.col("bytes") > 0) & (F.col("bytes") % F.col("block") == 0))
        below = lambda unit: flagged(F.exists(f"about_{unit}", lambda x: (F.col(unit) <= x) & (F.col(unit) > x * (1 - self.band))))
        open_, near = F.col("ending") != WHOLE, F.col("ending").isin(CUT, MARKED) & (below("chars") | below("bytes"))
        reason = F.when(exact & open_, LIMIT).when(near, NEAR).when(F.col("ending") == CUT, STRUCTURE)
        out = rows.join(s, F.expr("src <=> src_ and col = col_"), "left").withColumn("reason", reason)
        return out.select(*keep, "src", "col", "chars", "bytes", exact.alias("at_limit"), "ending", "reason", F.col("reason").isNotNull().alias("truncated"))

    def rates(self) -> DataFrame:
        """source, column, reason, n, n_at_limit, n_truncated, share: how often each source cuts each column, for any reason and for each."""
        per = self.flags().groupBy("src", "col").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("at_limit"), 1)).alias("n_at_limit"), F.count("reason").alias("any"), *(F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in (LIMIT, NEAR, STRUCTURE))
        )
        each = F.explode(F.array(*(F.struct(F.lit(r).alias("reason"), F.col(r).alias("n_truncated")) for r in ("any", LIMIT, NEAR, STRUCTURE))))
        rows = per.select("src", "col", "n", "n_at_limit", each.alias("x"))
        return rows.select(F.col("src").alias("source"), F.col("col").alias("column"), "x.reason", "n", "n_at_limit", "x.n_truncated", (F.col("x.n_truncated") / F.col("n")).alias("share"))
