"""Repeated runs of lines, found with a suffix array over line ids; later copies are deleted.

1. Exact copies of a whole text are settled by a grouping; only the first takes part in what follows.
2. Only lines that occur twice or more can be in a repeated run. Stretches of such lines with too few words are left out.
3. Prefix doubling ranks the suffixes of the stretches: level 0 by their first line, each further level by the pairs of
   ranks at a distance of 2^k. Distinct pairs are sorted over the cluster, so a rank is the place of a suffix
   in the suffix array as far as 2^(k+1) lines tell, and suffixes with a common prefix of that length are one interval.
4. A run that counts has ``min_words`` words. From every line that begins or ends such a run, the shortest one is taken:
   its lcp interval, all suffixes that share its L lines, is named by L and the ranks of its first and last 2^k lines
   (2^k <= L < 2^(k+1)). The union of these runs is the union of all maximal repeated runs that count.
   As a run has at most ``min_words`` lines, few levels suffice.
5. The first run of an interval stays. The lines of the others go, and with them documents of which nothing is left.
   A bitmap of fixed size tells most texts that lose nothing; these are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import free_names, hand_back
from tidewatch.llm.shingle_join import bitmap, in_bitmap
from tidewatch.sources.staging import stage

MIN_WORDS = 50
BUCKET_ROWS = 50_000

_LAST = (1 << 63) - 1
_LINES = 10**9  # more lines than a text can have
_WHITE = r"[\x20\x09-\x0D]+"


def _place(doc: Column, text_hash: Column, line: Column) -> Column:
    """One number in the order of documents (rows without an id last), texts of one id, and lines."""
    wide = lambda c: c.cast("decimal(38,0)")
    return wide((wide(doc) + F.expr("9223372036854775808BD")) * F.expr("1000000000000000000BD")
                + wide(F.pmod(text_hash, F.lit(_LINES)) * _LINES + line))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text")
    )


def _count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _WHITE), lambda x: x != ""))


def _copies(keyed: DataFrame, min_words: int) -> DataFrame:
    """(d, h) of later exact copies of texts with enough words."""
    rows = keyed.select("d", "h", F.md5("text").alias("md5"), (_count_words(F.col("text")) >= min_words).alias("long"))
    rows = rows.where("long").groupBy("md5", "d", "h").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("md5").agg(F.min("d").alias("first"), F.count("*").alias("docs")).where("docs > 1")
    return rows.join(firsts, "md5").where("d > first").select("d", "h")


def _lines(keyed: DataFrame) -> DataFrame:
    """(d, h, j, line, w, h1, h2): lines that are not blank, the j-th of its document, with words and two hashes."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(F.regexp_replace(x, _WHITE, " ")).alias("x"), i.alias("i")))
    rows = keyed.select("d", "h", F.posexplode(F.filter(numbered, lambda s: s.x != "")).alias("j", "s"))
    x = F.col("s.x")
    return rows.select("d", "h", "j", F.col("s.i").alias("line"), F.size(F.split(x, " ")).alias("w"),
                       F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines that occur more than once, in stretches (d, h, s) of neighbours that have enough words together."""
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    document = Window.partitionBy("d", "h").orderBy("j")
    rows = lines.distinct().join(repeated, ["h1", "h2"])
    rows = rows.withColumn("s", F.col("j") - F.row_number().over(document))
    rows = rows.withColumn("total", F.sum("w").over(Window.partitionBy("d", "h", "s")))
    return rows.where(F.col("total") >= min_words).drop("total")


def _ranked(pairs: DataFrame, name: str) -> DataFrame:
    """Distinct pairs (a, b) with an order-preserving number: sorted over the cluster, then numbered in turn."""
    ordered = pairs.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    return stage(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(stretches: DataFrame, levels: int) -> DataFrame:
    """Prefix doubling: adds r0, r1, ... , the ranks of each suffix by its first 1, 2, 4, ... lines."""
    ids = _ranked(stretches.select(F.col("h1").alias("a"), F.col("h2").alias("b")), "suffix-rank-0")
    rows = stretches.join(
        ids.select(F.col("a").alias("h1"), F.col("b").alias("h2"), F.col("rank").alias("r0")), ["h1", "h2"]
    ).drop("h1", "h2")
    inside = Window.partitionBy("d", "h", "s").orderBy("j")
    for k in range(1, levels):
        rows = stage(rows.withColumns({
            "a": F.col(f"r{k - 1}"), "b": F.coalesce(F.lead(f"r{k - 1}", 1 << (k - 1)).over(inside), F.lit(-1).cast("long"))
        }), f"suffixes-{k}")
        ids = _ranked(rows, f"suffix-rank-{k}").withColumnRenamed("rank", f"r{k}")
        rows = rows.join(ids, ["a", "b"]).drop("a", "b")
    return rows


def shortest_runs(w: np.ndarray, min_words: int) -> np.ndarray:
    """(begin, length) of the shortest runs with enough words that begin, and that end, at each line."""
    total = np.concatenate([[0], np.cumsum(w)])
    ends = np.searchsorted(total, total[:-1] + min_words)  # lines begin .. ends - 1
    begins = np.flatnonzero(ends < len(total))
    first = np.column_stack([begins, ends[begins] - begins])
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # lines starts .. end
    ends = np.flatnonzero(starts >= 0)
    last = np.column_stack([starts[ends], ends - starts[ends] + 1])
    return np.unique(np.concatenate([first, last]), axis=0)


def _runs(frame: pd.DataFrame, min_words: int, levels: int) -> pd.DataFrame:
    frame = frame.sort_values(["d", "h", "s", "j"])
    ranks = frame[[f"r{k}" for k in range(levels)]].to_numpy()
    key = frame[["d", "h", "s"]].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
    w, line, out = frame["w"].to_numpy(), frame["line"].to_numpy(), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        runs = shortest_runs(w[a:b], min_words)
        if len(runs):
            begin, length = runs[:, 0] + a, runs[:, 1]
            k = np.log2(length).astype(int)
            out.append(np.column_stack([
                np.broadcast_to(key[a, :2], (len(runs), 2)), line[begin], line[begin + length - 1], length,
                ranks[begin, k], ranks[begin + length - (1 << k), k],
            ]))
    columns = ["d", "h", "begin", "end", "length", "a", "b"]
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 7), np.int64), columns=columns)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, whole, begins, ends): what to delete of each document that loses lines; whole for exact copies."""
    keyed = _keyed(docs)
    copies = stage(_copies(keyed, min_words), "text-copies")
    lines = _lines(keyed).join(copies, ["d", "h"], "left_anti")
    stretches = stage(_stretches(lines, min_words), "line-stretches")
    # a run of min_words words has at most so many lines, and its ranks at most so many levels
    longest = stretches.groupBy("d", "h", "s").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    levels = int(min(min_words, longest)).bit_length()
    ranked = suffix_ranks(stretches, levels)
    buckets = max(1, stretches.count() // BUCKET_ROWS)
    runs = stage(
        ranked.withColumn("bucket", F.pmod(F.xxhash64("d", "h"), F.lit(buckets))).groupBy("bucket").applyInPandas(
            lambda frame: _runs(frame, min_words, levels), "d long, h long, begin long, end long, length long, a long, b long"
        ).withColumn("place", _place(F.col("d"), F.col("h"), F.col("begin"))),
        "line-runs",
    )
    interval = ["length", "a", "b"]
    firsts = runs.groupBy(*interval).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = runs.join(firsts, interval).where("place > first")
    # a copy that overlaps the first one in the same document loses only what lies beyond it
    line = lambda place: F.col(place) % F.lit(_LINES).cast("decimal(10,0)")
    inside = F.col("place") - line("place") == F.col("first") - line("first")
    beyond = line("first").cast("long") + F.col("end") - F.col("begin") + 1
    begin = F.when(inside, F.greatest("begin", beyond)).otherwise(F.col("begin"))
    spans = later.select("d", "h", begin.alias("begin"), "end").where("begin <= end").distinct()
    spans = spans.groupBy("d", "h").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return spans.select("d", "h", F.lit(False).alias("whole"), "spans").unionByName(
        copies.select("d", "h", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    )


def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        yield _without(texts, spans)
        del texts, spans
    hand_back()


def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, some in zip(texts, spans):
        lines = text.split("\n")
        gone = np.zeros(len(lines), bool)
        for s in some:
            gone[int(s["begin"]) : int(s["end"]) + 1] = True
        kept = [x for x, g in zip(lines, gone) if not g]
        rows.append(("\n".join(kept), int(gone.sum()), sum(1 for x in kept if x.strip())))
    return pd.DataFrame(rows, columns=["text", "removed", "left"])


def mark_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``text`` rid of later copies, ``lines_removed``, and ``nothing_left``.

    Runs of lines with at least ``min_words`` words that occur earlier, in a document of a smaller doc_id or before in the same,
    are deleted. Lines are compared without white space around and with single spaces inside; blank lines are
    passed over and go with the run around them. Null and empty texts stay as they are. Rows without a doc_id come after all others. Rows
    that repeat id and text are one document and fare alike. Very long texts and runs are worked through whole. Other columns pass
    through; where one has the name of a new column, the new one gets a line under its name. An empty table gives no rows.
    """
    doc, digest, whole, spans, new, removed, nothing = free_names(
        docs, "doc", "hash", "whole", "spans", "new", "lines_removed", "nothing_left"
    )
    changes = repeated_runs(docs, min_words).select(
        F.col("d").alias(doc), F.col("h").alias(digest), F.col("whole").alias(whole), F.col("spans").alias(spans)
    )
    changes = stage(changes, "line-changes")
    some = docs.sparkSession.sparkContext.broadcast(bitmap(changes.select(F.xxhash64(doc, digest).alias("id")), "id"))

    @F.pandas_udf("boolean")
    def may_change(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(in_bitmap(some.value, hashes.to_numpy(np.int64)))
        hand_back()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), digest: F.xxhash64(text)})
    # only texts that the bitmap lets through travel to the changes; all others stay where they are
    id_ = F.xxhash64(doc, digest)
    untouched = rows.where(~may_change(id_)).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.lit(0).alias(removed), F.lit(False).alias(nothing)
    )
    # Python workers live on after their task, so no task has more than one: a merge join parts the bitmap's from those that cut
    # texts, and a filter on what was cut is not pushed below it, which would cut every text twice
    rows = rows.where(may_change(id_)).join(changes.hint("merge"), [doc, digest], "left")
    without = F.pandas_udf(_cut, "text string, removed int, left int").asNondeterministic()
    cut = rows.where(F.col(spans).isNotNull()).withColumn(new, without("text", spans))
    cut = cut.select(*[F.col(f"{new}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                     F.col(f"{new}.removed").alias(removed), (F.col(f"{new}.left") == 0).alias(nothing))
    n_lines = F.size(F.split(text, "\n"))
    rest = rows.where(F.col(spans).isNull()).select(
        *[F.when(F.col(whole), "").otherwise(F.col(c)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(whole), n_lines).otherwise(0).alias(removed), F.coalesce(whole, F.lit(False)).alias(nothing),
    )
    return cut.unionByName(rest).unionByName(untouched)


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs, and without documents of which nothing is left; all else as ``mark_repeats`` says."""
    *_, nothing = free_names(docs, "lines_removed", "nothing_left")
    return mark_repeats(docs, min_words).where(~F.col(nothing)).select(*[F.col(f"`{c}`") for c in docs.columns])
