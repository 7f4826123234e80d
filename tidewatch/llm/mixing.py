"""Mixing of sources to target weights, by a multivariate-hypergeometric splitting tree.

1. Sources get weights by rank and share the words of all documents. A target above ``most`` times its source is cut to that, and what
   is cut off is shared again, by weight, until no target is above.
2. The words of a source, its documents one after the other, are cut into blocks of BLOCK words. A target is so many whole epochs of
   all blocks and a last one that ends after the right number of blocks, the last of which may be cut short. This
   makes the quota of blocks exact, and the words equal to the rounded target.
3. The quotas are dealt to output shards of equally many blocks by a tree: each node splits its blocks of every source over its children as
   drawing without replacement would, so that a child's counts are multivariate hypergeometric given the node's. A level of the tree
   is a grouping by node; sources go by bundles, first bundles are split and then the sources in each, so no group holds
   more than BUNDLE sources or one row per bundle.
4. Each shard draws its blocks from where the shards before it stopped, in the order of a keyed permutation of the source's blocks (a Feistel
   network; no sort), so the draws are disjoint and cover the quota. A shard shuffles its blocks by hash.

All draws come from hashes of a seed, the source, the epoch and the node, so reruns agree on any layout of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import documents
from tidewatch.sources.staging import measured, stage

BLOCK = 128  # words
SHARD = 8192  # blocks of an output shard
FAN = 32  # children of a node
BUNDLE = 1024  # sources that are split together
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def _generator(*parts) -> np.random.Generator:
    key = hashlib.sha256(":".join(map(str, parts)).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(key[:16], "little")))


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their rank (from 0) in that order: a range sort, a count per range, and its running sum."""
    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    low = F.col("at") - F.shiftleft(F.col("part"), 33)
    return dealt.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", low + F.col("before")).drop("at", "part", "before")


def targets(sizes: DataFrame, weights: list[float], most: float = MOST) -> DataFrame:
    """(source, source_size) with ``rank``, ``weight`` and ``target``. Sources in code-point order, null last, weigh ``weights``, repeating."""
    order = sizes.withColumn("last", F.col("source").isNull())
    ranked = _ranked(order, "last", "source").drop("last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stage(ranked.withColumn("weight", weight), "source-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    cap, share = F.col("source_size") * float(most), 0.0
    before = -1
    while True:  # each round cuts further sources; what is left is shared by the others
        above = F.col("weight") * F.lit(share) > cap
        found = rows.agg(
            F.count_if(above).alias("cut"), F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("words"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if found["cut"] == before:
            return rows.withColumn("target", F.least(F.col("weight") * F.lit(share), cap))
        before = found["cut"]
        if found["weight"]:
            share = (total - most * found["words"]) / found["weight"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(place: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 takes each place (or, ``back``, takes it from): a Feistel network over the next
    even power of two, walked on until it comes back below n."""
    out = place.astype(np.uint64)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for turn in range(4)[:: -1 if back else 1]:
                salt = k + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)
                if back:
                    left, right = right ^ (_mixed(left ^ _mixed(salt)) & m), left
                else:
                    left, right = right, left ^ (_mixed(right ^ _mixed(salt)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(seed: str, rank, epoch) -> np.ndarray:
    with np.errstate(over="ignore"):
        base = np.uint64(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little"))
        return _mixed(_mixed(base + np.asarray(rank, np.uint64)) + np.asarray(epoch, np.uint64))


def quotas(size: int, target: float, block: int, key_of) -> tuple[int, int, int]:
    """Blocks of a source, the blocks that it gives over all epochs, and the words that its last block is cut by."""
    blocks = -(-size // block)
    words = round(target)
    epochs, rest = divmod(words, size)
    if not rest:
        return blocks, epochs * blocks, 0
    short = blocks * block - size  # what the source's last block lacks
    drawn = -(-rest // block)
    if short:
        met = int(permute(np.array([blocks - 1]), np.array([blocks]), np.array([key_of(epochs)]), back=True)[0])
        if met < drawn:
            drawn = -(-(rest + short) // block)
        else:
            short = 0
    return blocks, epochs * blocks + drawn, drawn * block - short - rest


def _quotas(sources: DataFrame, block: int, seed: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (rank, size, *quotas(size, target, block, lambda e, r=rank: _key(seed, r, e)))
                for rank, size, target in zip(batch["rank"], batch["source_size"], batch["target"])
            ]
            yield pd.DataFrame(rows, columns=["rank", "size", "blocks", "drawn", "cut"])

    rows = sources.where("source_size > 0 and target > 0").select("rank", "source_size", "target")
    return rows.mapInPandas(work, "rank long, size long, blocks long, drawn long, cut long")


def _split(counts: np.ndarray, sizes: np.ndarray, generator: np.random.Generator) -> np.ndarray:
    """Counts of each kind for each child, drawn without replacement; children of the given sizes, which add up to the counts."""
    if len(sizes) == 1:
        return counts[None, :]
    middle = len(sizes) // 2
    first = _draw(counts, int(sizes[:middle].sum()), generator)
    return np.vstack([_split(first, sizes[:middle], generator), _split(counts - first, sizes[middle:], generator)])


def _draw(counts: np.ndarray, n: int, generator: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw, kind by kind."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for k, count in enumerate(counts):
        left -= int(count)
        out[k] = _hypergeometric(int(count), left, n, generator)
        n -= int(out[k])
    return out


def _hypergeometric(good: int, bad: int, n: int, generator: np.random.Generator) -> int:
    """Exact below 10^9 blocks, numpy's bound; greater urns, near the root of a tree over 100 TB, are drawn from by the normal limit."""
    if not good or not n:
        return 0
    if not bad:
        return n
    if good + bad < 1_000_000_000:
        return int(generator.hypergeometric(good, bad, n))
    share = good / (good + bad)
    spread = (n * share * (1 - share) * (good + bad - n) / (good + bad - 1)) ** 0.5
    return int(min(max(round(generator.normal(n * share, spread)), n - bad, 0), good, n))


def _children(node: int, level: int, shards: int, fan: int) -> list[tuple[int, int, int]]:
    """Children (number, first shard, shards) of a node at a level: a node spans ``fan ** level`` shards."""
    below = fan ** (level - 1)
    first = node * fan
    return [(c, c * below, min(below, shards - c * below)) for c in range(first, first + fan) if c * below < shards]


def _filled(first: int, n: int, blocks: int, shards: int) -> int:
    """Blocks of ``n`` shards from ``first`` on, if all shards hold equally many, up to one."""
    return (first + n) * blocks // shards - first * blocks // shards


def _bundles_dealt(level: int, shards: int, total: int, seed: str, fan: int):
    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bundle")
        node = int(frame["node"].iloc[0])
        children = _children(node, level, shards, fan)
        sizes = np.array([_filled(first, n, total, shards) for _, first, n in children], np.int64)
        out = _split(frame["n"].to_numpy(np.int64), sizes, _generator(seed, level, node))
        return pd.DataFrame({"node": node, "bundle": np.repeat(frame["bundle"].to_numpy(), len(children)),
                             "child": np.tile([c for c, *_ in children], len(frame)), "size": out.T.ravel()})

    return deal


def _sources_dealt(level: int, seed: str):
    def deal(sources: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        sources, sizes = sources.sort_values("rank"), sizes.sort_values("child")
        node, bundle = int(sources["node"].iloc[0]), int(sources["bundle"].iloc[0])
        out = _split(sources["n"].to_numpy(np.int64), sizes["size"].to_numpy(np.int64), _generator(seed, level, node, bundle))
        frame = pd.DataFrame({"node": np.repeat(sizes["child"].to_numpy(), len(sources)),
                              "rank": np.tile(sources["rank"].to_numpy(), len(sizes)), "n": out.ravel()})
        return frame[frame["n"] > 0]

    return deal


def _deal(quota: DataFrame, shards: int, seed: str, fan: int = FAN, bundle: int = BUNDLE) -> DataFrame:
    """(shard, rank, n): the blocks of each source for each shard, the leaves of the tree."""
    total = quota.agg(F.sum("drawn")).first()[0] or 0
    level = 0
    while fan**level < shards:
        level += 1
    rows = quota.select(F.lit(0).cast("long").alias("node"), "rank", F.col("drawn").alias("n"))
    for at in range(level, 0, -1):
        rows = rows.withColumn("bundle", F.floor(F.col("rank") / bundle))
        packs = rows.groupBy("node", "bundle").agg(F.sum("n").alias("n"))
        sizes = packs.groupBy("node").applyInPandas(
            _bundles_dealt(at, shards, total, seed, fan), "node long, bundle long, child long, size long"
        )
        held = rows.groupBy("node", "bundle").cogroup(sizes.groupBy("node", "bundle"))
        rows = stage(held.applyInPandas(_sources_dealt(at, seed), "node long, rank long, n long"), "mixing-tree")
    return rows.withColumnRenamed("node", "shard")


def _drawn(dealt: DataFrame, quota: DataFrame, block: int, seed: str) -> DataFrame:
    """(shard, place, rank, epoch, block, words): the blocks of each shard, shuffled; ``words``: how many of the block's count."""
    before = F.sum("n").over(Window.partitionBy("rank").orderBy("shard")) - F.col("n")
    runs = dealt.withColumn("begin", before).join(quota, "rank")
    each = runs.withColumn("turn", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turn, blocks = b["turn"].to_numpy(np.int64), b["blocks"].to_numpy(np.int64)
            epoch = turn // blocks
            key = _key(seed, b["rank"].to_numpy(), epoch)
            found = permute(turn % blocks, blocks, key)
            words = np.minimum(b["size"].to_numpy(np.int64) - found * block, block)
            words = words - np.where(turn == b["drawn"].to_numpy() - 1, b["cut"].to_numpy(), 0)
            with np.errstate(over="ignore"):
                order = (_mixed(key ^ _mixed(found.astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
            yield pd.DataFrame({"shard": b["shard"], "rank": b["rank"], "epoch": epoch, "block": found, "words": words, "order": order})

    rows = each.select("shard", "rank", "turn", "size", "blocks", "drawn", "cut").mapInPandas(
        draw, "shard long, rank long, epoch long, block long, words long, order long"
    )
    # a shard holds SHARD blocks
    place = F.row_number().over(Window.partitionBy("shard").orderBy("order", "rank", "epoch", "block")) - 1
    return rows.withColumn("place", place).drop("order")


def _laid_out(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their rank and ``start``: the words of their source before them, in order of doc_id, size and digest."""
    by_source = sources.select(F.col("source").alias("source_"), "rank")
    rows = docs.join(by_source, F.col("source").eqNullSafe(F.col("source_"))).drop("source", "source_")
    order = ["rank", "doc_id", "size", "digest"]
    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "laid-out")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    sums = dealt.groupBy("part", "rank").agg(F.sum("size").alias("words"))  # at most a row per range and one per source
    before = F.sum("words").over(Window.partitionBy("rank").orderBy("part")) - F.col("words")
    inside = F.sum("size").over(Window.partitionBy("part", "rank").orderBy("at")) - F.col("size")
    return dealt.withColumn("inside", inside).join(sums.withColumn("before", before), ["part", "rank"]).select(
        "rank", "doc_id", "size", "digest", (F.col("inside") + F.col("before")).alias("start")
    )


class Mix:
    """A mix: ``sources`` (source, source_size, rank, weight, target), ``documents`` (rank, doc_id, size, digest, start) and ``pieces``
    (shard, place, epoch, rank, doc_id, start, skip, length): ``length`` words of a document from word ``skip`` on."""

    def __init__(self, sources: DataFrame, documents: DataFrame, pieces: DataFrame, blocks: DataFrame):
        self.sources, self.documents, self.pieces, self.blocks = sources, documents, pieces, blocks


def mix(docs: DataFrame, weights: list[float], most: float = MOST, seed: str = "mix", block: int = BLOCK, shard: int = SHARD) -> Mix:
    """Draw a mix of as many words as the documents have.

    Null and empty texts have no words and are never drawn. Documents without a source are a source of their own, the last. Documents
    without a doc_id come first in their source; repeated rows are documents each. Very long texts are cut like others. Sources without
    words have the target 0. An empty table gives an empty mix. Other columns are ignored.
    """
    digest = F.xxhash64("text")
    rows = documents(docs, "source").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), digest.alias("digest"))
    rows = stage(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage(targets(sizes, weights, most), "mix-targets")
    laid = stage(_laid_out(rows, sources), "mix-documents")
    quota = measured(_quotas(sources, block, seed))
    total = quota.agg(F.sum("drawn")).first()[0] or 0
    blocks = stage(_drawn(_deal(quota, max(1, -(-total // shard)), seed), quota, block, seed), "mix-blocks")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = laid.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    skip = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    stop = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
    pieces = parts.join(blocks, ["rank", "block"]).select(
        "shard", "place", "epoch", "rank", "doc_id", "start", skip.alias("skip"), (stop - skip).alias("length")
    )
    return Mix(sources, laid, stage(pieces.where("length > 0"), "mix-pieces"), blocks)


def taken_words(docs: DataFrame, weights: list[float], most: float = MOST, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (its words in the mix, with repeats)."""
    made = mix(docs, weights, most, **how)
    # rank and start name a document that has words; one without has no piece
    taken = made.pieces.groupBy("rank", "start").agg(F.sum("length").alias("taken"))
    named = made.documents.join(made.sources.select("rank", "source_size", "target"), "rank")
    out = named.where("size > 0").join(taken, ["rank", "start"], "left").unionByName(named.where("size = 0"), allowMissingColumns=True)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, made: Mix) -> DataFrame:
    """The mix itself: shard, place, epoch, doc_id, start, skip, text; a shard in order of place, start and skip.

    A piece keeps the white space after each of its words.
    """
    rows = documents(docs).withColumn("digest", F.xxhash64("text"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(1))))
    names = made.documents.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("rank", "start")))
    names = names.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), F.col("copy").alias("c"), "rank", "start")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")) & (F.col("copy") == F.col("c"))
    cuts = F.array_sort(F.collect_list(F.struct("skip", "length", "shard", "place", "epoch"))).alias("cuts")
    wanted = made.pieces.groupBy("rank", "start").agg(cuts)
    held = rows.join(names, same).join(wanted, ["rank", "start"]).select(F.col("doc_id").cast("string").alias("doc_id"), "start", "text", "cuts")
    kind = docs.schema["doc_id"].dataType
    schema = "shard long, place int, epoch long, doc_id string, start long, skip long, text string"
    return held.mapInArrow(_cut, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    word = re.compile(WORD + r"[\x20\x09-\x0D]*")
    names = ["shard", "place", "epoch", "doc_id", "start", "skip", "text"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for row in batch.to_pylist():
            words = word.findall(row["text"])
            out = [
                (c["shard"], c["place"], c["epoch"], row["doc_id"], row["start"], c["skip"], "".join(words[c["skip"] : c["skip"] + c["length"]]))
                for c in row["cuts"]
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)
