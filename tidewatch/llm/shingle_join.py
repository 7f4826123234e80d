"""Near duplicates by the Jaccard similarity of word n-gram sets, found with signature trees.

1. Each text becomes the set of its hashed shingles; texts with equal sets are one class from here on. The lower half of a set's hashes is
   staged, as prefixes lie in it.
2. Prefix filter: with any fixed order of shingles, two sets that reach the threshold share s of their first
   n - ceil(t n) + s, or all that they share if that is less. The more sets hold a shingle, the later it comes in that order, in steps, so that shared passages stay
   out of the prefixes of texts that have enough of their own. Which these are is counted among the first shingles of all
   sets by hash and told by bitmaps of fixed size; where they err, the order is still the same for all. A shingle that many
   prefixes hold ties its classes together. Shingles that few hold are counted for each pair of classes; pairs with s of them, and of
   sizes that may link, are tied as well. So a shingle met by chance, of which there are the more the larger the table, ties nothing.
   Classes tied directly or through others form a region; every link lies within one, and most texts are in none.
3. In a region a signature tree is built: leaves hold a few sets that lie close together, each node the OR
   of its sets' bitmaps and the range of their sizes. A dual traversal descends into a pair of nodes
   only if the greatest overlap that bitmaps and sizes allow reaches the threshold, and if the
   two are not yet connected. Leaf pairs are verified on the sets themselves.
4. A region too large for one task is formed anew by size: sets link only within a band of sizes or with the next, and only classes
   of such a pair of bands that are tied, directly or through others of that pair, stay together. What is still too large is cut into blocks. Every block is first joined with itself
   and a few pivots of the region; then only classes outside the region's largest component meet
   the other blocks. So a huge group of copies never meets itself, and no pair list is ever written.
5. Components of the found links, which are between classes, give each document the smallest doc_id it is linked with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Forest, components, documents, drop_read_shuffles, free_names, hand_back, in_slices, words
from tidewatch.sources.staging import stage

BLOCK = 2048  # classes of a region that one task compares
PIVOTS = 8
LEAF, FANOUT = 8, 4
BITS_A_SHINGLE, LEAST_BITS, MOST_BITS = 4, 1 << 11, 1 << 16  # of a signature, by the largest set of a block
MAP_BITS = 1 << 26  # most bits of a bitmap that is sent to all tasks; a fuller one only lets more through
MAP_PIECE = 1 << 18
MANY_TEXTS = 512  # a block with so many hands its memory back
BITS_A_KEY = 16
COUNTED = 1.6  # so many prefix lengths of a set's shingles are counted; affects speed only
COMMON = (1, 4, 16, 64, 256, 1024)  # shingles of more than so many sets come later in the order of prefixes, at each step; affects speed only
SHARED = 8  # prefix shingles that a pair has to share if no more than FEW rows hold each
FEW = 32

HALF = np.uint64(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; shorter texts are one shingle, empty ones none."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, len(found) if len(found) < n else n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


def class_key(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def needed(size: int, percent: int) -> int:
    """The least size of a partner, and of the overlap with it: ceil(t size)."""
    return -(-size * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


# --- signature tree -----------------------------------------------------------------------------

class Node:
    """``bits``: the OR of all below; ``low``, ``high``: their sizes; ``spare``: most shingles over own bits."""

    __slots__ = ("bits", "low", "high", "spare", "children", "members")

    def __init__(self, bits, low, high, spare, children=(), members=()):
        self.bits, self.low, self.high, self.spare = bits, low, high, spare
        self.children, self.members = children, members


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A signature per set, one bit per shingle, packed into 64-bit words."""
    wanted = BITS_A_SHINGLE * max(len(s) for s in sets)
    size = min(MOST_BITS, max(LEAST_BITS, 1 << wanted.bit_length()))
    out = np.zeros((len(sets), size // 64), np.uint64)
    row = np.zeros(size, np.uint8)
    for k, s in enumerate(sets):
        at = (s >> np.uint64(7)).astype(np.int64) % size
        row[at] = 1
        out[k] = np.packbits(row).view(np.uint64)
        row[at] = 0
    return out


def build(sets: list[np.ndarray], bits: np.ndarray, members: list[int]) -> Node:
    """Bottom up; sets are ordered by size class and smallest hashes, so that near copies share a leaf."""
    band = lambda s: int(np.log(len(s)) / 0.12)
    order = sorted(members, key=lambda i: (band(sets[i]), tuple(sets[i][:4].tolist()), i))
    level = []
    for k in range(0, len(order), LEAF):
        part = order[k : k + LEAF]
        sizes = np.array([len(sets[i]) for i in part])
        spare = int((sizes - np.bitwise_count(bits[part]).sum(1)).max())
        ored = np.bitwise_or.reduce(bits[part], axis=0)
        level.append(Node(ored, int(sizes.min()), int(sizes.max()), spare, members=tuple(part)))
    while len(level) > 1:
        above = []
        for k in range(0, len(level), FANOUT):
            part = tuple(level[k : k + FANOUT])
            ored = np.bitwise_or.reduce([x.bits for x in part], axis=0)
            above.append(Node(ored, min(x.low for x in part), max(x.high for x in part),
                              max(x.spare for x in part), children=part))
        level = above
    return level[0]


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether some pair below may reach the threshold.

    What two sets share lies on the common bits, c of them. A set whose shingles outnumber its own bits by s
    can have at most c + s shingles there. A link needs t times the larger size.
    """
    common = int(np.bitwise_count(x.bits & y.bits).sum())
    most = min(x.high, y.high, common + min(x.spare, y.spare)) if common else 0
    return most > 0 and most >= needed(max(x.low, y.low), percent)


def pairs_that_may_link(
    left: np.ndarray, right: np.ndarray, bits: np.ndarray, ones: np.ndarray, sizes: np.ndarray, percent: int
) -> Iterator[tuple[int, int]]:
    """The bound for single sets: bits that the other lacks belong to at least as many shingles of its own."""
    common = np.bitwise_count(bits[left][:, None] & bits[right][None]).sum(2).astype(np.int64)
    a, b = sizes[left][:, None], sizes[right][None]
    most = np.minimum(a - ones[left][:, None] + common, b - ones[right][None] + common)
    return zip(*np.nonzero((most > 0) & (100 * most >= percent * (a + b - most))))


def join_sets(
    sets: list[np.ndarray], sides: list[int], components_: list, percent: int, both: bool
) -> list[tuple[int, int]]:
    """Links (i, j) that connect what links connect: a spanning forest by dual traversal of signature trees.

    ``sides`` 0 or 1; with ``both`` all sets meet each other, else side 0 meets side 1 only. Sets with equal
    entries of ``components_`` (not None) are known to be connected.
    """
    n, out = len(sets), []
    if n < 2:
        return out
    bits = bitmaps(sets)
    ones = np.bitwise_count(bits).sum(1).astype(np.int64)
    sizes = np.array([len(s) for s in sets])
    forest, first = Forest(n), {}
    for i, c in enumerate(components_):
        if c is not None:
            forest.join(i, first.setdefault(c, i))

    def whole(node: Node) -> int | None:
        """The root all members below share, or None."""
        if node.members:
            roots = {forest.find(i) for i in node.members}
        else:
            roots = {whole(c) for c in node.children}
        return roots.pop() if len(roots) == 1 else None

    def close(x: Node, y: Node) -> None:
        left, right = np.array(x.members), np.array(y.members)
        for k, m in pairs_that_may_link(left, right, bits, ones, sizes, percent):
            i, j = int(left[k]), int(right[m])
            if (x is not y or k < m) and forest.find(i) != forest.find(j) and linked(sets[i], sets[j], percent):
                forest.join(i, j)
                out.append((i, j))

    if both:
        tree = build(sets, bits, list(range(n)))
        todo = [(tree, tree)]
    else:
        split = [[i for i in range(n) if sides[i] == side] for side in (0, 1)]
        if not all(split):
            return out
        todo = [(build(sets, bits, split[0]), build(sets, bits, split[1]))]
    while todo:
        x, y = todo.pop()
        if x is y:
            if x.members:
                close(x, x)
            elif whole(x) is None:
                todo.extend((c, d) for k, c in enumerate(x.children) for d in x.children[k + 1 :])
                todo.extend((c, c) for c in x.children)
            continue
        if not may_link(x, y, percent):
            continue
        root = whole(x)
        if root is not None and root == whole(y):
            continue
        if x.members and y.members:
            close(x, y)
        elif y.members or x.children and x.high - x.low >= y.high - y.low:
            todo.extend((c, y) for c in x.children)
        else:
            todo.extend((x, c) for c in y.children)
    return out


# --- distributed join ---------------------------------------------------------------------------

def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """BITS_A_KEY bits for each key (a long, spread evenly), MAP_BITS at most: bit key mod size is set. 64-bit words.

    Tasks pack the bits; what meets the driver is the bitmap itself, in pieces.
    """
    keys = stage(keys.select(key), "bitmap-keys")
    size = min(MAP_BITS, MAP_PIECE << (keys.count() * BITS_A_KEY // MAP_PIECE).bit_length())

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(MAP_PIECE, np.uint8)
        out[frame["bit"] % MAP_PIECE] = 1
        return pd.DataFrame({"piece": [frame["bit"].iloc[0] // MAP_PIECE], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    bits = keys.select(F.pmod(F.col(key), F.lit(size)).alias("bit")).distinct()
    pieces = bits.groupBy(F.floor(F.col("bit") / MAP_PIECE)).applyInPandas(pack, "piece long, bits binary").collect()
    out = np.zeros((size // MAP_PIECE, MAP_PIECE // 64), np.uint64)
    for piece in pieces:  # at most MAP_BITS / MAP_PIECE
        out[piece["piece"]] = np.frombuffer(piece["bits"], np.uint64)
    return out.ravel()


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.int64) % (64 * len(bits))
    return (bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def _number(key: str) -> int:
    """60 bits of a class key; should two classes share them, their regions only merge."""
    return int(key[:15], 16)


def _low(s: np.ndarray, percent: int) -> np.ndarray:
    """The lower half of the hashes, if it is sure to hold the prefix; else all of them."""
    part = s[: np.searchsorted(s, HALF)]
    return part if len(part) >= len(s) - needed(len(s), percent) + SHARED else s


def _measure(batches: Iterator[pd.DataFrame], n: int, percent: int) -> Iterator[pd.DataFrame]:
    """A row per document: its class, the size of its set, and the part of it that prefixes come from, as bytes."""
    for batch in in_slices(batches):
        sets = [shingles(t, n) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "size": [len(s) for s in sets],
            "key": [class_key(s) if len(s) else None for s in sets], "part": [_low(s, percent).tobytes() for s in sets],
        })


def _joined_parts(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of distinct sets one after the other, their sizes, those of the sets, and the numbers of the classes."""
    joined = np.frombuffer(b"".join(batch["part"]), np.uint64)
    held = batch["part"].str.len().to_numpy(np.int64) // 8
    return joined, held, batch["size"].to_numpy(np.int64), np.array([_number(k) for k in batch["key"]], np.int64)


def _first(sizes: np.ndarray, upto: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Which members of joined sets are among the first ``upto`` of theirs, ordered by level and then as they stand."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    lower = np.zeros(len(sizes), np.int64)  # members of each set on the levels before
    out = np.zeros(len(level), bool)
    for k in np.unique(level):
        on = level == k
        count = np.concatenate([[0], np.cumsum(on)])
        out |= on & (count[:-1] < np.repeat(upto - lower + count[begins], sizes))
        lower += count[ends] - count[begins]
    return out


def _levels(joined: np.ndarray, common: list[np.ndarray]) -> np.ndarray:
    """The step of each shingle in the order of prefixes: how many of the bitmaps hold it; the upper half comes last."""
    level = np.zeros(len(joined), np.int8)
    at = np.arange(len(joined))
    for bits in common:
        at = at[in_bitmap(bits, joined[at])]
        level[at] += 1
    level[joined >= HALF] = len(common) + 1
    return level


def _prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes + (-sizes * percent // 100) + SHARED


def _counted(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for batch in in_slices(batches, key="key"):
        joined, held, sizes, numbers = _joined_parts(batch)
        upto = (COUNTED * _prefix_sizes(sizes, percent)).astype(np.int64)
        kept = _first(held, upto, np.zeros(len(joined), np.int8))
        yield pd.DataFrame({"k": np.repeat(numbers, held)[kept], "shingle": joined[kept].view(np.int64)})


def _prefixes(
    batches: Iterator[pd.DataFrame], percent: int, common: list[np.ndarray], wanted: np.ndarray | None
) -> Iterator[pd.DataFrame]:
    """Prefix shingles of each set; with ``wanted`` only those in that bitmap.

    The order of all shingles is: those of the lower half by the steps of COMMON, rare ones first, then the upper half.
    """
    for batch in in_slices(batches, key="key"):
        joined, held, sizes, numbers = _joined_parts(batch)
        kept = _first(held, _prefix_sizes(sizes, percent), _levels(joined, common))
        ids, found = np.repeat(numbers, held)[kept], joined[kept]
        if wanted is not None:
            hit = in_bitmap(wanted, found)
            ids, found = ids[hit], found[hit]
        yield pd.DataFrame({"k": ids, "shingle": found.view(np.int64)})


def _compare(frame: pd.DataFrame, n: int, percent: int, both: bool) -> pd.DataFrame:
    """Links within one block, or between its two sides, as pairs of classes."""
    frame = frame.sort_values(["side", "rep"]).drop_duplicates("rep" if both else ["side", "rep"])
    sets = [shingles(t, n) for t in frame["text"]]
    known = [None if pd.isna(c) else int(c) for c in frame["component"]]
    reps = frame["rep"].tolist()
    found = join_sets(sets, frame["side"].tolist(), known, percent, both)
    if len(frame) >= MANY_TEXTS:
        del frame, sets
        hand_back()
    return pd.DataFrame([(reps[i], reps[j]) for i, j in found], columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of word n-grams. Null and empty texts
    have no shingle and link with nothing (component_id is their own doc_id). Rows without a doc_id link with nothing either
    and have no component_id. Rows that share a doc_id are compared each by its own text.
    An empty table gives no rows.
    """
    return _grouped(docs, n, percent).drop("digest", "grp")


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of near_duplicates with ``digest`` (of the text) and ``grp``, a number for all texts linked; null where nothing can link.

    Texts are split and hashed once; what prefixes come from is staged, and the steps that look for regions read that. Only
    texts in regions are read again. A class is named by the place of one of its rows.
    """
    spark = docs.sparkSession
    texts = documents(docs).withColumn("digest", F.md5("text"))
    sets = texts.mapInPandas(lambda x: _measure(x, n, percent), "doc_id long, digest string, size int, key string, part binary")
    rows = stage(sets.withColumn("place", F.monotonically_increasing_id()), "shingle-parts")
    named = rows.where("key is not null and doc_id is not null")
    classes = named.groupBy("key").agg(
        F.min(F.struct("doc_id", F.col("place").alias("rep"), "digest")).alias("first"), F.first("size").alias("size")
    )
    classes = stage(classes.select("key", "first.*", "size"), "class-numbers")
    held = named.select("key", "size", "part")
    sent = []

    def send(bits: np.ndarray):
        sent.append(spark.sparkContext.broadcast(bits))
        return sent[-1]

    pair = "k long, shingle long"

    def several(frame: DataFrame) -> DataFrame:
        return frame.groupBy("shingle").agg(
            F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("c")
        ).where("a < b")

    shared = stage(several(held.mapInPandas(lambda x: _counted(x, percent), pair)).select("shingle", "c"), "shared-shingles")
    drop_read_shuffles(spark)
    top = shared.agg(F.max("c")).first()[0] or 0
    common = [send(bitmap(shared.where(F.col("c") > most), "shingle")) for most in COMMON if most < top]
    ordered = lambda x, wanted: _prefixes(x, percent, [bits.value for bits in common], wanted)
    met = stage(several(held.mapInPandas(lambda x: ordered(x, None), pair)), "met-shingles")
    drop_read_shuffles(spark)
    wanted = send(bitmap(met.where("c > 2"), "shingle"))
    again = held.mapInPandas(lambda x: ordered(x, wanted.value), pair)
    members = stage(again.join(met.where("c > 2").select("shingle", "c"), "shingle"), "prefix-members")
    drop_read_shuffles(spark)
    number = F.conv(F.substring("key", 1, 15), 16, 10).cast("long")
    numbered = classes.select(number.alias("id"), "rep", "size")
    pairs = stage(_tied_pairs(met, members, numbered, percent), "tied-pairs")
    many = members.where(F.col("c") > FEW).select("shingle", F.col("k").alias("id"))
    links = pairs.select("a", "b").union(_tied_by_many(many, ["shingle"], "id")).distinct()
    regions = stage(components(links), "regions").withColumnRenamed("component", "region")

    chosen = numbered.join(regions, "id")
    counted = chosen.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    chosen = stage(chosen.join(counted, "region"), "region-classes")
    large = chosen.where(F.col("n") > BLOCK)
    chosen = chosen.where(F.col("n") <= BLOCK).select("rep", F.xxhash64("region").alias("region"))
    if not large.isEmpty():
        chosen = chosen.union(_by_bands(large, pairs, many, percent))
    blocks = chosen.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n"))
    chosen = stage(chosen.join(blocks.where("n > 1"), "region").drop("n"), "region-members")
    chosen = chosen.join(classes.select("rep", "doc_id", "digest"), "rep")
    some = send(bitmap(chosen.select(F.xxhash64("doc_id", "digest").alias("id")), "id"))

    @F.pandas_udf("boolean")
    def may_be_chosen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(in_bitmap(some.value, hashes.to_numpy(np.int64)))
        hand_back()

    found = texts.where("doc_id is not null").where(may_be_chosen(F.xxhash64("doc_id", "digest")))
    found = found.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))  # repeated rows are one
    parts = found.join(chosen, ["doc_id", "digest"]).select(
        "rep", "region", "text", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block")
    )
    parts = stage(parts, "region-texts")
    for bits in sent:  # what used them is staged
        bits.destroy()
    drop_read_shuffles(spark)
    links = _links(parts, n, percent)
    linked_reps = components(links).withColumnRenamed("id", "rep").join(classes.select("rep", "doc_id"), "rep")
    least = linked_reps.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked_reps = linked_reps.join(least, "component").select("rep", "least", "component")
    named_classes = classes.select("key", F.col("doc_id").alias("first"), "rep").join(linked_reps, "rep", "left")
    result = rows.drop("part").join(named_classes, "key", "left")
    known = F.col("doc_id").isNotNull()
    return result.select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(known, F.coalesce("least", "first", "doc_id")).alias("component_id"),
        "digest", F.when(known, F.coalesce("component", "rep")).alias("grp"),
    )


def _tied_by_many(held_by: DataFrame, group: list[str], node: str) -> DataFrame:
    """Pairs (a, b) that connect all nodes of a group: its least one with each other one."""
    least = held_by.groupBy(*group).agg(F.min(node).alias("a"), F.max(node).alias("z")).where("a < z").drop("z")
    return held_by.join(least, group).select("a", F.col(node).alias("b")).where("a <> b").distinct()


def _tied_pairs(met: DataFrame, members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b) that share SHARED prefix shingles that few hold, or all that they need, and whose sizes may link.

    Where a pair that links has fewer of these, it also shares a prefix shingle that many hold.
    """
    lists = members.where(F.col("c") <= FEW).groupBy("shingle").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    each = lists.select(F.posexplode("ks").alias("i", "a"), "ks")
    several = each.select("a", F.explode(F.slice("ks", F.col("i") + 2, FEW)).alias("b"))
    shared = met.where("c = 2").select("a", "b").union(several).groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = lambda c: classes.select(F.col("id").alias(c), F.col("size").cast("long").alias(f"size_{c}"))
    sized = shared.join(sizes("a"), "a").join(sizes("b"), "b")
    least = F.ceil(F.greatest("size_a", "size_b") * percent / 100)
    return sized.where((F.col("shared") >= F.least(F.lit(SHARED), least)) & (F.least("size_a", "size_b") >= least)).select("a", "b").distinct()


def _by_bands(classes: DataFrame, pairs: DataFrame, many: DataFrame, percent: int) -> DataFrame:
    """Regions (rep, region) that hold every link of the classes; each class is in two of them at most.

    Linked sets lie in one band of sizes or in two that adjoin. ``many`` has what is tied by a shingle (shingle, id).
    """
    band = F.floor(F.log("size") / (np.log(100 / percent) * 1.0001)) if percent < 100 else F.col("size").cast("long")
    banded = classes.select("id", band.alias("band"))
    of = lambda c: banded.select(F.col("id").alias(c), F.col("band").alias(f"band_{c}"))
    common = F.least("band_a", "band_b")  # both are in the pair of bands that begins here
    tied = pairs.join(of("a"), "a").join(of("b"), "b").select(F.xxhash64("a", common).alias("a"), F.xxhash64("b", common).alias("b"))
    own = classes.select("id", "rep", F.explode(F.array(band, band - 1)).alias("band")).withColumn("node", F.xxhash64("id", "band"))
    spread = many.join(own, "id").select("shingle", "band", "node")
    found = components(tied.union(_tied_by_many(spread, ["shingle", "band"], "node")).distinct())
    return own.join(found.select(F.col("id").alias("node"), F.col("component").alias("region")), "node").select("rep", "region")


def _links(parts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that connect all that is connected, as pairs of classes (a, b)."""
    none = F.lit(None).cast("long").alias("component")
    large = parts.where("blocks > 1")
    pivots = large.groupBy("region", "blocks").agg(
        F.array_sort(F.collect_set(F.when(F.col("block") == 0, F.col("rep")))).alias("some")
    ).select("region", F.explode(F.slice("some", 1, PIVOTS)).alias("rep"), "blocks")
    pivot_texts = parts.join(pivots.select("region", "rep"), ["region", "rep"]).select(
        "region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "rep", "text"
    )
    own = parts.select("region", "block", F.lit(0).alias("side"), "rep", "text")
    schema = "a long, b long"
    first = stage(
        own.union(pivot_texts).select("region", "block", "side", "rep", none, "text")
        .groupBy("region", "block").applyInPandas(lambda frame: _compare(frame, n, percent, both=True), schema),
        "block-links",
    )
    if large.isEmpty():
        return first
    merged = components(first).withColumnRenamed("id", "rep")
    state = stage(
        large.join(merged, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "region-state"
    )
    counted = state.groupBy("region", "component").agg(F.count("*").alias("m"))
    largest = counted.groupBy("region").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    state = state.join(largest, "region")
    rest = state.where("component <> main")
    rows = rest.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).alias("strips"))
    left = rest.join(rows, "region").withColumn("strip", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("strips"))).select(
        "region", "strip", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(0).alias("side"), "rep", "component", "text",
    )
    right = state.join(rows, "region").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"), "block",
        F.lit(1).alias("side"), "rep", "component", "text",
    )
    second = left.union(right).groupBy("region", "strip", "block").applyInPandas(
        lambda frame: _compare(frame, n, percent, both=False), schema
    )
    return first.union(stage(second, "strip-links"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, of the smallest MD5 of the text among texts of that id.

    Exact repeats of that row go as well, whatever their other columns say. Texts without a word and rows without a doc_id are in no
    group and stay. Columns may have any names; an empty table stays empty.
    """
    digest, mark = free_names(docs, "digest", "mark")
    groups = stage(_grouped(docs, n, percent).where("grp is not null").select("grp", "doc_id", "digest"), "near-duplicates")
    texts = groups.groupBy("grp", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = groups.groupBy("grp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    fate = F.when(F.struct("doc_id", "digest") != F.col("first"), "gone").when(F.col("n") > 1, "repeated")
    marks = texts.join(first, "grp").select("doc_id", F.col("digest").alias(digest), fate.alias(mark)).where(F.col(mark).isNotNull())
    marks = stage(marks, "near-duplicates")
    kept = docs.withColumn(digest, F.md5("text")).join(marks, ["doc_id", digest], "left").where(
        F.col(mark).isNull() | (F.col(mark) == "repeated")
    )
    if marks.where(F.col(mark) == "repeated").isEmpty():
        return kept.select(docs.columns)
    one = kept.where(F.col(mark).isNotNull()).groupBy("doc_id", digest).agg(F.first(F.struct(*docs.columns)).alias(mark))
    return kept.where(F.col(mark).isNull()).select(docs.columns).union(one.select(f"{mark}.*"))
