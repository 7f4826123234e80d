"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words with their counts. For a word of weight w and a draw with r, c
from Gamma(2, 1) and b even on [0, 1), all fixed by the word and the draw, let t = floor(ln w / r + b); the sample is
the word (with its t) for which ln c - r (t - b + 1) is least. Two sets agree in a draw with a probability
equal to their generalised Jaccard similarity, sum of least over sum of greatest weights.

All DRAWS samples are drawn over the whole set of a text, so the share of equal ones estimates that similarity whatever
words carry the weight. A text and its edited version are drawn together: a word's r, c and b are worked out once for both, and so is the sample
where it weighs the same in both.

Few words can win a draw. The least key of a set of W words is ln of an exponential variable over W, so it hardly ever exceeds
ln(REACH / W). As -ln x >= 1 - x and r (t - b + 1) <= ln w + r, where e^-r is a product of two even numbers, a few
multiplications show that a word's key lies beyond that; only the others are worked out. A draw whose least key
does lie beyond is not decided this way: texts with such draws are drawn again over all their words.

All of it is DataFrame functions. A sample is one whole number: the rounded key above 24 bits of the word's hash and t,
so a minimum finds it. Documents are dealt by blocks of ids; text, words and signature stay in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, UPPER, documents
from tidewatch.sources.staging import stage

DRAWS = 64
REACH = 20.0  # a draw is undecided with probability e^-REACH; only speed depends on it
STEPS = float(1 << 18)  # of a unit of a key: keys lie within about +-700, so they stay apart and below 2^28
ID_BLOCK = 256  # ids of a block; neighbours beyond a block's end are fetched by a join
SPACES = r"[\x20\x09-\x0D]+"


def _even(x: Column, k: int) -> Column:
    """21 bits of a hash as a number between 0 and 1."""
    return (F.shiftrightunsigned(x, k).bitwiseAND(0x1FFFFF) + 0.5) / float(1 << 21)


def _least_share(word: Column, draw: Column) -> Column:
    """No more than e^key / w of the word in this draw, without logs."""
    h = F.xxhash64(word, draw)
    return (1 - _even(h, 42) * _even(F.xxhash64(h), 0)) * (_even(h, 0) * _even(h, 21))


def _samples(word: Column, draw: Column, logs: list[Column]) -> list[Column]:
    """One whole number per weight, null where that is. ``word`` is the word's hash, ``logs`` are those of its weights."""
    h = F.xxhash64(word, draw)
    g = F.xxhash64(h)
    r = -F.log(_even(h, 0) * _even(h, 21))
    log_c = F.log(-F.log(_even(h, 42) * _even(g, 0)))
    b = _even(g, 21)
    out = []
    for log in logs:
        t = F.floor(log / r + b)
        key = log_c - r * (t - b + 1)
        mark = F.xxhash64(word, t).bitwiseAND(0xFFFFFF)
        out.append(F.shiftleft(F.floor(key * STEPS), 24) + mark)
    return out


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents dealt by block of ids."""
    nameless = -(1 << 62) - F.pmod(F.xxhash64("text"), F.lit(4096))  # rows without an id: behind all blocks of ids
    rows = documents(docs).withColumn("block", F.coalesce(F.floor(F.col("doc_id") / ID_BLOCK), nameless).cast("long"))
    return rows.repartition("block")


def _order() -> Window:
    return Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "text")


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """(block, next_block) by descending block, the last followed by the first.

    One narrow row per block, sorted by ranges; only the first block of each range meets the others' in one task.
    """
    order = blocks.select("block").distinct().repartitionByRange(F.desc("block")).sortWithinPartitions(F.desc("block"))
    dealt = stage(order.withColumn("at", F.monotonically_increasing_id()), "block-order")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    heads = dealt.groupBy("part").agg(F.max("block").alias("head"))
    ranges = Window.orderBy("part")
    after = F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges))
    after = heads.select("part", after.alias("after"))  # a row per range
    inside = F.lead("block").over(Window.partitionBy("part").orderBy("at"))
    return dealt.withColumn("inside", inside).join(F.broadcast(after), "part").select(
        "block", F.coalesce("inside", "after").alias("next_block")
    )


def _edited(docs: DataFrame) -> DataFrame:
    """(block, place, doc_id, n_chars, text, edited): each text with its second half replaced by the next one's begin."""
    rows = _blocks(docs)
    placed = rows.withColumns({"place": F.row_number().over(_order()), "after": F.lead("text").over(_order())})
    heads = rows.withColumn("place", F.row_number().over(_order())).where("place = 1").select(
        F.col("block").alias("next_block"), F.col("text").alias("head")
    )
    heads = _next_blocks(rows).join(heads, "next_block").select("block", "head")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    after = F.coalesce("after", "head")
    return placed.join(heads, "block").select(
        "block", "place", "doc_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.left(F.col("text"), n - half), F.left(after, half)).alias("edited"),
    )


def _signatures(rows: DataFrame, reach: float | None) -> DataFrame:
    """(block, place, signature, edited_signature, undecided): arrays of DRAWS whole numbers, null where a text has no words.

    With a ``reach`` words that can't win are passed over, and ``undecided`` says whether a draw needs them; without, all are drawn.
    """
    split = lambda c: F.split(F.translate(c, UPPER, LOWER), SPACES)
    lists = rows.select("block", "place", split("text").alias("w0"), split("edited").alias("w1"))
    # the smaller number of words, perhaps with an empty one at either end: any number near it will do
    lists = lists.select("block", "place", F.least(F.size("w0"), F.size("w1")).alias("size"), "w0", "w1")
    key = ["block", "place", "size"]
    both = F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(f"w{w}").alias("ws")) for w in (0, 1)])).alias("x")
    words = lists.select(*key, both).select(*key, "x.which", F.explode("x.ws").alias("word")).where("word <> ''")
    words = words.select(*key, "which", F.xxhash64("word").alias("word"))  # all that a draw uses of a word
    weighted = words.groupBy(*key, "word").agg(*[F.count_if(F.col("which") == w).cast("double").alias(f"n{w}") for w in (0, 1)])
    logs = [F.log(F.nullif(f"n{w}", F.lit(0.0))).alias(f"l{w}") for w in (0, 1)]
    weighted = weighted.select(*key, "word", (F.greatest("n0", "n1") / F.col("size")).alias("share"), *logs)
    # a row per draw: code for all draws in one row is too long for the JVM to compile
    dealt = weighted.select("*", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw"))
    if reach is not None:
        dealt = dealt.where(_least_share(F.col("word"), F.col("draw")) <= F.col("share") * reach)
    first, second = _samples(F.col("word"), F.col("draw"), [F.col("l0"), F.col("l1")])
    # most words weigh the same in both texts
    drawn = dealt.withColumn("k0", first).withColumn("k1", F.when(F.col("l0") == F.col("l1"), F.col("k0")).otherwise(second))
    drawn = drawn.select(*key, "draw", "k0", "k1")
    least = drawn.groupBy(*key, "draw").agg(*[F.min(f"k{w}").alias(f"k{w}") for w in (0, 1)])
    short = lambda k: F.when(F.col(k).isNotNull(), F.xxhash64(k).bitwiseAND(0xFFFFFF).cast("int"))
    lists = least.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("draw", short("k0").alias("k0"), short("k1").alias("k1")))).alias("m"),
        *[F.max(f"k{w}").alias(f"last{w}") for w in (0, 1)], *[F.count(f"k{w}").alias(f"n{w}") for w in (0, 1)],
    )
    if reach is None:
        undecided = F.lit(False)
    else:
        # two steps of slack for rounding
        edge = F.floor(F.log(reach / F.col("size")) * STEPS) - 2
        late = lambda w: (F.col(f"n{w}") < DRAWS) | (F.shiftright(f"last{w}", 24) >= edge)
        undecided = F.coalesce(late(0) | late(1), F.lit(True))
    return lists.select(*key[:2], F.col("m.k0").alias("signature"), F.col("m.k1").alias("edited_signature"), undecided.alias("undecided"))


def likeness(a: Column, b: Column) -> Column:
    """The share of places with equal samples among those not empty in both; 1 if all are."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    used = F.size(F.filter(pairs, lambda p: p.x.isNotNull() | p.y.isNotNull()))
    equal = F.size(F.filter(pairs, lambda p: p.x == p.y))
    return F.when(used == 0, 1.0).otherwise(equal / used)


def _signed(rows: DataFrame, reach: float | None) -> DataFrame:
    """(block, place, doc_id, n_chars, edited_sha256, signature, edited_signature), staged."""
    facts = rows.select("block", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    names = ["signature", "edited_signature"]
    none = F.array_repeat(F.lit(None).cast("int"), DRAWS)  # of a document without words
    signed = stage(facts.join(_signatures(rows, reach), ["block", "place"], "left"), "signatures")
    undecided = signed.where("undecided").select("block", "place")
    if not undecided.isEmpty():
        again = _signatures(rows.join(undecided, ["block", "place"], "left_semi"), None)
        again = again.select("block", "place", *[F.col(c).alias(f"{c}_again") for c in names])
        signed = signed.join(again, ["block", "place"], "left").withColumns({c: F.coalesce(f"{c}_again", c) for c in names})
        signed = stage(signed.drop(*[f"{c}_again" for c in names]), "signatures")
    return signed.drop("undecided").withColumns({c: F.coalesce(c, none) for c in names})


def fingerprints(docs: DataFrame, reach: float | None = REACH) -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by descending doc_id (after the last: the first). Null texts are empty; rows without a doc_id come last, and
    those with the same doc_id are ordered by their text. A single row is its own next. An empty table gives no rows.
    ``reach`` changes nothing but the time; None works out every word in every draw.
    """
    signed = _signed(_edited(docs), reach)
    follows = Window.partitionBy("block").orderBy("place")
    heads = _next_blocks(signed).join(
        signed.where("place = 1").select(F.col("block").alias("next_block"), F.col("signature").alias("head")), "next_block"
    ).select("block", "head")
    near = signed.withColumn("after", F.lead("signature").over(follows)).join(heads, "block")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(F.lpad(F.hex(x), 6, "0"), F.lit("-"))), "")
    return near.select(
        "doc_id", "n_chars", "edited_sha256", text("signature").alias("fingerprint"),
        text("edited_signature").alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.coalesce("after", "head")).alias("near_next"),
    )
