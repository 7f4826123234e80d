import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from llm_texts import edge_rows, edges, none, prose  # noqa: F401
from tidewatch.llm import line_dedup, shingle_join, vector_dedup, weighted_sampling
from tidewatch.llm.common import components, table, words

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(9, 8), (8, 7), (7, 9), (3, 3)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    sets = Sets({x for link in links for x in link})
    for a, b in links:
        sets.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: sets.find(i) for i in sets.parent if i != 3}


# --- n-gram Jaccard join ------------------------------------------------------------------------

def jaccard_groups(rows, n, percent):
    """By comparing all pairs that share a shingle."""
    grams, held = {}, defaultdict(list)
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
        grams[doc] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        for g in grams[doc]:
            held[g].append(doc)
    sets = Sets(grams)
    for a, b in {(a, b) for docs in held.values() for a in docs for b in docs if a < b}:
        shared = len(grams[a] & grams[b])
        if 100 * shared >= percent * len(grams[a] | grams[b]):
            sets.join(a, b)
    return {d: (len(g), sets.find(d)) for d, g in grams.items()}


def similar_texts(count=60):
    """Groups of copies with some words changed, and texts that share a passage only."""
    rng, rows, passage = random.Random(7), [], prose(99, 60)
    for k in range(count):
        base = prose(k % 9, 40 + 11 * (k % 9)).split(" ")
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = f"new{rng.randrange(3)}"
        rows.append((k, " ".join(base)))
    rows += [(1000 + k, prose(500 + k, 50) + "\n" + passage) for k in range(20)]
    return rows


@pytest.mark.parametrize("block", [shingle_join.BLOCK, 4])
def test_jaccard_groups_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rows = similar_texts()
    for n, percent in ((4, 85), (5, 80)):
        want = jaccard_groups(rows, n, percent)
        got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert len(set(c for _, c in want.values())) < len(want)


@pytest.mark.parametrize("shared, few", [(3, 4), (8, 2)])  # workers keep the prefixes of 8, so 8 at most
def test_ties_keep_all_links(spark, shared, few, monkeypatch):
    for name, value in (("BLOCK", 4), ("SHARED", shared), ("FEW", few), ("COMMON", (1, 3))):
        monkeypatch.setattr(shingle_join, name, value)
    rows = similar_texts() + [(2000 + k, " ".join(prose(40 + k // 2, 9).split(" ")[: 4 + k % 6])) for k in range(12)]
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(rows, 4, 85)


def test_passages_of_other_texts_chain_no_regions(spark, monkeypatch):
    """Each text is made of two passages that its neighbours hold, so every prefix meets another one; no texts are near copies."""
    seen = {}

    def staged(df, name, *args, real=shingle_join.stage, **named):
        return seen.__setitem__(name, out := real(df, name, *args, **named)) or out

    monkeypatch.setattr(shingle_join, "stage", staged)
    rows = [(k, prose(5000 + k, 6) + " " + prose(5001 + k, 6)) for k in range(60)]
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert seen["met-shingles"].count() >= 60 and seen["region-texts"].count() == 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(rows, 2, 80)


def test_chained_texts_do_not_meet_block_by_block(spark, monkeypatch):
    """Blocks of a region met each other with their texts, quadratic in a region that chance had chained."""
    names, real = [], shingle_join.stage
    monkeypatch.setattr(shingle_join, "stage", lambda df, name, *args, **named: names.append(name) or real(df, name, *args, **named))
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    rows = [(k, prose(7000 + k, 6) + " " + prose(7001 + k, 6)) for k in range(40)]
    kept = shingle_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert sorted(kept.collect()) == sorted(rows) and "region-texts" in names and "strip-links" not in names


def test_jaccard_edges(edges, none):
    got = shingle_join.near_duplicates(edges, 4, 85).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    want = jaccard_groups([(d, t) for d, t in edge_rows() if d is not None], 4, 85)
    assert {d: (r.n_shingles, r.component_id) for d, r in by.items()} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = shingle_join.drop_near_duplicates(edges, 4, 85)
    assert kept.columns == edges.columns
    # one row of a group stays, so of the two equal rows of id 10 as well
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        {d for d, _ in edge_rows() if d is not None and want[d][1] == d}
    )
    assert kept.where("doc_id is null").count() == 2
    clash = edges.withColumns({c: edges.x for c in ("digest", "mark", "grp", "digest_", "place", "first")})
    kept = shingle_join.drop_near_duplicates(clash, 4, 85)
    assert kept.columns == clash.columns and set(kept.select("digest", "grp", "mark").distinct().collect()) == {("x", "x", "x")}
    assert shingle_join.drop_near_duplicates(none).count() == 0
    assert shingle_join.near_duplicates(none).count() == 0


def test_texts_of_one_id_are_compared_each(spark):
    rows = []
    for k in range(0, 60, 10):  # id k + 5 has two texts; each has a near copy under another id
        a, b = prose(700 + k, 90), prose(800 + k, 120)
        rows += [(k + 5, a), (k + 5, b), (k + 8, b + " end"), (k + 3, a + " end"), (k + 9, prose(900 + k, 70)), (k + 5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs, 4, 85).collect())
    size = lambda t: len({tuple(w) for w in zip(*[words(t)[i:] for i in range(4)])})
    least = [5, 5, 5, 3, 9, 5]
    want = [(d, size(t), d // 10 * 10 + (3 if i % 6 == 0 else least[i % 6])) for i, (d, t) in enumerate(rows)]
    assert got == Counter(want)
    kept = Counter((r.doc_id, r.text) for r in shingle_join.drop_near_duplicates(docs, 4, 85).collect())
    assert kept == Counter(r for i, r in enumerate(rows) if i % 6 in (1, 3, 4, 5))


def test_tree_bounds_never_hide_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for k in range(120):
        base = np.random.default_rng(k % 12).integers(0, 2**63, 30 + 5 * (k % 12)).astype(np.uint64)
        base[rng.integers(0, len(base), k % 4)] = rng.integers(0, 2**63, k % 4).astype(np.uint64)
        sets.append(np.unique(base))
    found = Sets(range(len(sets)))
    for i, j in shingle_join.join_sets(sets, [0] * 120, [None] * 120, 80, both=True):
        assert shingle_join.linked(sets[i], sets[j], 80)
        found.join(i, j)
    want = Sets(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if shingle_join.linked(sets[i], sets[j], 80):
                want.join(i, j)
    assert [found.find(i) for i in range(120)] == [want.find(i) for i in range(120)]


# --- line dedup ---------------------------------------------------------------------------------

def without_repeats(rows, least):
    """Every run of lines with enough words, in order; all but the first of each goes."""
    parts = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out, texts, first = [], {}, {}
    for doc, text in order:
        text = text or ""
        if len(parts(text)) >= least and texts.setdefault(text, doc) != doc:
            out.append((doc, ""))
            continue
        lines = [(i, " ".join(parts(x)), len(parts(x))) for i, x in enumerate(text.split("\n")) if parts(x)]
        gone = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total < least:
                    continue
                at = first.setdefault(tuple(x[1] for x in lines[a : b + 1]), (doc, lines[a][0], lines[b][0]))
                if at[:2] != (doc, lines[a][0]):
                    start = max(lines[a][0], at[2] + 1) if at[0] == doc else lines[a][0]
                    gone |= set(range(start, lines[b][0] + 1))
                if total > 4 * least:
                    break
        out.append((doc, "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)))
    return out


def lined_texts():
    rng, pool = random.Random(11), [prose(k, 4 + k % 9, 99) for k in range(14)]
    return [(k, "\n".join(rng.choice(pool + ["", " "]) if rng.random() < 0.8 else prose(k * 50, 9, 99) for _ in range(14))) for k in range(40)]


@pytest.mark.parametrize("least", [12, 25, 50])
def test_line_runs_equal_brute_force(spark, least):
    rows = lined_texts() + [(100, lined_texts()[3][1])]
    got = line_dedup.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(without_repeats(rows, least))
    assert any(r.lines_removed for r in got)


def test_texts_that_lose_nothing_stay_where_they_are(spark, monkeypatch):
    docs = spark.createDataFrame([(k, prose(k * 50, 60, 99)) for k in range(8)] + [(9, prose(0, 60, 99))], "doc_id long, text string")
    marked = line_dedup.mark_repeats(docs)
    assert "may_change" in marked._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in marked.collect() if r.nothing_left) == [9] and marked.count() == 9


def test_shortest_runs():
    got = line_dedup.shortest_runs(np.array([60, 5, 30, 30]), 50).tolist()
    assert got == [[0, 1], [0, 2], [1, 3], [2, 2]] or [0, 2] in got and [2, 2] in got and [0, 1] in got


def test_line_dedup_edges(edges, none):
    got = line_dedup.mark_repeats(edges)
    assert got.columns == [*edges.columns, "lines_removed", "nothing_left"]
    rows = got.collect()
    assert len(rows) == len(edge_rows())
    one = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert one[1].lines_removed == 0 and one[6].nothing_left and one[7].text == "end"
    assert one[9].text == prose(3, 60) and one[2].text is None and one[3].text == "" and one[10].text == "one"
    assert [r.nothing_left for r in rows if r.doc_id is None and r.text is not None] == [True]
    kept = line_dedup.drop_repeated_lines(edges)
    assert kept.columns == edges.columns and kept.count() == len(edge_rows()) - 2
    names = ["lines_removed", "nothing_left", "doc", "hash", "whole", "spans", "new", "d", "h"]
    clash = edges.withColumns({c: edges.x for c in names})
    marked = line_dedup.mark_repeats(clash)
    assert marked.columns == [*clash.columns, "lines_removed_", "nothing_left_"] and marked.count() == len(edge_rows())
    kept = line_dedup.drop_repeated_lines(clash)
    assert kept.columns == clash.columns and set(kept.select(names).distinct().collect()) == {("x",) * len(names)}
    assert line_dedup.mark_repeats(none).count() == 0


# --- vectors ------------------------------------------------------------------------------------

def vectors(seed=3, n=150):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    rows = []
    for k in range(n):
        v = base[k // 3] + 0.06 * rng.normal(size=16) * (k % 3)
        rows.append((k, [float(x) for x in v], k % 2 if k % 7 else 0))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(5)]
    return rows


@pytest.mark.parametrize("sizes", [(4096, 2048), (20, 8)])
def test_vector_groups_equal_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PER_CELL", sizes[0])
    monkeypatch.setattr(vector_dedup, "BLOCK", sizes[1])
    rows = vectors()
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)  # the values that the table holds
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    sets = Sets([r[0] for r in rows])
    for i, j in zip(*np.nonzero(hit)):
        sets.join(rows[i][0], rows[j][0])
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    df = df.withColumn("embedding", df.embedding.cast("array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert hit.any()
    assert [got[r[0]][0] for r in rows] == hit.sum(1).tolist()
    assert [got[r[0]][1] for r in rows] == [sets.find(r[0]) for r in rows]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0),
        (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 0.0], None), (10, [], 0), (11, [1.0, 0.0, 0.0], 0),
        (12, [1e300, 1e299], 0), (13, [1.0, -0.0], 0), (None, [1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows)
    assert {k: v[0] for k, v in got.items()} == {1: 3, 2: 3, 12: 3, 13: 3, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 0, None: 0}
    assert [k for k, v in got.items() if v[2]] and got[2][1:] == (1, False) and got[None][1:] == (None, False)
    assert vector_dedup.near_duplicate_vectors(df.where("1 = 0")).count() == 0


def test_cells_of_spherical_kmeans():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, size=(50, 3)) for c in np.eye(3) * 3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home = (x @ vector_dedup.spherical_kmeans(x, 3).T).argmax(1)
    assert all(len(set(home[k : k + 50])) == 1 for k in (0, 50, 100)) and len(set(home)) == 3


# --- fingerprints -------------------------------------------------------------------------------

def generalised_jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    most = sum(max(a[w], b[w]) for w in a | b)
    return sum(min(a[w], b[w]) for w in a | b) / most if most else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    docs = table(spark, SF, "documents")
    got = weighted_sampling.fingerprints(docs).orderBy("doc_id", ascending=False).toPandas()
    texts = docs.toPandas().sort_values("doc_id", ascending=False)["text"].tolist()
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, following)]
    assert got["n_chars"].tolist() == [len(t) for t in texts]
    for near, others in (("near_edited", edited), ("near_next", following)):
        error = got[near] - [generalised_jaccard(t, u) for t, u in zip(texts, others)]
        assert abs(error.mean()) < 0.03 and np.sqrt((error**2).mean()) < 0.09
    assert got.assign(text=texts).groupby("text")["fingerprint"].nunique().max() == 1


def test_fingerprints_weigh_a_dominating_word(spark):
    shared = " ".join(f"w{k}" for k in range(15))
    texts = ["x " * 1000 + shared, "y " * 1000 + shared, "x " * 1000 + "z " * 500 + shared]
    docs = spark.createDataFrame([(3 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = weighted_sampling.fingerprints(docs).orderBy("doc_id", ascending=False).collect()
    for row, a, b in zip(got, texts, texts[1:] + texts[:1]):
        assert abs(row.near_next - generalised_jaccard(a, b)) < 0.25
    assert got[0].near_next < 0.1 and 0.4 < got[2].near_next < 0.9


@pytest.mark.parametrize("reach", [0.7, weighted_sampling.REACH])
def test_passing_over_words_changes_no_fingerprint(spark, edges, reach):
    """Also where most draws are undecided at first, as with the smaller reach."""
    docs = table(spark, SF, "documents").select("doc_id", "text").where("doc_id % 3 = 0").union(edges.select("doc_id", "text"))
    whole = weighted_sampling.fingerprints(docs, reach=None)
    fast = weighted_sampling.fingerprints(docs, reach=reach)
    assert whole.count() > 0 and whole.exceptAll(fast).isEmpty() and fast.exceptAll(whole).isEmpty()


def test_fingerprint_edges(spark, edges, none):
    import hashlib

    got = weighted_sampling.fingerprints(edges).toPandas()
    assert len(got) == len(edge_rows())
    same = got[got["doc_id"].isin([1, 6])]["fingerprint"]
    assert same.nunique() == 1
    empty = got[got["n_chars"] == 0]
    assert (empty["near_edited"] == 1).all() and set(empty["edited_sha256"]) == {hashlib.sha256(b"").hexdigest()}
    one = weighted_sampling.fingerprints(edges.where("doc_id = 5")).first()
    assert one.near_next == 1.0
    long = dict(edge_rows())[5]
    assert one.edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 2] + long[: len(long) // 2]).encode()).hexdigest()
    assert weighted_sampling.fingerprints(none).count() == 0
    assert isinstance(got, pd.DataFrame)
