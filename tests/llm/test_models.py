import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from llm_texts import edge_rows, edges, none  # noqa: F401
from tidewatch.llm import class_ngrams, quality, url_filter
from tidewatch.llm.common import held_out, table, words
from tidewatch.llm.queries import URL_RULES, oracle_sql, queries

SF = "/root/testdata/sf0.01"


# --- class n-grams ------------------------------------------------------------------------------

def base_scores(rows, apart):
    c = Counter()
    for doc, text in rows:
        if not apart(doc):
            c.update([*words(text), b""])
    n, v = c.total(), len(c)
    score = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b""])
    return n, [(doc, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b""]), score(t)) for doc, t in rows]


def test_counts_and_base_scores_are_exact(edges, none):
    apart = (F.col("doc_id") == 5) | F.col("doc_id").isNull()
    got = class_ngrams.score_documents(edges, apart).collect()
    total, want = base_scores(edge_rows(), lambda d: d in (5, None))
    assert {r.train_tokens for r in got} == {total}
    key = lambda r: (str(r[0]), *r[1:3], round(r[3], 6))
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.n_tokens, r.n_known, r.base_score)) for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert class_ngrams.score_documents(none, F.lit(False)).count() == 0
    untaught = class_ngrams.score_documents(edges, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in untaught)


def test_blocks_do_not_change_counts(edges, monkeypatch):
    monkeypatch.setattr(class_ngrams, "BLOCK_BYTES", 1000)
    got = class_ngrams.score_documents(edges, F.lit(False)).collect()
    total, want = base_scores(edge_rows(), lambda d: False)
    assert {r.train_tokens for r in got} == {total}
    assert sorted(round(w[3], 6) for w in want) == sorted(round(r.base_score, 6) for r in got)


def plain_scores(rows, apart):
    """The model in plain Python: heads by exchange, other words by their neighbours, then class bigrams."""
    n, taught = class_ngrams.CLASSES, [words(t) for d, t in rows if not apart(d)]
    count = Counter(w for t in taught for w in t)
    total = count.total() + len(taught)
    heads = sorted((w for w in count if count[w] * class_ngrams.HEAD_SHARE >= total), key=lambda w: (-count[w], w))
    place = {w: k + 1 for k, w in enumerate(heads)}
    number = lambda t: [0, *[place.get(w, len(heads) + 1) for w in t], 0]
    pairs = np.zeros((len(heads) + 2,) * 2)
    for t in taught:
        q = number(t)
        for a, b in zip(q, q[1:]):
            pairs[a, b] += 1
    own = class_ngrams.exchange(pairs)
    weights = class_ngrams.agreement(own, pairs)
    agree = {}
    for t in taught:
        q = own[number(t)]
        for k, w in enumerate(t):
            if w not in place:
                agree[w] = agree.get(w, 0) + weights[q[k]] + weights[n + q[k + 2]]
    cls = {w: int(own[k]) for w, k in place.items()} | {w: 1 + int(np.argmax(a[1:])) for w, a in agree.items()}
    stats, table = np.zeros((3, n + 1)), np.zeros((n + 1, n + 1))
    stats[:, 0] = len(taught), len(taught) == 1, 1
    for w, c in count.items():
        stats[:, cls[w]] += c, c == 1, 1
    for t in taught:
        q = [0, *[cls[w] for w in t], 0]
        for a, b in zip(q, q[1:]):
            table[a, b] += 1
    move, sizes = class_ngrams.log_model(stats, table)
    out = []
    for _, text in rows:
        score, before = 0.0, 0
        for w in [*words(text), None]:
            c = 0 if w is None else cls.get(w, n)
            seen = len(taught) if w is None else count[w] or 1
            score, before = score + move[before, c] - sizes[c] + math.log10(seen), c
        out.append(score)
    return out


def test_scores_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(class_ngrams, "HEAD_SHARE", 40)
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    rows += [(1000, None), (1001, "never seen before"), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in class_ngrams.score_documents(docs, F.col("doc_id") % 5 == 1).collect()}
    want = plain_scores(rows, lambda d: d % 5 == 1)
    assert [got[d] for d, _ in rows] == pytest.approx(want, rel=1e-9)


def test_scores_depend_on_no_layout(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    runs = []
    for parts, size in ((1, 12_000_000), (7, 12_000_000), (3, 20_000)):
        monkeypatch.setattr(class_ngrams, "BLOCK_BYTES", size)
        got = class_ngrams.score_documents(docs.repartition(parts), held_out("doc_id", 5, 1)).toPandas()
        runs.append(got.sort_values("doc_id").reset_index(drop=True))
    assert runs[0].equals(runs[1]) and runs[0].equals(runs[2])


def test_classes_beat_single_words_on_texts_kept_out(spark):
    got = class_ngrams.score_documents(table(spark, SF, "documents"), held_out("doc_id", 5, 1)).toPandas()
    apart = got[got["held_out"]]
    assert apart["score"].sum() > 0.9 * apart["base_score"].sum() and (apart["score"] > apart["base_score"]).mean() > 0.9


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    n, size = class_ngrams.CLASSES, class_ngrams.CLASSES + 1
    stats = np.zeros((3, size))
    stats[0, :n], stats[1, :n] = rng.integers(10, 99, n), rng.integers(0, 9, n)
    log_move, log_sizes = class_ngrams.log_model(stats, rng.integers(0, 5, (size, size)).astype(float))
    known = 10**log_move[:, :n] * (stats[0, :n] / 10 ** log_sizes[:n])
    assert np.allclose(known.sum(1) + 10 ** log_move[:, n], 1.0)


def test_exchange_finds_alternating_classes():
    # the end, then heads 1-8: odd ones are followed by even ones and the other way round
    pairs = np.zeros((10, 10))
    for a in range(1, 9):
        for b in range(1, 9):
            pairs[a, b] = 50 if (a + b) % 2 else 0
    own = class_ngrams.exchange(pairs, classes=4)
    assert len(set(own[[1, 3, 5, 7]])) == 1 and len(set(own[[2, 4, 6, 8]])) == 1 and own[1] != own[2]
    assert own[0] == 0 and own[9] == 3


# --- quality ------------------------------------------------------------------------------------

def test_quality_on_rows_kept_out(spark):
    got = queries()["op7_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    apart = got[got["held_out"]]
    assert (apart["predicted"] == apart["quality"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_quality_edges(spark, edges, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 0), (9, 0, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (8, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(edges, labels, F.lit(True))
    scores = [r[0] for r in edges.select(quality.score(model)).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    assert quality.fit(edges, labels.where("quality = 1"), F.lit(True)) is None
    assert quality.fit(none, labels, F.lit(True)) is None
    assert {r[0] for r in edges.select(quality.score(None)).collect()} == {0.5}
    assert none.select(quality.score(model)).count() == 0


def test_discriminant_is_the_posterior_of_two_normals(monkeypatch):
    monkeypatch.setattr(quality, "SHARPNESS", 1.0)
    monkeypatch.setattr(quality, "LIMIT", 1e9)
    monkeypatch.setattr(quality, "TOWARDS_POOLED", 0.0)
    monkeypatch.setattr(quality, "TOWARDS_IDENTITY", 0.0)
    rng, d = np.random.default_rng(1), 3
    x = [rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) + k for k in (0, 1)]
    moments = {c: (lambda z: z.T @ z)(np.column_stack([np.ones(len(x[c])), x[c]])) for c in (0, 1)}
    probe = np.concatenate(x)[::37]
    density = []
    for part in x:
        mean, cov = part.mean(0), np.cov(part.T, bias=True)
        gap = probe - mean
        density.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(quality.discriminant(moments).scores(probe), 1 / (1 + np.exp(density[0] - density[1])))


# --- urls ---------------------------------------------------------------------------------------

def test_urls_equal_sql(spark):
    for sf in ("/root/testdata/sf0.001", SF):
        got = queries()["op1_url_filter"](spark, sf).toPandas()
        assert differences(got, connect(sf).execute(oracle_sql()["op1_url_filter"]).df()) is None


URLS = [
    ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/"), ("http://example.org/es", "example.org", "/es", "org/"),
    ("http://x.org", "x.org", "", None), ("http://notorg/a", "notorg", "/a", None), ("ftp://b.com/fr/#t", "b.com", "/fr/", "com/fr/"),
    ("http://example.org/en/1://z", "example.org", "/en/1://z", "example.org/en/1"), (None, "", "", None), ("no scheme", "", "", None),
    ("", "", "", None), ("http://c.com/de/?q", "c.com", "/de/", "com/de/"), ("http://", "", "", None), ("http://ü.net/ß?", "ü.net", "/ß", None),
    ("http://com/fr/x", "com", "/fr/x", "com/fr/"), ("http://r.net/" + "y" * 20_000, "r.net", "/" + "y" * 20_000, None),
]


def test_rules_hosts_and_paths(spark):
    rows = [(i, u, "a", "b") for i, (u, *_) in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, s string, w string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule) in enumerate(URLS * 2):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (dict((r, v) for v, r in URL_RULES)[rule] if rule else got[i].verdict)
        assert got[i].verdict in ("allow", "block") and (got[i].score is None) == (rule is not None)
        assert got[i].verdict == got[i % len(URLS)].verdict
    assert url_filter.filter_urls(df.where("1 = 0"), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_models_learn_from_judged_urls(spark):
    rows = [(k, f"http://h{k % 40}.org/good/{k}") for k in range(300)] + [(1000 + k, f"http://h{k % 40}.com/de/bad{k}") for k in range(300)]
    rows += [(5000, "http://z.net/good/777"), (5001, "http://z.net/de/bad777")]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert (got[5000], got[5001]) == ("allow", "block")


def test_there_is_a_query_for_each_operator():
    assert {k.split("_")[0] for k in queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())
