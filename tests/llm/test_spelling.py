import random
import re
import zlib
from collections import Counter

import pytest

from compare import connect, differences
from llm_texts import edges, none, prose  # noqa: F401
from tidewatch.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return out


def expected(counts, min_length=5, min_count=3):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    out, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form[w], None, n, len(close), words[best] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def answers(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def family(seed, size, letters="abcé", base="stein"):
    """Words that lie close together, with repeated letters and shared ends."""
    rng, out = random.Random(seed), set()
    while len(out) < size:
        w = list(base + rng.choice(["", base[:3], "aaa", "weg"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(letters)
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("limit", [spelling.BLOCK, 8, 2])
def test_near_words_equal_brute_force(spark, limit):
    rng = random.Random(3)
    words = {w: rng.choice([3, 5, 9, 9, 40]) for s, b in ((1, "stein"), (2, "aaaaa"), (3, "ababab")) for w in family(s, 120, base=b)}
    words = {w: n for w, n in words.items() if len(w) >= 4}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), limit).collect()
    want = {}
    for w in words:
        close = [v for v in words if near(w, v)]
        if close:
            best = min(close, key=lambda v: (-words[v], v))
            want[w] = (len(close), best, words[best])
    assert {r.word: (r.n_near, r.best, r.best_n) for r in got} == want
    assert max(v[0] for v in want.values()) > 5


def test_block_recurrences_alone():
    words = ["abcde", "abcdf", "abxcde", "abcdee"]
    found = {words[k]: n for k, n, _ in spelling.near_in_block(5, 0, 0, False, words)}
    assert found == {"abcde": 3, "abcdf": 1, "abxcde": 1, "abcdee": 1}


def test_variants_equal_brute_force(spark):
    rng, rows = random.Random(8), []
    pool = family(4, 60) + ["Straße", "Ångström", "ångström", "Æther", "x×y÷zzzzz", "ab"]
    for doc in range(400):
        rows.append((doc, " ".join(rng.choice(pool) + rng.choice(["", ".", "1", "-", "日"]) for _ in range(40))))
    rows += [(None, "Steine Steine"), (5, None), (6, ""), (7, "steine " * 3000)]
    rows.append((8, "kettenhaus " * 400 + "kettenhause " * 90 + "kettenhausen " * 20 + "kettenhausens " * 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(counted(rows))
    assert answers(spelling.variants(docs, limit=16)) == want
    assert any(form and forms_of(want, w) > 1 for w, (form, *_) in want.items())


def forms_of(want, word):
    steps = 0
    while want[word][0]:
        word, steps = want[word][0], steps + 1
    return steps


def test_query_equals_brute_force_and_sql(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_spelling(spark, SF)
    assert answers(got) == expected(counted(rows))
    assert differences(got.toPandas(), connect(SF).execute(spelling.ORACLE_SQL).df()) is None


def test_spelling_edges(spark, edges, none):
    got = spelling.variants(edges.withColumnRenamed("x", "first"), min_count=1)
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert answers(got) == expected(counted(rows), min_count=1)
    assert spelling.variants(none).count() == 0
    long = "ab" * 20_000
    docs = spark.createDataFrame([(1, f"{long} {long}c {long}") for _ in range(3)], "doc_id long, text string")
    assert answers(spelling.variants(docs)) == expected(counted([(1, f"{long} {long}c {long}")] * 3))
