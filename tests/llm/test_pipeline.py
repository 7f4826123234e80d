import numpy as np
import pandas as pd

import corpus_pipeline
from tidewatch.llm import line_dedup, quality
from tidewatch.llm.common import held_out, in_slices, table
from tidewatch.sources.staging import stage
from llm_texts import edges  # noqa: F401
from test_duplicates import jaccard_groups, without_repeats

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work_on_what_is_kept(spark):
    docs = table(spark, SF, "documents")
    names, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, SF), "stage")
        kept[name] = (before.toPandas(), docs.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    labels = table(spark, SF, "labels").toPandas()
    before, after = kept["quality classifier"]
    good = before.merge(labels, on="doc_id").query("quality == 1")["doc_id"]
    bad = before.merge(labels, on="doc_id").query("quality == 0")["doc_id"]
    assert good.isin(after["doc_id"]).mean() > 0.98 and bad.isin(after["doc_id"]).mean() < 0.05
    before, after = kept["line dedup"]
    want = {d: t for d, t in without_repeats(list(zip(before["doc_id"], before["text"])), 50)}
    left = dict(zip(after["doc_id"], after["text"]))
    assert all(left.get(d, "").strip() == t.strip() for d, t in want.items())
    assert (after["n_chars"] == after["text"].str.len()).all()
    before, after = kept["n-gram Jaccard join"]
    groups = jaccard_groups(list(zip(before["doc_id"], before["text"])), 5, 80)
    assert set(after["doc_id"]) == {d for d, (_, c) in groups.items() if c == d}
    before, after = kept["packing"]
    assert set(after["doc_id"]) == set(before["doc_id"])
    assert (after.groupby("doc_id")["length"].sum() == after.groupby("doc_id")["doc_tokens"].first()).all()


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows_and_names(spark, edges):
    docs = edges.withColumns({"lang": corpus_pipeline.F.lit("en"), "source": corpus_pipeline.F.lit(None).cast("string"),
                              "n_chars": corpus_pipeline.F.char_length("text").cast("long")})
    docs = docs.withColumns({c: corpus_pipeline.F.lit("y") for c in ("lines_removed", "nothing_left", "mark", "digest", "first", "spans")})
    kept = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = stage(step(spark, kept, SF), "stage")
        assert kept.columns == docs.columns and kept.count() > 0
        assert set(kept.select("lines_removed", "mark", "spans").distinct().collect()) == {("y", "y", "y")}
    packed = corpus_pipeline.pack(spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    nothing = docs.where("1 = 0")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, nothing, SF).count() == 0, name


def test_near_copies_leave_one_row(spark):
    docs = table(spark, SF, "documents").limit(1)
    twice = stage(docs.union(docs), "stage")
    assert corpus_pipeline.dedup_documents(spark, twice, SF).count() == 1


def test_classifier_keeps_what_scores_enough(spark):
    docs = table(spark, SF, "documents")
    model = corpus_pipeline.quality.fit(docs, table(spark, SF, "labels"), corpus_pipeline.F.lit(True))
    scored = docs.withColumn("s", corpus_pipeline.quality.score(model)).where(f"s >= {corpus_pipeline.quality.THRESHOLD}")
    kept = corpus_pipeline.quality.accepted(docs, model, step=7)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scored.collect())
    assert corpus_pipeline.quality.accepted(docs, None).count() == 0


def test_missing_labels_reject_nothing(spark, edges):
    model = corpus_pipeline.quality.fit(edges, table(spark, SF, "labels").where("1 = 0"), corpus_pipeline.F.lit(True))
    assert model is None


def python_nodes_in_a_task(df):
    """The most nodes of a plan that run Python one above the other without a shuffle between, so at once in one task."""
    most, above = 0, []  # (depth, nodes so far) of each ancestor
    for row in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = next((k for k, c in enumerate(row) if c.isalpha()), None)
        if depth is None:
            continue
        while above and above[-1][0] >= depth:
            above.pop()
        count = 0 if "Exchange" in row[depth:].split(" ")[0] else (above[-1][1] if above else 0)
        count += any(x in row[depth:].split(" ")[0] for x in ("EvalPython", "InPandas", "InArrow"))
        above.append((depth, count))
        most = max(most, count)
    return most


def test_no_task_has_several_python_workers(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert python_nodes_in_a_task(corpus_pipeline.dedup_lines(spark, docs, SF)) == 1
    assert python_nodes_in_a_task(line_dedup.mark_repeats(docs)) == 1
    taught = []
    moments = quality._moments
    try:
        quality._moments = lambda frame: taught.append(quality._sums(frame)) or moments(frame)
        quality.fit(docs, labels, ~held_out("doc_id", 4, 2))
    finally:
        quality._moments = moments
    assert python_nodes_in_a_task(taught[0]) == 1


def test_moments_are_those_of_the_rows(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, len(quality.STATISTICS))), rng.integers(0, 2, 50)
    frame = spark.createDataFrame([(int(q), v.tolist()) for q, v in zip(y, x)], "quality long, x array<double>").repartition(3)
    for label, got in quality._moments(frame).items():
        part = np.column_stack([np.ones((y == label).sum()), x[y == label]])
        assert np.allclose(got, part.T @ part, rtol=1e-12, atol=1e-12)


def test_slices_hold_all_rows_in_order():
    batches = [pd.DataFrame({"k": range(n), "v": [w] * n}) for w, n in enumerate((2500, 0, 7))]
    parts = list(in_slices(iter(batches), rows=1000))
    assert [len(p) for p in parts] == [1000, 1000, 500, 7]
    assert pd.concat(parts).equals(pd.concat([batches[0], batches[2]]))
    again = pd.DataFrame({"k": [1, 1, 2, 1], "v": [5, 6, 7, 8]})
    assert pd.concat(in_slices(iter([again]), key="k"))["v"].tolist() == [5, 7]
