"""Quality classifier: a regularised quadratic discriminant over statistics of the text alone.

Each class is a normal density over transformed document statistics. Its covariance is shrunk
towards the pooled one and towards a scaled identity, so that few labels or a constant statistic
still give a proper density. The score is the posterior of label 1; the Mahalanobis distances come from
the inverse Cholesky factors, which are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, hand_back

TOWARDS_POOLED, TOWARDS_IDENTITY = 0.2, 0.02
SHARPNESS = 0.25  # the statistics are dependent, so the log-density difference is damped before the posterior
THRESHOLD = 0.7  # a text is taken from this score on
LIMIT = 4.0  # statistics are held within so many pooled standard deviations: odd lengths alone are no evidence

STATISTICS = (
    "letters", "upper", "digits", "spaces", "stops", "signs", "signs_in_words", "word_bytes", "distinct_words",
    "distinct_lines", "shouted_words",
)

# A share is taken as if ordinary text of this size came with it: few words are little evidence.
PRIOR_BYTES, PRIOR_WORDS, PRIOR_LINES = 200, 30, 10
PRIOR = {"letters": 0.82, "upper": 0.03, "digits": 0.0, "spaces": 0.15, "stops": 0.03, "signs": 0.0,
         "word_bytes": 5.5, "distinct_words": 0.8}

_CLASS = np.full(256, 5)  # 0 lower letters and bytes of other letters, 1 upper, 2 digits, 3 white space, 4 stops, 5 signs
_CLASS[128:] = 0
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_OF_CLASS = np.eye(6)[_CLASS]


def statistics(texts: list[str]) -> np.ndarray:
    """One row per text (null: empty), each statistic roughly symmetric. Whole texts are read."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        lower, upper, digit, space, stop, sign = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _OF_CLASS
        n, words, lines = len(raw), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        size = n + PRIOR_BYTES
        share = lambda part, name: np.sqrt((part + PRIOR_BYTES * PRIOR[name]) / size)
        odd = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in b".,;:'\"-()?") if sign else 0
        loud = sum(map(bytes.isupper, words)) if upper else 0
        w = len(words) + PRIOR_WORDS
        out[k] = (
            share(lower + upper, "letters"), share(upper, "upper"), share(digit, "digits"), share(space, "spaces"),
            share(stop, "stops"), share(sign, "signs"), np.sqrt(odd / w),
            np.log((n - space + PRIOR_WORDS * PRIOR["word_bytes"]) / w),
            np.sqrt((len(set(words)) + PRIOR_WORDS * PRIOR["distinct_words"]) / w),
            np.sqrt((len(set(lines)) + PRIOR_LINES) / (len(lines) + PRIOR_LINES)), np.sqrt(loud / w),
        )
    return out


@dataclass(frozen=True)
class Model:
    """Means (2 x d), inverse Cholesky factors (2 x d x d), log density constants (2), pooled centre and scale."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -LIMIT, LIMIT)
        density = [
            c - 0.5 * np.square((z - m) @ f.T).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)
        ]
        return 1 / (1 + np.exp(np.clip(SHARPNESS * (density[0] - density[1]), -500, 500)))


def _sums(frame: DataFrame) -> DataFrame:
    """Per label the sums of (1, x) (1, x)', its upper triangle by rows. A task adds its rows up before the shuffle."""
    x = [F.lit(1.0), *[F.col("x")[k] for k in range(len(STATISTICS))]]
    return frame.groupBy("quality").agg(F.array(*[F.sum(a * b) for i, a in enumerate(x) for b in x[i:]]).alias("sums"))


def _moments(frame: DataFrame) -> dict[int, np.ndarray]:
    """Per label the sums of (1, x) (1, x)'."""
    d = len(STATISTICS) + 1
    found = {label: np.zeros((d, d)) for label in (0, 1)}
    for label, sums in _sums(frame).collect():  # two rows
        upper = np.zeros((d, d))
        upper[np.triu_indices(d)] = sums
        found[int(label)] = upper + np.triu(upper, 1).T
    return found


def discriminant(moments: dict[int, np.ndarray]) -> Model | None:
    """None without rows of both classes."""
    n = np.array([moments[c][0, 0] for c in (0, 1)])
    if (n == 0).any():
        return None
    total = moments[0] + moments[1]
    centre = total[0, 1:] / total[0, 0]
    spread = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means = np.stack([moments[c][0, 1:] / n[c] for c in (0, 1)])
    own = [moments[c][1:, 1:] / n[c] - np.outer(m, m) for c, m in zip((0, 1), means)]
    own = [s / np.outer(scale, scale) for s in own]
    means = (means - centre) / scale
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, constants = [], []
    for c in (0, 1):
        s = (1 - TOWARDS_POOLED) * own[c] + TOWARDS_POOLED * pooled
        s = (1 - TOWARDS_IDENTITY) * s + TOWARDS_IDENTITY * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
        root = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(root))
        constants.append(np.log(n[c] / n.sum()) / SHARPNESS - np.log(np.diag(root)).sum())
    return Model(means, np.stack(factors), np.array(constants), centre, scale)


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model | None:
    """Learn from the rows of ``docs`` for which ``train`` holds and whose labels agree on 0 or 1.

    All labelled rows take part. Only the statistics travel to the labels, never the texts. Repeated rows of ``docs`` count as often as
    they occur; labels that disagree are left out; null texts are empty; rows without a doc_id teach nothing; tables without both
    labels, empty ones too, give no model. Other columns, whatever their names, are ignored.
    """
    agreed = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")
    ).where("quality = most").select("doc_id", "quality")

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(statistics(texts.tolist())))
            del texts
        hand_back()

    rows = documents(docs).where(train).select("doc_id", measure("text").alias("x"))
    return discriminant(_moments(rows.join(agreed, "doc_id").select("quality", "x")))


def accepted(docs: DataFrame, model: Model | None, least: float = THRESHOLD, step: int = 512) -> DataFrame:
    """The rows whose score is at least ``least``, with all columns. Rows pass through the worker in batches of Arrow, so
    none waits for its score; null and empty texts are scored like others, repeated rows each, an empty table stays empty."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x = statistics(part.column(place).to_pylist())
                # rounded as `score` does
                score = np.round(model.scores(x), 9) if model else np.full(len(x), 0.5)
                yield part.filter(pa.array(score >= least))
            batch = part = None
        hand_back()

    place = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)


def score(model: Model | None) -> Column:
    """The score of the column ``text``, 0 to 1, higher: label 1 likelier; 0.5 for all if nothing could be learnt.

    It depends on nothing but the text: null counts as empty, equal texts have equal scores."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(np.round(model.scores(statistics(texts.tolist())), 9))

    return of(F.coalesce(F.col("text"), F.lit("")))
