"""Byte-level BPE by a table of ranks: long texts are pre-tokenised in overlapping chunks.

1. A text is cut into chunks that overlap, and each chunk is split by the pattern on its own, in any task.
2. Splitting from a boundary on depends on nothing before it. So from the first place in the overlap where both neighbours
   have a boundary, the right one goes on exactly as the whole text would. The left one is trusted up
   to a few characters before its end, where what follows could still change its last parts. If an overlap
   holds no common boundary (one endless word), the two chunks are split again as one.
3. Each stitched pre-token is merged by its ranks alone; ids of those met before are kept.

Decoding joins the raw bytes of the ids; only a whole text is valid UTF-8 for sure.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents

CHUNK, OVERLAP = 16_384, 256
UNSURE = 8  # characters at a chunk's end that the pattern may see otherwise in the whole text
KEPT = 400_000


class RankEncoder:
    """Ids and bytes of single pre-tokens, by the tiktoken library; those met lately are kept."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.raw = {i: b for b, i in ranks.items()}
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def token(self, part: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by commas, their number, and the bytes that they decode to."""
        if (found := self.young.get(part)) is None:
            if (found := self.old.get(part)) is None:
                ids = self.encoding.encode_ordinary(part)
                found = (",".join(map(str, ids)), len(ids), b"".join([self.raw[i] for i in ids]))
            if len(self.young) >= KEPT // 2:
                self.old, self.young = self.young, {}
            self.young[part] = found
        return found

    def digest(self, parts: list[str]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded bytes, for a text split into parts."""
        get = self.young.get
        got = [get(p) or self.token(p) for p in parts]
        ids = ",".join([g[0] for g in got])
        raw = b"".join([g[2] for g in got])
        return sum([g[1] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


@cache
def encoder(path: str, pattern: str) -> RankEncoder:
    return RankEncoder(path, pattern)


def chunk_spans(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans over n characters; each begins ``overlap`` before the end of the one before."""
    spans, a = [], 0
    while True:
        b = min(n, a + chunk)
        spans.append((a, b))
        if b == n:
            return spans
        a = b - overlap


def boundaries(split: regex.Pattern, text: str, at: int = 0) -> list[int]:
    """Where the parts of a chunk that lies at ``at`` begin in its text, and where the last one ends."""
    starts = [m.start() + at for m in split.finditer(text)]
    return [*starts, at + len(text)]


def stitch(split: regex.Pattern, chunks: list[tuple[int, str, list[int]]]) -> list[str]:
    """The parts of a text from its chunks (place, text, boundaries), which are in order."""
    at, text, marks = chunks[0]
    for right_at, right, right_marks in chunks[1:]:
        sure = at + len(text) - UNSURE
        known = set(right_marks)
        k = bisect_left(marks, right_at)
        meet = next((m for m in marks[k:] if m < sure and m in known), None)
        text = text + right[at + len(text) - right_at :]
        if meet is None:
            # from the last sure boundary before the right chunk, both are split as one
            good = [m for m in marks if m < min(sure, right_at + 1)] or [at]
            marks = good[:-1] + boundaries(split, text[good[-1] - at :], good[-1])
        else:
            marks = marks[: bisect_left(marks, meet)] + right_marks[bisect_left(right_marks, meet) :]
    return [text[a - at : b - at] for a, b in zip(marks, marks[1:]) if a < b]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SPLIT = "doc_id long, row long, at int, text string, marks array<int>"


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document the number of ids, the digest of its ids and of what they decode to.

    Null and empty texts have no ids; repeated rows and rows without a doc_id give a row each; an empty table
    gives none. Lengths count code points.
    """
    if overlap <= 2 * UNSURE or chunk <= 2 * overlap:
        raise ValueError("the overlap must exceed what is unsure, and the chunk two overlaps")
    docs = documents(docs).withColumn("row", F.monotonically_increasing_id())
    long = F.char_length("text") > chunk

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for batch in batches:
            rows = [enc.digest(enc.split.findall(t)) for t in batch["text"]]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(
                doc_id=batch["doc_id"].astype("Int64").to_numpy()
            )[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for batch in batches:
            batch["marks"] = [boundaries(enc.split, t, a) for t, a in zip(batch["text"], batch["at"])]
            yield batch

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path, pattern)
        frame = frame.sort_values("at")
        parts = stitch(enc.split, [(a, t, list(m)) for a, t, m in zip(frame["at"], frame["text"], frame["marks"])])
        out = pd.DataFrame([enc.digest(parts)], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        out.insert(0, "doc_id", pd.array([frame["doc_id"].iloc[0]], "Int64") if frame["doc_id"].notna().iloc[0] else None)
        return out

    step = chunk - overlap
    begins = F.sequence(F.lit(0), F.greatest(F.char_length("text") - overlap - 1, F.lit(0)), F.lit(step))
    cut = docs.where(long).select("doc_id", "row", "text", F.explode(begins).alias("at")).select(
        "doc_id", "row", "at", F.substring("text", F.col("at") + 1, F.lit(chunk)).alias("text")
    )
    # chunks are dealt out anew: one very long text keeps many tasks busy
    chunks = cut.repartition("row", "at").mapInPandas(split, _SPLIT)
    stitched = chunks.groupBy("row").applyInPandas(joined, RESULT)
    return docs.where(~long).select("doc_id", "text").mapInPandas(whole, RESULT).union(stitched)
