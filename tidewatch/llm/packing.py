"""Hierarchical packing of token sequences into windows of several context sizes.

Documents are routed by what is left of them after whole long windows: the remainder goes to the smallest
tier that holds it. The long tier opens windows with its own remainders and fills their gaps with
shorter ones, whole while they fit and the last one cut; then each shorter tier packs what is left in the same
way from itself and the tiers below. All tiers are powers of two, so a full window of any tier needs no
padding. What cannot fill a window of its tier goes on to the next batch, and the last few of a
partition share one padded sequence.

Step groups are balanced over all partitions: from the number of sequences of each tier in each partition every
sequence gets its place among all of its tier, and the places of a tier are split evenly over the groups. So groups hold the same
number of sequences of each tier, up to one, and with them the same number of tokens.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import documents, hand_back, in_slices
from tidewatch.sources.staging import measured, stage

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 1 << 19
BATCH_IDS = 4_000_000  # ids that are packed together; bounds a task's memory beside its longest document

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "tier int, part int, of_tier long"
)


class Packer:
    """Packs one partition. A piece is (doc, start, end); ``out`` collects (sequence, tier, its place in the tier, offset, piece)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.next = 0
        self.made = dict.fromkeys(self.tiers, 0)
        self.out: list[tuple] = []

    def _emit(self, tier: int, parts: list[tuple]) -> None:
        at = 0
        for doc, a, b in parts:
            self.out.append((self.next, tier, self.made[tier], at, doc, a, b))
            at += b - a
        self.next += 1
        self.made[tier] += 1

    def add(self, doc: int, n: int) -> None:
        """Whole long windows go out at once; the remainder waits in its tier."""
        long = self.tiers[0]
        for a in range(0, n - n % long, long):
            self._emit(long, [(doc, a, a + long)])
        if rest := n % long:
            tier = min(t for t in self.tiers if t >= min(rest, long))
            self.pools[tier].append((doc, n - rest, n))

    def pack(self) -> None:
        """Pack every tier as far as its pieces and the shorter ones fill windows."""
        for k, tier in enumerate(self.tiers):
            pool = self.pools[tier] = deque(sorted(self.pools[tier], key=lambda p: p[1] - p[2]))
            below = [self.pools[t] for t in self.tiers[k + 1 :]]
            have = sum(p[2] - p[1] for q in [pool, *below] for p in q)
            while pool and have >= tier:
                parts, gap = [], tier
                for q in [pool, *below]:
                    while q and gap:
                        doc, a, b = q.popleft()
                        cut = min(b, a + gap)
                        parts.append((doc, a, cut))
                        gap -= cut - a
                        if cut < b:  # the tail keeps its place; routing anew puts it into the tier of its size
                            self.pools[min(t for t in self.tiers if t >= b - cut)].appendleft((doc, cut, b))
                have -= tier
                self._emit(tier, parts)
            if have < tier:
                for q in [pool, *below]:
                    if q is not pool:
                        pool.extend(q)
                        q.clear()
                self.pools[self.tiers[-1]] = pool if tier != self.tiers[-1] else self.pools[tier]
                if tier != self.tiers[-1]:
                    self.pools[tier] = deque()
                break

    def finish(self) -> None:
        """What is left is less than a long window together, or fits one sequence after the other."""
        self.pack()
        rest = deque(p for t in self.tiers for p in self.pools[t])
        while rest:
            parts, gap = [], self.tiers[0]
            while rest and gap:
                doc, a, b = rest.popleft()
                cut = min(b, a + gap)
                parts.append((doc, a, cut))
                gap -= cut - a
                if cut < b:
                    rest.appendleft((doc, cut, b))
            self._emit(self.tiers[0], parts)
        self.pools = {t: deque() for t in self.tiers}


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS
) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies in its sequence.

    Every partition packs for itself, so texts are never shuffled; at most one sequence a partition is padded.
    A null text is empty (its end id alone), a null doc_id is kept as null, repeated rows are packed each
    for itself, very long texts are cut into windows. Other columns are ignored. ``sequence_id`` is unique over all partitions;
    ``step_group`` is one of as few groups as ``step_tokens`` allows. An empty table gives no rows.
    """
    tiers = tuple(sorted(tiers, reverse=True))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("context sizes are powers of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, packer, part = tokens.encoder(vocabulary), Packer(tiers), TaskContext.get().partitionId()
        ids: dict[int, np.ndarray] = {}
        names: dict[int, str | None] = {}
        fresh = count = 0  # ids since the last packing; documents

        def rows() -> pd.DataFrame:
            out, packer.out = packer.out, []
            left = {p[0] for t in packer.tiers for p in packer.pools[t]}
            frame = []
            for seq, tier, place, at, d, a, b in out:
                frame.append((names[d], a, b - a, zlib.crc32(ids[d][a:b]), len(ids[d]), (part << 33) + seq, at, tier, part, place))
            for d in [d for d in ids if d not in left]:
                del ids[d], names[d]
            frame = pd.DataFrame(frame, columns=[c.split()[0].strip("`") for c in PIECE.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for batch in in_slices(batches):
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids[count] = np.append(enc.encode([text])[0], np.uint32(end_id)).astype("<u4")
                names[count] = None if doc is None or pd.isna(doc) else int(doc)
                packer.add(count, len(ids[count]))
                fresh, count = fresh + len(ids[count]), count + 1
                if fresh >= BATCH_IDS:
                    packer.pack()
                    yield rows()
                    fresh = 0
        packer.finish()
        yield rows()
        enc.forget()
        hand_back()

    pieces = documents(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, PIECE)
    return _step_groups(stage(pieces, "packed-pieces"), step_tokens)


def _step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    made = pieces.groupBy("part", "tier").agg(F.max("of_tier").alias("last"), F.sum("length").alias("tokens"))
    made = measured(made)  # a row per partition and tier
    before = F.sum(F.col("last") + 1).over(Window.partitionBy("tier").orderBy("part")) - F.col("last") - 1
    all_of = Window.partitionBy("tier")
    groups = F.greatest(F.ceil(F.sum("tokens").over(Window.partitionBy()) / step_tokens), F.lit(1))
    dealt = made.select("part", "tier", before.alias("before"), F.sum(F.col("last") + 1).over(all_of).alias("of"), groups.alias("groups"))
    group = F.floor((F.col("before") + F.col("of_tier")) * F.col("groups") / F.col("of"))
    return pieces.join(dealt, ["part", "tier"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.alias("step_group")
    )
