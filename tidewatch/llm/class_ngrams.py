"""Language-model scores by a class-based bigram model with Brown clustering.

1. The corpus is staged in blocks of about BLOCK_BYTES of text. No block is larger than that and one document.
2. All words are counted. Those that make up at least 1 / HEAD_SHARE of the training tokens, at most HEAD_SHARE of them, are the heads.
   They are clustered by exchange: each in turn moves to the class that raises the likelihood of the class bigrams most.
   Their bigram counts, summed over all training text, are at most HEAD_SHARE squared numbers.
3. Every other word takes the class that agrees best with its neighbours: the classes beside all its occurrences are counted, summed over
   the corpus by word, and only then weighed with the heads' transitions. Sums are of whole numbers, so no class depends on how
   the corpus is cut into files, partitions or blocks.
4. Each block is then read once more beside the counts and classes of just its words. A document leaves the sums that scores
   need: log counts, and its class pairs. Transitions are summed from these, and a last narrow pass gives the scores.

The model is P(word | words before) = P(class | class before) P(word | class). Transitions are smoothed towards the class's
share. In every class but the end's, words seen once stand for those never seen, so an unknown word
has a probability in every class, and all probabilities after any word sum to one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, drop_read_shuffles, hand_back, words
from tidewatch.sources.staging import stage

BLOCK_BYTES = 12_000_000
HEAD_SHARE = 3000
CLASSES = 32  # the end has class 0, words that were not seen are of none and count as class CLASSES
TAIL = CLASSES - 1  # while heads are clustered, all other words are of this class
ROUNDS = 12
TOWARDS_SHARE = 20.0
END = b""


def exchange(pairs: np.ndarray, rounds: int = ROUNDS, classes: int = CLASSES) -> np.ndarray:
    """Classes of word 0 (the end), the heads, and the last word (all others), from their bigram counts.

    The end and the last word keep classes of their own. Heads begin in turn by their counts.
    """
    n = len(pairs)
    pairs = pairs.astype(float)
    own = np.zeros(n, int)
    own[-1] = classes - 1
    heads = np.arange(1, n - 1)
    own[heads] = 1 + np.arange(len(heads)) % (classes - 2)
    member = np.eye(classes)[own]
    table = member.T @ pairs @ member
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in heads:
            right, left, self_ = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            a = own[w]
            right[a] -= self_
            left[a] -= self_
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= self_
            rows, columns = table + right, table.T + left
            gain = (xlogx(rows) - xlogx(table)).sum(1) + (xlogx(columns) - xlogx(table.T)).sum(1)
            same = np.diag(table)
            gain += xlogx(same + right + left + self_) + xlogx(same) - xlogx(same + right) - xlogx(same + left)
            for total, more in ((table.sum(1), right.sum() + self_), (table.sum(0), left.sum() + self_)):
                gain -= xlogx(total + more) - xlogx(total)
            gain[[0, classes - 1]] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            own[w], member[w] = b, np.eye(classes)[b]
            table[b] += right
            table[:, b] += left
            table[b, b] += self_
            moved += a != b
        if not moved:
            break
    return own


def _blocks(docs: DataFrame, training: Column) -> DataFrame:
    """Documents with their block, a partition's rows in turn; staged, so that blocks stay what they are."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = size + batch["text"].str.len().cumsum()
            yield batch.assign(block=base + ends // BLOCK_BYTES)
            size = int(ends.iloc[-1]) if len(ends) else size

    rows = documents(docs).withColumn("train", training)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    blocks = rows.mapInPandas(number, "doc_id string, text string, train boolean, block long")
    return stage(blocks.withColumn("doc_id", F.col("doc_id").cast(kind)), "corpus-blocks", compression="zstd")


def _by_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task in frames of one block each; a block that two tasks share comes as two."""
    parts, block = [], None
    for batch in batches:
        for this, part in batch.groupby("block", sort=False):
            if parts and this != block:
                yield pd.concat(parts)
                parts = []
            parts.append(part)
            block = this
    if parts:
        yield pd.concat(parts)


def _heads(blocks: DataFrame) -> tuple[dict[bytes, int], int]:
    """The frequent words with their counts, most frequent first, and the number of training texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_blocks(batches):
            found: Counter = Counter()
            for text in frame["text"]:
                found.update(words(text))
            yield pd.DataFrame({"word": [END, *found], "n": [len(frame), *found.values()]})
        hand_back()

    rows = blocks.where("train").select("block", "text")
    counted = rows.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = rows.count()  # an end each
    # a share needs the number of all tokens first: the counts are staged, and read twice
    counted = stage(counted, "word-counts")
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where((F.col("n") * HEAD_SHARE >= tokens) & (F.length("word") > 0))  # at most HEAD_SHARE
    return {bytes(r["word"]): r["n"] for r in often.orderBy(F.desc("n"), "word").collect()}, total


def _bigrams(blocks: DataFrame, heads: list[bytes]) -> np.ndarray:
    """Counts of neighbours among the end (0), the heads, and all others (the last)."""
    size = len(heads) + 2
    ids = {w: k + 1 for k, w in enumerate(heads)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size * size, np.int64)
        for batch in batches:
            for text in batch["text"]:
                seq = np.array([0, *[ids.get(w, size - 1) for w in words(text)], 0])
                pairs, n = np.unique(seq[:-1] * size + seq[1:], return_counts=True)
                sums[pairs] += n
        found = np.flatnonzero(sums)
        yield pd.DataFrame({"pair": found, "n": sums[found]})

    rows = blocks.where("train").select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # at most (HEAD_SHARE + 2) squared rows
    out = np.zeros(size * size, np.int64)
    out[found["pair"]] = found["n"]
    return out.reshape(size, size)


LEFT, RIGHT = 0, CLASSES  # a context is the class before a word, or that after it beyond these
MOST = 1023  # times that one entry counts a context; more take several
_WORDS = "block long, word binary, contexts binary"


def _votes(blocks: DataFrame, heads: dict[bytes, int], own: np.ndarray) -> DataFrame:
    """(block, word, contexts) for each word of a block that is no head: how often its occurrences in training texts had
    which contexts, as 16-bit numbers (context and times)."""
    fixed = {END: 0} | {w: int(own[k + 1]) for k, w in enumerate(heads)}

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_blocks(batches):
            local = {w: k for k, w in enumerate(fixed)}
            seqs, trains = [], []
            for text, train in zip(frame["text"], frame["train"]):
                seqs.append(np.array([0, *[local.setdefault(w, len(local)) for w in words(text)], 0]))
                trains.append(train)
            n, known = len(local), np.full(len(local), TAIL)
            known[: len(fixed)] = list(fixed.values())
            taught = [q for q, train in zip(seqs, trains) if train]
            entries = offsets = None
            if taught:
                mid = np.concatenate([q[1:-1] for q in taught])
                left = known[np.concatenate([q[:-2] for q in taught])]
                right = known[np.concatenate([q[2:] for q in taught])]
                size = 2 * CLASSES
                at, times = np.unique(np.concatenate([mid * size + LEFT + left, mid * size + RIGHT + right]), return_counts=True)
                pieces = -(-times // MOST)
                last = np.cumsum(pieces) - 1
                at, spread = np.repeat(at, pieces), np.full(int(pieces.sum()), MOST)
                spread[last] = times - (pieces - 1) * MOST
                entries = ((at % size) << 10 | spread).astype("<u2").tobytes()
                offsets = 2 * np.searchsorted(at, np.arange(n + 1) * size)
            names = list(local)[len(fixed):]
            if not names:
                continue
            contexts = [entries[a:b] for a, b in zip(offsets[len(fixed):-1], offsets[len(fixed) + 1:])] if taught else [b""] * len(names)
            yield pd.DataFrame({"block": frame["block"].iloc[0], "word": names, "contexts": contexts})
        hand_back()

    return blocks.select("block", "text", "train").mapInPandas(vote, _WORDS)


def agreement(own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """How well each class goes with each context, in whole millionths, from the heads' transitions."""
    member = np.eye(CLASSES)[own]
    share = member.T @ pairs @ member + 0.1
    share /= share.sum()
    after = np.log(share / np.outer(share.sum(1), share.sum(0)))  # after[l, c]: how well c goes after l
    return np.round(np.concatenate([after, after.T]) * 1e6)


_LEXICON = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("known", pa.int64())])  # known: count, class and first
FIRST, CLASS_BITS = 1, 5  # the lowest bit, and the number of bits above it


def _lexicon(votes: DataFrame, weights: np.ndarray) -> DataFrame:
    """(block, word, known): for each word of a block what the whole training text says of it, in one number as it is shuffled.

    A word's rows follow each other; they wait, as numbers, until its last one has been added up.
    """
    size = 2 * CLASSES

    def rows(word: list, blocks: list[np.ndarray], lengths: np.ndarray, counts: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        classes = (table @ weights)[:, 1:].argmax(1) + 1
        place = np.repeat(np.arange(len(word)), lengths)
        known = (counts << CLASS_BITS + 1 | classes << 1)[place]
        known[np.cumsum(lengths) - lengths] |= FIRST
        values = [np.concatenate(blocks), pa.array(word, pa.binary()).take(pa.array(place)), known]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], schema=_LEXICON)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, waiting, count, table = None, [], 0, np.zeros(size)  # of the word that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("word")
            change = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                change[1:] = pc.not_equal(names.slice(1), names.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(change)
            ends = np.append(begin[1:], batch.num_rows)
            group = np.cumsum(change) - 1
            blocks = batch.column("block").to_numpy()
            lengths = pc.binary_length(batch.column("contexts")).to_numpy(zero_copy_only=False) // 2
            entries = np.frombuffer(b"".join(batch.column("contexts").to_pylist()), "<u2").astype(np.int64)
            at = np.repeat(group, lengths) * size + (entries >> 10)
            sums = np.bincount(at, weights=entries & MOST, minlength=len(begin) * size).reshape(-1, size)
            counts = sums[:, LEFT : LEFT + CLASSES].sum(1).astype(np.int64)  # each occurrence has one context before it
            heads = [names[int(i)].as_py() for i in begin]
            spans = [blocks[a:b] for a, b in zip(begin, ends)]
            if heads[0] == word:
                waiting.append(spans[0])
                count, table = count + counts[0], table + sums[0]
                heads, spans, counts, sums = heads[1:], spans[1:], counts[1:], sums[1:]
            if not heads:
                continue
            if waiting:
                yield rows([word], waiting, np.array([sum(map(len, waiting))]), np.array([count]), table[None])
            if len(heads) > 1:
                yield rows(heads[:-1], spans[:-1], np.array([len(x) for x in spans[:-1]]), counts[:-1], sums[:-1])
            word, waiting, count, table = heads[-1], [spans[-1]], counts[-1], sums[-1]
        if waiting:
            yield rows([word], waiting, np.array([sum(map(len, waiting))]), np.array([count]), table[None])

    dealt = votes.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(tell, "block long, word binary, known long")


_SUMS = (
    "doc_id {0}, train boolean, n_tokens long, n_known long, log_counts double, log_halves double, "
    "pairs array<int>, times array<int>, stats array<double>"
)


def _sums(blocks: DataFrame, lexicon: DataFrame, kind: str, heads: dict[bytes, int], ends: int, own: np.ndarray) -> DataFrame:
    """A row per document (its sums and class pairs), and one per block with the statistics of the words it owns."""
    size = CLASSES + 1
    known = np.array([ends, *heads.values()], np.int64)
    of_known = own[: len(known)]

    def add(docs: pd.DataFrame, lex: pd.DataFrame) -> pd.DataFrame:
        told = lex["known"].to_numpy(np.int64)
        count = np.concatenate([known, told >> CLASS_BITS + 1])
        cls = np.where(count > 0, np.concatenate([of_known, told >> 1 & (1 << CLASS_BITS) - 1]), CLASSES)
        place = {w: k for k, w in enumerate([END, *heads, *map(bytes, lex["word"])])}
        logs, halves = np.log10(np.maximum(count, 1)), np.log10(count + 0.5)
        rows = []
        for doc, text, train in zip(docs["doc_id"], docs["text"], docs["train"]):
            seq = np.array([*[place[w] for w in words(text)], place[END]])
            c = cls[seq]
            pairs, times = np.unique(np.concatenate([[0], c[:-1]]) * size + c, return_counts=True)
            rows.append((doc, train, len(seq), int((count[seq] > 0).sum()), float(logs[seq].sum()),
                         float(halves[seq].sum()), pairs, times, None))
        mine = np.concatenate([np.zeros(len(known), bool), (told & FIRST).astype(bool)]) & (count > 0)
        stats = np.zeros((3, size))
        for k, weight in enumerate((count[mine], count[mine] == 1, np.ones(mine.sum()))):
            stats[k] = np.bincount(cls[mine], weights=weight, minlength=size)
        rows.append((None, None, None, None, None, None, None, None, stats.ravel()))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in _SUMS.split(", ")])
        return out.astype({"n_tokens": "Int64", "n_known": "Int64", "train": "boolean"} | ({"doc_id": "Int64"} if kind in ("bigint", "int") else {}))

    # within a block the lexicon has every word that its documents use but the heads
    return blocks.groupBy("block").cogroup(lexicon.groupBy("block")).applyInPandas(add, _SUMS.format(kind))


def _transitions(sums: DataFrame) -> np.ndarray:
    size = CLASSES + 1

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            if len(batch):
                pairs, times = np.concatenate(batch["pairs"].to_list()), np.concatenate(batch["times"].to_list())
                total += np.bincount(pairs, weights=times, minlength=size * size).astype(np.int64)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"pair": found, "n": total[found]})

    rows = sums.where("train").select("pairs", "times").mapInPandas(add, "pair long, n long")
    out = np.zeros(size * size)
    for pair, n in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most (CLASSES + 1) squared
        out[pair] = n
    return out.reshape(size, size)


def log_model(stats: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | class before), the last column an unknown word; and log10 of what emission counts are divided by.

    ``stats``: tokens, words seen once and words, per class; ``table``: transitions in the training text.
    """
    tokens, once = stats[0, :CLASSES], stats[1, :CLASSES] + 0.5
    once[0] = 0.0
    share = (tokens + 0.5) / (tokens + 0.5).sum()
    table = table[:, :CLASSES]
    move = (table + TOWARDS_SHARE * share) / (table.sum(1, keepdims=True) + TOWARDS_SHARE)
    unknown = move @ (once / np.maximum(tokens + once, 0.5))
    with np.errstate(divide="ignore"):
        return np.log10(np.column_stack([move, unknown])), np.log10(np.append(np.maximum(tokens + once, 0.5), 1.0))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end. The model learns from rows for which ``held_out`` is false. Null and empty texts are
    the end alone. Scores are log10 probabilities of whole texts; base_score is that of single words with 0.5 added to
    each count. Without training text both scores are equal. Rows without a doc_id are scored like others; repeated
    rows count and are scored as often as they occur; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(docs, ~held_out)
    heads, ends = _heads(blocks)
    drop_read_shuffles(docs.sparkSession)
    pairs = _bigrams(blocks, list(heads))
    own = exchange(pairs)
    lexicon = _lexicon(_votes(blocks, heads, own), agreement(own, pairs))
    sums = stage(_sums(blocks, lexicon, kind, heads, ends, own), "class-sums")
    stats = np.zeros((3, CLASSES + 1))
    for n, c in zip([ends, *heads.values()], own):
        if n:
            stats[:, c] += (n, n == 1, 1)
    found = sums.where("stats is not null").select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    for k, v in found.collect():
        stats.ravel()[k] += v
    total, kinds = int(stats[0].sum()), int(stats[2].sum())
    log_move, log_sizes = log_model(stats, _transitions(sums))
    base_size = float(np.log10(total + 0.5 * (kinds + 1)))
    size = CLASSES + 1

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per_pair = (log_move - log_sizes[None, :]).ravel()
        for batch in batches:
            base = batch["log_halves"].to_numpy(float) - batch["n_tokens"].to_numpy(float) * base_size
            moves = np.array([per_pair[p] @ t for p, t in zip(batch["pairs"], batch["times"])], float)
            score = batch["log_counts"].to_numpy(float) + moves if total else base
            yield batch[["doc_id", "held_out", "n_tokens", "n_known"]].assign(
                train_tokens=total, base_score=base, score=score
            )

    rows = sums.where("stats is null").withColumn("held_out", ~F.col("train")).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = rows.mapInPandas(
        finish, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
