"""Spelling variants: words that differ by one letter, found through a bit-sliced position index.

1. Words are counted by a grouping, so frequent words collapse before the shuffle.
2. The vocabulary is split into blocks in which all near words of a word are met. Of two near words, of m and m or
   m + 1 letters, either the first half of m letters is equal in both or the rest of m is: each word enters the blocks of its first
   and of its last letters, once for each m. A block of more than BLOCK words is halved in the same way at the letters not yet fixed, until
   it is smaller or a single letter is left, which bounds it by the alphabet.
3. A block is indexed by bitsets over its words, one for each (position, letter). For each word, word-parallel recurrences along its letters
   keep the set of words without an error so far beside the sets with one error: at the same position (replaced), one position on
   (the other word has a letter more) and one position back (a letter less).
4. Bits are ranked by count, so the number of near words and the best of them are the population and the lowest bit of
   the final set. No pairs are written.
5. Forms are followed to their roots by pointer doubling. Counts at least double on the way, so a few rounds do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, UPPER
from tidewatch.sources.staging import measured, stage

BLOCK = 4096  # words
MIN_LENGTH, MIN_COUNT = 5, 3
SLIP = 97  # one in so many runs loses a letter
KEY = ["m", "head", "tail", "later", "first", "last"]


def runs(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """(doc, run): every maximal run of letters of at least ``min_length``, only A-Z lower-cased."""
    text = F.translate("text", UPPER, LOWER)
    found = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))


def slipped(doc: Column, run: Column, every: int = SLIP) -> Column:
    """The run, without one letter if ``every`` divides the hash of document and run."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts."""
    found = runs(docs, min_length).select(slipped(F.col("doc"), F.col("run")).alias("word"))
    counts = found.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Blocks by name: the letters that their words share at either end."""
    first = F.substring(F.col("word"), F.lit(1), F.col("head"))
    last = F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return rows.withColumns({"first": first, "last": last})


def _halved(rows: DataFrame) -> DataFrame:
    """Each word in the two halves of its block. ``later``: words equal in all of the free letters met in the other half."""
    half = ((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
    front = F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("later"))
    back = F.struct(F.col("head"), (F.col("m") - F.col("head") - half).alias("tail"), F.lit(True).alias("later"))
    return _keyed(rows.withColumn("half", F.explode(F.array(front, back))).select("word", "n", "m", "half.*"))


def _blocks(words: DataFrame, limit: int) -> DataFrame:
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    shortest = words.agg(F.min(length)).first()[0] or 0  # no word is that short, so nothing pairs there
    whole = whole.where(F.col("m") >= shortest).withColumns({"head": F.lit(0), "tail": F.lit(0), "later": F.lit(False)})
    rows = stage(_halved(whole), "word-blocks")
    while True:
        free = F.col("m") - F.col("head") - F.col("tail")
        large = rows.where(free > 1).groupBy(KEY).agg(F.count("*").alias("size")).where(F.col("size") > limit)
        large = measured(large.select(*KEY, F.lit(True).alias("large")))
        if large.isEmpty():
            return rows
        marked = rows.join(large, KEY, "left")
        split = _halved(marked.where("large").drop("first", "last", "large"))
        rows = stage(marked.where("large is null").select(rows.columns).unionByName(split), "word-blocks")


def near_in_block(m: int, head: int, tail: int, later: bool, words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(place, number of near words, place of the first) for each word with near ones.

    The words have m or m + 1 letters, the first ``head`` and last ``tail`` of which they share. ``later`` leaves out
    what the half with equal first letters holds as well: a letter added right before the tail.
    """
    index: dict[tuple[int, str], int] = defaultdict(int)
    same = longer = 0
    for k, word in enumerate(words):
        bit = 1 << k
        if len(word) == m:
            same |= bit
        else:
            longer |= bit
        for i in range(head, len(word) - tail):
            index[i, word[i]] |= bit
    if not same or not same | longer:
        return
    end = m - tail
    for k, word in enumerate(words):
        if len(word) == m:
            none, replaced, added = same | longer, 0, 0
            for i in range(head, end):
                letter = word[i]
                here = index[i, letter]
                added = (added | none) & index.get((i + 1, letter), 0)
                replaced = (replaced & here) | none
                none &= here
            found = replaced & same & ~none
            found |= (added & ~none if later else added | none) & longer
        else:
            none, dropped = same, 0
            for i in range(head, end + 1):
                letter = word[i]
                dropped = (dropped & index.get((i - 1, letter), 0)) | none
                if i < end:
                    none &= index[i, letter]
            found = dropped & ~none if later else dropped
        if found:
            yield k, found.bit_count(), (found & -found).bit_length() - 1


_NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words block by block; a block's rows follow each other, the most frequent word first."""
    key, words, counts, out = None, [], [], []

    def close() -> None:
        if len(words) > 1:
            for k, near, best in near_in_block(*key[:4], words):
                out.append((words[k], near, words[best], counts[best]))

    for batch in batches:
        for *this, word, n in zip(*(batch.column(c).to_pylist() for c in [*KEY, "word", "n"])):
            if this != key:
                close()
                key, words, counts = this, [], []
            words.append(word)
            counts.append(n)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(_NEAR.names, r)) for r in out], _NEAR)
            out.clear()
    close()
    yield pa.RecordBatch.from_pylist([dict(zip(_NEAR.names, r)) for r in out], _NEAR)


def near_words(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) for the words with near ones; ``words`` are distinct (word, n)."""
    rows = _blocks(words, limit).repartition(*KEY).sortWithinPartitions(*KEY, F.desc("n"), "word")
    found = rows.select(*KEY, "word", "n").mapInArrow(_search, "word string, near long, best string, best_n long")
    best = F.min(F.struct(-F.col("best_n"), F.col("best")))  # words in code-point order
    sums = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top"))
    return sums.select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.col1")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form); words without a form are not in it."""
    links = stage(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "word-roots")
        links = moved.drop("more")
        if moved.where("more").isEmpty():
            return links


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, limit: int = BLOCK) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest count, the smallest of equals, if its count is at least twice the word's. Null and empty texts
    hold no words; a null doc_id counts as an empty one; repeated rows count as often as they occur; very long
    runs are words like others; other columns are ignored; an empty table gives no rows.
    """
    words = stage(vocabulary(docs.select("doc_id", "text"), min_length, min_count), "vocabulary")
    rows = words.join(near_words(words, limit), "word", "left")
    strong = F.col("best_n") >= 2 * F.col("n")
    rows = stage(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(rows.where("form is not null"))
    out = rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


# The same over whole tables in DuckDB: CRC-32 by its reflected polynomial, near words by letters left out.
ORACLE_SQL = """
with recursive steps as (
    select list_transform(range(256), lambda i: list_reduce(
        list_prepend(i::ubigint, list_transform(range(8), lambda k: k::ubigint)),
        lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as t
), runs as (
    select doc_id, run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) as run
        from documents)
    group by all
), hexed as (
    select run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as b from runs
), hashed as (
    select run, n, xor(4294967295::ubigint, list_reduce(
        list_prepend(4294967295::ubigint, list_transform(range(length(b) // 2),
            lambda i: ('0x' || substr(b, (2 * i + 1)::bigint, 2))::ubigint)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) % 256 + 1)::bigint]))) as h
    from hexed, steps
), words as (
    select word, sum(n)::bigint as n from (
        select n, case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2)
            else run end as word
        from hashed)
    where length(word) >= 5 group by word having sum(n) >= 3
), cut as (
    select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
    from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
    select a.word, b.word as other, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
    union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
), best as (
    select word, count(*) as n_near, max(n) as top, arg_min(other, (-n, encode(other))) as other from near group by word
), forms as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 2 * w.n then other end as form,
        case when top >= 2 * w.n then top end as form_n
    from words w left join best using (word)
), walk as (
    select word, word as root, form as next from forms
    union all select w.word, w.next, f.form from walk w join forms f on f.word = w.next
)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n from forms f join walk w on w.word = f.word and w.next is null
"""
