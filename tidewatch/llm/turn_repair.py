"""Repair of conversations by weighted CYK parsing.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. The repair grammar is in Chomsky normal form: its symbols are
[p, q], "these rows, edited, take the reader of that pattern from state p to state q", with

    [p, q] -> [p, r] [r, q]        for every state r
    [p, q] -> one row, edited      keep, rerole or delete, closed under insertions before and after it

A cell of a span holds for every symbol the least (cost, audit), the audit being the initials of the edits. Of two derivations of one
symbol over the same rows, the one with the smaller cell stays smaller in every context: equal costs forbid that one audit continues
the other. As the symbols are pairs of states, every split of a span gives the same cell; so one split a span is enough, spans
double from level to level, and n rows need n - 1 cells.

1. Faults and order need narrow rows only: role, digest of the text, flags. Equal rows are one row with a count.
2. Rows are dealt by range of (conversation, turn), so that a long conversation lies in several tasks. Each task parses spans of up to
   SPAN rows; further rounds combine up to SPAN spans of a conversation, until each has one.
3. The texts are shuffled once, by conversation, behind the audit, and stream through the hash. SHA-256 can't be split, so the texts of one
   conversation pass through one task, but only a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.staging import stage

SPAN = 1024  # rows, or spans, that are combined in one step
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

# the reader of (s?(ua)+)?: begun, after s, after u, after a; begun and after a may end
STATES, FINAL = 4, (0, 3)
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

Cell = tuple  # STATES x STATES of (cost, audit) or None, row by row


def combine(left: Cell, right: Cell) -> Cell:
    out = []
    for p in range(STATES):
        for q in range(STATES):
            best = None
            for r in range(STATES):
                a, b = left[p * STATES + r], right[r * STATES + q]
                if a is not None and b is not None:
                    both = (a[0] + b[0], a[1] + b[1])
                    if best is None or both < best:
                        best = both
            out.append(best)
    return tuple(out)


def least(a: Cell, b: Cell) -> Cell:
    return tuple(min((x for x in pair if x is not None), default=None) for pair in zip(a, b))


def _terminals(edits: list[tuple[int, int, int, str]]) -> Cell:
    out: list = [None] * (STATES * STATES)
    for p, q, cost, audit in edits:
        at = p * STATES + q
        out[at] = min(out[at], (cost, audit)) if out[at] else (cost, audit)
    return tuple(out)


def _insertions() -> Cell:
    """No row at all: insertions only. Closed, as it doesn't change when combined with itself."""
    cell = _terminals([(p, p, 0, "") for p in range(STATES)])
    step = least(cell, _terminals([(p, q, INSERT, "I") for (p, role), q in MOVES.items() if role != "s"]))
    while cell != step:
        cell, step = step, combine(step, step)
    return cell


NOTHING = _insertions()


@lru_cache(maxsize=64)
def row_cell(initial: str, fault: str) -> Cell:
    """One row by its role's initial and its fault: b(lank), d(uplicate), t(runcated) or none."""
    more = CUT_OFF if fault == "t" else 0
    edits = [(p, p, DELETE, "D") for p in range(STATES)]
    if fault not in ("b", "d"):
        for (p, role), q in MOVES.items():
            if role == initial:
                edits.append((p, q, KEEP + more, "K"))
            if role != "s":
                edits.append((p, q, REROLE + more, "R"))
    return combine(combine(NOTHING, _terminals(edits)), NOTHING)


def by_length(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, pairs of spans first."""
    while len(cells) > 1:
        pairs = [combine(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else NOTHING


@lru_cache(maxsize=4096)
def _run_cell(codes: str) -> Cell:
    """Rows by codes of two characters; conversations share most of their short runs."""
    return by_length([row_cell(codes[i], codes[i + 1].strip()) for i in range(0, len(codes), 2)])


def cell_of(codes: str, step: int = 8) -> Cell:
    return by_length([_run_cell(codes[i : i + 2 * step]) for i in range(0, len(codes), 2 * step)])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies (0: dropped, 2: repeated), as strings but for turn and copies; nulls count as a space.

    ``conv`` is null for the conversation without an id; ``turn`` stays null, too.
    """
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).alias("place"),
    )
    kind = F.crc32(F.col("place").cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def whole(conversations: DataFrame) -> DataFrame:
    """The same columns for conversations that are to be repaired as they are."""
    nothing = damaged(conversations.limit(0))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), *texts)
    return nothing.unionByName(rows.withColumn("copies", F.lit(1).cast("long")))


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, copies, code: distinct rows with their first copy's role initial and fault."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    kind = F.when(last == "", "b").when(last.isin(".", "!", "?"), " ").otherwise("t")
    narrow = rows.select("conv", "turn", "role", _digest().alias("digest"), kind.alias("kind"), "copies")
    narrow = narrow.groupBy("conv", "turn", "role", "digest", "kind").agg(F.sum("copies").alias("copies"))
    narrow = stage(narrow, "turns")
    met = narrow.where("kind <> 'b' and copies > 0")
    # a null turn comes first, so it is less than any other
    begun = F.min(F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn"))).alias("begun")
    first = met.groupBy("conv", "role", "digest").agg(F.count("*").alias("times"), begun).where("times > 1")
    again = first.select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), "begun")
    rows = narrow.join(again, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")), "left")
    seen = F.col("begun").isNotNull() & ~F.col("turn").eqNullSafe(F.col("begun.turn"))
    fault = F.when((F.col("kind") != "b") & seen, "d").otherwise(F.col("kind"))
    # roles other than the three have a dot, which the pattern has not
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(".")
    return rows.select("conv", "turn", "role", "digest", "copies", F.concat(initial, fault).alias("code"))


_SPANS = pa.schema(
    [("conv", pa.string()), ("at", pa.int64())]
    + [(c, pa.int64()) for c in ("rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_SPANS_SQL = (
    "conv string, at long, rows long, low long, high long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, costs array<long>, audits array<string>"
)
NEXT_TO = ("su", "ua", "au")


def _row_span(conv: str | None, turn: int | None, code: str, copies: int) -> dict:
    """What is known of ``copies`` equal rows of one turn: all but the first repeat it."""
    initial, fault = code[0], code[1].strip()
    repeated = "b" if fault == "b" else "d"
    out = dict.fromkeys(_SPANS.names, 0) | {"conv": conv, "rows": copies, "low": None, "high": None, "first": None, "last": None}
    if copies:
        for kind, n in ((fault, 1), (repeated, copies - 1)):
            name = {"b": "blank", "d": "duplicate", "t": "truncated"}.get(kind)
            if name:
                out[name] += n
        known = turn is not None
        out |= {"low": turn, "high": turn, "turns": int(known), "first": initial, "last": initial}
        out["illegal"] = (copies - 1) * (initial * 2 not in NEXT_TO)
    return out


def _join_spans(a: dict, b: dict) -> dict:
    """The counts of two neighbouring spans, in order of turns."""
    if not a["rows"] or not b["rows"]:
        return dict(b if b["rows"] else a)
    out = {c: a[c] + b[c] for c in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in NEXT_TO
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"conv": a["conv"], "first": a["first"], "last": b["last"]}
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out


def _with_cell(span: dict, cell: Cell, at: int) -> dict:
    return span | {"at": at, "costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell]}


def _parse_rows(span: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of conversation and turn; a span ends with its conversation, or after ``span`` rows."""
        base = TaskContext.get().partitionId() << 40
        out: list[dict] = []
        state, codes, begun, made = None, [], False, 0

        def close() -> None:
            nonlocal made
            if begun:
                out.append(_with_cell(state, cell_of("".join(codes)), base + made))
                made += 1

        for batch in batches:
            for conv, turn, code, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "code", "copies"))):
                repeated = code[0] + ("b" if code[1] == "b" else "d")
                new = not begun or state["conv"] != conv
                while True:  # equal rows may be more than a span holds
                    if new or len(codes) >= span:
                        close()
                        state, codes, begun = _row_span(conv, None, code, 0), [], True
                        new = False
                    part = min(copies, span - len(codes))
                    if not part:
                        break
                    state = _join_spans(state, _row_span(conv, turn, code, part))
                    codes.extend([code] + [repeated] * (part - 1))
                    copies, code = copies - part, repeated
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, _SPANS)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, _SPANS)

    return parse


def _combine_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one conversation and ``step``, in order, to one span."""
    out: list[dict] = []
    key, state, cells, at = None, None, [], 0

    def close() -> None:
        if cells:
            out.append(_with_cell(state, by_length(cells), at))

    for batch in batches:
        for row in batch.to_pylist():
            this = (row["conv"], row["step"])
            cell = tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))
            if this != key:
                close()
                key, state, cells, at = this, row, [cell], row["at"]
            else:
                state = _join_spans(state, row)
                cells.append(cell)
        if len(out) > 500:
            yield pa.RecordBatch.from_pylist(out, _SPANS)
            out.clear()
    close()
    yield pa.RecordBatch.from_pylist(out, _SPANS)


def _spans(faults: DataFrame, span: int) -> DataFrame:
    """One row per conversation: counts and the cell of all its rows."""
    order = ["conv", "turn", "role", "digest"]
    faults = stage(faults, "turn-faults")  # the range is found from a first pass
    rows = faults.repartitionByRange(*order).sortWithinPartitions(*order)
    spans = stage(rows.select("conv", "turn", "code", "copies").mapInArrow(_parse_rows(span), _SPANS_SQL), "spans")
    while True:
        several = spans.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")
        several = stage(several.select(F.col("conv").alias("conv_"), F.lit(True).alias("several")), "long-conversations")
        if several.isEmpty():
            return spans
        marked = spans.join(several, F.col("conv").eqNullSafe(F.col("conv_")), "left").drop("conv_")
        place = F.row_number().over(Window.partitionBy("conv").orderBy("at")) - 1
        parts = marked.where("several").select(*_SPANS.names, F.floor(place / span).alias("step"))
        parts = parts.repartition("conv", "step").sortWithinPartitions("conv", "step", "at")
        joined = parts.mapInArrow(_combine_spans, _SPANS_SQL)
        spans = stage(marked.where("several is null").select(_SPANS.names).unionByName(joined), "spans")


def _best(spans: DataFrame) -> DataFrame:
    """The cheapest audit of each conversation, from the states that may end it."""
    cells = F.array(*[F.struct(F.col("costs")[q].alias("cost"), F.col("audits")[q].alias("audit")) for q in FINAL])
    best = F.array_min(F.filter(cells, lambda c: c["cost"].isNotNull()))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return spans.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                        best["cost"].alias("cost"), best["audit"].alias("audit"))


_HASH = pa.schema(
    [("conv", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_HASH_SQL = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_ROW_SQL = "conv string, place int, part long, text string"


class Editor:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.said, self.begun = audit, 0, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._speaker(), ""

    def _speaker(self) -> str:
        self.said += 1
        return "user" if (self.said - self.begun) % 2 else "assistant"

    def edit(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        step = self.audit[self.at]
        self.at += 1
        if step == "K" and role[:1] == "s":
            self.begun = 1
        if step != "D":
            speaker = self._speaker()
            yield (role if step == "K" else speaker), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _streams(best: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of each conversation in order, behind a row with its verdict."""
    verdict = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    heads = best.select("conv", F.lit(0).alias("copies"), *verdict)
    order = ["conv", "head", "turn", "role", "digest"]
    rows = rows.where("copies > 0").withColumns({"digest": _digest(), "head": F.lit(1)})
    both = rows.unionByName(heads.withColumn("head", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions(*order).select("conv", "head", "role", "text", "copies", *verdict)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    verdict, editor, sha, glue = None, None, None, b""

    def write(said: Iterator[tuple[str, str]]) -> None:
        nonlocal glue
        for role, text in said:
            sha.update(glue + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            glue = b"\n"

    def close() -> None:
        if editor:
            write(editor.end())
            out.append(verdict | {"repaired_sha256": sha.hexdigest()})

    for batch in batches:
        rows = batch.to_pydict()
        for k, head in enumerate(rows["head"]):
            if head == 0:
                close()
                verdict = {c: rows[c][k] for c in _HASH.names[:-1]}
                editor, sha, glue = Editor(verdict["audit"]), hashlib.sha256(), b""
            else:
                for _ in range(rows["copies"][k]):
                    write(editor.edit(rows["role"][k], rows["text"][k]))
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, _HASH)
            out.clear()
    close()
    yield pa.RecordBatch.from_pylist(out, _HASH)


def repair(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per conversation of ``rows`` (as ``damaged`` or ``whole`` gives them): conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    best = _best(_spans(_faults(rows), span))
    return _streams(best, rows).mapInArrow(_hash, _HASH_SQL)


def _say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    editor, conv, place = None, None, 0

    def rows_of(said: Iterator[tuple[str, str]]) -> list[dict]:
        nonlocal place
        made = []
        for role, text in said:
            made.append({"conv": conv, "place": place, "role": role, "text": text})
            place += 1
        return made

    for batch in batches:
        rows, out = batch.to_pydict(), []
        for k, head in enumerate(rows["head"]):
            if head == 0:
                out += rows_of(editor.end()) if editor else []
                editor, conv, place = Editor(rows["audit"][k]), rows["conv"][k], 0
            else:
                for _ in range(rows["copies"][k]):
                    out += rows_of(editor.edit(rows["role"][k], rows["text"][k]))
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(rows_of(editor.end()) if editor else [], schema)


def repaired(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """The repaired conversations themselves: conv, place, role, text."""
    best = _best(_spans(_faults(rows), span))
    return _streams(best, rows).mapInArrow(_say, "conv string, place long, role string, text string")


def repair_damaged(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per conv_id of the table: what was wrong after the damage, the cheapest repair and the hash of its text.

    Nulls count as one space, in the hash that chooses the damage, too; a null role is therefore none of the three, and a null text is
    blank. A null conv_id is a conversation like others. Rows without a turn come first; they count in no gap. Rows of one turn come by
    role, then by digest of their texts. Repeated rows are duplicates of the first. Very long texts and conversations need no more
    memory than a row and the audit. Other columns are ignored; an empty table gives no rows.
    """
    kind = conversations.schema["conv_id"].dataType
    out = repair(damaged(conversations), span)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *out.columns[1:])
