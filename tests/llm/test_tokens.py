import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm.common import table
from llm_texts import edges, none  # noqa: F401
from tidewatch.llm import packing, rank_bpe, token_files, tokens
from tidewatch.llm.elias_fano import EliasFano
from tidewatch.llm.queries import BYTE_BPE, RANKS
from tidewatch.sources.staging import shared_dir

SIGNS = ["a", "b", "'ll", "'s", "'", " ", "  ", "\n", "é", "1", "!", "日", "\t", "　", "'v", "word", "\x1c"]


def noise(rng, n):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randrange(n)))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pieces_encode_as_the_whole_text(library):
    rng = random.Random(3)
    texts = [noise(rng, 80) for _ in range(400)] + ["", " ", "!abc x!b", "<|endoftext|> a", "a \n b", "\n "]
    enc = tokens.PieceEncoder(BYTE_BPE, kept=40)  # forgets all the time
    for text, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [5], [0] * 200, list(range(300)), [0, 0, 1 << 40], [7, 7, 9, 1000, 1001]])
def test_elias_fano_gives_every_value_back(values):
    f = EliasFano.of(np.array(values, np.uint64))
    assert f.all().tolist() == values
    assert [f[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    f = EliasFano.of(ends)
    assert f.all().tolist() == ends.tolist()
    bits = 8 * (len(f.low) + len(f.high) + len(f.samples)) / len(ends)
    assert bits < 2.6 + np.log2(ends[-1] / len(ends))


def expected_rows(library, edges, end):
    rows = sorted(((r.doc_id, r.text or "") for r in edges.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [(d, ids_of(library, t, end)) for d, t in rows]


@pytest.mark.parametrize("size", [1_000_000, 50])
def test_token_files_round_trip(spark, edges, library, size, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", size)
    path = f"{shared_dir(spark)}/files-{size}"
    token_files.write_token_files(edges, path, BYTE_BPE, end_id=2)
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    want, start = expected_rows(library, edges, 2), 0
    assert [r.doc_id for r in got] == [d for d, _ in want]
    for r, (_, ids) in zip(got, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    row = token_files.segments(spark, path).orderBy("before").first().asDict()
    assert token_files.ids_of(row, row["n_docs"] - 1).tolist() == want[row["n_docs"] - 1][1].tolist()


def test_token_files_of_nothing(spark, none):
    path = f"{shared_dir(spark)}/files-none"
    token_files.write_token_files(none, path, BYTE_BPE, end_id=2)
    assert token_files.read_documents(spark, path).count() == 0


def check_packing(pieces, want, long):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    left = {d: [ids for e, ids in want if e == d] for d in {d for d, _ in want}}
    for d, rows in by_doc.items():
        # repeated documents: every id as often as documents have it
        assert sum(r.length for r in rows) == sum(map(len, left[d]))
        for r in rows:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in left[d])
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= long
        padding += 0 if at & (at - 1) == 0 else long - at
    return padding


def test_packing_keeps_every_id_once(edges, library):
    want = expected_rows(library, edges, 0)
    rows = packing.pack_documents(edges, BYTE_BPE, end_id=0).collect()
    assert check_packing(rows, want, 1024) <= 3 * 1024  # at most one sequence a partition
    assert {r.doc_id for r in rows} == {d for d, _ in want}
    assert {r.tier for r in rows} <= set(packing.TIERS)
    small = packing.pack_documents(edges.coalesce(1), BYTE_BPE, end_id=0, tiers=(16, 4)).collect()
    assert check_packing(small, want, 16) <= 16


def test_packing_of_nothing_and_odd_tiers(none):
    assert packing.pack_documents(none, BYTE_BPE, end_id=0).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(none, BYTE_BPE, end_id=0, tiers=(1000,))


def test_step_groups_are_balanced_over_partitions(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").repartition(5)
    step = 16_384
    got = packing.pack_documents(rows, BYTE_BPE, end_id=0, step_tokens=step).toPandas()
    sizes = got.groupby("step_group")["length"].sum()
    assert len(sizes) == -(-got["length"].sum() // step) > 5
    assert sizes.max() <= 1.12 * sizes.mean() and sizes.min() >= 0.88 * sizes.mean()
    sequences = got.drop_duplicates("sequence_id").groupby(["tier", "step_group"]).size().unstack(fill_value=0)
    assert (sequences.max(axis=1) - sequences.min(axis=1)).max() <= 1  # a like mix of tiers
    assert (got.groupby("sequence_id")["step_group"].nunique() == 1).all()


def test_chunks_stitch_to_the_whole_split():
    enc, rng = rank_bpe.encoder(RANKS, public_tokenizers.PATTERN), random.Random(5)
    for k in range(1500):
        text = noise(rng, 250) + ("x" * 90 if k % 9 == 0 else "") + noise(rng, 250)
        spans = rank_bpe.chunk_spans(len(text), 64, 24)
        chunks = [(a, text[a:b], rank_bpe.boundaries(enc.split, text[a:b], a)) for a, b in spans]
        assert rank_bpe.stitch(enc.split, chunks) == enc.split.findall(text)


@pytest.mark.parametrize("sizes", [(rank_bpe.CHUNK, rank_bpe.OVERLAP), (300, 40)])
def test_rank_encoding_equals_the_library(edges, sizes):
    whole = rank_bpe.encoder(RANKS, public_tokenizers.PATTERN).encoding
    want = []
    for r in edges.collect():
        ids = whole.encode_ordinary(r.text or "")
        joined = ",".join(map(str, ids)).encode()
        want.append((str(r.doc_id), len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = rank_bpe.encode_documents(edges, RANKS, public_tokenizers.PATTERN, *sizes).collect()
    assert sorted(want) == sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)


def test_rank_encoding_of_nothing(none):
    assert rank_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_parts_are_those_of_the_vocabulary():
    latin = [chr(c) for c in range(0x250)]
    texts = [f"{a} {b}{a}'s{b}1" for a, b in zip(latin, latin[::-1])] + [a + b + " x" for a in " \t\n\x85\xa0\x1c" for b in latin]
    for text in [*texts, "it's  we'll\n\n 12² é'd ", "a ɐ b", "多 语 's "]:
        assert "".join(tokens.parts_of(text)) == text
        assert tokens.parts_of(text) == tokens._PARTS(text)


def test_words_of_a_task_are_merged_once():
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**i % 26] for i in range(4)) + "tion"
    texts = [" ".join(word(1000 * j + k) for k in range(1000)) for j in range(100)]
    enc, asked = tokens.PieceEncoder(BYTE_BPE), []
    learn = enc._learn
    enc._learn = lambda missing: (asked.append(len(missing)), learn(missing))
    enc.encode(texts)
    first = sum(asked)
    assert first == 100_000
    enc.encode(texts)
    assert sum(asked) == first
    enc.encode([text + "." for text in texts])  # with other signs beside them the words are still known
    assert sum(asked) <= first + 1
