"""Packing and token counts against plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casebrook.llm import packing, queries, token_files, tokens


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=150, deadline=None)
def test_pack_covers_every_token_once(lengths):
    held = defaultdict(list)
    for size, pieces in packing.pack(lengths):
        assert size & (size - 1) == 0 and size <= 2048
        assert sum(p[0] for p in pieces) == size
        for length, doc, start in pieces:
            held[doc] += range(start, start + length)
    assert all(sorted(held[d]) == list(range(n)) for d, n in enumerate(lengths))


@given(st.lists(st.sampled_from([256, 512, 1024, 2048]), max_size=80))
@settings(max_examples=80, deadline=None)
def test_steps_hold_equal_tokens(sizes):
    totals = defaultdict(int)
    for size, step in zip(sizes, packing.step_groups(sizes, 4096)):
        totals[step] += size
    assert sorted(totals) == list(range(len(totals)))
    assert sum(t != 4096 for t in totals.values()) <= 1


def check_pieces(rows, expected):
    """``expected``: (doc_id, ids) of every row of the input, in any order."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    wanted = defaultdict(list)
    for key, ids in expected:
        wanted[key].append(np.array(ids, dtype="<u4"))
    assert set(whole) == set(wanted)
    for key, pieces in whole.items():
        ids, copies = wanted[key][0], len(wanted[key])
        assert all(len(x) == len(ids) for x in wanted[key])
        covered = np.zeros(len(ids), dtype=int)
        for r in pieces:
            assert r.doc_tokens == len(ids)
            part = ids[r.start : r.start + r.length]
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()


def test_packing(spark, folder, texts, reference):
    rows = queries.op6_packing(spark, folder).collect()
    check_pieces(rows, [(k, reference(t) + [1]) for k, t in texts.items()])


def test_packing_of_odd_rows(odd, nothing, reference):
    rows = packing.pack_documents(odd).collect()
    check_pieces(rows, [(r.doc_id, reference(r.text or "") + [1]) for r in odd.collect()])
    assert packing.pack_documents(nothing).collect() == []


def test_token_counts(spark, folder, texts, reference):
    rows = queries.op4_token_counts(spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(reference(t)) for k, t in texts.items()}
    assert len(rows) == len(texts)


@pytest.mark.parametrize("block_ids", [1, 7, 1000, 1 << 20])
def test_counts_over_block_ends(spark, odd, nothing, reference, block_ids):
    if block_ids == 1:
        odd = odd.where("length(text) < 100 or text is null")
    blocks = token_files.write_blocks(odd, block_ids=block_ids)
    rows = token_files.count_tokens(blocks).collect()
    want = sorted((str(r.doc_id), len(reference(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.label), r.n_tokens) for r in rows) == want
    assert all(r.closed for r in rows)
    assert token_files.count_tokens(token_files.write_blocks(nothing)).collect() == []


@pytest.mark.parametrize("block_ids", [2, 3, 64])
def test_raw_files(spark, tmp_path, block_ids):
    files = {
        "a.bin": [5, 6, 50256, 50256, 7, 8, 9, 10, 50256],
        "b.bin": [50256],
        "c.bin": [1, 2, 3, 4, 5, 50256, 3],
        "d.bin": [9, 9, 9, 9, 9],
        "e.bin": [],
    }
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    got = token_files.count_tokens(token_files.read_blocks(spark, str(tmp_path), block_ids))
    want = []
    for name, ids in files.items():
        start, number = 0, 0
        for i, token in enumerate(ids + [None]):
            if token == 50256 or (token is None and i > start):
                want.append((name, number, start, i - start, token is not None))
                start, number = i + 1, number + 1
    rows = [(r.file.rsplit("/", 1)[1], r.doc_no, r.start, r.n_tokens, r.closed) for r in got.collect()]
    assert sorted(rows) == sorted(want)


def test_broken_file(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole ids"):
        token_files.read_blocks(spark, str(tmp_path)).collect()


def test_files_are_read_by_ranges(spark, tmp_path):
    """Spark never loads a file whole, however long it is."""
    ids = ([7] * 9 + [50256]) * 500
    (tmp_path / "x y%20.bin").write_bytes(np.array(ids, dtype="<u2").tobytes())
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "64")
    try:
        blocks = token_files.read_blocks(spark, str(tmp_path), 64)
        assert max(len(r.ids) for r in blocks.collect()) == 128
        got = token_files.count_tokens(blocks).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted((r.doc_no, r.start, r.n_tokens) for r in got) == [(k, 10 * k, 9) for k in range(500)]


def test_op4_counts_raw_files(spark, odd, nothing, reference, tmp_path):
    rows = token_files.count_documents(odd, str(tmp_path / "raw")).collect()
    want = sorted((str(r.doc_id), len(reference(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    held = sum((n + 1) * 2 for _, n in want)
    assert sum(p.stat().st_size for p in (tmp_path / "raw").iterdir()) == held
    assert token_files.count_documents(nothing, str(tmp_path / "none")).collect() == []


def test_special_token_in_texts_is_one_id(spark):
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext| <|endoftext|>é "]
    want = [(k, tokenizer.encode(t, add_special_tokens=False).ids + [1]) for k, t in enumerate(texts)]
    assert len(want[0][1]) == 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(packing.pack_documents(df).collect(), want)
    # in a flat file that id would be a separator: there the string stays ordinary text
    blocks = token_files.write_blocks(df)
    assert sorted(r.label for r in token_files.count_tokens(blocks).collect()) == [0, 1, 2, 3]
