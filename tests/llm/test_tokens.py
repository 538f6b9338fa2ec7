"""Operators 3, 5 and 7 against the libraries, exact round trips, and edge rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from apsight.llm import bpe, packing, queries, token_files
from apsight.llm.pieces import PieceEncoder

BYTE, WORDS, RANKS = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
ODD = ["'", "s", "re", "ll", "a", "Z", "1", "２", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "!", "é", "ß", "\u0301", "漢", "😀", "\x1c", "\x85", "'s", "'S", "²", "_", "<|endoftext|>"]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_pieces_equal_the_library(path, texts):
    rng, encode, library = random.Random(1), PieceEncoder(path), Tokenizer.from_file(path)
    some = ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(1500)] + list(texts.values())
    added = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "endoftext|>"]
    some += [t for a in added for t in (a, f"{a} b", f"a {a} b", f"a {a}", f"a{a}b", f" {a} ", f"a  {a}\n{a}", f"x {a}{a}, y. The end", f"<{a}>")]
    for text, got in zip(some, encode.batch(some), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in some[-45:]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pieces_begin_anew(monkeypatch, texts):
    """A full cache is emptied between batches; the ids are the same."""
    from apsight.llm import pieces

    monkeypatch.setattr(pieces, "CACHE_PIECES", 50)
    encode, library = PieceEncoder(BYTE), Tokenizer.from_file(BYTE)
    for text in list(texts.values())[:60]:
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [7], [0] * 500, [2**63, 0, 5, 2**64 - 1, 2**60, 1], list(range(5000)), [1, 2**61] * 40])
def test_words_round_trip(values):
    ids = np.array(values, np.uint64)
    words, marks = token_files.pack(ids)
    assert token_files.unpack(words, len(ids)).tolist() == values
    for lo, hi in [(0, len(ids)), (len(ids) // 3, len(ids) // 2), (max(0, len(ids) - 1), len(ids))]:
        if len(ids):
            assert token_files.unpack_slice(words, marks, lo, hi).tolist() == values[lo:hi]


def test_random_words_round_trip_and_are_dense():
    rng = np.random.default_rng(2)
    for top in (2, 200, 60_000, 2**33):
        ids = rng.integers(0, top, 20_000).astype(np.uint64)
        words, _ = token_files.pack(ids)
        assert (token_files.unpack(words, len(ids)) == ids).all()
        assert len(words) <= len(ids)


def test_token_files_query(spark, texts):
    lib = Tokenizer.from_file(BYTE)
    at = 0
    got = {r.doc_id: r for r in queries.op3_token_files(spark, "/root/testdata/sf0.001").collect()}
    for doc_id in sorted(texts):
        ids = np.array([*lib.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[doc_id]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_edges(spark, edge, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(edge, path, BYTE, block_ids=50)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 6, 7]
    assert [len(r.ids) for r in rows if r.doc_id in (2, 3)] == [4, 4]  # the end id alone
    assert all(b.start == a.start + len(a.ids) // 4 for a, b in zip(rows, rows[1:], strict=False))
    assert token_files.token_files(spark, edge.limit(0), BYTE).count() == 0


def test_bpe_equals_tiktoken(texts):
    import public_tokenizers
    import tiktoken

    pairs, rng = bpe.BytePairs(RANKS), random.Random(3)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    some = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(3000)] + list(texts.values())
    some += ["a" * 3000, "é" * 500 + " " * 200, "ab'" * 400, "\n" * 30 + "a"]
    for at in range(0, len(some), 100):
        for text, got in zip(some[at:at + 100], pairs.encode_group(some[at:at + 100]), strict=True):
            ids = np.frombuffer(got, "<u4")
            assert ids.tolist() == whole.encode_ordinary(text), text
            assert pairs.decode(ids) == text.encode()


def test_bpe_scan_is_the_stepwise_machine():
    rng, scan = np.random.default_rng(5), bpe.scanner()
    kinds = rng.integers(0, 9, 1000).astype(np.int8)
    state, expected = bpe.FREE, []
    for k in kinds.tolist():
        expected.append(state)
        state = bpe._step(state, k)[0]
    assert scan.states_before(kinds).tolist() == expected


def test_bpe_edges(edge):
    coded = bpe.encode(edge, RANKS)
    rows = {(r.doc_id, len(r.decoded)) for r in bpe.decode(coded, RANKS).collect()}
    assert {(2, 0), (3, 0), (6, 3)} <= rows and len(coded.collect()) == 10
    part = {r.doc_id: r for r in bpe.decode_range(coded.where("doc_id = 1"), RANKS, 2, 5).collect()}[1]
    text = b"The first text stands here, alone and long enough to have words."
    assert text[part.at:].startswith(bytes(part.decoded)) and len(part.decoded) > 3
    assert bpe.encode(edge.limit(0), RANKS).count() == 0


def _check_packed(pieces, lengths, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
        assert r.padded_to == (r.sequence_tokens if r.sequence_tokens & (r.sequence_tokens - 1) == 0 else size)
    for doc_id, spans in by_doc.items():
        assert sum(n for _, n in spans) == lengths[doc_id]
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
    return by_seq


def test_packing_query(spark, small, texts):
    lib = Tokenizer.from_file(WORDS)
    ids = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    rows = packing.pack_documents(small, WORDS).collect()
    by_seq = _check_packed(rows, {d: len(i) for d, i in ids.items()}, 2048)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start:r.start + r.length]
    used = sum(map(len, ids.values()))
    assert len(by_seq) * 2048 < 1.1 * used + 4096


def test_packing_few_windows_and_edges(edge):
    rows = packing.pack_documents(edge, WORDS, size=64, open_windows=2).collect()
    lengths = defaultdict(int)
    for r in rows:
        if r.start == 0:
            lengths[r.doc_id] += r.doc_tokens
    _check_packed(rows, lengths, 64)
    assert lengths[2] == lengths[3] == lengths[4] == 1 and len({r.start for r in rows if r.doc_id == 5}) > 100
    assert packing.pack_documents(edge.limit(0), WORDS).count() == 0


def test_open_windows_are_bounded():
    rng, windows, out = random.Random(4), packing.OpenWindows(100, 5), []
    for i in range(2000):
        done = windows.place(rng.randint(1, 100), i)
        assert len(windows.order) <= 6
        out += [x for _, x in done[2]] if done else []
    out += [x for w in windows.drain() for _, x in w[2]]
    assert sorted(out) == list(range(2000))


def test_full_pieces_take_no_slot():
    windows = packing.OpenWindows(2048, 64)
    assert not any(windows.place(1500, i) for i in range(64))
    assert windows.place(2048, "full") == (2048, 64, [(0, "full")]) and len(windows.order) == 64


def test_packing_query_columns(spark, texts):
    """The registered query: digests of each piece, sequences without gaps, padding."""
    lib = Tokenizer.from_file(WORDS)
    ids = {d: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    found, pieces = defaultdict(list), defaultdict(list)
    for r in queries.op7_packing(spark, "/root/testdata/sf0.001").collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        found[r.doc_id].append((r.start, r.length))
        pieces[r.sequence_id].append(r)
    assert found.keys() == ids.keys()
    for doc_id, parts in found.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc_id])
    for rows in pieces.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        power = at & (at - 1) == 0
        assert {(r.sequence_tokens, r.padded_to) for r in rows} == {(at, at if power else 2048)} and at <= 2048


def test_byte_bpe_query(spark, texts):
    import hashlib

    import public_tokenizers
    import tiktoken

    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.BytePairs(RANKS).ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in texts.items():
        ids = whole.encode_ordinary(text or "")
        assert got[doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
