"""Token counts, id files, packing and media against the libraries, on awkward texts, nulls and empty tables."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, id_files, media, packing, token_counts
from ledgerloom.llm.ragged import HashMap64, hash_spans, ranges, utf8, word_spans

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TEXTS = [
    "", None, "a", " ", "\n\n", "don't we'll 'tis 's ''s", "  two  blanks \t\n end ", "<|endoftext|> in <|endoftext|>text", "日本語テキスト 123 ½²", "🙂🙂 it's", "x" * 3000, "word " * 1500, "tail<|endof", "\r\n \r\n é'm'm",
    "same text", "same text",
]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def encode(texts, by):
    flat, offsets = utf8(pa.array(texts, pa.string()))
    return bpe.encode_rows(flat, offsets, PATH, by)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tsdtmrelv.1a😀é½|<>"), st.characters(exclude_categories=("Cs",)))), min_size=1, max_size=4))
def test_pretokens_and_merges_equal_the_library(texts):
    want = [ids_of(t) for t in texts]
    for by in ("arrays", "library"):
        ids, counts = encode(texts, by)
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_token_counts(spark):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark), PATH).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(ids_of(t)))
        assert got[i]["over_limit"] == (len(ids_of(t)) > 1024)
    assert token_counts.count_tokens(table(spark, []), PATH).count() == 0


def test_memo_bound_changes_nothing(monkeypatch):
    want = encode(["alpha beta gamma", "beta delta"] * 3, "arrays")[0].tolist()
    monkeypatch.setattr(bpe, "MEMO_WORDS", 2)
    bpe.word_codes.cache_clear()
    assert encode(["alpha beta gamma", "beta delta"] * 3, "arrays")[0].tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_codes_round_trip(numbers):
    ranks = np.array(numbers, dtype=np.uint32)
    control, data = id_files.encode(ranks)
    size = id_files.number_sizes(control)[: len(ranks)]
    assert size.sum() == len(data) and len(control) == -(-len(ranks) // 4)
    assert id_files.decode(data, size).tolist() == numbers


def test_id_files(spark, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 50)
    shuffled = table(spark).orderBy("text").repartition(3)
    got = sorted(id_files.read_ids(id_files.write_ids(shuffled, PATH), with_ids=True).collect(), key=lambda r: r["doc_id"])
    start = 0
    for row, text in zip(got, TEXTS, strict=True):
        want = [*ids_of(text), 2]
        assert (row["start"], row["n_tokens"], row["token_ids"]) == (start, len(want), want)
        assert row["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        start += len(want)
    assert id_files.read_ids(id_files.write_ids(table(spark, []), PATH)).count() == 0


def test_id_files_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = sorted(id_files.read_ids(id_files.write_ids(df, PATH)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2]
    assert [r["start"] for r in got] == [0, 2, 5, 8]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=30), st.sampled_from([8, 64, 1024]))
def test_cut_covers_documents(lengths, capacity):
    doc, start, size = packing.cut(np.array(lengths), capacity)
    k = packing.per_bin(size, capacity)
    assert ((size > 0) & (k * size <= capacity) & ((k + 1) * size > capacity)).all()
    for k, n in enumerate(lengths):
        own = doc == k
        assert start[own].tolist() == (np.cumsum(size[own]) - size[own]).tolist() and size[own].sum() == n


def test_packing(spark):
    texts = [*TEXTS, *[f"document {k} " * (k % 37) for k in range(150)]]
    rows = packing.pack(table(spark, texts).repartition(3), PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        want = [*ids_of(t), 0]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        got = [x for p in pieces for x in np.frombuffer(p["ids"], dtype="<u4").tolist()]
        assert got == want and all(p["doc_tokens"] == len(want) for p in pieces)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.02 * sum(r["length"] for r in rows)
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.media_features(media.store_media(table(spark))).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        r = got[i]
        assert not r["damaged"] and r["n_bytes"] == len(data) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert got[14]["media_sha256"] == got[15]["media_sha256"] and got[14]["feature"] == got[15]["feature"]
    assert media.media_features(media.store_media(table(spark, []))).count() == 0


def _png(pixels, filters, step):
    """A PNG written with given row filters, by the format's definition."""
    rows, wide = pixels.shape
    lines = bytearray()
    for y in range(rows):
        lines.append(filters[y])
        for x in range(wide):
            a = int(pixels[y, x - step]) if x >= step else 0
            b = int(pixels[y - 1, x]) if y else 0
            c = int(pixels[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            nearest = min((a, b, c), key=lambda v: abs(v - p))
            lines.append((int(pixels[y, x]) - (0, a, b, (a + b) // 2, nearest)[filters[y]]) % 256)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", wide // step, rows, 8, {1: 0, 3: 2, 4: 6}[step], 0, 0, 0)
    packed = zlib.compress(bytes(lines))
    return media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 3, 4])
def test_all_filters_are_read(step):
    random = np.random.default_rng(step)
    pixels = random.integers(0, 256, (15, 8 * step), dtype=np.uint8)
    for filters in ([k % 5 for k in range(15)], [4] * 15, [3] * 15, [2] * 15, [1] * 15):
        assert (media.read_png(_png(pixels, filters, step)) == pixels).all()


def test_damage_is_found(spark):
    data = bytearray(media.write_png(np.zeros((3, 64), dtype=np.uint8)))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(data))
    df = spark.createDataFrame([(1, 3, bytes(data)), (2, None, None)], "doc_id long, n_bytes long, media binary")
    assert [r["damaged"] for r in media.media_features(df).collect()] == [True, True]


def test_ragged_helpers():
    flat = np.frombuffer(b"ab  cd\nab", dtype=np.uint8)
    starts, ends, row = word_spans(flat, np.array([0, 3, 3, 9]))
    assert list(zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True)) == [(0, 2, 0), (4, 6, 2), (7, 9, 2)]
    hashes = hash_spans(flat, starts, ends)
    assert hashes[0] == hashes[2] != hashes[1]
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    table_ = HashMap64(2)
    keys = np.arange(1, 2000, dtype=np.uint64) * np.uint64(977)
    for part in np.array_split(np.arange(len(keys)), 5):
        table_.put(keys[part], part)
    assert (table_.get(keys) == np.arange(len(keys))).all() and (table_.get(keys + np.uint64(1))[:50] == -1).all()
