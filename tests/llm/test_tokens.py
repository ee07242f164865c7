"""Token records and packing: exact round trips."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuesheet.llm import packing, records
from cuesheet.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def whole(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ENCODERS = [(Encoder(WORD, True), whole(WORD)), (Encoder(BYTE, False), whole(BYTE))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t abcXYZé'ß.,!?019\xa0\x01\x00\x1ć"), st.characters(codec="utf-8")), max_size=60), max_size=6))
def test_encoding_by_words_is_encoding(texts):
    for ours, plain in ENCODERS:
        got = [np.frombuffer(x, "<u2").tolist() for x in ours(pa.array(texts, pa.string()))]
        assert got == [plain(t) for t in texts]


def test_records(odd, rows, tmp_path):
    encode = whole(WORD)
    shards = records.write_records(odd, str(tmp_path / "r"), WORD)
    got = sorted(records.read_digests(shards).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, order, strict=True):
        ids = [*encode(text or ""), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), crc(ids))
        start += len(ids)


def test_small_shards_hold_their_bound(odd, rows, tmp_path):
    encode = whole(WORD)
    shards = records.write_records(odd, str(tmp_path / "r"), WORD, shard_bytes=50)
    made = shards.collect()
    assert len(made) > 5 and all(x.bytes - 50 < 16 + 2 * max(len(encode(t or "")) + 1 for _, t in rows) for x in made)
    assert sum(x.records for x in made) == len(rows)
    got = sorted(records.read_digests(shards).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(r.doc_id, r.ids_crc32) for r in got] == [(d, crc([*encode(t or ""), 2])) for d, t in order]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_damage_is_found(odd, tmp_path):
    shards = records.write_records(odd, str(tmp_path / "r"), WORD).collect()
    path = shards[0].path + ".rec"
    data = bytearray(open(path, "rb").read())
    records.unframe(memoryview(data), 0)
    data[13] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(data), 0)
    data[1] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(data), 0)


def test_packing(odd, rows):
    encode = whole(BYTE)
    want = sorted(crc([*encode(t or ""), 0]) for _, t in rows)
    pieces = packing.pack(packing.encoded(odd, BYTE).cache()).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 2 > 0
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert sum(p.length for p in pieces) == sum(len(encode(t or "")) + 1 for _, t in rows)
    unique = [k for k in by_doc if k[0] is not None and sum(d == k[0] for d, _ in rows) == 1]
    for k in unique:
        ids = b"".join(bytes(p.ids) for p in sorted(by_doc[k], key=lambda p: p.start))
        assert zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()) in want


def test_checksums_of_pieces(odd, rows):
    """The query's form: checksums of each piece's ids instead of the ids."""
    encode = whole(BYTE)
    texts = [(d, [*encode(t or ""), 0]) for d, t in rows]
    pieces = packing.packed(odd, BYTE).collect()
    assert all((d, p.doc_tokens) == (p.doc_id, len(ids)) for p in pieces for d, ids in [next(x for x in texts if x[0] == p.doc_id and len(x[1]) == p.doc_tokens)])
    left = sorted((str(d), len(ids)) for d, ids in texts)
    for p in pieces:
        assert any(d == p.doc_id and p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for d, ids in texts)
        if p.start == 0:
            left.remove((str(p.doc_id), p.doc_tokens))
    assert not left
    used = defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
    for x in used.values():
        ends = 0
        for offset, n in sorted(x):
            assert offset == ends and n > 0
            ends += n
        assert ends <= packing.LENGTH
    assert len(used) <= sum(len(ids) for _, ids in texts) / packing.LENGTH * 1.05 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 60), min_size=1, max_size=25), st.integers(1, 8))
def test_plan_places_every_id_once(histogram, min_gap):
    placed, packs = packing.plan(histogram, 64, min_gap)
    seen, used = defaultdict(list), defaultdict(list)
    for i in range(len(placed["part"])):
        for k in range(placed["count"][i]):
            seen[placed["length"][i], placed["rank"][i] + k].append((placed["start"][i], placed["size"][i]))
            used[placed["pack"][i] + k].append((placed["offset"][i], placed["size"][i]))
    assert set(seen) == {(n, r) for n, c in histogram.items() for r in range(c)}
    for x, end in [*((v, k[0]) for k, v in seen.items()), *((v, None) for v in used.values())]:
        at = 0
        for start, size in sorted(x):
            assert start == at and size > 0
            at += size
        assert at == end if end is not None else at <= 64
    assert set(used) == set(range(packs))


def test_little_padding():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 1024, 20_000), return_counts=True), strict=True)}
    _, packs = packing.plan(histogram)
    total = sum(k * v for k, v in histogram.items())
    assert packs * 1024 < total * 1.01


def test_empty(empty, tmp_path):
    assert records.read_digests(records.write_records(empty, str(tmp_path / "r"), WORD)).count() == 0
    assert packing.packed(empty, BYTE).count() == 0
