"""SentencePiece encoding, hard negatives and resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesheet.llm import negatives, pieces, queries, resampling

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLE = pieces.ChunkTable(MODEL)
SMALL = "/root/testdata/sf0.001"


def encoded(texts):
    ids, ends = TABLE(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁abcXYZé'.,<0x>19\xa0\x00ć漢字"), st.characters(codec="utf-8")), max_size=80), max_size=6))
def test_encoding_by_chunks_is_encoding(texts):
    assert encoded(texts) == [LIBRARY.encode(t) for t in texts]


def test_long_chunks_and_blanks_are_encoded_whole():
    rng = random.Random(3)
    texts = ["a" * 20_000, "漢字かな交じり文" * 2000, " " * 3000, "x" + " " * 40 + "y ", "".join(rng.choice("abcdefgh▁ \n<>0x.é字") for _ in range(30_000)), "<s> </s> <unk> <0x0A>", "", " "]
    assert encoded(texts) == [LIBRARY.encode(t) for t in texts]
    some = pa.array(["left out", *texts, "left out too"]).slice(1, len(texts))
    ids, ends = TABLE(some)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [LIBRARY.encode(t) for t in texts]


def test_the_table_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    t = pieces.ChunkTable(MODEL)
    for texts in (["one two three four five", "one"], ["two six", "seven eight one"], ["one two"]):
        ids, ends = t(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [LIBRARY.encode(x) for x in texts]
        assert len(t.chunks) <= 8


def test_odd_rows_are_encoded_and_decoded(odd, rows):
    got = pieces.decode_pieces(pieces.encode_pieces(odd, MODEL), MODEL).collect()
    plain = lambda t: LIBRARY.encode(t or "")
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got], key=key) == sorted([(i, plain(t), LIBRARY.decode(plain(t)) if t else "") for i, t in rows], key=key)


def test_no_rows(empty, spark):
    assert pieces.decode_pieces(pieces.encode_pieces(empty, MODEL), MODEL).count() == 0
    assert resampling.resample(empty, empty).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(negatives.prepared(none), F.col("vec_id") % 100 == 0).count() == 0


def test_op11_gives_the_library_s_digests(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.QUERIES["op11_sentencepiece"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 40), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_strassen_is_exact(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**26), 2**26, (m, k)), rng.integers(-(2**26), 2**26, (n, k))
    assert (negatives.product(a, b) == a @ b.T).all()


def mined(rows, every):
    """Plain version over (number, vec_id, vector, label)."""
    usable = [(n, i, [math.floor(256 * float(x)) for x in v], y) for n, i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v, y in usable:
        if i % every:
            continue
        score = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), j, m, z == y) for m, j, w, z in usable if m != n)
        for s, j, _, _ in [x for x in score if x[3]][:5]:
            window = [x for x in score if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(window, 1)]
    return sorted(out)


def test_negatives_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0.3, 0.3) for _ in range(rng.choice((6, 6, 6, 4)))], rng.choice((0, 0, 0, 1, 2))) for i in range(-40, 260)]
    rows += [rows[7], (20, [0.5] * 6, 1), (40, None, 1), (60, [0.1, None], 1), (None, [0.5] * 6, 1), (80, [float("nan")], 0), (80, [float("inf"), 1.0], 0), (100, [0.5], None), (120, [], 1), (140, [0.0] * 6, 2)]
    rows += [(13, [0.5] * 6, 2)] * 40
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, nr string").coalesce(1)
    got = negatives.hard_negatives(negatives.prepared(df), F.col("vec_id") % 20 == 0, stripe=5, slice_=60).collect()
    assert sorted(map(tuple, got)) == mined([(n, *r) for n, r in enumerate(rows)], 20)
    assert len(got) > 100


def test_vectors_that_no_score_fits_take_no_part(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1e30, 1.0], 0), (2, [1.0, 1.0], 0), (3, [0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in negatives.hard_negatives(negatives.prepared(df), F.col("vec_id") == 0).collect()] == [(0, 2, 1, 3, 131072, 65536)]


def test_keys_are_xxh64_and_slots_keep_what_collides_apart():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abé9") for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 21, 40)))) for _ in range(rng.randrange(60))) for _ in range(50)]
    grams = resampling.Grams(pa.array(texts))
    keys = grams.keys(grams.lanes())
    assert keys.tolist() == [xxhash.xxh64_intdigest(grams.bytes_of(i)) for i in range(len(keys))]
    for k in (keys, np.zeros(len(keys), np.uint64), keys & np.uint64(3)):
        table, found = resampling.GramTable(grams, k), defaultdict(Counter)
        for i, slot in enumerate(table.slot.tolist()):
            found[slot][grams.bytes_of(i)] += 1
        assert all(len(x) == 1 for x in found.values()) and len(found) == len({grams.bytes_of(i) for i in range(len(keys))})
        assert all(table.count[slot] == sum(x.values()) and table.bucket[slot] == zlib.crc32(next(iter(x))) % 10_000 for slot, x in found.items())


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(docs, target):
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s, t = (Counter(bucket(x) for text in texts for x in features(text)[1]) for texts in ([x for _, x in docs], target))
    total = [sum(x.values()) for x in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total[0] + 10_000) / ((s[b] + 1) * (total[1] + 10_000))))
    out = []
    for i, text in docs:
        words, grams = features(text)
        weight = sum(gain(bucket(x)) for x in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    out.sort(key=lambda x: (not x[4], -x[3], x[0] is not None, x[0] or 0))
    drawn = sum(x[4] for x in out) * 25 // 100
    return [(*x[:4], n if n <= drawn else None) for n, x in enumerate(out, 1)]


def same(got, expected):
    key = lambda x: tuple((v is None, v or 0) for v in x)
    return sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_resampling_against_plain_counts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = queries.QUERIES["op13_importance_resampling"](spark, SMALL).collect()
    assert same(got, resampled(docs, target)) and sum(r.rank is not None for r in got) > 10


def test_odd_rows_are_resampled(odd, rows, spark):
    target = spark.createDataFrame([("alpha beta", 1), (None, 2), ("", 3)], "text string, n int")
    assert same(resampling.resample(odd, target).collect(), resampled(rows, ["alpha beta"]))


def test_many_rows_of_one_id_are_ranked(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(5, text)] * 300 + [(i, text) for i in range(6, 106)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string")).collect()
    assert same(got, resampled(rows, ["w1 w2"]))
