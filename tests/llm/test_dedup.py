"""Exact dedup, near-dedup and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuesheet.llm import exact, graph, sharding, simhash


def plain_copies(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append((doc is None, doc if doc is not None else 0, i))
    return {t: (None if min(g)[0] else min(g)[1], len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("identifier", [F.xxhash64, lambda c: F.length(c).cast("long") % 3])
def test_exact_dedup(odd, rows, identifier):
    want = plain_copies(rows)
    got = exact.copies(odd, identifier=identifier).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): x for t, x in want.items()}
    assert all((r.keep_id, r.group_size) == sha[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)


def test_chunks_give_the_text_back(odd):
    bad = odd.where("text is not null").select(exact.normalised(F.col("text")).alias("t")).where(F.array_join(exact.chunks(F.col("t")), "") != F.col("t"))
    assert bad.count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def roots(pairs, nodes):
    at = {x: x for x in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_near_groups(odd, rows):
    fps = {text: plain_fingerprint(text) for _, text in rows}
    distinct = sorted(set(fps.values()))
    found = roots([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3], distinct)
    least = defaultdict(list)
    for doc, text in rows:
        least[found[fps[text]]].append(doc)
    want = sorted((str(d), fps[t], str(min((x for x in least[found[fps[t]]] if x is not None), default=None))) for d, t in rows)
    got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in simhash.near_groups(odd).collect())
    assert got == want


@pytest.mark.parametrize("limit", [2, 1024])
def test_links_find_all_within_three_bits(spark, limit):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    want = roots([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    links = [(u % (1 << 64), v % (1 << 64)) for u, v in simhash.links(df, group_limit=limit).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in links)
    assert roots(links, fps) == want


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 5)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200}


def plain_shards(rows, limit):
    sized = [(int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16), len((t or "").encode()), d) for d, t in rows]
    out = []
    for h, n, d in sized:
        for depth in range(61):
            size = sum(m for g, m, _ in sized if g >> (60 - depth) == h >> (60 - depth))
            if size <= limit or depth == 60:
                out.append((str(d), n, format(h, "060b")[:depth], depth, size, size <= limit))
                break
    return sorted(out)


@pytest.mark.parametrize("limit", [10, 5000, 250_000, 10**9])
def test_sharding(odd, rows, limit):
    got = sorted((str(r.doc_id), r.bytes, r.shard, r.depth, r.shard_bytes, r.fits) for r in sharding.shard(odd, limit).collect())
    assert got == plain_shards(rows, limit)


def test_empty_tables(empty):
    assert exact.copies(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("limit", [10, 5000, 10**9])
def test_written_shards(spark, odd, rows, tmp_path, limit):
    sharding.write_shards(odd, str(tmp_path / "s"), limit)
    got = spark.read.parquet(str(tmp_path / "s"))
    by_id = {d: s for d, _, s, *_ in plain_shards(rows, limit)}
    want = sorted((str(d), str(t), "b" + by_id[str(d)]) for d, t in rows)
    assert sorted((str(r.doc_id), str(r.text), r.shard) for r in got.collect()) == want


def test_tables_can_be_cleared(spark, odd):
    from pathlib import Path

    from cuesheet.llm import common

    assert exact.copies(odd).count() == odd.count() and common.WRITTEN
    paths = [Path(p.removeprefix("file:")) for p in common.WRITTEN if "table-" in p]
    assert any(p.exists() for p in paths)
    common.clear(spark)
    assert not any(p.exists() for p in paths) and not common.WRITTEN


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from cuesheet.llm import common

    def session(master):
        held = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: held[-1] if held else None, setCheckpointDir=held.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))

    assert common.shared_dir(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_chunks_are_cut_by_content(spark):
    """Without ends of sentences too: after a change near the start, the last chunks are as before."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(20_000))
    df = spark.createDataFrame([(0, text), (1, "more " + text)], "row long, text string").select("row", exact.chunks(F.col("text")).alias("c"))
    a, b = (r.c for r in df.orderBy("row").collect())
    assert a[-1] == b[-1] and len(set(a) & set(b)) > len(a) / 2 and max(map(len, a[:-1])) < exact.CHUNK_MIN + 20
