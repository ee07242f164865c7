"""The pipeline's stages on odd rows and on planted cases."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline
from cuesheet.llm import decontamination, exact, simhash

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


def test_stages_keep_the_columns(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DIR).columns == odd.columns


def test_what_is_planted_goes(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first().text
    clean = [(i, text(120)) for i in range(20)]
    copy, near = clean[3][1], clean[4][1].replace(clean[4][1].split()[-1], "other.")
    docs = [*clean, (50, copy), (50, copy), (51, "  ".join(copy.split(" "))), (52, near), (53, f"{text(30)} {item} {text(30)}"), (54, None), (55, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = exact.keep_first_copies(spark, df, DIR)
    assert sorted(r.doc_id for r in left.collect()) == [*range(20), 52, 53, 54]
    left = simhash.keep_one_of_each_group(spark, left, DIR)
    ids = sorted(r.doc_id for r in left.collect())
    assert set(range(20)) <= set(ids) and 53 in ids
    left = decontamination.drop_contaminated(spark, left, DIR)
    ids = {r.doc_id for r in left.collect()}
    assert 53 not in ids and set(range(20)) <= ids


def test_run_packs_what_all_stages_keep(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
    got = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_texts_of_similarity_from_08_on_go(spark):
    """Pairs at 0.8 to 1 and just under 0.8, by brute force; parts of a long list hang together."""
    rng = random.Random(3)
    docs = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        docs.append((2 * k, " ".join(words)))
        for at in rng.sample(range(8, 112), k % 5 + 1):
            words[at] = "other"
        docs.append((2 * k + 1, " ".join(words)))
    docs += [(1000 + i, f"{docs[0][1]} tail{i}") for i in range(60)]
    sets = [set(simhash.shingles(t, 5)) for _, t in docs]
    alike = [{j for j in range(len(docs)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(len(docs))]
    least, todo = list(range(len(docs))), True
    while todo:
        new = [min(least[j] for j in x) for x in alike]
        todo, least = new != least, new
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_of_each_group(spark, df, DIR).collect()}
    assert kept == {docs[i][0] for i in range(len(docs)) if least[i] == i}
    rows = df.withColumnRenamed("doc_id", "nr")
    links = [(r.u, r.v) for r in simhash.similar_links(rows, "nr", band_limit=16).collect()]
    assert {x for e in links for x in e} >= {0, *range(1000, 1060)}


def test_a_near_copy_goes(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120))
    df = spark.createDataFrame([(4, text + " last."), (52, text + " other."), (53, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each_group(spark, df, DIR).collect()) == [4, 53]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    a, b, c, clean = text(), text(), text(), text()
    docs = [(1, a), (2, a + " more"), (2, clean), (None, b), (None, b + " more"), (3, c), (3, c + " more")]
    left = [(r.doc_id, r.text) for r in simhash.keep_one_of_each_group(spark, spark.createDataFrame(docs, "doc_id long, text string"), DIR).collect()]
    assert len(left) == 4 and {(1, a), (2, clean)} <= set(left)
    assert sum(i is None for i, _ in left) == sum(i == 3 for i, _ in left) == 1


def test_long_lists_lose_no_component(spark):
    """Chains, whose ends are unlike each other and unlike any hub, in lists cut into parts of eight."""
    rng = random.Random(9)
    docs, want = [], {}
    for k in range(4):
        words = [f"k{k}w{i}" for i in range(150)]
        for i in range(40):
            docs.append((100 * k + i, " ".join(words)))
            want[docs[-1][0]] = 100 * k
            words[rng.randrange(60)] += "x"
    rows = spark.createDataFrame(docs, "nr long, text string")
    found = simhash.similar_links(rows, "nr", band_limit=8)
    assert {r.node: r.root for r in simhash.components(found).collect()} == want
    sets = {i: set(simhash.shingles(t, 5)) for i, t in docs}
    assert all(len(sets[r.u] & sets[r.v]) >= 0.8 * len(sets[r.u] | sets[r.v]) for r in found.collect())
    # the second step alone: one list of all rows, of which the first step has linked one chain and left the others apart
    keyed = rows.selectExpr("nr AS row", "0 AS band", "7L AS key")
    large = spark.createDataFrame([(0, 7, len(docs))], "band int, key long, n long")
    roots = rows.where("nr < 40").selectExpr("nr AS node", "0L AS root")
    blocks = simhash._blocks(keyed, large, roots, 8)
    assert blocks.where("asks").select("row").distinct().count() == 120
    added = simhash._compared(rows.withColumnRenamed("nr", "row"), blocks, ["band", "key", "part", "chunk"])
    both = added.union(roots.where("node > 0").selectExpr("node", "root"))
    assert {r.node: r.root for r in simhash.components(both).collect()} == want
    few = simhash._blocks(keyed, large, roots.union(rows.where("nr >= 40").selectExpr("nr", "0L")), 8)
    assert few.isEmpty()


def test_rows_with_a_passage_in_common_are_not_compared_with_each_other(spark):
    """Many unlike rows share a long passage, and so some band; few of them are alike. Prefixes list the similar ones only."""
    rng = random.Random(12)
    own = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage, docs = own(90), []
    for i in range(300):
        docs.append((i, " ".join(passage + own(40))))
    for i in range(0, 40, 2):
        words = docs[i][1].split()
        words[125] = "other"
        docs.append((1000 + i, " ".join(words)))
    rows = spark.createDataFrame(docs, "nr long, text string")
    found = simhash.similar_links(rows, "nr", band_limit=8)
    assert {frozenset(r) for r in found.collect()} == {frozenset((i, 1000 + i)) for i in range(0, 40, 2)}
    prefixes = simhash._prefixes(rows.withColumnRenamed("nr", "row"))
    lists = prefixes.groupBy("key").count().where("count > 1").collect()
    assert lists and max(r["count"] for r in lists) == 2


def test_odd_rows_leave_one_of_each_group(odd, empty, spark):
    left = simhash.keep_one_of_each_group(spark, odd, DIR)
    texts = [r.text for r in left.collect()]
    assert left.columns == odd.columns and len(texts) == len(set(texts))
    assert sum(not (t or "").strip() for t in texts) == 1 and sum(len(t or "") > 100_000 for t in texts) == 1
    assert simhash.keep_one_of_each_group(spark, empty, DIR).count() == 0


def test_rows_that_only_their_fingerprints_bring_together(spark):
    """A pair at 0.8 that shares no band of least hashes, but whose fingerprints are within three bits; and one within three bits that is not alike."""
    rng = random.Random(1002)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = own(40) * 12
    docs = [(1, " ".join(base + own(5))), (2, " ".join(base + own(5))), (3, " ".join(base + own(40)))]
    sets, bits = [simhash.shingle_set(t) for _, t in docs], [simhash.fingerprint(t, 5) for _, t in docs]
    assert not (simhash.band_keys(sets[0]) == simhash.band_keys(sets[1])).any()
    assert max((bits[0] ^ x).bit_count() for x in bits[1:]) <= 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each_group(spark, df, DIR).collect()) == [1, 3]
