"""Near-duplicate classes don't hang on which texts of a bucket are its heads."""

from __future__ import annotations

import numpy as np
from fixtures import prose

from tidemark.llm import neardup


def groups(n_groups: int, copies: int) -> list[tuple[int, str]]:
    """Groups of near copies that share their first half with all other groups."""
    shared = prose(900, 150).split()
    docs = []
    for g in range(n_groups):
        own = shared + prose(901 + g, 150).split()
        docs += [(g * copies + k, " ".join([*own[: 20 * k + 10], f"changed{g}x{k}", *own[20 * k + 10 :]])) for k in range(copies)]
    return docs


def test_no_link_is_lost_without_heads(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_heads", lambda full: full.selectExpr("band", "bucket", "1 as place", "node as head").where("false"))
    df = spark.createDataFrame(groups(4, 8), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: i // 8 * 8 for i in range(32)}


def test_overlaps_are_similarities():
    rng = np.random.default_rng(5)
    idf = (1 + rng.random(neardup.DF_BUCKETS)).astype(np.float32)
    pool = np.sort(rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2))
    # The last two have more shared shingles than are compared at once.
    bags = [(np.sort(rng.choice(pool[:400], n, replace=False)), rng.integers(1, 4, n).astype(np.uint32)) for n in (300, 320, 5, 390)]
    bags += [(pool[a:b], np.ones(b - a, np.uint32)) for a, b in ((0, 18000), (1000, 20000))]
    every = np.arange(len(bags))
    got = neardup.overlaps(bags, every, every, idf)
    for i in every:
        for j in every[every != i]:
            want = neardup.similarity(*[(bags[k][0], neardup.weights(*bags[k], idf)) for k in (i, j)])
            assert abs(got[i, j] - want) < 1e-5


def test_one_of_a_class_stays_without_heads(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_heads", lambda full: full.selectExpr("band", "bucket", "1 as place", "node as head").where("false"))
    df = spark.createDataFrame(groups(3, 8), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == [0, 8, 16]


def test_all_links_of_a_crowded_bucket_in_many_blocks(spark, monkeypatch):
    """One bucket of several classes: each pair of different classes is compared, whichever blocks its texts are dealt to."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 5)
    docs = groups(5, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    idf = neardup.idf_table(df)
    named = df.selectExpr("encode(lpad(doc_id, 3, '0'), 'utf-8') as node", "text")
    full = named.selectExpr("node", "0 as band", "7L as bucket", f"{len(docs)}L as size")
    # The first group is a class already, as is part of the second.
    class_of = lambda i: 0 if i < 12 else 12 if i < 17 else i
    roots = spark.createDataFrame([(b"%03d" % i, b"%03d" % class_of(i)) for i in range(17)], "node binary, root binary")
    found = neardup.rest(full, roots, neardup.bags(named), spark.sparkContext.broadcast(idf)).collect()
    bags = []
    for _, text in docs:
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, counts, _ = neardup.text_shingles(data, np.array([0, len(data)]))
        bags.append((hashes, neardup.weights(hashes, counts, idf)))
    links = {(i, j) for j in range(len(docs)) for i in range(j) if class_of(i) != class_of(j) and neardup.similarity(bags[i], bags[j]) >= neardup.SIMILARITY}
    assert len(links) > 100 and sorted((int(r["a"]), int(r["b"])) for r in found) == sorted(links)
