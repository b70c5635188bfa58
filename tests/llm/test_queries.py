"""Each query that SQL can't express against a plain version of it, and the cases that its docstring defines."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from fixtures import odd_rows, prose
from test_llm import DATA, SF, VOCABULARY, brute_measures, brute_removed, library  # noqa: F401
from test_whole_job import plain_words

from tidemark.llm import chat, labelled, language, neardup, quality_ordinal, quality_rules, sharding, substring_dedup, tokens

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name: str, folder: str = SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_score(hashed: labelled.Hashed, text: str) -> float:
    """The bias and the plain sums of one text's weights, over the root of their number."""
    data = np.frombuffer(text.encode(), np.uint8)
    (words, _), (chars, _) = labelled.features(data, np.array([0, len(data)]))
    part = lambda weights, at: sum(float(weights[i]) for i in at) / (len(at) + labelled.PRIOR_ITEMS) ** 0.5
    return hashed.bias + part(hashed.words, words) + part(hashed.chars, chars)


def brute_rules(model: quality_rules.QualityModel, text: str) -> tuple:
    m = brute_measures(text)
    failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
    p = 1 / (1 + np.exp(-(model.slope * one_score(model.hashed, text) + model.shift)))
    return (*m, failed), p


def brute_tail(model: quality_ordinal.OrdinalModel, text: str) -> float:
    return 1 / (1 + np.exp(-(one_score(model.hashed, text) - model.thresholds[-1])))


def test_op3_is_its_plain_version(spark):
    docs = table(spark, "documents")
    model = quality_rules.train(docs, table(spark, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality_rules.op3_quality_rules(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want, p = brute_rules(model, texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert r["probability"] == pytest.approx(p, abs=1e-5)
        assert r["kept"] == (not want[-1] and p >= quality_rules.THRESHOLD) or abs(p - quality_rules.THRESHOLD) < 1e-5


def test_op8_is_its_plain_version(spark):
    docs = table(spark, "documents")
    model = quality_ordinal.train(docs, table(spark, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_ordinal.op8_quality_ordinal(spark, SF).collect():
        p = brute_tail(model, texts[r["doc_id"]] or "")
        assert r["p_grade_2"] == pytest.approx(p, abs=1e-5) and (r["kept"] == (p >= quality_ordinal.THRESHOLD) or abs(p - quality_ordinal.THRESHOLD) < 1e-5)


def test_models_of_held_out_labels(spark):
    """Both models on labels that they were not fitted on."""
    folder = f"{DATA}/sf0.01"
    docs, labels = table(spark, "documents", folder), table(spark, "labels", folder)
    seen, fresh = labels.where("doc_id % 4 <> 0"), {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.where("doc_id % 4 = 0").collect()}
    rules = {r["doc_id"]: r["kept"] for r in quality_rules.score(docs, quality_rules.train(docs, seen)).collect()}
    graded = {r["doc_id"]: r["kept"] for r in quality_ordinal.score(docs, quality_ordinal.train(docs, seen)).collect()}
    bad = [d for d, (q, _) in fresh.items() if q == 0]
    clean = [d for d, (q, t) in fresh.items() if q == 1 and t == 0]
    assert not any(rules[d] for d in bad) and np.mean([rules[d] for d in clean]) > 0.9
    assert not any(graded[d] for d in bad) and np.mean([graded[d] for d in clean]) > 0.95


def test_samples_take_long_texts_whole(spark):
    """A labelled text of any length is learnt from, and its end as well as its beginning."""
    end = "zyxwv utsrq " * 40_000
    docs = spark.createDataFrame([(1, prose(1, 50)), (2, prose(2, 30) + " " + end)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    found = labelled.labelled_sample(docs, labels)
    assert [x[1] for x in found] == [1, 0]
    for (numbers, means), text in zip([x[0] for x in found], [r["text"] for r in docs.orderBy("doc_id").collect()], strict=True):
        want = next(labelled.bags(__import__("pyarrow").array([text])))
        assert numbers.tolist() == want[0].tolist() and np.allclose(means, want[1])
    late = spark.createDataFrame([(1, "aaa " * 3000 + "qqqq " * 3000, "xx")], "doc_id long, text string, lang string")
    assert language.fold and b"qqqq" in language.learn(late.withColumn("doc_id", late["doc_id"] + 1)).dictionaries["xx"]


@pytest.mark.parametrize("labels", [[(3, 1, 0), (4, 1, 0)], [(3, 0, 0)], []])
def test_one_grade_keeps_all_that_the_rules_keep(spark, odd, labels):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality_ordinal.score(odd, quality_ordinal.train(odd, frame)).collect())
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.score(odd, quality_rules.train(odd, frame)).collect())


# -- 1 sharding


def test_a_stored_map_is_edited(spark):
    store = sharding.SlotMapStore(spark)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    before = {r["virtual_slot"]: r["shard"] for r in sharding.shard_by_bytes(docs, 6, 256, store).collect()}
    more = docs.union(spark.range(3000, 3300).selectExpr("id", "repeat('y', 200)"))
    rows = sharding.shard_by_bytes(more, 6, 256, store).collect()
    after, loads = {r["virtual_slot"]: r["shard"] for r in rows}, Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert {r["map_version"] for r in rows} == {2} and max(loads.values()) < 1.02 * min(loads.values())
    assert sum(after[s] != shard for s, shard in before.items()) < 100


def test_copies_of_one_row_are_spread(spark):
    docs = spark.range(5000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    rows = sharding.shard_by_bytes(docs).collect()
    loads = Counter(r["shard"] for r in rows)
    assert len(rows) == 5000 and len(loads) == 24 and max(loads.values()) - min(loads.values()) <= 3
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


# -- 2 substrings


def test_report_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, prose(1, 30), "a")], "doc_id long, text string, n_removed string")
    assert substring_dedup.dedup_substrings(docs, report=True).columns == ["doc_id", "text", "n_removed", "n_sentences", "_n_removed", "n_removed_words"]


# -- 5 tokens


def test_digests_are_the_library_s(spark, odd, none, library):  # noqa: F811
    for df, texts in ((odd, [(r[0], r[1]) for r in odd_rows()]), (table(spark, "documents"), None)):
        texts = texts or [(r["doc_id"], r["text"]) for r in df.collect()]
        want = Counter()
        for doc, text in texts:
            ids = library.encode(text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        got = tokens.digests(df, VOCABULARY)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert tokens.digests(none, VOCABULARY).count() == 0


# -- 6 chat


def test_a_long_thread_is_walked_in_rounds(spark):
    """Every message answers the one before; a side branch hangs on each hundredth."""
    n = 3000
    said = lambda k: f"This is statement number {k} of the thread"
    rows = [(1, 0, "u", said(0))] + [(1, k, "u", f"> {said(k - 1)}\n{said(k)}") for k in range(1, n)]
    rows += [(1, n + k, "v", f"> {said(100 * k)}\nside {k} remark here") for k in range(n // 100)] + [(1, 2 * n, "w", "alone")]
    got = {r["turn"]: r for r in chat.link_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) and sorted(r["position"] for r in got.values()) == list(range(len(rows)))
    assert all(got[k]["position"] == k and got[k]["depth"] == k for k in range(n)) and got[2 * n]["position"] == len(rows) - 1
    # Side branches come after the whole thread below their parent, the deepest parent's first.
    assert [got[n + k]["position"] for k in range(n // 100)] == [n + n // 100 - 1 - k for k in range(n // 100)]
    assert all(got[n + k]["parent"] == 100 * k and got[n + k]["depth"] == 100 * k + 1 for k in range(n // 100))


def test_chat_odd_rows(spark):
    long = prose(3, 5000)
    rows = [
        (1, 0, "a", "Sounds good."), (1, 1, "b", "> Sounds good.\nThen we go"), (1, 1, "a", "Same turn again."), (1, 1, "a", "Same turn again."),
        (1, 2, None, "> Then we go\n" + long), (2, None, "a", "> x"), (2, None, "a", "> x"), (None, None, None, None), (3, 5, "a", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as parent", "'y' as position", "1 as n", "2 as bucket", "3 as base")
    linked = chat.link_messages(df)
    got = sorted((str(r["conv_id"]), r["position"], r["turn"], r["parent"]) for r in linked.collect())
    assert got == [("1", 0, 0, None), ("1", 1, 1, 0), ("1", 2, 1, 0), ("1", 3, 1, 0), ("1", 4, 2, 1), ("2", 0, None, None), ("2", 1, None, None), ("3", 0, 5, None), ("None", 0, None, None)]
    chats = {r["conv_id"]: r["chat"] for r in chat.chat_rows(linked).collect()}
    assert long in chats[1] and "<|unknown|>" in chats[1] and chats[3] == "<|a|>\n\n"


def test_chat_with_quotes_matches_sql(spark, tmp_path):
    from compare import duck, same_rows

    rng = np.random.default_rng(5)
    rows = []
    for conv in range(30):
        own = {}
        for turn in range(int(rng.integers(1, 40))):
            own[turn] = f"In {conv} turn {turn} says {prose(conv * 100 + turn, 6)}" if rng.random() < 0.8 else "Yes indeed"
            quote = "".join(f"{'> ' * int(rng.integers(1, 3))}{own[int(rng.integers(0, turn))]}\n" for _ in range(int(rng.integers(0, 3)))) if turn else ""
            rows.append((conv, turn, "u", quote + own[turn]))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("part-*")
    os.rename(part, tmp_path / "conversations.parquet")
    here, there, a, b = same_rows(chat.op6_chat_format(spark, str(tmp_path)), duck(str(tmp_path)), chat.OP6_SQL)
    assert here == there and (a[:1], b[:1]) == ([], [])


# -- 7 near duplicates


def brute_links(texts: list[str], idf: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of texts that are similar, of all that share a shingle."""
    held, bags = defaultdict(list), []
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, counts, _ = neardup.text_shingles(data, np.array([0, len(data)]))
        bags.append((hashes, neardup.weights(hashes, counts, idf)))
        for h in hashes.tolist():
            held[h].append(i)
    pairs = {(i, j) for group in held.values() for j in group for i in group if i < j}
    return {(i, j) for i, j in pairs if neardup.similarity(bags[i], bags[j]) >= neardup.SIMILARITY}


def test_links_of_documents_are_found(spark):
    folder = f"{DATA}/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents", folder).collect()]
    links = brute_links([t or "" for _, t in docs], neardup.idf_table(table(spark, "documents", folder).select("doc_id", "text")))
    ids = {r["doc_id"]: r["class_id"] for r in neardup.op7_near_dedup(spark, folder).collect()}
    found = sum(ids[docs[i][0]] == ids[docs[j][0]] for i, j in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    # Nothing else is joined: every class is connected by links or equal texts.
    near = defaultdict(set)
    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    assert all(len({docs[k][1] for k in group}) == 1 or all(near[k] for k in group) for group in [[k for k, (d, _) in enumerate(docs) if ids[d] == c] for c in {ids[docs[i][0]] for i, _ in links}])


def test_links_of_a_large_group_are_found(spark):
    """400 copies with 0 to 24 edits: about half of them near the threshold, most buckets far over the number of heads."""
    base, texts = prose(20, 150).split(), []
    rng = np.random.default_rng(8)
    for k in range(400):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 12)), replace=False):
            copy[at] = f"edit{k}x{at}"
        texts.append(" ".join(copy))
    texts += [prose(1000 + k, 100) for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = brute_links(texts, neardup.idf_table(df))
    ids = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    lost = sum(ids[i] != ids[j] for i, j in links)
    assert len(links) > 2000 and lost <= 0.005 * len(links)
    assert all(ids[k] == k for k in range(400, 800))


def test_nodes_sort_as_doc_ids(spark):
    ids = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(i, bytearray(b"k" * 16)) for i in ids], "doc_id long, key binary")
    rows = df.select("doc_id", neardup._node("doc_id", "key").alias("node")).orderBy("node").withColumn("back", neardup._doc_of(__import__("pyspark.sql.functions").sql.functions.col("node"))).collect()
    assert [r["doc_id"] for r in rows] == ids and [r["back"] for r in rows] == ids


# -- 9 language


def test_op9_is_its_plain_version(spark):
    docs = table(spark, "documents")
    model = language.learn(docs)
    rows = {r["doc_id"]: r for r in docs.collect()}
    trained = [(r["lang"], r["text"].lower()) for r in rows.values() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    for lang, words in model.dictionaries.items():
        assert all(any(block in text for name, text in trained if name == lang) for block in words.decode().rstrip().split("\n")[:20] if len(block) > 100)
    for r in language.op9_language_id(spark, SF).collect():
        text = rows[r["doc_id"]]["text"]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data, sizes = text.lower().encode(), []
        for lang, words in model.dictionaries.items():
            held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=language.LEVEL)
            coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(coder.compress(data[k : k + language.BLOCK_BYTES])) for k in range(0, len(data), language.BLOCK_BYTES)), lang))
        sizes.sort()
        assert r["lang_pred"] == sizes[0][1] and r["score"] == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[1][0])


def test_language_ties_and_one_language(spark):
    same = spark.createDataFrame([(k, "one text for both", lang) for k, lang in enumerate(["b", "a"] * 20)], "doc_id long, text string, lang string")
    model = language.LanguageModel({"b": b"equal words", "a": b"equal words"})
    assert {r["lang_pred"] for r in language.identify(same, model).collect()} == {"a"}
    alone = language.learn(same.where("lang = 'a'"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(same, alone).collect()} == {("a", 1.0)}


# -- pipeline


def test_pipeline_is_its_plain_version(spark, library):  # noqa: F811
    import corpus_pipeline

    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: stages[name](spark, df, SF)

    model = quality_rules.train(docs, labels)
    kept = step("quality_rules", docs)
    sure = {d: (not f[-1], p) for d, t in rows(docs).items() for f, p in [brute_rules(model, t or "")] if abs(p - quality_rules.THRESHOLD) > 1e-5}
    have = rows(kept)
    assert all((d in have) == (ok and p >= quality_rules.THRESHOLD) for d, (ok, p) in sure.items())

    model = quality_ordinal.train(kept, labels)
    chosen = step("quality_classifier", kept)
    left = rows(chosen)
    assert all((d in left) == (p >= quality_ordinal.THRESHOLD) for d, t in have.items() for p in [brute_tail(model, t or "")] if abs(p - quality_ordinal.THRESHOLD) > 1e-5)

    apart = step("near_dedup", chosen)
    order = sorted(left)
    links = brute_links([left[d] for d in order], neardup.idf_table(chosen.select("doc_id", "text")))
    label = list(range(len(order)))
    equal = {}
    for k, d in enumerate(order):
        links.add((equal.setdefault(left[d], k), k))
    for i, j in sorted(links):
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    single = rows(apart)
    assert set(single) == {order[k] for k in set(label)}

    cleaned = step("substring_dedup", apart)
    gone = brute_removed(list(single.items()))
    words = lambda t: sum(len(w) for w, _ in __import__("test_llm").brute_pieces(t))
    for d, text in rows(cleaned).items():
        pieces = __import__("test_llm").brute_pieces(single[d])
        assert words(text) == sum(len(w) for k, (w, _) in enumerate(pieces) if k not in gone[d])

    total = Counter()
    for r in step("packing", cleaned).collect():
        total[r["doc_id"]] += r["length"]
    assert total == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows(cleaned).items()}


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline

    odd = spark.createDataFrame(odd_rows(), DOCUMENTS)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == odd.columns
            assert out.count() <= 2 * docs.count()


def test_words_of_long_passages(spark):
    """A passage of 60 words that two documents share goes from the second."""
    passage = plain_words(5, 60)
    docs = spark.createDataFrame([(1, plain_words(6, 30) + " " + passage), (2, passage + " " + plain_words(7, 30))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(docs).collect()}
    assert passage in got[1] and passage not in got[2] and plain_words(7, 30) in got[2]
