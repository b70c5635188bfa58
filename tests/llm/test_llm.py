"""The operators against brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from fixtures import odd_rows, prose

from tidemark.llm import bpe, chat, fingerprint, labelled, language, neardup, packing, quality_ordinal, quality_rules, sharding, substring_dedup, textvec, tokens

DATA = os.environ.get("TEST_DATA", "/root/testdata")
SF = f"{DATA}/sf0.001"
VOCABULARY = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(VOCABULARY)


# -- 1 sharding


def test_shards_are_even_and_gapless(spark):
    rows = sharding.op1_sharding(spark, SF).collect()
    loads, places = Counter(), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(loads) == 24 and max(loads.values()) < 1.02 * min(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in rows)


def test_rebalancing_moves_few_slots():
    before = sharding.SlotMap.even(4, 64)
    weights = {s: 10 + s % 3 for s in range(64)}
    weights[0] = 60
    after = before.rebalanced(weights, 4)
    loads = Counter()
    for s, shard in enumerate(after.shards):
        loads[shard] += weights[s]
    assert after.version == 1 and max(loads.values()) - min(loads.values()) <= 2
    assert sum(a != b for a, b in zip(before.shards, after.shards, strict=True)) < 20


def test_sharding_odd_rows(odd, none):
    got = sharding.shard_by_bytes(odd).collect()
    assert len(got) == len(odd_rows()) and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {8}
    assert sharding.shard_by_bytes(none).count() == 0


# -- 2 substrings


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
    return int(textvec.Words(data, np.array([0, len(data)])).hashes[0])


def brute_pieces(text: str) -> list[tuple[tuple[str, ...], bool]]:
    """Sentences as (words, False), and the pieces of long ones as (words, True)."""
    out = []
    for sentence in re.split(r"(?<=[.!?])(?=[ \t\n\v\f\r])|(?<=\n)", text):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), sentence))
        if len(words) <= substring_dedup.PIECE_WORDS:
            out += [(tuple(words), False)] if words else []
            continue
        hashes, cuts = [word_hash(w) for w in words], {0}
        for k in range(len(words) - substring_dedup.CUT_WINDOW + 1):
            window = hashes[k : k + substring_dedup.CUT_WINDOW]
            cuts.add(k + max(i for i, h in enumerate(window) if h == min(window)))
        edges = [*sorted(cuts), len(words)]
        out += [(tuple(words[i:j]), True) for i, j in zip(edges, edges[1:], strict=False)]
    return out


def brute_removed(docs: list[tuple[int, str]]) -> dict[int, set[int]]:
    seen, gone = set(), defaultdict(set)
    for doc, text in sorted(docs):
        pieces = brute_pieces(text)
        for k in range(len(pieces)):
            end, need = k + 3, substring_dedup.LEAST_WORDS
            while end <= len(pieces):
                if any(cut for _, cut in pieces[k:end]):
                    need = substring_dedup.PIECE_WORDS
                if sum(len(w) for w, _ in pieces[k:end]) >= need:
                    break
                end += 1
            if end > len(pieces):
                continue
            run = tuple(w for w, _ in pieces[k:end])
            if run in seen:
                gone[doc] |= set(range(k, end))
            seen.add(run)
    return gone


def test_repeated_spans_go_after_their_first_place(spark):
    shared = prose(50, 70)
    docs = [(1, prose(3, 60) + "\n" + shared), (2, shared + "\n" + prose(4, 60)), (3, prose(5, 40) + "\n" + shared + "\n" + prose(6, 40)), (4, prose(7, 90)), (5, prose(9, 30) + " " + shared[:40])]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), report=True).collect()}
    want = brute_removed(docs)
    assert {d: r["n_removed"] for d, r in got.items()} == {d: len(want[d]) for d, _ in docs}
    assert got[1]["text"] == docs[0][1] and got[4]["text"] == docs[3][1]
    assert shared not in got[2]["text"] and prose(4, 60) in got[2]["text"] and got[3]["n_removed_words"] >= 65


def test_substrings_match_brute_force_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_removed(docs)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.op2_substring_dedup(spark, SF).collect()}
    assert got == {d: len(want[d]) for d, _ in docs}


def test_substrings_odd_rows(odd, none):
    got = substring_dedup.dedup_substrings(odd)
    assert got.columns == odd.columns
    rows = {(r["doc_id"], i): r["text"] for i, r in enumerate(got.orderBy("doc_id").collect())}
    texts = defaultdict(list)
    for (doc, _), text in rows.items():
        texts[doc].append(text)
    assert texts[1] == [None] and texts[2] == [""] and len(set(texts[3])) == 1 and texts[3][0] == odd_rows()[3][1] and texts[5] == [""]
    assert substring_dedup.dedup_substrings(none).count() == 0


# -- 3 and 8 quality


def brute_measures(text: str | None) -> list[int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(marked)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é|#\n\t\x0b 中", max_size=60)), max_size=6))
def test_measures(texts):
    got = quality_rules.judged(quality_rules.QualityModel(None), pa.array(texts, pa.string()))
    assert [[int(got[m][i]) for m in quality_rules.MEASURES] for i in range(len(texts))] == [brute_measures(t) for t in texts]


def sample(n: int) -> list[tuple[str, int, int]]:
    good = [(prose(k, 80), 1, 0) for k in range(n)]
    junk = [(prose(k, 80).replace(" ", "### ").upper(), 0, 0) for k in range(n, 2 * n)]
    toxic = [(prose(k, 80).replace(". ", " vile scum. "), 1, 1) for k in range(2 * n, 3 * n)]
    return [x for group in zip(good, junk, toxic, strict=True) for x in group]


def test_quality_model_holds_out():
    model = quality_rules.fit(sample(40))
    fresh = pa.array([prose(900, 80), prose(901, 80).replace(" ", "### ").upper()])
    assert quality_rules.judged(model, fresh)["kept"].tolist() == [True, False]


def test_ordinal_grades_are_ordered():
    model = quality_ordinal.fit(sample(40))
    tails = model.tails(pa.array([prose(900, 80), prose(901, 80).replace(" ", "### ").upper(), prose(902, 80).replace(". ", " vile scum. ")]))
    assert (tails[:, 0] >= tails[:, 1]).all() and (tails[:, 1] >= quality_ordinal.THRESHOLD).tolist() == [True, False, False]
    assert tails[2].sum() > tails[1].sum()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (4, 1, 1), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for module, keep in ((quality_rules, quality_rules.keep_good), (quality_ordinal, quality_ordinal.keep_selected)):
        model = module.train(odd, labels)
        assert module.score(odd, model).count() == len(odd_rows())
        assert keep(odd, model).columns == odd.columns
        assert module.score(none, module.train(none, labels)).count() == 0
    assert labelled.labelled_sample(odd, labels)[1][1:] == (0, 1)


# -- 4 fingerprints


def test_fingerprints_follow_the_order_of_documents(spark):
    got = {r["doc_id"]: r for r in fingerprint.op4_fingerprints(spark, SF).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = dict(zip([d for d, _ in docs], fingerprint.fingerprints([t for _, t in docs]), strict=True))
    for k, (doc, text) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)]
        cut = len(text) // 4
        new = text[: len(text) - cut] + nxt[1][:cut]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), prints[doc])
        assert r["edited_fingerprint"] == fingerprint.fingerprints([new])[0] and r["near_next"] == pytest.approx(fingerprint.likeness(prints[doc], prints[nxt[0]]))


def test_equal_substrings_parse_alike_whatever_the_offset():
    text = prose(11, 400)
    alone, moved = fingerprint.fingerprints([text])[0], fingerprint.fingerprints(["some other words before " + text])[0]
    assert fingerprint.likeness(alone, moved) > 0.9
    assert fingerprint.likeness(alone, fingerprint.fingerprints([prose(12, 400)])[0]) < 0.1
    assert fingerprint.fingerprints([text, "", text, "aaaa"])[0] == fingerprint.fingerprints([text])[0]


def test_fingerprints_odd_rows(spark, odd, none):
    got = fingerprint.fingerprint_frame(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert fingerprint.fingerprint_frame(none).count() == 0
    assert [r["near_next"] for r in fingerprint.fingerprint_frame(odd.where("doc_id = 4")).collect()] == [1.0]


# -- 5 and 10 tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aabbcdeé'strvlmd  \n\t.!1२ÀßΣσςİ中😀́\u0085 #ﬁ가", max_size=40), max_size=5))
def test_bpe_is_the_library(library, texts):
    coder = bpe.load(VOCABULARY)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_specials_long_pieces_and_a_full_table(library):
    coder = bpe.WordBpe(VOCABULARY)
    coder.table = bpe.PieceTable(64)
    texts = ["a<|endoftext|>b", "<|startoftext|>", "it's we've 'sam ''s !'s", "a" * 3000, "aab" * 900, "thequick" * 200, None, "", *[prose(k, 50) for k in range(20)]]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_encode_decode_round_trip(odd, library):
    got = {(r["doc_id"], r["text"]) for r in tokens.decode(tokens.encode(odd, VOCABULARY), VOCABULARY).collect()}
    assert got == {(r[0], library.decode(library.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in odd_rows()}


def test_packing_holds_every_id_once(spark, odd, none, library):
    for df, texts in ((odd, [(r[0], r[1]) for r in odd_rows()]), (spark.read.parquet(f"{SF}/documents.parquet"), None)):
        texts = texts or [(r["doc_id"], r["text"]) for r in df.collect()]
        ids = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in texts]
        rows = packing.pack(df, VOCABULARY).collect()
        by_sequence = defaultdict(list)
        for r in rows:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        want = Counter()
        left = Counter((d, len(x)) for d, x in ids)
        arrays = defaultdict(list)
        for d, x in ids:
            arrays[d, len(x)].append(x)
        for r in rows:
            found = {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in arrays[r["doc_id"], r["doc_tokens"]]}
            assert r["ids_crc32"] in found
            want[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert want == {k: k[1] * n for k, n in left.items()}
        total = sum(len(x) for _, x in ids)
        assert len(by_sequence) * packing.CAPACITY <= total * 1.03 + packing.CAPACITY * df.rdd.getNumPartitions()
    assert packing.pack(none, VOCABULARY).count() == 0


@given(st.integers(1, 4095))
def test_cuts_fill_their_classes(length):
    pieces = packing.cuts(length)
    assert sum(n for n, _ in pieces) == length and all(n * k <= 4096 and n * k >= 0.96 * 4096 for n, k in pieces)


# -- 6 chat


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there my friend. How are you doing today?"),
        (1, 1, "bot", "> Hello there my friend.\nI am fine thank you."),
        (1, 2, "user", "On Monday bot wrote:\n> > Hello there my friend.\n> I am fine thank you.\nGood to hear that indeed!"),
        (1, 3, "bot", "> How are  you doing\n> today?\nStill fine as I said."),
        (1, 4, "u", "No quote at all here."),
        (1, 5, "x", "> > good to hear that indeed\nyes"),
        (2, 0, None, None),
        (None, 3, "a", "b"),
    ]
    got = {r["conv_id"]: r for r in chat.chat_rows(chat.link_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1]["turns"], got[1]["replies"]) == ("0,1,2,5,3,4", "1>0,2>1,5>2,3>0")
    assert ">" not in got[1]["chat"].replace("|>", "") and "wrote:" not in got[1]["chat"] and got[2]["chat"] == "<|unknown|>\n\n"


def test_chat_parts_are_whole(spark):
    df = spark.range(700).selectExpr("1L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    got = sorted((r["part"], r["n_messages"], r["turns"]) for r in chat.chat_rows(chat.link_messages(df), 512).collect())
    assert [x[:2] for x in got] == [(0, 512), (1, 188)] and ",".join(x[2] for x in got) == ",".join(map(str, range(700)))
    assert chat.chat_rows(chat.link_messages(df.limit(0))).count() == 0


def test_chat_matches_sql(spark):
    from compare import duck, same_rows

    here, there, a, b = same_rows(chat.op6_chat_format(spark, SF), duck(SF), chat.OP6_SQL)
    assert here == there and not a and not b


# -- 7 near duplicates


def brute_classes(texts: list[str], idf: np.ndarray) -> list[int]:
    bags = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        h, c, _ = neardup.text_shingles(data, np.array([0, len(data)]))
        bags.append((h, neardup.weights(h, c, idf)))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (len(bags[i][0]) and len(bags[j][0]) and neardup.similarity(bags[i], bags[j]) >= neardup.SIMILARITY):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_classes_are_those_of_brute_force(spark):
    base = prose(20, 150).split()
    texts = [prose(k, 120) for k in range(12)]
    for k in range(25):
        copy = list(base)
        for e in range(k % 6):
            copy[(7 * k + 23 * e) % 150] = f"edit{k}x{e}"
        texts.append(" ".join(copy))
    texts += [" ".join(base), "short one", "short one", "", "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = brute_classes(texts, neardup.idf_table(df))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == label
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == sorted(set(label))


def test_icws_collides_as_often_as_the_similarity():
    idf = np.ones(neardup.DF_BUCKETS, np.float32)
    rng = np.random.default_rng(2)
    a = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    hashes = [a[:240], a[60:]]
    counts = [rng.integers(1, 4, 240).astype(float), rng.integers(1, 4, 240).astype(float)]
    keys = [neardup.samples(h, c, np.array([0, len(h)]), 512)[0] for h, c in zip(hashes, counts, strict=True)]
    want = neardup.similarity((hashes[0], counts[0]), (hashes[1], counts[1]))
    assert abs((keys[0] == keys[1]).mean() - want) < 0.07 and idf.sum() > 0


def test_near_duplicates_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows()) and {r["class_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows()) - 2
    assert neardup.keep_one(none).count() == 0


# -- 9 language


def test_language_is_learnt_outside_the_held_out_fold(spark):
    rows = language.op9_language_id(spark, f"{DATA}/sf0.01").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    right = [r for r in held if r["lang_pred"] == docs[r["doc_id"]]["lang"]]
    assert len(right) >= 0.95 * len(held)


def test_language_odd_rows(odd, none):
    got = language.identify(odd, language.learn(odd)).collect()
    assert len(got) == len(odd_rows()) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 6)} == {"und"}
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(none)).collect()} == {"und"}


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= kept and len(ids) == len(set(ids)), name
        docs, kept = out, set(ids)
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
