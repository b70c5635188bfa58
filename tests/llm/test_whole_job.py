"""What the training-data operators must not leave out."""

from __future__ import annotations

from fixtures import prose

from tidemark.llm import substring_dedup


def plain_words(seed: int, words: int) -> str:
    return prose(seed, words).replace(".", "")


# -- 2 substrings


def test_passages_within_a_long_sentence_go_at_every_offset(spark):
    passage = plain_words(60, 51)
    docs = [(0, plain_words(61, 23) + " " + passage + " " + plain_words(62, 20) + ".")]
    docs += [(k + 1, f"{plain_words(100 + k, k)} {passage} {plain_words(200 + k, 30)}.".strip()) for k in range(40)]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), report=True).collect()}
    assert got[0]["text"] == docs[0][1]
    for k in range(40):
        r = got[k + 1]
        assert substring_dedup.PIECE_WORDS <= r["n_removed_words"] <= 51 and passage not in r["text"]
        assert plain_words(200 + k, 30) in r["text"] and r["text"].startswith(plain_words(100 + k, k))


def test_passages_of_short_sentences_go(spark):
    short = ". ".join(plain_words(63, 60).split()) + "."
    docs = [(1, plain_words(64, 12) + ". " + short), (2, short + " " + plain_words(65, 12) + "."), (3, ". ".join(plain_words(66, 60).split()) + ".")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), report=True).collect()}
    assert got[1]["text"] == docs[0][1] and got[3]["text"] == docs[2][1]
    assert got[2]["text"] == plain_words(65, 12) + "." and got[2]["n_removed_words"] == 60
