"""Language ID by compression: each language has a raw-content dictionary, and the one that codes a text smallest wins.

A text is cut into blocks, each block is compressed by zstandard with each language's dictionary, and
the sizes are summed, so every part of a long text counts. A prediction whose margin over the next
language is narrow is marked as not accepted. A dictionary holds ``DICTIONARY_BLOCKS`` blocks, drawn from
anywhere in a bounded sample of training documents (``SAMPLE_CLASSES`` x ``CLASS_DOCS`` of each language).

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and not accepted; ties
go to the first language in code-point order; without any labelled document all are ``und``; with
one language all texts with a letter get it, score 1; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, small_batches

UNKNOWN = "und"
#: Bounds of the training sample: of a language's documents, dealt into hash classes, so many with the lowest hash of each.
SAMPLE_CLASSES, CLASS_DOCS = 40, 15
#: A dictionary has so many blocks of these documents at most, those of the lowest hash; a block has so many characters.
DICTIONARY_BLOCKS, BLOCK_CHARS = 512, 512
BLOCK_BYTES, LEVEL = 2048, 3
#: Least relative margin between the two smallest sizes.
LEAST_MARGIN = 0.01
#: Folds of the held-out split; fold 0 is never learnt from.
FOLDS = 5

_LETTER = regex.compile(r"\p{L}")


def fold(doc_id: str | Column) -> Column:
    """crc32 of the doc_id as text, modulo the folds; null for a null doc_id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % FOLDS


@dataclass
class LanguageModel:
    """Dictionaries by language; compressors are made where it is used."""

    dictionaries: dict[str, bytes]

    @cached_property
    def coders(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang in sorted(self.dictionaries):
            words = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)))
        return out

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries}

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """(bytes, language), smallest first."""
        data = text.lower().encode("utf-8", "surrogatepass")
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        return sorted((sum(len(coder.compress(b)) for b in blocks), lang) for lang, coder in self.coders)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); the score is the relative margin over the next language."""
        if text is None or not self.dictionaries or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        ranked = self.sizes(text)
        if len(ranked) == 1:
            return ranked[0][1], 1.0, True
        score = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], score, score >= LEAST_MARGIN


def learn(docs: DataFrame, classes: int = SAMPLE_CLASSES, class_docs: int = CLASS_DOCS, blocks: int = DICTIONARY_BLOCKS) -> LanguageModel:
    """Dictionaries from documents outside fold 0 that have a language, a text and a doc_id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    keyed = known.select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("key"))
    keyed = keyed.withColumn("class", F.pmod(F.col("key"), F.lit(classes)))
    # A limit for every class of every language holds before the shuffle, and no language meets in one task.
    place = F.row_number().over(Window.partitionBy("lang", "class").orderBy("key", "doc_id"))
    chosen = keyed.withColumn("place", place).where(F.col("place") <= class_docs).select("doc_id", "lang").distinct()
    # Of repeated rows of one document the least text counts. All blocks of a text have the same chance, wherever they stand.
    met = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(BLOCK_CHARS))
    cut = met.select("lang", "doc_id", "text", F.explode(starts).alias("start")).select(
        "lang", F.xxhash64("doc_id", "start").alias("key"), "doc_id", "start", F.substring("text", F.col("start") + 1, F.lit(BLOCK_CHARS)).alias("block")
    )
    # A block of every document comes before a second one of any, so that a dictionary is of many documents.
    cut = cut.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "doc_id").orderBy("key", "start")))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "key", "doc_id", "start"))
    parts: dict[str, list[bytes]] = {}
    for r in cut.withColumn("place", order).where(F.col("place") <= blocks).orderBy("lang", "place").toLocalIterator():
        parts.setdefault(r["lang"], []).append(r["block"].lower().encode("utf-8", "surrogatepass"))
    return LanguageModel({lang: b"\n".join(p).ljust(8, b" ") for lang, p in parts.items()})


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every row; only the text is looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "lang_pred": pa.array([x[0] for x in found], pa.string()),
                    "score": pa.array([x[1] for x in found], pa.float64()),
                    "accepted": pa.array([x[2] for x in found], pa.bool_()),
                }
            )

    marked = docs.select("doc_id", "text", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"))
    return marked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return identify(docs, learn(docs))
