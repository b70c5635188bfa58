"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Document frequencies of the hashed five-word shingles are counted over all documents, in
   ``DF_BUCKETS`` buckets, and give every shingle a bounded, size-independent IDF.
2. Each text gets ``BANDS`` x ``ROWS`` ICWS samples of its TF-IDF weighted shingles; texts that share a band
   are candidates. Equal texts are one text from here on.
3. Candidates are verified by the exact weighted Jaccard similarity of their shingles. In a bucket of up to
   ``FIRST_HEADS`` + 1 texts all pairs are; in a larger one every text meets its ``FIRST_HEADS`` most central texts,
   and what is in another class than one of its further heads after that meets that one also. So a large group
   of copies costs a bounded number of pairs for each of its texts, and is one class, or nearly. Where a bucket holds
   several classes still, all pairs of them are held against each other, block by block: no link of a bucket is lost.
4. Classes are the connected components of verified links; the class id is its lowest doc_id.

Defined cases: null and empty texts, and texts without a word, are near duplicates of equal texts
only; texts of one to four words are one shingle; ties go to the lowest doc_id, null first, then the
text; rows that repeat a (doc_id, text) pair share a class; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialise, small_batches, unused
from tidemark.llm.textvec import Words, chunks, distinct, int64, seeded, splitmix

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band once in 1300 times, one of 0.85 once in 13000.
BANDS, ROWS = 10, 3
#: Buckets of the document frequencies: what a bucket's other shingles add is a fixed share of the documents.
DF_BUCKETS = 1 << 18
DF_BLOCK = 1 << 12
#: Documents per shingle from which it counts as rare: IDF = 1 + ln((1 + R) / (1 + R df / n)), from 1 to 1 + ln(1 + R).
RARITY = 4.0
#: Representatives of a bucket that all its texts meet, and all that those of other classes meet.
FIRST_HEADS, HEADS = 4, 16
#: Parts of a bucket that its heads are chosen from first.
HEAD_SALTS = 32
#: Texts, and bytes of their shingles, of a block on average, and shingles that two blocks are compared by at once.
BLOCK_TEXTS, BLOCK_BYTES, BLOCK_SHINGLES = 256, 1 << 22, 1 << 13


def text_shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, their counts, and offsets."""
    return distinct(*Words(data, off).shingles(SHINGLE_WORDS))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % DF_BUCKETS


def idf_table(docs: DataFrame) -> np.ndarray:
    """IDF by bucket, from document frequencies over all rows of ``docs``; its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, off in chunks(batch.column("text")):
                hashes, _, at = text_shingles(data, off)
                # Two shingles of one text in one bucket count once.
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                seen = np.unique(owner * DF_BUCKETS + _bucket(hashes)) % DF_BUCKETS
                total += np.bincount(seen, minlength=DF_BUCKETS)
        if n:
            used = np.flatnonzero(total.reshape(-1, DF_BLOCK).any(axis=1))
            blocks = [total[b * DF_BLOCK : (b + 1) * DF_BLOCK].astype("<i8").tobytes() for b in used]
            yield pa.record_batch({"block": pa.array([*used, -1], pa.int32()), "counts": pa.array([*blocks, np.int64(n).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(counts, "<i8")
                sums[block] = sums[block] + counts if block in sums else counts
        if sums:
            yield pa.record_batch({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "block int, counts binary"
    # One partial row of a block for each task; they meet block by block, streamed and never held together.
    parts = docs.select("text").mapInArrow(count, schema).repartition(DF_BUCKETS // DF_BLOCK, "block").mapInArrow(add, schema)
    df, n = np.zeros(DF_BUCKETS, np.int64), 0
    for row in parts.collect():
        counts = np.frombuffer(bytes(row["counts"]), "<i8")
        if row["block"] < 0:
            n += int(counts[0])
        else:
            df[row["block"] * DF_BLOCK : (row["block"] + 1) * DF_BLOCK] += counts
    return (1 + np.log((1 + RARITY) / (1 + RARITY * df / max(n, 1)))).astype(np.float32)


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[_bucket(hashes)]


def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2^16 values each of a Gamma(2, 1) variable and of the logarithm of one, in a fixed random order."""
    size = 1 << 16
    u = (np.argsort(seeded(4 * size, 31).reshape(4, size), axis=1) + 0.5) / size
    return (-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32), (seeded(size, 32) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


_tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def samples(hashes: np.ndarray, weight: np.ndarray, off: np.ndarray, n_samples: int = BANDS * ROWS) -> np.ndarray:
    """ICWS samples of texts with a shingle at least: an array (texts, samples) of 64-bit (shingle, level) names.

    For shingle k with weight w, r, c ~ Gamma(2, 1) and b ~ U(0, 1) follow from its hash: level t =
    floor(ln w / r + b), ln a = ln c - r (t - b + 1), and the sample is the (k, t) of least ln a.
    """
    if not _tables:
        _tables.append(_quantiles())
    gamma, log_gamma, uniform = _tables[0]
    log_w = np.log(weight).astype(np.float32)
    counts = np.diff(off)
    out = np.zeros((len(counts), n_samples), np.uint64)
    mask = np.uint64(0xFFFF)
    for j, seed in enumerate(seeded(n_samples, 33)):
        bits = (hashes ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        bits ^= bits >> np.uint64(29)
        bits *= np.uint64(0x94D049BB133111EB)
        r = gamma[(bits >> np.uint64(48)).astype(np.int64)]
        b = uniform[((bits >> np.uint64(32)) & mask).astype(np.int64)]
        t = np.floor(log_w / r + b)
        score = log_gamma[((bits >> np.uint64(16)) & mask).astype(np.int64)] - r * (t - b + 1)
        least = np.minimum.reduceat(score, off[:-1])
        at = np.flatnonzero(score == np.repeat(least, counts))
        # Of equal scores the first: shingles are in order of their hashes.
        first = at[np.searchsorted(at, off[:-1])]
        out[:, j] = splitmix(hashes[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def band_keys(data: np.ndarray, off: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have a shingle, their band hashes)."""
    hashes, counts, at = text_shingles(data, off)
    some = np.flatnonzero(np.diff(at) > 0)
    if not len(some):
        return some, np.zeros((0, BANDS), np.uint64)
    keys = samples(hashes, weights(hashes, counts, idf), np.append(at[some], len(hashes)))
    out = np.zeros((len(some), BANDS), np.uint64)
    for band, seed in enumerate(seeded(BANDS, 34)):
        key = np.full(len(some), seed)
        for k in range(ROWS):
            key = splitmix(key + keys[:, band * ROWS + k])
        out[:, band] = key
    return some, out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending hashes, weights)."""
    at = np.searchsorted(a[0], b[0])
    met = (at < len(a[0])) & (a[0][np.minimum(at, len(a[0]) - 1)] == b[0])
    shared = float(np.minimum(a[1][at[met]], b[1][met]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def bags(texts: DataFrame) -> DataFrame:
    """node and the shingles of its text: ascending hashes, and their counts where one is over 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in chunks(batch.column("text")):
                hashes, counts, at = text_shingles(data, off)
                own = [slice(at[i], at[i + 1]) for i in range(end - first)]
                many = [counts[x].astype("<u4").tobytes() if (counts[x] > 1).any() else b"" for x in own]
                nodes = batch.column("node").slice(first, end - first)
                yield pa.record_batch({"node": nodes, "hashes": pa.array([hashes[x].astype("<u8").tobytes() for x in own], pa.binary()), "counts": pa.array(many, pa.binary())})

    return texts.select("node", "text").mapInArrow(run, "node binary, hashes binary, counts binary")


def verified(pairs: DataFrame, shingles: DataFrame, idf, least: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that are similar, with their similarity. ``shingles``: see ``bags``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value

        def bag(found: bytes, many: bytes) -> tuple:
            hashes = np.frombuffer(found, "<u8")
            return hashes, weights(hashes, np.frombuffer(many, "<u4") if many else np.ones(len(hashes), np.float32), table)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("hashes_a", "counts_a", "hashes_b", "counts_b")), strict=True)
            found = [similarity(bag(ha, ca), bag(hb, cb)) for ha, ca, hb, cb in rows]
            keep = pa.array([s >= least for s in found], pa.bool_())
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(found, pa.float64())}).filter(keep)

    side = lambda x: shingles.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}"), F.col("counts").alias(f"counts_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of ``links`` (a, b).

    Labels fall to the least of the neighbours' and then to that label's own label, so a chain halves with every round.
    """
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.select("node", "root").join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("next"), "root")
        labels = materialise(new.select("node", F.col("next").alias("root"), F.col("root").alias("old")), "labels", labels)
        if labels.where("old <> root").isEmpty():
            return labels.select("node", "root")


def _node(doc_id: str, key: str) -> Column:
    """One binary name of a (doc_id, key) that sorts as the pair does, null before all numbers."""
    number = F.unhex(F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.coalesce(F.concat(F.lit(b"\x01"), number), F.lit(bytes(9))), F.col(key))


def _doc_of(node: Column) -> Column:
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.substring(node, 1, 1) == F.lit(b"\x01"), number)


def _heads(full: DataFrame) -> DataFrame:
    """The ``HEADS`` most central texts of every bucket of ``full`` (node, band, bucket, size): band, bucket, place, head.

    Central is a text whose buckets hold the most texts: in a group of copies, those that most others are near to.
    They only spare pairs inside a class: a bucket that they leave in several classes is compared whole by ``rest``.
    """
    central = full.groupBy("node").agg(F.sum("size").alias("weight"))
    order = [F.desc("weight"), F.xxhash64("node"), F.col("node")]
    found = full.join(central, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(HEAD_SALTS)))
    # The best of each part of a bucket come first, so that no task meets a large bucket whole.
    for by in (("band", "bucket", "salt"), ("band", "bucket")):
        found = found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= HEADS)
    return found.select("band", "bucket", "place", F.col("node").alias("head"))


def _pairs(of: DataFrame, heads: Column) -> DataFrame:
    """Distinct (a, b) of each node of ``of`` with its ``heads``."""
    met = of.select("node", F.explode(heads).alias("head")).where("head <> node")
    return met.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each text of ``left`` with each of ``right``, in single precision.

    ``bags``: (ascending hashes, counts). A shingle that a text holds n times counts as n shingles of one weight, so
    that a sum of lesser weights is a product of matrices. A shingle of one text alone adds to no such sum.
    """
    hashes = np.concatenate([h for h, _ in bags])
    counts = np.concatenate([c for _, c in bags]).astype(np.int64)
    owner = np.repeat(np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags]), counts)
    weight = np.repeat(idf[_bucket(hashes)], counts)
    total = np.bincount(owner, weight, len(bags))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    names = np.repeat(hashes, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, column, times = np.unique(names, return_inverse=True, return_counts=True)
    column_of = np.cumsum(times > 1) - 1
    some = np.flatnonzero(times[column] > 1)
    some = some[np.argsort(column[some], kind="stable")]
    column, owner, root = column_of[column[some]], owner[some], np.sqrt(weight[some])
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_SHINGLES):
        own = slice(*np.searchsorted(column, [low, low + BLOCK_SHINGLES]))
        matrix = np.zeros((len(bags), BLOCK_SHINGLES), np.float32)
        matrix[owner[own], column[own] - low] = root[own]
        shared += matrix[left] @ matrix[right].T
    return shared / (total[left][:, None] + total[right][None, :] - shared)


def rest(full: DataFrame, roots: DataFrame, shingles: DataFrame, idf) -> DataFrame:
    """All links (a, b) between texts of one bucket that are in different classes still: the exact way for what heads leave.

    A bucket's texts outside of its largest class are dealt into blocks, and all its texts are; each two blocks meet in
    one task, which compares every pair of different classes.
    """

    def compare(group: pa.Table) -> pa.Table:
        node, root, minor = (group.column(c).to_pylist() for c in ("node", "root", "minor"))
        bags = []
        for found, many in zip(group.column("hashes").to_pylist(), group.column("counts").to_pylist(), strict=True):
            hashes = np.frombuffer(found, "<u8")
            bags.append((hashes, np.frombuffer(many, "<u4") if many else np.ones(len(hashes), np.uint32)))
        left = np.flatnonzero(np.array(minor))
        right = np.flatnonzero(~np.array(minor)) if len(left) else np.arange(len(node))
        left = left if len(left) else right
        _, number = np.unique(np.array(root, object), return_inverse=True)
        # What rounding could hide is held against the limit again, exactly.
        near = (overlaps(bags, left, right, idf.value) >= SIMILARITY - 1e-4) & (number[left][:, None] != number[right][None, :])
        bag = lambda i: (bags[i][0], weights(*bags[i], idf.value))
        found = {tuple(sorted((node[left[i]], node[right[j]]))) for i, j in zip(*np.nonzero(near), strict=True) if similarity(bag(left[i]), bag(right[j])) >= SIMILARITY}
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    bytes_of = shingles.select("node", F.length("hashes").alias("bytes"))
    own = full.where(F.col("size") > FIRST_HEADS + 1).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(bytes_of, "node")
    own = materialise(own.select("node", "band", "bucket", "root", "bytes"), "own")
    each = own.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max(F.struct("n", "root", "bytes"))
    mixed = each.groupBy("band", "bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes"), most.alias("most")).where("classes > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_TEXTS, size / BLOCK_BYTES, F.lit(1.0))).cast("int")
    n, size = F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")
    mixed = materialise(mixed.select("band", "bucket", F.col("most.root").alias("largest"), blocks(F.col("n"), F.col("bytes")).alias("all"), blocks(n, size).alias("minors")), "mixed")
    dealt = materialise(own.drop("bytes").join(mixed, ["band", "bucket"]), "dealt")
    at = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    others = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    keep = ["node", "root", "band", "bucket"]
    whole = dealt.select(*keep, at("all").alias("i"), others("minors").alias("j"), F.lit(False).alias("minor"))
    # A bucket of one block meets itself.
    minors = dealt.where("root <> largest and `all` > 1").select(*keep, others("all").alias("i"), at("minors").alias("j"), F.lit(True).alias("minor"))
    met = whole.union(minors).join(shingles, "node")
    return materialise(met.groupBy("band", "bucket", "i", "j").applyInArrow(compare, "a binary, b binary").distinct(), "links")


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links."""
    if more.isEmpty():
        return roots
    # Classes are the nodes now: their own links are few.
    ends = [more.select(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    named = ends[0].join(roots, "node", "left").select(F.coalesce("root", "node").alias("a"), F.col("other").alias("node"))
    joined = components(named.join(roots, "node", "left").select("a", F.coalesce("root", "node").alias("b")))
    every = roots.select("node", "root").union(ends[0].select("node", F.col("node").alias("root")).union(ends[1].select("node", F.col("node").alias("root"))))
    every = every.groupBy("node").agg(F.min("root").alias("root"))
    step = joined.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return materialise(every.join(step, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "roots")


def classes(docs: DataFrame) -> DataFrame:
    """A row for each distinct (doc_id, text): doc_id, key of the text, class_id, class_key and representative.

    ``representative`` marks the one document of a class that stays: the lowest doc_id, of its texts the least key.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    # A text's key: 128 bits of its content, a null text one of its own.
    key = F.coalesce(F.unhex(F.md5("text")), F.lit(b""))
    idf = spark.sparkContext.broadcast(idf_table(docs))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[list[int] | None] = [None] * batch.num_rows
            for first, _, data, off in chunks(batch.column("text")):
                some, found = band_keys(data, off, idf.value)
                for i, row in zip(some.tolist(), found.view(np.int64).tolist(), strict=True):
                    keys[first + i] = row
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "bands": pa.array(keys, pa.list_(pa.int64()))})

    signed = docs.select("doc_id", "text", key.alias("key")).mapInArrow(bands, "doc_id long, key binary, bands array<long>")
    members = materialise(signed.groupBy("doc_id", "key").agg(F.first("bands").alias("bands")), "members")
    # A text goes by its first document from here on.
    texts = members.groupBy("key").agg(F.min(_node("doc_id", "key")).alias("node"), F.first("bands").alias("bands"))
    buckets = texts.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    full = materialise(buckets.join(shared, ["band", "bucket"]), "buckets")
    heads = materialise(_heads(full), "heads")
    # Texts of candidates only; the rest need not be read again.
    wanted = full.select("node").distinct().select("node", F.substring("node", 10, 16).alias("key"))
    candidates = docs.select(key.alias("key"), "text").join(wanted, "key").groupBy("node").agg(F.first("text").alias("text"))
    shingles = materialise(bags(candidates), "bags")
    # Written, as is all that meets the buckets: a large bucket can be split where both sides are shuffled for the join alone.
    listed = materialise(heads.where(F.col("place") <= FIRST_HEADS).groupBy("band", "bucket").agg(F.collect_list("head").alias("heads")), "heads")
    links = materialise(verified(_pairs(full.join(listed, ["band", "bucket"]), F.col("heads")), shingles, idf), "links")
    roots = components(links)
    # Where a bucket's texts fall into several classes still, they meet its other heads of other classes.
    known = roots.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    others = heads.where(F.col("place") > FIRST_HEADS).join(known, "head", "left").select("band", "bucket", F.struct("head", F.coalesce("head_root", "head").alias("root")).alias("head"))
    listed = materialise(others.groupBy("band", "bucket").agg(F.collect_list("head").alias("heads")), "heads")
    open_ = full.where(F.col("size") > FIRST_HEADS).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(listed, ["band", "bucket"])
    apart = F.transform(F.filter("heads", lambda h: h["root"] != F.col("root")), lambda h: h["head"])
    more = materialise(verified(_pairs(open_, apart), shingles, idf), "links")
    roots = _merged(roots, more)
    roots = _merged(roots, rest(full, roots, shingles, idf))
    # Written before the join: both its sides are shuffled for it alone then, and a text of very many copies can be split.
    classed = materialise(texts.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "classed")
    return members.select("doc_id", "key").join(classed, "key").select(
        "doc_id", "key", _doc_of(F.col("root")).alias("class_id"), F.col("root").alias("class_key"), (_node("doc_id", "key") == F.col("root")).alias("representative")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and representative for every row of ``docs``."""
    docs = docs.select("doc_id", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("text_key"), "text")
    found = classes(docs).withColumnRenamed("doc_id", "class_doc")
    met = docs.drop("text").join(found, docs["doc_id"].eqNullSafe(found["class_doc"]) & (docs["text_key"] == found["key"]))
    return met.select("doc_id", "class_id", "representative")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all the columns of ``docs``; of repeated rows one stays."""
    doc, key = unused(docs, "kept_doc", "kept_key")
    kept = classes(docs).where("representative").select(F.col("doc_id").alias(doc), F.col("key").alias(key))
    own = docs.withColumn(key, F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    met = own.join(kept, own["doc_id"].eqNullSafe(kept[doc]) & (own[key] == kept[key]), "left_semi")
    # Rows that repeat a document partly combine before the shuffle, and the join has dealt them by these columns already.
    rest = [c for c in docs.columns if c != "doc_id"]
    one = met.groupBy("doc_id", key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("row"))
    return one.select(*["doc_id" if c == "doc_id" else F.col(f"row.`{c}`") for c in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
