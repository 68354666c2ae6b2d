"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 of a text's word shingles. To find all pairs within
``radius`` 3 bits, the 64 bits are cut into three blocks; a pair that differs has a differing bit in at
least one block, so with that block masked out the rest differs in two bits at most. Every distinct
fingerprint therefore emits, for each masked block, all variants of the rest within half of two bits;
both members of a pair meet at a variant midway. Fingerprints are shuffled on the variant. In each
bucket colliding pairs are verified on all 64 bits and joined in chains, so a bucket of m members yields
fewer than m links, never all pairs. Connected components of the links give the classes.

Defined cases: a null or wordless text has fingerprint 0, linked like any other; texts are read whole;
repeated rows share fingerprint and class; a null doc_id never names a class unless the class has no
other (then component_id is null); an empty table gives an empty result; extra columns are ignored by
reports and pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import components, shuffle_width, small_batches, staged

RADIUS = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCKS = ((0, 21), (21, 42), (42, 64))
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    h, k = xxhash.xxh64_intdigest, shingle
    if len(words) <= k:
        return h(b" ".join(words), 42)
    if k == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    n = len(grams)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        v = np.fromiter((h(g, 42) for g in grams[at : at + 4096]), np.uint64)
        ones += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint's bits as a signed long."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts become Python objects one at a time
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {id_type}, fp long")


def block_masks() -> list[tuple[np.uint64, np.ndarray]]:
    """For each block: the mask that clears it, and the flips (none or one bit) of what is left."""
    out = []
    for lo, hi in BLOCKS:
        gone = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        left = [b for b in range(64) if not lo <= b < hi]
        out.append((np.uint64(~gone & (2**64 - 1)), np.array([0] + [1 << b for b in left], np.uint64)))
    return out


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp) for each block and variant of every fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = block_masks()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
                u = fp.view(np.uint64)
                for k, (mask, flips) in enumerate(masks):
                    v = ((u & mask)[:, None] ^ flips[None, :]).ravel()
                    # the masked block is free to carry the block's number, so one long is the whole key
                    lo = BLOCKS[k][0]
                    v |= np.uint64(k + 1) << np.uint64(lo)
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(np.repeat(fp, len(flips)))], names=["variant", "fp"])

    return fps.select("fp").mapInArrow(work, "variant long, fp long")


def bucket_links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius`` bits in one bucket: a spanning forest of the true links.

    A breadth-first sweep: each member found takes with it all unfound members in reach, so every
    member is linked once at most and a bucket of near-equal members costs about its own length.
    """
    left, out = np.unique(fp), []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        x = queue.pop()
        near = np.bitwise_count(left ^ x) <= radius
        if near.any():
            out += [(int(x), int(y)) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough to connect every pair within ``radius``."""
    if radius > 3:
        raise ValueError("three blocks cover radius 3 at most")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by variant; a bucket that a batch may cut is held until it ends."""
        held_key, held_val = np.empty(0, np.int64), np.empty(0, np.uint64)
        found: set[tuple[int, int]] = set()

        def buckets(key: np.ndarray, val: np.ndarray) -> None:
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
            many = ends - starts > 1
            for s, e in zip(starts[many], ends[many]):
                found.update(bucket_links(val[s:e], radius))

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            val = np.concatenate([held_val, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            buckets(key[:last], val[:last])
            held_key, held_val = key[last:], val[last:]
            if len(found) > 100_000:
                yield out(found)
                found.clear()
        buckets(held_key, held_val)
        yield out(found)

    def out(found: set) -> pa.RecordBatch:
        pairs = np.array(sorted(found), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    # few bytes but many variants, so the fingerprints are spread over all partitions first
    made = variants(fps.select("fp").repartition(shuffle_width(fps.sparkSession)))
    return made.repartition("variant").sortWithinPartitions("variant").mapInArrow(work, "a long, b long").distinct()


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable."""
    with small_batches(docs.sparkSession):
        prints = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(distinct, radius))
    mine = distinct.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = mine.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = staged(mine.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def classes_report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """``docs`` with one document of each class, the smallest doc_id (one of its rows); all columns as they were.

    Three bits are few: prints over shingles of five words tell apart what three words still join (README), so
    three is the default. Rows without doc_id cannot be told apart and stay.
    """
    found = staged(classes(docs, radius, shingle), "decisions")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    often = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_often"))
    if often.isEmpty():
        return left
    single = left.join(often, left.doc_id == often._often, "left_anti")
    return single.unionByName(left.join(often, left.doc_id == often._often, "left_semi").dropDuplicates(["doc_id"]))
