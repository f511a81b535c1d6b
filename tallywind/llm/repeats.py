"""Removal of long byte strings that start anywhere else, by refining the merged suffix order.

All suffixes of all texts, in order, fall into blocks that share a prefix; two shards' orders
are merged by refining the blocks of their interleave until a block holds one suffix, or its
common prefix is as long as asked for. Only the blocks matter here, not the order inside them,
and a block is named by a hash of what its suffixes share, so refining a block is a grouped
count that Spark combines shard by shard, and no suffix is sorted again.

One byte a step would take as many passes as the shortest string asked for (400), over every
suffix. Instead
* the suffixes that start a window of 400 bytes are bundled by the window's anchor, its least
  hashed 16 bytes: windows with the same anchor at the same offset are one record. Equal windows
  have equal anchors, so a block of the first step is an anchor, and a record whose anchor no
  other record has is settled: none of its windows is repeated;
* a step extends what a block shares to both sides, by splitting the windows of a record into
  ranges of offsets (64, then 8, then 1): all windows of a range share the bytes between them;
* records that agree on all the bytes they cover are repeated as a whole. Of them one goes on
  and stands for all, so thousands of copies are one record in the next step.
After the last step a block with two members is a repeated window, and the bytes that repeated
windows cover are removed. Hashes of 128 bits stand for byte strings.

Defined cases: null text is empty; texts shorter than the length have no window; rows are texts
of their own even if they share a doc_id (repeated rows repeat one another); rows with null
doc_id take part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, store, text_of

LENGTH = 400
ANCHOR = 16
STEPS = (64, 8, 1)
_SEGMENT = 1 << 21
_TEXT = ["doc_id", "text_hash"]


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    n = len(data) - ANCHOR + 1
    words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    x = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8:8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[width - 1:width - 1 + n])


def records(data: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, its hash, first and last window) of the runs of windows with one anchor; of
    equal hashes in a window the leftmost counts."""
    held = None
    for at in range(0, len(data) - length + 1, _SEGMENT):
        part = np.ascontiguousarray(data[at:at + _SEGMENT + length - 1])
        h = _kmer_hashes(part)
        keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_least(keyed, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.diff(anchor)) + 1
        firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges - 1, [len(anchor) - 1]])
        found = anchor[firsts]
        for a, key, lo, hi in zip((found + at).tolist(), h[found].view(np.int64).tolist(), (firsts + at).tolist(), (lasts + at).tolist()):
            if held and held[0] == a:
                held = (a, key, held[2], hi)
            else:
                if held:
                    yield held
                held = (a, key, lo, hi)
    if held:
        yield held


def _both(digests: list[bytes]) -> list[pa.Array]:
    pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(pair[:, 0]), pa.array(pair[:, 1])]


def _first(length: int):
    """Records of whole texts: the least and largest offset of their windows before the anchor,
    the block (the anchor's hash) and the hash of all bytes the windows cover."""
    names = ["doc_id", "text_hash", "anchor", "lo", "hi", "block", "cover_1", "cover_2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            digests: list[bytes] = []

            def out():
                cols = list(zip(*rows))
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + _both(digests), names=names)

            for doc, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                for a, key, first, last in records(np.frombuffer(raw, np.uint8), length):
                    rows.append((doc, text_hash, a, a - last, a - first, key))
                    digests.append(xxhash.xxh3_128_digest(raw[first:last + length]))
                if len(rows) > 100_000:
                    yield out()
                    rows, digests = [], []
            if rows:
                yield out()

    return run


def _fetch(length: int):
    """The bytes that the records in ``open`` cover, from their texts."""
    names = ["doc_id", "text_hash", "anchor", "lo", "hi", "done", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, text, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(doc, text_hash, r["anchor"], r["lo"], r["hi"], r["done"], raw[r["anchor"] - r["hi"]:r["anchor"] - r["lo"] + length]) for r in found]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 20_000]), kinds)], names=names)

    return run


def _split(size: int, coarse: int, length: int):
    """Records split into ranges of ``size`` offsets: for each the block (what all windows of
    the whole range share) and the hash of what the record's own windows there cover.
    ``parts`` are the ranges of ``coarse`` offsets that are still open."""
    names = ["doc_id", "text_hash", "anchor", "part", "lo", "hi", "done", "block", "cover_1", "cover_2"]
    most = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            blocks: list[int] = []
            covers: list[bytes] = []
            for doc, text_hash, a, lo, hi, raw, parts in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for p in parts:
                    for part in range(p["part"] * coarse // size, (p["part"] + 1) * coarse // size):
                        u, v = part * size, min(part * size + size - 1, most)
                        first, last = max(lo, u), min(hi, v)
                        if first > last:
                            continue
                        rows.append((doc, text_hash, a, part, first, last, p["done"]))
                        blocks.append(xxhash.xxh3_64_intdigest(raw[hi - u:hi - v + length], seed=part) - (1 << 63))
                        covers.append(xxhash.xxh3_128_digest(raw[hi - last:hi - first + length]))
            kinds = [pa.int64()] * 6 + [pa.bool_()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + [pa.array(blocks, pa.int64())] + _both(covers), names=names)

    return run


def _settle(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` of blocks with several members, with ``n`` (records that cover the same bytes)
    and ``kinds`` (different covers in the block). Counts are combined before they are shuffled;
    rows that nothing else resembles leave here."""
    same = rows.groupBy("block", "cover_1", "cover_2", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    same = store(same, f"repeats-{label}-same")
    kinds = same.groupBy("block").agg(F.count(F.lit(1)).alias("kinds"))
    busy = same.join(kinds, "block").filter("n > 1 OR kinds > 1")
    return store(rows.join(store(busy, f"repeats-{label}-busy"), ["block", "cover_1", "cover_2", "lo", "hi"]), f"repeats-{label}")


def _go_on(settled: DataFrame, extra: list[str]) -> DataFrame:
    """The records a block goes on with: one per cover, done if its windows are known to repeat."""
    mixed = settled.filter("kinds > 1").withColumn("done", F.col("done") | (F.col("n") > 1))
    alone = mixed.filter("n = 1").select(*_TEXT, "anchor", "lo", "hi", "done", *extra)
    keys = ["block", "cover_1", "cover_2", "lo", "hi"]
    several = mixed.filter("n > 1").dropDuplicates(keys).select(*_TEXT, "anchor", "lo", "hi", "done", *extra)
    return alone.unionByName(several)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, first, last): ranges of starts of the windows of ``length`` bytes
    that start anywhere else too. ``text_hash`` is Spark's xxhash64 of the text."""
    ship_by_value(__name__)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = "doc_id long, text_hash long, anchor long, lo long, hi long, block long, cover_1 long, cover_2 long"
    rows = store(texts.filter(F.octet_length(text_of()) >= length).mapInArrow(_first(length), kind), "repeats-records").withColumn("done", F.lit(False))
    settled = _settle(rows, "anchors")
    starts = lambda s: s.filter("n > 1 AND NOT done").select(*_TEXT, (F.col("anchor") - F.col("hi")).alias("first"), (F.col("anchor") - F.col("lo")).alias("last"))
    found = starts(settled)
    going = _go_on(settled, []).groupBy(*_TEXT).agg(F.collect_set(F.struct("anchor", "lo", "hi", "done")).alias("found"))
    going = store(going, "repeats-open").withColumnsRenamed({c: f"of_{c}" for c in _TEXT})
    here = texts.join(going, F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("text_hash").eqNullSafe(F.col("of_text_hash")))
    here = here.dropDuplicates(_TEXT).select(*_TEXT, "text", "found")
    held = store(here.mapInArrow(_fetch(length), "doc_id long, text_hash long, anchor long, lo long, hi long, done boolean, bytes binary"), "repeats-bytes")
    held = held.withColumn("parts", F.array(F.struct(F.lit(0).cast("long").alias("part"), "done")))
    coarse = 1 << (length - 1).bit_length()
    for size in STEPS:
        kind = "doc_id long, text_hash long, anchor long, part long, lo long, hi long, done boolean, block long, cover_1 long, cover_2 long"
        rows = held.select(*_TEXT, "anchor", "lo", "hi", "bytes", "parts").mapInArrow(_split(size, coarse, length), kind)
        settled = _settle(store(rows, f"repeats-rows-{size}"), f"blocks-{size}")
        known = settled.withColumn("n", F.when(F.col("done"), 0).otherwise(F.col("n")))
        found = found.unionByName(starts(known))
        if size == 1:
            break
        going = _go_on(settled, ["part"]).groupBy(*_TEXT, "anchor").agg(F.collect_set(F.struct("part", "done")).alias("parts"))
        going = store(going, f"repeats-open-{size}").withColumnsRenamed({c: f"of_{c}" for c in (*_TEXT, "anchor")})
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*_TEXT, "anchor")]
        held = store(held.drop("parts", "done").join(going, same[0] & same[1] & same[2]).select(*_TEXT, "anchor", "lo", "hi", "bytes", "parts"), f"repeats-bytes-{size}")
        coarse = size
    return found


def _cut(length: int):
    names = ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for r in sorted(((r["first"], r["last"]) for r in found or ())):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1] + length)
                    else:
                        spans.append([r[0], r[1] + length])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((doc, b"".join(kept), len(raw), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), span]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, kept (the bytes left; a cut may fall inside a character), n_bytes,
    n_removed, n_spans and spans (the runs removed, start and end in bytes)."""
    found = repeated_windows(docs, length).groupBy(*_TEXT).agg(F.collect_set(F.struct("first", "last")).alias("found"))
    found = store(found, "repeats-found").withColumnsRenamed({c: f"of_{c}" for c in _TEXT})
    rows = docs.select("doc_id", "text").join(
        found, F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.xxhash64("text") == F.col("of_text_hash")), "left")
    kind = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>"
    return rows.select("doc_id", "text", "found").mapInArrow(_cut(length), kind.replace("kept", "text")).withColumnRenamed("text", "kept")


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the SHA-256 of the bytes kept, and the text they make
    (half a character at a cut becomes the replacement character)."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                          F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
