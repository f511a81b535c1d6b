"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts with the same set are one class, represented by its
smallest doc_id; only representatives are joined. Representatives that agree on a band of
MinHash values are candidates. Of a candidate pair the MinHash values are compared a block at a
time, and it is dropped as soon as the posterior probability that its similarity reaches the
threshold (uniform prior, so a beta posterior) falls below the tolerance. Pairs that are left
are verified on their shingle sets.

No bucket is expanded into all its pairs: its members meet the bucket's smallest member, and
the links found are contracted to components, so a group of thousands of near copies costs a
star. Buckets that then still hold several components are compared across components: small ones
as rows, larger ones in blocks of members that are compared and verified inside a task, which
hands on links alone. So every candidate pair is either compared or within one
component already, which settles the classes.

Links are counted when the classes stand: the representatives of a class are cut into blocks,
and every two blocks meet in a task, which compares all their shingle sets and hands on a number
per representative. No pair leaves the task.

Defined cases: words are separated by blanks, tabs and line breaks and compared as they are; a
text of one to four words is one shingle; null and empty texts and rows with null doc_id take
no part; of rows with one doc_id and several texts, one text counts; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.operators.ranking import with_position

from .common import WORD, ship_by_value, store, text_of
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares one of 32 bands of 6 values but for 6 in 100,000 cases.
BANDS, ROWS = 32, 6
#: Posterior probability below which a candidate is dropped.
TOLERANCE = 1e-6
#: Buckets of more members are compared in blocks.
FEW, BLOCK_MEMBERS = 8, 1024
#: To count links, a class is cut into at most MEETING blocks of COUNT_MEMBERS representatives, then
#: into blocks of BLOCK_MEMBERS; and so that a block has about COUNT_SHINGLES shingles.
COUNT_MEMBERS, MEETING, COUNT_SHINGLES = 128, 12, 1_000_000
_BLOCK = 32
_CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts, as sorted distinct 64-bit hashes, for many texts at a time."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, _CHUNK_BYTES)
            one = np.ones(1, np.uint64)
            self.powers = np.cumprod(np.concatenate([one, np.full(n, _BASE)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([one, np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Of the UTF-8 texts that ``offsets`` cuts ``data`` into."""
        n = len(data)
        self._grow(n + 1)
        blank = _SPACE[data]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        before = np.concatenate([[True], blank[:-1]]) if n else np.zeros(0, bool)
        after = np.concatenate([blank[1:], [True]]) if n else np.zeros(0, bool)
        starts = np.flatnonzero(~blank & (before | border[:-1]))
        ends = np.flatnonzero(~blank & (after | border[1:])) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * self.powers[:n] + self.powers[:n], dtype=np.uint64)])
        words = _mix((sums[ends] - sums[starts]) * self.inverse[starts])
        m = max(0, len(words) - SHINGLE + 1)
        grams = np.zeros(m, np.uint64)
        for j in range(SHINGLE):
            grams += words[j:j + m] * _STEP[j]
        grams = _mix(grams)
        bounds = np.searchsorted(starts, offsets)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                yield np.unique(grams[a:b - SHINGLE + 1])
            elif b > a:
                yield _mix(np.array([(words[a:b] * _STEP[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)

    def of_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Of a column of strings, a few megabytes at a time."""
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK_BYTES, "right")) - 1)
            yield from self.sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            a = b


class Minhash:
    def __init__(self, n: int = BANDS * ROWS) -> None:
        rng = np.random.default_rng(7)
        self.a = rng.integers(1, 1 << 63, n, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)[:, None]
        self.room = np.empty((n, 256), np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 256):
            part = x[None, i:i + 256]
            room = self.room[:, :part.shape[1]]
            np.multiply(self.a, part, out=room)
            room += self.b
            np.minimum(least, room.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


_BAND_SALT = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_BAND_STEP = np.array([pow(0xA0761D6478BD642F, i + 1, 1 << 64) | 1 for i in range(ROWS)], np.uint64)


def _band_keys(sign: np.ndarray) -> np.ndarray:
    """A key for each band of a signature."""
    return _mix((sign.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_STEP).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, minhash = Shingler(), Minhash()
    for batch in batches:
        keys, sizes, signs, bands = [], [], [], []
        for x in shingler.of_column(batch.column(1)):
            keys.append(xxhash.xxh3_128_digest(x.tobytes()))
            sizes.append(len(x))
            s = minhash(x)
            signs.append(s.tobytes())
            bands.append(_band_keys(s))
        n = len(sizes)
        if n:
            flat = pa.array(np.concatenate(bands))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), flat)],
                names=["doc_id", "text_hash", "key", "size", "sign", "bands"])


def least_matches(threshold: float, tolerance: float, n: int, block: int) -> list[int]:
    """For each number of values compared (a block, two, ...), the least number of equal ones
    for which P(similarity >= threshold) reaches the tolerance: with a uniform prior that is
    P(Binomial(compared + 1, threshold) <= equal)."""
    out = []
    for seen in range(block, n + 1, block):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(seen + 1, m) * threshold ** m * (1 - threshold) ** (seen + 1 - m)
        out.append(m)
    return out


def _prune(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance, BANDS * ROWS, _BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (_signs(pdf[c]) for c in ("sign_a", "sign_b"))
                i = np.arange(len(pdf))
                yield pdf.iloc[_alive(a, b, i, i, pdf["size_a"].to_numpy(), pdf["size_b"].to_numpy(), threshold, needed)[0]][["a", "b"]]

    return run


def _signs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), -1)


def _alive(a, b, i, j, size_a, size_b, threshold: float, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (row i of a, row j of b) those that no block of values rules out."""
    fits = np.minimum(size_a[i], size_b[j]) >= threshold * np.maximum(size_a[i], size_b[j]) - 1e-9
    i, j = i[fits], j[fits]
    equal = np.zeros(len(i), np.int64)
    for n, least in enumerate(needed):
        part = slice(n * _BLOCK, (n + 1) * _BLOCK)
        equal += (a[i, part] == b[j, part]).sum(axis=1)
        kept = equal >= least
        i, j, equal = i[kept], j[kept], equal[kept]
    return i, j


def _link_blocks(threshold: float, tolerance: float):
    """Links across the components of a bucket, of two of its blocks: what the signatures leave
    is verified here, in the first band its two members share, so that no pair leaves the task
    but as a link."""
    needed = least_matches(threshold, tolerance, BANDS * ROWS, _BLOCK)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["left"]], pdf[pdf["right"]])
        a, b = _signs(left["sign"]), _signs(right["sign"])
        (rep_a, size_a, comp_a), (rep_b, size_b, comp_b) = ((x["rep"].to_numpy(), x["size"].to_numpy(), x["component"].to_numpy()) for x in (left, right))
        two_blocks = not pdf["left"].iloc[0] or not pdf["right"].iloc[0]
        band = int(np.flatnonzero(_band_keys(_signs(pdf["sign"].iloc[:1])[0]) == pdf["bucket"].iloc[0])[0])
        out = []
        step = max(1, 100_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = np.nonzero((comp_a[at:at + step, None] != comp_b[None, :]) & (two_blocks | (rep_a[at:at + step, None] < rep_b[None, :])))
            i, j = _alive(a, b, i + at, j, size_a, size_b, threshold, needed)
            first = (a[i] == b[j]).reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            i, j = i[first], j[first]
            sets_a, sets_b = (_sets_of(x["text"], np.unique(k)) for x, k in ((left, i), (right, j)))
            for x, y in zip(i.tolist(), j.tolist()):
                like = _jaccard(sets_a[x], sets_b[y])
                if like >= threshold - 1e-12:
                    out.append((min(rep_a[x], rep_b[y]), max(rep_a[x], rep_b[y]), like))
        return pd.DataFrame(out, columns=["a", "b", "jaccard"])

    return run


def _count_blocks(threshold: float):
    """For each representative of two blocks of a class, the texts of the other block (of its
    own, if the two are one) that are similar enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["left"]], pdf[pdf["right"]])
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "n_links": []}).astype("int64")
        one_block = bool(pdf["left"].iloc[0] and pdf["right"].iloc[0])
        sets_a, sets_b = ([x for x in Shingler().of_column(pa.array(p["text"], pa.string()))] for p in (left, right))
        order = np.argsort([len(x) for x in sets_b], kind="stable")
        sets_b = [sets_b[j] for j in order]
        sizes = np.array([len(x) for x in sets_b])
        names, flat = np.unique(np.concatenate(sets_b), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(names), np.int32)
        n_a, n_b = np.zeros(len(sets_a), np.int64), np.zeros(len(sets_b), np.int64)
        for i, x in enumerate(sets_a):
            lo = int(np.searchsorted(sizes, threshold * len(x) - 1e-9, "left"))
            hi = int(np.searchsorted(sizes, len(x) / threshold + 1e-9, "right"))
            if lo == hi:
                continue
            at = np.searchsorted(names, x)
            at = at[names[np.minimum(at, len(names) - 1)] == x]
            mark[at] = 1
            both = np.add.reduceat(mark[flat[starts[lo]:starts[hi - 1] + sizes[hi - 1]]], starts[lo:hi] - starts[lo])
            mark[at] = 0
            alike = both / (len(x) + sizes[lo:hi] - both) >= threshold - 1e-12
            n_a[i] = alike.sum() - one_block  # itself is among its own block
            n_b[lo:hi] += alike
        if one_block:
            return pd.DataFrame({"rep": left["rep"].to_numpy(), "n_links": n_a})
        return pd.DataFrame({"rep": np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()[order]]), "n_links": np.concatenate([n_a, n_b])})

    return run


def _sets_of(texts: pd.Series, rows: np.ndarray) -> dict[int, np.ndarray]:
    return dict(zip(rows.tolist(), Shingler().of_column(pa.array(texts.iloc[rows], pa.string()))))


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / max(1, len(x) + len(y) - both)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("text_a", "text_b"))
            like = np.array([_jaccard(x, y) for x, y in zip(shingler.of_column(a), shingler.of_column(b))])
            rows = np.flatnonzero(like >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(like[rows])],
                                             names=["a", "b", "jaccard"])

    return run


class _Join:
    """State of one join: the signatures and texts of the representatives that share a bucket.

    What is laid down once is joined by a shuffle at every size: the ids asked for grow with the
    documents, so a plan that broadcasts them while they are few would not last.
    """

    def __init__(self, docs: DataFrame, threshold: float, tolerance: float) -> None:
        ship_by_value(__name__)
        self.docs, self.threshold, self.tolerance = docs, threshold, tolerance
        rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash")).filter(text_of().rlike(WORD))
        self.signed = store(rows.mapInArrow(_sign, "doc_id long, text_hash long, key binary, size int, sign binary, bands array<long>"), "near-signed")
        one = self.signed.groupBy("doc_id").agg(F.min(F.struct("text_hash", "key")).alias("of")).select("doc_id", "of.text_hash", "of.key")
        reps = one.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        reps = reps.select("key", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"))
        self.member = store(one.join(reps, "key").select("doc_id", "rep", "rep_hash"), "near-members")
        self.reps = self.member.filter("doc_id = rep").select("rep", "rep_hash")

    def _of_reps(self, reps: DataFrame, *columns: str) -> DataFrame:
        same = (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
        return self.signed.select("doc_id", "text_hash", *columns).join(reps.hint("merge"), same).select("rep", *columns)

    def buckets(self) -> DataFrame:
        """(bucket, rep, lead, n) of the buckets with several representatives. Signatures and
        texts of those are laid down for the comparisons."""
        placed = self._of_reps(self.reps, "bands").select("rep", F.explode("bands").alias("bucket"))
        shared = placed.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"))
        members = store(placed.join(store(shared.filter("last > lead").drop("last"), "near-shared"), "bucket"), "near-buckets")
        reps = store(members.select("rep").distinct().join(self.reps, "rep"), "near-involved")
        self.signs = store(self._of_reps(reps, "size", "sign").dropDuplicates(["rep"]), "near-signs")
        texts = self.docs.select("doc_id", "text").join(reps.hint("merge"), F.col("doc_id") == F.col("rep")).filter(F.xxhash64("text") == F.col("rep_hash"))
        self.texts = store(texts.select("rep", "text").dropDuplicates(["rep"]), "near-texts")
        return members

    def survivors(self, pairs: DataFrame) -> DataFrame:
        """Of candidate ``pairs`` (a, b) those that their signatures do not rule out."""
        side = lambda c: self.signs.select(F.col("rep").alias(c), F.col("sign").alias(f"sign_{c}"), F.col("size").alias(f"size_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sign_a", "sign_b", "size_a", "size_b")
        return both.mapInPandas(_prune(self.threshold, self.tolerance), "a long, b long")

    def block_links(self, members: DataFrame) -> DataFrame:
        """Links across components of the buckets in ``members`` (bucket, rep, component, n): a
        bucket is cut into blocks, and every two blocks meet in a task."""
        cut = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        rows = (members.withColumn("cut", cut).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("cut")))
                .withColumn("meet", F.explode(meets))
                .withColumn("left", F.col("block") == F.col("meet.i")).withColumn("right", F.col("block") == F.col("meet.j"))
                .join(self.signs, "rep").join(self.texts, "rep"))
        return (rows.select("bucket", "meet", "rep", "component", "left", "right", "size", "sign", "text").groupBy("bucket", "meet")
                .applyInPandas(_link_blocks(self.threshold, self.tolerance), "a long, b long, jaccard double"))

    def n_links(self, of: DataFrame) -> DataFrame:
        """(rep, n_links) of the classes ``of`` (rep, component), counted block against block."""
        members = store(of.join(self.signs.select("rep", "size"), "rep"), "near-classes")
        spans = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
        cut = F.greatest(F.least(F.ceil(F.col("n") / COUNT_MEMBERS), F.lit(MEETING)), F.ceil(F.col("n") / BLOCK_MEMBERS),
                         F.ceil(F.col("shingles") / COUNT_SHINGLES)).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        rows = (members.join(spans, "component").withColumn("cut", cut).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
                .withColumn("meet", F.explode(meets))
                .withColumn("left", F.col("block") == F.col("meet.i")).withColumn("right", F.col("block") == F.col("meet.j"))
                .join(self.texts, "rep"))
        counted = (rows.select("component", "meet", "rep", "left", "right", "text").groupBy("component", "meet")
                   .applyInPandas(_count_blocks(self.threshold), "rep long, n_links long"))
        return counted.groupBy("rep").agg(F.sum("n_links").alias("n_links"))

    def verified(self, kept: DataFrame) -> DataFrame:
        """Of pairs (a, b) those similar enough, with their similarity."""
        side = lambda c: self.texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))
        both = kept.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verify(self.threshold), "a long, b long, jaccard double")


def _classes(join: _Join) -> DataFrame:
    """(id, component) of the representatives linked with another one."""
    members = join.buckets()
    pairs = store(members.filter("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    links = store(join.verified(store(join.survivors(pairs), "near-kept")), "near-links")
    of = store(components(links), "near-components")

    known = members.join(of.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("bucket")
    known = store(known.join(mixed, "bucket").filter("n > 2"), "near-open")  # the star compared two already
    left = known.filter(F.col("n") <= FEW)
    right = left.select("bucket", F.col("rep").alias("b"), F.col("component").alias("other"))
    more = (left.withColumnRenamed("rep", "a").join(right, "bucket").filter("a < b AND a > lead AND component <> other")
            .select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    kept = store(join.survivors(store(more, "near-more")), "near-kept")
    more = store(join.verified(kept).unionByName(join.block_links(known.filter(F.col("n") > FEW))), "near-links")
    if not more.isEmpty():
        links = links.unionByName(more).dropDuplicates(["a", "b"])
        of = store(components(links), "near-components")
    return of


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per doc_id with a word: doc_id, class_id (smallest doc_id of the documents linked
    with it through similar texts), copy_of (smallest doc_id with the same shingles) and n_links
    (other texts of its class at least ``threshold`` alike, all pairs of the class compared)."""
    join = _Join(docs, threshold, tolerance)
    of = _classes(join).withColumnRenamed("id", "rep")
    per_rep = join.reps.select("rep").join(of, "rep", "left").join(join.n_links(of), "rep", "left")
    return (join.member.select("doc_id", "rep").join(per_rep, "rep", "left")
            .select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copy_of"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One document of each class stays, that with the smallest doc_id; documents that take no
    part in the join stay as they are. A document is a pair of doc_id and text: of equal rows
    one stays, and texts that share a doc_id are judged apart."""
    keys = docs.filter("doc_id IS NOT NULL").filter(text_of().rlike(WORD)).select("doc_id", F.xxhash64("text").alias("text_hash"))
    rows = store(keys.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    if not rows.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty():
        numbered = with_position(rows.select(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__hash")), [F.col("__of"), F.col("__hash")], "__nr")
        same = (F.col("doc_id") == F.col("__of")) & (F.xxhash64("text") == F.col("__hash"))
        found = docs.join(numbered, same, "left").drop("__of", "__hash")
        part = found.filter("__nr IS NOT NULL").dropDuplicates(["__nr"])
        docs = store(found.filter("__nr IS NULL").unionByName(part), "near-documents")
        gone = _gone(docs.select(F.col("__nr").alias("doc_id"), "text"), threshold, tolerance).withColumnRenamed("doc_id", "__nr")
        return docs.join(gone, "__nr", "left_anti").drop("__nr")
    return docs.join(_gone(docs, threshold, tolerance), "doc_id", "left_anti").select(*docs.columns)


def _gone(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """doc_ids (one text each) of the documents with a smaller doc_id in their class."""
    join = _Join(docs, threshold, tolerance)
    of = _classes(join).withColumnRenamed("id", "rep")
    gone = join.member.join(of, "rep", "left").filter(F.coalesce("component", "rep") != F.col("doc_id")).select("doc_id")
    return store(gone, "near-gone")
