"""Runs of periodic words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
``max(LEAST, 2q)`` words that no neighbouring word extends.

Short periods are scanned lag by lag. For periods in [P, 2P) every window of P/2 words has a
minimizer, the first of its least hashed 4 words. A run of period p holds at least p words twice,
so one of its windows comes again p words later with the same minimizer at the same place: pairs of
equal minimizers less than 2P apart seed the candidates, which are extended word by word. The
scales double until 2P exceeds the longest text.

Windows inside a run of a much shorter period are left out (a period of at most half a window):
there minimizers repeat with that period, which is known from an earlier scale. The one kind of
run all of whose windows can be left out is one whose halves lie in two touching runs of the same
shorter period; touching runs are therefore aligned and seed their candidates themselves.

A task takes texts in groups of about a quarter of a million words, numbers their words and works on arrays
over the whole group; a longer text is a group of its own. Nothing leaves a task but rows.

Defined cases: null text has no words; texts of any length are read whole; each row is a text of
its own, so repeated rows and null or equal keys change nothing; texts without a run have an empty list
and keep their words; an empty table gives an empty result. Other columns take no part, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value

#: Shortest run, in words.
LEAST = 12
#: Periods below this are scanned lag by lag.
SCANNED = 64
#: Words in a hashed stretch of a minimizer.
GRAM = 4
#: Words in a group of texts that are worked on together.
GROUP_WORDS = 250_000

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64."""
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Finder:
    """Runs of one array of word numbers in which texts are set apart by numbers used once."""

    def __init__(self, ids: np.ndarray, least: int):
        self.x, self.least, self.n = ids, least, len(ids)
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self.seen: dict[int, list[tuple[int, int]]] = {}  # period -> (start, end) of the runs with it
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
        self.power = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.mixed * self.power[:-1], out=self.sums[1:])

    def same(self, at: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches [at, at+length) and those ``lag`` later agree, by hash; False
        where one would leave the array."""
        inside = (at >= 0) & (at + lag + length <= self.n)
        a = np.where(inside, at, 0)
        b, k = np.where(inside, lag, 0), np.where(inside, length, 0)
        return inside & ((self.sums[a + k] - self.sums[a]) * self.power[b] == self.sums[a + b + k] - self.sums[a + b])

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.least, 2 * period):
            old = self.found.get((start, end))
            if old is None or period < old:
                self.found[start, end] = period
                self.seen.setdefault(period, []).append((start, end))

    def scan(self, lag: int) -> None:
        equal = np.zeros(self.n - lag + 2, np.int8)
        equal[1:-1] = self.x[lag:] == self.x[:-lag]
        edges = np.flatnonzero(np.diff(equal))
        starts, ends = edges[::2], edges[1::2]
        for i in np.flatnonzero(ends - starts + lag >= max(self.least, 2 * lag)):
            self.add(int(starts[i]), int(ends[i]) + lag, lag)

    def _agree(self, a: int, b: int) -> int:
        """How many words from a and b on are equal, in steps that double."""
        x, n, done, step = self.x, self.n, 0, 64
        while b + done < n:
            k = min(step, n - b - done)
            differs = np.flatnonzero(x[a + done:a + done + k] != x[b + done:b + done + k])
            if len(differs):
                return done + int(differs[0])
            done += k
            step = min(2 * step, 1 << 16)
        return done

    def _agree_back(self, a: int, b: int) -> int:
        """How many words before a and b are equal (a < b)."""
        x, done, step = self.x, 0, 64
        while done < a:
            k = min(step, a - done)
            differs = np.flatnonzero(x[a - done - k:a - done] != x[b - done - k:b - done])
            if len(differs):
                return done + k - 1 - int(differs[-1])
            done += k
            step = min(2 * step, 1 << 16)
        return done

    def extend(self, at: int, lag: int) -> int:
        """Add the run of this lag around ``at``; the end of its stretch of agreement."""
        end = at + self._agree(at, at + lag)
        start = at - self._agree_back(at, at + lag)
        if end - start >= lag:
            self.add(start, end + lag, lag)
        return end

    def seeds(self, at: np.ndarray, lag: np.ndarray) -> None:
        """Extend the seeds around which at least half a period agrees on one side, each
        stretch of agreement once."""
        half = (lag + 1) // 2
        ok = self.same(at, lag, half) | self.same(at - half, lag, half)
        at, lag = at[ok], lag[ok]
        order = np.lexsort((at, lag))
        now, upto = -1, -1
        for a, d in zip(at[order].tolist(), lag[order].tolist()):
            if d != now:
                now, upto = d, -1
            if a >= upto:
                upto = max(self.extend(a, d), a + 1)

    def touching(self, period: int, done: set[tuple[int, int]]) -> None:
        """Runs made by touching runs of one period: the second run's first words come again and
        again in the first run, each time with another distance."""
        spans = sorted({span for span in self.seen.get(period, ()) if self.found[span] == period})
        for (a1, e1), (a2, e2) in zip(spans, spans[1:]):
            if a2 > e1 or (a1, a2) in done:
                continue
            done.add((a1, a2))
            last = np.arange(max(a1, e1 - 2 * period + 1), e1 - period + 1)
            hit = last[self.same(last, a2 - last, np.full(len(last), period))]
            if not len(hit) or not np.array_equal(self.x[hit[-1]:hit[-1] + period], self.x[a2:a2 + period]):
                continue
            lag = np.arange(a2 - int(hit[-1]), min(e1 - a1, e2 - a2) + 1, period)
            start, end = np.maximum(a1, a2 - lag), np.minimum(e1, e2 - lag)  # where both sides lie in these runs
            fits = end - start >= lag
            for s, e, d in zip(start[fits].tolist(), end[fits].tolist(), lag[fits].tolist()):
                if a1 == a2 - d or e1 == e2 - d:  # both runs end here: what follows may agree, too
                    self.extend(s, d)
                else:
                    self.add(s, e + d, d)

    def inside_known(self, width: int, longest: int) -> np.ndarray:
        """Starts of windows that lie in a run of period ``longest`` at most."""
        change = np.zeros(self.n + 2, np.int32)
        for (start, end), period in self.found.items():
            if period <= longest and end - start >= width:
                change[start] += 1
                change[end - width + 1] -= 1
        return np.cumsum(change)[:self.n] > 0

    def find(self, longest: int) -> list[tuple[int, int, int]]:
        """(start, end, period) of all runs; no text is longer than ``longest`` words."""
        for lag in range(1, min(SCANNED, longest // 2 + 1)):
            self.scan(lag)
        joined: set[tuple[int, int]] = set()
        known = 1
        period, n = SCANNED, self.n
        if 2 * period > longest:
            return self.result()
        grams = n - GRAM + 1
        # Hash of the words of a gram and its place: the least is the first of the least hashed.
        key = sum(np.roll(self.mixed, -i) * self.power[i + 1] for i in range(GRAM))[:grams]
        key ^= key >> np.uint64(29)
        key = ((key * _BASE) >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
        least, width = key, 1  # least key of ``width`` grams from each place on
        while 2 * period <= longest:
            while known < period:
                self.touching(known, joined)
                known += 1
            while 2 * width + GRAM - 1 <= period // 2:
                least = np.minimum(least[:len(least) - width], least[width:])
                width *= 2
            words = width + GRAM - 1
            at = least
            if words >= self.least:  # else a stretch as long as a window may be too short for a run
                at = least[~self.inside_known(words, words // 2)[:len(least)]]
            at = np.unique((at & np.uint64(0xFFFFFFFF)).astype(np.int64))
            values = key[at] >> np.uint64(32)
            order = np.lexsort((at, values))
            at, values = at[order], values[order]
            step = 1
            alive = np.arange(len(at) - 1)
            seed_at, seed_lag = [], []
            while len(alive):
                alive = alive[alive + step < len(at)]
                lag = at[alive + step] - at[alive]
                near = (values[alive + step] == values[alive]) & (lag < 2 * period)
                alive, lag = alive[near], lag[near]
                far = lag >= period
                seed_at.append(at[alive[far]])
                seed_lag.append(lag[far])
                step += 1
            if seed_at:
                self.seeds(np.concatenate(seed_at), np.concatenate(seed_lag))
            period *= 2
        return self.result()

    def result(self) -> list[tuple[int, int, int]]:
        return sorted((start, end, period) for (start, end), period in self.found.items())


def runs_of(texts: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not any(len(t) >= least for t in texts):
        return out
    number: dict = {}
    for t in texts:
        number.update(dict.fromkeys(t))
    number = dict(zip(number, range(len(number))))
    ids = np.empty(bounds[-1], np.int32)
    for i, t in enumerate(texts):
        ids[bounds[i]:bounds[i] + len(t)] = np.fromiter(map(number.__getitem__, t), np.int32, len(t))
    ids[bounds[1:] - 1] = len(number) + np.arange(len(texts))
    found = _Finder(ids, least).find(max(map(len, texts)))
    owner = np.searchsorted(bounds, [f[0] for f in found], "right") - 1
    for (start, end, period), i in zip(found, owner):
        out[i].append((start - int(bounds[i]), end - start, period))
    for r in out:
        r.sort(key=lambda f: (f[0], f[2]))
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those after the first period of a run that holds them."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]


def _groups(batches: Iterator[pa.RecordBatch], edit: Callable | None) -> Iterator[tuple[list, list]]:
    """Keys and word lists of about GROUP_WORDS words at a time."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = raw.split() if raw else []  # bytes split at the blanks 20 and 09 to 0D
            if edit:
                words = edit(key, words)
            if texts and held + len(words) > GROUP_WORDS:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(words)
            held += len(words) + 1
    if texts:
        yield keys, texts


def collapse(docs: DataFrame, key: str = "doc_id", edit: Callable[[object, list], list] | None = None,
             least: int = LEAST) -> DataFrame:
    """Per row: key, n_words, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the text's words without the repetitions, joined by one space.

    ``edit(key, words)`` may change a text's words before they are searched.
    """
    ship_by_value(__name__)
    kind = docs.schema[key].dataType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field(0).type

        def all_batches():
            yield first
            yield from batches

        for keys, texts in _groups(all_batches(), edit):
            runs = runs_of(texts, least)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, key_type), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], _RUN_TYPE),
                pa.array([b" ".join(kept_words(t, r)) for t, r in zip(texts, runs)], pa.binary()).view(pa.string()),
            ], names=[key, "n_words", "runs", "collapsed"])

    return docs.select(key, "text").mapInArrow(find, f"`{key}` {kind.simpleString()}, n_words bigint, runs {RUN}, collapsed string")


def plant(key: int | None, words: list) -> list:
    """The words with a repetition planted by the key's CRC-32 in one of ten texts."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a:a + p]
    return words[:a] + (head * ((n - a) // p + 1))[:n - a]


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of :func:`collapse`: number of runs, the longest one, and digests of all runs
    and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"),
        best["p"].alias("period"), F.floor(-best["l"] * 1000 / best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
