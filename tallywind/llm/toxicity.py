"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents. A word written with digits or symbols
for letters, with separators between its letters or with letters repeated is a lattice: at each
written character the intended one may be itself, a letter it stands for, or nothing (a
separator, a repetition). The Viterbi path of least cost under the trigram model and the
channel's costs is the restored word. Every token with a doubled letter or a character that
stands for a letter is decoded, also one of symbols alone. In letters spaced out by blanks of any
width or line breaks, and in neighbouring short fragments, a gap may also be the end of a word. A
word of letters alone, none doubled, has one path, itself. Written words stay beside the restored
ones. The restored text is scored by a logistic model on words and word beginnings,
learned from a bounded sample of labelled documents outside the held-out fifth.

Counts of the trigram model go through map-side sums into a table bounded by the alphabet; the
lattices and the scores are per document, so no group can be hot.

Defined cases: null text is empty; an empty text has the score of a text without any feature;
without both labels to learn from, the score is the labels' prevalence, or 0; labels that are
null, of unknown documents or of null doc_id are passed over; of several texts of one labelled
doc_id the least is learned from; repeated rows are scored alike; texts are decoded token by
token, so very long ones need no more than their different tokens in memory; other columns, also
of the same names as the result's, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from functools import partial
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, store

#: Labelled documents the model is learned from, at most: those with the smallest hashes of their id.
SAMPLE = 20_000
#: Features kept, at most.
FEATURES = 3000
PREFIXES = (4, 5, 6, 7)
FOLDS = 5

ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_SIZE = len(ALPHABET) + 1  # 0: no letter
_LETTER = {c: i + 1 for i, c in enumerate(ALPHABET)}

# What a written character may stand for, besides itself.
STANDS_FOR = {"4": "a", "@": "a", "8": "b", "6": "bg", "(": "c", "3": "e", "€": "e", "9": "g", "1": "il", "!": "il", "|": "il",
              "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
SEPARATORS = " .-_*~'/,·"
SUBSTITUTION, SEPARATION, REPETITION = 0.7, 0.3, 1.0

_EDGE = "\"'`´.,;:!?()[]{}<>«»„“”‘’…%&#*_~^=/\\|-–—+$@€"
_PLAIN = "".join(c for c in _EDGE if c not in STANDS_FOR)
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<![\w$@])(?:[\w$@!][\s.\-_*~]+){2,}[\w$@!](?![\w$@])")
_WRITTEN = frozenset(ALPHABET) | frozenset(STANDS_FOR)
#: First letters that a word's features share.
HEAD = PREFIXES[0]
#: Letters of a fragment that may belong to a word cut by a blank.
FRAGMENT = 4
#: A word that begins so on every path and is no fragment, with marks at its end at most.
_ORDINARY = re.compile(rf"(?:([{ALPHABET}])(?!\1)){{{HEAD - 1}}}[{ALPHABET}]{{{FRAGMENT + 2 - HEAD},}}[{re.escape(_EDGE)}]*")
_CACHE = 100_000


def count_trigrams(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams, words bounded by the symbol 0, as one flat array."""
    lut = np.zeros(0x160, np.int64)
    for c, i in _LETTER.items():
        lut[ord(c)] = i
    total = np.zeros(_SIZE ** 3, np.int64)
    for i in range(0, len(texts), 200):
        joined = "  ".join(["", *texts[i:i + 200], ""]).lower()
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        for j in range(0, len(code), 1 << 20):
            s = lut[np.minimum(code[j:j + (1 << 20) + 2], 0x15F)]
            grams = (s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:]
            total += np.bincount(grams, minlength=len(total))
    total[: _SIZE] = 0  # two symbols 0 before a letter are counted with the second one below
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE ** 3, np.int64)
    for batch in batches:
        total += count_trigrams([t for t in batch.column(0).to_pylist() if t])
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs -log P(c | a, b), an array [a, b, c], from all texts."""
    ship_by_value(__name__)
    counted = docs.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(_SIZE ** 3)
    n[counted["gram"].to_numpy(int)] = counted["n"].to_numpy(float)
    return costs(n)


def costs(n: np.ndarray) -> np.ndarray:
    """Trigram costs from flat counts, interpolated with bigrams and single letters."""
    three = n.reshape(_SIZE, _SIZE, _SIZE)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 0.5) / (one.sum() + 0.5 * _SIZE)
    p2 = (two + 5.0 * p1) / (two.sum(axis=1, keepdims=True) + 5.0)
    p3 = (three + 5.0 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5.0)
    return -np.log(p3).astype(np.float32)


class _Memory:
    """What keys tell. Sets of keys meet a plain dict and a set in one step each, without a loop here."""

    def __init__(self) -> None:
        self.told: dict = {}
        self.telling: set = set()  # keys that tell anything

    def make_room(self, most: int) -> bool:
        full = len(self.told) >= most
        if full:
            self.told.clear()
            self.telling.clear()
        return full

    def read(self, keys: set, look: Callable) -> Iterator[str]:
        """What the keys tell; ``look`` says it of a new key."""
        for key in keys.difference(self.told):
            self.told[key] = told = look(key)
            if told:
                self.telling.add(key)
        return chain.from_iterable(map(self.told.get, keys & self.telling))


class Decoder:
    """Viterbi decoding of written words; results of recent words are remembered.

    Without a ``model`` the words themselves are read. ``of`` turns words into what is read of
    them, each word for itself. With a ``model``, a set of features, those of its features are
    read: all features of a word share its first letters, and a written word that begins with
    four letters, none doubled, begins so on every path, so most words are settled by one look."""

    def __init__(self, cost: np.ndarray, of: Callable[[Iterable[str]], Iterable[str]] = tuple, model: Container[str] | None = None) -> None:
        self.cost = cost.tolist()
        self.of = of
        self.starts = None
        self.room = _CACHE
        if model is not None:
            self.starts = {f[:HEAD] for f in model}
            self.beginnings = {f[:n] for f in self.starts for n in range(1, HEAD + 1)}
            self.of = partial(_of_model, model, self.starts)
            self.room = 3 * _CACHE  # nearly all tell nothing and take little
        self.known: dict[str, str] = {}
        self.tokens = _Memory()  # what a written token tells
        self.fragments: dict[str, str] = {}  # short tokens, without marks at their edges
        self.pairs = _Memory()  # what neighbouring fragments tell

    def __call__(self, word: str, ends: bool = False) -> str:
        """The restored word, or nothing if it can't be of the model; with ``ends``, a blank inside may also be the end of a word."""
        key = (word, ends) if ends else word
        out = self.known.get(key)
        if out is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            out = self.known[key] = self._decode(word, ends) if ends or self._may_tell(word) else ""
        return out

    def read(self, tokens: list[str]) -> set[str]:
        """What the tokens of a text tell, one by one and in pairs of neighbouring fragments."""
        if self.tokens.make_room(self.room):
            self.fragments.clear()
        self.pairs.make_room(self.room)
        found = set(self.tokens.read(set(tokens), self._told_by))
        found.update(self.pairs.read(set(pairwise(map(self.fragments.get, tokens))), self._told_by_two))
        return found

    def _told_by(self, raw: str) -> tuple[str, ...]:
        if self.starts is not None and raw[:HEAD] not in self.starts and _ORDINARY.fullmatch(raw):
            return ()
        return tuple(self.of(self._token(raw)))

    def _told_by_two(self, pair: tuple[str | None, str | None]) -> tuple[str, ...]:
        first, second = pair
        if first is None or second is None or len(first) + len(second) <= FRAGMENT:
            return ()
        if self.starts is not None and len(first) + len(second) >= HEAD and (first + second)[:HEAD] not in self.starts and (first + second).isalpha():
            return ()
        return tuple(self.of(self._rejoined(first, second)))

    def _may_tell(self, word: str) -> bool:
        """Whether some path begins as a feature of the model does."""
        if self.starts is None:
            return True
        ways, before = {""}, ""
        for c in word:
            letters = c if c in _LETTER else STANDS_FOR.get(c, "")
            between = c in SEPARATORS or c.isspace()
            longer = {w + x for w in ways for x in letters} & self.beginnings
            if any(len(w) == HEAD for w in longer):
                return True
            ways = longer | ways if between or c == before or not letters else longer
            if not ways:
                return False
            if not between:
                before = c
        return not ways.isdisjoint(self.starts)

    def _token(self, raw: str) -> set[str]:
        core = raw.strip(_EDGE)
        if 0 < len(core) <= FRAGMENT and _WRITTEN.issuperset(core) and not core.isdigit():
            self.fragments[raw] = core
        words = set()
        if core.isalpha():
            words.add(core)
            if _DOUBLE.search(core):
                words.add(self(core))
            if raw.strip(_PLAIN) == core:
                return words
        else:
            words.update(w for w in re.split(r"[\W\d_]+", core) if len(w) > 1)
        if len(raw) > 2 and raw[0] in STANDS_FOR and _WRITTEN.issuperset(raw):
            words.add(self(raw))  # symbols alone, or one for the first letter
        # letters at the edge may be written as symbols
        while raw and raw[-1] in _EDGE and (raw[-1] not in STANDS_FOR or raw[-2:-1] == raw[-1:] or raw[-1] in "!|+"):
            raw = raw[:-1]
        raw = raw.lstrip(_PLAIN)
        if raw != core or not core.isalpha():
            if any(c in _WRITTEN for c in raw):
                words.add(self(raw))
        return words

    def _rejoined(self, first: str, second: str) -> tuple[str, ...]:
        """Words of two fragments. Between letters the path differs at the seam alone."""
        if not (first.isalpha() and second.isalpha()):
            return tuple(self(f"{first} {second}", ends=True).split())
        a, b = (_LETTER[first[-2]] if len(first) > 1 else 0), _LETTER[first[-1]]
        c, d = _LETTER[second[0]], (_LETTER[second[1]] if len(second) > 1 else 0)
        cost = self.cost
        if SEPARATION + cost[a][b][c] + cost[b][c][d] < cost[a][b][0] + cost[b][0][c] + cost[0][c][d]:
            return (first + second,)
        return ()

    def _decode(self, word: str, ends: bool) -> str:
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for c in word:
            letters = [(c, 0.0)] if c in _LETTER else [(x, SUBSTITUTION) for x in STANDS_FOR.get(c, "")]
            between = c in SEPARATORS or c.isspace()
            best: dict[tuple[int, int], tuple[float, tuple]] = {}
            if c in _LETTER and c != before:  # no way but itself
                i = _LETTER[c]
                for (a, b), (spent, path) in paths.items():
                    total = spent + self.cost[a][b][i]
                    if (b, i) not in best or total < best[b, i][0]:
                        best[b, i] = (total, (path, c))
                before, paths = c, best
                continue
            skip = [x for x, may in ((SEPARATION, between), (REPETITION, c == before), (3.0, not letters)) if may]
            for (a, b), (spent, path) in paths.items():
                if skip:
                    total = spent + min(skip)
                    if (a, b) not in best or total < best[a, b][0]:
                        best[a, b] = (total, path)
                row = self.cost[a][b]
                if ends and b and c.isspace():
                    total = spent + row[0]
                    if (b, 0) not in best or total < best[b, 0][0]:
                        best[b, 0] = (total, (path, " "))
                for letter, extra in letters:
                    i = _LETTER[letter]
                    total = spent + row[i] + extra
                    if (b, i) not in best or total < best[b, i][0]:
                        best[b, i] = (total, (path, letter))
            if not between:
                before = c
            paths = best
        _, path = min((spent + self.cost[a][b][0], path) for (a, b), (spent, path) in paths.items())
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out))


def restored_words(text: str, decode: Decoder) -> set[str]:
    """The different words of the restored text, lower case, or what ``decode`` reads of them."""
    text = text.lower()
    found = decode.read(text.split())
    for spaced in _SPACED.findall(text):
        found.update(decode.of([decode(spaced), *decode(spaced, ends=True).split()]))
    found.discard("")
    return found


def features_of(words: Iterable[str]) -> set[str]:
    """Words and their beginnings; beginnings end in a star."""
    return {*words, *(w[:n] + "*" for n in PREFIXES for w in words if len(w) > n)}


def _of_model(model: Container[str], starts: set[str], words: Iterable[str]) -> list[str]:
    near = [w for w in words if w[:HEAD] in starts]
    return [f for f in features_of(near) if f in model] if near else []


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _count_features(cost: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(cost, features_of)
        every: Counter = Counter()
        toxic: Counter = Counter()

        def out():
            rows = list(every)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([every[f] for f in rows]), pa.array([toxic[f] for f in rows])],
                                              names=["feature", "n", "n_toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = restored_words(text or "", decode)
                every.update(found)
                if label:
                    toxic.update(found)
                if len(every) > 500_000:
                    yield out()
                    every, toxic = Counter(), Counter()
        if every:
            yield out()

    return run


def _indices(cost: np.ndarray, index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(cost, model=index)
        for batch in batches:
            found = [sorted(index[f] for f in restored_words(t or "", decode)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "found"])

    return run


def fit(found: list[list[int]], y: np.ndarray, n_features: int, ridge: float = 0.15, steps: int = 1000) -> np.ndarray:
    """Logistic weights, the constant last, by accelerated gradient steps on a sparse table."""
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cols = np.array([i for f in found for i in f], int)
    w = ahead = np.zeros(n_features + 1)
    w[-1] = ahead[-1] = math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    v = np.ones(n_features + 1)
    for _ in range(30):  # largest curvature of the loss, by power steps
        u = np.bincount(rows, weights=v[cols], minlength=len(y)) + v[-1]
        v = np.append(np.bincount(cols, weights=u[rows], minlength=n_features), u.sum())
        most = np.linalg.norm(v)
        v /= most
    most = 0.25 * 1.1 * most + ridge
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=ahead[cols], minlength=len(y)) + ahead[-1], -30, 30)))
        d = p - y
        g = np.append(np.bincount(cols, weights=d[rows], minlength=n_features), d.sum()) + ridge * np.append(ahead[:-1], 0)
        step = ahead - g / most
        ahead = step + t / (t + 3) * (step - w)
        w = step
    return w


def learn(docs: DataFrame, labels: DataFrame, cost: np.ndarray, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Weights of features and the constant."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y IN (0, 1)").filter(~is_held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    known = store(known, "toxic-known")  # at most ``sample`` rows of two numbers
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # repeated rows count once
            .select("text", "y", "doc_id"))
    rows = store(rows, "toxic-rows")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).first()
    if not n["n"]:
        return {}, -30.0
    if not n["toxic"] or n["toxic"] == n["n"]:
        return {}, 30.0 if n["toxic"] else -30.0
    toxic, clean = float(n["toxic"]), float(n["n"] - n["toxic"])
    ratio = F.log((F.col("n_toxic") + 0.2) / (toxic + 0.4)) - F.log((F.col("n") - F.col("n_toxic") + 0.2) / (clean + 0.4))
    chosen = (rows.repartition(F.xxhash64("doc_id")).mapInArrow(_count_features(cost), "feature string, n long, n_toxic long")
              .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
              .withColumn("ratio", ratio).filter((F.col("n_toxic") >= 4) & (F.col("ratio") > 1.5))
              .orderBy(F.desc(F.col("ratio") * F.sqrt("n_toxic")), "feature").limit(FEATURES).select("feature").toPandas())
    index = {f: i for i, f in enumerate(chosen["feature"])}
    table = rows.mapInArrow(_indices(cost, index), "y int, found array<int>").toPandas()
    w = fit([list(f) for f in table["found"]], table["y"].to_numpy(float), len(index))
    return {f: float(w[i]) for f, i in index.items()}, float(w[-1])


def _scores(cost: np.ndarray, weights: dict[str, float], constant: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(cost, model=weights)
        for batch in batches:
            odds = [constant + math.fsum(weights[f] for f in restored_words(t or "", decode)) for t in batch.column(2).to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs``."""
    ship_by_value(__name__)
    cost = language_model(docs)
    weights, constant = learn(docs, labels, cost, sample)
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scores(cost, weights, constant), "doc_id long, held_out boolean, score double, predicted int")
