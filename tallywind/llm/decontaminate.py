"""Benchmark decontamination by template canonicalisation, DataFrame expressions only.

Numbers, names (words with a capital followed by a small letter, wherever they stand) and units
become typed placeholders, so that a question asked again with other values has the same
template. Windows of eight template words (an item of five to seven words is one window) are
hash-joined with those of the benchmark. Windows of the item with fewer literal words than
placeholders say too little and are left out; windows with placeholders are joined by their folded words, too, so that a copy in other
case or with other line ends is found as it stands.

Hits on one diagonal (the same shift between document and item) are read in runs: as many
neighbouring windows as are asked for (six, or all that the item has, i.e. up to 13 words in line) must
be hit, and fill their slots consistently: equal values of the item meet equal values of the
document. A document holds an item if it has such a run. Items of fewer than five words are
searched for as whole lines.

Only hits are shuffled: documents' windows stream past the benchmark's, which are broadcast if
their counted bytes allow it; beyond that both sides are shuffled on the hash.

Defined cases: null and empty texts have no windows; texts of any length are read whole; items without a word are not searched for;
items of almost only names and numbers are found as they stand, not with other values; rows of
one doc_id count as one document; rows with null doc_id or item_id take no part (as documents
they are kept); extra columns take no part, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_of

WINDOW = 8
LEAST_WORDS = 5
LEAST_HITS = 6
#: Bytes of the benchmark's windows that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Different words of the benchmark up to which windows with other words are left out before they are hashed.
FILTER_WORDS = 20_000

_SLOT, _POINT = "\ue000", "\ue001"
# Units of measure, time and money that follow a number.
UNITS = ("km kg cm mm mg ml lb lbs oz ft mi mph kmh m g l s ms h hr hrs min mins sec secs inch inches feet miles meters metres "
         "grams kilograms liters litres hours minutes seconds days weeks months years percent usd eur gbp dollars euros pounds cents "
         "kb mb gb tb hz khz mhz ghz w kw v c f").split()
_UNIT = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
_APART = rf"[^\p{{L}}\p{{M}}\p{{N}}{_POINT}]+"
_PAIRS = "array<struct<at:int,type:string,item:bigint,doc:bigint>>"


def words(text: Column) -> Column:
    """Words of a text; a number with decimals is one, its unit another."""
    plain = F.when(F.contains(text, F.lit(_SLOT)) | F.contains(text, F.lit(_POINT)),
                   F.translate(text, _SLOT + _POINT, "  ")).otherwise(text)
    # Patterns begin with the rare character, which is what a scan tests at every place.
    apart = F.regexp_replace(F.regexp_replace(plain, r"[.,](?=[0-9])(?<=[0-9].)", _POINT),
                             rf"([0-9])(?=(?i:{_UNIT})(?![\p{{L}}\p{{N}}]))", "$1 ")
    return F.array_remove(F.split(F.when(plain.rlike("[0-9]"), apart).otherwise(plain), _APART), "")


def _number(w: Column) -> Column:
    return (w < ":") & (w >= "0") & (F.translate(w, f"0123456789{_POINT}", "") == "")


def _typed(raw: Column, folded: Column, mark, word) -> Column:
    """For each word ``mark(type)`` if it is a number, its unit or a name, else ``word(i)``. The
    tests go from cheap to dear: most words fail the first comparison of each."""

    def of(w: Column, i: Column) -> Column:
        low = F.get(folded, i)
        unit = F.coalesce(_number(F.get(raw, i - 1)), F.lit(False)) & low.isin(UNITS)
        named = (w != low) & (F.substring(w, 1, 1) != F.substring(low, 1, 1)) & (F.substring(w, 2, 1) != F.upper(F.substring(w, 2, 1)))
        return F.when(_number(w), mark("n")).when(unit, mark("u")).when(named, mark("a")).otherwise(word(i))

    return F.transform(raw, of)


def typed(raw: Column, folded: Column) -> Column:
    """The template words: placeholders for numbers, their units and names, else the folded word."""
    return _typed(raw, folded, lambda k: F.lit(f"{_SLOT}{k}"), lambda i: F.get(folded, i))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once. As a plain column it would be put into the
    lambdas that use it, evaluated per element, or become a packed array, copied per slice."""
    return F.get(F.transform(F.array(value), use), 0)


def vocabulary(benchmark: DataFrame) -> list[int] | None:
    """Hashes of all words and template words of the items; None if there are more than
    FILTER_WORDS, in which case every window is hashed and joined."""
    both = _let(words(text_of()), lambda raw: _let(F.transform(raw, F.lower), lambda low: F.array_union(typed(raw, low), low)))
    found = benchmark.select(F.explode(both).alias("w")).select(F.xxhash64("w").alias("h")).distinct().limit(FILTER_WORDS + 1).collect()
    return None if len(found) > FILTER_WORDS else [r["h"] for r in found]


def windows(docs: DataFrame, key: str, sizes: list[int], among: list[int] | None = None) -> DataFrame:
    """(key, pos, size, hash, slots) of each window; slots: hashes of the folded words at the
    window's places if the hash is that of a template with a placeholder, else null. With
    ``among`` only of windows all of whose words are among these hashes: no other can be hit."""
    kind = "array<struct<pos:int,size:int,t:bigint,f:bigint,slots:array<bigint>>>"

    def of(h: Column, size: int) -> Column:
        def at(i: Column) -> Column:
            t, f = F.slice(h["t"], i + 1, size), F.slice(h["f"], i + 1, size)
            return _let(F.struct(F.xxhash64(t, F.lit(size)).alias("t"), F.xxhash64(f, F.lit(size)).alias("f")), lambda x: F.struct(
                i.alias("pos"), F.lit(size).alias("size"), x["t"].alias("t"), x["f"].alias("f"), F.when(x["t"] != x["f"], f).alias("slots")))

        n = F.size(h["t"])
        starts = F.sequence(F.lit(0), n - size)
        if among is not None:
            starts = F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(h["ok"], i + k) for k in range(size)]))
        return F.when(n >= size, F.transform(starts, at)).otherwise(F.array().cast(kind))

    def hashes(raw: Column, folded: Column) -> Column:
        mark = lambda k: F.xxhash64(F.lit(f"{_SLOT}{k}"))
        known = lambda t, f: F.lit(None) if among is None else F.transform(f, lambda x, i: x.isin(among) | F.get(t, i).isin(among))
        return _let(F.transform(folded, lambda w: F.xxhash64(w)), lambda f: _let(
            _typed(raw, folded, mark, lambda i: F.get(f, i)), lambda t: F.struct(t.alias("t"), f.alias("f"), known(t, f).alias("ok"))))

    every = _let(words(text_of()), lambda raw: _let(F.transform(raw, F.lower), lambda folded: _let(
        hashes(raw, folded), lambda h: of(h, sizes[0]) if len(sizes) == 1 else F.concat(*[of(h, s) for s in sizes]))))
    at = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(every).alias("w")).select("key", "w.*")
    # A window without a placeholder has one hash, another two: its template's and its words'.
    own = F.struct(F.col("t").alias("hash"), "slots")
    plain = F.struct(F.col("f").alias("hash"), F.lit(None).cast("array<bigint>").alias("slots"))
    kinds = F.when(F.col("t") == F.col("f"), F.array(own)).otherwise(F.array(own, plain))
    return at.select("key", "pos", "size", F.explode(kinds).alias("k")).select(F.col("key").alias(key), "pos", "size", "k.hash", "k.slots")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items: of eight words, or the whole of a shorter item; ``item_types`` are
    their template words where they have slots."""
    both = _let(words(text_of()), lambda raw: _let(F.transform(raw, F.lower), lambda low: F.struct(
        raw.alias("raw"), low.alias("folded"), typed(raw, low).alias("typed"))))
    base = benchmark.filter("item_id IS NOT NULL").select("item_id", F.explode(F.array(both)).alias("w")).select("item_id", "w.*")
    size = F.least(F.lit(WINDOW), F.size("raw"))
    base = base.filter(F.size("raw") >= LEAST_WORDS).withColumn("size", size)
    at = base.select("item_id", "size", "folded", "typed", (F.size("raw") - size + 1).alias("item_windows"),
                     F.explode(F.sequence(F.lit(0), F.size("raw") - size)).alias("item_pos"))
    at = at.withColumn("typed", F.slice("typed", F.col("item_pos") + 1, F.col("size"))).withColumn("folded", F.slice("folded", F.col("item_pos") + 1, F.col("size")))
    slots = F.size(F.filter("typed", lambda w: F.startswith(w, F.lit(_SLOT))))
    hashed = lambda c: F.xxhash64(F.transform(c, lambda w: F.xxhash64(w)), F.col("size"))
    plain = at.select("item_id", "item_pos", "size", "item_windows", hashed("folded").alias("hash"),
                      F.lit(None).cast("array<string>").alias("item_types"), F.lit(None).cast("array<bigint>").alias("item_slots"))
    marked = at.filter((slots > 0) & (2 * slots <= F.col("size"))).select(
        "item_id", "item_pos", "size", "item_windows", hashed("typed").alias("hash"), F.col("typed").alias("item_types"),
        F.transform("folded", lambda w: F.xxhash64(w)).alias("item_slots"))
    return plain.unionByName(marked).distinct()


def _small(items: DataFrame, bytes_of: Column) -> DataFrame:
    """``items`` with a broadcast hint if their counted bytes allow it."""
    size = items.agg(F.coalesce(F.sum(bytes_of + 64), F.lit(0))).first()[0]
    return F.broadcast(items) if size <= BROADCAST_BYTES else items


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Windows of the documents that stand in an item."""
    items = store(item_windows(benchmark), "decon-items")
    sizes = sorted((r["size"] for r in items.select("size").distinct().collect()), reverse=True) or [WINDOW]  # four at most
    width = F.coalesce(F.octet_length(F.array_join("item_types", "")) + 8 * F.size("item_slots"), F.lit(0))
    found = windows(docs, "doc_id", sizes, vocabulary(benchmark)).join(_small(items, width), ["hash", "size"])
    # A hash of folded words and one of a template are equal only where the item has no slots.
    return found.filter(F.col("slots").isNull() == F.col("item_slots").isNull())


def short_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(doc_id, item_id) of items too short for a window that are a line of a document."""
    line = F.array_join(F.transform(words(text_of()), F.lower), " ")
    items = store(benchmark.filter("item_id IS NOT NULL").select("item_id", words(text_of()).alias("raw"), line.alias("line"))
                  .filter(F.size("raw").between(1, LEAST_WORDS - 1)).select("item_id", "line"), "decon-short")
    if items.isEmpty():
        return None
    lines = docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(F.split(text_of(), r"\R")).alias("text")).select("doc_id", line.alias("line"))
    return lines.join(_small(items, F.octet_length("line")), "line").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, item_id, n_hits (windows of the item
    found), n_windows (that the item has), n_slots (slots compared), changed (slots with
    another value than the item's)."""
    pair = F.when(F.col("slots").isNotNull(), F.filter(F.transform(
        F.sequence(F.lit(0), F.col("size") - 1),
        lambda i: F.struct((F.col("item_pos") + i).alias("at"), F.get("item_types", i).alias("type"),
                           F.get("item_slots", i).alias("item"), F.get("slots", i).alias("doc"))),
        lambda p: F.startswith(p["type"], F.lit(_SLOT)))).otherwise(F.array().cast(_PAIRS))
    need = F.least(F.lit(LEAST_HITS), F.col("item_windows")).cast("int")
    values = lambda pairs, *names: F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(*[p[n].alias(n) for n in names]))))

    def run(i: Column) -> Column:
        inside = F.slice("hit", i, need)
        pairs = F.array_distinct(F.flatten(F.transform(inside, lambda h: h["pairs"])))
        fine = (F.element_at(inside, -1)["at"] - F.element_at(inside, 1)["at"] == need - 1) & (values(pairs, "type", "item") == values(pairs, "type", "item", "doc"))
        return F.when(fine, inside).otherwise(F.array().cast(f"array<struct<at:int,pairs:{_PAIRS}>>"))

    # Of a window that is hit both ways the one that stands as it is in the item has no pairs.
    line = (hits(docs, benchmark).withColumn("pairs", pair).groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_windows", "item_pos")
            .agg(F.min("pairs").alias("pairs"))
            .groupBy("doc_id", "item_id", "shift", "item_windows").agg(F.sort_array(F.collect_list(F.struct(F.col("item_pos").alias("at"), "pairs"))).alias("hit"))
            .filter(F.size("hit") >= need))
    runs = line.withColumn("runs", F.flatten(F.transform(F.sequence(F.lit(1), F.size("hit") - need + 1), run))).filter(F.size("runs") > 0)
    slots = F.array_distinct(F.flatten(F.transform("runs", lambda h: h["pairs"])))
    found = (runs.withColumn("slots", slots).withColumn("found", F.array_distinct(F.transform("runs", lambda h: h["at"])))
             .groupBy("doc_id", "item_id", "item_windows")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_hits"), F.max(F.size("slots")).alias("n_slots"),
                  F.min(F.size(F.filter("slots", lambda p: p["item"] != p["doc"]))).alias("changed"))
             .select("doc_id", "item_id", "n_hits", F.col("item_windows").alias("n_windows"), "n_slots", "changed"))
    short = short_items(docs, benchmark)
    if short is None:
        return found
    zero, one = F.lit(0), F.lit(1)
    return found.unionByName(short.select("doc_id", "item_id", one.alias("n_hits"), one.alias("n_windows"), zero.alias("n_slots"), zero.alias("changed")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their columns as they are."""
    bad = store(contaminated(docs, benchmark).select("doc_id").distinct(), "decon-bad")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
