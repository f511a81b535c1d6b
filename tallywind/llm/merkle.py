"""Merkle manifest of a dataset by nested-struct rollup.

Rows become leaves (a SHA-256 over their fields), leaves are ranked inside their tree, and a
rank is written as digits to the base 3. Digits of a bounded block of ranks (3^6 leaves) are
columns; they are grouped away one after the other, the last first, so that a node is a struct
that holds its children and a block becomes one row of nested structs. Its leaves and their
proofs come out of that row by ``transform`` and ``explode``: no leaf is joined with a node. All groupings of a
block run on one shuffle by (tree, block).

A block's row is large (some 150 KB, with all proofs over a megabyte) and readers take thousands of rows at a
time, so a file holds some TASK_BLOCKS blocks at every size of the table, and rows with proofs are never stored:
they are made where leaves are exploded.

The roots of a tree's blocks are ranked already and roll up in the same way, so a tree of n
leaves takes ``log_729(n)`` passes of which each is 729 times smaller than the one before. What a
block needs from above is attached to the block's row, not to its leaves. The trees' roots are leaves of one more tree.

Ranks come from a range shuffle (:func:`tallywind.operators.ranking.with_position`), so a source
with most of the rows is no single task.

Defined cases: a null field is ``-`` in a leaf; a null source is a tree of its own, first in
order; null doc_ids come first; rows with equal doc_ids stand in the order of their leaf hashes,
equal rows are leaves of their own with equal hashes; texts of any length are hashed whole; a
lone leaf is its tree's root and a lone tree's root is the root; an empty table gives an empty
result. Columns other than the fields take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.operators.ranking import with_position

from .common import store

ARITY = 3
#: Digits of a block: a row holds at most 3^6 = 729 leaves.
BLOCK_DIGITS = 6
#: Blocks a task rolls up and a file of them holds, about.
TASK_BLOCKS = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:string,after:string>>"


def digest(value: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of a row: each field as byte count, colon and value, or a dash if null."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return digest(F.concat(*parts))


def depth_of(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: digits of its last rank, none for a lone leaf."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, ARITY))).otherwise(0)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings in its proof."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof_digest(proof: Column) -> Column:
    """One hash over all siblings of a proof, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def _siblings(kids: Column, i: Column) -> Column:
    hashes = F.transform(kids, lambda k: k["hash"])
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before"),
                    F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("after"))


def _proofs(kids: Column, level: int, first_level: int, depth: Column, above: Column) -> Column:
    """(item, proof) of all leaves under ``kids``; ``above`` is the proof of their parent."""

    def one(k: Column, i: Column) -> Column:
        real = F.lit(first_level + level) <= depth
        here = F.when(real, F.concat(F.array(_siblings(kids, i)), above)).otherwise(above)
        if level == 1:
            return F.array(F.struct(k["item"].alias("item"), here.alias("proof")))
        return _proofs(k["kids"], level - 1, first_level, depth, here)

    return F.flatten(F.transform(kids, one))


def _roll_up(nodes: DataFrame, first_level: int, total: int) -> DataFrame:
    """Blocks of ``nodes`` (tree, rank, depth, hash, item), ``total`` of them about, as rows: tree, block,
    depth, hash and the nested ``kids``. A level above the tree's root hands its only child on."""
    size = ARITY ** BLOCK_DIGITS
    digits = [f"d{i}" for i in range(1, BLOCK_DIGITS + 1)]
    rows = nodes.select(
        "tree", F.floor(F.col("rank") / size).alias("block"), "depth",
        *[(F.floor(F.col("rank") / ARITY ** i) % ARITY).cast("int").alias(d) for i, d in enumerate(digits)],
        "hash", "item")
    # A number that follows the leaves: tasks merged by shuffled bytes would hold ever more blocks.
    rows = rows.repartition(1 + total // (size * TASK_BLOCKS), "tree", "block")
    child = ["hash", "item"]
    for i, d in enumerate(digits):
        real = F.lit(first_level + i + 1) <= F.col("depth")
        rows = (rows.groupBy("tree", "block", "depth", *digits[i + 1:])
                .agg(F.sort_array(F.collect_list(F.struct(d, *child))).alias("kids"))
                .withColumn("hash", F.when(real, digest(F.array_join(F.transform("kids", lambda k: k["hash"]), "")))
                            .otherwise(F.col("kids")[0]["hash"])))
        child = ["hash", "kids"]
    return rows


def prove(nodes: DataFrame, most: int, total: int, first_level: int = 0) -> DataFrame:
    """Root and proof of every leaf of every tree.

    ``nodes`` has tree (any value, may be null), rank (from 0), depth (of the tree), hash and
    item (what names the leaf); ``most`` is the largest depth among the trees, ``total`` the number
    of leaves. Returns tree, root and ``leaves``, an array of (item, proof), one row per block of leaves.
    Rows are made as they are read: explode ``leaves``, do not store them.
    """
    blocks = store(_roll_up(nodes, first_level, total), "merkle-blocks")
    if most <= first_level + BLOCK_DIGITS:
        whole = blocks.withColumn("root", F.col("hash")).withColumn("above", F.array().cast(PROOF))
    else:
        upper = prove(blocks.select("tree", F.col("block").alias("rank"), "depth", "hash", F.col("block").alias("item")),
                      most, total // ARITY ** BLOCK_DIGITS, first_level + BLOCK_DIGITS)
        upper = (upper.select(F.col("tree").alias("of"), "root", F.explode("leaves").alias("leaf"))
                 .select("of", F.col("leaf.item").alias("at"), "root", F.col("leaf.proof").alias("above")))
        whole = blocks.join(upper, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
    return whole.select("tree", "root", _proofs(F.col("kids"), BLOCK_DIGITS, first_level, F.col("depth"), F.col("above")).alias("leaves"))


def _ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int, int]:
    """``rows`` (tree, hash, item and what ``order`` uses) with rank and depth in their tree; the
    largest depth; the number of rows."""
    placed = with_position(rows, [F.col("tree").asc_nulls_first(), *order])
    sizes = store(placed.groupBy("tree").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
                  .select(F.col("tree").alias("of"), "first", "n", depth_of(F.col("n")).alias("depth")), "merkle-trees")
    most, total = sizes.agg(F.max("depth"), F.sum("n")).first()
    nodes = (placed.join(sizes, F.col("tree").eqNullSafe(F.col("of")))
             .select("tree", (F.col("position") - F.col("first")).alias("rank"), "depth", "hash", "item"))
    return nodes, most or 0, total or 0


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "source", key: str = "doc_id",
             extra: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``docs``: key, tree, leaf, subroot (root of the row's tree), root and
    proof, the siblings (before, after) level by level from the leaf through the subroot to the
    root. ``extra`` are further columns, computed from ``docs``, to keep with a leaf."""
    extra = extra or {}
    leaves = store(docs.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"),
                               leaf_hash([F.col(f) for f in fields]).alias("hash"),
                               F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in extra.items()]).alias("extra"))
                   .withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    rows = leaves.select("tree", "hash", "key", "row", F.struct("key", F.col("hash").alias("leaf"), "extra").alias("item"))
    nodes, most, total = _ranked(rows, [F.col("key").asc_nulls_first(), F.col("hash"), F.col("row")])
    blocks = prove(nodes, most, total)

    roots = store(blocks.groupBy("tree").agg(F.first("root").alias("hash")), "merkle-subroots")
    tops, most, total = _ranked(roots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "hash", F.col("tree").alias("item")),
                                [F.col("name").asc_nulls_first()])
    top = (prove(tops, most, total).select("root", F.explode("leaves").alias("leaf"))
           .select(F.col("leaf.item").alias("of"), F.col("root").alias("top"), F.col("leaf.proof").alias("rest")))
    out = (blocks.join(top, F.col("tree").eqNullSafe(F.col("of")))
           .select("tree", F.col("root").alias("subroot"), F.col("top").alias("root"), "rest", F.explode("leaves").alias("leaf")))
    return out.select(F.col("leaf.item.key").alias(key), F.col("tree").alias(tree), F.col("leaf.item.leaf").alias("leaf"), "subroot", "root",
                      F.concat(F.col("leaf.proof"), F.col("rest")).alias("proof"),
                      *[F.col("leaf.item.extra")[n].alias(n) for n in extra])


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` and its verification after a tampering that deletes the line breaks
    of texts with an even CRC-32 of the doc_id (none for a null doc_id)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    torn = F.when(hit, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    found = leaf_hash([torn if f == "text" else F.col(f) for f in FIELDS])
    out = manifest(docs, extra={"found": F.when(hit & F.col("text").contains("\n"), found)})
    out = out.withColumn("folded_root", fold(F.coalesce("found", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same in DuckDB's SQL: trees level by level, proofs leaf by leaf.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ord(substr(CAST(doc_id AS VARCHAR), i, 1))::UBIGINT),
      lambda crc, b: list_reduce(range(8)::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END,
        xor(crc, b)), 4294967295::UBIGINT) AS crc
  FROM documents),
f AS (
  SELECT doc_id, source,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS torn
  FROM base),
leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(torn) || ':' || torn, '-')) AS found FROM f),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM leaf),
up AS (
  SELECT source, 0 AS lvl, idx, leaf AS h, n FROM ranked
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1
  GROUP BY source, lvl, idx // 3, n),
subroot AS (SELECT source, h AS subroot FROM up WHERE n = 1),
tops AS (SELECT source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM subroot),
upper AS (
  SELECT 0 AS lvl, idx, subroot AS h, n FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM upper WHERE n > 1
  GROUP BY lvl, idx // 3, n),
sib AS (
  SELECT a.source, a.lvl, a.idx,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY a.source, a.lvl, a.idx),
topsib AS (
  SELECT a.lvl, a.idx,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
walk AS (
  SELECT source, idx AS at, 0 AS lvl, idx, n, found AS h, '' AS acc FROM ranked
  UNION ALL
  SELECT w.source, w.at, w.lvl + 1, w.idx // 3, (w.n + 2) // 3, sha256(s.before || w.h || s.after), w.acc || s.before || s.after
  FROM walk w JOIN sib s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.idx = s.idx WHERE w.n > 1),
climb AS (
  SELECT w.source, w.at, 0 AS lvl, t.idx, t.n, w.h, w.acc FROM walk w JOIN tops t ON w.source IS NOT DISTINCT FROM t.source WHERE w.n = 1
  UNION ALL
  SELECT w.source, w.at, w.lvl + 1, w.idx // 3, (w.n + 2) // 3, sha256(s.before || w.h || s.after), w.acc || s.before || s.after
  FROM climb w JOIN topsib s ON w.lvl = s.lvl AND w.idx = s.idx WHERE w.n > 1)
SELECT r.doc_id, r.leaf, t.subroot, u.h AS root, sha256(c.acc) AS proof_sha256, c.h AS folded_root, c.h = u.h AS verified
FROM ranked r JOIN tops t ON r.source IS NOT DISTINCT FROM t.source
JOIN climb c ON c.n = 1 AND c.source IS NOT DISTINCT FROM r.source AND c.at = r.idx
JOIN upper u ON u.n = 1
"""
