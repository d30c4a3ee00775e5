"""Merkle manifest of a dataset: a tree a stratum over the rows' digests, a root over the strata, and a proof for each row.

A leaf is the SHA-256 of a row's fields, each with its length before it. Within a stratum leaves ascend by id; every two
consecutive nodes become one, a last one without a partner too, until one is left: the stratum's root. Strata, in
the byte order of their names (null first), are joined likewise. Digests are hashed as hex text.

Nodes get their places by a range sort (``placed``), so no task holds a stratum. A round (``_round``) cuts each tree into
aligned blocks of ``2 ** BLOCK`` nodes and walks each block in postorder: a visit returns its subtree's digest and, while it unwinds,
appends the digest beside it to the path of every leaf that it holds. The blocks' roots are the nodes of the next round;
three or four rounds cover 10^12 rows. Paths of upper rounds are then joined downwards, one row a block.

Cases: a null field is ``-``, unlike an empty one; a null id orders first; rows that share an id are ordered by their leaf, and equal
leaves by where they stand, which no root shows, but gives them paths of their own; a stratum of one row is its own root; an
empty table gives no rows; other columns aren't read unless they are named to be carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW, numbered, stored

#: A block holds ``2 ** BLOCK`` nodes.
BLOCK = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its text, or ``-`` if null. Whole numbers are decimals."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(tree, ...) plus pos, the place from 0 within the tree by ``order``, and size, the nodes of the tree.

    Rows are dealt by range and counted where they lie; a table of one row a part and tree says how many stand before.
    ``order`` has to tell rows apart, or a large tie lands in one part.
    """
    dealt = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            if not len(tree):
                continue
            new = np.flatnonzero(np.concatenate([[tree[0] != last], tree[1:] != tree[:-1]]))
            local = np.arange(len(tree)) + n
            for at in new:
                local[at:] = np.arange(len(tree) - at)
            last, n = tree[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(tree), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"])

    held = stored(dealt.mapInArrow(count, f"{fields}, part int, local bigint"), "placed")
    counts = held.groupBy("tree", "part").agg((F.max("local") + 1).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = counts.select("tree", "part", before.alias("before"), F.sum("n").over(tree).alias("size"))
    return held.join(counts, ["tree", "part"]).select(*nodes.columns, (F.col("before") + F.col("local")).alias("pos"), "size")


def joined(left: bytes, right: bytes = b"") -> bytes:
    return hashlib.sha256((left.hex() + right.hex()).encode()).digest()


def walk(digests: list[bytes], height: int) -> tuple[bytes, list[list[bytes]]]:
    """Root and, for each leaf, its path: on every level the digest beside it behind ``L`` or ``R`` for its side, or nothing."""
    n, paths = len(digests), [[] for _ in digests]

    def visit(first: int, level: int) -> bytes:
        if not level:
            return digests[first]
        middle, end = first + (1 << level - 1), min(n, first + (1 << level))
        left = visit(first, level - 1)
        if middle >= n:  # it has no partner
            for path in paths[first:end]:
                path.append(b"")
            return joined(left)
        right = visit(middle, level - 1)
        for path in paths[first:middle]:
            path.append(b"R" + right)
        for path in paths[middle:end]:
            path.append(b"L" + left)
        return joined(left, right)

    return visit(0, height), paths


def _round(nodes: DataFrame, carried: list[str], bits: int) -> tuple[DataFrame, DataFrame]:
    """nodes(tree, pos, size, digest, carried) -> (tree, block, pos, path, carried) written, and the next round's nodes."""
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in carried)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pos")
        size, pos = table.column("size")[0].as_py(), table.column("pos")
        height = bits if size > 1 << bits else (size - 1).bit_length()
        root, paths = walk(table.column("digest").to_pylist(), height)
        columns = {c: table.column(c) for c in ("tree", "block", "pos", "size")} | {"path": pa.array(paths, pa.list_(pa.binary())), "root": pa.array([root] + [None] * (len(paths) - 1), pa.binary())}
        return pa.table(columns | {c: table.column(c) for c in carried})

    blocks = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "size", "digest", *carried)
    out = stored(blocks.groupBy("tree", "block").applyInArrow(run, f"tree string, block bigint, pos bigint, size bigint, path array<binary>, root binary{kinds}"), "merkle")
    up = out.where("root is not null").select("tree", F.col("block").alias("pos"), F.shiftright(F.col("size") + ((1 << bits) - 1), bits).alias("size"), F.col("root").alias("digest"))
    return out, up


def _climb(nodes: DataFrame, carried: list[str], bits: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds until every tree is one node -> what each round wrote, and (tree, digest) of the roots."""
    most = nodes.agg(F.max("size")).first()[0] or 1
    rounds = []
    while True:
        out, nodes = _round(nodes, [] if rounds else carried, bits)
        rounds.append(out)
        if most <= 1 << bits:
            return rounds, nodes.select("tree", "digest")
        most = (most + (1 << bits) - 1) >> bits


def _descend(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """above(tree, path, ...), a row a tree: its path behind those of the rounds -> (tree, pos, path, ..., carried) a first node."""
    rest = [c for c in above.columns if c not in ("tree", "path")]
    up = above.withColumn("pos", F.lit(0).cast("long"))
    for i, out in enumerate(reversed(rounds)):
        own = carried if i + 1 == len(rounds) else []
        up = up.withColumnsRenamed({"pos": "block", "path": "_above"})
        up = out.drop("size", "root").join(up, ["tree", "block"]).select("tree", "pos", F.concat("path", "_above").alias("path"), *rest, *own)
    return up


def manifest(leaves: DataFrame, carried: tuple[str, ...] = (), bits: int = BLOCK) -> DataFrame:
    """leaves(tree, doc_id, leaf, carried) -> tree, doc_id, leaf, carried, pos, path, subroot, root.

    ``path`` is the row's proof, level by level up to the root: a digest behind ``L`` or ``R`` for its side, or nothing where the node
    had no partner.
    """
    kept = ["doc_id", "leaf", *carried]
    # Null is a tree of its own, before all others.
    named = F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("t"), F.col("tree").cast("string")))
    rows = numbered(stored(leaves.select(named.alias("tree"), *kept), "leaves"))
    nodes = placed(rows, ["doc_id", "leaf", ROW]).withColumn("digest", F.col("leaf"))
    rounds, subroots = _climb(nodes, kept, bits)
    trees = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    over, root = _climb(trees.withColumn("subroot", F.col("digest")), ["name", "subroot"], bits)
    top = root.select("tree", F.array().cast("array<binary>").alias("path"), F.col("digest").alias("root"))
    above = _descend(over, top, ["name", "subroot"]).select(F.col("name").alias("tree"), "path", "subroot", "root")
    out = _descend(rounds, above, kept)
    return out.select(F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("tree"), *kept, "pos", "path", "subroot", "root")


PROVED = "proof_sha256 string, folded_root string, verified boolean"


def verified(proofs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """proofs(leaf, path, root, carried), where ``leaf`` is what a row hashes to now -> carried, proof_sha256, folded_root, verified.

    The proof's digest covers the siblings alone, in the order of the path.
    """
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in proofs.select(*carried).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof, folded, good = [], [], []
            for digest, path, root in zip(*(batch.column(c).to_pylist() for c in ("leaf", "path", "root"))):
                proof.append(hashlib.sha256("".join(x[1:].hex() for x in path).encode()).hexdigest())
                for x in path:
                    digest = joined(x[1:], digest) if x[:1] == b"L" else joined(digest, x[1:])
                folded.append(digest.hex())
                good.append(digest == root)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array(good, pa.bool_())], names=[*carried, "proof_sha256", "folded_root", "verified"])

    return proofs.select("leaf", "path", "root", *[c for c in carried if c not in ("leaf", "path", "root")]).mapInArrow(run, kinds + PROVED)


def manifest_of(documents: DataFrame, tree: str = "lang", bits: int = BLOCK) -> DataFrame:
    """The manifest of documents(doc_id, source, lang, n_chars, text)."""
    fields = {c: F.col(c) for c in FIELDS}
    return manifest(documents.select(F.col(tree).alias("tree"), "doc_id", leaf(list(fields.values())).alias("leaf")), bits=bits)


def tamper_report(documents: DataFrame, bits: int = BLOCK) -> DataFrame:
    """documents(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256 of the rows as they are, and
    folded_root, verified after one was added to n_chars of those whose id's CRC-32 seven divides (null ids and null counts stay)."""
    fields = {c: F.col(c) for c in FIELDS}
    more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = documents.select(F.col("lang").alias("tree"), "doc_id", leaf(list(fields.values())).alias("leaf"), F.when(hit, leaf(list(more.values()))).alias("changed"))
    made = manifest(rows, ("changed",), bits)
    now = made.select("doc_id", F.lower(F.hex("leaf")).alias("was"), F.coalesce("changed", "leaf").alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), "path", "root", F.lower(F.hex("root")).alias("root_hex"))
    out = verified(now, ("doc_id", "was", "subroot", "root_hex"))
    return out.select("doc_id", F.col("was").alias("leaf"), "subroot", F.col("root_hex").alias("root"), "proof_sha256", "folded_root", "verified")


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
ORACLE = f"""
WITH RECURSIVE
crc_t AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([CAST(n AS BIGINT)] || CAST(range(8) AS BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT *, n_chars AS was, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM documents),
e AS (SELECT * EXCLUDE (bytes, t), xor(list_reduce([4294967295] || bytes, lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) % 7 = 0 AS hit FROM d, crc_t),
l0 AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE 't' || lang END AS tree, {_LEAF} AS leaf, CASE WHEN hit AND was IS NOT NULL THEN sha256({" || ".join(_FIELD.format(c if c != "n_chars" else "(CAST(n_chars AS HUGEINT) + 1)") for c in FIELDS)}) END AS changed FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM l0),
node AS (
  SELECT tree, 0 AS level, pos, size, leaf AS digest FROM l
  UNION ALL SELECT tree, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE size > 1 GROUP BY tree, level, pos // 2, size),
sub AS (SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, count(*) OVER () AS trees FROM node WHERE size = 1),
top AS (
  SELECT 0 AS level, rank AS pos, trees AS size, subroot AS digest FROM sub
  UNION ALL SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY level, pos // 2, size),
root AS (SELECT digest AS root, level AS height FROM top WHERE size = 1),
path AS (
  SELECT l.tree, l.pos, n.level, l.pos >> n.level AS own, n.digest AS sibling FROM l JOIN node n ON n.tree = l.tree AND n.size > 1 AND n.pos = xor(l.pos >> n.level, 1)
  UNION ALL SELECT l.tree, l.pos, s.height + t.level, s.rank >> t.level, t.digest FROM l JOIN sub s ON s.tree = l.tree JOIN top t ON t.size > 1 AND t.pos = xor(s.rank >> t.level, 1)),
fold AS (
  SELECT l.tree, pos, 0 AS level, s.height + r.height AS height, coalesce(changed, leaf) AS digest FROM l JOIN sub s USING (tree), root r
  UNION ALL SELECT f.tree, f.pos, f.level + 1, f.height, sha256(CASE WHEN p.sibling IS NULL THEN f.digest WHEN p.own % 2 = 1 THEN p.sibling || f.digest ELSE f.digest || p.sibling END)
    FROM fold f LEFT JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND p.level = f.level WHERE f.level < f.height)
SELECT doc_id, leaf, subroot, root, coalesce((SELECT sha256(string_agg(sibling, '' ORDER BY level)) FROM path p WHERE p.tree = l.tree AND p.pos = l.pos), sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = root AS verified
FROM l JOIN sub USING (tree) CROSS JOIN root JOIN fold f ON f.tree = l.tree AND f.pos = l.pos AND f.level = f.height
"""
