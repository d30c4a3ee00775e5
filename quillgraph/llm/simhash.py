"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit majority votes over shingle hashes. Distinct fingerprints are tiled by
the population counts of their sub-words. The summed difference of the counts bounds the
Hamming distance from below, so only tile pairs within the radius are compared; the others are
skipped unseen. A tile pair is compared exactly, in blocks, by numpy exclusive-or and bit
counts. Tiles of more than ``TILE`` fingerprints are cut into parts and every pair of parts is
a task of its own. Each task returns a spanning forest of its links, never all pairs; the
forests join by distributed connected components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROW, numbered, public_id, row_id, stored, tidy, without_rows
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a part of a tile: 256 KB.
TILE = 32768
#: Numbers of sub-words to choose from.
SUB_WORDS = (4, 6, 8)


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    h = xxhash.xxh64_intdigest
    return np.array([h(b" ".join(g), SEED) for g in zip(*(words[i:] for i in range(n)))], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; none: 0. In blocks, so memory stays bounded."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > len(hashes)).astype(object)).sum()) if len(hashes) and (2 * ones > len(hashes)).any() else 0


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(x.as_py(), n)) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64)), batch.column(ROW)], names=["doc_id", "fp", ROW])
        tidy()

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Numbered docs(doc_id, text) -> doc_id, fp (the 64 bits as a signed long), number. Null text: empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_id(), text.alias("text"), ROW).mapInArrow(_fingerprints(shingle), f"doc_id long, fp long, {ROW} long")


def _offsets(radius: int, cuts: int) -> list[tuple[int, ...]]:
    """Count differences within the radius, one of each opposite pair, without no difference."""
    found = itertools.product(range(-radius, radius + 1), repeat=cuts)
    return [o for o in found if sum(map(abs, o)) <= radius and o > (0,) * cuts]


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links between left and right (None: inside left), as each point's tie to its component's first."""
    points = left if right is None else np.concatenate([left, right])
    label = np.arange(len(points))
    other, shift = (left, 0) if right is None else (right, len(left))
    for i in range(0, len(left), block):
        for j in range(i if right is None else 0, len(other), block):
            near = np.bitwise_count(left[i : i + block, None] ^ other[None, j : j + block]) <= radius
            if right is None and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            x, y = x + i, y + j + shift
            while len(x):
                p, q = label[x], label[y]
                apart = p != q
                x, y, p, q = x[apart], y[apart], p[apart], q[apart]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label[label] != label).any():
                    label = label[label]
    tied = np.flatnonzero(label != np.arange(len(points)))
    return points[tied].view(np.int64), points[label[tied]].view(np.int64)


def _compare(radius: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, p, q = (x.as_py() for x in key)
        fps = table.column("fp").to_numpy().view(np.uint64)
        role, part = table.column("role").to_numpy(), table.column("part").to_numpy()
        own = fps[role == 0]
        if q < 0:
            a, b = _forest(own, fps[role == 1], radius)
        elif p == q:
            a, b = _forest(own, None, radius)
        else:
            a, b = _forest(fps[part == p], fps[part == q], radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def widths(cuts: int) -> tuple[int, ...]:
    """Widths of that many sub-words of 64 bits."""
    return tuple(64 // cuts + (i < 64 % cuts) for i in range(cuts))


def _tiles(prints: DataFrame, radius: int, tile: int, cuts: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct fp -> (fp, tile), (tile, n, parts), and the pairs of neighbour tiles within the radius that exist."""
    at, counts = 0, []
    for width in cuts:
        counts.append(F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(((1 << width) - 1) << at)))).cast("long"))
        at += width
    # Digits base 128: a sum with an offset never carries, as counts and offsets are below 64.
    keyed = prints.select("fp", sum((c + radius) * 128**i for i, c in enumerate(counts)).alias("tile"))
    tiles = keyed.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    steps = [sum(d * 128**i for i, d in enumerate(o)) for o in _offsets(radius, len(cuts))]
    pairs = tiles.select(F.col("tile").alias("other"), F.col("n").alias("other_n"), F.col("parts").alias("other_parts"), F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"))
    return keyed, tiles, pairs.withColumn("tile", F.col("other") + F.col("step")).drop("step").join(tiles, "tile")


def predicted_rows(prints: DataFrame, radius: int, tile: int, cuts: tuple[int, ...]) -> tuple[int, int]:
    """Fingerprints, and the rows that ``dealt`` makes of them, from the sizes of the tiles alone."""
    _, tiles, pairs = _tiles(prints, radius, tile, cuts)
    inside = tiles.select(F.col("n"), (F.col("n") * F.col("parts")).alias("rows"))
    across = pairs.groupBy("tile", "n", "parts").agg(F.max("other_parts").alias("qs"), F.sum("other_n").alias("near")).select(F.lit(0).alias("n"), (F.col("n") * F.col("qs") + F.col("parts") * F.col("near")).alias("rows"))
    n, rows = inside.unionByName(across).agg(F.sum("n"), F.sum("rows")).first()
    return n or 0, rows or 0


def choose_cuts(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> tuple[int, ...]:
    """Widths of the fewest sub-words that deal a fingerprint out no more often than more of them do at best, which is
    once inside its tile, once to its neighbours and once to each of them. Any choice gives the same components."""
    for k, more in zip(SUB_WORDS, SUB_WORDS[1:]):
        n, rows = predicted_rows(prints, radius, tile, widths(k))
        if rows <= n * (len(_offsets(radius, more)) + 2):
            return widths(k)
    return widths(SUB_WORDS[-1])


def dealt(prints: DataFrame, radius: int, tile: int, cuts: tuple[int, ...]) -> DataFrame:
    """Distinct fp -> tile, p, q, role, part, fp: every fingerprint in each group of tile parts that compares it."""
    keyed, tiles, pairs = _tiles(prints, radius, tile, cuts)
    own = keyed.join(tiles.drop("n"), "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # Inside a tile: every pair of parts is a task.
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")))
    inside = own.select("tile", "fp", "part", F.explode(mates).alias("t")).select("tile", "t.p", "t.q", F.lit(0).alias("role"), "part", "fp")
    # Neighbour tiles: (part p here, part q of each of them) is a task.
    needed = pairs.groupBy("tile").agg(F.max("other_parts").alias("qs"))
    here = own.join(needed, "tile").select("tile", F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(0).alias("role"), "part", "fp")
    there = own.select(F.col("tile").alias("other"), "fp", "part").join(pairs.select("tile", "parts", "other"), "other")
    there = there.select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("part").alias("q"), F.lit(1).alias("role"), "part", "fp")
    return inside.unionByName(here.unionByName(there).withColumn("q", -1 - F.col("q")))


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, cuts: tuple[int, ...] = (16, 16, 16, 16)) -> DataFrame:
    """Distinct fp -> a, b: ties whose components are those of all links within ``radius``."""
    return dealt(prints, radius, tile, cuts).groupBy("tile", "p", "q").applyInArrow(_compare(radius), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint, component_id, keep: one row per row.

    Documents without words have fingerprint zero and link like any other. component_id is the
    least doc_id reachable over links of ``radius`` bits or fewer; a null doc_id counts as the
    least and is given back as null. One row of each component is kept: the least doc_id, of rows that share it one. An
    empty table gives no rows.
    """
    return _components(numbered(docs), radius, shingle, tile).drop(ROW)


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row of each component of ``docs``, with all its columns."""
    rows = numbered(docs)
    return without_rows(rows, _components(rows, radius, shingle, tile).where("not keep"))


def _components(docs: DataFrame, radius: int, shingle: int, tile: int) -> DataFrame:
    prints = stored(fingerprints(docs, shingle), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min(F.struct("doc_id", ROW)).alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius, tile, choose_cuts(nodes.select("fp"), radius, tile)), "a", "b")
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    out = prints.join(named.join(least, "root").select("fp", "least"), "fp")
    return out.select(
        public_id("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), public_id("least.doc_id").alias("component_id"), (F.col(ROW) == F.col(f"least.{ROW}")).alias("keep"), ROW
    )
