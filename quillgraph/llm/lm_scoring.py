"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A token is coded as bits: whether it is a known word, then the bits of its bucket's code (a
Huffman code over hash buckets of words), then its share of its bucket; an unknown word is
spelt byte by byte, again in bits. Each code bit is predicted in several hashed contexts: no
context, the word before, the endings of the two words before, and the last words that
followed the same one and two words in this document. The predictions are mixed in the
logistic domain by weights that a gate selects, and the weights are refined after every bit
they predict. The product is a probability of the whole text; its logarithm gives the score
and the bits a byte.

The byte bits are mixed alike, by weights that a gate selects and that are refined after every
bit of the word.

Jobs: (1) every task turns its documents into units of at most ``UNIT`` tokens, written to the
shared folder as arrays, with the sorted vocabulary of each unit by hash range and the task's
context counts; (2) the units' vocabularies are merged by hash range, so that each word's exact
count over all training documents returns to each unit that holds it, and each word is spelt once; no
vocabulary is ever in one place; (3) context counts of fixed size are summed and broadcast; (4) units are
scored. Words are told apart by 64-bit hashes. Every sum is one of whole numbers, and every run of a document's tokens starts
from the same weights, so the scores don't depend on how the table is cut into files or tasks.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, input_bytes, public_id, row_id, stored, tidy
from ._tokens import mix, words

FOLDS = 10
UNIT = 1_000_000
BUCKETS = 2048
CLASSES = 1024
CONTEXTS = 3
#: Slots of the byte contexts of one, two and three bytes.
SPELL = (256, 4096, 16384)
SPELL_CELLS = sum(SPELL) * 256
LANE = 384
#: The step of the weights falls from ``FAST + RATE`` at a lane's start to ``RATE``, by half of the difference after ``SETTLED`` tokens.
RATE, FAST, SETTLED = 0.02, 0.08, 64
SPELL_RATE = 0.002
ARRAYS = ("ids", "vocabulary", "ending")
PARTS = 16
#: Blobs of a table's part that one merge takes.
MERGED = 256
END = np.uint64(0x9E3779B97F4A7C15)
INPUTS = 6
GATES = 4
#: Weight of a word's corpus share against its count in the document so far.
SHARE = 8.0
SPELL_GATES = 3
MIXED = "kind int, unit long, part long, payload binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("unit", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])


def held_out(doc_id: int, folds: int = FOLDS) -> bool:
    return doc_id != NULL_ID and zlib.crc32(str(doc_id).encode()) % folds == 0


def _squeeze(a: np.ndarray) -> tuple[str, bytes]:
    """An array's bytes, by significance, compressed: small numbers leave whole runs of zeros."""
    a = np.ascontiguousarray(a)
    return a.dtype.str, zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _swell(packed: tuple[str, bytes]) -> np.ndarray:
    kind, raw = packed
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).tobytes(), kind)


def _sorted_out(a: np.ndarray) -> tuple[str, bytes]:
    return _squeeze(np.diff(a, prepend=a[:1] * 0))


def _sorted_in(packed: tuple[str, bytes]) -> np.ndarray:
    a = _swell(packed)
    return np.cumsum(a, dtype=a.dtype)


def _row(kind: int, unit: int, part: int, payload: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((kind, unit, part, pickle.dumps(payload, 5)), _SCHEMA)], schema=_SCHEMA)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.uint32) % np.uint32(BUCKETS)).astype(np.int32)


def contexts(ids: np.ndarray, firsts: np.ndarray, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Context classes of every token: word before, its ending, the ending of the one before that. A text's first token sees nothing."""
    word = np.append((h.astype(np.uint32) >> np.uint32(11)) % np.uint32(CLASSES - 1) + 1, 0).astype(np.int32)
    last = np.append(ending.astype(np.int32) + 1, 0).astype(np.int32)
    none = len(h)
    one = np.concatenate([[none], ids[:-1]])
    one[firsts] = none
    two = np.concatenate([[none], one[:-1]])
    two[firsts] = none
    return np.stack([word[one], last[one], last[two]])


def _spelling(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words and a final space, and the rows of their hashed contexts of one, two and three bytes."""
    size = ends - starts + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(starts, size) + at
    final = at == np.repeat(size - 1, size)
    byte = np.where(final, 32, low[np.minimum(place, max(len(low) - 1, 0))] if len(low) else 32).astype(np.int64)
    before = []
    for far in (1, 2, 3):
        x = np.concatenate([np.full(far, 32), byte])[: len(byte)]
        x[at < far] = 32
        before.append(x)
    one, two, three = before
    rows = (one, SPELL[0] + (two * 256 + one) * 40503 % 65537 % SPELL[1], SPELL[0] + SPELL[1] + ((three * 256 + two) * 256 + one) * 2654435761 % 2**32 % SPELL[2])
    return byte, np.stack(rows)


def _unit(rows: list[tuple[int, bytes]], train: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Documents as one unit: its arrays, its sorted vocabulary, counts in the documents that ``train`` marks, the words, the context cells to count in."""
    sizes = [len(t) for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    low, starts, ends, h, owner = words(np.frombuffer(b"".join(t for _, t in rows), np.uint8), offsets)
    per = np.bincount(owner, minlength=len(rows)) + 1  # and the end token
    lasts = np.cumsum(per) - 1
    every = np.full(per.sum(), END)
    inner = np.ones(len(every), bool)
    inner[lasts] = False
    every[inner] = h
    vocabulary, first, ids = np.unique(every, return_index=True, return_inverse=True)
    ids = ids.astype(np.int32)
    word = (np.cumsum(inner) - 1)[first]  # token -> word
    real = inner[first]
    word[~real] = 0
    ending = np.full(len(vocabulary), 7)
    if len(h):
        e, s = ends[word], starts[word]
        ending = np.where(real, low[e - 1].astype(np.int32) * 263 + np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0) * 31, 7) % (CLASSES - 1)
    mask = np.repeat(train, per)
    counts = np.bincount(ids[mask], minlength=len(vocabulary)).astype(np.int64)
    near = contexts(ids, np.cumsum(per) - per, vocabulary, ending)
    spelt = [low[starts[w] : ends[w]].tobytes() if r else b"" for w, r in zip(word.tolist(), real.tolist())]
    text = {int(i): spelt[i] for i in np.flatnonzero(real & (counts == 0))}
    unit = {"docs": [d for d, _ in rows], "bytes": sizes, "per": per, "ids": ids, "vocabulary": vocabulary.astype(np.uint32), "ending": ending.astype(np.int16), "text": text}
    return unit, vocabulary, counts, spelt, _cells(near, _bucket(vocabulary)[ids], mask)


def _by_range(unit: int, vocabulary: np.ndarray, counts: np.ndarray, spelt: list[bytes], parts: int) -> Iterator[tuple[int, int, int, object]]:
    """The unit's vocabulary cut by hash range: at most as many rows as words."""
    part = (vocabulary >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64)
    borders = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(borders[:-1], borders[1:]):
        yield 1, unit, int(part[a]), (_sorted_out(vocabulary[a:b]), _squeeze(counts[a:b].astype(np.int32)), int(a), zstandard.compress(b" ".join(spelt[a:b]), 1))


def _tokens_at_most(text: bytes) -> int:
    """About a text's tokens by its bytes; more where white space shows that its words may be shorter."""
    return max(len(text) // 6, sum(text.count(x) for x in b"\t\n\v\f\r ")) + 2


def _gather(folds: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() + 1) << 24
        table = np.zeros(CONTEXTS * CLASSES * BUCKETS, np.int32)
        held: list[tuple[int, bytes]] = []

        def unit_of(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            unit, vocabulary, counts, spelt, cells = _unit(rows, np.array([not held_out(d, folds) for d, _ in rows]))
            np.add.at(table, cells, 1)
            yield _row(0, number, 0, unit | {k: _squeeze(unit[k]) for k in ARRAYS})
            for row in _by_range(number, vocabulary, counts, spelt, parts):
                yield _row(*row)
            number += 1

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                held.append((doc, text.as_py()))
                size += _tokens_at_most(held[-1][1])
                if size >= UNIT:
                    yield from unit_of(held)
                    held, size = [], 0
        if held:
            yield from unit_of(held)
        yield from _cell_rows(2, TaskContext.get().partitionId(), table)
        held = table = None
        tidy()

    return run


def _cell_rows(kind: int, unit: int, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table of counts in ``PARTS`` blocks, its zeros left out."""
    step = -(-len(cells) // PARTS)
    for p in range(PARTS):
        block = cells[p * step : (p + 1) * step]
        at = np.flatnonzero(block)
        if len(at):
            yield _row(kind, unit, p, (_sorted_out(at.astype(np.uint32)), _squeeze(block[at])))


def _merge_range(table: pa.Table) -> pa.Table:
    """One hash range of all units: exact counts to each unit (kind 1), spelling counts of its words (3), sums a bucket (4)."""
    raw = [(u, *pickle.loads(p)) for u, p in zip(table.column("unit").to_pylist(), table.column("payload").to_pylist())]
    blobs = [(u, _sorted_in(v), _swell(c), start) for u, v, c, start, _ in raw]
    every = np.concatenate([v for _, v, _, _ in blobs])
    vocabulary, first, ids = np.unique(every, return_index=True, return_inverse=True)
    counts = np.bincount(ids, weights=np.concatenate([c for _, _, c, _ in blobs]), minlength=len(vocabulary)).astype(np.int64)
    rows, at = [], 0
    new = np.zeros(len(every), bool)
    new[first[counts > 0]] = True  # a word's first place, where its text is taken
    spell = np.zeros(SPELL_CELLS, np.int32)
    for (unit, v, _, start), (*_, text) in zip(blobs, raw):
        rows.append((1, unit, start, pickle.dumps(_squeeze(counts[ids[at : at + len(v)]]), 5)))
        here = np.flatnonzero(new[at : at + len(v)])
        if len(here):
            said = zstandard.decompress(text).split(b" ")
            _spell_into(spell, [w for i in here if (w := said[i])])
        at += len(v)
    mass = np.bincount(_bucket(vocabulary), weights=counts, minlength=BUCKETS).astype(np.int64)
    sums = {-1: int((counts > 0).sum()), -2: int((counts == 1).sum())} | {int(b): int(mass[b]) for b in np.flatnonzero(mass)}
    rows += [(4, key, n, b"") for key, n in sums.items()]
    out = [pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)]
    return pa.concat_tables(out + [pa.Table.from_batches([x]) for x in _cell_rows(3, table.column("part")[0].as_py(), spell)])


def _spell_into(spell: np.ndarray, texts: list[bytes]) -> None:
    if texts:
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size)
        byte, near = _spelling(np.frombuffer(b"".join(texts), np.uint8), ends - size, ends)
        np.add.at(spell, (near * 256 + byte).ravel(), 1)


def _dense(kind: int, part: int, payloads: list[bytes]) -> np.ndarray:
    """The sum of blobs of one part of a table, one blob swollen at a time."""
    total = CONTEXTS * CLASSES * BUCKETS if kind == 2 else SPELL_CELLS
    step = -(-total // PARTS)
    cells = np.zeros(min(step, total - part * step), np.int64)
    for p in payloads:
        at, n = pickle.loads(p)
        cells[_sorted_in(at)] += _swell(n)
    return np.minimum(cells, 2**31 - 1).astype(np.int32)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """Some blobs of one part of a table as one of the same form."""
    kind, part, run = (k.as_py() for k in key)
    block = _dense(kind, part, table.column("payload").to_pylist())
    at = np.flatnonzero(block)
    return pa.Table.from_batches([_row(kind, run, part, (_sorted_out(at.astype(np.uint32)), _squeeze(block[at])))])


def summed(cells: DataFrame, most: int, merged: int = 0) -> DataFrame:
    """cells(kind, unit, part, payload), at most ``most`` blobs a part, told apart by ``unit`` -> the same sums in ``MERGED`` blobs a part at most:
    a tree of merges, so that no group grows with the number of tasks."""
    merged = merged or MERGED
    while most > merged:
        most = -(-most // merged)
        run = F.pmod("unit", F.lit(most)).alias("run")
        cells = cells.groupBy("kind", "part", run).applyInArrow(_added, MIXED)
    return cells


def _merge_cells(key: tuple, table: pa.Table) -> pa.Table:
    kind, part = key[0].as_py(), key[1].as_py()
    block = _dense(kind, part, table.column("payload").to_pylist())
    return pa.table([pa.array([x], f.type) for x, f in zip((kind, 0, part, zlib.compress(block.tobytes(), 1)), _SCHEMA)], schema=_SCHEMA)


def _stretch(ones: np.ndarray, both: np.ndarray, prior: np.ndarray | float, strength: float) -> np.ndarray:
    p = (ones + strength * prior) / (both + strength)
    p = np.clip(p, 1 / 4096, 1 - 1 / 4096)
    return np.log(p / (1 - p)).astype(np.float32)


def _cells(near: np.ndarray, bucket: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Cells of the context tables that the tokens of ``mask`` count in."""
    return np.concatenate([(near[k][mask] + k * CLASSES) * BUCKETS + bucket[mask] for k in range(CONTEXTS)])


def build(mass: np.ndarray, table: np.ndarray, spell: np.ndarray, tokens: int, once: int) -> dict:
    """Code tree over buckets, and every predictor's stretched probability at every node."""
    heap = [(float(m), i, i) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    new = len(mass)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[new] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], new, new))
        new += 1
    # Leaves in tree order; each node is a run of them, and its bit 1 a later run.
    order: list[int] = []
    spans = np.zeros((len(mass) - 1, 3), np.int64)
    paths: dict[int, tuple[list[int], list[int]]] = {}

    def walk(root: int) -> None:
        stack = [(root, [], [], 0)]
        while stack:
            node, nodes, bits, done = stack.pop()
            if node < len(mass):
                paths[node] = (nodes, bits)
                order.append(node)
                continue
            k = node - len(mass)
            if done == 0:
                spans[k, 0] = len(order)
                stack.append((node, nodes, bits, 1))
                stack.append((kids[node][0], [*nodes, k], [*bits, 0], 0))
            elif done == 1:
                spans[k, 1] = len(order)
                stack.append((node, nodes, bits, 2))
                stack.append((kids[node][1], [*nodes, k], [*bits, 1], 0))
            else:
                spans[k, 2] = len(order)

    walk(new - 1)
    longest = max(len(n) for n, _ in paths.values())
    node = np.zeros((len(mass), longest), np.int16)
    bit = np.zeros((len(mass), longest), np.int8)
    length = np.zeros(len(mass), np.int16)
    for leaf, (n, b) in paths.items():
        node[leaf, : len(n)], bit[leaf, : len(b)], length[leaf] = n, b, len(n)
    order_ = np.array(order)
    a, m, b = spans.T

    def sums(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.concatenate([np.zeros((*rows.shape[:-1], 1), np.float64), np.cumsum(rows[..., order_], axis=-1)], axis=-1)
        return c[..., b] - c[..., m], c[..., b] - c[..., a]

    ones, both = sums(mass.astype(np.float64))
    base = (ones + 0.02) / (both + 0.04)
    order0 = _stretch(ones, both, 0.5, 0.02)
    cells = np.empty((CONTEXTS, CLASSES, len(mass) - 1), np.int8)
    for k in range(CONTEXTS):
        for i in range(0, CLASSES, 128):
            ones, both = sums(table.reshape(CONTEXTS, CLASSES, -1)[k, i : i + 128])
            cells[k, i : i + 128] = np.clip(np.rint(_stretch(ones, both, base, 8.0) * 12), -127, 127)
    # Byte bits, most significant first: node i of 1..255 covers a run of byte values.
    s = spell.reshape(-1, 256).astype(np.float64)
    c = np.concatenate([np.zeros((len(s), 1)), np.cumsum(s, axis=1)], axis=1)
    flat = np.concatenate([[0.0], np.cumsum(s[: SPELL[0]].sum(axis=0))])
    byte_nodes = np.zeros((len(s), 256), np.float32)
    for i in range(1, 256):
        depth = i.bit_length() - 1
        width = 256 >> depth
        lo = (i - (1 << depth)) * width
        prior = (flat[lo + width] - flat[lo + width // 2] + 0.5) / (flat[lo + width] - flat[lo] + 1)
        byte_nodes[:, i] = _stretch(c[:, lo + width] - c[:, lo + width // 2], c[:, lo + width] - c[:, lo], prior, 2.0)
    return {"node": node, "bit": bit, "length": length, "order0": order0, "cells": cells, "mass": mass, "spell": byte_nodes, "seen": c[:, -1].astype(np.float32), "tokens": tokens, "new": (once + 1) / (tokens + 2), "weights": None}


def first_weights() -> np.ndarray:
    return np.tile(np.array([0.25, 0.3, 0.25, 0.25, 0.5, 0.8], np.float32), (GATES, 1))


#: Weights of the contexts of one, two and three bytes, by gate, at a word's start. Fitted ones (logistic regression on
#: words left out of their own counts) cost 1 % more bits on unknown words.
FIRST_SPELLING = np.array([[0.8, 0.25, 0.05], [0.2, 0.75, 0.15], [0.1, 0.3, 0.7]])


def _spelling_gate(seen: np.ndarray) -> np.ndarray:
    """The longest context met often enough leads."""
    return np.where(seen[2] >= 8, 2, np.where(seen[1] >= 8, 1, 0))


def spelling_cost(model: dict, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each word's bytes and its end, bit by bit from hashed byte contexts. Each word starts from
    ``FIRST_SPELLING`` and refines its own weights after every bit."""
    if not texts:
        return np.empty(0)
    size = np.array([len(t) for t in texts])
    low = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(size)
    byte, rows = _spelling(low, ends - size, ends)
    gate = _spelling_gate(model["seen"][rows])
    firsts = np.cumsum(size + 1) - size - 1
    order = np.argsort(-size, kind="stable")
    w = np.tile(FIRST_SPELLING.ravel(), (len(texts), 1)).reshape(-1, 3)
    total = np.zeros(len(texts))
    for t in range(int(size[order[0]]) + 1):
        live = order[: int(np.searchsorted(-size[order], -t, side="right"))]  # words with a byte or their end here
        at = firsts[live] + t
        own, node = live * SPELL_GATES + gate[at], np.ones(len(live), np.int64)
        for k in range(7, -1, -1):
            bit = byte[at] >> k & 1
            v = np.stack([model["spell"][rows[i, at], node] for i in range(3)], axis=1).astype(np.float64)
            p = np.clip(1 / (1 + np.exp(-np.einsum("ij,ij->i", w[own], v))), 1e-4, 1 - 1e-4)
            total[live] += np.log10(np.where(bit == 1, p, 1 - p))
            w[own] += (SPELL_RATE * (bit - p))[:, None] * v
            node = node * 2 + bit
    return total


def last_followers(owner: np.ndarray, ids: np.ndarray, n: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token the word that last followed the same one, and the same two, words in its text; -1 if none."""
    out = []
    one = np.concatenate([[0], ids[:-1]]).astype(np.int64)
    two = np.concatenate([[0, 0], ids[:-2]])[: len(ids)].astype(np.int64)
    at = np.arange(len(ids)) - np.repeat(firsts, np.diff(np.append(firsts, len(ids))))
    for far in (1, 2):
        key = owner * n + one if far == 1 else (mix((two * n + one).astype(np.uint64)) >> np.uint64(24)).astype(np.int64) + (owner.astype(np.int64) << 40)
        order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (at[order][1:] >= far) & (at[order][:-1] >= far)
        found = np.full(len(ids), -1, np.int32)
        found[order[1:][same]] = ids[order[:-1][same]]
        out.append(found)
    return out[0], out[1]


def earlier(key: np.ndarray) -> np.ndarray:
    """How often each key stood before."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    start = np.flatnonzero(first)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return out


def mix_bits(model: dict, bucket: np.ndarray, near: np.ndarray, guess: tuple[np.ndarray, np.ndarray], lanes: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token's code, token after token in every lane at once; and the lanes' last weights.

    ``lanes``: first token of each lane, longest lane first; ``sizes``: their tokens.
    """
    node, bits, length, order0 = np.ascontiguousarray(model["node"].T), np.ascontiguousarray(model["bit"].T), model["length"], model["order0"]
    cells = [c.ravel() for c in model["cells"]]
    width = model["cells"].shape[2]
    w = np.tile(weights.ravel(), (len(lanes), 1)).reshape(len(lanes) * GATES, INPUTS)
    out = np.zeros(len(bucket), np.float32)
    x = np.empty((len(lanes), INPUTS), np.float32)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # lanes with more than t tokens
        token = lanes[:live] + t
        mine = bucket[token]
        rows = [near[k][token].astype(np.int64) * width for k in range(CONTEXTS)]
        hint = [np.where(g[token] >= 0, g[token], 0) for g in guess]
        fits = [g[token] >= 0 for g in guess]
        size = length[mine]
        lane = np.arange(live)
        rate = RATE + FAST / (1 + t / SETTLED)
        j = 0
        while len(lane):
            n, b = node[j].take(mine).astype(np.int64), bits[j].take(mine)
            v = x[: len(lane)]
            v[:, 0] = order0.take(n)
            for k in range(CONTEXTS):
                v[:, 1 + k] = cells[k].take(rows[k] + n)
            v[:, 1 : 1 + CONTEXTS] *= 1 / 12
            for k in range(2):
                says = bits[j].take(hint[k])
                v[:, 4 + k] = np.where(fits[k], 4.0 * says - 2.0, 0.0)
                fits[k] = fits[k] & (says == b)  # a code that agreed to its end is the token's own, which ends there too
            at = lane * GATES + (v[:, 4] != 0) + 2 * (v[:, 5] != 0)
            own = w.take(at, axis=0)
            p = 1 / (1 + np.exp(-np.einsum("ij,ij->i", own, v)))
            np.clip(p, 1e-4, 1 - 1e-4, out=p)
            out[token[lane]] += np.log10(np.where(b == 1, p, 1 - p))
            own += (rate * (b - p))[:, None].astype(np.float32) * v
            w[at] = own
            j += 1
            more = size > j
            if not more.all():
                lane, mine, size = lane[more], mine[more], size[more]
                rows, hint, fits = [r[more] for r in rows], [g[more] for g in hint], [f[more] for f in fits]
    return out, w.reshape(len(lanes), GATES, INPUTS)


def score_unit(model: dict, unit: dict, counts: np.ndarray) -> dict:
    """Columns of one unit's documents."""
    per, ids, vocabulary = unit["per"], unit["ids"], unit["vocabulary"]
    firsts = np.cumsum(per) - per
    owner = np.repeat(np.arange(len(per)), per)
    known = counts > 0
    bucket = _bucket(vocabulary)
    near = contexts(ids, firsts, vocabulary, unit["ending"])
    one, two = last_followers(owner, ids, len(vocabulary), firsts)
    guess = tuple(np.where(g >= 0, bucket[g], -1) for g in (one, two))
    # Lanes: runs of at most LANE tokens of one document.
    pieces = -(-per // LANE)
    turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lanes = np.repeat(firsts, pieces) + turn * LANE
    sizes = np.minimum(np.repeat(per, pieces) - turn * LANE, LANE)
    longest = np.argsort(-sizes, kind="stable")
    # An unknown word costs no code bits; its bucket's code is read for nothing but the weights.
    code, _ = mix_bits(model, bucket[ids], near, guess, lanes[longest], sizes[longest], model["weights"])
    del near, one, two, guess
    fresh = ~known[ids]
    before = np.cumsum(fresh) - fresh
    before = before - np.repeat(before[firsts], per)
    at = np.arange(len(ids)) - np.repeat(firsts, per)
    p_new = (400 * model["new"] + before) / (400 + at)
    # A word's share of its bucket, and an unknown word's of the unknown ones, follow the document so far.
    again, same = earlier(owner * len(vocabulary) + ids), earlier(owner * BUCKETS + bucket[ids])
    share = np.maximum(counts, 1) / np.maximum(model["mass"][bucket], 1)
    share = np.log10((again + SHARE * share[ids]) / (same + SHARE))
    rare = np.array(sorted(i for i in unit["text"] if not known[i]), np.int64)
    spelt = np.zeros(len(vocabulary))
    if len(rare):
        spelt[rare] = spelling_cost(model, [unit["text"][int(i)] for i in rare])
    p_new = np.clip(p_new, 1e-6, 0.95)
    first = fresh & (again == 0)
    sorts = np.cumsum(first) - first
    sorts = sorts - np.repeat(sorts[firsts], per)
    p_again = (before - sorts + 0.2) / (before + 1)
    unknown = np.where(again > 0, np.log10(p_again * np.maximum(again, 1) / np.maximum(before, 1)), spelt[ids] + np.log10(1 - np.where(before > 0, p_again, 0)))
    token = np.where(fresh, np.log10(p_new) + unknown, np.log10(1 - p_new) + code + share)
    base = np.log10((counts + 0.1) / (model["tokens"] + 0.1 * (model["distinct"] + 1)))
    total = lambda v: np.add.reduceat(v.astype(np.float64), firsts)
    score = total(token)
    return {"doc_id": unit["docs"], "n_tokens": per, "n_known": np.add.reduceat(known[ids].astype(np.int64), firsts), "base_score": total(base[ids]), "score": score, "n_bytes": unit["bytes"]}


def score_documents(documents: DataFrame, folds: int = FOLDS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows whose crc32(doc_id as text) mod ``folds`` isn't 0 (a null doc_id
    learns), and scores every row. A null text is empty: its one token is the end. Repeated rows
    learn and score each for itself. An empty table gives no rows; other columns are ignored.
    bits_per_byte counts an empty text as one byte (its end). How the table is cut into partitions has no say.
    """
    spark = documents.sparkSession
    parts = 1 << max(6, min(16, (input_bytes(documents) >> 24).bit_length()))
    docs = documents.select(row_id(), F.coalesce("text", F.lit("")).alias("text"))
    gathered = stored(docs.mapInArrow(_gather(folds, parts), MIXED), "lm-units", "kind")
    asked = gathered.where("kind = 1").select("part", "unit", "payload")
    ranges = stored(asked.groupBy("part").applyInArrow(_merge_range, MIXED), "lm-counts", "kind")
    sums = {r.unit: r.n for r in ranges.where("kind = 4").groupBy("unit").agg(F.sum("part").alias("n")).collect()}  # a row a bucket
    cells = gathered.where("kind = 2").select("kind", "unit", "part", "payload").unionByName(ranges.where("kind = 3").select("kind", "unit", "part", "payload"))
    cells = summed(cells, max((r["n"] for r in cells.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).collect()), default=0))  # 2 x PARTS rows
    dense = {k: np.zeros(-(-n // PARTS) * PARTS, np.int32) for k, n in ((2, CONTEXTS * CLASSES * BUCKETS), (3, SPELL_CELLS))}
    for r in cells.groupBy("kind", "part").applyInArrow(_merge_cells, MIXED).collect():  # 2 x PARTS rows of fixed size
        step, block = len(dense[r.kind]) // PARTS, np.frombuffer(zlib.decompress(r.payload), np.int32)
        dense[r.kind][r.part * step : r.part * step + len(block)] = block
    mass = np.array([sums.get(b, 0) for b in range(BUCKETS)], float)
    tokens, distinct, once = int(mass.sum()), sums.get(-1, 0), sums.get(-2, 0)
    table, spell = dense[2][: CONTEXTS * CLASSES * BUCKETS], dense[3][:SPELL_CELLS]
    model = build(mass, table, spell, tokens, once) | {"distinct": distinct, "weights": first_weights()}
    shared = spark.sparkContext.broadcast(model)

    def columns(rows: pa.Table) -> dict:
        kinds, payloads = rows.column("kind").to_pylist(), rows.column("payload")
        unit = pickle.loads(payloads[kinds.index(0)].as_py())
        unit |= {k: _swell(unit[k]) for k in ARRAYS}
        counts = np.zeros(len(unit["vocabulary"]), np.int64)
        for kind, start, payload in zip(kinds, rows.column("part").to_pylist(), payloads):
            if kind == 1:
                c = _swell(pickle.loads(payload.as_py()))
                counts[start : start + len(c)] = c
        return score_unit(shared.value, unit, counts)

    def scored(rows: pa.Table) -> pa.Table:
        found = columns(rows)
        tidy()
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64()}
        return pa.table([pa.array(found[k], t) for k, t in kinds.items()], names=list(kinds))

    # A unit and its counts are one group, so that a worker is sent one unit at a time, however many a task has.
    units = gathered.where("kind = 0").select("kind", "unit", "part", "payload").unionByName(ranges.where("kind = 1").select("kind", "unit", "part", "payload"))
    out = units.groupBy("unit").applyInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    ids = public_id("doc_id")
    return out.select(
        ids, F.coalesce(F.crc32(ids.cast("string").cast("binary")) % folds == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * np.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
