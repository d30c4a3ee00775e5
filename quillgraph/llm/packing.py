"""Token packing by minimum bin slack.

Each task tokenises its documents and packs them in blocks of ``BLOCK`` documents; nothing is
shuffled. Full windows are cut from documents longer than a window. For the remainders a
window is seeded with the longest one left, then a bitset subset-sum dynamic programme over the
multiset of remaining lengths finds the total closest to capacity, and backtracking through
the stored bitsets gives how many pieces of each length make it. When what is left can't fill
a window, its tokens are cut into sequences of power-of-two lengths, which need no padding.

Bitsets are Python integers: bit s is set when length s can be reached; adding a length is one
shift and one or.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import public_id, row_id

WINDOW = 4096
END = 2
BLOCK = 4096
#: Tokens after which a block is packed even if it has fewer documents.
BLOCK_TOKENS = 8_000_000
CACHE_WORDS = 800_000

_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_state: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Whole texts -> ids, equal to the tokenizer file's own.

    The file's rules always split at ASCII white space and drop it, so words encode alone and
    are remembered, in a bounded memory; so does a full stop or comma after a letter or digit at a word's end. New words go through the same merges in one call of
    tiktoken: ranks are the file's merges in order, below them the single bytes, alone and with
    the word-end mark. Words with other characters than Latin ones, or with a special token's
    opening, are encoded by the tokenizer itself.
    """

    MARK = "\x01"  # stands for the word end; words that hold it go to the tokenizer
    LATIN = re.compile("[^\x01\u0250-\U0010ffff]*")

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        vocab = spec["model"]["vocab"]
        mark = self.MARK.encode()
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        end = spec["model"]["end_of_word_suffix"]
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(end)) + mark * t.endswith(end)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + mark for b in range(256)] + [raw(x) + raw(y) for x, y in merges]
        ranks = {x: i for i, x in reversed(list(enumerate(order)))}
        ranks = {x: i for i, x in enumerate(sorted(ranks, key=ranks.get))}
        ids = {raw(t): i for t, i in vocab.items() if not t.startswith("<|")}
        self.back = np.zeros(len(ranks), "<u4")
        for x, i in ranks.items():
            self.back[i] = ids[x] if x in ids else 0xFFFFFFFF
        self.line = ranks[b"\n" + mark]
        self.engine = tiktoken.Encoding("merges", pat_str=f"[^{self.MARK}]*{self.MARK}", mergeable_ranks=ranks, special_tokens={})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(rf"\n|{pattern}").findall
        self.words: dict[bytes, bytes] = {}

    def learn(self, new: list[bytes]) -> None:
        texts = [w.decode() for w in new]
        fast = [self.LATIN.fullmatch(x) is not None and "<|" not in x for x in texts]
        joined = unicodedata.normalize("NFC", "\n".join(x for x, f in zip(texts, fast) if f)).lower()
        if joined:
            got = np.array(self.engine.encode_ordinary(self.MARK.join(self.pieces(joined)) + self.MARK), np.int64)
            cuts = np.flatnonzero(got == self.line)
            ids = self.back[got]
            starts, stops = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(got)]])
            for w, a, b in zip((w for w, f in zip(new, fast) if f), starts.tolist(), stops.tolist()):
                self.words[w] = ids[a:b].tobytes()
        slow = [(w, x) for w, x, f in zip(new, texts, fast) if not f]
        for (w, _), e in zip(slow, self.tokenizer.encode_batch_fast([x for _, x in slow], add_special_tokens=False)):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts of a binary column, without nulls -> their ids one after another, and the n + 1 places where texts begin and end.

        Each distinct word of the column is looked up once; its ids are then gathered for all its places.
        """
        data, offsets = _parted(texts)
        column = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        split = pc.ascii_split_whitespace(column)
        borders = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        self.words[b""] = b""  # before and after white space at a text's ends
        found = list(map(self.words.get, distinct))
        if None in found:
            self.learn([w for w, ids in zip(distinct, found) if ids is None])
            found = list(map(self.words.get, distinct))
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy()
        size = sizes[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        first = np.cumsum(sizes) - sizes
        places = np.repeat(first[word] - ends[:-1], size) + np.arange(ends[-1])
        return flat[places], ends[borders - borders[0]]


def _parted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, with a space put between a letter or digit and the full stop or comma that ends its word."""
    n = len(texts)
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    at = np.flatnonzero((data == 46) | (data == 44))
    at = at[~border[at]]  # something of its own text stands before it
    at = at[_ALNUM[data[at - 1]]]
    at = at[border[at + 1] | _SPACE[data[np.minimum(at + 1, len(data) - 1)]]]
    return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets, side="left")


def encoder(path: str) -> Encoder:
    """One a Python worker and file."""
    if _state.get("path") != path:
        _state.update(path=path, encoder=Encoder(path))
    return _state["encoder"]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of lengths -> how many of each to take so that the sum is closest to ``capacity``, not over it."""
    mask, reach, trail = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, take = counts[length], 1
        while left > 0:  # binary splitting of the multiplicity
            n = min(take, left)
            if n * length > capacity:
                break
            trail.append((length, n, reach))
            reach |= (reach << (n * length)) & mask
            left -= n
            take *= 2
        if reach >> capacity:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(trail):
        if not before >> at & 1:
            chosen[length] += n
            at -= n * length
    return dict(chosen)


def plan(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Document lengths -> sequences, each a list of (document index, start, length)."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, n in enumerate(lengths):
        full = n // window
        sequences += [[(i, k * window, window)] for k in range(full)]
        if n % window:
            rest[n % window].append((i, full * window))
    counts = {k: len(v) for k, v in rest.items()}
    total = sum(k * n for k, n in counts.items())

    def take(length: int) -> tuple[int, int, int]:
        i, start = rest[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return i, start, length

    while total >= window:
        row = [take(max(counts))]
        size = row[0][2]
        for length, n in fill(counts, window - size).items():
            for _ in range(n):
                row.append(take(length))
                size += length
        if size < window and counts:  # the slack left: cut it from the shortest piece that covers it
            length = min((x for x in counts if x > window - size), default=0)
            if length:
                i, start, _ = take(length)
                cut = window - size
                row.append((i, start, cut))
                rest[length - cut].append((i, start + cut))
                counts[length - cut] = counts.get(length - cut, 0) + 1
                size = window
        sequences.append(row)
        total -= size
    left = [take(k) for k in sorted(counts, reverse=True) for _ in range(counts[k])]
    row, room = [], 0
    total = sum(x[2] for x in left)
    for i, start, n in left:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                row = []
                sequences.append(row)
            cut = min(n, room)
            row.append((i, start, cut))
            start, n, room, total = start + cut, n - cut, room - cut, total - cut
    return sequences


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, window: int, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = (TaskContext.get().partitionId() + 1) << 36
        docs: list[int] = []
        ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows: list[tuple] = []
            size = 0
            for sequence in plan([len(x) for x in ids], window):
                offset = 0
                for i, start, n in sequence:
                    rows.append((docs[i], start, n, ids[i][start : start + n].tobytes(), len(ids[i]), made, offset))
                    offset += n
                    size += 4 * n
                made += 1
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)
            docs.clear()
            ids.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        stop = np.array([end], "<u4")
        held = 0
        for batch in batches:
            flat, borders = encoder(path).encode(batch.column("text").cast(pa.binary()))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), borders[:-1], borders[1:]):
                docs.append(doc)
                ids.append(np.concatenate([flat[a:b], stop]))
                held += len(ids[-1])
                if len(docs) >= block or held >= BLOCK_TOKENS:
                    yield from flush()
                    held = 0
        if docs:
            yield from flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> pieces with ``ids`` (little-endian unsigned 32-bit token ids).

    A null text is empty: its document is the end token alone. Every token of every row lies in
    one piece; a sequence is full, or its length is a power of two. Repeated rows are packed as
    documents of their own. An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(row_id(), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(_pack(tokenizer or default_tokenizer(), window, end, block), PIECE).withColumn("doc_id", public_id("doc_id"))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
