"""Toxicity by compression distance between zstandard dictionaries.

Two pairs of dictionaries are compared over the words of a document; both differences are calibrated.

*Phrases.* One zstandard dictionary is trained on toxic text and one on ordinary text. Windows of
``WIDTH`` words, each pair of neighbours in one of them, are compressed with each; the score of a window is its length by
the ordinary dictionary less that by the toxic one. The toxic dictionary is refined by cross-fitting:
dictionaries trained on random halves of the toxic documents score the windows of the other half,
windows that score over all but ``SPARE`` of the ordinary ones are narrowed to the words that carry the difference, and the
final dictionary is trained on those.

*Strings.* A short word can't shorten a window of its own by much, as a match costs about as many bytes
as the word. So a second pair shares the trained ordinary content, and the toxic one also holds, nearest to the window, the
strings typical of toxic documents, each behind a carrier phrase that starts every window: there one
longer match covers both, and the length falls by all the bytes that the string explains. The
strings are chosen greedily by likelihood gain.

A document's windows are counted by score, and a logistic calibration on documents that trained neither
dictionary turns the counts into a probability. All words of all documents are scored; fitting reads
a bounded sample of labelled rows (``MAX_TOXIC``, ``MAX_ORDINARY``, ``SAMPLE_BYTES``), whole texts each.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import public_id, row_id, tidy

MAX_TOXIC = 2000
MAX_ORDINARY = 4000
#: UTF-8 bytes of whole texts sampled of each class; a text that no longer fits is left to the next that does.
SAMPLE_BYTES = 16 << 20
FOLDS = 5
LEVEL = 19
DICTIONARY = 2048
MAX_STRINGS = 200
#: A typical string is in this share of the toxic documents at least, after those chosen before it.
MIN_SHARE = 0.02
MEMORY = 200_000
#: Longer words are scored like others but not remembered.
MEMO_BYTES = 64
CLASSES = 6
#: Words of a window; the next one starts ``WIDTH - 1`` words on, so that every pair of neighbours is in one.
WIDTH = 2
#: The phrase pair: sizes of the dictionaries, level, halves a round, share of ordinary windows above the cut.
ORDINARY_SIZE, TOXIC_SIZE = 16_384, 1_536
PHRASE_LEVEL = 1
HALVES = 6
SPARE = 0.001
#: Least match of the phrase level's strategy, and bits of the table of such strings.
GRAM, GRAM_BITS = 7, 20
#: Words compressed in one call.
BLOCK = 20_000
#: Starts every phrase window and ends both dictionaries, so that a window is never stored raw.
MARK = bytes(range(1, 9)) + bytes(range(11, 13)) + bytes(range(14, 16))
#: Bytes that no text holds in a row; they measure what a window costs besides its own.
STRANGE = bytes(range(128, 168))

_ALNUM = bytes(range(48, 58)) + bytes(range(97, 123))
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b in _ALNUM or b >= 128 else 32) for b in range(256))
_memo: dict = {}


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, ASCII lower-cased."""
    return text.translate(FOLD).split()


def _params(level: int = LEVEL, **more: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(level, **more, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=_params())


def phrase_windows(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Runs of ``width`` words that share one word with the next; the last may be shorter."""
    return [b" ".join(words[i : i + width]) + b" " for i in range(0, max(len(words) - 1, min(1, len(words))), width - 1)]


def lengths(book: zstandard.ZstdCompressor, windows: list[bytes], head: bytes = MARK) -> np.ndarray:
    if not windows:
        return np.empty(0, np.int64)
    packed = book.multi_compress_to_buffer([head + w for w in windows], threads=1)
    return np.fromiter(map(len, packed), np.int64, len(windows))


def gaps(ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, windows: list[bytes], head: bytes, most: int) -> np.ndarray:
    """Scores of windows, 0 to ``most``; 1 stands for 0 too. The ordinary length counts at most as the window stored
    as it is, so that windows which the toxic dictionary doesn't shorten by two bytes aren't compressed again."""
    own = lengths(toxic, windows, head)
    plain = np.fromiter(map(len, windows), np.int64, len(windows)) + len(toxic.compress(head + STRANGE)) - len(STRANGE)
    out = np.clip(plain - own, 0, 1)
    near = np.flatnonzero(plain - own > 1)
    other = np.minimum(lengths(ordinary, [windows[i] for i in near], head), plain[near])
    out[near] = np.clip(other - own[near], 0, most)
    return out


def _phrase_book(content: bytes) -> zstandard.ZstdCompressor:
    book = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=_params(PHRASE_LEVEL, min_match=GRAM))


class WindowScorer:
    """Scores of words behind the carrier, remembered for up to ``MEMORY`` of them."""

    def __init__(self, model: dict):
        self.ordinary, self.toxic = _compressor(model["ordinary"]), _compressor(model["toxic"])
        self.head, self.known = model["carrier"], {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Scores of distinct words."""
        fresh = [w for w in words if w not in self.known]
        found = dict(zip(fresh, gaps(self.ordinary, self.toxic, [w + b" " for w in fresh], self.head, CLASSES * 2).tolist()))
        out = np.fromiter((found[w] if w in found else self.known[w] for w in words), np.int64, len(words))
        if len(self.known) + len(found) > MEMORY:
            self.known.clear()
        self.known.update((w, x) for w, x in found.items() if len(w) <= MEMO_BYTES)
        return out


class PhraseScorer:
    """Scores of a document's windows of several words, counted.

    A match of zstandard's fast strategy is ``GRAM`` bytes at least. A window without so many bytes in a row from the
    toxic dictionary can't be shortened by it and scores 0 unseen; the others are compressed.
    """

    def __init__(self, model: dict):
        self.ordinary, self.toxic = _phrase_book(model["phrases"][0]), _phrase_book(model["phrases"][1])
        self.table = np.zeros(1 << GRAM_BITS, bool)
        self.table[_grams(np.frombuffer(model["phrases"][1], np.uint8))] = True

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Windows by score, ``CLASSES`` + 1 or more together."""
        out = np.zeros(CLASSES + 2, np.int64)
        for at in range(0, max(1, len(words) - 1), BLOCK):  # a block ends where the next window starts
            part = words[at : at + BLOCK + 1]
            body = b" ".join(part) + b" "
            met = np.concatenate([[0], np.cumsum(self.table[_grams(np.frombuffer(body, np.uint8))])])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            first = np.arange(0, max(len(part) - 1, min(1, len(part))), WIDTH - 1)
            last = np.minimum(first + WIDTH, len(part)) - 1
            start, stop = np.concatenate([[0], ends])[first], ends[last] if len(part) else first
            stop = np.minimum(np.maximum(stop - GRAM + 1, start), len(met) - 1)
            hit = np.flatnonzero(met[stop] > met[np.minimum(start, len(met) - 1)])
            windows = [b" ".join(part[i : i + WIDTH]) + b" " for i in first[hit].tolist()]
            out += np.bincount(gaps(self.ordinary, self.toxic, windows, MARK, CLASSES + 1), minlength=CLASSES + 2)
            out[0] += len(first) - len(hit)
        return out


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of every ``GRAM`` bytes in a row."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for i in range(GRAM):
        packed |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _features(counts: np.ndarray, n: int, phrases: np.ndarray) -> np.ndarray:
    """Of a document's windows by score: how many reach each class, on a log scale, and their share."""
    reach = np.cumsum(counts[::-1])[::-1][2 : CLASSES + 2].astype(float)
    above = np.cumsum(phrases[::-1])[::-1][2:].astype(float)
    return np.concatenate(
        [[1.0], np.minimum(reach, 1), np.log1p(reach), [math.log1p(n), math.log1p(1000 * reach[1] / max(1, n))], np.minimum(above, 1), np.log1p(above), np.log1p(1000 * above / max(1, n))]
    )


NOTHING = np.zeros(2 * CLASSES + 1, np.int64), 0, np.zeros(CLASSES + 2, np.int64)


def document_features(text: bytes, score: WindowScorer, phrases: PhraseScorer) -> np.ndarray:
    words = words_of(text)
    times = Counter(words)
    found = score(list(times))
    counts = np.bincount(found, np.fromiter(times.values(), np.int64, len(times)), 2 * CLASSES + 1)
    return _features(counts, len(words), phrases(words))


def without_copies(texts: list[bytes], size: int = 8, shared: int = 4) -> list[bytes]:
    """Texts less near copies of earlier ones (by the least hashes of their words), so that a copied text has one voice."""
    kept, owners = [], defaultdict(list)
    for x in texts:
        least = sorted({zlib.crc32(w) for w in words_of(x)})[:size]
        votes = Counter(k for h in least for k in owners[h])
        if votes and max(votes.values()) >= min(shared, len(least)):
            continue
        for h in least:
            owners[h].append(len(kept))
        kept.append(x)
    return kept


def strings_typical_of(toxic: list[bytes], ordinary: list[bytes], most: int = MAX_STRINGS) -> list[bytes]:
    """Byte strings of words, greedily by gain in likelihood; words explained by one don't count for the next."""
    n1, n0 = len(toxic), len(ordinary)
    floor = max(4 if n1 < 100 else 6, MIN_SHARE * n1)
    if not n1 or not n0:
        return []
    t, o = Counter(), Counter()
    for count, texts in ((t, toxic), (o, ordinary)):
        for x in texts:
            count.update(set(words_of(x)))
    def grams(w: bytes, known: dict) -> set[bytes]:
        """Strings of 4 to 8 bytes found in ``known``."""
        p = b" " + w + b" "
        return {p[i : i + n] for n in range(4, 9) for i in range(len(p) - n + 1) if p[i : i + n] in known}

    # Level by level: a string is frequent only if its two shorter parts are.
    ct: Counter = Counter()
    for n in range(4, 9):
        level: Counter = Counter()
        for w, c in t.items():
            p = b" " + w + b" "
            for g in {p[i : i + n] for i in range(len(p) - n + 1) if n == 4 or p[i : i + n - 1] in ct and p[i + 1 : i + n] in ct}:
                level[g] += c
        ct.update({g: c for g, c in level.items() if c >= floor})
    co: Counter = Counter()
    for w, c in o.items():
        for g in grams(w, ct):
            co[g] += c
    own: dict[bytes, list[bytes]] = defaultdict(list)

    def gain(c: float, k: float) -> float:
        p, q, r = (c + 0.5) / (n1 + 1), (k + 0.5) / (n0 + 1), (c + k + 1) / (n1 + n0 + 2)
        return (c * math.log(p / r) + k * math.log(q / r)) if p > 12 * q else 0.0

    gains = {g: v for g, c in ct.items() if (v := gain(c, co[g])) > 8}
    for w in t:
        for g in grams(w, gains):
            own[g].append(w)
    chosen: list[bytes] = []
    gone: set[bytes] = set()
    while gains and len(chosen) < most:
        g = max(gains, key=lambda g: (gains[g], len(g), g))
        # Of strings that stand in nearly the same words the longest: it compresses best.
        g = max((h for h in gains if g in h and ct[h] >= 0.95 * ct[g]), key=lambda h: (len(h), gains[h], h))
        if g[:1] == b" ":
            chosen.append(g[1:])
        else:  # not a word's beginning: its commonest words stand for it
            chosen += [w + b" " for w in sorted((w for w in set(own[g]) if w not in gone), key=lambda w: (-t[w], w))[:3]]
        touched: Counter = Counter()
        for w in own[g]:
            if w not in gone:
                gone.add(w)
                for h in grams(w, gains):
                    ct[h] -= t[w]
                    co[h] -= o[w]
                    touched[h] += 1
        for h in touched:
            v = gain(ct[h], co[h]) if ct[h] >= floor else 0.0
            if v > 8:
                gains[h] = v
            else:
                del gains[h]
        gains.pop(g, None)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary by the library's cover algorithm; too little text for it: the text's end."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def narrowed(windows: list[bytes], ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> list[bytes]:
    """Windows without the words at either end that their score, less one byte, doesn't need."""
    now = [w.split() for w in windows]
    packed = lambda rows: [b" ".join(r) + b" " for r in rows]
    score = lambda rows: lengths(ordinary, packed(rows)) - lengths(toxic, packed(rows))
    least = score(now) - 1
    for part in (slice(1, None), slice(None, -1)):
        live = np.arange(len(now))
        while len(live := np.array([i for i in live if len(now[i]) > 1], int)):
            shorter = [now[i][part] for i in live]
            good = score(shorter) >= least[live]
            for i, r, fine in zip(live, shorter, good):
                if fine:
                    now[i] = r
            live = live[good]
    return packed(now)


def phrase_dictionaries(toxic: list[bytes], ordinary: list[bytes], seed: int = 1) -> tuple[bytes, bytes]:
    """Texts of each class -> contents of the ordinary and of the toxic dictionary."""
    own = [phrase_windows(words_of(x)) for x in toxic]
    other = [w for x in ordinary for w in phrase_windows(words_of(x))]
    base = trained(other, ORDINARY_SIZE)
    if not own or not other:
        return base, base
    flat = [w for ws in own for w in ws]
    owner = np.repeat(np.arange(len(own)), [len(ws) for ws in own])
    book = _phrase_book(base)
    plain, plain_other = lengths(book, flat), lengths(book, other)
    total, times, clean = np.zeros(len(flat)), np.zeros(len(flat)), np.zeros(len(other))
    rng = np.random.default_rng(seed)
    against = book
    for _ in range(HALVES):
        half = np.zeros(len(own), bool)
        half[rng.permutation(len(own))[: -(-len(own) // 2)]] = True
        against = _phrase_book(trained([w for ws, inside in zip(own, half) if inside for w in ws], TOXIC_SIZE))
        free = ~half[owner]
        total[free] += np.clip(plain - lengths(against, flat), -2, 8)[free]
        times += free
        clean += np.clip(plain_other - lengths(against, other), -2, 8)
    cut = max(1.0, float(np.quantile(clean / HALVES, 1 - SPARE)))
    chosen = [flat[i] for i in np.flatnonzero(total / np.maximum(times, 1) > cut)]
    return base, trained(narrowed(chosen, book, against) if chosen else flat, TOXIC_SIZE)


def fit(texts: list[bytes], labels: list[int]) -> dict:
    """Whole labelled texts -> model. With one class only, the score is that class's smoothed share."""
    y = np.array(labels, int)
    part = np.array([int(i % 5 >= 3) for i in range(len(y))])  # three fifths train the dictionaries, two calibrate
    toxic = without_copies([x for x, k, h in zip(texts, y, part) if k and not h])
    ordinary = without_copies([x for x, k, h in zip(texts, y, part) if not k and not h])
    folded = [b" ".join(words_of(x)) for x in ordinary]
    samples = [x[i : i + 300] for x in folded for i in range(0, len(x), 300)]
    try:
        book = zstandard.train_dictionary(DICTIONARY + 800, samples).as_bytes()[-DICTIONARY:]
    except zstandard.ZstdError:  # too little text for the cover algorithm
        book = b" ".join(samples)[-DICTIONARY:]
    strings = strings_typical_of(toxic, ordinary)
    carrier = b" ".join(book.split()[-2:])[-8:] + b" "
    # Each string follows the carrier, so that one match covers both; then the shared content.
    model = {"ordinary": carrier + b"\n" + book, "toxic": b"".join(carrier + x + b"\n" for x in reversed(strings)) + carrier + b"\n" + book, "carrier": carrier, "strings": strings}
    model["phrases"] = phrase_dictionaries(toxic, ordinary)
    score, phrases = WindowScorer(model), PhraseScorer(model)
    width = len(_features(*NOTHING))
    x = np.array([document_features(t, score, phrases) for t in texts]).reshape(len(texts), width)
    other = part == 1 if len(set(y[part == 1])) == 2 else np.ones(len(y), bool)
    if len(set(y)) == 2:
        model["weights"] = _logistic(x[other], y[other]).tolist()
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        model["weights"] = [math.log(share / (1 - share))] + [0.0] * (width - 1)
    return model


def document_score(text: bytes, model: dict, score: WindowScorer, phrases: PhraseScorer) -> float:
    return 1 / (1 + math.exp(-float(np.clip(np.dot(document_features(text, score, phrases), model["weights"]), -30, 30))))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds == 0) & doc_id.isNotNull()


def training_sample(documents: DataFrame, labels: DataFrame, folds: int = FOLDS) -> tuple[list[bytes], list[int]]:
    """Labelled rows outside the held-out fold: of each class at most ``MAX_TOXIC`` or ``MAX_ORDINARY`` documents by least
    hash of the id, of which those are read that fit into ``SAMPLE_BYTES``, whole."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(7)), "doc_id"]
    picked = marks.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(marks.where("toxic = 0").orderBy(*order).limit(MAX_ORDINARY))
    # One text a doc_id: the longest, then the greatest.
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n"))
    sizes = docs.select("doc_id", "n").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n")).orderBy(*order).collect()
    room, chosen = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sizes:  # at most MAX_TOXIC + MAX_ORDINARY rows
        if r.n <= room[r.toxic]:
            room[r.toxic] -= r.n
            chosen.append((r.doc_id, r.toxic, r.n))
    few = F.broadcast(documents.sparkSession.createDataFrame(chosen, "doc_id long, toxic int, n int"))
    rows = docs.join(few, ["doc_id", "n"]).groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy(*order).select("toxic", F.col("text").cast("binary").alias("text")).toArrow()
    return rows.column("text").to_pylist(), rows.column("toxic").to_pylist()


def _scores(texts: pa.Array, model: dict) -> list[float]:
    """Scores of a column of texts; a worker keeps its scorers, and the words they met, between batches."""
    if _memo.get("model") != model:
        _memo.update(model=model, scorer=WindowScorer(model), phrases=PhraseScorer(model))
    return [document_score(x.as_py() or b"", model, _memo["scorer"], _memo["phrases"]) for x in texts.cast(pa.binary())]


def score_documents(documents: DataFrame, model: dict, folds: int = FOLDS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, held_out, score, predicted: one row a row, no shuffle.

    Null text is empty and gets a score too; a null doc_id is never held out; repeated rows
    score alike; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model), pa.float64())], names=["doc_id", "score"])

    docs = documents.select(row_id(), F.coalesce("text", F.lit("")).alias("text"))
    out = docs.mapInArrow(run, "doc_id long, score double").select(public_id("doc_id"), "score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    return score_documents(documents, fit(*training_sample(documents, labels, folds)), folds)


def drop_toxic(documents: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The rows of ``documents`` that aren't predicted toxic, with all their columns: one pass, nothing is shuffled."""
    model = fit(*training_sample(documents, labels, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.array(_scores(batch.column("text"), model), float) < 0.5
            yield batch.filter(pa.array(clean, pa.bool_()))
        _memo.clear()  # the worker goes on to other stages
        tidy()

    return documents.mapInArrow(run, documents.schema)
