"""Transcript parsing by a hidden Markov model, and canonical turn rendering.

States are roles; observations are lines, described by their speaker marker, position in the
turn, length and punctuation. Start, transition and emission counts come from the rows whose role is
known, in the conversations that aren't held out, on top of a prior by which a marker speaks for its role. Viterbi
recovers the roles.

The lines are described once; what is sorted and decoded are their codes, not the texts. Rows are ordered by
ranges, so that a conversation of any length spreads over tasks, and cut into chunks of at most ``CHUNK`` rows. The recursion is a
product of max-plus matrices: one matrix a chunk is made in parallel, then one a run of at most ``2 ** RUN_BITS`` chunks; the runs'
matrices of a conversation (nine numbers for half a million rows) are chained, then each run's chunks between the run's known
ends, and each chunk is decoded between its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ROW, numbered, stored

CHUNK = 512
RUN_BITS = 10
FOLDS = 5
ROLES = ("system", "user", "assistant")
#: Words that name a speaker at the start of a line, by role, and words that may as well begin what is said.
NAMES = {"system": ("system", "developer"), "user": ("user", "human", "customer", "prompter"), "assistant": ("assistant", "ai", "bot", "agent", "gpt")}
HINTS = {"system": ("instruction", "instructions"), "user": ("question", "q", "me", "you"), "assistant": ("answer", "a", "model", "response")}
#: The frame of a marker; the first group is its word.
MARKER = r"(?i)^\s*[\[<#*|]*\s*([a-z]{1,12})\s*[\]>*|]*\s*[:>]"
#: Lines that a marker counts for its own role before any is seen.
NAME_PRIOR, HINT_PRIOR = 200.0, 20.0
#: Values of a line's features: marker (none, a name or a hint of each role), first line of the turn, first turn, log2 length, ends with '?'.
SIZES = (1 + 2 * len(ROLES), 2, 2, 12, 2)
NO_ID = -(2**63)


def line_code(line: Column, index: Column, first_turn: Column) -> Column:
    """The features as one number."""
    word = F.lower(F.regexp_extract(line, MARKER, 1))
    code = F.lit(0)
    for i, role in enumerate(ROLES):
        code = F.when(word.isin(*NAMES[role]), i + 1).when(word.isin(*HINTS[role]), i + 1 + len(ROLES)).otherwise(code)
    length = F.least(F.floor(F.log2(F.char_length(line) + 1)), F.lit(SIZES[3] - 1)).cast("int")
    for size, value in zip(SIZES[1:], ((index == 0).cast("int"), first_turn.cast("int"), length, F.endswith(F.rtrim(line), F.lit("?")).cast("int"))):
        code = code * size + value
    return code.cast("short")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")


def held_out(conv_id: Column, folds: int = FOLDS) -> Column:
    """A fifth of the conversations, by their ids; rows without one never."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


CHUNKS = "conv_id long, chunk long, rows array<long>, roles array<int>, codes array<array<short>>"
_CHUNKS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("rows", pa.list_(pa.int64())), ("roles", pa.list_(pa.int32())), ("codes", pa.list_(pa.list_(pa.int16())))])


def chunks_of(turns: DataFrame, size: int | None = None) -> DataFrame:
    """Numbered turns -> one row a chunk: conv_id, chunk (ordered in its conversation), and its rows' numbers, known roles (-1: none) and line codes."""
    role = F.lower(F.col("role").cast("string")) if "role" in turns.columns else F.lit(None).cast("string")
    known = F.lit(-1)
    for i, name in enumerate(ROLES):
        known = F.when(role == name, i).otherwise(known)
    described = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), known.alias("role"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), ROW, lines_of(F.col("text")).alias("lines"),
    )
    described = described.withColumn("codes", F.transform("lines", lambda x, i: line_code(x, i, F.col("turn") <= 0))).drop("lines")
    order = ["conv_id", "turn", "tie", ROW]
    most = size or CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        out, held = [], []
        for batch in batches:
            for conv, role, row, codes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", ROW, "codes"))):
                if held and (held[0][0] != conv or len(held) == most):
                    out.append((held[0][0], base + k, [h[1] for h in held], [h[2] for h in held], [h[3] for h in held]))
                    held, k = [], k + 1
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHUNKS)], schema=_CHUNKS)
                        out = []
                held.append((conv, row, role, codes))
        if held:
            out.append((held[0][0], base + k, [h[1] for h in held], [h[2] for h in held], [h[3] for h in held]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHUNKS)], schema=_CHUNKS)

    return described.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", ROW, "codes").mapInArrow(cut, CHUNKS)


def _run() -> Column:
    """The run of a chunk: chunks are numbered in order from a task's multiple of 2 ** 32, so a run never spans two tasks."""
    return F.shiftright("chunk", RUN_BITS).alias("run")


def prior() -> np.ndarray:
    """Emission counts before any line: one of each kind, and markers for their roles."""
    emit = np.ones((len(ROLES), int(np.prod(SIZES))))
    cube = emit.reshape(len(ROLES), *SIZES)
    rest = cube[0, 0].size
    for i in range(len(ROLES)):
        cube[i, 1 + i] += NAME_PRIOR / rest
        cube[i, 1 + i + len(ROLES)] += HINT_PRIOR / rest
    return emit


def model_of(emit: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> dict:
    """Counts -> log-probabilities. Each feature on its own given the role."""
    total = 0.0
    cube = emit.reshape(len(ROLES), *SIZES)
    for axis in range(len(SIZES)):
        own = cube.sum(axis=tuple(k + 1 for k in range(len(SIZES)) if k != axis))
        own = np.log(own / own.sum(axis=1, keepdims=True))
        total = total + own.reshape(len(ROLES), *(s if k == axis else 1 for k, s in enumerate(SIZES)))
    # Inside a turn the speaker only changes at a marker.
    stay = np.full((len(ROLES), len(ROLES)), math.log(1e-4)) + np.eye(len(ROLES)) * (math.log1p(-2e-4) - math.log(1e-4))
    return {"emit": np.asarray(total).reshape(len(ROLES), -1), "turn": np.log(moves / moves.sum(axis=1, keepdims=True)), "line": stay, "start": np.log(starts / starts.sum())}


def fit(chunks: DataFrame, folds: int = FOLDS) -> dict:
    """The model of all rows whose role is one of ``ROLES``, in conversations that aren't held out."""
    train = chunks.where(~held_out(F.when(F.col("conv_id") != NO_ID, F.col("conv_id")), folds))
    n = len(ROLES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, moves = np.zeros((n, int(np.prod(SIZES))), np.int64), np.zeros((n, n), np.int64)
        for batch in batches:
            for roles, codes in zip(batch.column("roles").to_pylist(), batch.column("codes").to_pylist()):
                for role, own in zip(roles, codes):
                    if role >= 0:
                        np.add.at(emit[role], own, 1)
                for a, b in zip(roles, roles[1:]):
                    if a >= 0 and b >= 0:
                        moves[a, b] += 1
        for kind, table in enumerate((emit, moves)):
            a, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b), pa.array(table[a, b])], names=["kind", "a", "b", "n"])

    emit, moves, starts = prior(), np.ones((n, n)), np.ones(n)
    counted = train.select("roles", "codes").mapInArrow(count, "kind long, a long, b long, n long")
    for kind, a, b, k in counted.groupBy("kind", "a", "b").agg(F.sum("n")).collect():  # at most 3 x prod(SIZES) + 9 rows
        (emit, moves)[kind][a, b] += k
    from pyspark.sql import Window

    ends = train.select("conv_id", "chunk", _run(), F.get("roles", F.lit(0)).alias("first"), F.element_at("roles", -1).alias("last"))
    runs = ends.groupBy("conv_id", "run").agg(F.min_by("first", "chunk").alias("first"), F.max_by("last", "chunk").alias("last"))
    inside = ends.withColumn("before", F.lag("last").over(Window.partitionBy("conv_id", "run").orderBy("chunk"))).where("before is not null")
    between = runs.withColumn("before", F.lag("last").over(Window.partitionBy("conv_id").orderBy("run")))
    both = inside.select("before", "first").unionByName(between.select("before", "first")).where("first >= 0")
    for before, first, k in both.groupBy("before", "first").count().collect():
        if before is None:
            starts[first] += k
        elif before >= 0:
            moves[before, first] += k
    return model_of(emit, moves, starts)


def _steps(model: dict, rows: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Transition and emission of every line; a turn's first line, and a marked one, uses the turn transitions."""
    marked = int(np.prod(SIZES[1:]))
    return [(model["turn"] if i == 0 or c >= marked else model["line"], model["emit"][:, c]) for codes in rows for i, c in enumerate(codes)]


def chunk_matrix(model: dict, rows: list[list[int]]) -> np.ndarray:
    """Best log-score from each state before the chunk to each state at its end."""
    best = np.where(np.eye(len(ROLES), dtype=bool), 0.0, -np.inf)
    for move, emit in _steps(model, rows):
        best = (best[:, :, None] + move[None]).max(axis=1) + emit
    return best


def first_scores(model: dict, rows: list[list[int]]) -> np.ndarray:
    """Best log-score of each state at the end of a conversation's first chunk."""
    score = None
    for move, emit in _steps(model, rows):
        score = model["start"] + emit if score is None else (score[:, None] + move).max(axis=0) + emit
    return score


def viterbi(model: dict, rows: list[list[int]], before: int | None = None, end: int | None = None) -> list[int]:
    """States of all lines; ``before`` and ``end`` fix the state before the first line and of the last. Ties: the lower state."""
    back, score = [], None
    for move, emit in _steps(model, rows):
        if score is None:
            score = (model["start"] if before is None else move[before]) + emit
            continue
        paths = score[:, None] + move
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + emit
    if score is None:
        return []
    states = [int(score.argmax()) if end is None else end]
    for step in reversed(back):
        states.append(int(step[states[-1]]))
    return states[::-1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Best log-score from each state before the first matrix to each state after the last."""
    best = matrices[0]
    for m in matrices[1:]:
        best = (best[:, :, None] + m[None]).max(axis=1)
    return best


def chain(matrices: list[np.ndarray], first: np.ndarray, before: int | None = None, end: int | None = None) -> list[tuple[int | None, int]]:
    """(state before, state at the end) of each chunk. ``first``: scores at the end of the first; ``before`` and ``end`` fix the state before the
    first, which then has its matrix' scores, and the last state."""
    scores = [first if before is None else matrices[0][before]]
    for m in matrices[1:]:
        scores.append((scores[-1][:, None] + m).max(axis=0))
    ends = [int(scores[-1].argmax()) if end is None else end]
    for k in range(len(matrices) - 1, 0, -1):
        ends.append(int((scores[k - 1] + matrices[k][:, ends[-1]]).argmax()))
    ends.reverse()
    return [(ends[k - 1] if k else before, ends[k]) for k in range(len(ends))]


def roles_of_lines(chunks: DataFrame, model: dict) -> DataFrame:
    """Chunks -> row number, states of its lines."""
    n = len(ROLES)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("chunk"), pa.array([chunk_matrix(model, c).ravel().tolist() for c in codes], pa.list_(pa.float64())), pa.array([first_scores(model, c).tolist() for c in codes], pa.list_(pa.float64()))],
                names=["conv_id", "chunk", "m", "first"],
            )

    def square(ms) -> list[np.ndarray]:
        return [np.array(m).reshape(n, n) for m in ms]

    def joined(pdf):
        pdf = pdf.sort_values("chunk")
        ms, first = square(pdf["m"]), np.array(pdf["first"].iloc[0])
        for m in ms[1:]:
            first = (first[:, None] + m).max(axis=0)
        return pdf.head(1)[["conv_id", "run"]].assign(m=[product(ms).ravel().tolist()], first=[first.tolist()])

    def chained(pdf):
        pdf = pdf.sort_values("run")
        ends = chain(square(pdf["m"]), np.array(pdf["first"].iloc[0]))
        return pdf.assign(since=[-1 if b is None else b for b, _ in ends], until=[e for _, e in ends])[["conv_id", "run", "since", "until"]]

    def within(pdf):
        pdf = pdf.sort_values("chunk")
        since, until = int(pdf["since"].iloc[0]), int(pdf["until"].iloc[0])
        ends = chain(square(pdf["m"]), np.array(pdf["first"].iloc[0]), None if since < 0 else since, until)
        return pdf.assign(before=[-1 if b is None else b for b, _ in ends], ending=[e for _, e in ends])[["chunk", "before", "ending"]]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, states = [], []
            for own, codes, before, end in zip(*(batch.column(c).to_pylist() for c in ("rows", "codes", "before", "ending"))):
                path = np.array(viterbi(model, codes, None if before is None or before < 0 else before, end), np.int8)
                rows += own
                states += np.split(path, np.cumsum([len(c) for c in codes])[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([s.tolist() for s in states], pa.list_(pa.int8()))], names=[ROW, "states"])

    many = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id")
    parts = chunks.join(many, "conv_id", "left_semi").select("conv_id", "chunk", "codes").mapInArrow(matrices, "conv_id long, chunk long, m array<double>, first array<double>")
    parts = stored(parts.select("*", _run()), "chat-parts")
    runs = parts.groupBy("conv_id", "run").applyInPandas(joined, "conv_id long, run long, m array<double>, first array<double>")
    known = parts.join(runs.groupBy("conv_id").applyInPandas(chained, "conv_id long, run long, since int, until int"), ["conv_id", "run"])
    known = known.groupBy("conv_id", "run").applyInPandas(within, "chunk long, before int, ending int")
    ready = chunks.select("conv_id", "chunk", "rows", "codes").join(known, "chunk", "left")
    return ready.select("rows", "codes", "before", "ending").mapInArrow(decoded, f"{ROW} long, states array<tinyint>")


def parse(turns: DataFrame, model: dict | None = None, folds: int = FOLDS) -> DataFrame:
    """turns(conv_id, turn, text[, role]) -> conv_id, turn, held_out, role, roles, n_lines, rendered: one row per row.

    ``roles`` are the recovered roles of the row's pieces in order (more than one where a marker
    changes the speaker inside a row), ``role`` the first. ``rendered`` is each piece as
    ``<|role|>``, its lines, ``<|end|>``. A piece's first line loses the marker of the recovered role if that
    names a speaker ("User:"), or if the row has several pieces; "Answer: 42" as a whole row stays as it is.
    Known roles are used to fit the model only, and only outside the held-out conversations; without any, or without
    the column, markers decide. Null texts are one empty line; a null turn sorts first (as -1), null conversations are
    one conversation. Rows that tie on (conv_id, turn) are ordered by a hash of their texts. Rows repeated in
    full are turns of their own. Other columns are ignored; an empty table gives no rows.
    """
    turns = numbered(turns)
    chunks = stored(chunks_of(turns), "chat-chunks")
    states = roles_of_lines(chunks, model or fit(chunks, folds))
    rows = turns.select(ROW, F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text")).join(states, ROW)
    names = F.array(*[F.lit(r) for r in ROLES])
    state = lambda i: F.get("states", i).cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.size("states") - 1), lambda i: (i == 0) | (F.get("states", i) != F.get("states", i - 1)))
    stops = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("states")))

    def first_line(i: Column) -> Column:
        line = F.get("lines", i)
        word = F.lower(F.regexp_extract(line, MARKER, 1))
        out = F.lit(False)
        for k, role in enumerate(ROLES):
            sure = word.isin(*NAMES[role]) | (word.isin(*HINTS[role]) & (F.size("starts") > 1))
            out = F.when(state(i) == k, sure).otherwise(out)
        return F.when(out, F.regexp_replace(line, MARKER + r"\s*", "")).otherwise(line)

    piece = lambda a, b: F.array_join(F.concat(F.array(first_line(a)), F.slice("lines", a + 2, b - a - 1)), "\n")
    rendered = F.array_join(F.zip_with("starts", "stops", lambda a, b: F.concat(F.lit("<|"), F.get(names, state(a)), F.lit("|>\n"), piece(a, b), F.lit("\n<|end|>"))), "\n")
    out = rows.withColumn("lines", lines_of(F.col("text"))).withColumn("starts", starts).withColumn("stops", stops)
    return out.select(
        "conv_id", "turn", held_out(F.col("conv_id"), folds).alias("held_out"), F.get(names, state(F.lit(0))).alias("role"),
        F.transform("starts", lambda i: F.get(names, state(i))).alias("roles"), F.size("lines").cast("long").alias("n_lines"), rendered.alias("rendered"),
    )
