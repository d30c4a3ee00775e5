"""Personal data: spans by fixed rules, and spans that boosted trees pick among many overlapping candidates.

The rules find e-mail addresses, IP addresses, payment cards and international telephone numbers in their usual spelling. They
miss addresses that are spelt out ("ann [at] host [dot] org"), IPv6, numbers that run into other numbers, cards
with dots, telephone numbers without a plus. Generators propose such spans with high recall: every run of digit groups, every "at", every
row of hexadecimal groups, with overlaps and wrong ends. Trees score each by its form and the words beside it;
scores are calibrated (isotonic) on examples kept out of the fit, and a threshold a kind is the least chance at which
``PRECISION`` of those kept out are right. Of overlapping candidates the likeliest stays; none may touch a rule's span.

There are no labelled spans, so the trees learn from examples made of the corpus itself: pieces of sampled texts without digits or
at signs, with a personal item in some spelling, or something alike that isn't one (dates, versions, order numbers,
tables, "at home"), put in their middle. A candidate is right if it is the item exactly. The sample is bounded:
``SAMPLE`` documents of least hash of the id, ``SAMPLE_CHARS`` of them in all; everything else covers all texts whole.

Cases: a null text is an empty one and has no spans; rows are judged one by one, so ids may repeat or be null; other columns
aren't read; an empty table gives no rows and fits on the made items alone. Every generator is linear in the text.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _boost
from ._common import tidy

KINDS = ("email", "ip", "card", "phone")
#: Documents, and characters of them in all, whose pieces surround the examples.
SAMPLE, SAMPLE_CHARS = 1000, 2_000_000
#: Examples made, the part kept out of the fit, and the share of those kept out that a threshold must get right.
EXAMPLES, KEPT_OUT, PRECISION = 6000, 0.3, 0.99
#: Characters beside a candidate whose words are features.
NEAR = 48
#: Candidates scored at a time.
JUDGED = 20_000

Span = tuple[int, int, int]  # kind, start, end

# ---- rules

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules, by kind and start."""
    out: list[Span] = []
    end = at = 0
    for m in _DOMAIN.finditer(text):
        # An address starts at the first character of the run before its sign, but after the last sign and address.
        floor = max(end, text.rfind("@", at, m.start()) + 1)
        start = len(text[floor : m.start()].rstrip(_LOCAL)) + floor
        at = m.start()
        if start < m.start():
            out.append((0, start, end := m.end()))
    if not any(c in text for c in "0123456789"):
        return out
    out += [(1, m.start(), m.end()) for m in _QUAD.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---- candidates

# Each begins with a fixed character or string, which the search looks for.
_AT = [re.compile(x) for x in (r"[@＠]\s?", r"[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]\s?", r" at\s", r" AT\s", r" At\s")]
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT|Dot)\s|\s?[.．]\s?)"
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_NEXT = re.compile(rf"{_DOT}[A-Za-z0-9-]{{1,63}}")
_PARTS = re.compile(r"[0-9]{1,3}(?:\s?[\[({]?\s?(?:[.．]|dot)\s?[\])}]?\s?[0-9]{1,3}){3}(?![0-9])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z:])")
_RUN = re.compile(r"[0-9]++(?:[ ().\-–/_ ]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal data; they overlap, and most are wrong. Addresses may be proposed twice."""
    for sign in _AT:
        for m in sign.finditer(text):
            at = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
            head = text[max(0, at - 64) : at]
            start = at - (len(head) - len(head.rstrip(_LOCAL)))
            label = _LABEL.match(text, m.end())
            if start == at or not label:
                continue
            end = label.end()
            for _ in range(5):
                if not (more := _NEXT.match(text, end)):
                    break
                yield 0, start, (end := more.end())
    if _COLONS.search(text):
        for m in _HEX.finditer(text):
            yield 1, m.start(), m.end()
    after = 0
    for g in _GROUP.finditer(text):
        if g.end() - g.start() <= 3 and (m := _PARTS.match(text, g.start())):
            yield 1, m.start(), m.end()
        if g.start() >= after:
            run = _RUN.match(text, g.start())
            after = run.end()
            if after - g.start() >= 9:
                yield from _numbers(text, run)


def _numbers(text: str, run: re.Match) -> Iterator[Span]:
    """Cards and telephone numbers among the windows of a run of digit groups."""
    groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run.group())]
    for i, (first, _) in enumerate(groups):
        n, start = 0, first
        if start and text[start - 1] == "(":
            start -= 1
        if start and text[start - 1] == "+":
            start -= 1
        for a, end in groups[i : i + 19]:
            n += end - a
            if n > 19:
                break
            whole = start if text[start] != "(" or ")" in text[start:end] else first
            if 9 <= n <= 15:
                yield 3, whole, end
            if n >= 13 and luhn(_digits(text[first:end])):
                yield 2, first, end


# ---- features. Words beside personal items, and beside things like them; ends of host names.

ASKS = {
    0: "email e-mail mail mailto contact write reach address kontakt correo courriel",
    1: "ip host server client login address from connect addr gateway dns adresse",
    2: "card credit visa mastercard amex debit payment pay pan cc karte carte tarjeta",
    3: "phone tel telephone call mobile fax cell contact whatsapp sms dial telefon telefono appeler",
}
OTHER = "version release isbn ean order invoice ref reference id no number serial build page section article date time timestamp sku case ticket code part model commit chapter v doi issn"
ENDS = "com org net edu gov io co uk de fr es it nl eu us info biz ai dev app me ch at be jp cn in br ru au ca example test local"
_ASKS = {k: frozenset(v.split()) for k, v in ASKS.items()}
_OTHER, _ENDS = frozenset(OTHER.split()), frozenset(ENDS.split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    body = text[start:end]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    left, right = before[-1:] or " ", after[:1] or " "
    said = [w.lower() for w in _WORD.findall(before)][-6:]
    digits, groups = _digits(body), [len(g) for g in _GROUP.findall(body)] or [0]
    values = [int(g) for g in _GROUP.findall(body)] if kind == 1 and len(body) < 64 else []
    seps = [c for c in body if not c.isalnum()]
    labels = re.split(r"[^A-Za-z0-9-]+", body)
    asks, other = _ASKS[kind], _OTHER
    return [
        *(float(kind == k) for k in range(4)),
        len(digits), len(body), len(groups), max(groups), min(groups), groups[0], groups[-1],
        *(body.count(c) for c in " -./(:"), len(set(seps)), body[0] == "+", body[0] == "(",
        float(len(groups) > 1 and len(set(groups[:-1])) == 1), float(groups == [4, 4, 4, 4]), float(groups[-2:] == [3, 4]), float(13 <= len(digits) <= 19 and luhn(digits)),
        float(digits[:1] in ("4", "5", "3", "6")), len(set(digits)), float(digits[:2] in ("19", "20")), float(bool(values) and all(v <= 255 for v in values)), float("::" in body),
        float("@" in body or "＠" in body), float(bool(re.search(r"[\[({<]", body)) if kind < 2 else 0), float(labels[-1].lower() in _ENDS) if kind == 0 else 0.0, len(labels[-1]) if kind == 0 else 0.0, len(labels), float(" at " in body.lower()), float(" dot " in body.lower()),
        float(bool(re.search(r"[.．]\s|\s[.．]", body))), float(labels[-1] != labels[-1].lower()) if kind == 0 else 0.0,
        float(left.isalnum()), float(right.isalnum()), float(left in "+-./,:$#=_"), float(right in "-/:%=_" or right in ".," and after[1:2].isdigit()),
        float(before[-3:].strip()[-1:].isdigit()), float(after[:3].strip()[:1].isdigit()), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        float(any(w in asks for w in said)), float(any(w in asks for w in said[-2:])), float(any(w in other for w in said)), float(any(w in other for w in said[-2:])),
    ]


# ---- examples


def _item(rng: random.Random) -> tuple[int, str]:
    """A personal item: its kind and spelling."""
    number = lambda n, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    kind = rng.randrange(4)
    if kind == 0:
        at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", "."), (" @ ", " . "), ("＠", "."), (" at ", " dot "), (" AT ", " DOT "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", "."), ("{at}", "{dot}"), ("@", "[.]"), ("<at>", "<dot>")])
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}{rng.randint(1, 99)}", f"{word()}.{rng.randint(10, 99)}"])
        return kind, local + at + dot.join([*(word() for _ in range(rng.choice([1, 1, 2]))), rng.choice(ENDS.split())])
    if kind == 1:
        if rng.random() < 0.4:
            parts = ["%x" % rng.randrange(1, 65536) for _ in range(8)]
            cut = rng.randint(2, 6)
            return kind, ":".join(parts) if rng.random() < 0.5 else ":".join(parts[:cut]) + "::" + ":".join(parts[cut + 1 :][: 7 - cut])
        return kind, rng.choice([".", ".", "[.]", "(.)", " . ", "[dot]", " dot "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        n = rng.choice([13, 14, 15, 16, 16, 16, 16, 16, 19])
        body = number(n - 1, rng.choice(["3456", "0123456789"]))
        body += next(c for c in "0123456789" if luhn(body + c))
        step = rng.choice([n, n, 4, 4, 4])
        return kind, rng.choice([" ", "-", ".", "/", "  ", "–", "_"]).join(body[i : i + step] for i in range(0, n, step))
    area, mid, last = number(3, "23456789"), number(3, "23456789"), number(4)
    return kind, rng.choice([
        f"({area}) {mid}-{last}", f"({area}) {mid} {last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+1 ({area}) {mid}-{last}", f"+1 {area} {mid} {last}", f"+1-{area}-{mid}-{last}", f"+{number(2, '23456789')} {number(3)} {number(7)}", f"1-{area}-{mid}-{last}",
        f"({area}){mid}-{last}", f"0{number(3, '123456789')} {number(7)}", f"0{number(3, '123456789')}/{number(7)}", f"+{number(2, '3456789')} (0) {number(3)} {number(6)}", f"{area} {mid} {last}",
    ])


def _decoy(rng: random.Random) -> str:
    """Something of similar form that isn't personal."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    date = f"20{number(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    valid = number(12)
    return rng.choice([
        date + f" {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", date.replace("-", rng.choice("/.")) + " - " + date.replace("-", "/"), f"{date} {number(4)}", number(rng.choice([9, 10, 11, 12, 13, 14, 15, 16, 16, 17, 18, 19, 20, 24])),
        ".".join(number(rng.choice([1, 1, 2])) for _ in range(rng.randint(5, 7))), "version " + ".".join(number(rng.choice([1, 1, 2])) for _ in range(4)), f"{number(1)}.{number(rng.randint(9, 17))}", f"isbn 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{rng.choice(OTHER.split())} {valid + next(c for c in '0123456789' if luhn(valid + c))}",
        f"{rng.choice(OTHER.split())} {number(4)}-{number(6)}", " ".join(number(rng.choice([1, 2, 2, 3])) for _ in range(rng.randint(6, 16))), " ".join(number(4) for _ in range(rng.randint(3, 9))), "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{number(2)}.{number(6)}, {number(2)}.{number(6)}", f"pages {number(3)}-{number(3)} ({number(4)})",
        f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}. {word()}", f"{word()} at the {word()} . {word().title()}", f"@{word()} . {word()}", f"{word()} @ {word()}", f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", ":".join(number(2) for _ in range(rng.randint(3, 6))), f"std::{word()}::{word()}",
        f"${number(3)} {number(3)} {number(3)}", f"{number(3)}+{number(4)} = {number(4)} - {number(3)}", f"{number(5)}/{number(5)} ({number(2)})", f"{word()}_{number(12)}", f"{number(4)} {number(4)} {number(4)}", "1 2 3 4 5 6 7 8 9 10 11 12",
    ])


def examples(texts: list[str], n: int = EXAMPLES, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in ``n`` made pieces."""
    rng = random.Random(seed)
    plain = [p for t in texts for p in re.findall(r"[^0-9@＠]{60,160}", t[:20_000])[:8]] or [" "]
    rows, labels = [], []
    for _ in range(n):
        around = rng.choice(plain)
        cut = around.find(" ", len(around) // 2)
        head, tail = (around[: cut + 1], around[cut:]) if cut >= 0 else (around + " ", " ")
        kind, item = _item(rng) if (good := rng.random() < 0.5) else (-1, _decoy(rng))
        bare = kind == 3 and not re.search(r"[+(]|\d{3}[-.]\d{3}[-.]\d{4}", item)
        if good and (bare or rng.random() < 0.4):  # a bare row of digits is a telephone number only where it is said to be
            head += rng.choice(ASKS[kind].split()) + rng.choice([" ", ": ", ":"])
        if good and kind in (1, 2) and rng.random() < 0.25:  # other numbers run into it
            head += "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 4))) + " "
        if good and kind in (2, 3) and rng.random() < 0.25:
            tail = " " + "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 6))) + tail
        text, start = head + item + tail, len(head)
        for span in dict.fromkeys(candidates(text)):
            rows.append(features(text, span))
            labels.append(good and span == (kind, start, start + len(item)))
    return np.array(rows, float), np.array(labels, bool)


@dataclass(frozen=True)
class Model:
    trees: _boost.Trees
    tables: tuple[tuple[np.ndarray, np.ndarray], ...]  # calibration of each kind
    least: tuple[float, ...]  # threshold of each kind

    def chances(self, x: np.ndarray) -> np.ndarray:
        margins = self.trees.margins(x)
        return np.select([x[:, k] == 1 for k in range(len(KINDS))], [_boost.chances(margins, t) for t in self.tables])


def learn(texts: list[str], n: int = EXAMPLES, precision: float = PRECISION) -> Model:
    """Trees, their calibration and the thresholds, from pieces of ``texts``."""
    x, y = examples(texts, n)
    out = np.array([hashlib.md5(r.tobytes()).digest()[0] < 256 * KEPT_OUT for r in x])  # equal rows stand on one side
    trees = _boost.fit(x[~out], y[~out])
    tables, least = [], []
    for kind in range(len(KINDS)):
        own = out & (x[:, kind] == 1)
        margins = trees.margins(x[own])
        tables.append(_boost.calibrated(margins, y[own]))
        chance = _boost.chances(margins, tables[-1])
        order = np.argsort(-chance, kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        last = np.flatnonzero((right >= precision) & (chance[order] >= 0.5))
        least.append(float(chance[order][last[-1]]) if len(last) else 2.0)
    return Model(trees, tuple(tables), tuple(least))


def sampled(documents: DataFrame, text: str = "text", key: str = "doc_id", n: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """Texts of the ``n`` rows of least hash, as far as ``chars`` go. A bound on the hash, from the count of rows, leaves little more than
    these to be sorted, however many tasks read the table."""
    least, rows = -(2**63), documents.count()
    bound = min(2**63 - 1, least + int(1.3 * n / max(rows, 1) * 2**64))
    hashed = documents.select(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("pii")).alias("h"), F.col(text).alias("t"))
    out, held = [], 0
    for row in hashed.where((F.col("h") <= bound) & F.col("t").isNotNull()).orderBy("h", F.md5("t")).limit(n).toLocalIterator():
        held += len(row.t)
        if held <= chars:
            out.append(row.t)
    return out


# ---- detection


def _kept(base: list[Span], found: list[tuple[float, Span]]) -> list[Span]:
    """The likeliest of overlapping candidates, none over a rule's span."""
    taken = sorted((s, e) for _, s, e in base)
    out = list(base)
    free = [(chance, span) for chance, span in found if not any(s < span[2] and span[1] < e for s, e in _between(taken, span))]
    held: list[tuple[int, int]] = []
    for _, span in sorted(free, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1][1], x[1][0])):
        near = _between(held, span)
        if not any(s < span[2] and span[1] < e for s, e in near):
            bisect.insort(held, (span[1], span[2]))
            out.append(span)
    return sorted(out)


def _between(spans: list[tuple[int, int]], span: Span) -> list[tuple[int, int]]:
    """Those of sorted spans that may touch ``span``: starts inside it, and the few that start before."""
    low, high = bisect.bisect_left(spans, (span[1], 0)), bisect.bisect_left(spans, (span[2], 0))
    return spans[max(0, low - len(KINDS)) : high]


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


DETECTED = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, redacted string"


def detect(documents: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """-> doc_id, n_email, n_ip, n_card, n_phone (the rules' spans), base and spans (all) as kind:start:end in code points, and
    the redacted text: each covered stretch as the name of its first span's kind in brackets."""
    known = documents.sparkSession.sparkContext.broadcast(model or learn(sampled(documents, text, key)))  # some 100 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = known.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [rule_spans(t) for t in texts]
            found: list[list[tuple[float, Span]]] = [[] for _ in texts]
            held: list[tuple[int, Span, list[float]]] = []

            def judge() -> None:
                for (i, span, _), chance in zip(held, learnt.chances(np.array([row for _, _, row in held], float))):
                    if chance >= learnt.least[span[0]]:
                        found[i].append((float(chance), span))
                held.clear()

            for i, t in enumerate(texts):
                for span in dict.fromkeys(candidates(t)):
                    held.append((i, span, features(t, span)))
                    if len(held) >= JUDGED:
                        judge()
            if held:
                judge()
            every = [_kept(b, f) for b, f in zip(base, found)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            strings = [pa.array(x, pa.string()) for x in (map(told, base), map(told, every), map(redacted, texts, every))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *strings], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"])
        tidy()

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DETECTED)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def report(documents: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of ``detect``."""
    found = detect(documents)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
