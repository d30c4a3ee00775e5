"""Embedding clients for use on executors: batching, pacing, retries, and a deterministic embedder for tests."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterable, Iterator


def batches(texts: Iterable[str], most: int = 32, most_tokens: int = 12_000, tokens: Callable[[str], int] = lambda t: max(1, len(t) // 4)) -> Iterator[list[str]]:
    """Greedy in order: a batch closes before it would pass either bound; a text over the bound goes alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        n = tokens(text)
        if held and (len(held) >= most or size + n > most_tokens):
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


class TokenBuckets:
    """Two refilling buckets, requests and tokens a minute. One a worker: give each its share of the limits."""

    def __init__(self, requests: float, tokens: float, headroom: float = 0.85, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rates = (requests * headroom / 60, tokens * headroom / 60)
        self.capacity = (requests * headroom, tokens * headroom)
        self.level = list(self.capacity)
        self.clock, self.sleep, self.last = clock, sleep, clock()

    def acquire(self, cost: float) -> None:
        """Waits until one request of ``cost`` tokens may go. A cost over the capacity raises instead of waiting for ever."""
        if cost > self.capacity[1]:
            raise ValueError(f"a request of {cost} tokens can never pass a bucket of {self.capacity[1]:g}")
        while True:
            now = self.clock()
            self.level = [min(c, v + r * (now - self.last)) for c, v, r in zip(self.capacity, self.level, self.rates)]
            self.last = now
            lack = [max(0.0, want - v) / r for want, v, r in zip((1, cost), self.level, self.rates)]
            if not any(lack):
                self.level = [self.level[0] - 1, self.level[1] - cost]
                return
            self.sleep(max(lack))


def backoff(attempt: int, most: float = 60.0, jitter: float = 5.0) -> float:
    return min(most, 2 ** (attempt - 1) + random.uniform(0, jitter))


def retrying(call: Callable[[list[str]], list[list[float]]], attempts: int = 10, throttled: Callable[[Exception], bool] = lambda e: any(w in str(e).lower() for w in ("429", "quota", "rate", "unavailable", "temporar", "timeout", "deadline", "exhausted")), sleep: Callable[[float], None] = time.sleep):
    """``call`` again after throttling errors, ``attempts`` times at most; other errors and wrong counts raise at once."""

    def run(texts: list[str]) -> list[list[float]]:
        for attempt in range(1, attempts + 1):
            try:
                out = call(texts)
            except Exception as error:
                if attempt == attempts or not throttled(error):
                    raise
                sleep(backoff(attempt))
                continue
            if len(out) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(out)} vectors")
            return out
        raise AssertionError

    return run


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Signed feature hashing of lower-cased words to unit vectors: the same everywhere, no network."""

    def one(text: str) -> list[float]:
        v = [0.0] * dim
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    return lambda texts: [one(t) for t in texts]


def counting_embedder() -> Callable[[list[str]], list[list[float]]]:
    """A text's characters, spaces and line feeds: vectors that SQL can say, to prove that rows keep theirs."""
    return lambda texts: [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


def vectors_of(reply: object) -> list[list[float]]:
    """Vectors in a service's reply: an object or mapping with ``embeddings`` or one ``embedding``, a list, or an object with ``to_dict``.
    A vector is a list, or has its numbers under ``values`` or ``embedding``."""
    if not isinstance(reply, dict | list) and hasattr(reply, "embeddings"):
        return [_vector(x) for x in reply.embeddings]
    if not isinstance(reply, dict | list) and callable(getattr(reply, "to_dict", None)):
        reply = reply.to_dict()
    if isinstance(reply, dict):
        if "embeddings" in reply:
            return [_vector(x) for x in reply["embeddings"]]
        if "embedding" in reply:
            return [_vector(reply["embedding"])]
    if isinstance(reply, list):
        return [_vector(x) for x in reply]
    raise TypeError(f"no vectors in a reply of {type(reply).__name__}")


def _vector(item: object) -> list[float]:
    if isinstance(item, dict):
        item = item["values"] if "values" in item else item["embedding"]
    elif not isinstance(item, list) and hasattr(item, "values"):
        item = item.values
    return [float(x) for x in item]


#: What a text is embedded for: documents of the corpus, or a question put to it.
TASKS = {"document": "RETRIEVAL_DOCUMENT", "query": "RETRIEVAL_QUERY"}


def client(service: Callable[[list[str], str], object], task: str = "document", limiter: TokenBuckets | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """``service(texts, task)`` -> an embedder: batches, paces, retries throttling, reads any reply shape and checks its size."""
    call = retrying(lambda texts: vectors_of(service(texts, TASKS[task])), sleep=sleep)

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for batch in batches(texts):
            if limiter is not None:
                limiter.acquire(sum(max(1, len(t) // 4) for t in batch))
            out += call(batch)
        return out

    return run
