"""Settings of retrieval, ingestion and the agent: checked when made; switches of ablations, and settings without effect."""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Search:
    """Sizes and thresholds of candidate search."""

    entity_topk: int = 20
    relation_topk: int = 10
    entity_threshold: float = 0.2
    relation_threshold: float = 0.2
    bm25_share: float = 0.6
    keyword_mode: str = "both"

    def __post_init__(self):
        _check(self.entity_topk > 0 and self.relation_topk > 0, "top-k has to be positive")
        _check(all(-1 <= t <= 1 for t in (self.entity_threshold, self.relation_threshold)), "a cosine threshold lies between -1 and 1")
        _check(0 < self.bm25_share <= 1, "bm25_share lies between 0 and 1")
        _check(self.keyword_mode in ("high", "low", "both"), f"unknown keyword mode {self.keyword_mode}")


@dataclass(frozen=True)
class Activation:
    """Spreading activation."""

    hops: int = 2
    cut: float = 0.4
    keep: float = 0.5

    def __post_init__(self):
        _check(self.hops >= 0, "hops cannot be negative")
        _check(0 <= self.cut < 1 and 0 <= self.keep <= 1, "cut and keep lie between 0 and 1")


@dataclass(frozen=True)
class Evidence:
    """Selection of evidence."""

    summary_topk: int = 16
    direct_topn: int = 50
    direct_least: float = 0.35
    rerank_topk: int = 16
    rerank: bool = True

    def __post_init__(self):
        _check(min(self.summary_topk, self.direct_topn, self.rerank_topk) >= 0, "sizes cannot be negative")


@dataclass(frozen=True)
class Agent:
    """Refinement by commands."""

    mode: str = "filter_fetch"
    most_calls: int = 6
    most_ids: int = 8
    categories: tuple[str, ...] | None = None

    def __post_init__(self):
        _check(self.mode in ("filter", "fetch_only", "filter_fetch"), f"unknown mode {self.mode}")
        _check(self.most_calls > 0 and self.most_ids > 0, "calls and ids have to be positive")

    def applies_to(self, category: str | None) -> bool:
        """None of the settings' categories means all."""
        return self.categories is None or category in self.categories


@dataclass(frozen=True)
class Ingest:
    """How turns are taken in."""

    mode: str = "pair"
    chunk_turns: int = 0
    retries: int = 2

    def __post_init__(self):
        _check(self.mode in ("pair", "session", "chunk"), f"unknown ingest mode {self.mode}")
        _check(self.mode != "chunk" or self.chunk_turns > 0, "chunks need a size")
        _check(self.retries >= 0, "retries cannot be negative")


#: Environment switches that take one channel out, and what of the plan they take out.
SWITCHES = ("NO_LEXICAL", "NO_DENSE", "NO_RELATIONS", "NO_ACTIVATION", "NO_DIRECT", "NO_RERANK", "NO_TIME_REWRITE")


def switched_on(name: str, env: Mapping[str, str] | None = None) -> bool:
    """Whether a switch is set to something other than a no."""
    if name not in SWITCHES:
        raise ValueError(f"unknown switch {name}")
    return (env if env is not None else os.environ).get(name, "").strip().lower() not in ("", "0", "false", "no", "off")


def channels(env: Mapping[str, str] | None = None) -> frozenset[str]:
    """The channels that are left."""
    return frozenset(s.removeprefix("NO_").lower() for s in SWITCHES if not switched_on(s, env))


def without_effect(evidence: Evidence, env: Mapping[str, str] | None = None) -> list[str]:
    """Names of settings that differ from their default though nothing reads them as things stand."""
    left, usual = channels(env), Evidence()
    unread = set()
    if not evidence.rerank or "rerank" not in left:
        unread.add("rerank_topk")
    if evidence.direct_topn == 0 or "direct" not in left:
        unread |= {"direct_least"} | ({"direct_topn"} if "direct" not in left else set())
    return sorted(n for n in unread if getattr(evidence, n) != getattr(usual, n))


def sweep(base, variants: Mapping[str, Mapping]) -> dict:
    """The base settings with the changes of each named variant; an unknown field is an error."""
    known = {f.name for f in fields(base)}
    for name, changes in variants.items():
        if set(changes) - known:
            raise ValueError(f"variant {name} changes unknown settings {sorted(set(changes) - known)}")
    return {name: replace(base, **changes) for name, changes in variants.items()}


class Throttle:
    """At most `most` calls of a model in a sliding window of seconds, within one worker; wait() blocks until the next may go."""

    def __init__(self, most: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.seconds, self.clock, self.sleep, self.calls = most, seconds, clock, sleep, deque()

    def wait(self) -> None:
        while True:
            now = self.clock()
            while self.calls and now - self.calls[0] >= self.seconds:
                self.calls.popleft()
            if len(self.calls) < self.most:
                self.calls.append(now)
                return
            self.sleep(self.seconds - (now - self.calls[0]))


def retried(call: Callable, attempts: int = 8, first: float = 2.0, most: float = 60.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """call(), again after waits that double up to `most` seconds while `again` says that the error may pass."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not again(e):
                raise
            sleep(min(most, first * 2**n))
