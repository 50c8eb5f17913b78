"""Retrieval settings: what each may be, how they name collections and runs, and chat requests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

from ..operators.index import COLLECTION, RUN
from ..operators.retrieve import RERANK_CANDIDATES

#: What each setting may be, what it is if it isn't given, and the best known ones.
ALLOWED = {
    "corpus": ("apuntes", "manual", "combined"),
    "extras": ("base", "contextual", "hype"),
    "embedding": ("bgem3", "qwen06b", "qwen8b", "openai3large"),
    "search": ("densa", "hibrida"),
    "k": (3, 5, 10),
}
GIVEN = {"cap": 512, "rerank": False}
BEST = {"corpus": "combined", "cap": 512, "extras": "contextual", "embedding": "qwen8b", "search": "hibrida", "k": 10, "rerank": True}


def settings(**given: object) -> dict[str, object]:
    """All settings; one ValueError names every setting that is missing, unknown or not allowed."""
    s = GIVEN | given
    wrong = [f"{n} is {s.get(n)!r}, not one of {allowed}" for n, allowed in ALLOWED.items() if s.get(n) not in allowed]
    wrong += [f"{n} is no setting" for n in s if n not in ALLOWED and n not in GIVEN]
    if wrong:
        raise ValueError("; ".join(wrong))
    return s


def collection(s: dict[str, object]) -> str:
    return COLLECTION.format(**s)


def run_name(s: dict[str, object]) -> str:
    return RUN.format(**s) + ("-rerank" if s["rerank"] else "")


def candidates(s: dict[str, object]) -> int:
    """Hits to fetch: more if a reranker chooses among them."""
    return RERANK_CANDIDATES if s["rerank"] else int(s["k"])


def grid(**fixed: object) -> Iterator[dict[str, object]]:
    """All settings that agree with the given ones; an error if there are none."""
    free = {n: [v for v in allowed if fixed.get(n) in (None, v)] for n, allowed in ALLOWED.items()}
    empty = [f"{n}={fixed[n]!r}" for n, v in free.items() if not v]
    if empty:
        raise ValueError(f"no collection has {', '.join(empty)}")
    more = {n: v for n, v in fixed.items() if n in GIVEN and v is not None}
    return (settings(**dict(zip(free, v, strict=True)), **more) for v in product(*free.values()))


def parse_request(body: object, models: Iterable[str]) -> tuple[list[tuple[str, str]], str, str, dict[str, object]]:
    """(history, question, model, settings) of a chat request; anything else raises ValueError."""
    if not isinstance(body, dict):
        raise ValueError("the request is no object")
    question, history, model, config = (body.get(k) for k in ("question", "history", "model", "config"))
    if not isinstance(question, str) or not question.strip():
        raise ValueError("question is blank")
    if not isinstance(history, list) or not all(isinstance(h, list | tuple) and len(h) == 2 and all(isinstance(x, str) for x in h) for h in history):
        raise ValueError("history is no list of pairs of strings")
    if model not in tuple(models):
        raise ValueError(f"model is not one of {tuple(models)}")
    if not isinstance(config, dict) or not set(ALLOWED) <= set(config):
        raise ValueError("config is not complete")
    return [tuple(h) for h in history], question, model, settings(**{n: config[n] for n in ALLOWED}, rerank=bool(config.get("rerank", False)))
