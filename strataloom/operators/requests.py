"""Search requests: out-of-range numbers are clamped, wrong types are refused."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

MODES = ("hybrid", "fulltext", "semantic")


@dataclass(frozen=True)
class Request:
    query: str
    domain: str | None = None
    limit: int = 5
    min_score: float = 0.0
    mode: str = "hybrid"


def _number(body: dict, name: str, default: float, low: float, high: float, whole: bool) -> float:
    v = body.get(name, default)
    v = default if v is None else v
    if isinstance(v, str):
        try:
            v = float(v.strip())
        except ValueError:
            v = None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or (whole and v != int(v)):
        raise ValueError(f"{name} must be {'a whole number' if whole else 'a number'}")
    return max(low, min(v, high))


def parse(body: Any) -> Request:
    """A request of an agent, its domain filter yet to be resolved (documents.resolve_domains); an unknown mode is hybrid, unknown keys are ignored."""
    if not isinstance(body, dict):
        raise ValueError("a request is an object")
    q, domain = body.get("query"), body.get("domain_filter")
    if not isinstance(q, str) or not q.strip():
        raise ValueError("query must be a text that is not empty")
    if domain is not None and not isinstance(domain, str):
        raise ValueError("domain_filter must be a text")
    mode = body.get("mode") if body.get("mode") in MODES else "hybrid"
    return Request(q.strip(), domain, int(_number(body, "limit", 5, 1, 25, True)), float(_number(body, "min_score", 0.0, 0.0, 1.0, False)), mode)
