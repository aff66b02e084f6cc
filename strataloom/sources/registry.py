"""Registry of sources: name -> reader of raw records and normaliser to documents, both over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Source:
    name: str
    normalize: Callable[[DataFrame], DataFrame]
    kind: str = "other"


_SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    """Adds a source; a name must be new and not empty."""
    if not source.name:
        raise ValueError("a source needs a name")
    if source.name in _SOURCES:
        raise ValueError(f"source {source.name} is registered already")
    _SOURCES[source.name] = source
    return source


def get(name: str) -> Source:
    if name not in _SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(names()) or 'none'}")
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


def valid_documents(raw: DataFrame, source: Source, limit: int | None = None) -> DataFrame:
    """Normalised documents with a title; the limit counts valid ones, after the filter."""
    good = source.normalize(raw).where("length(trim(title)) > 0 and length(trim(native)) > 0")
    return good if limit is None else good.limit(limit)
