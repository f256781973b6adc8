"""Settings of an engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The numbers that results depend on."""

    default_collection: str = "docs_v4"
    window_over: int = 700
    window_words: int = 600
    overlap_sentences: int = 2
    least_section: int = 30
    least_content: int = 200
    rrf_k: int = 60
    fetch_factor: int = 4
    rerank_factor: int = 2
    hybrid_weight: float = 0.4
    rerank_weight: float = 0.6
    rerank_chars: int = 8000
    result_chars: int = 1500
    duplicate_ratio: float = 0.8
    duplicate_chars: int = 200
    debounce_seconds: float = 2.0
    sheet_rows: int = 50


SETTINGS = Settings()


class TextloomError(Exception):
    """Base of this package's errors."""


class IndexingError(TextloomError):
    pass


class UnsupportedFormatError(TextloomError):
    pass


class SearchError(TextloomError):
    pass


class CollectionError(TextloomError):
    pass


class StoreError(TextloomError):
    pass
