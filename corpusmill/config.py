"""Settings of the engine; every operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults for crawling, chunking, encoding, retrieval and reporting."""

    allowed_hosts: tuple[str, ...] = ()
    max_pages: int = 5000
    depth_cap: int = 4
    content_types: tuple[str, ...] = ("text/html", "application/pdf")
    dense_k: int = 30
    sparse_k: int = 30
    rrf_k: int = 60
    top_k: int = 8
    confidence_threshold: float = 0.35
    max_chunk_tokens: int = 510
    target_chunk_tokens: int = 350
    overlap_tokens: int = 50
    small_section_tokens: int = 50
    quality_floor_tokens: int = 80
    encode_batch: int = 32
    encode_retries: int = 4
    encode_backoff_s: float = 1.0
    k_anonymity: int = 5
    contacts: dict[str, tuple[str, str]] = field(default_factory=dict)


def csv_set(text: str | None) -> tuple[str, ...]:
    """Comma-separated settings: trimmed, lower-cased, empty parts dropped."""
    return tuple(dict.fromkeys(p for p in (x.strip().lower() for x in (text or "").split(",")) if p))


DEFAULTS = Settings()
