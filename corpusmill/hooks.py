"""What can be added from outside: extractors, vectorisers, and hooks on events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: The events that hooks may wait for.
EVENTS = ("on_ingest", "on_run_start", "on_run_complete", "on_merge", "on_search", "on_error")


@dataclass
class Extractor:
    """read(content, options) gives blocks (kind, name, content, start, end, level, page), as the parsers do."""

    name: str
    version: str
    read: Callable
    mimes: tuple[str, ...] = ()


@dataclass
class Vectorizer:
    """vectors(df, key, dims, config, env) gives (chunk_id, vector)."""

    name: str
    version: str
    vectors: Callable


@dataclass
class Registry:
    """By name and by MIME type; the last registration wins."""

    extractors: dict[str, Extractor] = field(default_factory=dict)
    by_mime: dict[str, Extractor] = field(default_factory=dict)
    vectorizers: dict[str, Vectorizer] = field(default_factory=dict)
    hooks: list[tuple[int, int, str, Callable]] = field(default_factory=list)

    def add_extractor(self, e: Extractor) -> None:
        self.extractors[e.name] = e
        self.by_mime |= dict.fromkeys(e.mimes, e)

    def extractor_for(self, mime: str) -> Extractor:
        """The extractor of a MIME type; KeyError if none is registered."""
        return self.by_mime[mime]

    def add_vectorizer(self, v: Vectorizer) -> None:
        self.vectorizers[v.name] = v

    def add_hook(self, event: str, call: Callable[[dict], None], priority: int = 0) -> None:
        """call gets what the event is about; higher priorities go first, then earlier registrations."""
        if event not in EVENTS:
            raise ValueError(f"unknown event {event}")
        self.hooks.append((-priority, len(self.hooks), event, call))

    def fire(self, event: str, **about) -> int:
        """Call the hooks of an event; how many there were. What a hook raises goes to the caller."""
        hit = sorted((h for h in self.hooks if h[2] == event), key=lambda h: h[:2])
        for _, _, _, call in hit:
            call({"event": event, **about})
        return len(hit)


REGISTRY = Registry()
