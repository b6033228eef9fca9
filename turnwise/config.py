"""Paths and parameters of a run, from a small YAML file."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    raw_data: str = "data/raw"
    processed_data: str = "data/processed"
    outputs: str = "data/outputs"
    min_turn_length: int = 10
    top_n_terms: int = 30
    session_gap_minutes: int = 60


def parsed(text: str) -> dict[str, str]:
    """Leaves ``key: value`` of a file of nested mappings; comments and lists are passed over."""
    out = {}
    for line in text.splitlines():
        key, colon, value = line.split(" #")[0].strip().partition(":")
        if colon and value.strip() and not key.startswith(("#", "-")):
            out[key.strip()] = value.strip().strip("\"'")
    return out


def load(path: str | None) -> Config:
    """Defaults where the file or a key is absent; unknown keys don't matter."""
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        given = parsed(f.read())
    return Config(**{x.name: (int if x.type == "int" else str)(given[x.name]) for x in fields(Config) if x.name in given})
