"""Configuration files: loading and checking."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from pathlib import Path

import pandas as pd
import yaml

from chronolith.operators.labeling import Ontology
from chronolith.operators.links import SourceRule

STORAGE_KEYS = ("raw_dir", "processed_dir", "reports_dir")


def load_yaml(path: str | Path) -> dict:
    """A YAML mapping; FileNotFoundError without the file, ValueError for any other root."""
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the root must be a mapping")
    return found


def source_by_id(config: dict, source_id: str) -> dict:
    for source in config.get("sources") or []:
        if source.get("source_id") == source_id:
            return source
    raise KeyError(source_id)


@dataclass(frozen=True)
class Paths:
    raw: Path
    processed: Path
    reports: Path


def storage_paths(config: dict) -> Paths:
    storage = config.get("storage") or {}
    if gone := [k for k in STORAGE_KEYS if not storage.get(k)]:
        raise ValueError(f"storage lacks {gone}")
    return Paths(*[Path(storage[k]) for k in STORAGE_KEYS])


def source_rules(config: dict) -> list[SourceRule]:
    """The registry in order."""
    return [
        SourceRule(s["source_id"], tuple(s.get("allow") or ()), tuple(s.get("deny") or ()), s.get("kind", ""), bool(s.get("discovery_only")))
        for s in config.get("sources") or []
    ]


def load_ontology(path: str | Path) -> Ontology:
    return Ontology.from_dict(load_yaml(path))


NO_DATE = frozenset(("", "none", "null", "nan"))  # fixed values: words that stand for no date


def config_date(value: object) -> date | None:
    """A configured day (UTC); None for words that say none, and for what is no date."""
    said = str(value).strip() if value is not None else ""
    found = pd.NaT if said.lower() in NO_DATE else pd.to_datetime(said, errors="coerce", utc=True)
    return None if pd.isna(found) else found.date()


def source_caps(config: dict) -> dict[str, int]:
    """How many links each source may give, for sources that say so."""
    return {s["source_id"]: int(s["max_discovered_urls"]) for s in config.get("sources") or [] if s.get("max_discovered_urls")}
