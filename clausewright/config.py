"""Settings: nested values by dotted path, defaults, YAML on top."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from . import dims

DEFAULTS: dict[str, Any] = {
    "preprocessing": {"max_chunk_chars": dims.CHUNK_MAX, "min_chunk_chars": dims.CHUNK_MIN},
    "schema_discovery": {"max_chunks_per_entity_type": dims.PER_TYPE_SAMPLE, "max_total_chunks": dims.TOTAL_SAMPLE, "max_retries": dims.RETRIES, "retry_backoff_base": dims.BACKOFF_BASE},
    "atomizer": {
        "batch_processing": {"max_batch_chars": dims.BATCH_CHARS, "max_retries_per_batch": dims.RETRIES, "retry_backoff_base": dims.BACKOFF_BASE},
        "failure_handling": {"batch_failure_threshold": dims.BATCH_FAILURE_THRESHOLD},
        "confidence_thresholds": {"pass1": dims.PASS_THRESHOLDS[1], "pass2": dims.PASS_THRESHOLDS[2]},
        "fragment_detection": {"pronouns": list(dims.REQUIREMENT_PRONOUNS)},
    },
    "confidence_gate": {"thresholds": {k: {"auto_accept": a, "human_review": h} for k, (a, h) in dims.GATES.items()}},
    "deduplication": {"jaccard_similarity_threshold": dims.DUPLICATE_SIMILARITY},
    "llm": {"temperature": 0.0, "temperature_retry": 0.1, "temperature_first": 0.1, "temperature_second": 0.0, "max_tokens": 4096},
}


def _merge(a: dict, b: dict) -> dict:
    return {**a, **{k: _merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}


class Config:
    """get("a.b.c", default): null and missing values give the default."""

    def __init__(self, path: str | Path | None = None):
        self.path = path
        self.reload()

    def reload(self) -> None:
        self.values = DEFAULTS
        if self.path and Path(self.path).exists():
            import yaml

            self.values = _merge(DEFAULTS, yaml.safe_load(Path(self.path).read_text()) or {})

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or at.get(part) is None:
                return default
            at = at[part]
        return at

    def section(self, key: str) -> dict:
        return self.get(key, {})

    def gates(self) -> dict[str, tuple[float, float]]:
        """(auto_accept, human_review) by document format."""
        return {k: (float(v["auto_accept"]), float(v["human_review"])) for k, v in self.section("confidence_gate.thresholds").items()}

    def pass_thresholds(self) -> dict[int, float]:
        at = self.section("atomizer.confidence_thresholds")
        return {1: float(at["pass1"]), 2: float(at["pass2"])}

    def temperatures(self) -> tuple[float, float]:
        """Of the first pass and of the second."""
        return float(self.get("llm.temperature_first", 0.1)), float(self.get("llm.temperature_second", 0.0))
