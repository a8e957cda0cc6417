"""Settings with their defaults and bounds, from the environment or given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

#: The least value of settings that have one.
LEAST = {
    "ground_truth_rows": 1, "schema_chars": 2000, "sample_chars": 2000, "schema_props": 5, "sample_labels": 1, "sample_rows": 1,
    "sample_props": 3, "value_chars": 20, "supernodes": 1, "max_pairs": 1, "max_level": 1, "path_limit": 1, "max_hops": 1, "retrieval_k": 1, "chunk_size": 1, "limit_questions": 0,
}


@dataclass
class EngineConfig:
    """One object for every default of the engine. Names of environment variables are GRAPHBENCH_ and the field's name in capitals."""

    ground_truth_rows: int = 10
    near_threshold: float = 0.92
    samples_per_label: int = 10
    supernodes: int = 20
    max_pairs: int = 50
    pair_strategy: str = "sample"
    max_level: int = 5
    path_limit: int = 25
    max_hops: int = 15
    hint_hops: int = 8
    hop1_collected: int = 64
    hop2_collected: int = 96
    hop1_kept: int = 20
    hop2_kept: int = 30
    context_lines: int = 16
    neighbour_limit: int = 28
    max_contexts: int = 24
    cross_branch_items: int = 5
    end_labels: int = 5
    seed: int = 42
    schema_chars: int = 12_000
    sample_chars: int = 24_000
    schema_props: int = 40
    sample_labels: int = 30
    sample_rows: int = 3
    sample_props: int = 12
    value_chars: int = 180
    chunk_size: int = 600
    chunk_overlap: int = 100
    retrieval_k: int = 5
    query_mode: str = "naive"
    limit_questions: int = 0
    rebuild_index: bool = False
    rel_mode: str = "keywords_primary"
    type_label: bool = True
    temperature: float = 0.2
    model: str = "offline"
    judge_model: str = ""

    def __post_init__(self) -> None:
        for name, least in LEAST.items():
            setattr(self, name, max(least, getattr(self, name)))
        self.samples_per_label = min(10, max(5, self.samples_per_label))
        self.judge_model = self.judge_model.strip() or self.model

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **given) -> EngineConfig:
        """Given values first, then the environment, then defaults; a text that is no number is an error."""
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on")}
        found = {f.name: kinds[f.type](env[key]) for f in fields(cls) if (key := f"GRAPHBENCH_{f.name.upper()}") in env and env[key].strip()}
        return cls(**(found | given))


def resolve_path(name: str, *folders: str | Path) -> Path:
    """An absolute path as it is; else the first folder that has the file, else the place in the first folder."""
    p = Path(name).expanduser()
    places = [p] if p.is_absolute() else [Path(f) / p for f in folders or (".",)]
    return next((x for x in places if x.is_file()), places[0]).resolve()
