"""Settings with their defaults, and the readers of loosely written ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

RERANK_MODES = {"auto": "auto", "true_reranker": "true_reranker", "reranker": "true_reranker", "llm_scoring": "llm_scoring", "llm": "llm_scoring"}
SPEAKER_MODES = {"paper_v2": "paper_v2", "paper": "paper_v2", "appendix_prompt": "appendix_prompt", "appendix": "appendix_prompt", "disabled": "disabled", "off": "disabled", "none": "disabled"}


def as_bool(value: str | bool) -> bool:
    return value if isinstance(value, bool) else value.strip().lower() in ("1", "true", "yes", "on")


def as_mode(value: str, modes: Mapping[str, str]) -> str:
    found = modes.get(value.strip().lower().replace("-", "_"))
    if found is None:
        raise ValueError(f"unknown mode {value!r}; one of {sorted(modes)}")
    return found


@dataclass(frozen=True)
class Config:
    embedding_dim: int = 128
    recent_episodes: int = 6
    dedup_limit: int = 5
    max_layers: int = 4
    min_children: int = 2
    assign_batch: int = 96
    detail_batch: int = 48
    entity_detail_tokens: int = 768
    edge_tokens: int = 768
    reflection_rounds: int = 1
    episode_top_k: int = 10
    node_top_k: int = 20
    edge_top_k: int = 20
    candidate_limit: int = 50
    rrf_k: int = 60
    force_speaker: bool = True
    speaker_mode: str = "paper_v2"
    rerank_mode: str = "auto"
    entity_match: tuple[float, float] = (0.92, 0.88)
    edge_match: tuple[float, float] = (0.94, 0.88)

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "TESSERA_") -> Config:
        """From an environment-like mapping."""
        found = {}
        for f in fields(cls):
            raw = values.get(prefix + f.name.upper())
            if raw is None:
                continue
            if f.name == "speaker_mode":
                found[f.name] = as_mode(raw, SPEAKER_MODES)
            elif f.name == "rerank_mode":
                found[f.name] = as_mode(raw, RERANK_MODES)
            elif f.type == "bool":
                found[f.name] = as_bool(raw)
            elif f.type.startswith("tuple"):
                found[f.name] = tuple(float(x) for x in raw.split(","))
            else:
                found[f.name] = int(raw)
        return cls(**found)


def parse_indexes(text: str, n_users: int) -> list[int]:
    """User numbers such as ``0,2-4``: in order, each once; an error beyond the last user."""
    found: list[int] = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        low, _, high = part.partition("-")
        found += range(int(low), int(high or low) + 1)
    wrong = [k for k in found if not 0 <= k < n_users]
    if wrong:
        raise ValueError(f"no user {wrong[0]}; there are {n_users}")
    return list(dict.fromkeys(found))
