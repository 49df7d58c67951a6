"""The tables of the memory graph."""

from __future__ import annotations

EPISODES = "group_id string, uuid string, source_id string, speaker string, content string, valid_at timestamp, seq long, metadata_json string, episode_embedding array<float>, ingestion_complete boolean"
ENTITIES = "group_id string, uuid string, name string, summary string, tag array<string>, is_speaker boolean, episode_idx array<string>, source_ids array<string>, name_embedding array<float>, summary_embedding array<float>"
CATEGORIES = "group_id string, uuid string, name string, summary string, tag array<string>, layer int, summary_embedding array<float>"
RELATES_TO = "group_id string, uuid string, source_uuid string, target_uuid string, fact string, valid_at timestamp, invalid_at timestamp, fact_embedding array<float>"
MENTIONS = "group_id string, entity_uuid string, episode_uuid string"
CATEGORIZES = "group_id string, parent_uuid string, child_uuid string"
EVENTS = "event_type string, stage string, operation string, runtime_seconds double, model string, prompt_tokens long, completion_tokens long, total_tokens long, metadata map<string,string>, started_at string, seq long"
ANSWERS = "user_index int, group_id string, question_index int, question string, reference_answer string, predicted_answer string, is_correct boolean, judge_confidence double, judge_reasoning string, category string, evidence array<string>, error string"

#: Natural keys; the stores assert that they are unique.
KEYS = {
    "episodes": ("group_id", "source_id"),
    "entities": ("uuid",),
    "categories": ("uuid",),
    "relates_to": ("uuid",),
    "mentions": ("group_id", "entity_uuid", "episode_uuid"),
    "categorizes": ("group_id", "parent_uuid", "child_uuid"),
}
