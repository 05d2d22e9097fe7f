"""Typed tables of the memory model."""

from __future__ import annotations

# The enumerations of the model.
MEMORY_TYPES = "LongTermMemory UserMemory EpisodicMemory WorkingMemory SkillMemory ToolSchemaMemory ToolTrajectoryMemory PreferenceMemory SemanticMemory".split()
TEXT_TYPES = ["LongTermMemory", "UserMemory", "EpisodicMemory"]
SKILL_TYPES = ["SkillMemory"]
TOOL_TYPES = ["ToolSchemaMemory", "ToolTrajectoryMemory"]
RELATIONS = "MERGED_INTO EXTRACTED_FROM CONTRADICTS RELATED MENTIONS_ENTITY CONSOLIDATED_INTO CAUSES SUPPORTS SAME_SESSION TIMELINE_NEXT SIMILAR_COSINE_HIGH".split()
LABELS = "query add mem_read mem_organize mem_update pref_add mem_archive mem_feedback answer".split()
HIGH_PRIORITY = ["mem_update", "query", "mem_feedback"]
FEEDBACK_LABELS = ["positive", "negative", "neutral", "correction"]


# Table schemas, as DDL.
MEMORY = (
    "id string, user_name string, user_id string, agent_id string, session_id string, memory string, memory_type string, status string, "
    "created_at timestamp, updated_at timestamp, key string, tags array<string>, background string, info map<string,string>, confidence double, "
    "importance_score double, access_count int, retrieval_count int, hierarchy_level string, parent_memory_id string, pagerank double, "
    "ce_score_topk array<struct<neighbor_id:string,score:float>>, embedding array<float>"
)
EDGES = "from_id string, to_id string, relation string, confidence double, valid_at timestamp, invalid_at timestamp, rationale string"
ENTITIES = "id string, user_name string, name string, entity_type string, embedding array<float>"
ENTITY_EDGES = "user_name string, from_entity string, predicate string, to_entity string, memory_id string, valid_at timestamp, invalid_at timestamp"
PROFILES = "cube_id string, user_id string, topic string, sub_topic string, memo string, confidence double, valid_at timestamp, updated_at timestamp, expired_at timestamp"
FEEDBACK = "event_id long, user_id string, cube_id string, query string, prediction string, correction string, label string, created_at timestamp"
CUBES = "cube_id string, name string, owner string, settings map<string,string>, is_active boolean, created_at timestamp, updated_at timestamp"
CONFIGS = "user_id string, config string"
TASKS = "item_id string, user_id string, cube_id string, label string, content string, timestamp string, user_name string, task_id string"
