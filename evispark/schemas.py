"""Explicit schemas (name to type): nothing is inferred from data."""

from __future__ import annotations

from . import fixed

PAGES = {"doc_id": "bigint", "page_ordinal": "int", "page_number": "int", "markdown": "string",
         "sections": "array<string>", "has_tables": "boolean", "content_type": "string"}

FLAT_CHUNK = {
    "chunk_id": "string", "text": "string", "page_start": "int", "page_end": "int", "section": "string",
    "section_hierarchy": "string", "content_type": "string", "token_count": "int", "char_count": "int",
    "chunk_index": "int", "prev_chunk_id": "string", "next_chunk_id": "string", "semantic_density": "double",
    "created_at": "string", "source": "string", "has_recommendation": "boolean", "has_table": "boolean",
    "is_urgent": "boolean", "cancer_types": "string", "symptoms": "string", "age_thresholds": "string",
    "timeframes": "string", "urgency": "string", "actions": "string", "risk_factors": "string",
    "investigations": "string",
}

# Values a flat chunk takes where a field is missing (links stay null).
FLAT_DEFAULTS = {
    "chunk_id": "", "text": "", "page_start": 0, "page_end": 0, "section": "", "section_hierarchy": "",
    "content_type": "text", "token_count": 0, "char_count": 0, "chunk_index": 0, "semantic_density": 0.0,
    "created_at": "", "source": fixed.GUIDELINE, "has_recommendation": False, "has_table": False, "is_urgent": False,
    "cancer_types": "", "symptoms": "", "age_thresholds": "", "timeframes": "", "urgency": "", "actions": "",
    "risk_factors": "", "investigations": "",
}

PATIENT_FILE = {"patient_id": "string", "id": "string", "name": "string", "age": "int", "gender": "string",
                "smoking_history": "string", "symptoms": "array<string>", "symptom_duration_days": "int"}

TURNS = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string", "ts": "timestamp"}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())


def struct_ddl(schema: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in schema.items()) + ">"
