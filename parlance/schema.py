"""Explicit schemas of the persistent relations and of session events."""

from __future__ import annotations

VERSION = 5

MEETINGS = "id string, title string, started_at timestamp, ended_at timestamp, duration_ms long, language string, segment_count long, sample_rate_hz int, channels int"
SEGMENTS = "id string, meeting_id string, start_ms long, end_ms long, text string, speaker_id string, confidence double"
SPEAKERS = "id string, meeting_id string, slot int, label string"
SUMMARIES = "id string, meeting_id string, template string, model string, language string, created_at timestamp, payload string"
NOTES = "id string, meeting_id string, text string, timestamp_ms long, created_at timestamp"
TEMPLATES = "id string, name string, prompt string"
TABLES = {"meetings": MEETINGS, "segments": SEGMENTS, "speakers": SPEAKERS, "summaries": SUMMARIES, "notes": NOTES}

EVENTS = (
    "type string, session_id string, seq long, chunk_index int, offset_ms long, duration_ms long, rms float, language string, rtf float, "
    "speaker_id string, speaker_slot int, segments array<struct<id: string, start_ms: bigint, end_ms: bigint, text: string, speaker_id: string, confidence: float>>, "
    "total_segments long, total_audio_ms long, message string"
)
