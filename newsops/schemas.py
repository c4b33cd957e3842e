"""Explicit schemas of the data model as DDL text; nothing is inferred from data."""

from __future__ import annotations

FEED_ARTICLE = (
    "title string, url string, excerpt string, published_at string, source_id string, "
    "source_name string, full_text string"
)
TOPIC = (
    "topic_id string, topic_ord int, name string, keywords array<string>, "
    "exclusion_keywords array<string>, threshold int, article_limit int, "
    "source_ids array<string>, enabled boolean, archived boolean"
)
SOURCE = (
    "source_id string, name string, url string, homepage string, category string, "
    "language string, terms string, preset_id string, preset_version int, "
    "user_modified boolean, enabled boolean, archived boolean, last_status string, "
    "last_checked_at string, last_error string"
)
SCORE = (
    "score int, summary string, analysis string, relevant boolean, reason string"
)
RUN = (
    "run_id string, status string, phase string, outcome string, trigger string, "
    "topic_ids array<string>, started_at timestamp, finished_at timestamp, ordinal bigint, "
    "article_count int, source_success int, source_failure int, analyses int, "
    "duplicates_skipped int, funnel map<string,bigint>, ai_requests int, ai_success int, "
    "ai_failure int, warning string, error string"
)
STORED_ARTICLE = (
    "id string, run_id string, topic_id string, source_id string, title string, url string, "
    "excerpt string, full_text string, summary string, analysis string, score int, "
    "published_at string, created_at timestamp, favorite boolean, content_hash string, "
    "analysis_mode string, model string, matched_keywords array<string>, "
    "matched_fields array<string>"
)

SCORE_FIELDS = ("score", "summary", "analysis", "relevant", "reason")

# Enumerations of the data model.
RUN_STATUSES = ("queued", "running", "complete", "degraded", "failed", "cancelled")
REASONS = (
    "direct_match", "contextual_match", "background_context", "off_topic",
    "exclusion_match", "insufficient_evidence",
)
