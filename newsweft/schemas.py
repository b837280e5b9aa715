"""Spark schemas of the tables the operators exchange."""

VISITED = (
    "url string, title string, source_name string, first_seen timestamp, "
    "passed_relevance boolean, relevance_score int, was_briefed boolean"
)
VECTORS = "url string, embedding array<float>, title string, source string, document string"
NODES = (
    "concept string, first_seen timestamp, last_seen timestamp, encounter_count bigint, "
    "familiarity double, category string, interest_score double, interest_count bigint"
)
EDGES = "a string, b string, relationship_type string, first_seen timestamp"
EDGE_SOURCES = "a string, b string, url string, seq bigint"
ARTICLES = (
    "briefing_date date, article_number int, title string, source_name string, url string, "
    "summary string, novel_insights string, key_concepts array<string>, "
    "related_topics array<string>, relevance_score int, novelty_score double, "
    "graph_novelty double, vector_novelty double, novelty_explanation string, "
    "technical_depth int, is_deepening boolean, body_content string, body_content_type string"
)
FEEDBACK = (
    "briefing_date date, article_number int, title string, `read` boolean, interest int, "
    "quality string, processed_at timestamp"
)
FAILURES = (
    "url string, phase string, title string, source_name string, error_type string, "
    "error_message string, failed_at timestamp, run_id string, retry_count bigint"
)
