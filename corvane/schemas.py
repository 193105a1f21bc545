"""Declared schemas of the record tables; nothing is inferred."""

STATEMENTS = (
    "full_id string, id string, namespace string, kind string, modality string, abstract boolean, body string, status string, "
    "tags array<string>, provenance_type string, source_file string, line_start int, line_end int, source_hash string, created_at timestamp, file_path string"
)
REJECTIONS = "full_id string, namespace string, body string, see_instead string, rejected_at timestamp, file_path string"
EDGES = "from_id string, to_id string, type string, note string, via string, unconfirmed boolean"
VERDICTS = "a string, b string, verdict string, note string, decided_at timestamp, file_path string"
CLEARANCES = "id string, body_hash string, cleared_at timestamp, note string"
EMBEDDINGS = "source_kind string, full_id string, model string, dims int, vector array<float>, source_hash string, computed_at timestamp"
CODE_REFS = "full_id string, file string, line int, kind string"
SCORES = "identity string, a_hash string, b_hash string, score double"
MANIFEST = "file_path string, mtime_ns bigint, size bigint"
COMMITS = "sha string, date string, subject string, message string"
