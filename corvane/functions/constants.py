"""Values that results depend on."""

# Retrieval.
RRF_K = 60
CHECK_LIMIT = 10
SEMANTIC_FLOOR = 0.5
DF_FILTER_ROWS = 20
EXCERPT_BYTES = 140
SIM_DUPLICATE, SIM_DUPLICATE_FACET, SIM_RELATED = 0.90, 0.82, 0.72
COVERAGE_DUPLICATE, COVERAGE_RELATED = 0.70, 0.34
MIN_DRAFT_TERMS, MIN_STEM_BYTES = 4, 3
DUPLICATE_GATE_LIMIT = 5
GRAPH_SEEDS, GRAPH_NEIGHBOURS = 3, 5
EDGE_PRIORITY = {"conflicts_with": 0, "supersedes": 1, "duplicates": 2, "see_instead": 3, "refines": 4, "depends_on": 5}

# Audit.
DENSITY_K, FACET_HUB = 5, 8
FACET_BOOST, SOURCE_BOOST = 10.0, 5.0
AUDIT_LIMIT, AUDIT_NEIGHBOURS = 50, 2

# Text.
FACETS_PER_RECORD, FACET_BYTES, FACET_SEGMENT = 32, 3, 2
SEARCH_TERMS, SEARCH_TERM_CHARS, SEARCH_LIMIT = 12, 3, 10
EDIT_DISTANCE = 2
GROWTH_BYTES, GROWTH_PART = 300, 0.5
BRIEF_CAP = 10
OPEN_WORDING_WARN = 0.9
BATCH_LINE_BYTES = 1 << 20
DERIVATION_VERSION = "6"

# Closed enums.
MODALITIES = ["must", "should", "may", "must_not", "should_not"]
NEGATIVE = ["must_not", "should_not"]
STATUSES = ["proposed", "active", "superseded", "deprecated"]
SEARCHABLE = ["active", "proposed"]
EDGE_TYPES = ["conflicts_with", "supersedes", "depends_on", "refines", "duplicates", "moved_to", "not_related"]
DOC_EXTENSIONS = [".md", ".markdown", ".rst", ".adoc", ".asciidoc", ".txt", ".org"]

# Identifier shapes (snake_case, leading colon, dotted path, camelCase, PascalCase). A word edge is
# ASCII here: (?<![A-Za-z0-9_]) and (?![A-Za-z0-9_]) say so in Java, where \b would know other letters.
FACET_PATTERNS = [
    r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    r":[a-z][a-z0-9_]*(?:_[a-z0-9]+)*\b",
    r"\b[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+\b",
    r"\b[a-z]+[A-Z][A-Za-z0-9]*\b",
    r"\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*\b",
]
FACET_TRIM = ".,;:()[]`'\""
FACET_NOISE = ["e.g", "i.e", "etc.etc"]

# The tool's own vocabulary, which names no identifier of a user's; a default, callers may give another.
OWN_VOCABULARY = [
    "must_not", "should_not",
    "conflicts_with", "depends_on", "not_related", "moved_to",
    "full_id", "source_kind", "see_instead", "rejected_at",
    "created_at", "line_range", "source_hash", "source_file",
    "embedding_status", "code_refs", "covered_via", "match_kind",
    "shared_facets", "decided_at",
    "duplicate_ok", "needs_embedding", "min_score", "no_abstract",
    "leave_link", "rewrite_refs", "api_key_env", "batch_size",
    "derivation_version",
]

# Words that do not count for a draft's coverage (stemmed before use).
COVERAGE_STOPWORDS = [
    "the", "and", "for", "are", "not", "but",
    "any", "all", "can", "has", "was", "with",
    "that", "this", "from", "into", "when", "then",
    "than", "they", "them", "their", "which", "while",
    "would", "should", "must", "never", "always",
    "every", "each", "does", "only", "other", "over",
    "same", "such", "because", "before", "after",
    "about", "there", "where", "what", "will",
    "been", "being", "its", "one", "two", "way",
    "how", "rather", "instead", "without", "within",
    "per", "via", "off", "out", "own", "set",
]

# Words that do not count for a search of files.
SEARCH_STOPWORDS = [
    "the", "and", "for", "are", "not", "but",
    "any", "all", "can", "has", "had", "was",
    "were", "with", "that", "this", "from", "into",
    "when", "then", "than", "they", "them", "their",
    "which", "while", "would", "should", "must",
    "never", "always", "every", "each", "does",
    "only", "other", "over", "same", "such",
    "because", "before", "after", "about", "there",
    "where", "what", "will", "been", "being",
    "its", "it's", "one", "two", "way", "how",
    "rather", "instead", "without", "within",
]

#: The word that marks a label in source text; callers may give their own.
MARKER = "decision"
LABEL_ID = r"[a-z0-9]+(?:-[a-z0-9]+)*(?:/[a-z0-9]+(?:-[a-z0-9]+)*)*"
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
