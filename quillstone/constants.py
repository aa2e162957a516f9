"""Fixed values of the engine's formulas."""

# Ranking.
RRF_K = 60
CANDIDATES = 50
WIDE_CANDIDATES = 200
JACCARD_DUPLICATE = 0.8
RECENCY_BOOST = 0.1
RECENCY_DAYS = 14.0
MAX_EXPANSIONS = 8
MAX_QUERY_TERMS = 12
LEXICAL_ROUTE = (0.35, 0.65)
NATURAL_ROUTE = (0.7, 0.3)
COARSE_ABOVE = 8192
COARSE_FACTOR = 8
COARSE_LEAST = 200
FIELD_WEIGHTS = {"content": 1.0, "symbol": 2.0, "relpath": 2.5}
BM25_K1, BM25_B = 1.2, 0.75
RERANK_TOP, RERANK_WEIGHT = 20, 1.0

# Chunks.
WINDOW, OVERLAP, SNAP = 40, 10, 5
MIN_LINES, MAX_DEF_LINES = 4, 120
GENERATED_MARK, GENERATED_LINES = "@generated", 5
EMBED_BYTES, RERANK_BYTES, SNIPPET_BYTES, EVIDENCE_BYTES = 6000, 3000, 1600, 6000

# Notes.
KINDS = ["lesson", "decision", "convention", "skill", "fact", "episode"]
SOURCES = ["agent", "capture"]
STATUSES = ["live", "stale", "archived"]
SURPRISE_WEIGHT, COST_WEIGHT, EXPLICIT_WEIGHT = 0.25, 0.35, 0.4
SALIENCE_LEAST, EXPLICIT_DEFAULT = 0.05, 0.3
STALE_FACTOR, NOTE_CANDIDATES = 0.5, 40
BRIEF_STALE_MAX, BRIEF_GLOBALS_MAX = 5, 2
NOISE_DECAY, GLOBAL_NOISE_SCOPES = 0.8, 2
HALF_LIFE_DAYS, STALE_DAYS, EPISODE_FLOOR = 29.0, 30, 0.1
UNRANGED_CHUNKS = 3
THRESHOLDS = {"grounded": 0.5, "holds": 0.5, "contradiction": 0.8}

# Work lists and sync batches.
WORK_STATUSES = ["doing", "todo", "done"]
BATCH_FILES, BATCH_BYTES = 16, 2 * 1024 * 1024

# Extension to language.
LANGUAGES = {
    "sh": "bash", "bash": "bash", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "go": "go", "java": "java",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "kt": "kotlin", "kts": "kotlin", "lua": "lua", "php": "php", "py": "python", "pyi": "python",
    "rb": "ruby", "rs": "rust", "scala": "scala", "sc": "scala", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
}
# Globs that a walk skips.
SKIP_GLOBS = ["*.lock", "*.bin", "*.ipynb", "*.pyc", "*.safetensors", "*.sqlite", "*.pt"]
