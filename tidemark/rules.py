"""Rules as data: patterns, word lists, prices and limits. No logic lives here."""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Fixed values. Everything in this block must keep its exact value for results to be right.
# ---------------------------------------------------------------------------------------------

# Price, per million tokens, that savings are measured against.
BASELINE_PRICE_IN = "15.00"
BASELINE_PRICE_OUT = "75.00"

ROLLING_HOURS = 24

# Provider table: name, model, role, price in, price out, tier, declared position, chain position.
PROVIDERS = [
    ("deepseek", "deepseek-chat", "primary_background", "0.14", "0.28", 1, 1, 1),
    ("xai", "grok-4.1-fast", "secondary", "0.20", "0.50", 1, 2, 2),
    ("kimi", "kimi-k2-turbo-preview", "secondary", "0.60", "0.60", 1, 3, None),
    ("openrouter", "meta-llama/llama-3.1-70b-instruct", "bulk_tasks", "0.40", "0.40", 1, 4, 3),
    ("minimax", "MiniMax-Text-01", "bulk_tasks", "0.30", "2.40", 1, 5, 4),
    ("cerebras", "llama-3.3-70b", "compaction", "0.60", "0.60", 1, 6, 5),
    ("ollama", "qwen2.5-coder:7b", "fallback", "0.00", "0.00", 1, 7, 6),
    ("anthropic", "claude-opus-4", None, "15.00", "75.00", 2, 8, None),
    ("openai", "gpt-4o", None, "2.50", "10.00", 2, 9, None),
    ("google", "gemini-2.5-pro", None, "1.25", "10.00", 2, 10, None),
]

# The wider list offered when a provider table is first set up: name, model, role, in, out.
STARTER_PROVIDERS = [
    ("deepseek", "deepseek-chat", "primary_background", "0.14", "0.28"),
    ("xai", "grok-4.1-fast", "secondary", "0.20", "0.50"),
    ("kimi", "kimi-k2-turbo-preview", "secondary", "0.60", "0.60"),
    ("openrouter", "meta-llama/llama-3.3-70b-instruct", "bulk_tasks", "0.40", "0.40"),
    ("zai", "glm-4-flash", "bulk_tasks", "0.10", "0.10"),
    ("cerebras", "llama-3.3-70b", "compaction", "0.60", "0.60"),
    ("minimax", "MiniMax-Text-01", "bulk_tasks", "0.30", "2.40"),
    ("groq", "llama-3.3-70b-versatile", "compaction", "0.59", "0.79"),
    ("together", "meta-llama/Meta-Llama-3.1-70B-Instruct-Turbo", "bulk_tasks", "0.88", "0.88"),
    ("fireworks", "accounts/fireworks/models/llama-v3p3-70b-instruct", "bulk_tasks", "0.90", "0.90"),
    ("perplexity", "sonar", "research", "1.00", "1.00"),
    ("ollama", "qwen2.5-coder:7b", "fallback", "0.00", "0.00"),
]

# The provider that always comes last in a default chain.
FALLBACK_PROVIDER = "ollama"

# Cool-off: this many failures in a row close a provider for this many seconds.
FAILURE_LIMIT = 3
COOL_OFF_SECONDS = 60

# Quality gate: pass mark, penalties, tag patterns and role-marker patterns with their flags
# (i = any case, m = ^ and $ at every line).
PASS_MARK = 0.5
TAG_PENALTY = -0.4
FORMAT_PENALTY = -0.2
INJECTION_PENALTY = -0.5
COHERENCE_PENALTY = -0.3
TRUNCATION_PENALTY = -0.15

TAG_PATTERNS = [
    (r"<minimax[:_][\w_]+>", "i"),
    (r"</?invoke\b[^>]*>", "i"),
    (r"</?function_call\b[^>]*>", "i"),
    (r"</?tool_call\b[^>]*>", "i"),
    (r"</?tool_use\b[^>]*>", "i"),
    (r"</?tool_result\b[^>]*>", "i"),
    (r"</?assistant_response\b[^>]*>", "i"),
    (r"</?system_instruction\b[^>]*>", "i"),
    (r"</?internal_thought\b[^>]*>", "i"),
    (r"</?reasoning\b[^>]*>", "i"),
]

INJECTION_PATTERNS = [
    (r"\[SYSTEM\]", "i"),
    (r"\[INST\]", "i"),
    (r"\[/INST\]", "i"),
    (r"<<SYS>>", "i"),
    (r"<</SYS>>", "i"),
    (r"<\|im_start\|>", "i"),
    (r"<\|im_end\|>", "i"),
    (r"<\|system\|>", "i"),
    (r"<\|user\|>", "i"),
    (r"<\|assistant\|>", "i"),
    (r"Human:\s*$", "m"),
    (r"Assistant:\s*$", "m"),
    (r"^system\s*:", "im"),
]

REPEATED_CHAR_PATTERN = r"(.)\1{20,}"
NON_ASCII_RUN_PATTERN = r"[^\x00-\x7F]{50,}"
TERMINAL_MARKS = ".!?}])\"'\n`"

# Commands that must not appear in a request; all match in any case.
DANGEROUS_PATTERNS = [
    r"\brm\s+-rf\s+/",
    r"\brm\s+-rf\s+~",
    r"\brm\s+-rf\s+\$HOME",
    r"\bdd\s+if=",
    r"\bmkfs\b",
    r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:",
    r"\bcurl\b[^|]*\|\s*(ba)?sh\b",
    r"\bwget\b[^|]*\|\s*(ba)?sh\b",
    r"\bcurl\b[^|]*\|\s*sudo\b",
    r"\bwget\b[^|]*\|\s*sudo\b",
    r"\b>\s*/dev/sda\b",
    r"\bchmod\s+-R\s+777\s+/\s*$",
    r"\bchown\s+-R\b.*\s+/\s*$",
]

# Credentials, replaced in this order: kind, pattern, flags, replacement. A replacement may refer
# to groups as $1; the last entry is the group holding the secret itself (0 = the whole match).
CREDENTIAL_RULES = [
    ("sk", r"\bsk-[a-zA-Z0-9_-]{20,}\b", "", "[REDACTED_API_KEY]", 0),
    ("sk_live", r"\bsk_live_[a-zA-Z0-9_-]{20,}\b", "", "[REDACTED_API_KEY]", 0),
    ("sk_test", r"\bsk_test_[a-zA-Z0-9_-]{20,}\b", "", "[REDACTED_API_KEY]", 0),
    ("key", r"\bkey-[a-zA-Z0-9_-]{20,}\b", "", "[REDACTED_API_KEY]", 0),
    ("pk_live", r"\bpk_live_[a-zA-Z0-9_-]{20,}\b", "", "[REDACTED_API_KEY]", 0),
    ("pk_test", r"\bpk_test_[a-zA-Z0-9_-]{20,}\b", "", "[REDACTED_API_KEY]", 0),
    ("bearer", r"Bearer\s+[a-zA-Z0-9_.\-]{20,}", "", "Bearer [REDACTED_TOKEN]", 0),
    (
        "assignment",
        r"((?:api[_-]?key|token|secret|password|auth)\s*[=:]\s*[\"']?)([a-zA-Z0-9_.\-/+]{32,})([\"']?)",
        "i",
        "$1[REDACTED]$3",
        2,
    ),
    ("aws", r"\bAKIA[A-Z0-9]{16}\b", "", "[REDACTED_AWS_KEY]", 0),
    ("ghp", r"\bghp_[a-zA-Z0-9]{36}\b", "", "[REDACTED_GH_TOKEN]", 0),
    ("gho", r"\bgho_[a-zA-Z0-9]{36}\b", "", "[REDACTED_GH_TOKEN]", 0),
    ("ghu", r"\bghu_[a-zA-Z0-9]{36}\b", "", "[REDACTED_GH_TOKEN]", 0),
    ("ghs", r"\bghs_[a-zA-Z0-9]{36}\b", "", "[REDACTED_GH_TOKEN]", 0),
    ("jwt", r"\beyJ[a-zA-Z0-9_-]{100,}\b", "", "[REDACTED_JWT]", 0),
]

# The end of the assignment rule, which every match of it holds.
ASSIGNMENT_END = r"[=:]\s*[\"']?[a-zA-Z0-9_.\-/+]{32}"

# Shell gate: fixed strings (any case), then two line patterns; the last match is reported.
SHELL_STRINGS = [
    "rm -rf /",
    "rm -rf ~",
    "rm -rf $HOME",
    "rm -rf ${HOME",
    "dd if=",
    "mkfs.",
    ":(){ :|:& };:",
    "> /dev/sd",
    "> /dev/nvme",
    "> /dev/disk",
    "chmod -R 777 /",
    "chown -R",
]
SHELL_LINE_PATTERNS = [
    ("curl | sh", r"curl\s+.*\|\s*(ba)?sh"),
    ("wget | sh", r"wget\s+.*\|\s*(ba)?sh"),
]
SHELL_TOOLS = ["Bash", "bash"]
AUDIT_BYTES = 500

# Placeholder keys: marker words (two or more), whole strings, least length of a real key.
PLACEHOLDER_WORDS = [
    "your", "here", "replace", "changeme", "todo", "fixme", "example", "placeholder", "insert", "paste",
]
PLACEHOLDER_STRINGS = ["your key here", "your key", "key here", "api key", "sk xxx", "test"]
SHORTEST_KEY = 12

# Finish reasons; anything else is end_turn.
FINISH_REASONS = {"stop": "end_turn", "length": "max_tokens", "content_filter": "end_turn"}

# Memory pipeline.
MAX_CONTEXT_CHARS = 100_000
MIN_CONTEXT_CHARS = 100
IMPORTANCE_THRESHOLD = 7
DEFAULT_IMPORTANCE = 5
CATEGORIES = ["fact", "decision", "skill"]
DEFAULT_SUBCATEGORY = {"fact": "reference", "decision": "strategy", "skill": "how_to"}
COMPACTION_TOOLS = "[Cc]ompact|[Ss]ummariz|[Cc]ompress"
SESSION_END_MIN_BYTES = 50
SESSION_END_MIN_CHARS = 50
TOOL_RESULT_MIN_CHARS = 100
TOOL_RESULT_MARK = "\n\n--- tool_result ---\n"
UNKNOWN = "unknown"
UNASSIGNED = "unassigned"

# Full-text ranking (Okapi BM25 as used by SQLite FTS5) and its least inverse document frequency.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_LEAST_IDF = 1e-6

# Combining marks that full-text search drops.
DROPPED_MARKS = (
    "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311"
    "\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
)

# Stemmer: suffix tables of Porter (1980), revised form. Each step lists suffix -> replacement;
# the longest matching suffix decides, then its condition on the rest of the word is tested.
STEM_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEM_STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEM_STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]
STEM_MIN_BYTES = 3
STEM_MAX_BYTES = 64

# ---------------------------------------------------------------------------------------------
# Own values: rule tables that stand in for a language model's judgement. They may be changed.
# ---------------------------------------------------------------------------------------------

# kind, subcategory, importance, pattern
FACT_RULES = [
    ("url", "url", 9, r"https?://[A-Za-z0-9./?=&_%:#~-]+"),
    ("date", "date", 7, r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"),
    ("version", "spec", 8, r"\bv?[0-9]+\.[0-9]+\.[0-9]+\b"),
    ("env_var", "config", 8, r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b"),
    ("setting", "config", 10, r"\b[A-Za-z_][A-Za-z0-9_.]* = [A-Za-z0-9_./:\"'-]+"),
    ("error", "reference", 8, r"\b[A-Za-z]*(?:Error|Exception): [^\n]+"),
    ("number", "number", 6, r"\b[0-9]{3,}\b"),
]

# category, subcategory, importance, cue pattern (any case); the first matching rule decides.
SENTENCE_RULES = [
    ("decision", "rejection", 8, r"\b(rejected|ruled out|instead of)\b"),
    ("decision", "tool_choice", 8, r"\b(chose|decided|picked)\b"),
    ("decision", "tradeoff", 7, r"\b(because|trade-?off)\b"),
    ("skill", "workaround", 8, r"\b(workaround|work around)\b"),
    ("skill", "gotcha", 8, r"\b(gotcha|beware)\b"),
    ("skill", "debug_technique", 8, r"\b(fixed by|solved by|root cause)\b"),
]
