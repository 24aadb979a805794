"""Fixed values.

Everything here is a value that existing corpora and catalogs already carry, so it has to
be spelled exactly like this for results to agree: profile tables, word lists, marker
formats, message texts and search patterns. No logic lives in this module.
"""

# --- profile catalog: profile, phase, pass threshold, target pairs -------------------------
PROFILES = [
    ("python_fastapi", 0, 0.90, 3000),
    ("sql_postgres", 0, 0.95, 1500),
    ("python_django", 1, 0.90, 2000),
    ("python_flask", 1, 0.90, 1500),
    ("typescript_express", 1, 0.90, 2500),
    ("sql_mysql", 1, 0.95, 800),
    ("typescript_nextjs", 2, 0.90, 2000),
    ("php_laravel", 2, 0.90, 2500),
    ("php_vanilla", 2, 0.90, 1500),
    ("javascript_vanilla", 2, 0.90, 1500),
    ("html_jinja2", 2, 0.95, 1000),
    ("html_blade", 2, 0.95, 800),
    ("css_tailwind", 2, 0.95, 600),
    ("java_spring", 3, 0.87, 2500),
    ("csharp_dotnet", 3, 0.87, 2000),
    ("go_gin", 3, 0.90, 2000),
    ("ruby_rails", 3, 0.90, 1500),
    ("sql_tsql", 3, 0.95, 1000),
    ("sql_sqlite", 3, 0.95, 600),
    ("swift_ios", 4, 0.87, 2000),
    ("kotlin_android", 4, 0.87, 2000),
    ("dart_flutter", 4, 0.87, 1500),
    ("rust_axum", 5, 0.80, 2500),
    ("cpp_modern", 5, 0.80, 2000),
]
DEFAULT_PHASE, DEFAULT_THRESHOLD, DEFAULT_PAIRS = -1, 0.90, 0
BASE_MODEL = "Qwen/Qwen2.5-Coder-3B-Instruct"

# --- language tiers: tier, languages, retry budget, required pass rate, escalation limit ----
TIERS = [
    ("low", ["sql", "html", "css"], 2, 0.95, 0.05),
    ("medium", ["python", "typescript", "javascript", "php", "go", "ruby"], 3, 0.90, 0.12),
    ("medium-high", ["java", "csharp", "swift", "kotlin", "dart"], 3, 0.87, 0.15),
    ("high", ["rust", "cpp"], 4, 0.80, 0.20),
]

# --- corpus quotas ---------------------------------------------------------------------------
CONSTRUCTS = [
    "QUERY", "PERSIST", "IF/THEN/ELSE", "FAIL", "RETURN",
    "LOOP", "EMIT", "SEQUENCE", "PARALLEL", "TRANSACTION",
    "LOCK", "FALLBACK", "CACHE GET", "CACHE SET",
    "VALIDATE", "PAGINATE", "AGGREGATE", "TRANSFORM",
    "OBSERVABLE", "CONFIDENCE", "TIMEOUT", "PATCH",
]
HIGH_FREQUENCY = ["PARALLEL", "FALLBACK", "TRANSACTION"]
CATEGORY_SHARES = [("A", 0.60), ("B", 0.30), ("C", 0.10)]
CALLS_PER_CATEGORY = {"A": 2, "B": 4, "C": 3}
CONSTRUCT_QUOTA = 50
HIGH_FREQUENCY_QUOTA = 100
VALIDATION_PAIRS = 200
NEW_TARGET_PAIRS = 1500
DELTA_PAIRS = 100
BATCH_SIZE = 3
CHECKPOINT_EVERY = 50
MAX_TOKENS = 2048
SPEC_CHARS = 6000
LOW_CONFIDENCE = 0.8

DOMAINS = [
    "authentication", "payments", "orders", "inventory", "users",
    "notifications", "reporting", "search", "products", "subscriptions",
    "shipping", "reviews", "coupons", "analytics", "sessions",
    "audit logs", "file uploads", "webhooks", "api keys", "permissions",
]
PATCH_IDEAS = [
    "add rate limiting before the main logic",
    "add caching to avoid redundant reads",
    "add an audit log entry on mutation",
    "add input sanitisation for string fields",
    "add a retry with exponential backoff on transient failures",
]
FLAWS = [
    "missing INTL:BEGIN/END sentinels",
    "PRECONDITION not enforced — missing guard clause",
    "MUTATES field not implemented — no actual write operation",
    "OBSERVABLE field ignored — no logging call present",
    "contains a TODO or stub instead of real implementation",
]

# --- block text ------------------------------------------------------------------------------
BLOCK_KEYWORDS = ["FUNCTION ", "PIPELINE ", "PATCH ", "MODULE "]
BLOCK_ENDS = ["END FUNCTION", "END PIPELINE", "END PATCH", "END MODULE"]
NO_HEADER = "missing FUNCTION/PIPELINE/PATCH block header"
NO_INTENT = "missing INTENT field"
NO_END = "missing END marker"
TRUNCATED = "\n\n[spec truncated — key syntax above covers required constructs]"

# --- statement forms of a block body: name, line pattern -------------------------------------
STATEMENTS = [
    ("QUERY", r"=\s*QUERY\s"),
    ("PERSIST INSERT", r"\bPERSIST\s+\w+\s+INSERT\b"),
    ("PERSIST UPDATE", r"\bPERSIST\s+\w+\s+UPDATE\b"),
    ("PERSIST DELETE", r"\bPERSIST\s+\w+\s+DELETE\b"),
    ("AWAIT", r"\bAWAIT\s+CALL\b"),
    ("CALL", r"\bCALL\s+\w"),
    ("IF", r"(?m)^\s*IF\s"),
    ("FAIL", r"\bFAIL\s+\w+\s*\("),
    ("RETURN", r"\bRETURN\s"),
    ("SEQUENCE", r"(?m)^\s*SEQUENCE\b"),
    ("PARALLEL", r"(?m)^\s*PARALLEL\b"),
    ("FALLBACK", r"\bFALLBACK\s*(?:\n|$)"),
    ("LOOP", r"(?m)^\s*LOOP\s"),
    ("EMIT", r"\bEMIT\s+\w+\s*\("),
    ("SUBSCRIBE", r"(?m)^\s*SUBSCRIBE\s"),
    ("CACHE GET", r"\bCACHE\s+GET\s"),
    ("CACHE SET", r"\bCACHE\s+SET\s"),
    ("TRANSACTION", r"(?m)^\s*TRANSACTION\b"),
    ("VALIDATE", r"(?m)^\s*VALIDATE\s"),
    ("PAGINATE", r"=\s*PAGINATE\s"),
    ("AGGREGATE", r"=\s*AGGREGATE\s"),
    ("TRANSFORM", r"=\s*TRANSFORM\s"),
    ("LOCK", r"(?m)^\s*LOCK\s"),
    ("ASSIGN", r"(?m)^\s*\w+\s*=(?!=|\s*(?:QUERY|AWAIT|CALL|PAGINATE|AGGREGATE|TRANSFORM|FALLBACK)\b)"),
]

# --- markers ---------------------------------------------------------------------------------
BEGIN_TAG = "INTL:BEGIN"
END_TAG = "INTL:END"
MARKER_LINE = "(?iu)INTL:(BEGIN|END)"
BEGIN_FORMAT = "═══ INTL:BEGIN [id=%s] %s ═══"
END_FORMAT = "═══ INTL:END   [id=%s] %s ═══"
# profile prefix, comment opener, comment closer; any other profile uses "# "
COMMENT_STYLES = [("sql", "-- ", ""), ("html", "<!-- ", " -->"), ("css", "/* ", " */")]
COMMENT_OPENERS = ["#", "--", "<!--", r"/\*"]
SLASH_LANGUAGES = ["typescript", "javascript", "java", "csharp", "go", "rust", "cpp", "php", "swift", "kotlin", "dart"]

# --- completion gate -------------------------------------------------------------------------
NO_BEGIN_MARKER = "missing INTL:BEGIN sentinel"
NO_END_MARKER = "missing INTL:END sentinel"
STUBS = ["TODO", "FIXME", "pass  #", "raise NotImplementedError", "stub"]
STUB_FOUND = "contains stub/placeholder: '%s'"

# --- rule checks: names ----------------------------------------------------------------------
CHECK_NAMES = [
    "T1-Syntax", "T2-Sentinel", "T3-Preconditions", "T4-Postconditions",
    "T5-SideEffects", "T6-Types", "T7-NoPlaceholders",
]
# --- rule checks: words and patterns ---------------------------------------------------------
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "BEGIN", "COMMIT"]
HTML_TAG = r"<[a-zA-Z][^>]*>"
GUARD_STOP_WORDS = ["IS", "NOT", "NULL", "AND", "OR", "THEN", "IF", "True", "False"]
RESULT_STOP_WORDS = ["IS", "NOT", "NULL", "NOW", "AND", "OR", "True", "False"]
RESULT_WORDS = ["return", "RETURN", "Result", "response"]
WRITE_WORDS = ["INSERT", "UPDATE", "DELETE"]
WRITE_METHODS = ["save", "create", "update", "delete", "add", "put", "post", "execute"]
WRITE_CALLS = ["session.commit", "db.commit"]
LOG_WORDS = ["log", "logger"]
LOG_METHODS = ["info", "debug", "warning"]
LOG_TEXTS = ["logging.", "console.log", "Log.", "@observable", "@log"]
EMIT_WORDS = ["emit", "publish", "dispatch", "send"]
PLACEHOLDERS = [
    ("TODO", "TODO"),
    ("FIXME", "FIXME"),
    ("bare pass", "pass"),
    ("unimplemented!()", r"unimplemented!\(\)"),
    ("NotImplementedError", "NotImplementedError"),
    ("throw not implemented", r'throw new Error\("not implemented"\)'),
    ("placeholder", "placeholder"),
]

# --- message texts of the pair templates -----------------------------------------------------
WRITER_PROMPT = (
    "You are an INTL (Intent Language) architect. Your job is to write syntactically valid, "
    "realistic INTL blocks. Follow the specification precisely. Every block must have INTENT. "
    "Use correct END markers. Write complete, production-realistic logic — not toy examples.\n\n%s"
)
COMPILER_PROMPT = (
    "You are the INTL compiler for %1$s. Convert INTL blocks to idiomatic, production-ready %1$s code. "
    "Rules:\n"
    "- Wrap ALL output in INTL:BEGIN / INTL:END sentinels matching the block ID\n"
    "- PRECONDITION → explicit guard/assertion\n"
    "- POSTCONDITION → assertion before return\n"
    "- MUTATES → actual write operation (insert/update/delete)\n"
    "- OBSERVABLE → structured logging at entry and decision points\n"
    "- No TODO, FIXME, stub, placeholder, or pass statements\n"
    "- Return ONLY the compiled code with sentinels — no explanation"
)
PATCH_PROMPT = (
    "You are the INTL compiler for %1$s in PATCH mode. Given existing compiled code and an INTL PATCH block, "
    "apply the patch with minimal diff. Rules:\n"
    "- Preserve existing code structure — only apply the described change\n"
    "- Wrap output in INTL:BEGIN / INTL:END sentinels\n"
    "- No TODO, stub, or placeholder\n"
    "- Return ONLY the patched code — no explanation"
)
ESCALATION_PROMPT = (
    "You are the INTL escalation compiler for %1$s. Fix the failed compilation output. Rules:\n"
    "- Fix ALL listed failing checks completely\n"
    "- Wrap output in INTL:BEGIN / INTL:END sentinels\n"
    "- No TODO, stub, or placeholder\n"
    "- Return ONLY corrected code — no explanation"
)
CORRECTION_PROMPT = (
    "You are the INTL compiler for %1$s (%2$s). Given an INTL block, produce idiomatic, production-ready %1$s code. "
    "Wrap output in INTL:BEGIN / INTL:END sentinels with the correct block ID."
)
ATTEMPT_HEADING = "\n\n# PREVIOUS ATTEMPT (failed):\n"
CHECK_HEADING = "\n\n# FAILING CHECK: "
CHECKS_HEADING = "\n\n# FAILING CHECKS: "
PACKAGE_FORMAT = (
    "=== ESCALATION PACKAGE ===\n\n"
    "ADAPTER:      %s\nLANGUAGE:     %s\nBLOCK ID:     %s\nRETRY COUNT:  %s\n\n"
    "--- ORIGINAL INTL BLOCK (authoritative specification) ---\n%s\n\n"
    "--- FAILED COMPILED OUTPUT ---\n%s\n\n"
    "--- FAILING VALIDATION CHECKS ---\n%s\n"
    "==========================\n"
)
REQUEST_FORMAT = (
    "The INTL compiler produced code that failed validation.\n\n"
    "## INTL Block\n%s\n\n"
    "## Failed Compiled Output\n```\n%s\n```\n\n"
    "## Failed Checks\n%s\n\n"
    "Please produce a corrected, complete, production-ready implementation.\n"
    "Output ONLY the corrected code. No explanations. No markdown fences."
)

# --- declared types of a data shape → Spark DDL -----------------------------------------------
TYPE_DDL = {
    "String": "string", "Int": "bigint", "Integer": "bigint", "Float": "double", "Bool": "boolean",
    "UUID": "string", "DateTime": "timestamp", "Date": "date", "Duration": "interval day to second",
    "Bytes": "binary", "JSON": "string",
}
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
