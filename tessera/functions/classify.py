"""Rules that classify and route text, as chained expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import phrases
from tessera.functions.text import extension, file_name, strip

# What each intent is told by, in the order in which intents are tried.
WHY = ["why did", "why do", "reason", "decision", "decided", "rationale"]
WHAT = ["what port", "what is", "which", "should i", "convention", "rule", "standard"]
HOW = ["how do", "how did", "how to", "implement", "build", "create", "fix", "error", "bug"]
INTENT_COLLECTION = {"how": "code-patterns", "what": "conventions", "why": "discussions", "unknown": "discussions"}
INTENT_TYPES = {"how": ["implementation", "error_pattern", "refactor", "file_pattern"], "what": ["rule", "guideline", "port", "naming", "structure"], "why": ["decision", "session", "blocker", "preference", "context"], "unknown": []}

# Phrases that trigger retrieval, in the order in which they are tried.
DECISION_PHRASES = [
    "why did we", "why do we", "what was decided", "what did we decide", "remember when", "remember the decision", "remember what", "remember how", "do you remember", "recall when",
    "recall the", "recall how", "last session", "previous session", "earlier we", "before we", "previously", "last time we", "what did we do", "where did we leave off",
]
SESSION_PHRASES = [
    "what have we done", "what did we work on", "project status", "where were we", "what's the status", "continue from", "pick up where", "continue where", "what's left to do",
    "remaining work", "what's next for", "what's next on", "what's next in the", "next steps", "todo", "tasks remaining",
]
PRACTICE_PHRASES = [
    "best practice", "best practices", "coding standard", "coding standards", "convention", "conventions for", "what's the pattern", "what is the pattern", "how should i", "how do i",
    "what's the right way", "what is the right way", "naming convention", "style guide", "research the pattern", "research best practice", "should i use", "what's recommended",
    "what is recommended", "recommended approach", "preferred approach", "preferred way", "look up", "find out about", "what do the docs say", "industry standard", "common pattern",
]
FILLERS = ["for", "in", "to", "the", "a", "an", "about", "on", "with"]
CODE_PATH = "(?i)(?:[a-z_][\\w/\\\\.-]*\\.(?:py|ts|tsx|js|jsx|go|rs|java|cpp|c|h|rb|php|css|html|yaml|yml|json|toml|md|sh|sql)|/(?:src|lib|tests?|scripts?|docker|hooks?)/)"
ERROR_MARKS = ["Error:", "Exception:", "Traceback", "FAILED:", "error:"]
ERROR_WORDS = ["error", "exception", "failed", "failure", "fatal", "traceback", "bug"]

# Significance.
SKIP_PATTERNS = ["(?i)^(ok|okay|yes|no|sure|thanks|thank you|got it|done|yep|nope)\\.?$", "^[\\x{1F300}-\\x{1F9FF}]+$"]
LOW_PATTERN = "(?i)^(sounds good|will do|on it|understood|acknowledged)"
HIGH_PATTERNS = ["(?i)DEC-\\d+", "(?i)BLK-\\d+", "(?i)(decided|chose|selected|opted for)", "(?i)(error|exception|traceback)", "(?i)(MUST|NEVER|ALWAYS|REQUIRED|SHALL NOT)"]
LEAST_LENGTH = 20
SIGNIFICANCE = {"high": (True, True, None), "medium": (True, True, 90), "low": (True, False, 30), "skip": (False, False, None)}

# Rules in the order in which they are tried: type, confidence, patterns.
RULES = [
    ("error_pattern", 0.90, ["(?i)\\b(traceback|exception|stack\\s*trace)\\b", "(?i)\\berror[:\\s]+\\S", "(?i)\\b(TypeError|ValueError|KeyError|AttributeError|RuntimeError|ImportError|SyntaxError|IndexError|NameError|OSError|IOError|FileNotFoundError|PermissionError|ConnectionError|TimeoutError)\\b"]),
    ("port", 0.95, ["(?i)port\\s*[:=]?\\s*\\d{4,5}", "(?i)(runs?|listens?|available)\\s+(on|at)\\s+port\\s+\\d+"]),
    ("rule", 0.90, ["\\b(MUST|NEVER|ALWAYS|REQUIRED|SHALL NOT)\\b", "(?i)^(rule|requirement):\\s*"]),
    ("blocker", 0.85, ["(?i)(blocked|blocking|can'?t proceed|waiting on|stuck)", "(?i)BLK-\\d+"]),
    ("decision", 0.95, ["(?i)DEC-\\d+"]),
]
LEAST_CONFIDENCE = 0.85
COLLECTION_TYPES = {
    "code-patterns": ["implementation", "error_pattern", "refactor", "file_pattern"], "conventions": ["rule", "guideline", "port", "naming", "structure"],
    "discussions": ["decision", "discussion", "session", "blocker", "preference", "user_message", "agent_response"],
}
PROTECTED_TYPES = ["session", "error_pattern"]
TYPE_COLLECTION = {"conventions": ["guideline", "rule", "naming", "port", "structure", "best_practice"], "discussions": ["decision", "session", "blocker", "preference", "context", "session_summary", "chat_memory", "agent_decision", "user_message", "agent_response"]}

# Languages by extension; what the sync variant knows besides.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".rb": "ruby", ".php": "php", ".c": "c",
    ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".html": "html", ".css": "css", ".sql": "sql",
}
SYNC_LANGUAGES = LANGUAGES | {
    ".scala": "scala", ".r": "r", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".xml": "xml", ".scss": "scss", ".rst": "rst", ".dockerfile": "dockerfile", ".tf": "terraform", ".hcl": "hcl",
}
IMPORTANT_MARKS = ["def __init__", "class ", "async def", "try:", "@dataclass", "@decorator", "CREATE TABLE", "migration", "auth", "security"]
IMPORTANT_PATHS, UNIMPORTANT_PATHS = ["auth", "security", "config", "model"], ["test", "example", "tmp"]
AGENTS = ["architect", "analyst", "pm", "dev", "tea", "tech-writer", "ux-designer", "quick-flow-solo-dev", "sm"]
COMPONENTS = {
    "auth": "src/auth/|authentication|AuthService", "database": "src/database/|db/|database|DatabaseService", "api": "src/api/|api/|APIService|endpoint", "memory": "src/memory/|memory/|MemoryService",
    "queue": "src/queue/|queue/|QueueService", "embedding": "src/embedding/|embedding/|EmbeddingService", "search": "src/search/|search/|SearchService", "storage": "src/storage/|storage/|StorageService",
    "docker": "docker/|Docker|container", "tests": "tests?/|test_|Testing", "scripts": "scripts?/", "hooks": "hooks?/|HookService",
}
AGENT_BUDGETS_OTHER = 1000


def any_of(text: Column, words: list[str]) -> Column:
    c = F.lit(False)
    for w in words:
        c |= F.contains(text, F.lit(w))
    return c


def mapped(values: dict, key: Column, other: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)
    return found if other is None else F.coalesce(found, other)


def intent(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(any_of(t, WHY), "why").when(any_of(t, WHAT), "what").when(any_of(t, HOW), "how").otherwise("unknown")


def triggers(text: Column) -> Column:
    """decision, session, practice, why, what, how: the first phrase of each list that a text holds, all lists in one pass."""
    return phrases.first_of_each(text, {"decision": DECISION_PHRASES, "session": SESSION_PHRASES, "practice": PRACTICE_PHRASES, "why": WHY, "what": WHAT, "how": HOW})


def _after(text: Column, phrase: Column) -> Column:
    return strip(F.substr(text, F.instr(F.lower(text), phrase) + F.length(phrase), F.length(text)))


def _question(text: Column) -> Column:
    return strip(F.regexp_replace(text, "\\?+$", ""))


def decision_topic(text: Column) -> Column:
    p = triggers(text)["decision"]
    topic = _question(_after(text, p))
    return F.when(p.isNull(), None).when(topic != "", topic).otherwise(_question(text))


def session_topic(text: Column) -> Column:
    p = triggers(text)["session"]
    topic = _question(_after(text, p))
    return F.when(p.isNull(), None).when(topic != "", topic).otherwise(p)


def practice_topic(text: Column) -> Column:
    """What follows the phrase, less plural endings and filler words, in their order; else the three words before it."""
    p = triggers(text)["practice"]
    at = F.instr(F.lower(text), p)
    topic = strip(F.regexp_replace(F.substr(text, at + F.length(p), F.length(text)), "^[esES]+", ""))
    for word in FILLERS:
        topic = F.regexp_replace(topic, f"(?i)^{word} ", "")
    topic = _question(topic)
    before = F.filter(F.split(F.substr(text, F.lit(1), at - 1), "\\s+"), lambda w: w != "")
    words = F.array_join(F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3)), " ")
    return F.when(p.isNull(), None).when(topic != "", topic).when(words != "", words)


def routes(text: Column) -> Column:
    """Collections to search, with ! after those that all tenants share."""
    t = triggers(text)
    told = F.array_compact(F.array(F.when(t["decision"].isNotNull() | t["session"].isNotNull(), F.lit("discussions")), F.when(practice_topic(text).isNotNull(), F.lit("conventions!"))))
    asked = F.when(t["why"].isNotNull(), "why").when(t["what"].isNotNull(), "what").when(t["how"].isNotNull(), "how").otherwise("unknown")
    by_intent = F.when(asked == "unknown", F.array(F.lit("discussions"), F.lit("code-patterns"), F.lit("conventions!"))).when(asked == "what", F.array(F.lit("conventions!"))).when(asked == "how", F.array(F.lit("code-patterns"))).otherwise(F.array(F.lit("discussions")))
    return F.when(F.size(told) > 0, told).when(F.rlike(text, F.lit(CODE_PATH)), F.array(F.lit("code-patterns"))).otherwise(by_intent)


def error_signature(text: Column) -> Column:
    """An exception with its message; else a traceback's last exception line; else what follows a mark, to the end of its line."""
    kind, message = F.regexp_extract(text, "(?s)\\b(\\w+(?:Error|Exception)):\\s*([^\\n]+)", 1), F.regexp_extract(text, "(?s)\\b(\\w+(?:Error|Exception)):\\s*([^\\n]+)", 2)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.rlike(x, F.lit("^\\w+(?:Error|Exception):")))
    marked = F.coalesce(*(F.when(F.contains(text, F.lit(m)), F.substring(strip(F.substring_index(F.substr(text, F.instr(text, m), F.length(text)), "\n", 1)), 1, 150)) for m in ERROR_MARKS))
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", None)
        .when(kind != "", F.concat(kind, F.lit(": "), F.substring(strip(message), 1, 100)))
        .when(F.contains(text, F.lit("Traceback")), F.coalesce(F.substring(F.try_element_at(lines, F.lit(-1)), 1, 150), F.lit("Traceback detected")))
        .otherwise(marked)
    )


def output_signature(text: Column, most: int = 200) -> Column:
    """The first line with an error word, else the last one that is not blank."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    told = F.filter(lines, lambda x: any_of(F.lower(x), ERROR_WORDS))
    full = F.filter(lines, lambda x: x != "")
    return F.substring(F.coalesce(F.try_element_at(told, F.lit(1)), F.try_element_at(full, F.lit(-1)), F.lit("Error detected in command output")), 1, most)


def significance(text: Column) -> Column:
    s = strip(F.coalesce(text, F.lit("")))
    c = F.when(F.length(s) < LEAST_LENGTH, "skip")
    for p in SKIP_PATTERNS:
        c = c.when(F.rlike(s, F.lit(p)), "skip")
    c = c.when(F.rlike(s, F.lit(LOW_PATTERN)), "low")
    for p in HIGH_PATTERNS:
        c = c.when(F.rlike(text, F.lit(p)), "high")
    return c.otherwise("medium")


def rule(text: Column) -> Column:
    """type and confidence of the first rule that matches; null where none does."""
    c = F.when(F.coalesce(text, F.lit("")) == "", None)
    for kind, confidence, patterns in RULES:
        if confidence >= LEAST_CONFIDENCE:
            hit = F.lit(False)
            for p in patterns:
                hit |= F.rlike(text, F.lit(p))
            c = c.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))
    return c


def classified(text: Column, current: Column, enabled: bool = True) -> Column:
    """type, confidence and provider: significance first, then types that stay, then rules; what is left is for a model."""
    r = rule(text)
    result = lambda kind, confidence, by: F.struct(kind.alias("type"), confidence.cast("double").alias("confidence"), F.lit(by).alias("provider"))
    if not enabled:
        return result(current, F.lit(1.0), "disabled")
    return (
        F.when(significance(text).isin("skip", "low"), result(current, F.lit(1.0), "significance-filter"))
        .when(current.isin(*PROTECTED_TYPES), result(current, F.lit(1.0), "protected-type"))
        .when(r.isNotNull(), result(r["type"], r["confidence"], "rule-based"))
        .otherwise(result(current, F.lit(None), "model"))
    )


def valid_type(kind: Column, collection: Column, original: Column) -> Column:
    """The type if its collection has it, else the one before."""
    ok = F.lit(False)
    for name, kinds in COLLECTION_TYPES.items():
        ok |= (collection == name) & kind.isin(*kinds)
    return F.when(ok, kind).otherwise(original)


def language(path: Column, sync: bool = False) -> Column:
    found = mapped(SYNC_LANGUAGES if sync else LANGUAGES, extension(path), F.lit("unknown"))
    return F.when(F.lower(file_name(path)) == "dockerfile", "dockerfile").otherwise(found) if sync else found


def framework(text: Column, lang: Column) -> Column:
    has = lambda p: F.rlike(text, F.lit(p))
    js = lang.isin("javascript", "typescript")
    c = F.when((lang == "python") & has("(?:from\\s+)?fastapi|import.*FastAPI"), "fastapi").when((lang == "python") & has("(?:from\\s+)?flask|import.*Flask"), "flask").when((lang == "python") & has("from django"), "django").when((lang == "python") & has("import pytest|from pytest"), "pytest")
    for name, module in (("react", "react"), ("nextjs", "next"), ("vue", "vue")):
        c = c.when(js & has(f"from ['\"]{module}['\"]|import.*['\"]{module}['\"]"), name)
    return c.when(js & has("express\\("), "express").otherwise("general")


def importance(text: Column, path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(any_of(text, IMPORTANT_MARKS) | any_of(p, IMPORTANT_PATHS), "high")
        .when((F.length(text) < 50) | (F.size(F.split(text, "\n")) < 3) | any_of(p, UNIMPORTANT_PATHS), "low")
        .otherwise("normal")
    )


def tags(text: Column, lang: Column, frame: Column) -> Column:
    t = F.lower(text)
    return F.array_compact(F.array(
        lang, F.when(frame != "general", frame), F.when(any_of(text, ["async", "await"]), F.lit("async")), F.when(F.contains(t, F.lit("test")) | any_of(text, ["pytest", "describe("]), F.lit("testing")),
        F.when(any_of(t, ["api", "endpoint"]), F.lit("api")), F.when(any_of(t, ["config", "settings"]), F.lit("config")), F.when(any_of(text, ["try:", "catch", "except"]), F.lit("error-handling")),
    ))


def agent(text: Column) -> Column:
    return F.coalesce(*(F.when(F.rlike(text, F.lit(f"(?i)\\b{a}\\s+agent\\b|Agent:\\s*{a}\\b|@{a}\\b|\\[{a}\\]")), F.lit(a)) for a in AGENTS))


def component(text: Column) -> Column:
    return F.coalesce(*(F.when(F.rlike(text, F.lit(f"(?i){p}")), F.lit(c)) for c, p in COMPONENTS.items()))


def story(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ("(?i)Story\\s+(\\d+\\.\\d+)", "(?i)Epic\\s+(\\d+)", "(?i)\\b([A-Z]+-\\d+)\\b")))


# Folders whose next part is a component, and how types of files are called.
COMPONENT_FOLDERS = ["src", "tests", "scripts", "hooks", "memory", "docker", "monitoring", "lib", "pkg", "cmd", "app", "internal", "api", "components", "pages", "controllers", "models", "views", "services", "utils", "helpers"]
FILE_TYPES = {
    "py": "Python", "md": "Markdown", "yaml": "YAML", "yml": "YAML", "json": "JSON", "sh": "Shell script", "js": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript React", "jsx": "JavaScript React", "go": "Go", "rs": "Rust",
    "java": "Java", "cpp": "C++", "c": "C", "h": "C/C++ Header", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "xml": "XML", "toml": "TOML", "ini": "INI", "css": "CSS", "html": "HTML", "sql": "SQL",
}


def read_context(path: Column) -> Column:
    """file_type, component, question of a file that is read; null for files without an extension. The component is the part after
    the first folder that is known to hold components, or that folder where it is the last part."""
    kind = F.nullif(F.regexp_extract(path, "[^/.]\\.([^./]*)$", 1), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(F.transform(parts, lambda p: p.isin(*COMPONENT_FOLDERS)), True).cast("int")
    part = F.when(at > 0, F.coalesce(F.get(parts, at), F.get(parts, at - 1))).otherwise("")
    called = F.coalesce(mapped(FILE_TYPES, kind), F.upper(kind))
    asked = F.concat(F.lit("Best practices for "), called, F.lit(" files"), F.when(part != "", F.concat(F.lit(" in "), part, F.lit(" component"))).otherwise(""))
    return F.when(kind.isNotNull(), F.struct(kind.alias("file_type"), part.alias("component"), asked.alias("question")))


def migrated_type(content: Column, kind: Column) -> Column:
    """The type of an agent's memory in the collections of today, from what it says: decisions and blockers by their numbers, summaries
    of sessions, preferences by their words, else context."""
    says = lambda p: F.rlike(F.coalesce(content, F.lit("")), F.lit(p))
    return (
        F.when(says("(?i)\\bDEC-\\d+\\b"), "decision").when(says("(?i)\\bBLK-\\d+\\b"), "blocker").when(kind == "session_summary", "session")
        .when(says("(?i)\\b(?:prefer|preference|like|dislike)\\b"), "preference").otherwise("context")
    )


def collection_of(kind: Column) -> Column:
    told = [F.when(kind.isin(*kinds), F.lit(name)) for name, kinds in TYPE_COLLECTION.items()]
    return F.coalesce(*told, F.lit("code-patterns"))


def import_run(text: Column) -> Column:
    """Length of the longest run of import lines."""
    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when(F.rlike(line, F.lit("^\\s*(import|from) ")), acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.split(text, "\n"), state, step, lambda acc: acc["best"])


def is_significant_code(text: Column) -> Column:
    """Defines something, imports three lines in a row, or decorates."""
    defines = "(?m)\\bdef\\s+\\w+\\s*\\(|\\bfunction\\s+\\w+\\s*\\(|\\bfunc\\s+\\w+\\s*\\(|\\bfn\\s+\\w+\\s*\\(|^\\s*\\w+\\s*:\\s*function\\s*\\("
    return F.rlike(text, F.lit(defines)) | F.rlike(text, F.lit("\\b(?:class|interface|struct|trait|enum)\\s+\\w+")) | (import_run(text) >= 3) | F.rlike(text, F.lit("(?m)^\\s*@\\w+"))


# What is not stored.
SKIPPED_EXTENSIONS = [".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".lock", ".log", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".tar", ".gz"]
SKIPPED_PATHS = ["node_modules/", "venv/", ".venv/", "env/", ".git/", "__pycache__/", ".pytest_cache/", "dist/", "build/", ".next/", ".nuxt/", "target/", "vendor/", ".terraform/", "coverage/", ".coverage/"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin",
    ".pyc", ".pyo", ".class", ".o", ".obj", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".sqlite", ".db", ".lock",
]


def should_store(path: Column, text: Column) -> Column:
    return ~extension(path).isin(*SKIPPED_EXTENSIONS) & ~any_of(F.replace(path, F.lit("\\"), F.lit("/")), SKIPPED_PATHS) & is_significant_code(text)


def should_sync(path: Column, size: Column, most: int, excluded: list[str]) -> Column:
    """Known language, not binary, not too large, not excluded by suffix (*.x) or folder."""
    c = ~extension(path).isin(*BINARY_EXTENSIONS) & (F.coalesce(size, F.lit(0)) <= most) & (language(path, sync=True) != "unknown")
    for e in excluded:
        c &= ~F.endswith(path, F.lit(e[1:])) if e.startswith("*") else ~F.array_contains(F.split(path, "/"), e)
    return c


def without_low_value_lines(text: Column) -> Column:
    """Less rulers, menu tags and cut-off box drawings."""
    keep = lambda x: ~(F.rlike(x, F.lit("^\\s*─")) | F.rlike(x, F.lit("\\[(?:MH|CH|PS|DA|CR|DS|PM)\\]")) | F.rlike(strip(x), F.lit("[┌┐└┘├┤┬┴┼│─].*\\.\\.\\.$")))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


# Families of build and test commands, and what a command of each holds.
COMMANDS = {
    "npm": ["npm test", "npm run test", "npm run build", "npm ci"], "yarn": ["yarn test", "yarn build", "yarn install"], "pnpm": ["pnpm test", "pnpm build", "pnpm install"],
    "pytest": ["pytest", "python -m pytest", "python3 -m pytest"], "python": ["python setup.py", "python -m unittest"], "pip": ["pip install", "pip3 install"],
    "make": ["make", "make test", "make build", "make install"], "cmake": ["cmake", "ctest"], "gradle": ["gradle test", "gradle build", "./gradlew"], "maven": ["mvn test", "mvn build", "mvn install"],
    "go": ["go test", "go build", "go install", "go mod"], "cargo": ["cargo test", "cargo build", "cargo check"], "docker": ["docker build", "docker-compose up", "docker compose up"],
    "jest": ["jest", "npm run jest"], "mocha": ["mocha", "npm run mocha"], "vitest": ["vitest", "npm run vitest"],
    "eslint": ["eslint", "npm run lint"], "pylint": ["pylint"], "black": ["black"], "mypy": ["mypy"],
}


def command_family(command: Column) -> Column:
    """The first family that a command holds a pattern of; null for other commands."""
    cases = [F.when(F.greatest(*(F.contains(command, F.lit(p)) for p in ps), F.lit(False)), F.lit(k)) for k, ps in COMMANDS.items()]
    return F.coalesce(*cases)


def routing_cases() -> list[tuple[str, str]]:
    """Every trigger phrase and what it is routed to; a phrase of two lists, or that holds one of another, goes to both."""
    talk, practice = [*DECISION_PHRASES, *SESSION_PHRASES], PRACTICE_PHRASES
    out = []
    for p in dict.fromkeys([*talk, *practice]):
        to = ["discussions"] * any(x in p for x in talk) + ["conventions!"] * any(x in p for x in practice)
        out.append((p, ",".join(to)))
    return out
