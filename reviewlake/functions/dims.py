"""Static dimensions.

Everything under "FIXED VALUES" must equal the behaviour being reproduced (extension maps,
keyword sets, severity weights, ...); it is stated plainly, in natural order.  Small maps are
turned into literal ``MAP`` columns so a lookup is a codegen'd ``element_at`` with no join and no
exchange; this holds at any data size because the map size is fixed.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------------------------

PLATFORMS = ["github", "gitlab", "bitbucket", "azure", "unknown"]

SEVERITIES = ["critical", "high", "medium", "low", "info"]  # rank 0..4, worst first

# severity synonyms, applied to the lower-cased value
SEVERITY_SYNONYMS = {
    "critical": "critical",
    "high": "high",
    "medium": "medium",
    "low": "low",
    "info": "info",
    "information": "info",
    "minor": "low",
    "major": "high",
}

# security penalty per security-category issue
SECURITY_PENALTY = {"critical": 4, "high": 2, "medium": 1}

# technical debt hours per issue
DEBT_HOURS = {"critical": 2.0, "high": 1.0, "medium": 0.5, "low": 0.15, "info": 0.0}

# issue category -> risk area (anything else: Maintainability)
CATEGORY_AREA = {
    "security": "Security",
    "injection": "Security",
    "broken_auth": "Security",
    "sensitive_data": "Security",
    "xxe": "Security",
    "broken_access": "Security",
    "misconfig": "Security",
    "xss": "Security",
    "deserialization": "Security",
    "vulnerable_deps": "Security",
    "insufficient_logging": "Security",
    "secret_leak": "Security",
    "bugs": "Reliability",
    "bug": "Reliability",
    "performance": "Reliability",
    "reliability": "Reliability",
    "code_quality": "Maintainability",
    "best_practices": "Maintainability",
    "maintainability": "Maintainability",
    "style": "Maintainability",
    "compilation": "Reliability",
    "general": "Maintainability",
    "ai_slop": "Maintainability",
}
AREAS = ["Security", "Reliability", "Maintainability"]

# extension (lower-cased, no dot) -> language; used for diffs and PR file lists
EXTENSION_LANGUAGE = {
    "py": "python", "pyi": "python", "pyx": "python", "pyw": "python",
    "cs": "csharp", "csx": "csharp",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "kotlin", "scala": "scala",
    "go": "go",
    "rs": "rust",
    "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "hxx": "cpp",
    "php": "php", "phtml": "php",
    "rb": "ruby", "rake": "ruby",
    "swift": "swift",
    "dart": "dart",
    "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell",
    "ps1": "powershell", "psm1": "powershell",
    "sql": "sql",
    "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css",
    "yaml": "yaml", "yml": "yaml", "json": "json",
    "xml": "xml",
    "md": "markdown", "markdown": "markdown",
}

# file names (lower-cased) that never vote for a language
CONFIG_FILE_NAMES = [
    "dockerfile", "makefile", "cmakelists.txt", "package.json",
    "requirements.txt", "pom.xml", "build.gradle", "cargo.toml",
    "go.mod", "composer.json", "gemfile", "package-lock.json",
    "yarn.lock", "tsconfig.json", "webpack.config.js", ".gitignore",
    ".dockerignore", ".env", ".env.example",
]

# language code -> display name (fallback: capitalised code)
LANGUAGE_DISPLAY = {
    "python": "Python", "csharp": "C#", "javascript": "JavaScript", "typescript": "TypeScript",
    "java": "Java", "kotlin": "Kotlin", "scala": "Scala", "go": "Go", "rust": "Rust", "c": "C",
    "cpp": "C++", "php": "PHP", "ruby": "Ruby", "swift": "Swift", "dart": "Dart", "shell": "Shell",
    "powershell": "PowerShell", "sql": "SQL", "html": "HTML", "css": "CSS", "yaml": "YAML",
    "json": "JSON", "xml": "XML", "markdown": "Markdown",
}

# project review: extension (lower-cased, with dot) -> language, default "auto"
PROJECT_EXTENSION_LANGUAGE = {
    ".py": "python", ".cs": "csharp", ".java": "java",
    ".js": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".jsx": "javascript", ".go": "go", ".rs": "rust",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp",
    ".h": "c", ".hpp": "cpp", ".dart": "dart", ".vue": "vue",
    ".sh": "shell",
}

# project review: reviewable extensions
REVIEW_EXTENSIONS = [
    ".py", ".cs", ".java", ".js", ".ts", ".tsx", ".jsx",
    ".go", ".rs", ".swift", ".kt", ".scala", ".rb", ".php",
    ".c", ".cpp", ".h", ".hpp", ".dart", ".vue", ".sh",
    ".json", ".xml", ".yaml", ".yml", ".toml", ".ini",
    ".csproj", ".sln", ".props", ".targets", ".config",
    ".css", ".scss", ".less", ".html", ".sql",
]
# command-line project review: narrower default extension set
CLI_EXTENSIONS = [
    ".py", ".cs", ".java", ".js", ".ts", ".tsx", ".jsx",
    ".go", ".rs", ".swift", ".kt", ".scala", ".rb", ".php",
    ".c", ".cpp", ".h", ".hpp", ".dart", ".vue", ".sh",
]

SKIP_DIRS = [
    "node_modules", ".git", "bin", "obj", "dist", "build",
    "__pycache__", ".venv", "venv", ".next", "coverage",
    "packages", ".vs", ".idea", "vendor", "target",
]

# classification (entries that can never match a lower-cased path are left out)
AUTO_GENERATED_DIRS = ["migrations", "generated", "wwwroot", "properties"]
AUTO_GENERATED_SUBSTRINGS = [
    "migrations", "migration",
    "designer.cs", ".designer.cs", ".generated.cs", ".g.cs", ".g.i.cs",
    "assemblyinfo.cs", "globalusings.g.cs",
    "reference.cs", "service.reference",
]
TEST_PARTS = ["test", "tests", "spec", "specs", "__tests__", "__test__"]
TEST_SUFFIXES = ["tests.cs", "test.cs", ".spec.ts", ".test.ts", "_test.py", "_test.go"]
BOILERPLATE_NAMES = [
    "program.cs", "startup.cs", "globalusings.cs",
    "appsettings.json", "appsettings.development.json",
    "launchsettings.json",
]
CONFIG_EXTENSIONS = [".json", ".xml", ".yaml", ".yml", ".toml", ".ini", ".config", ".csproj", ".sln", ".props", ".targets"]

# focus area -> base rule document
FOCUS_RULE_FILES = {
    "compilation": "compilation.md",
    "security": "security.md",
    "performance": "performance.md",
    "dotnet": "dotnet-fundamentals.md",
    "dotnet_fundamentals": "dotnet-fundamentals.md",
    "best_practices": "best-practices.md",
    "code_quality": "best-practices.md",
    "bugs": "compilation.md",
}
RULE_CATEGORIES = ["security", "performance", "fundamentals", "compilation", "best-practices", "linter"]
EVOLUTION_BASE_RULES = ["security.md", "compilation.md", "best-practices.md"]

# OWASP Top 10 (2021): source file, code, title
OWASP_CATEGORIES = [
    ("A01_2021-Broken_Access_Control.md", "A01", "Broken Access Control"),
    ("A02_2021-Cryptographic_Failures.md", "A02", "Cryptographic Failures"),
    ("A03_2021-Injection.md", "A03", "Injection"),
    ("A04_2021-Insecure_Design.md", "A04", "Insecure Design"),
    ("A05_2021-Security_Misconfiguration.md", "A05", "Security Misconfiguration"),
    ("A06_2021-Vulnerable_and_Outdated_Components.md", "A06", "Vulnerable and Outdated Components"),
    ("A07_2021-Identification_and_Authentication_Failures.md", "A07", "Identification and Authentication Failures"),
    ("A08_2021-Software_and_Data_Integrity_Failures.md", "A08", "Software and Data Integrity Failures"),
    ("A09_2021-Security_Logging_and_Monitoring_Failures.md", "A09", "Security Logging and Monitoring Failures"),
    ("A10_2021-Server-Side_Request_Forgery_(SSRF).md", "A10", "Server-Side Request Forgery (SSRF)"),
]

# accepted PR actions per platform
GITHUB_PR_ACTIONS = ["opened", "synchronize", "reopened"]
GITLAB_MR_ACTIONS = ["open", "update", "reopen"]
BITBUCKET_EVENT_KEYS = ["pullrequest:created", "pullrequest:updated", "pullrequest:changes_request_created"]
AZURE_EVENT_TYPES = ["git.pullrequest.created", "git.pullrequest.updated"]

# platform detection headers, in precedence order
PLATFORM_HEADERS = [
    ("x-github-event", "github"),
    ("x-gitlab-event", "gitlab"),
    ("x-event-key", "bitbucket"),
    ("x-vss-activityid", "azure"),
]

# target branches that get the detailed analysis table
DETAILED_BRANCHES = ["master", "main", "preprod", "production"]

# commit status name per platform for the generic states success / failure / pending
PLATFORM_STATUS = {
    "github": {"success": "success", "failure": "failure", "pending": "pending"},
    "gitlab": {"success": "success", "failure": "failed", "pending": "pending"},
    "bitbucket": {"success": "SUCCESSFUL", "failure": "FAILED", "pending": "INPROGRESS"},
}

# default model per provider
PROVIDER_DEFAULT_MODEL = {
    "openai": "gpt-4-turbo-preview",
    "anthropic": "claude-3-5-sonnet-20241022",
    "groq": "llama-3.3-70b-versatile",
    "mock": "mock-1",
}

# offline model response (valid review JSON)
OFFLINE_RESPONSE = (
    '{"summary":"Mock review: wiring OK (provider=mock).","score":8,"issues":[],'
    '"approval_recommended":true,"block_merge":false}'
)

# ---------------------------------------------------------------------------------------------
# literal-map lookups
# ---------------------------------------------------------------------------------------------


def literal_map(d: dict) -> Column:
    """A fixed-size ``MAP`` literal; lookups on it stay inside whole-stage codegen."""
    items = []
    for k, v in d.items():
        items.extend([F.lit(k), F.lit(v)])
    return F.create_map(*items)


def lookup(d: dict, key: Column) -> Column:
    """``d[key]`` or NULL."""
    return F.try_element_at(literal_map(d), key)


def severity_rank(sev: Column) -> Column:
    return F.coalesce(lookup({s: i for i, s in enumerate(SEVERITIES)}, sev), F.lit(5))


def area_of(category: Column) -> Column:
    return F.coalesce(lookup(CATEGORY_AREA, F.lower(category)), F.lit("Maintainability"))
