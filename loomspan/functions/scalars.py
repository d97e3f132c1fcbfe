"""Column functions: paths, names, scopes, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names that are never scanned.
EXCLUDED = (
    "node_modules venv .venv env __pycache__ dist build .next coverage .git vendor .cache .npm .yarn bower_components jspm_packages .tox .nox .pytest_cache .mypy_cache eggs .eggs site-packages"
).split()
# Endpoint patterns that clients don't call (webhooks, admin, internal, sign-in callbacks, documentation).
IGNORED_ENDPOINTS = (
    "/webhook",
    "/stripe/webhook",
    "/paypal/webhook",
    "/github/webhook",
    "/slack/webhook",
    "/admin",
    "/api/admin",
    "/management",
    "/api/management",
    "/debug",
    "/internal",
    "/api/internal",
    "/health",
    "/ping",
    "/metrics",
    "/ready",
    "/alive",
    "/auth/callback",
    "/oauth",
    "/callback",
    "/docs",
    "/swagger",
    "/openapi",
    "/redoc",
)
# Verbs that stand for a method in a function's name, in the order in which they are tried.
VERBS = {
    "GET": "get|fetch|load|retrieve|read|list|find|search",
    "POST": "create|add|post|submit|save|insert|register|login|logout",
    "PUT": "update|edit|modify|change|replace",
    "PATCH": "patch|partial|tweak",
    "DELETE": "delete|remove|destroy|clear|drop",
}
# File names that start a program, and names of configuration files.
ENTRY_NAMES = "index|main|app|server|cli|tool|handler|mcp|worker"
CONFIG_NAMES = r"^\..*rc$|config\.|settings\.|\.env|package\.json|tsconfig"


def is_excluded(path: Column, names: list[str] = EXCLUDED) -> Column:
    """Whether any segment of a path is an excluded directory; backslashes count as slashes."""
    return F.arrays_overlap(F.split(F.translate(path, "\\", "/"), "/"), F.array(*map(F.lit, names)))


def glob_to_regex(glob: str) -> str:
    """A regular expression for the whole of a path: ``**`` any, ``*`` within a segment, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".\+^$()[]{}|" else c), i + 1
    return f"^{out}$"


def is_ignored(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_to_regex, globs))) if globs else F.lit(False)


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def parent_directory(path: Column) -> Column:
    """The path up to before its last slash; empty without one."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "^(.*)/", 1)


def extension(path: Column) -> Column:
    """The last suffix of the file name, lower case, with its dot; empty without one or for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"\.test\.|\.spec\.|__tests__|/tests?/")


def is_config(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(CONFIG_NAMES)


def is_entry_point(path: Column, frameworks: tuple[str, ...] = ()) -> Column:
    """Whether a file starts a program, or is a page or service of one of the ``frameworks`` (nextjs, fastapi) that a project uses."""
    low, name = F.lower(path), file_name(path)
    found = F.lower(name).rlike(f"^({ENTRY_NAMES})") | low.rlike("^src/[^/]+$") | low.contains("/bin/")
    if "nextjs" in frameworks:
        found = found | (path.contains("/app/") & name.isin("page.tsx", "page.ts", "layout.tsx")) | (path.contains("/pages/") & ~name.startswith("_"))
    if "fastapi" in frameworks:
        found = found | name.isin("main.py", "app.py") | (path.contains("/api/") & name.endswith(".py"))
    return found


def map_kind(kind: Column, function: tuple = ("function",), class_: tuple = ("class", "interface", "type", "enum"), method: tuple = ("method",)) -> Column:
    """The nine kinds of symbols as function, class, method or variable."""
    return F.when(kind.isin(*function), "function").when(kind.isin(*class_), "class").when(kind.isin(*method), "method").otherwise("variable")


def file_scope(path: Column, shared: list[str], frontend: list[str], backend: list[str]) -> Column:
    """shared, frontend, backend or unknown: by contained words, shared first, frontend only without a backend word."""
    low = F.lower(path)
    has = lambda words: F.lit(False) if not words else low.rlike("|".join(_escaped(w) for w in words))
    suffix = F.when(path.rlike(r"\.[tj]sx$"), "frontend").when(path.endswith(".py") & ~path.contains("test") & low.rlike(r"main\.py|app\.py"), "backend").otherwise("unknown")
    return F.when(has(shared), "shared").when(has(frontend) & ~has(backend), "frontend").when(has(backend), "backend").otherwise(suffix)


def _escaped(word: str) -> str:
    return "".join("\\" + c if c in r".\+*?^$()[]{}|" else c for c in word)


def ignored_endpoints_pattern() -> str:
    return "(?i)" + "|".join(IGNORED_ENDPOINTS)


def ignored_endpoint(path: Column) -> Column:
    return path.rlike(ignored_endpoints_pattern())


def naming_convention(name: Column) -> Column:
    return (
        F.when(name.contains("_"), "snake_case")
        .when(name.rlike("^[a-z]+([A-Z][a-z]+)*$"), "camelCase")
        .when(name.rlike("^[A-Z][a-z]+([A-Z][a-z]+)*$"), "PascalCase")
        .when(name.contains("-"), "kebab-case")
        .otherwise("unknown")
    )


def normalize_name(name: Column, hyphens: bool = False) -> Column:
    """Lower case without underscores (and hyphens)."""
    return F.lower(F.regexp_replace(name, "[_-]" if hyphens else "_", ""))


def normalize_path(path: Column) -> Column:
    """Repeated slashes made one, no slash at either end."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def strip_api_prefix(path: Column) -> Column:
    """A normalised path without one leading ``api/``, then version, then ``rest/``."""
    out = normalize_path(path)
    for lead in ("^api/", "^v[0-9]+/", "^rest/"):
        out = F.regexp_replace(out, lead, "")
    return out


def generic_params(path: Column) -> Column:
    """Every parameter, in any of four syntaxes, as ``{param}``."""
    return F.regexp_replace(path, r"\$\{[^}]+\}|\{[^}]+\}|<[^>]+>|:[A-Za-z_][A-Za-z0-9_]*", "{param}")


def package_name(module: Column, python: bool = False) -> Column:
    if python:
        return F.substring_index(module, ".", 1)
    return F.when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def path_params(path: Column) -> Column:
    """Distinct parameter names of a path: ``{x}``, ``:x`` and ``${x}``, the last as the snake case of its last part."""
    braces = F.regexp_extract_all(path, F.lit(r"(?<!\$)\{([^}]+)\}"), F.lit(1))
    colons = F.regexp_extract_all(path, F.lit(r":([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    dollars = F.transform(F.regexp_extract_all(path, F.lit(r"\$\{([^}]+)\}"), F.lit(1)), lambda x: camel_to_snake(F.substring_index(x, ".", -1)))
    return F.array_distinct(F.concat(braces, colons, dollars))


def infer_method(name: Column) -> Column:
    """The HTTP method that a function's name stands for; null if none."""
    out = None
    for method, verbs in VERBS.items():
        out = F.when(name.rlike(verbs), method) if out is None else out.when(name.rlike(verbs), method)
    return out


def name_parts(name: Column) -> Column:
    """The lower-case parts of a camel or snake name."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[_ -]+"), lambda x: x != "")


def shares_part(a: Column, b: Column) -> Column:
    """Whether two names have parts that are equal or of which one holds the other."""
    return F.exists(name_parts(a), lambda x: F.exists(name_parts(b), lambda y: x.contains(y) | y.contains(x)))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two texts share."""
    n = F.least(F.char_length(a), F.char_length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.try_element_at(first, F.lit(1)) - 1, n)


def segment_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else the larger of prefix coverage and normalised edit distance."""
    x, y = F.lower(a), F.lower(b)
    most, least = F.greatest(F.char_length(a), F.char_length(b)), F.least(F.char_length(a), F.char_length(b))
    prefix = common_prefix(x, y)
    other = F.greatest(prefix / least * 0.7 + prefix / most * 0.3, 1 - F.levenshtein(x, y) / most)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(other)


def jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct elements of two arrays; 0 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


def line_of(text: Column, number: Column) -> Column:
    """The line with a number, from 1; empty where there is none."""
    return F.coalesce(F.try_element_at(F.split(text, "\n"), number), F.lit(""))


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400_000_000)


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
