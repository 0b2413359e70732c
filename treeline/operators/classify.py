"""What a file is: language, class and the rule that told it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions import paths as P

# Names and patterns of common tools and languages.
LANGUAGES = {
    "python": ".py .pyi", "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .mts .cts", "tsx": ".tsx", "rust": ".rs",
    "go": ".go", "ruby": ".rb", "java": ".java", "kotlin": ".kt", "c": ".c .h", "cpp": ".cc .cpp .hpp", "shell": ".sh .bash",
    "sql": ".sql", "json": ".json", "yaml": ".yaml .yml", "toml": ".toml", "xml": ".xml", "markdown": ".md", "rst": ".rst",
    "text": ".txt", "css": ".css .scss", "html": ".html", "vue": ".vue", "svelte": ".svelte",
}
PARSEABLE = ("python", "javascript", "typescript", "tsx")
CODE = ("python", "javascript", "typescript", "tsx", "rust", "go", "ruby", "java", "kotlin", "c", "cpp", "shell", "vue", "svelte")
SOURCE = (*CODE, "css", "html")
LOCKFILES = (
    "package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json poetry.lock Pipfile.lock uv.lock pdm.lock conda-lock.yml "
    "Cargo.lock go.sum composer.lock Gemfile.lock mix.lock flake.lock"
).split()
STRUCTURAL = (
    "package.json tsconfig.json jsconfig.json pyproject.toml setup.py setup.cfg Pipfile environment.yml Cargo.toml go.mod pom.xml "
    "build.gradle CMakeLists.txt Makefile Justfile Dockerfile docker-compose.yml docker-compose.yaml compose.yml compose.yaml "
    "manifest.yaml manifest.yml alembic.ini tox.ini Procfile README.md ARCHITECTURE.md CONTRIBUTING.md CLAUDE.md main.py app.py "
    "wsgi.py asgi.py __main__.py manage.py conftest.py index.ts index.js cli.ts cli.js main.ts main.js server.ts server.js"
).split()
VENDOR_SEGMENTS = "vendor vendored third_party thirdparty node_modules .venv venv site-packages bower_components external".split()
GENERATED_SEGMENTS = "dist build out __pycache__ .next coverage htmlcov migrations reports generated _generated gen target .egg-info".split()
TEST_SEGMENTS = "test tests spec specs __tests__ testing e2e".split()
GENERATED_NAME = r"\.min\.(js|css)$|\.bundle\.js$|\.map$|_pb2(_grpc)?\.py$|\.pb\.go$|\.g\.dart$|^__init__\.pyc$"
GENERATED_HEADER = r"(?i)@generated|DO NOT EDIT|Code generated by|autogenerated|Auto-generated"
TEST_NAME = r"^test_.*\.(py|rb)$|_test\.(py|go|rb|ts|js)$|\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$|^conftest\.py$"
STRUCTURAL_NAME = r"\.config\.(js|ts|mjs|cjs)$|^requirements.*\.txt$"
MULTIPLIERS = {"structural": 1.4, "source": 1.0, "test": 0.5, "data": 0.3, "generated": 0.0, "vendored": 0.0, "lockfile": 0.0}
HEAD_CHARS = 2048


def language(path: Column) -> Column:
    """Language by extension; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for name, exts in LANGUAGES.items() for e in exts.split() for x in (e, name)])
    return F.try_element_at(table, P.extension(path))


def segments(path: Column) -> Column:
    return F.filter(F.split(P.dirname(path), "/"), lambda s: (s != "") & (s != "."))


def _hit(parts: Column, names: list[str], suffix: str = "") -> Column:
    ok = lambda s: F.lower(s).isin(names) | (s.endswith(suffix) if suffix else F.lit(False))
    return F.try_element_at(F.filter(parts, ok), F.lit(1))


def is_test(path: Column, lang: Column) -> Column:
    """By name, or by a folder's name if the language is one that tests are written in."""
    by_folder = F.coalesce(lang.isin(*CODE), F.lit(False)) & F.exists(segments(path), lambda s: F.lower(s).isin(TEST_SEGMENTS))
    return P.basename(path).rlike(TEST_NAME) | by_folder


def classify(path: Column, head: Column, mark: Column | None = None, binary: Column | None = None, truncated: Column | None = None) -> Column:
    """``struct<class, signals>``: the first rule that holds, and its name.

    ``mark`` is ``vendored`` or ``generated`` where the repository's attributes say so; ``head`` the start of
    the text.  A binary file is data; truncation adds a signal.
    """
    lang, base, parts = language(path), P.basename(path), segments(path)
    vendor, made = _hit(parts, VENDOR_SEGMENTS), _hit(parts, GENERATED_SEGMENTS, ".egg-info")
    rules: list[tuple[Column, str, Column]] = []
    if mark is not None:
        rules += [(F.coalesce(mark == m, F.lit(False)), m, F.lit(f"gitattributes:linguist-{m}")) for m in ("vendored", "generated")]
    ext = P.extension(path)
    rules += [
        (base.isin(LOCKFILES), "lockfile", F.concat(F.lit("lockfile-name:"), base)),
        (vendor.isNotNull(), "vendored", F.concat(F.lit("vendor-path:"), vendor, F.lit("/"))),
        (made.isNotNull(), "generated", F.concat(F.lit("generated-path:"), made, F.lit("/"))),
        (base.rlike(GENERATED_NAME), "generated", F.concat(F.lit("generated-name:"), base)),
        (F.coalesce(F.substring(head, 1, HEAD_CHARS).rlike(GENERATED_HEADER), F.lit(False)), "generated", F.lit("generated-header")),
        (is_test(path, lang), "test", F.lit("test-path-or-name")),
        (base.isin(STRUCTURAL) | base.rlike(STRUCTURAL_NAME) | path.startswith(".github/workflows/"), "structural", F.concat(F.lit("structural-name:"), base)),
        (F.coalesce(lang.isin(*SOURCE), F.lit(False)), "source", F.concat(F.lit("language:"), lang)),
    ]
    if binary is not None:
        rules.insert(0, (binary, "data", F.lit("binary")))
    other = F.when(ext != "", F.concat(F.lit("data-ext:"), ext)).otherwise(F.lit("data-no-ext"))
    kind, signal = F.lit("data"), other
    for rule, name, why in reversed(rules):
        kind, signal = F.when(rule, name).otherwise(kind), F.when(rule, why).otherwise(signal)
    signals = F.array(signal)
    if truncated is not None:
        signals = F.when(truncated, F.concat(signals, F.array(F.lit("truncated")))).otherwise(signals)
    return F.struct(kind.alias("class"), signals.alias("signals"))


def multiplier(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in MULTIPLIERS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0.0))


def parse_target(path: Column, kind: Column, binary: Column) -> Column:
    return ~binary & F.coalesce(language(path).isin(*PARSEABLE), F.lit(False)) & ~kind.isin("vendored", "generated")


def teachable(kind: Column, binary: Column) -> Column:
    """Whether a file gets steps; all others are reproduced as they are."""
    return ~binary & kind.isin("source", "structural", "test")


def attribute_pattern(glob: Column) -> Column:
    """An attributes glob (``*``, ``**``, ``?``, leading ``/``) as a regular expression."""
    out = F.regexp_replace(F.regexp_replace(F.trim(glob), r"^/", ""), r"([.+^${}()|\[\]\\])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0001"))
    out = F.replace(F.replace(F.replace(out, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit(".*"))
    return F.concat(F.when(F.trim(glob).startswith("/"), "^").otherwise("(^|/)"), out, F.lit("$"))


def screened(path: Column, skip: list[str]) -> Column:
    """Whether a path lies in a skipped folder or behind a dot-name, ``.github`` as a folder excepted."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    dot = lambda s, i: s.startswith(".") & ~((s == ".github") & (i < last))
    return F.exists(F.transform(parts, lambda s, i: s.isin(skip) | dot(s, i)), lambda x: x)
