"""Rules as data: the fixed names, endings and words that files, languages and stacks are told by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import paths

#: Directories that are never read, by scanner.
IGNORED_ANALYSIS = ".git .vs .vscode .idea bin obj node_modules dist build coverage out target .next .nuxt .output tmp temp artifacts secrets .secrets".split()
IGNORED_INGEST = ".git .svn .hg .vs .vscode .idea bin obj node_modules dist build out coverage packages __pycache__ .pytest_cache .next .nuxt target vendor .terraform".split()
IGNORED_CLASSIFIER = "node_modules bin obj dist build packages vendor __pycache__".split()
#: Endings the ingest scan leaves out (programs, archives, media, documents, compiled and minified files).
IGNORED_ENDINGS = (
    "exe dll so dylib pdb class jar war wasm zip tar gz tgz bz2 7z rar png jpg jpeg gif ico svg bmp webp mp3 mp4 wav avi mov mkv "
    "pdf doc docx xls xlsx ppt pptx min.js min.css map pyc pyo"
).split()
GENERATED_ENDINGS = ".g.cs .g.i.cs .assemblyinfo.cs .assemblyattributes.cs .designer.cs".split()
#: Category by ending, in order; the first that has it wins.
CATEGORIES = {
    "CSharp": "cs", "Razor": "cshtml razor", "WebAsset": "css scss sass less", "TypeScript": "ts tsx", "JavaScript": "js jsx mjs cjs", "Java": "java kt kts",
    "Python": "py", "Go": "go", "PHP": "php", "Rust": "rs", "Documentation": "md markdown txt rst adoc",
}
#: Language by ending.
LANGUAGES = {
    "C#": "cs", "TypeScript": "ts tsx mts cts", "JavaScript": "js jsx mjs cjs", "JSON": "json", "XML": "xml csproj props targets", "YAML": "yaml yml", "TOML": "toml",
    "HTML": "html htm", "CSS": "css", "SCSS": "scss", "Less": "less", "SQL": "sql", "Markdown": "md", "Text": "txt", "Shell": "sh bash", "PowerShell": "ps1", "Python": "py",
    "Go": "go", "Java": "java", "Rust": "rs", "C++": "cpp", "C": "c",
}
CONFIGURATION = "package.json tsconfig.json next.config.js vite.config.ts".split()
#: Manifests and the type of project each one makes.
MANIFESTS = {
    "package.json": "Node", "pom.xml": "Java", "build.gradle": "Java", "build.gradle.kts": "Java", "requirements.txt": "Python", "pyproject.toml": "Python", "setup.py": "Python",
    "pipfile": "Python", "go.mod": "Go", "composer.json": "PHP", "cargo.toml": "Rust",
}
PROJECT_LANGUAGE = {"CSharp": "csharp", "Node": "typescript", "Java": "java", "Python": "python", "Go": "go", "PHP": "php", "Rust": "rust"}
#: Limits of a scan.
MOST_FILES, MOST_FILE_BYTES, MOST_BYTES, MOST_EDGES, MOST_INGEST_BYTES = 10_000, 5 << 20, 500 << 20, 50_000, 20 << 20
#: Path words of a stack's tiers, each with how many nodes it shows.
TIERS = {
    "spring": (("controller resource", 6), ("service manager", 6), ("repository dao", 4)),
    "python": (("view router api endpoint", 6), ("service crud manager", 5), ("model schema entity", 4)),
    "go": (("handler controller api", 6), ("service usecase domain", 5), ("repository storage db", 4)),
    "php": (("controller", 6), ("service action", 4), ("models model", 4)),
    "universal": (("controller handler route api view", 6), ("service usecase manager core domain logic", 5), ("repo storage db model entity", 4)),
}
GATEWAYS = {"spring": ("client", "dispatcher"), "python": ("browser", "application"), "go": ("client", "router"), "php": ("browser", "router"), "universal": ("entry", "gateway")}


def when_chain(rules: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(otherwise)
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    return out


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def in_ignored_directory(path: Column, names: list[str], dotted: bool = True) -> Column:
    """A directory of the path is ignored, or (dotted) begins with '.' and isn't .config."""
    folders = F.slice(paths.segments(path), 1, F.size(paths.segments(path)) - 1)

    def bad(name: Column) -> Column:
        hidden = name.startswith(".") & (name != ".config") & (name != ".")
        return F.lower(name).isin(names) | hidden if dotted else F.lower(name).isin(names)

    return F.exists(folders, bad)


def is_secret_file(path: Column) -> Column:
    return F.lower(paths.file_name(path)).rlike(r"^(\.env(\..*)?|.*\.secrets\.json|.*\.secret\..*)$")


def is_generated(path: Column) -> Column:
    name = F.lower(paths.file_name(path))
    return any_of([name.endswith(e) for e in GENERATED_ENDINGS])


def has_ignored_ending(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(e.replace(".", r"\.") for e in IGNORED_ENDINGS) + ")$")


def is_configuration(path: Column) -> Column:
    name = F.lower(paths.file_name(path))
    return name.isin(CONFIGURATION) | name.rlike(r"^(appsettings|tsconfig).*\.json$")


def category(path: Column) -> Column:
    """Category of a source file; null for files that are none."""
    ending = paths.extension(path)
    return when_chain([*((ending.isin(e.split()), name) for name, e in CATEGORIES.items()), (is_configuration(path), "Configuration")])


def language(path: Column) -> Column:
    ending, name = paths.extension(path), F.lower(paths.file_name(path))
    return when_chain([(name == "dockerfile", "Dockerfile"), *((ending.isin(e.split()), n) for n, e in LANGUAGES.items())], "Unknown")


def project_type(path: Column) -> Column:
    """Type of the project a manifest makes; null for other files."""
    name = F.lower(paths.file_name(path))
    return when_chain([(name.endswith(".csproj"), "CSharp"), *((name == m, kind) for m, kind in MANIFESTS.items())])


def tier(path: Column, stack: str) -> Column:
    """0, 1 or 2: the first tier whose word is in the path; null for none."""
    p = F.lower(path)
    return when_chain([(any_of([p.contains(w) for w in words.split()]), n) for n, (words, _) in enumerate(TIERS[stack])])
