"""Text: secrets, snippets, tokens, headings, sentences and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What takes a secret's place, what stands for a missing snippet, the longest snippet.
MASK = "***MASKED***"
NO_SNIPPET = "[No snippet available]"
SNIPPET_CHARS = 1000
CHARS_PER_TOKEN = 4

#: In order; each is (pattern, replacement).
SECRETS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", MASK),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", f"Bearer {MASK}"),
    (r"\bsk-[A-Za-z0-9_-]{8,}", MASK),
    (r"(?i)\b(password|pwd|uid|user id)\s*=\s*[^;\"'\s]+", f"$1={MASK}"),
    (r"(?i)\b(api[_-]?key|token|secret|client[_-]?secret)\b(\s*[:=]\s*)([\"'])[^\"']+[\"']", f"$1$2$3{MASK}$3"),
)
#: File endings that count as references, and words in back quotes that don't.
REFERENCE_ENDINGS = "csproj cs ts json js xml sln sql md yml yaml".split()
PLAIN_WORDS = (
    "true false null string int bool void async await task var let const class interface record struct enum public private protected internal static readonly override virtual "
    "get set init return new this base if else foreach while try catch finally throw using namespace import export from default select where post put delete patch api"
).split()
REFUSALS = ("insufficient evidence", "no relevant evidence", "no evidence found", "cannot find any evidence")


def mask_secrets(text: Column) -> Column:
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def has_secret(text: Column) -> Column:
    found = F.lit(False)
    for pattern, _ in SECRETS:
        found = found | text.rlike(pattern)
    return found


def snippet(text: Column) -> Column:
    masked = mask_secrets(F.trim(text))
    cut = F.when(F.length(masked) > SNIPPET_CHARS, F.concat(F.left(masked, F.lit(SNIPPET_CHARS - 3)), F.lit("..."))).otherwise(masked)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(NO_SNIPPET)).otherwise(cut)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("int")


def lines(text: Column) -> Column:
    """Split at CR LF, CR or LF; a trailing empty line stays."""
    return F.split(text, r"\r\n|\r|\n", -1)


def is_heading(line: Column) -> Column:
    return line.rlike(r"^\s*#{1,6}\s")


def is_documentation(path: Column) -> Column:
    return path.rlike(r"(?i)(\.(md|markdown|txt|rst|adoc)$|(^|/)docs/|readme$)")


def slug(name: Column) -> Column:
    out = F.lower(F.trim(name))
    for gone in ("project:", "repo:", "class:", "interface:"):
        out = F.replace(out, F.lit(gone), F.lit(""))
    return F.translate(out, "./\\", "---")


def sentences(text: Column) -> Column:
    """Per line, after . ! or ? where white space and then a capital, digit or quote follow."""
    cut = F.flatten(F.transform(lines(text), lambda line: F.split(line, r"(?<=[.!?])\s+(?=[A-Z0-9`\"'])")))
    return F.filter(F.transform(cut, F.trim), lambda s: s != "")


def file_references(text: Column) -> Column:
    # A longer ending is tried before one that begins it, so .json isn't read as .js.
    endings = "|".join(REFERENCE_ENDINGS)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)([a-z0-9_./\\-]+\.(?:{endings}))\b"), 1))


def identifiers(text: Column) -> Column:
    """Names in back quotes of three letters or more that aren't plain words."""
    found = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][A-Za-z0-9_]{2,})`"), 1)
    plain = F.array(*map(F.lit, PLAIN_WORDS))
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(plain, F.lower(w))))


def is_refusal(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(REFUSALS)), F.lit(False))


def file_matches(a: Column, b: Column) -> Column:
    """Equal, one ends the other, or the same file name; ignoring case."""
    from .paths import file_name, normal

    x, y = F.lower(normal(a)), F.lower(normal(b))
    return (x == y) | x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x)) | (file_name(x) == file_name(y))
