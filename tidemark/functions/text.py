"""Scalar helpers on text: labels, paths, globs, hashes, ids. Column functions, with driver twins where the CLI needs them."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_LENGTH = 80
#: Fixed value: severities from low to high.
SEVERITIES = ("note", "warning", "error")


def collapse_whitespace(text: Column) -> Column:
    """Runs of ASCII white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def truncate(text: Column, length: int = LABEL_LENGTH) -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def normalize_label(text: Column, length: int = LABEL_LENGTH) -> Column:
    return truncate(collapse_whitespace(text), length)


def fingerprint(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def posix_path(path: Column) -> Column:
    """Forward slashes, no runs of them, none at the end unless the path is the root."""
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.when(F.length(slashes) > 1, F.regexp_replace(slashes, "/$", "")).otherwise(slashes)


def artifact_uri(path: Column) -> Column:
    """Percent-encoded segments, as browsers encode components; nothing gives (unknown)."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    encoded = F.regexp_replace(F.url_encode(plain), r"\+", "%20")
    for code, char in (("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.regexp_replace(encoded, code, char)
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit("(unknown)")).otherwise(encoded)


def finding_id(rule: Column, path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", rule, path, line.cast("string"), column.cast("string"))


def function_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def meets_severity(severity: Column, threshold: str) -> Column:
    """Whether a severity reaches the threshold; `none` is never reached."""
    return F.lit(False) if threshold == "none" else severity_rank(severity) >= SEVERITIES.index(threshold) + 1


def cwe_number(cwe: Column) -> Column:
    return F.regexp_extract(cwe, r"(\d+)", 1)


def cwe_url(cwe: Column) -> Column:
    number = cwe_number(cwe)
    return F.when(number != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")))


# ---- globs -------------------------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """An anchored regular expression that Java and Python read alike: `**/` spans any number of folders, `*` and `?` stay within one."""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern.replace("\\", "/"))
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(t) or re.sub(r"([.^$+{}()\[\]|\\])", r"\\\1", t) for t in tokens) + "$"


def matches_any_glob(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether a path matches a pattern; one without wildcards also stands for all below it."""
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob_regex(p))
        if not re.search(r"[*?]", p):
            found = found | path.startswith(p.rstrip("/") + "/")
    return found


@lru_cache(maxsize=256)
def _matcher(patterns: tuple[str, ...]) -> re.Pattern:
    """All patterns as one expression, made once for the many paths that are held against them."""
    return re.compile("|".join([glob_regex(p) for p in patterns] + [re.escape(p.rstrip("/") + "/") for p in patterns if not re.search(r"[*?]", p)]))


def path_matches(path: str, patterns: list[str] | tuple[str, ...]) -> bool:
    return bool(patterns) and _matcher(tuple(patterns)).match(path) is not None


def label_of(text: str, length: int = LABEL_LENGTH) -> str:
    flat = text if text.isidentifier() else re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
    return flat if len(flat) <= length else flat[:length] + "…"


def digest_of(text: str, digits: int = 16) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:digits]
