"""Path expressions: keys, attributes, ignore rules, containment."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories ignored by default, supported suffixes, and those that aren't code.
IGNORED = [".git", "node_modules", ".next", "dist", "build", "coverage", "target", "bin", "obj", ".venv", "venv", "__pycache__", ".cache", ".idea", ".vscode", "vendor", "tmp", "temp"]
SUPPORTED = [".md", ".mdx", ".txt", ".log", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".properties", ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".sql", ".sh", ".ps1"]
NOT_CODE = [".md", ".mdx", ".txt", ".log", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".properties"]
MARKDOWN = [".md", ".mdx"]
MIME = {".md": "text/markdown", ".txt": "text/plain", ".json": "application/json", ".py": "text/x-python", ".js": "text/javascript", ".c": "text/x-csrc", ".h": "text/x-chdr", ".html": "text/html", ".csv": "text/csv", ".sh": "application/x-sh", ".sql": "application/sql"}
MAX_FILE_BYTES = 10 * 1024 * 1024
BINARY_PROBE = 8192


def glob_regex(pattern: str) -> str:
    """A gitignore-style pattern (no negation) as a regular expression over paths with / between parts.

    `*`, `**`, `?`, classes such as [a-z] and [!0-9], and escapes count.

    A pattern with a slash inside is anchored at the root; one that ends in / matches directories
    and so whatever lies below.
    """
    below = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            negated = inside[:1] in ("!", "^")
            out, i = out + ("[^/" if negated else "(?!/)[") + inside[negated:] + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if below else "(?:/|$)")


def ignore_regex(extra: list[str] | None = None) -> str:
    return "|".join(glob_regex(p) for p in [*[f"{d}/" for d in IGNORED], *(extra or [])])


def ignored(path: Column, extra: list[str] | None = None) -> Column:
    """Whether a file path is ignored; backslashes count as slashes. The last rule that matches decides, and `!` re-includes,
    but not below a folder that is itself ignored."""
    path = F.translate(path, "\\", "/")

    def one(p: Column) -> Column:
        out = p.rlike(ignore_regex())
        for pattern in extra or []:
            out = (out & ~p.rlike(glob_regex(pattern[1:]))) if pattern.startswith("!") else (out | p.rlike(glob_regex(pattern)))
        return out

    if not any(p.startswith("!") for p in extra or []):
        return one(path)  # what matches a folder matches all below
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    return one(path) | F.coalesce(F.exists(above, one), F.lit(False))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./]+(\.[^./]+)$", 1))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def project_key(path: Column, root_name: Column) -> Column:
    return F.when(path.contains("/"), F.split(path, "/")[0]).otherwise(root_name)


def mime_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit("text/plain"))


def _folds() -> list[tuple[str, str]]:
    """Letters whose case folding isn't their lower case: a few hundred, by Python's Unicode tables."""
    return [(c.lower(), c.casefold()) for c in map(chr, range(0x80, 0x1E944)) if c.lower() != c.casefold() and len(c.lower()) == 1 and c.lower().lower() == c.lower()]


def casefolded(path: Column) -> Column:
    """Case folding on the JVM: lower case and, in paths beyond ASCII, the letters that fold further."""
    out = F.lower(path)
    one = {a: b for a, b in _folds() if len(b) == 1}
    further = F.translate(out, "".join(one), "".join(one.values()))
    for a, b in _folds():
        if len(b) > 1:
            further = F.replace(further, F.lit(a), F.lit(b))
    return F.when(path.rlike(r"[^\x00-\x7F]"), further).otherwise(out)


def idempotency_key(root: Column, path: Column, size: Column, mtime_ns: Column) -> Column:
    """SHA-256 of root, case-folded path, size and time, as key_of() gives it."""
    return F.sha2(F.concat_ws("\0", root.cast("string"), casefolded(path), size.cast("string"), mtime_ns.cast("string")), 256)


def key_of(root: str, path: str, size: int, mtime_ns: int) -> str:
    return hashlib.sha256("\0".join((root, path.casefold(), str(size), str(mtime_ns))).encode()).hexdigest()


class UnsafePath(ValueError):
    """A path that leaves its root."""


def contained(path: str, root: str) -> str:
    """The resolved path; raises UnsafePath if it isn't below the resolved root."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    if real != top and not real.startswith(top.rstrip(os.sep) + os.sep):
        raise UnsafePath(f"{path} is outside {root}")
    return real
