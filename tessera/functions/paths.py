"""Path rules of the scanner as column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# What kind of file an extension names, and its language.
CODE = {".py": "python", ".js": "js", ".jsx": "js", ".ts": "ts", ".tsx": "ts", ".java": "java", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".go": "go", ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".clj": None, ".sh": None, ".sql": None, ".html": "html", ".css": None, ".vue": "js"}
# Documents, configuration, names without extension, binary files, and what is admitted or left out.
DOCUMENT = {".md": "markdown", ".txt": None, ".rst": "rst", ".tex": "latex", ".adoc": None}
CONFIG = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env", ".xml", ".gitignore", ".gitattributes"]
SPECIAL = {"dockerfile": "config", "makefile": "config", "readme": "document", "license": "document", "changelog": "document"}
BINARY = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib", ".jar", ".class", ".pyc", ".o", ".obj", ".lib", ".a", ".bin", ".dat"]
ALLOWED = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".php", ".rb", ".go", ".rs", ".swift", ".kt", ".scala", ".md", ".txt", ".rst", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".sh", ".sql", ".html", ".css", ".vue"]
EXCLUDED = [".git", "node_modules", "dist", "build", "venv", ".venv", "target"]
# Extensions with a syntax-aware chunker.
PARSED = [".py", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".java", ".cpp", ".cc", ".cxx", ".c++", ".hpp", ".h", ".go", ".rs", ".cs"]
MAX_PARSE_BYTES = 1_048_576


def unify(path: Column) -> Column:
    """Forward slashes, without a leading ``./`` or ``/``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./|/)+", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case with its dot; '' if the name has none or only begins with one."""
    return F.regexp_extract(F.lower(base_name(path)), r"^\.*[^.].*?(\.[^.]*)$", 1)


def pruned(path: Column, excluded: list[str] = EXCLUDED) -> Column:
    """Whether a directory on the way is excluded or hidden."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(folders, lambda x: x.isin(excluded) | F.startswith(x, F.lit(".")))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regex; ``*`` crosses slashes."""
    return r"\A" + fnmatch.translate(pattern).replace(r"\Z", r"\z")


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a line of the ignore file matches the path or the name."""
    found = F.lit(False)
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            found = found | path.rlike(glob_regex(line)) | base_name(path).rlike(glob_regex(line))
    return found


def admitted(path: Column, allowed: list[str] = ALLOWED) -> Column:
    """Not binary, and of an allowed extension or a known plain name."""
    ext, name = extension(path), F.lower(base_name(path))
    return F.when(ext.isin(BINARY), False).when(ext != "", ext.isin(allowed)).otherwise(name.isin(list(SPECIAL)))


def file_type(path: Column) -> Column:
    ext, name = extension(path), F.lower(base_name(path))
    kind = F.when(ext.isin(list(CODE)), "code").when(ext.isin(list(DOCUMENT)), "document").when(ext.isin(CONFIG), "config")
    for prefix, what in SPECIAL.items():
        kind = kind.when(F.startswith(name, F.lit(prefix)), what)
    return kind.otherwise("unknown")


def language(path: Column) -> Column:
    ext = extension(path)
    by = {k: v for k, v in (CODE | DOCUMENT).items() if v}
    return F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[ext]


def syntax_route(path: Column, size: Column) -> Column:
    """'syntax' for code in a parsed language within the size limit, else 'text'."""
    return F.when((file_type(path) == "code") & (size <= MAX_PARSE_BYTES) & extension(path).isin(PARSED), "syntax").otherwise("text")
