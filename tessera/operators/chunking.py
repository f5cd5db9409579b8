"""Chunking of files: by syntax where a language is known, recursively by separators else.

Python is cut by its own syntax tree; JavaScript, TypeScript, Java, Go, C++, Rust
and C# by an outline of their declarations (``outline``).  All functions are pure; ``chunk_files`` runs them in Arrow batches.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from . import outline

# Separators by language, tried in order.
SEPARATORS: dict[str | None, list[str]] = {
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""],
    "ts": ["\nenum ", "\ninterface ", "\nnamespace ", "\ntype ", "\nclass ", "\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "markdown": [r"\n#{1,6} ", "```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", "\n\n", "\n", " ", ""],
    None: ["\n\n", "\n", " ", ""],
}


def nonws(text: str) -> int:
    return sum(map(len, text.split()))


def _cut(text: str, pattern: str) -> list[str]:
    """Pieces that begin with the separator."""
    if not pattern:
        return list(text)
    at = [0, *(m.start() for m in re.finditer(pattern, text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:]) if b > a]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, total = [], [], 0
    for p in pieces:
        if held and total + len(p) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held))
    return [s for s in map(str.strip, out) if s]


def recursive_split(text: str, language: str | None = None, size: int = 1000, overlap: int = 200) -> list[str]:
    """Chunks of at most ``size`` characters where a separator allows it, with overlap."""

    def split(text: str, separators: list[str]) -> list[str]:
        chosen, rest = separators[-1], []
        for i, s in enumerate(separators):
            pattern = s if language == "markdown" else re.escape(s)
            if s == "" or re.search(pattern, text):
                chosen, rest = s, separators[i + 1 :]
                break
        out, short = [], []
        for piece in _cut(text, chosen if language == "markdown" or not chosen else re.escape(chosen)):
            if len(piece) < size:
                short.append(piece)
                continue
            out += _merge(short, size, overlap)
            short = []
            out += split(piece, rest) if rest else [piece]
        return out + _merge(short, size, overlap)

    return split(text, SEPARATORS.get(language) or SEPARATORS[None])


# Fixed value: a class of more than so many chunk sizes of bytes is cut into its members.
DECOMPOSE = 2.5


@dataclass
class Element:
    text: str
    kind: str
    name: str
    first: int
    last: int
    extra: dict = field(default_factory=dict)


_KINDS = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.Import: "import", ast.ImportFrom: "import"}


def python_elements(text: str) -> list[Element]:
    """Classes, functions, imports and module-level assignments in source order, nested ones too."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = text.split("\n")
    out: list[Element] = []

    def take(node: ast.AST, kind: str, name: str, first: int | None = None) -> None:
        a, b = first or node.lineno, node.end_lineno
        head = node.col_offset if first is None and not lines[a - 1][: node.col_offset].strip() else 0
        body = "\n".join([lines[a - 1][head:], *lines[a:b]])
        out.append(Element(body, kind, name, a, b))

    def walk(node: ast.AST, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            kind = _KINDS.get(type(child))
            if kind == "import":
                take(child, kind, ast.unparse(child))
            elif kind:
                if child.decorator_list:
                    take(child, "decorated_definition", child.name, child.decorator_list[0].lineno)
                take(child, kind, child.name)
            elif depth == 0 and isinstance(child, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                take(child, "assignment", ast.unparse(child).split("=")[0].strip())
            walk(child, depth + bool(kind and kind != "import"))

    walk(tree, 0)
    return out


_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)


def braced_elements(text: str, language: str) -> list[Element]:
    """Declarations of a brace language in source order, nested ones too."""
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    return [Element(text[a:b], kind, name, bisect_left(breaks, a) + 1, bisect_left(breaks, b) + 1) for kind, name, a, b in outline.declarations(text, language)]


def _units(element: Element, language: str, size: int) -> list[str]:
    """Statements or members of a large element, nothing between them lost."""
    lines = element.text.split("\n")
    starts = {0}
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                import textwrap

                body = ast.parse(textwrap.dedent(element.text)).body
            top = body[0].body if len(body) == 1 and isinstance(body[0], (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) else body
            starts |= {min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in top}
        except SyntaxError:
            starts |= set(range(len(lines)))
    else:
        depth = 0
        for i, line in enumerate(_NOISE.sub(lambda m: re.sub(r"[{}]", " ", m[0]), element.text).split("\n")):
            if i and depth == 1 and line.strip():
                starts.add(i)
            depth += line.count("{") - line.count("}")
    at = [*sorted(starts), len(lines)]
    return [u for a, b in zip(at, at[1:]) if (u := "\n".join(lines[a:b])).strip()]


def split_large(element: Element, language: str, size: int = 1000, overlap: int = 200, least: int = 100, most: int = 2000) -> list[Element]:
    """Pieces of an element above ``most`` non-blank characters, with trailing units carried over."""
    if nonws(element.text) <= most:
        return [element]
    units: list[tuple[str, bool]] = []
    # a class that is not much above a chunk is one unit, a larger one its head and members
    small_class = element.kind == "class" and len(element.text.encode("utf-8", "replace")) <= DECOMPOSE * size
    for u in [element.text] if small_class else _units(element, language, size):
        if nonws(u) <= most:
            units.append((u, False))
        else:  # line by line
            part: list[str] = []
            for line in u.split("\n"):
                if part and nonws("\n".join(part)) + nonws(line) > size:
                    units.append(("\n".join(part), True))
                    part = []
                part.append(line)
            if part:
                units.append(("\n".join(part), True))
    out: list[Element] = []
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        text = "\n".join(u for u, _ in held)
        extra = {"is_chunk": True, "original_element_name": element.name, "chunk_non_ws_chars": nonws(text)}
        if any(d for _, d in held):
            extra["is_decomposed_unit"] = True
        out.append(Element(text, element.kind, f"{element.name}_chunk_{len(out)}", element.first, element.last, extra))

    total = fresh = 0
    for u, decomposed in units:
        n = nonws(u)
        if fresh and total >= least and total + n > size:
            flush()
            carried, kept = 0, []
            for v in reversed(held):
                if carried + nonws(v[0]) > overlap or total + n <= size:
                    break
                carried += nonws(v[0])
                kept.insert(0, v)
            held, total, fresh = kept, carried, 0
        held.append((u, decomposed))
        total += n
        fresh += 1
    if fresh:
        flush()
    return out


_ORDER = {"import": 1, "assignment": 2, "function": 3, "decorated_definition": 3, "class": 4}


def merge_small(elements: list[Element], least: int = 100, size: int = 1000) -> list[Element]:
    """Neighbouring small elements of compatible kinds joined, up to ``size`` non-blank characters."""
    out: list[Element] = []
    group: list[Element] = []

    def flush() -> None:
        if len(group) < 2:
            out.extend(group)
        else:
            kind = Counter(e.kind for e in group).most_common(1)[0][0]
            text = "\n\n".join(e.text for e in group)
            extra = {"is_merged": True, "merged_count": len(group), "merged_elements": json.dumps([e.name for e in group], ensure_ascii=False), "merged_non_ws_chars": nonws(text)}
            out.append(Element(text, kind, f"merged_{kind}", min(e.first for e in group), max(e.last for e in group), extra))
        group.clear()

    for e in sorted(elements, key=lambda e: (_ORDER.get(e.kind, 5), e.first)):
        n = nonws(e.text)
        if n >= least:
            flush()
            out.append(e)
            continue
        alike = group and _ORDER.get(group[-1].kind, 5) == _ORDER.get(e.kind, 5) <= 3
        if group and not (alike and sum(nonws(g.text) for g in group) + n <= size):
            flush()
        group.append(e)
    flush()
    return out


def syntax_chunks(text: str, language: str, size: int = 1000, overlap: int = 200, least: int = 100, most: int = 2000) -> list[Element]:
    """Elements of one file; the whole file, flagged, where there is no parser or it fails."""
    if language not in ("python", *outline.LANGUAGES):
        return [Element(text, "file", "", 1, text.count("\n") + 1, {"unsupported_language": True})]
    try:
        found = python_elements(text) if language == "python" else braced_elements(text, language)
    except (SyntaxError, ValueError, RecursionError):
        return [Element(text, "file", "", 1, text.count("\n") + 1, {"parse_error": True})]
    if not found:
        return [Element(text, "file", "", 1, text.count("\n") + 1, {"no_elements": True})]
    return merge_small([p for e in found for p in split_large(e, language, size, overlap, least, most)], least, size)


SCHEMA = (
    "{keys}, local_idx long, content string, language string, element_type string, element_name string, start_line long, end_line long, is_chunk boolean, original_element_name string, chunk_non_ws_chars long, "
    "is_decomposed_unit boolean, is_merged boolean, merged_count long, merged_elements string, merged_non_ws_chars long, flag string"
)
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")[1:]]


def chunk_files(files: DataFrame, key: str = "file_path", content: str = "content", language: str = "language", route: str | None = None, size: int = 1000, overlap: int = 200, header: bool = True) -> DataFrame:
    """Chunks of every file with text; ``route`` names a column of 'syntax' or 'text' (default 'text')."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text, lang, how in zip(pdf.k, pdf.c, pdf.l, pdf.r):
                if text is None or not text.strip():
                    continue
                if how == "syntax":
                    for i, e in enumerate(syntax_chunks(text, lang)):
                        x = e.extra
                        flag = next((f for f in ("unsupported_language", "parse_error", "no_elements") if f in x), None)
                        rows.append((k, i, e.text, lang, e.kind, e.name, e.first, e.last, x.get("is_chunk"), x.get("original_element_name"), x.get("chunk_non_ws_chars"), x.get("is_decomposed_unit"), x.get("is_merged"), x.get("merged_count"), x.get("merged_elements"), x.get("merged_non_ws_chars"), flag))
                else:
                    # Fixed value: the line that names the file.
                    head = f"文件路径: {k}\n\n" if header else ""
                    for i, t in enumerate(recursive_split(head + text, lang, size, overlap)):
                        rows.append((k, i, t, lang, None, None, i * (size // 50) + 1, *(None,) * 10))
            out = pd.DataFrame(rows, columns=["k", *_COLUMNS], dtype=object)
            yield out.rename(columns={"k": key})

    from pyspark.sql import functions as F

    chosen = files.select(F.col(key).alias("k"), F.col(content).alias("c"), F.col(language).alias("l"), (F.col(route) if route else F.lit("text")).alias("r"))
    return chosen.mapInPandas(run, SCHEMA.format(keys=f"`{key}` {kind}"))
