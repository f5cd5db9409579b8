"""Generated, minified, vendored or data-only source files.

One multi-pattern automaton finds the wording of generation notices, foreign
licences and compiler marks in a file; a hit counts where such notices stand: in
the comments at the file's head or foot.  Path rules add vendored directories,
lockfiles and minified suffixes, and the directories excluded by the settings.
What carries no notice shows in its shape: minified and obfuscated code has
hardly any white space, embedded data hardly any words, and members numbered in
series are the work of a program.

Edge cases: rows with null content or another file type are judged by nothing
and have no row; a null path has no directories; empty files are hand-written;
paths may use backslashes or begin with ``./`` or ``/``; directory names are
compared as spelled; repeated rows give one result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording of notices, lower case; white space and comment marks between words are one blank.
GENERATED = [
    "code generated by", "@generated", "do not edit", "do not modify", "don't edit", "autogenerated file", "auto-generated", "autogenerated by", "automatically generated", "automatically produced",
    "automatically created by", "this file is generated", "this file was generated", "generated on build", "generated by the protocol buffer compiler", "generated from", "machine-made", "machine generated", "changes will be lost", "changes will be overwritten",
    "automatisch erzeugt", "automatisch von", "automatisch generiert", "nicht bearbeiten", "produit automatiquement", "généré automatiquement", "generado automáticamente", "no editar", "ne pas modifier", "自动生成", "请勿修改", "sourcemappingurl=",
]
FOREIGN = ["imported from", "vendored from", "copied from", "upstream revision", "local changes:", "origin:", "see license of the", "library. see license", "contributors. released under", "its authors. all rights reserved", "part of the"]
STRONG_FOREIGN = re.compile(
    r"imported from \S+ v?\d|vendored from|upstream (?:revision|commit|version)|origin: \S+ (?:release|version|v?\d)|see licen[sc]e of the \S+ project|copyright \(c\) [\d, -]+ (?:the )?\S+ contributors|part of the \S+ (?:toolkit|library|project|framework),? \(c\)|^/\*! ?\S+(?:\.js)? v?\d"
)
VENDORED = {"node_modules", "bower_components", "site-packages", "vendor", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "bundled", "Godeps", "Pods", "jspm_packages"}
LOCKFILES = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock", "uv.lock"}
MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|packed)\.(?:js|mjs|cjs|css)$", re.I)
COMPILED = re.compile(r'^(?:﻿)?(?:"use strict";\s*)?(?:Object\.defineProperty\(exports, ?"__esModule"|var __(?:extends|assign|awaiter|importDefault|createBinding) ?=|\(\(\) ?=> ?\{ ?(?:// webpackBootstrap)?\s*(?:var|"use strict"))')
#: Names that end in a number with leading zeros; so many of them that run on without much of a gap are a program's series.
NUMBERED, SERIES = re.compile(r"\b\w*[A-Za-z]_?(0\d+)_?\b"), 4
OBFUSCATED = re.compile(r"_0x[0-9a-f]{3,}")
_MARK = re.compile(r"^[ \t]*(?://+!?|/\*+!?|\*+/?|#+!?|--|<!--|;+|\"\"\"|''')[ \t]*|[ \t]*(?:\*+/|-->|\"\"\"|''')[ \t]*$", re.M)
_COMMENT = re.compile(r"^[ \t]*(?://|/\*|\*|#|--|<!--|;|\"\"\"|''')")
_DOCSTRING = re.compile(r"[rRuU]?(\"\"\"|''')")


def _each(text: str, backwards: bool = False) -> Iterator[str]:
    """The lines one by one, so that no more of the text is cut than is read."""
    at = len(text) if backwards else 0
    while backwards and at >= 0:
        cut = text.rfind("\n", 0, at)
        yield text[cut + 1 : at]
        at = cut
    while not backwards and at <= len(text):
        cut = text.find("\n", at)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut + 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("generated", GENERATED), ("foreign", FOREIGN)):
        for w in words:
            a.add_word(w, kind)
    a.make_automaton()
    return a


def path_parts(path: str | None) -> list[str]:
    return [p for p in re.split(r"[\\/]+", path or "") if p not in ("", ".")]


def _comment_lines(lines: Iterable[str]) -> list[str]:
    """The leading lines while they are comments, blank, or inside a block comment or a leading docstring."""
    out, block = [], None
    for line in lines:
        s = line.strip()
        if block:
            out.append(line)
            if block in s:
                block = None
        elif not s:
            continue
        elif s.startswith("/*"):
            out.append(line)
            block = None if "*/" in s[2:] else "*/"
        elif m := _DOCSTRING.match(s):
            out.append(line)
            block = None if m[1] in s[m.end() :] else m[1]
        elif s.startswith(("//", "#", "--", "<!--", ";;", "*")):
            out.append(line)
        else:
            break
    return out


def serial(text: str) -> bool:
    """Whether names carry a counter with leading zeros, as no hand writes it: 000, 001, 002 and on."""
    by_width: dict[int, set[int]] = {}
    for n in NUMBERED.findall(text):
        if len(n) > 2:
            by_width.setdefault(len(n), set()).add(int(n))
    return any(len(x) >= SERIES and max(x) - min(x) < 2 * len(x) for x in by_width.values())


class Judge:
    def __init__(self, excluded: frozenset[str]):
        self.excluded = excluded
        self.automaton = _automaton()

    def notice(self, text: str) -> str | None:
        zone = _comment_lines(_each(text))
        foot = []
        for line in _each(text.rstrip(), backwards=True):
            if not line.strip():
                continue
            if not _COMMENT.match(line) or line.lstrip()[:3] in ('"""', "'''"):
                break
            foot.append(line)
        zone = "\n".join(zone + foot[::-1])
        if not zone:
            return None
        flat = " ".join(_MARK.sub("", zone.lower()).split())
        kinds = {kind for _, kind in self.automaton.iter(flat)}
        if "generated" in kinds:
            return "generated"
        if "foreign" in kinds and (STRONG_FOREIGN.search(flat) or STRONG_FOREIGN.search(zone.lower())):
            return "third_party"
        return "third_party" if zone.startswith("/*!") and STRONG_FOREIGN.search(zone.lower()) else None

    def shape(self, text: str) -> str | None:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        n = np.bincount(raw, minlength=256)
        size = len(raw)
        if not size or text.isspace():
            return None
        blank = int(n[9] + n[10] + n[13] + n[32]) / size
        lines = int(n[10]) + 1
        digits = int(n[48:58].sum()) / size
        if blank < 0.12 and size / lines > 120:
            bare = _LITERAL.sub("", text)
            if len(_WORD.findall(bare)) * 40 < size:
                return "data"
            if OBFUSCATED.search(text):
                return "obfuscated"
            # long literals aside, is what remains still without white space?
            if sum(map(str.isspace, bare)) < 0.12 * len(bare) and len(bare) > 0.3 * size:
                return "minified"
        if digits > 0.2 or n[34] + n[39] > 2 and blank < 0.12:
            bare = _LITERAL.sub("", text)
            if len(_WORD.findall(bare)) * 60 < size or digits > 0.25 and len(_WORD.findall(bare)) * 25 < size:
                return "data"
        return None

    def __call__(self, path: str | None, text: str) -> str | None:
        parts = path_parts(path)
        folders = parts[:-1]
        if self.excluded.intersection(folders):
            return "excluded_directory"
        if VENDORED.intersection(folders):
            return "third_party"
        if parts and parts[-1] in LOCKFILES:
            return "generated"
        found = self.notice(text) or self.shape(text)
        if found:
            return found
        if parts and MINIFIED_NAME.search(parts[-1]) and text.count("\n") * 80 < len(text):
            return "minified"
        if COMPILED.match(text):
            return "generated"
        if "00" in text and serial(text):
            return "generated"
        if "_0x" in text and len(OBFUSCATED.findall(text)) >= 4:
            return "obfuscated"
        return None


_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|-?\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?)\b")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")


def read_excluded(settings: DataFrame, name: str = "EXCLUDED_DIRECTORIES") -> frozenset[str]:
    """The list of the latest row of that key: JSON or separated by commas."""
    row = settings.where(F.col("setting_key") == name).orderBy(F.col("updated_at").desc_nulls_last(), F.col("setting_value").desc_nulls_last()).select("setting_value").first()
    value = (row and row[0] or "").strip()
    try:
        parsed = json.loads(value)
    except ValueError:
        parsed = value.split(",")
    return frozenset(str(x).strip() for x in (parsed if isinstance(parsed, list) else [parsed]) if x is not None and str(x).strip())


def machine_made(files: DataFrame, excluded: frozenset[str], key: str = "file_id", path: str = "file_path", content: str = "content") -> DataFrame:
    """(key, reason) of every file that is not hand-written source of its own repository."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(excluded)
        for batch in batches:
            keys, reasons = [], []
            for k, p, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if t is not None and (r := judge(p, t)):
                    keys.append(k)
                    reasons.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), pa.array(reasons, pa.string())], [key, "reason"])

    return files.select(key, path, content).mapInArrow(run, f"`{key}` {kind}, reason string")
