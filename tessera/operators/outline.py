"""Declarations of source files in brace languages, with their exact extents.

A file is cut into tokens and its brackets are matched; statements are then read
level by level, and each is told by the words it begins with.  Strings, comments
and what stands in parentheses never end a declaration.  Unbalanced brackets are
an error (``ValueError``), as a parser would report one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<hash>^[ \t]*#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|region|endregion|nullable)\b(?:\\\n|[^\n])*)"
    r"|(?P<text>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|@\"(?:[^\"]|\"\")*\"|r#\"(?:[^\"]|\"(?!#))*\"#|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<other>=>|->|::|\d[\w.]*|.)",
    re.S | re.M,
)
#: In Rust a quotation mark is a character of its own or begins a lifetime.
_RUST = re.compile(_TOKEN.pattern.replace(r"'(?:[^'\\\n]|\\.)*'", r"'(?:[^'\\\n]|\\[^\n']+|\\')'|'\w+"), re.S | re.M)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Language:
    #: Words that make a type with members, a function, a variable, and an import.
    types: frozenset[str] = frozenset()
    functions: frozenset[str] = frozenset()
    variables: frozenset[str] = frozenset()
    imports: frozenset[str] = frozenset()
    #: Words before a declaration, and words that hold further declarations without being one.
    modifiers: frozenset[str] = frozenset()
    scopes: frozenset[str] = frozenset()
    #: Types whose members are looked at, but which are no elements themselves.
    silent: frozenset[str] = frozenset()
    by_line: bool = False
    #: Functions and variables are known by their shape: type, name, parentheses.
    typed: bool = False


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


_JS = dict(types=_set("class"), functions=_set("function"), variables=_set("var"), imports=_set("import export"), modifiers=_set("async default abstract declare static get set public private protected readonly override * accessor"), by_line=True)
LANGUAGES = {
    "js": Language(**_JS),
    "ts": Language(**_JS, scopes=_set("namespace module")),
    "java": Language(types=_set("class interface"), imports=_set("import package"), modifiers=_set("public private protected static final abstract native synchronized transient volatile strictfp default sealed"), silent=_set("enum record"), typed=True),
    "csharp": Language(types=_set("class interface struct"), imports=_set("using"), modifiers=_set("public private protected internal static readonly sealed abstract virtual override async partial extern unsafe volatile new required const"), scopes=_set("namespace"), silent=_set("enum record"), typed=True),
    "cpp": Language(types=_set("class struct"), modifiers=_set("static inline virtual explicit constexpr extern friend const mutable volatile"), scopes=_set("namespace"), silent=_set("union enum"), typed=True),
    "go": Language(functions=_set("func"), variables=_set("var type"), imports=_set("import package"), by_line=True),
    "rust": Language(types=_set("struct enum"), functions=_set("fn"), variables=_set("let"), imports=_set("use"), modifiers=_set("pub async unsafe const extern"), scopes=_set("mod"), silent=_set("impl trait")),
}
LANGUAGES["c"] = LANGUAGES["cpp"]
_NO_TYPE = _set("return throw delete else goto case break continue new if for while switch do try catch using typedef public private protected yield await co_return default operator sizeof")


class Outline:
    def __init__(self, text: str, language: str):
        self.text, self.language, self.name = text, LANGUAGES[language], "cpp" if language == "c" else language
        self.found: list[tuple[str, str, int, int]] = []
        self.t: list[str] = []
        self.kind: list[str] = []
        self.at: list[tuple[int, int]] = []
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for m in (_RUST if language == "rust" else _TOKEN).finditer(text):
            if m.lastgroup in ("skip", "hash"):
                continue
            i = len(self.t)
            if self.name == "rust" and m[0][0] == "'" and m[0][-1] != "'":
                continue  # a lifetime
            if m[0] in _PAIRS:
                stack.append(i)
            elif m[0] in (")", "]", "}"):
                if not stack or _PAIRS[self.t[stack[-1]]] != m[0]:
                    raise ValueError("unbalanced brackets")
                self.match[stack.pop()] = i
            self.t.append(m[0])
            self.kind.append(m.lastgroup)
            self.at.append(m.span())
        if stack:
            raise ValueError("unbalanced brackets")
        self.back = {b: a for a, b in self.match.items()}
        self.line = [0]  # of each token
        for (_, a), (b, _) in zip(self.at, self.at[1:]):
            self.line.append(self.line[-1] + (1 if "\n" in text[a:b] else 0))
        todo = [(0, len(self.t), "file")]
        while todo:
            todo += self.block(*todo.pop())
        self.found.sort(key=lambda e: (e[2], -e[3]))

    def take(self, kind: str, name: str, first: int, last: int) -> None:
        self.found.append((kind, name, self.at[first][0], self.at[last][1]))

    def over(self, i: int) -> int:
        """The next token behind this one and, if it opens a group, the group."""
        return self.match.get(i, i) + 1

    def until(self, i: int, end: int) -> int:
        """The last token of the statement that begins here."""
        last = i
        while i < end:
            if self.t[i] == ";":
                return i
            if self.t[i] in (")", "]", "}"):
                return last
            if self.language.by_line and i > last and self.line[i] != self.line[last] and self.t[last] not in ("=", ",", "+", "=>", "?", ":", "&", "|", ".", "(") and self.t[i] not in (".", "?", ":", "+", "=", "&", "|", "="):
                return last
            last = self.match.get(i, i)
            i = last + 1
        return last

    def find(self, i: int, end: int, wanted: str, stops: str = ";}") -> int:
        """The first such token on this level, or -1."""
        while i < end and self.t[i] not in stops:
            if self.t[i] == wanted:
                return i
            i = self.over(i)
        return -1

    def start(self, i: int, end: int) -> int:
        """Behind modifiers, annotations, attributes and template heads."""
        while i < end:
            t = self.t[i]
            if t in self.language.modifiers and i + 1 < end and self.t[i + 1] not in ("(", "=", ";", ",", ":", ")"):
                i += 1
            elif t == "@" and i + 1 < end and self.t[i + 1] != "interface":
                i += 2
                while i + 1 < end and self.t[i] == ".":
                    i += 2
                i = self.over(i) if i < end and self.t[i] == "(" else i
            elif t == "[" and self.name == "csharp" or t == "#" and self.name == "rust" and i + 1 < end:
                i = self.over(i if t == "[" else i + 1)
            elif t == "<" and self.name == "java":
                i = self.angle(i, end)
            elif t == "template" and self.name == "cpp":
                i = self.angle(i + 1, end)
            elif t == "(" and self.name == "rust" and i and self.t[i - 1] == "pub":
                i = self.over(i)
            else:
                break
        return i

    def angle(self, i: int, end: int) -> int:
        """Behind a group in angle brackets, if one is here."""
        if i >= end or self.t[i] != "<":
            return i
        depth = 0
        while i < end and self.t[i] not in (";", "{"):
            depth += {"<": 1, ">": -1}.get(self.t[i], 0)
            i = self.over(i)
            if not depth:
                return i
        return i

    def block(self, i: int, end: int, where: str) -> list[tuple[int, int, str]]:
        """Declarations of one level; returns the levels below."""
        below: list[tuple[int, int, str]] = []
        while i < end:
            after = self.declaration(i, end, where, below)
            if after is None:  # no declaration: on to the next statement
                while i < end:
                    t = self.t[i]
                    if t in _PAIRS:
                        below.append((i + 1, self.match[i], "body"))
                    if t == "=>" and self.name in ("js", "ts"):
                        self.arrow(i, end)
                    n = self.over(i)
                    i = n
                    if t in (";", "{") or self.language.by_line and n < end and self.line[n] != self.line[n - 1]:
                        break
            else:
                i = after
        return below

    def arrow(self, i: int, end: int) -> None:
        first = i - 1
        if self.t[first] == ")":
            first = self.back[first]
        elif self.kind[first] != "word":
            return
        name = next((self.t[k] for k in range(first, i) if self.kind[k] == "word"), "Unknown")
        first -= first > 0 and self.t[first - 1] == "async"
        k = i + 1
        if k >= end:
            return
        last = self.match[k] if self.t[k] == "{" else self.value(k, end)
        self.take("function", name, first, last)

    def value(self, i: int, end: int) -> int:
        """The last token of the expression that begins here."""
        last = i
        while i < end and self.t[i] not in (",", ";", ")", "]", "}") and not (i > last and self.line[i] != self.line[last] and self.t[i] not in (".", "?", ":", "+") and self.t[last] not in ("=>", "?", ":", "+", "&", "|")):
            last = self.match.get(i, i)
            i = last + 1
        return last

    def inner(self, a: int, b: int, below: list) -> None:
        """What stands within a declaration on its own level: groups, and arrow functions."""
        k = a
        while k < b:
            if self.t[k] in _PAIRS:
                below.append((k + 1, self.match[k], "body"))
            if self.t[k] == "=>" and self.name in ("js", "ts"):
                self.arrow(k, b + 1)
            k = self.over(k)

    def declaration(self, first: int, end: int, where: str, below: list) -> int | None:
        lang, t = self.language, self.t
        i = self.start(first, end)
        if i >= end:
            return end
        w, nxt = t[i], t[i + 1] if i + 1 < end else ""
        if w in lang.imports and not (w == "import" and nxt in ("(", ".") and self.name in ("js", "ts")) and not (w == "using" and where == "body"):
            last = self.until(i, end)
            if w == "export":
                k = self.start(i + 1, end)
                body = self.find(k, end, "{") if k < end and t[k] in lang.types | lang.functions else -1
                last = self.match[body] if body >= 0 else last
                self.take("import", self.text[self.at[i][0] : self.at[last][1]], i, last)
                inside = self.declaration(i + 1, last + 1, where, below)
                if inside is None:
                    self.inner(i + 1, last, below)
            else:
                self.take("import", self.text[self.at[first][0] : self.at[last][1]].rstrip(";"), first, last)
            return last + 1
        if w in lang.scopes or w in lang.silent or w == "@" and nxt == "interface":
            body = self.find(i, end, "{")
            if body < 0:
                return self.until(i, end) + 1
            below.append((body + 1, self.match[body], "file" if w in lang.scopes else "class"))
            return self.match[body] + 1
        if w in lang.types and nxt and self.kind[i + 1] == "word":
            body = self.find(i, end, "{")
            last = self.match[body] if body >= 0 else self.until(i, end)
            if body < 0 and self.name == "cpp":
                return None  # named only
            self.take("class", nxt, first, last)
            if body >= 0:
                below.append((body + 1, last, "class"))
            return last + 1
        if w in lang.functions:
            name = next((t[k] for k in range(self.over(i + 1) if nxt == "(" else i + 1, end) if self.kind[k] == "word"), "Unknown")
            body = self.find(i, end, "{")
            if self.name == "go" and body >= 0 and t[body - 1] in ("interface", "struct"):
                body = self.find(self.over(body), end, "{")
            last = self.match[body] if body >= 0 else self.until(i, end)
            self.take("function", name if self.name != "go" or nxt != "(" or where == "file" else "Unknown", first, last)
            self.inner(i, body if body >= 0 else last, below)
            if body >= 0:
                below.append((body + 1, last, "body"))
            return last + 1
        if w in lang.variables:
            last = self.until(i, end)
            k = i + 1
            while k < last and self.kind[k] != "word":
                k += 1
            self.take("assignment", t[k + 1] if t[k] == "mut" else t[k], first, last)
            self.inner(i + 1, last, below)
            return last + 1
        if self.name in ("js", "ts") and where == "class" and (self.kind[i] in ("word", "text") or w in "#["):
            k = self.over(i) if w == "[" else i + 1 + (w == "#")
            k = self.angle(k, end)
            if k < end and t[k] == "(":
                body = self.find(k, end, "{")
                if body >= 0 and self.until(k, end) >= body:
                    self.take("function", t[i + (w == "#")], first, self.match[body])
                    below += [(k + 1, self.match[k], "body"), (body + 1, self.match[body], "body")]
                    return self.match[body] + 1
            return None
        return self.typed(first, i, end, where, below) if lang.typed and w not in _NO_TYPE else None

    def typed(self, first: int, i: int, end: int, where: str, below: list) -> int | None:
        """Functions, fields and variables that begin with a type."""
        t, k, words = self.t, i, 0
        name = ""
        while k < end and t[k] not in ("(", "=", ";", "{", "=>", ",", "}"):
            if self.kind[k] == "word":
                name, words = t[k], words + (not (k and t[k - 1] in (".", "::")))
                k = self.angle(k + 1, end)
            elif t[k] in ("*", "&", "?", ".", "::", "~", "[", ">", ":"):
                if t[k] == ":" and self.name != "cpp":
                    return None
                k = self.over(k)
            else:
                return None
        if k >= end or not name:
            return None
        if t[k] == "(":
            stop = self.over(k)
            body = self.find(stop, end, "{")
            if self.name != "cpp" and where != "class" or where == "body" or words < 2 and self.name != "cpp":
                if where == "class" and body >= 0:  # a constructor: no element, but its body may hold some
                    below.append((body + 1, self.match[body], "body"))
                    return self.match[body] + 1
                return None
            last = self.match[body] if body >= 0 else self.until(k, end)
            if body < 0 and self.name == "cpp":
                if where == "class" or words < 2:
                    return last + 1 if where == "class" else None
                self.take("assignment", name, first, last)
                return last + 1
            self.take("function", name, first, last)
            if body >= 0:
                below.append((body + 1, last, "body"))
            return last + 1
        if words < 2 or self.name == "java" and where != "class" or self.name == "csharp" and where != "class" or self.name == "cpp" and where == "class":
            return None
        last = self.until(k, end)
        if t[k] == "{":
            if self.name != "csharp":
                return None
            last = self.match[k] if self.over(k) >= end or t[self.over(k)] != "=" else self.until(self.over(k), end)
            below.append((k + 1, self.match[k], "body"))
        else:
            self.inner(k, last, below)
        self.take("assignment", name, first, last)
        return last + 1


def declarations(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first character, end) in source order, nested ones too."""
    return Outline(text, language).found
