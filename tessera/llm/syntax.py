"""Source files that do not parse, by generalised LL.

A file is cut into tokens, and its brackets (in Python also its indented blocks)
into a tree.  The parser steps through a group's content for all nonterminals that
may stand in such a group at once; at its closing bracket the group becomes one
token of the content around it, known by the set of those it derives.  What was
stepped through before, in this file or another, is only looked up.

Edge cases: null content and unknown extensions are not judged; an empty file is
valid (but no Go or minified file is without a package clause: Go needs one); a
byte-order mark and a leading ``#!`` line are skipped; files over any size are
parsed whole; templates or markup nested hundreds of levels deep are invalid;
repeated rows give one result.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import grammars
from .gll import END, FRONTS, Front, Network

#: Distinct token texts whose kind is kept.
MEMO = 400_000
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = {")", "]", "}"}


class Invalid(Exception):
    pass


class Kinds(dict):
    """Token text to kind id; fills itself."""

    def __init__(self, language: "Language"):
        self.language = language

    def __missing__(self, text: str) -> int:
        kind = self.language.classify(text)
        if len(text) < 40 and len(self) < MEMO:
            self[text] = kind
        return kind


class Language:
    name = ""
    grammar = ""
    #: What a whole file is.
    top = ""
    #: Nonterminals that may be the content of each bracket.
    contents: dict[str, list[str]] = {}
    keywords: frozenset[str] = frozenset()
    soft: frozenset[str] = frozenset()
    pattern: re.Pattern

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.groups: dict[int, tuple[str, frozenset[str]]] = {}
        self.of: dict[tuple[str, frozenset[str]], int] = {}
        self.kinds = Kinds(self)
        self.net = Network(self.grammar, self.matches, self.holds)
        # kinds are even; an odd one stands first on its line; those up to ``special`` need more than a step
        self.skip, self.newline, self.bad = self.kind("SKIP"), self.kind("NEWLINE"), self.kind("BAD")
        self.opens = {self.kind(b): b for b in _OPEN}
        self.closes = {self.kind(b): b for b in _CLOSE}
        self.special = 2 * len(self.names) - 1

    def kind(self, name: str) -> int:
        if name not in self.ids:
            self.ids[name] = 2 * len(self.names)
            self.names.append(name)
        return self.ids[name]

    def matches(self, kind: int, terminal: tuple[str, str]) -> bool:
        bracket, what = terminal
        group = self.groups.get(kind & ~1)
        if bracket:
            return group is not None and group[0] == bracket and what in group[1]
        if group is not None:
            return False
        name = self.names[kind >> 1]
        if name == what:
            return True
        if what == "ID":
            return name in self.soft
        return what == "WORD" and name in self.keywords

    def holds(self, kind: int, predicate: str) -> bool:
        if predicate == "end":
            return kind == END
        if predicate == "asi":
            return kind == END or bool(kind & 1)
        if predicate in ("exprstart", "arrowexpr"):
            group = self.groups.get(kind & ~1) if kind != END else None
            if group is not None:
                return group[0] != "{"
            return kind == END or predicate == "arrowexpr" or self.names[kind >> 1] not in ("function", "class")
        return False  # never

    def classify(self, text: str) -> int:
        raise NotImplementedError

    def inside(self) -> dict[str, Front]:
        """The front at the start of each kind of group."""
        return {b: self.net.start(*names) for b, names in self.contents.items()}

    def group(self, bracket: str, front: Front) -> int:
        """The kind of a group: one for all contents that derive the same nonterminals."""
        can = front.accepts
        found = self.of.get((bracket, can))
        if found is None:
            if not can:
                raise Invalid(bracket)
            found = self.of[bracket, can] = self.kind(bracket + ",".join(sorted(can)))
            self.groups[found] = (bracket, can)
        return found

    def tokens(self, text: str) -> list[int]:
        return [*map(self.kinds.__getitem__, self.pattern.findall(text))]

    def run(self, text: str, *names: str) -> Front:
        """The front after the whole text, from the start of these nonterminals."""
        return self.feed(self.tokens(text), *names)

    def feed(self, tokens: list[int], *names: str) -> Front:
        """The same for the kinds of its tokens."""
        front, inside, special = self.net.start(*names), self.inside(), self.special
        skip, newline, bad, opens, closes = self.skip, self.newline, self.bad, self.opens, self.closes
        stack: list[tuple[str, int, Front]] = []
        first = 0
        for k in tokens:
            if k > special:
                front = front[k | first]
                first = 0
            elif k == newline:
                first = 1
            elif k in opens:
                stack.append((opens[k], first, front))
                front = inside[opens[k]]
                first = 0
            elif k in closes:
                if not stack or _OPEN[stack[-1][0]] != closes[k]:
                    raise Invalid("bracket")
                bracket, first, outer = stack.pop()
                front = outer[self.group(bracket, front) | first]
                first = 0
            elif k == bad:
                raise Invalid("token")
        if stack:
            raise Invalid("open bracket")
        return front

    def valid(self, text: str) -> bool:
        if len(self.net.fronts) > FRONTS:
            self.net.reset()
        text = text.removeprefix("\ufeff")
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        try:
            return self.top in self.run(text, self.top).accepts
        except (Invalid, RecursionError):
            return False


class Script(Language):
    """JavaScript as a module."""

    name, grammar, top = "js", grammars.JS, "Program"
    keywords = frozenset("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new null return super switch this throw true false try typeof var void while with yield await let static implements interface package private protected public".split())
    soft = frozenset("async of get set from as type assert require using global".split())
    contents = {
        "(": ["Expr", "Args", "Params", "ForHead", "CatchHead"],
        "[": ["Expr", "ArrLit", "ArrPat", "Assign"],
        "{": ["Stmts", "ObjLit", "ObjPat", "ClassBody", "Cases", "ImportList"],
    }
    pattern = re.compile(
        r"[ \t\r\f\v\xa0﻿]*(//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\n\s*"
        r"|[^\W\d][\w$]*(?:\$[\w$]*)*|\$[\w$]*|\"(?:[^\"\\\n]|\\(?:\r\n|.|\n))*\"|'(?:[^'\\\n]|\\(?:\r\n|.|\n))*'|`(?:[^`\\]|\\.|\\\n)*`"
        r"|0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
        r"|#[^\W\d][\w$]*|\.\.\.|\?\.(?!\d)|=>|===|!==|\*\*=|\*\*|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|<<=|<<|[-+*/%&|^]=|[-+*/%&|^!~?:;,.<>=@(){}\[\]]|.|\Z)",
        re.S,
    )
    blanks, slash = re.compile(r"[ \t\r\f\v\xa0﻿]*"), re.compile(r"/(?![/*])")
    slow = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")

    def __init__(self):
        super().__init__()
        names = "ID NUM STR TPL REGEX JSX this super null true false ) ] }".split()
        self.operand = {self.kind(n) for n in names} | {self.kind(s) for s in self.soft}
        self.heads = {self.kind(n) for n in "if for while switch catch function with".split()}

    def classify(self, text: str) -> int:
        if not text:
            return self.skip
        c = text[0]
        if c == "\n":
            return self.newline
        if text.startswith(("//", "/*")):
            return self.newline if text.startswith("/*") and "\n" in text else self.skip
        if c.isalpha() or c in "_$":
            return self.kind(text if text in self.keywords or text in self.soft else "ID")
        if c in "\"'":
            return self.kind("STR") if len(text) > 1 and text[-1] == c else self.bad
        if c == "`":
            return self.template(text) if len(text) > 1 else self.bad
        if c.isdigit() or c == "." and len(text) > 1 and text[1].isdigit():
            return self.kind("NUM") if not re.match(r"0\d", text) else self.bad
        if c == "#":
            return self.kind("PRIV") if len(text) > 1 else self.bad
        if len(text) > 1 or c in "-+*/%&|^!~?:;,.<>=@(){}[]":
            return self.kind(text)
        return self.bad

    def template(self, text: str) -> int:
        """A template whose substitutions are expressions."""
        i, n = 1, len(text) - 1
        while True:
            i = text.find("${", i, n)
            if i < 0:
                return self.kind("TPL")
            back = len(text[:i]) - len(text[:i].rstrip("\\"))
            if back % 2:
                i += 2
                continue
            end = self.closing(text, i + 2, n)
            if end < 0:
                return self.bad
            try:
                if "Expr" not in self.run(text[i + 2 : end], "Expr").accepts:
                    return self.bad
            except Invalid:
                return self.bad
            i = end + 1

    @staticmethod
    def closing(text: str, i: int, n: int) -> int:
        depth = 1
        while i < n:
            c = text[i]
            if c in "\"'":
                j = i + 1
                while j < n and text[j] != c:
                    j += 1 + (text[j] == "\\")
                i = j
            elif c == "`":
                j = i + 1
                while j < n and text[j] != "`":
                    if text.startswith("${", j):
                        j = Script.closing(text, j + 2, n)
                        if j < 0:
                            return -1
                    j += 1 + (text[j] == "\\") if j < n else 1
                i = j
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return i
            i += 1
        return -1

    def tokens(self, text: str) -> list[int]:
        if "`" in text and "${" in text or any(self.expects_operand(text, m.start()) for m in self.slash.finditer(text)):
            return self.careful(text)
        return super().tokens(text)

    @staticmethod
    def expects_operand(text: str, at: int) -> bool:
        """Whether a slash here may begin a regular expression, by what stands before it."""
        while at and text[at - 1].isspace():
            at -= 1
        return not at or text[at - 1] in "=(,:;!&|?[{}+~^<>%*-" or text.endswith(("return", "typeof", "case"), 0, at)

    def careful(self, text: str) -> list[int]:
        """One token after another: regular expressions and nested templates."""
        return self.scan(text, 0, False)[0]

    def scan(self, text: str, i: int, within: bool) -> tuple[list[int], int]:
        """Kinds from here to the end or, ``within`` braces, to the brace that closes them; and where that is."""
        out, n, last, depth = [], len(text), -1, 0
        match, kinds = self.pattern.match, self.kinds
        paren: list[bool] = []
        after_head = False
        while (i := self.blanks.match(text, i).end()) < n:
            c = text[i]
            if within and c in "{}":
                depth += 1 if c == "{" else -1
                if depth < 0:
                    return out, i
            if c == "/" and text[i + 1 : i + 2] not in ("/", "*") and (last not in self.operand or after_head) and (m := self.slow.match(text, i)):
                k, i = self.kind("REGEX"), m.end()
            elif c == "<" and self.elements and (last not in self.operand or after_head) and self.opening.match(text, i):
                k, i = self.kind("JSX"), self.element(text, i)
            elif c == "`":
                j = i + 1
                while j < n and text[j] != "`":
                    if text.startswith("${", j):
                        j = self.closing(text, j + 2, n)
                        if j < 0:
                            return [self.bad], n
                    j += 1 + (j < n and text[j] == "\\")
                if j >= n:
                    return [self.bad], n
                k, i = self.template(text[i : j + 1]), j + 1
            else:
                m = match(text, i)
                k, i = kinds[m[1]], m.end()
            out.append(k)
            if k not in (self.skip, self.newline):
                after_head = False
                if c == "(":
                    paren.append(last in self.heads)
                elif c == ")" and paren:
                    after_head = paren.pop()
                last = k
        if within:
            raise Invalid("open brace")
        return out, i

    # -- elements of markup, in the dialects that have them -----------------------

    elements = False
    opening = re.compile(r"<(?:>|[A-Za-z_$])")
    _name, _pad = re.compile(r"[A-Za-z_$][\w$]*(?:[.:-][\w$-]*)*"), re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")

    def braces(self, text: str, i: int, spread: bool) -> int:
        """Behind a pair of braces that begins here and holds an expression, spread or (in children) nothing."""
        inner, end = self.scan(text, i + 1, True)
        inner = [k for k in inner if k not in (self.skip, self.newline)]
        if inner and inner[0] == self.kind("..."):
            inner = inner[1:]
        elif spread:
            raise Invalid("attribute")
        if (inner or spread) and "Expr" not in self.feed(inner, "Expr").accepts:
            raise Invalid("expression")
        return end + 1

    def element(self, text: str, i: int) -> int:
        """Behind the element that begins here; open ones are kept on a list, whatever their depth."""
        open_: list[str] = []
        while True:
            # a tag begins here
            closes = text.startswith("</", i)
            i = self._pad.match(text, i + 1 + closes).end()
            m = self._name.match(text, i)
            name, i = (m[0], m.end()) if m else ("", i)
            i = self._pad.match(text, i).end()
            if closes:
                if not open_ or open_.pop() != name or text[i : i + 1] != ">":
                    raise Invalid("closing tag")
                i += 1
            else:
                while (c := text[i : i + 1]) not in (">", "/"):
                    if c == "{" and name:
                        i = self.braces(text, i, True)
                    elif name and (m := self._name.match(text, i)):
                        i = self._pad.match(text, m.end()).end()
                        if text[i : i + 1] == "=":
                            i = self._pad.match(text, i + 1).end()
                            c = text[i : i + 1]
                            if c in ("\"", "'") and c:
                                i = text.find(c, i + 1) + 1
                                if not i:
                                    raise Invalid("attribute")
                            elif c == "{":
                                j = i
                                i = self.braces(text, i, False)
                                if not text[j + 1 : i - 1].strip():
                                    raise Invalid("attribute")
                            elif c == "<":
                                i = self.element(text, i)
                            else:
                                raise Invalid("attribute")
                    else:
                        raise Invalid("tag")
                    i = self._pad.match(text, i).end()
                if c == ">":
                    open_.append(name)
                    i += 1
                elif name and text.startswith("/>", i):
                    i += 2
                else:
                    raise Invalid("tag")
            if not open_:
                return i
            while (c := text[i : i + 1]) != "<":  # children
                if not c or c in "}>":
                    raise Invalid("child")
                if c == "{":
                    i = self.braces(text, i, False)
                else:
                    m = self._words.match(text, i)
                    i = m.end()

    _words = re.compile(r"[^<>{}]+")


class TypeScript(Script):
    name, grammar = "ts", grammars.TS
    keywords = Script.keywords - frozenset("implements interface package private protected public static".split())
    soft = Script.soft | frozenset("implements interface private protected public static readonly abstract declare override accessor namespace module is asserts keyof infer unique satisfies out any".split())
    contents = {
        "(": [*Script.contents["("], "Type"],
        "[": [*Script.contents["["], "Nothing", "Type", "Tuple", "IndexSig"],
        "{": [*Script.contents["{"], "TypeBody", "EnumBody", "Program"],
    }


class ScriptX(Script):
    """JavaScript with elements of markup."""

    name, elements = "jsx", True

    def tokens(self, text: str) -> list[int]:
        return self.careful(text)


class TypeScriptX(TypeScript):
    """TypeScript with elements of markup; a type in angle brackets before an expression is none."""

    name, elements = "tsx", True
    opening = re.compile(r"<(?:>|[A-Za-z_$](?![\w$]*\s*(?:,|extends\b)))")

    def tokens(self, text: str) -> list[int]:
        return self.careful(text)


class Java(Language):
    name, grammar, top = "java", grammars.JAVA, "Unit"
    keywords = frozenset("abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
    soft = frozenset("record sealed permits yield when module open requires exports opens uses provides transitive to with non".split())
    prims = frozenset("int long short byte char boolean float double".split())
    contents = {
        "(": ["Expr", "Args", "Params", "ForHead", "CatchHead", "Resources", "AnnoArgs", "CastType", "LambdaParams", "Patterns"],
        "[": ["Nothing", "Expr"],
        "{": ["Stmts", "ClassBody", "EnumBody", "ArrInit", "SwitchBody", "ElemVals", "ModuleBody"],
    }
    pattern = re.compile(
        r"\s*(//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|[^\W\d][\w$]*|\$[\w$]*|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'"
        r"|0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?"
        r"|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<=|<<|[-+*/%&|^]=|[-+*/%&|^!~?:;,.<>=@(){}\[\]]|.|\Z)",
        re.S,
    )

    def classify(self, text: str) -> int:
        if not text:
            return self.skip
        c = text[0]
        if text.startswith(("//", "/*")):
            return self.skip
        if c.isalpha() or c in "_$":
            return self.kind(text if text in self.keywords or text in self.soft else "PRIM" if text in self.prims else "ID")
        if c in "\"'":
            return self.kind("STR") if len(text) > 1 and text[-1] == c and text != "''" else self.bad
        if c.isdigit() or c == "." and len(text) > 1 and text[1].isdigit():
            return self.kind("NUM")
        if len(text) > 1 or c in "-+*/%&|^!~?:;,.<>=@(){}[]":
            return self.kind(text)
        return self.bad


class Go(Language):
    name, grammar, top = "go", grammars.GO, "File"
    keywords = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    contents = {
        "(": ["Grouped", "Args", "Params", "ImportSpecs", "Specs", "TypeSpecs", "Type", "Asserted"],
        "[": ["Nothing", "Index", "ArrLen", "TypeList", "TypeParams", "Type"],
        "{": ["Stmts", "Literal", "Fields", "Methods", "Cases"],
    }
    pattern = re.compile(
        r"[ \t\r]*(//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\n|[^\W\d]\w*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n']+|\\')'|`[^`]*`"
        r"|0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?"
        r"|\.\.\.|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|<<=|>>=|&\^=|&\^|<<|>>|[-+*/%&|^]=|[-+*/%&|^!~:;,.<>=(){}\[\]]|.|\Z)",
        re.S,
    )

    def __init__(self):
        super().__init__()
        self.semi = self.kind(";")
        self.enders = {self.kind(n) for n in "ID NUM STR break continue fallthrough return ++ -- ) ] }".split()}

    def classify(self, text: str) -> int:
        if not text:
            return self.skip
        c = text[0]
        if c == "\n":
            return self.newline
        if text.startswith("//"):
            return self.skip
        if text.startswith("/*"):
            return self.newline if "\n" in text else self.skip
        if c.isalpha() or c == "_":
            return self.kind(text if text in self.keywords else "ID")
        if c in "\"'`":
            return self.kind("STR") if len(text) > 1 and text[-1] == c else self.bad
        if c.isdigit() or c == "." and len(text) > 1 and text[1].isdigit():
            return self.kind("NUM")
        if len(text) > 1 or c in "-+*/%&|^!~:;,.<>=(){}[]":
            return self.kind(text)
        return self.bad

    def tokens(self, text: str) -> list[int]:
        out, last = [], -1
        skip, newline, semi, enders = self.skip, self.newline, self.semi, self.enders
        kinds = self.kinds
        for t in self.pattern.findall(text):
            k = kinds[t]
            if k == skip:
                continue
            if k == newline:
                if last in enders:
                    out.append(semi)
                    last = semi
                continue
            out.append(k)
            last = k
        if last in enders:
            out.append(semi)
        return out


class Python(Language):
    name, grammar, top = "python", grammars.PYTHON, "File"
    keywords = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
    soft = frozenset(["match", "case", "type"])
    contents = {
        "(": ["Paren", "Args", "Params", "NameList", "WithItems", "TargetGroup", "Single", "PatGroup", "PatArgs"],
        "[": ["List", "Subs", "TargetGroup", "TypeParams", "PatGroup"],
        "{": ["Braces", "PatMap"],
        "<": ["Stmts", "Cases"],
    }
    pattern = re.compile(
        r"(?:[ \t\f]|\\\r?\n|#[^\n]*(?!\n[^\n]))*((?:\r?\n[ \t\f]*(?:#[^\n]*)?)+|\r|(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
        r"|[^\W\d]\w*|0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?"
        r"|\.\.\.|->|:=|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|==|!=|<=|>=|[-+*/%@&|^]=|[-+*/%@&|^~:;,.<>=(){}\[\]]|#|.|\Z)",
        re.S,
    )

    def __init__(self):
        super().__init__()
        self.nl, self.colon = self.kind("NL"), self.kind(":")

    def classify(self, text: str) -> int:
        if not text:
            return self.skip
        c = text[0]
        if c in "\n\r":
            return self.newline
        if c == "#":
            return self.skip
        if text[-1] in "\"'":
            return self.kind("STR") if len(text.lstrip("rRbBuUfFtT")) > 1 else self.bad
        if c.isalpha() or c == "_":
            return self.kind(text if text in self.keywords or text in self.soft else "ID")
        if c.isdigit() or c == "." and len(text) > 1 and text[1].isdigit():
            return self.kind("NUM") if not re.match(r"0[\d_]*[1-9]", text) or not text.isdigit() else self.bad
        if len(text) > 1 or c in "-+*/%@&|^~:;,.<>=(){}[]":
            return self.kind(text)
        return self.bad

    def run(self, text: str, *names: str) -> Front:
        text = re.sub(r"(?m)^[ \t\f]*#[^\n]*$", "", text) if "#" in text and '"""' not in text and "'''" not in text else text
        front, inside, special = self.net.start(*names), self.inside(), self.special
        newline, bad, nl, colon, opens, closes = self.newline, self.bad, self.nl, self.colon, self.opens, self.closes
        indents = [0]
        blocks: list[Front] = []  # the fronts around each open block
        stack: list[tuple[str, Front]] = []  # open brackets
        fresh = True  # at the start of a logical line
        last = before = -1  # the two kinds before, on this level
        first_indent = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*([ \t\f]*)(?=[^\s#]|\Z)", text)
        pending = len(first_indent[1].expandtabs(8)) if first_indent else 0
        tokens = self.pattern.findall(text, first_indent.start(1) if first_indent else 0)
        for t, k in zip(tokens, map(self.kinds.__getitem__, tokens)):
            if k > special or k in opens:
                if fresh:
                    if pending > indents[-1]:
                        if last != nl or before != colon:
                            raise Invalid("indent")
                        indents.append(pending)
                        blocks.append(front)
                        front = inside["<"]
                    while pending < indents[-1]:
                        indents.pop()
                        block = self.group("<", front)
                        front = blocks.pop()[block]
                        before, last = last, block
                    if pending != indents[-1]:
                        raise Invalid("dedent")
                    fresh = False
                if k > special:
                    front = front[k]
                    before, last = last, k
                else:
                    stack.append((opens[k], front))
                    front = inside[opens[k]]
            elif k == newline:
                if stack:
                    continue
                if not fresh:
                    front = front[nl]
                    before, last = last, nl
                    fresh = True
                tail = t[t.rfind("\n") + 1 :]
                if "#" not in tail:  # a comment line closes the run; the next newline sets the indent
                    pending = len(tail.expandtabs(8))
            elif k in closes:
                if not stack or _OPEN[stack[-1][0]] != closes[k]:
                    raise Invalid("bracket")
                bracket, outer = stack.pop()
                last = self.group(bracket, front)
                front = outer[last]
            elif k == bad:
                raise Invalid("token")
        if stack:
            raise Invalid("open bracket")
        if not fresh:
            front = front[nl]
        while blocks:
            block = self.group("<", front)
            front = blocks.pop()[block]
        return front

    def valid(self, text: str) -> bool:
        if super().valid(text):
            return True
        # an exact check of what the grammar rejects
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text.removeprefix("﻿"))
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False


LANGUAGES = {".py": Python, ".pyi": Python, ".js": Script, ".mjs": Script, ".jsx": ScriptX, ".ts": TypeScript, ".mts": TypeScript, ".tsx": TypeScriptX, ".java": Java, ".go": Go}
_READY: dict[type, Language] = {}


def language_of(path: str | None) -> Language | None:
    m = re.search(r"\.[A-Za-z]+$", path or "")
    kind = LANGUAGES.get(m[0].lower()) if m else None
    if kind is None:
        return None
    if kind not in _READY:
        _READY[kind] = kind()
    return _READY[kind]


def parses(path: str | None, text: str) -> bool | None:
    """None: not a language that is judged."""
    language = language_of(path)
    return None if language is None else language.valid(text)


def unparsable(files: DataFrame, key: str = "file_id", path: str = "file_path", content: str = "content", *carried: str) -> DataFrame:
    """(key, language, valid) of every file in a supported language, and the columns to carry along."""
    kept = [key, *carried]
    kinds = "".join(f", `{c}` {files.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, languages, valid = [], [], []
            for i, (p, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if t is not None and (language := language_of(p)) is not None:
                    at.append(i)
                    languages.append(language.name)
                    valid.append(language.valid(t))
            rows = batch.take(pa.array(at, pa.int64()))
            columns = [rows.column(2), pa.array(languages, pa.string()), pa.array(valid, pa.bool_()), *(rows.column(3 + i) for i in range(len(carried)))]
            yield pa.RecordBatch.from_arrays(columns, [key, "language", "valid", *carried])

    kind = files.schema[key].dataType.simpleString()
    return files.select(path, content, *kept).mapInArrow(run, f"`{key}` {kind}, language string, valid boolean{kinds}")
