"""Credentials embedded in source and configuration files, and their redaction.

Strings are split by a public subword vocabulary.  Natural words and names come as
few long subwords; keys and passwords fall apart into many short ones, so few
characters per subword mark an unnatural string.  Context sets the bar: behind a
telling name, in a header, a URL's login, a login call or a comment about a
password ``TOLD`` characters per subword are few enough, with a provider's prefix
``PREFIXED``; a string without any such context, wherever it stands, has to stay
below ``UNTOLD``.  Context rules then take out placeholders, references to
variables and secret stores, digests, identifiers, embedded data and public keys.
Redaction replaces the characters of the value one for one, so that no offset,
quote, escape or line break of the surrounding code moves.

Edge cases: null and empty contents have no rows; lines are counted from 1 and
end with a line feed, and may have any length; a literal joined from parts counts
on its first line and all its parts are redacted; a private key counts on the line
of its first marker and its body is redacted; a password has four characters or
more (three in a URL, which tells of one by itself); repeated rows give one result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from re import _parser as sre

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokenizer import TOKENIZERS, open_bpe

#: At most so many characters per subword in an unnatural string: in a telling context, with a provider's prefix, and without either.
TOLD, PREFIXED, UNTOLD = 2.6, 3.6, 2.0
_NAME = r"passwords?|passwd|passwort|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|account[_-]?key|secret[_-]?key|auth[_-]?key|auth|authorization|credentials?|bearer|webhook"
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_KEY = rf"(?P<name>[\w$.-]{{0,64}}?(?:{_NAME})[\w$-]{{0,64}})(?P<q>[\"'`]?\]?)\s{{0,40}}(?::\s{{0,40}}[\w<>\[\]. |]{{1,60}}?\s{{0,40}})?(?P<op>:=|=>|=|:)(?!=)\s*+"
_KEYED = re.compile(rf"{_KEY}(?P<open>(?:\(\s*)+(?=[bru]{{0,2}}[\"'`]))?(?:[bru]{{1,2}}(?=[\"'`]))?(?P<value>{_STRING}|[^\s\"'`,;]+)", re.I)
#: A name at the end of its line whose literal begins on the next, and how a literal goes on.
_REMARK, _BLANKS = r"[ \t]*+(?:(?:#|//)[^\n]*+)?", r"(?:\s|(?:#|//)[^\n]*\n)*+"
_OPEN = re.compile(rf"{_KEY}(?P<open>(?:\(\s*+)+)?\\?{_REMARK}\s*+$", re.I)
_NEXT = re.compile(rf"{_BLANKS}[bru]{{0,2}}(?P<value>{_STRING})(?!\s*[:=])(?![\"'`])", re.I)
_INDENT = re.compile(r"[ \t]*")
_MORE = re.compile(rf"(?:(?P<sign>{_BLANKS}(?:\+|\.{{1,2}}|&){_BLANKS}|[ \t]*\\\r?\n\s*)|(?P<break>{_REMARK}\r?\n(?:[ \t]*(?:#|//)[^\n]*\n)*(?P<indent>[ \t]*))|[ \t]+)[bru]{{0,2}}(?P<value>{_STRING})(?P<key>\s*[:=])?", re.I)
_FLAG = re.compile(rf"--?(?:[\w-]{{0,40}}?(?:{_NAME})[\w-]{{0,40}})[ =]{{1,20}}(?P<value>{_STRING}|[^\s\"']+)", re.I)
_HEADER = re.compile(rf"\b(?:x-[\w-]{{0,40}}?(?:key|token|secret|auth)[\w-]{{0,40}}|authorization|proxy-authorization)\s*:\s*(?:(?:bearer|basic|token)\s+)?(?P<value>[^\s\"'`,;]+)", re.I)
_PROSE = re.compile(r"\b(?:token|password|passwd|passphrase|secret|key|login|pass|pwd)\b(?:\s+(?:is|was|for|of|to|now|here|the)\b|\s+[a-z]\w*)?(?:\s*[:=/]\s*|\s+(?:/\s*)?)(?P<value>[^\s\"'`,;()]{6,})", re.I)
_LOGIN = re.compile(r"\b(?:login|account|user|credentials)\b[^\n]{0,40}?\s/\s(?P<value>[^\s\"'`,;()]{6,})", re.I)
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{0,20}://(?P<user>[^\s:/@\"'`<>]{0,120}):(?P<value>[^\s/@\"'`]{1,400})@[\w.\[\]${}<>-]+", re.I)
_BEARER = re.compile(r"\b(?:bearer|basic)\s{1,20}(?P<value>[\w.~+/=-]{12,})|[\"'`]token\s{1,20}(?P<other>[\w.~+/=-]{12,})", re.I)
#: Calls that take a login (any argument but the first) or a credential (any argument).
_LOGINS = "connect|login|log_in|logon|log_on|signin|sign_in|authenticate|basic_?auth"
_CALL = re.compile(rf"(?P<name>\w{{0,64}}?(?:(?P<login>{_LOGINS})|{_NAME})\w{{0,64}})\s{{0,20}}\(", re.I)
#: What every match of these two holds, without what stands before it: cheap to rule out.
_KEYED_PART = re.compile(rf"(?:{_NAME})[\w$-]{{0,64}}[\"'`]?\]?\s{{0,40}}[:=]", re.I)
_CALL_PART = re.compile(rf"(?:{_LOGINS}|{_NAME})\w{{0,64}}\s{{0,20}}\(", re.I)
_ARGUMENT = re.compile(rf"\s*(?:[bru]{{0,2}}(?P<value>{_STRING})\s*(?=[,)])|(?P<named>[\w.-]+\s*(?:=|:)(?!=))?(?:{_STRING}|\([^()\n]*\)|[^\"'`(),])*)(?P<end>[,)])?")
#: Calls that look a credential up, and literals that are plain names.
_GETTER = re.compile(r"^(?:get|fetch|read|load|lookup|find|has|is|delete|remove|require|check|count|list|parse|split|next|peek|emit|log_)(?![a-z])|^(?:get|fetch|read|load|find|has|is|parse)(?=[A-Z_])")
_PLAIN = re.compile(r"^(?:[a-z]+(?:[_.-][a-z]+)+|[A-Z]+(?:_[A-Z]+)+)[_-]?\d{0,4}$")
_FIXED = re.compile(
    r"(?<![A-Za-z0-9_/+.-])(?P<value>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{20,}|xox[abpsr]-[\w-]{10,}|(?:(?:sk|rk|pk)_live_|(?:sk|rk|pk)_test_)[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,})(?![A-Za-z0-9])"
)
_FIXED_PART = re.compile(r"^(?:(?:AKIA|ASIA)[0-9A-Z]{12,}|gh[pousr]_|github_pat_|glpat-|xox[abpsr]-|(?:sk|rk)_(?:live|test)_|sk-|AIza|npm_|eyJ)")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


def _bodies(slashes: str) -> tuple[re.Pattern, re.Pattern]:
    """The body of a private key after its marker, and one run of it; comment marks may begin its lines."""
    mark = rf"(?:\n|\\n)[ \t]*+(?:/\*+|#+|\*+|--(?!-)|;+|>+|!+|%+|{slashes})[ \t]*+"
    head = r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):(?:(?!\\[nr])[^\n])*+"
    gap = rf"(?:{mark}|\\[nrt]?|[\s\"'`+,;])"
    return re.compile(rf"(?:{gap}|{head})*+(?P<body>[A-Za-z0-9+/=]{{16,}}+(?:{gap}++[A-Za-z0-9+/=]++)*)"), re.compile(rf"(?P<run>[A-Za-z0-9+/=]++){gap}*+")


#: Two slashes may begin a line of the key itself, so they need a blank, unless such a comment holds the marker.
_BODY, _BODY_SLASHED = _bodies(r"//+(?=[ \t])"), _bodies("//+")
_SLASHED = re.compile(r"//+[ \t]*$")
#: Names that tell of something about a credential, not of the credential.
_ABOUT = re.compile(
    r"(?:hint|policy|field|type|name|ref|reference|ttl|limit|size|count|length|len|min|max|path|file|url|uri|endpoint|host|header|prefix|suffix|format|pattern|regex|label|title|text|message|msg|error|status|state|level|kind|mode|expiry|expires?|expiration|timeout|interval|age|rotation|id|ids|public|pub|digest|hash|sha\d*|md5|checksum|fingerprint|etag|version|index|column|input|form|page|placeholder|description|enabled|required|algorithm|provider|store|manager|scope|scopes|budget|usage|cache|bucket|delay|step|row|total|offset|weight|part|group|node|line|item|value|entry|depth|ratio)s?\d*$",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"change[_-]?me|change[_-]?this|replace[_-]?(?:me|this|with)|your[_-]|(?:^|[_-])(?:example|sample|dummy|placeholder|redacted|insert|todo|fixme|tbd|none|null|nil|undefined|true|false|empty|default|secret|password|token|test)$|^(?:example|sample|dummy|placeholder|redacted|masked|hidden|todo|tbd|fixme|none|null)|x{6,}|\*{3,}|\.{3,}|^<.*>$|[<>]|\$\{|\{\{|%\(|\$\(|^\$\w|^%\w+%$|^@\w+@$",
    re.I,
)
_REFERENCE = re.compile(r"^(?:vault|secret|secretsmanager|ssm|env|file|kms|keychain|op|aws|gcp|azure|sops|arn)[:/]|^(?:os|process|System|ENV|env|config|settings|cfg|self|this|viper|secrets?|vault)\b[.\[(]|getenv|environ|\w\(|^[A-Za-z_][\w.]*\[|^type=", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_DIGEST = re.compile(r"^(?:sha\d+[:-]|md5[:-])", re.I)
#: A string as long as keys are, without context; what stands before it as its name; and names that tell of other things.
_LONG = re.compile(r"(?<![\w+/=.~\\-])[A-Za-z0-9][\w+/=.~-]{19,199}(?![\w+/=.~-])")
_NAMED = re.compile(r"([\w$-]{1,64})[\"'`]?\]?\s{0,40}(?::\s{0,40}[\w<>\[\]. |]{1,60}?)?(?::=|=>|=|:)\s*[bru]{0,2}[\"'`]?$", re.I)
_OTHER = re.compile(r"(?:hash|digest|sum|etag|commit|revision|rev|integrity|icon|image|img|data|blob|font|id|uuid|guid|trace|fingerprint|cert|certificate|public|pub|sri|nonce|salt|seed|version|payload|fixture|snapshot|cursor|signature|sig|mapping|asset|font|media|path|file|url|name|class|style|svg|png)[\w$]*$", re.I)
_WITHIN = re.compile(r"[a-z]+://[^\s\"'`]*$|base64,$|BEGIN ")
_DIGIT = re.compile(r"\d")
_HEX = re.compile(r"^(?:0x)?[0-9a-f-]+$|^(?:0x)?[0-9A-F-]+$")
#: Names of passwords, which may be short.
_SHORT = re.compile(r"passwords?|passwd|passwort|passphrase|passcode|pwd|pass", re.I)
_CODE = re.compile(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:[();,{}]|$)")
_COMMENT = re.compile(r"^\s*(?://|#|\*|/\*|--|;|<!--|\"\"\"|''')|\s(?://|#)\s")


def needed(rule: re.Pattern) -> set[str]:
    """Strings, in lower case, of which every match of the rule holds one."""

    def walk(items) -> set[str]:
        best, run = set(), {""}
        for op, av in [*items, (None, None)]:
            if op is sre.LITERAL:
                run = {r + chr(av).lower() for r in run}
                continue
            if op is sre.IN and len(av) <= 8 and all(o is sre.LITERAL for o, _ in av) and len(run) <= 8:
                run = {r + chr(c).lower() for r in run for _, c in av}
                continue
            found = [run]
            run = {""}
            if op is sre.SUBPATTERN:
                found.append(walk(av[3]))
            elif op is sre.BRANCH:
                parts = [walk(x) for x in av[1]]
                found.append(set().union(*parts) if all(parts) else set())
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0]:
                found.append(walk(av[2]))
            for x in found:
                if x and min(map(len, x)) >= max(1, min(map(len, best), default=0)):
                    best = x
        return best

    out = walk(sre.parse(rule.pattern, rule.flags & re.I))
    assert out, rule.pattern
    return out


RULES = [_KEYED, _FLAG, _HEADER, _PROSE, _LOGIN, _URL, _BEARER, _CALL, _FIXED, _PRIVATE]
#: What the automaton looks for, with the rules (as bits) that match only where it stands: no rule matches without one.
HINTS: dict[str, int] = {}
for _i, _rule in enumerate(RULES):
    for _h in needed(_rule):
        HINTS[_h] = HINTS.get(_h, 0) | 1 << _i
_BIT = {id(r): 1 << i for i, r in enumerate(RULES)}
#: Letters that match others when case is ignored, beyond their lower case.
_FOLD = str.maketrans({"\u0131": "i", "\u0130": "i", "\u017f": "s", "\u212a": "k"})


class Finder:
    def __init__(self, vocabulary: str, told: float = TOLD, prefixed: float = PREFIXED, untold: float = UNTOLD):
        self.bpe = open_bpe(vocabulary)
        self.told, self.prefixed, self.untold = told, prefixed, untold
        self.automaton = ahocorasick.Automaton()
        for h, rules in HINTS.items():
            self.automaton.add_word(h, (len(h), rules))
        self.automaton.make_automaton()
        self.ratios: dict[str, float] = {}

    def per_subword(self, value: str) -> float:
        """Characters per subword, never across what the value joins by marks."""
        if value not in self.ratios:
            if len(self.ratios) > 200_000:
                self.ratios.clear()
            self.ratios[value] = len(value) / max(1, len(self.bpe.encode_batch([value])[0]))
        return self.ratios[value]

    def credible(self, value: str, bare: bool, least: int = 6) -> bool:
        """Whether the value of a telling context is a literal credential."""
        if len(value) < least or " " in value.strip():
            return False
        if _PLACEHOLDER.search(value) or _REFERENCE.search(value) or _UUID.match(value) or _DIGEST.match(value) or "://" in value:
            return False
        if _FIXED_PART.match(value) and len(value) >= 12:
            return self.per_subword(value) <= self.prefixed
        if value.replace(".", "").replace("-", "").replace(":", "").isdigit() and len(value) < 16:
            return False
        if len(set(value)) < min(4, len(value)) or value[0] in "/." and not any(c.isdigit() for c in value):
            return False
        if bare and (any(c in "[]{}()" for c in value) or _CODE.match(value) and not any(c.isdigit() for c in value)):
            return False
        # a short value is unnatural only if hardly any two of its characters belong together
        return self.per_subword(value) <= (self.told if len(value) > 7 else self.told - 0.6 if len(value) > 5 else self.told - 1)

    def untold_keys(self, text: str) -> list[tuple[int, int]]:
        """Spans of the unnatural strings that need no context to be keys: whole literals or values, of
        letters of both cases and digits, that are no part of a series without names."""
        found, last = [], -1
        for m in _LONG.finditer(text):
            v, (a, b) = m[0], m.span()
            if _DIGIT.search(v) is None or v.isupper() or v.islower() or _HEX.match(v) or "__" in v:
                continue
            series, last = last >= 0 and text.count("\n", last, a) < 2, b
            quote = text[a - 1 : a] if a else ""
            if quote in ("\n", "") or not (quote in "\"'`" and text[b : b + 1] == quote or quote in " \t=:" and text[b : b + 1] in ("", "\n", "\r", ";", " ", ",")):
                continue
            found.append((a, b, quote in "\"'`" and not series))
        new = [v for a, b, _ in found if (v := text[a:b]) not in self.ratios]
        if new:
            self.ratios |= {v: len(v) / max(1, len(ids)) for v, ids in zip(new, self.bpe.encode_batch(new))}
        return [(a, b) for a, b, single in found if self.per_subword(text[a:b]) <= self.untold and self._alone(text, a, b, single)]

    @staticmethod
    def _alone(text: str, a: int, b: int, single: bool) -> bool:
        """Whether nothing around an unnatural string tells that it is something else than a key."""
        v, before = text[a:b], text[max(text.rfind("\n", 0, a) + 1, a - 200) : a]
        name = _NAMED.search(before)
        if name is None and not single or name and (_OTHER.search(name[1]) or _ABOUT.search(name[1])):
            return False
        return not (_PLACEHOLDER.search(v) or _REFERENCE.search(v) or _PLAIN.match(v) or _WITHIN.search(before))

    def lines(self, text: str, lower: str) -> Iterator[tuple[int, int, int]]:
        """Start, end and possible rules of every line that holds a hint."""
        start = end = -1
        rules = 0
        for at, (_, more) in self.automaton.iter(lower):
            if at < end:
                rules |= more
                continue
            if end >= 0:
                yield start, end, rules
            start, end, rules = text.rfind("\n", 0, at) + 1, text.find("\n", at), more
            end = len(text) if end < 0 else end
        if end >= 0:
            yield start, end, rules

    def line(self, text: str, start: int, end: int, rules: int) -> list[tuple[int, ...]]:
        """Spans of the credentials that begin on this line, by the rules that can match."""
        out: list[tuple[int, ...]] = []
        s = text[start:end]
        may = lambda rule: rules & _BIT[id(rule)]
        comment = bool(may(_PROSE) or may(_LOGIN)) and bool(_COMMENT.search(s))
        for m in _URL.finditer(s) if may(_URL) else ():
            v = m["value"]
            if not _PLACEHOLDER.search(v) and not _REFERENCE.search(v) and len(v) > 2 and self.per_subword(v) <= self.told:
                out.append((start + m.start("value"), start + m.end("value")))
        for m in _FIXED.finditer(s) if may(_FIXED) else ():
            v = m["value"]
            if not _PLACEHOLDER.search(v) and len(set(v)) > 8 and self.per_subword(v) <= self.prefixed:
                out.append((start + m.start("value"), start + m.end("value")))
        for m in _BEARER.finditer(s) if may(_BEARER) else ():
            v = (m["value"] or m["other"]).rstrip(".")
            if self.credible(v, True):
                a = start + m.start(m.lastgroup)
                out.append((a, a + len(v)))
        for m in _CALL.finditer(s) if may(_CALL) and _CALL_PART.search(s) else ():
            out += self.arguments(text, m["name"], m["login"] is not None, start + m.end())
        counted, depth = start, 0  # parentheses open before a match
        for m in _KEYED.finditer(s) if may(_KEYED) and _KEYED_PART.search(s) else ():
            v, name = m["value"], m["name"]
            quoted = v[:1] in "\"'`"
            if _ABOUT.search(name):
                continue
            short = 4 if _SHORT.search(name) else 6
            if quoted:
                at = start + m.start("value")
                depth, counted = depth + text.count("(", counted, at) - text.count(")", counted, at), at
                out += self.joined(text, start, at, start + m.end("value"), m["open"] is not None, depth > 0, short)
            elif v.lower() in ("bearer", "basic", "token"):
                rest = re.match(r"\s+([^\s\"'`,;]+)", s[m.end() :])
                if rest and self.credible(rest[1], True):
                    out.append((start + m.end() + rest.start(1), start + m.end() + rest.end(1)))
            elif self.credible(v.rstrip(").]}"), True):
                out.append((start + m.start("value"), start + m.start("value") + len(v.rstrip(").]}"))))
        if may(_KEYED) and text[end : end + 1] == "\n" and (first := _NEXT.match(text, end)) and (m := _OPEN.search(s)) and not _ABOUT.search(m["name"]):
            at = first.start("value")
            depth += text.count("(", counted, at) - text.count(")", counted, at)
            out += self.joined(text, start, at, first.end("value"), m["open"] is not None, depth > 0, 4 if _SHORT.search(m["name"]) else 6)
        for rule in (_FLAG, _HEADER, *((_PROSE, _LOGIN) if comment else ())):
            for m in rule.finditer(s) if may(rule) else ():
                v, a = m["value"], m.start("value")
                if v[:1] in "\"'`" and len(v) > 1:
                    v, a = v[1:-1], a + 1
                if rule is _HEADER:
                    v = v.rstrip("\\")
                if self.credible(v, True):
                    out.append((start + a, start + a + len(v)))
        return out

    def joined(self, text: str, start: int, at: int, end: int, opened: bool, inside: bool, least: int) -> list[tuple[int, ...]]:
        """Start, end and start of the first part, of each part of the literal that begins here, if it is a credential.
        It goes on behind a sign or backslash, and without one in parentheses or on lines further in."""
        parts = [(at + 1, end - 1)]
        inside = opened or inside
        depth = _INDENT.match(text, start).end() - start
        while m := _MORE.match(text, end):
            if m["sign"] is None and (m["key"] or not inside and (m["break"] is None or len(m["indent"]) <= depth)) or text[m.end("value") : m.end("value") + 1] == m["value"][0]:
                break
            parts.append((m.start("value") + 1, m.end("value") - 1))
            end = m.end("value")
        whole = "".join(text[a:b] for a, b in parts)
        if whole.lower().startswith(("bearer ", "basic ", "token ")):
            cut = whole.index(" ") + 1
            whole, rest = whole[cut:], []
            for a, b in parts:
                rest.append((min(b, a + cut), b))
                cut -= min(cut, b - a)
            parts = rest
        if opened and _PLAIN.match(whole) or not self.credible(whole, False, least):
            return []
        return [(a, b, at) for a, b in parts if b > a]

    def arguments(self, text: str, name: str, login: bool, at: int) -> list[tuple[int, int]]:
        """Spans of the credentials among the plain arguments of a call, whose first starts here."""
        if _ABOUT.search(name) or _GETTER.search(name):
            return []
        literals, n = [], 0
        while m := _ARGUMENT.match(text, at):
            if m["value"]:
                literals.append((n, m.start("value") + 1, m.end("value") - 1))
            at, n = m.end(), n + 1
            if m["end"] != ",":
                break
        return [(a, b) for i, a, b in literals if (i or n == 1 or not login) and not _PLAIN.match(text[a:b]) and self.credible(text[a:b], False)]

    def __call__(self, text: str) -> list[tuple[int, list[tuple[int, int]]]]:
        """(line number, spans) of every line with a credential."""
        lower = text.lower() if text.isascii() else text.translate(_FOLD).lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(_FOLD))
        found: dict[int, list[tuple[int, int]]] = {}
        number, counted, skip = 1, 0, -1
        for start, end, rules in self.lines(text, lower):
            if end <= skip:
                continue
            number += text.count("\n", counted, start)
            counted = start
            spans: list[tuple[int, ...]] = []
            start = max(start, skip)
            for key in _PRIVATE.finditer(text, start, end) if rules & _BIT[id(_PRIVATE)] else ():
                whole, run = _BODY_SLASHED if _SLASHED.search(text, text.rfind("\n", 0, key.start()) + 1, key.start()) else _BODY
                body = whole.match(text, key.end())
                if body and key.start() >= skip:
                    first, last = body.span("body")
                    kinds = text[first : first + 64]
                    marked = not text[key.end() : first].strip(" \t\r\n\"'`+,;\\nrt") or any(c.isdigit() for c in kinds) and any(c.isupper() for c in kinds) and any(c.islower() for c in kinds)
                    if marked and len(set(text[first:last])) > 8:  # not one that is blanked out
                        found.setdefault(number, []).extend(m.span("run") for m in run.finditer(text, first, last))
                        skip = max(skip, last)
            spans += self.line(text, start, end, rules)
            for a, b, *first in spans:  # an argument, or the literal of a name, may stand on a later line
                at = first[0] if first else a
                found.setdefault(number + (text.count("\n", end, at) if at > end else 0), []).append((a, b))
                if first and b > end:
                    skip = max(skip, b + 1)
        at, number = 0, 1
        for a, b in self.untold_keys(text):
            number += text.count("\n", at, a)
            at = a
            if number not in found or all(b <= x or y <= a for x, y in found[number]):
                found.setdefault(number, []).append((a, b))
        return sorted(found.items())


_ESCAPE = re.compile(r"\\(?:(u)[0-9a-fA-F]{4}|(x)[0-9a-fA-F]{2}|.)|[^\s\\\"'`+,;]", re.S)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "X") -> str:
    """The text with these values replaced character for character; line breaks, quotes and escapes stay."""

    def put(m: re.Match) -> str:
        return f"\\u{ord(mark):04x}" if m[1] else f"\\x{ord(mark):02x}" if m[2] else m[0] if m[0][0] == "\\" else mark

    out, at = [], 0
    for a, b in sorted(spans):
        a = max(a, at)
        if b <= a:
            continue
        out += [text[at:a], _ESCAPE.sub(put, text[a:b])]
        at = b
    return "".join(out) + text[at:]


def _run(files: DataFrame, tokenizers: str, names: list[str], schema: str, make, key: str, content: str) -> DataFrame:
    path = os.path.join(tokenizers, "byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(path)
        for batch in batches:
            rows = [row for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for row in make(finder, k, t)]
            types = [batch.schema[0].type, *([pa.int64()] if "line_no" in names else [pa.int64(), pa.string()])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ty) for i, ty in enumerate(types)], names)

    return files.select(key, content).mapInArrow(run, schema)


def find_credentials(files: DataFrame, tokenizers: str = TOKENIZERS, key: str = "file_id", content: str = "content") -> DataFrame:
    kind = files.schema[key].dataType.simpleString()
    return _run(files, tokenizers, [key, "line_no"], f"`{key}` {kind}, line_no bigint", lambda f, k, t: [(k, n) for n, _ in f(t)], key, content)


def redact_credentials(files: DataFrame, tokenizers: str = TOKENIZERS, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, credentials, redacted) of every file that holds any."""
    kind = files.schema[key].dataType.simpleString()

    def make(finder, k, t):
        found = finder(t)
        return [(k, len(found), redact(t, [s for _, spans in found for s in spans]))] if found else []

    return _run(files, tokenizers, [key, "credentials", "redacted"], f"`{key}` {kind}, credentials bigint, redacted string", make, key, content)
