"""Broken question and answer pairs: a multi-label linear classifier.

Training needs no labels.  From a bounded sample of ``SAMPLE_ROWS`` pairs it makes
defective ones - answers cut off at a random place, emptied, replaced by the
question in another dress, by an answer to a question of another language, or by
a refusal - and learns one logistic output per defect against the pairs as they
are.  Inputs are hashed n-grams (words and word pairs of the answer, its last
characters, and its words crossed with the language of the question) and features
of the pair (how the answer ends, how much of it only repeats the question, which
languages both are in, whether it bars the speaker from something).  One half of the sample trains,
the other half sets each output's threshold where its F1 is best.  The outputs
decide, but for emptiness, which is exact.  The refusal output also trains on
refusals whose words are hidden.

Edge cases: a null answer counts as empty; a null question has no words, so only
emptiness, refusal and truncation can show; every row gets at most one defect,
the output that exceeds its threshold most; repeated rows give one result; with
few or no usable pairs, built-in ones take their place in training; a model
trained on a table without rows flags nothing.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1_600
HASHED = 1 << 12
DEFECTS = ["empty", "truncated", "refusal", "copy", "language"]

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TICKS = re.compile(r"`[^`\n]*`")
_CODE = re.compile(r"https?://\S+|\b[\w.-]*(?:/[\w.-]+)+|\b\w+[_.]\w[\w.]*|\b[a-z]+[A-Z]\w*|\b(?:[A-Z][a-z]+){2,}\w*")
_TAGS = re.compile(r"<[^<>]{0,40}>|&nbsp;|&#\d+;")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=\S)|\n+")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」")

#: Function words that tell the language of Latin-script prose.
STOP = {
    "en": "no the is are was were be been of and to in that it for with as by on this which who what where when why how does do did not can you your have has from or if then than there its an at all each only because after before called look see yes work me show explain i".split(),
    "de": "der die das den dem des ein eine einen einem einer ist sind war und oder nicht mit von zu auf für im in aus bei wie was wo wer wird werden kann man sich es er sie wenn dass als nach vor über durch nur sobald solange ja was warum welche welcher welches mir zugleich etwa dabei".split(),
    "es": "el la los las un una unos unas es son de del que y o no con por para en se lo al como qué cuál dónde quién cuándo cuando si su sus más pero esta este ese eso cada sólo solo sí puede puedes tras cerca también le cómo ya".split(),
    "fr": "le la les un une des du de est sont et ou ne pas avec par pour dans sur en se ce cette ces que qui quoi où quand comment si son sa ses plus mais chaque seul oui peut peux elle il on au aux est-ce quelle quel lors vers si à d l s n qu".split(),
}
#: Names of the languages, as a question may ask for one.
NAMES = {
    "en": r"english|englisch\w*|ingl[eé]s|anglais\w*|英语|英文",
    "de": r"german|deutsch\w*|alem[aá]n|allemand\w*|德语|德文",
    "es": r"spanish|spanisch\w*|español|espagnol\w*|西班牙语|西班牙文",
    "fr": r"french|franz[oö]sisch\w*|franc[eé]s|français\w*|法语|法文",
    "zh": r"chinese|mandarin|chinesisch\w*|chino|chinois\w*|中文|汉语|普通话",
}
_NAMES = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)" if k != "zh" else v, re.I) for k, v in NAMES.items()}
#: Wording of declining, per language: answers so worded are no examples of answers that do not decline.
DECLINE = re.compile(
    r"(?:\b(?:can ?not|can't|could not|am not able to|'m not able to|am unable to|not something i can|have to decline|must decline|would rather not|won't|will not|not allowed to|not permitted to|outside of what i am allowed|refuse to)\b[^.!?\n]{0,60}?(?:\b(?:help|assist|answer|discuss|go into|respond|comply|provide|share|support|decline|do|with|allowed)\b|$))|(?:\bi (?:have to|must) (?:decline|refuse)|i am not able to answer|i would rather not|outside of what i am allowed)"
    r"|(?:\bkann (?:ich )?(?:\w+ ){0,3}nicht (?:helfen|beantworten|antworten)|nicht helfen|keine auskunft|muss ich ablehnen|ich muss (?:\w+ ){0,3}ablehnen|darf ich (?:\w+ ){0,3}nicht|darf nicht|möchte (?:ich )?(?:\w+ ){0,3}nicht|lehne ich ab|nicht beantworten)"
    r"|(?:\bno puedo (?:\w+ ){0,3}(?:ayudar|responder|contestar)|no me está permitido|no estoy autorizad|prefiero no|debo rechazar|tengo que rechazar|no me es posible|no soy capaz de)"
    r"|(?:\bne (?:peux|puis) pas|je préfère ne pas|je dois (?:refuser|décliner)|pas autorisé|pas en mesure|m'est pas (?:permis|possible)|je refuse)"
    r"|(?:无法(?:协助|帮助|回答|提供|处理|满足)|不能(?:协助|帮助|回答|提供|处理|讨论)|不便回答|必须拒绝|拒绝这个|不被允许|不允许(?:我)?回答|无权回答|不愿|恕我)",
    re.I,
)
_COURTESY = re.compile(r"(?:sorry|unfortunately|thank|i understand|please ask|anything else|something else|leider|entschuldig|tut mir leid|bitte (?:stelle|stellen|fragen)|danke|lo siento|lamentablemente|por favor|haz otra|gracias|désolé|malheureusement|merci|autre question|抱歉|对不起|不好意思|换一个|其他问题|谢谢|请)", re.I)
#: What declining is about, in any wording: the speaker, a negation or a bar, speaking or helping, leave or duty.
SIGNS = [
    re.compile(r"(?<!\w)(?:i|i'm|i'll|i've|me|my|ich|mir|mich|mein\w*|je|j'|m'|moi|mon|ma|mes|yo|mi|mis|conmigo)(?!\w)|(?<!\w)[jm]'|(?<!\w)(?:puedo|debo|tengo|estoy|soy|prefiero|temo|lamento)(?!\w)|[我本]", re.I),
    re.compile(r"(?<!\w)(?:no|not|never|nothing|cannot|neither|unable|against|beyond|outside|away|decline\w*|refus\w*|forbid\w*|prohibit\w*|prevent\w*|nicht|nichts|nie|kein\w*|unters\w+|verb[ioe]\w+|verweiger\w*|ablehn\w*|nunca|nada|ning\w+|fuera|imp[ie]d\w*|proh[ií]b\w*|rechaz\w*|neg\w+|ne|pas|jamais|rien|aucun\w*|interdi\w*|emp[êe]ch\w*|hors)(?!\w)|n't(?!\w)|(?<!\w)n'|[不无没未非拒禁]|超出|沉默", re.I),
    re.compile(r"(?<!\w)(?:answer\w*|help\w*|assist\w*|say\w*|speak\w*|talk\w*|tell\w*|discuss\w*|comment\w*|respond\w*|provid\w*|shar\w+|disclos\w*|topic\w*|request\w*|antwort\w*|beantwort\w*|helf\w*|sag\w*|sprech\w*|äußer\w*|auskunft|auskünfte|thema|anfrage|respond\w*|respuesta|contest\w*|habl\w*|ayud\w*|decir|tema|coment\w*|petici[oó]n|répon\w*|parl\w*|aid\w*|dire|sujet|demande)(?!\w)|[说答谈帮]|提供|讨论|透露|问题|话题", re.I),
    re.compile(r"(?<!\w)(?:can|could|may|able|allow\w*|permi\w*|polic\w*|guideline\w*|instruct\w*|supposed|authori[sz]\w*|right|willing|kann|könn\w*|darf|dürf\w*|richtlinie\w*|vorgabe\w*|befugt|zuständig|erlaub\w*|gestattet|pued\w*|deb\w+|norma\w*|pol[ií]tica\w*|directric\w*|autoriz\w*|alcance|peux|puis|peut|droit|consigne\w*|règle\w*|autoris\w*|fonctions?)(?!\w)|[能可权]|规定|政策|职责|允许|范围", re.I),
]
#: Parts of the refusals made for training.
REFUSALS = {
    "en": (["I am sorry, but ", "Sorry - ", "Unfortunately ", "Thank you for asking, however ", "I understand the interest, but ", "", "As an assistant, "], ["I cannot help with this request", "I am not able to answer this question", "I have to decline", "I can't assist with that", "I would rather not go into that", "this is not something I can assist with", "I am unable to provide this information", "answering this is outside of what I am allowed to do", "I won't answer that"], [".", ". Please ask something else.", ". Is there anything else you would like to know?", " as an assistant."]),
    "de": (["Es tut mir leid, aber ", "Leider ", "Entschuldigung, ", ""], ["dabei kann ich nicht helfen", "darauf darf ich nicht antworten", "diese Anfrage muss ich ablehnen", "dazu kann ich keine Auskunft geben", "darüber möchte ich nicht sprechen"], [".", ". Bitte stelle eine andere Frage."]),
    "es": (["Lo siento, pero ", "Lamentablemente ", "Disculpa, ", ""], ["no puedo ayudar con esta petición", "no me está permitido responder a eso", "debo rechazar esta solicitud", "prefiero no hablar de ello", "no puedo responder a ese tipo de preguntas"], [".", ". Haz otra pregunta, por favor."]),
    "fr": (["Je suis désolé, mais ", "Malheureusement ", "Pardon, ", ""], ["je ne peux pas vous aider", "je ne peux pas répondre à cette question", "je dois refuser cette demande", "je préfère ne pas en parler", "je ne suis pas autorisé à répondre"], [".", ". Merci de poser une autre question."]),
    "zh": (["很抱歉，", "抱歉，", "不好意思，", ""], ["我无法协助处理这个请求", "我不能回答这类问题", "我必须拒绝这个要求", "这个问题我不便回答"], ["。", "。请换一个问题。"]),
}
#: Questions and answers that stand in where a table has fewer than FILL usable pairs; {n} is a name, {k} a number.
FILL = 200
BUILT_IN = {
    "en": (["What does {n} do?", "Where is {n} defined and who calls it?", "Is {n} safe to call from several threads?", "Why does {n} return an empty list?", "What is the default limit used by {n}?"], ["It walks every entry and keeps only those that the filter lets pass.", "The default limit of {k} applies unless the caller passes another value.", "`{n}` is defined in `src/{n}.py`, around line {k}.\n\n```python\n{n}(limit={k})\n```", "Yes, but each worker must open its own session first.", "{k}", "No.", "When that step fails, the error is logged and the next file is read.\n\n- `{n}`\n- `load_file`"]),
    "de": (["Was macht {n}?", "Wo ist {n} definiert und wer ruft es auf?", "Kann man {n} aus mehreren Prozessen aufrufen?", "Warum gibt {n} eine leere Liste zurück?"], ["Die Funktion geht alle Einträge durch und behält nur die, die der Filter durchlässt.", "Der Vorgabewert von {k} gilt, wenn der Aufrufer keinen anderen Wert übergibt.", "Sie steht in `src/{n}.py` und wird nach dem Lesen der Datei aufgerufen.", "Ja.", "Tritt dabei ein Fehler auf, wird er ins Protokoll geschrieben und die nächste Datei gelesen."]),
    "es": (["¿Qué hace {n}?", "¿Dónde se define {n} y quién lo llama?", "¿Se puede llamar a {n} desde varios procesos?", "¿Por qué devuelve {n} una lista vacía?"], ["La función recorre todas las entradas y conserva sólo las que el filtro deja pasar.", "El límite por defecto de {k} se aplica si no se pasa otro valor.", "Se define en `src/{n}.py` y se llama después de leer el archivo.", "Sí.", "Si hay un error en ese paso, se registra y se sigue con el archivo siguiente."]),
    "fr": (["Que fait {n} ?", "Où est défini {n} et qui l'appelle ?", "Peut-on appeler {n} depuis plusieurs processus ?", "Pourquoi {n} renvoie-t-il une liste vide ?"], ["La fonction parcourt toutes les entrées et garde celles que le filtre laisse passer.", "La limite par défaut de {k} s'applique si l'appelant ne donne pas d'autre valeur.", "Elle est définie dans `src/{n}.py` et appelée après la lecture du fichier.", "Oui.", "Quand une erreur survient à cette étape, elle est notée dans le journal et le fichier suivant est lu."]),
    "zh": (["{n} 是做什么的？", "{n} 在哪里定义，由谁调用？", "可以同时从多个进程调用 {n} 吗？", "为什么 {n} 返回空列表？"], ["这个函数会遍历所有条目，只保留通过过滤器的条目。", "除非调用者传入其他值，否则默认上限是 {k}。", "它在 `src/{n}.py` 中定义，读取文件之后被调用。", "可以。", "如果这一步出错，错误会写入日志，然后继续读取下一个文件。"]),
}
EMPTIES = ["", " ", "\n\n", "\t", "...", "…", "-", "​", "\xa0 ", "<p></p>", "```\n```", '""', "<br/>", "**", "。", "﻿", "- ", "> "]
_LISTING = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")


def bare(text: str) -> str:
    """Letters and digits only, folded."""
    return "".join(_WORD.findall(unicodedata.normalize("NFKC", text).casefold()))


class Kept(dict):
    """Results by word, worked out once; forgotten when there are too many."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        out = self.make(word)
        if len(word) < 40:
            if len(self) > 1 << 18:
                self.clear()
            self[word] = out
        return out


#: What is left of a piece without blanks if code is taken out.
_PLAIN = Kept(lambda piece: _CODE.sub(" ", piece))


def prose(text: str) -> str:
    if "```" in text:
        text = _FENCE.sub(" ", text)
    if "`" in text:
        text = _TICKS.sub(" ", text)
    return " ".join(map(_PLAIN.__getitem__, text.split(" ")))


_STOP = {"en": (set(STOP["en"]), ""), "de": (set(STOP["de"]), "äöüß"), "es": (set(STOP["es"]), "ñ¿¡óíá"), "fr": (set(STOP["fr"]), "èêçàùœ")}
_LANGUAGES = [*_STOP, "zh"]
_LETTERS, _HAN = re.compile(r"[^\W\d_]+"), re.compile(r"[一-鿿]")


#: For a lower-case word the languages it tells of, as (number, weight).
_TELLS = Kept(lambda w: tuple((i, n) for i, (words, letters) in enumerate(_STOP.values()) if (n := (w in words) + (0 if w.isascii() else 1.5 * sum(c in letters for c in w)))))


def spoken(text: str, words: list[str]) -> tuple[str | None, float]:
    """The language of prose and how sure that is (0 to 1), by its lower-case words."""
    hits = [0.0] * 5
    for w in words:
        for i, n in _TELLS[w]:
            hits[i] += n
    if not text.isascii():
        hits[4] = len(_HAN.findall(text)) / 1.5
    n = max(hits)
    if n < 1:
        return None, 0.0
    best = hits.index(n)
    hits[best] = -1.0
    second = max(hits)
    return _LANGUAGES[best], (n - second) / (n + second + 0.5)


def language(text: str) -> tuple[str | None, float]:
    """The language of the prose and how sure that is (0 to 1)."""
    text = prose(text)
    return spoken(text, _LETTERS.findall(text.lower()))


def ending(answer: str) -> tuple[float, ...]:
    """How the answer ends: open fence, open row, open mark, open sentence, dangling mark, closed."""
    text = answer.rstrip()
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return (0.0,) * 6
    last = lines[-1].strip()
    fence = text.count("```") % 2
    row = float(not fence and last.startswith("|") and (not last.endswith("|") or len(last) < 2))
    table = [x.strip() for x in lines if x.strip().startswith("|")]
    if not fence and last.startswith("|") and not row and len({x.count("|") for x in table}) > 1:
        row = 1.0
    if not fence and last.startswith("|") and not row and len(table) < 3:
        row = 1.0  # a head without rows
    outside = _FENCE.sub("", text)
    mark = float(not fence and (outside.count("`") % 2 == 1 or bool(_LISTING.match(last + " ")) and len(last.split()) < 2))
    if not fence and not mark and last.rfind("(") > last.rfind(")") and not last.startswith("|"):
        mark = 0.5
    tail = re.sub(r"[\s\"'”’»)\]*_`」）\U0001F000-\U0001FAFF☀-➿️‍]+$", "", last)
    done = bool(re.search(r"[.!?。！？…؟]$", tail)) or bool(re.search(r"[.!?。！？]\s*\([^()]*\)$", last))
    arrow = bool(re.search(r"[.!?。！？]\s*(?:→|->|=>|:|–|—)?\s*`[^`]+`$", last)) or bool(re.fullmatch(r"`[^`]+`", text))
    value = len(lines) == 1 and len(text.split()) == 1 and not re.search(r"[一-鿿]{6}|[,;:，；：]$", text)
    closed = not (mark or fence or row) and (done or arrow or value or last.startswith((">", "#")) or bool(re.match(r"(?:https?://|www\.)\S+$", last)) or (last.endswith("```") and not fence) or (last.startswith("|") and not row) or (bool(_LISTING.match(last)) and not mark and len(last.split()) >= 2))
    dangling = float(bool(re.search(r"[,;:，；：、(（\[{\-–]$", last)) and not last.startswith("|"))
    return float(fence), row, mark, float(not closed and not fence and not row), dangling, float(closed)


_UNIT = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_NUMBER = re.compile(r"\d")


def signs(answer: str, text: str) -> tuple[float, ...]:
    """Whether a sentence bars the speaker from something, says from what, or is sorry for it; whether the answer lacks substance."""
    if len(answer) > 300 or _NUMBER.search(answer) or "```" in answer or len(text) < len(answer) or text != answer.replace("’", "'") or len(_UNIT.findall(answer)) < 2:
        return 0.0, 0.0, 0.0, 0.0
    parts = [x for x in _SENTENCE.split(_QUOTED.sub(" ", text)) if _WORD.search(x)]
    if not parts:
        return 0.0, 0.0, 0.0, 0.0
    found = [[True, True, *(bool(r.search(x)) for r in SIGNS[2:])] if SIGNS[1].search(x) and SIGNS[0].search(x) else None for x in parts]
    own = [sum(f) for f in found if f]
    sorry = bool(_COURTESY.search(text)) and any(SIGNS[1].search(x) for x in parts)
    return float(bool(own)), float(any(n >= 3 for n in own)), float(sorry), 1.0


def _slot_of(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % HASHED


_SLOT = Kept(_slot_of)
_TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+|\d|[^\w\s]")
#: Numbers of the pair features below, and of those that tell of refusals.
NUMBERS, ANY_WORDING = 25, slice(19, 23)


def features(question: str | None, answer: str | None) -> tuple[list[float], list[int]]:
    """Features of the pair, and the slots of its n-grams."""
    q, a = question or "", answer or ""
    low = a.casefold()
    tokens = _TOKEN.findall(low)
    plain = prose(a).replace("’", "'")
    words = _LETTERS.findall(plain.lower())
    q_low = q.casefold()
    q_words = _WORD.findall(q_low)
    a_words = _WORD.findall(_TAGS.sub("", low) if "<" in low or "&" in low else low)
    visible, qb = "".join(a_words), "".join(q_words)
    if not (a.isascii() and q.isascii()):
        visible, qb = bare(visible), bare(qb)
    rest = visible.replace(qb, "") if len(qb) > 5 else visible
    known = set(q_words)
    cover = sum(w in known for w in a_words) / len(a_words) if a_words else 0.0
    ql, qs = spoken(q, _LETTERS.findall(prose(q_low)))
    al, as_ = spoken(plain, words)
    other = ql is not None and al is not None and ql != al
    asked = other and bool(_NAMES[al].search(q))
    empty = not visible
    repeats = len(qb) > 5 and qb in visible and len(rest) <= 0.1 * len(qb) + 1
    sure = min(qs, as_) if other and not asked else 0.0
    numbers = [
        empty, repeats, cover, cover > 0.9, min(len(rest), 300) / 300,
        sure, sure > 0.3, asked, qs, as_,
        min(len(plain.strip()), 200) / 200,
        *((0.0,) * 6 if empty else ending(a)), min(len(a), 500) / 500, "```" in a, *signs(a, plain), al is None, al is not None and al == ql,
    ]
    slot = _SLOT
    slots = {slot[w] for w in tokens}
    slots.update(slot[f"{x} {y}"] for x, y in zip(tokens, tokens[1:]))
    tail = low.rstrip()[-8:]
    slots.update(slot["$" + tail[i:]] for i in range(len(tail)))
    slots.update(slot[f"{ql}>{w}"] for w in set(words))
    return numbers, [*slots]


def matrix(pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
    """A row of inputs for each pair."""
    x = np.zeros((len(pairs), NUMBERS + HASHED + 1), np.float32)
    for row, (q, a) in zip(x, pairs):
        numbers, slots = features(q, a)
        row[:NUMBERS] = numbers
        if slots:
            row[NUMBERS + np.array(slots)] = GRAMS / len(slots) ** 0.5
    x[:, :NUMBERS] *= 4
    x[:, -1] = 1
    return x


#: Weight of all n-grams of an answer together.
GRAMS = 0.6


def spoiled(rows: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[str | None, str | None, int]]:
    """Defective pairs made of good ones: (question, answer, defect)."""
    out: list[tuple[str | None, str | None, int]] = []
    langs = [language(q)[0] for q, _ in rows]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    for i, (q, a) in enumerate(rows):
        out.append((q, pick([None, *EMPTIES]), 0))
        if len(a) > 30:
            for _ in range(8):
                cut = a[: int(rng.integers(8, len(a) - 2))]
                if not ending(cut)[5] and len(cut.split()) > 1:
                    out.append((q, cut, 1))
                    break
        lang = langs[i] if rng.random() < 0.9 and langs[i] else pick(list(REFUSALS))
        out.append((q, "".join(pick(p) for p in REFUSALS[lang]), 2))
        s = q.strip()
        mute = s.rstrip("?？ ")
        out.append((q, pick([s, s.upper(), s.lower(), f'"{s}"', mute + ".", f"Q: {s}", f"> {s}\n", mute, mute.upper(), f"{s}\n{s}"]), 3))
        other = rows[int(rng.integers(len(rows)))][1]
        spoken_ = language(other)[0]  # a bare value has none
        if langs[i] and spoken_ and langs[i] != spoken_ and not _NAMES[spoken_].search(q):
            out.append((q, other, 4))
    return out


#: How a question asks for an answer in a language.
ASKING = {
    "en": ["Answer in English.", "auf Englisch", "en inglés", "en anglais", "请用英语回答"], "de": ["Answer in German.", "auf Deutsch", "en alemán", "en allemand", "请用德语回答"],
    "es": ["Answer in Spanish.", "auf Spanisch", "en español", "en espagnol", "请用西班牙语回答"], "fr": ["Answer in French.", "auf Französisch", "en francés", "en français", "请用法语回答"],
    "zh": ["Answer in Chinese.", "auf Chinesisch", "en chino", "en chinois", "请用中文回答"],
}


def asking(rows: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[str, str]]:
    """Good pairs whose question asks for the language of the answer."""
    out = []
    for q, _ in rows[::4]:
        answer = rows[int(rng.integers(len(rows)))][1]
        if spoken_ := language(answer)[0]:
            out.append((f"{q} {ASKING[spoken_][int(rng.integers(5))]}", answer))
    return out


def built_in() -> list[tuple[str, str]]:
    """FILL pairs of the built-in questions and answers, the same ones always."""
    out = []
    for i in range(FILL):
        questions, answers = list(BUILT_IN.values())[i % len(BUILT_IN)]
        n, k = ["load_x", "trimSession", "rank_entry", "mergeDigest", "FileReader"][i // 3 % 5], 7 + 13 * i
        q, a = questions[i // len(BUILT_IN) % len(questions)], answers[i // len(BUILT_IN) % len(answers)]
        out.append((q.format(n=n, k=k), a.format(n=n, k=k)))
    return out


class Classifier:
    def __init__(self, rows: list[tuple[str, str]], rounds: int = 60, ridge: float = 1e-4):
        self.ready = True
        rng = np.random.default_rng(11)
        rows = [(q, a) for q, a in rows if q and a]
        if len(rows) < FILL:
            rows = sorted(rows + built_in()[len(rows) :], key=lambda r: zlib.crc32("\n".join(r).encode("utf-8", "replace")))
        half = len(rows) // 2
        (gx, bx, by, more), (hgx, hbx, hby, hmore) = (self._examples(part, rng) for part in (rows[:half], rows[half:]))
        # pairs as they are hold some defects: what a first fit finds is left out of the second
        w = self._weights(gx, bx, by, more, rounds // 2, ridge)
        gx, hgx = gx[self._p(gx, w).max(1) < 0.5], hgx[self._p(hgx, w).max(1) < 0.5]
        self.weights = w = self._weights(gx, bx, by, more, rounds, ridge)
        p, y = self._p(np.concatenate([hgx, hbx]), w), np.concatenate([np.zeros((len(hgx), len(DEFECTS)), np.float32), hby])
        self.thresholds = np.array([self._threshold(p[:, d], y[:, d]) for d in range(len(DEFECTS))])
        self.thresholds[2] = self._threshold(np.concatenate([p[:, 2], self._p(hmore[0], w)[:, 2]]), np.concatenate([y[:, 2], hmore[1]]))

    @classmethod
    def _weights(cls, good: np.ndarray, bad: np.ndarray, y: np.ndarray, more: tuple[np.ndarray, np.ndarray], rounds: int, ridge: float) -> np.ndarray:
        """One column per defect; what tells of refusals in any wording counts for that defect only."""
        x, y = np.concatenate([good, bad]), np.concatenate([np.zeros((len(good), len(DEFECTS)), np.float32), y])
        refusal = cls._fit(np.concatenate([x, more[0]]), np.concatenate([y[:, 2], more[1]])[:, None], rounds, ridge)
        x[:, ANY_WORDING] = 0
        w = cls._fit(x, y, rounds, ridge)
        w[ANY_WORDING] = 0
        w[:, 2:3] = refusal
        return w

    @classmethod
    def _examples(cls, rows: list[tuple[str, str]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        bad = spoiled(rows, rng)
        y = np.zeros((len(bad), len(DEFECTS)), np.float32)
        y[np.arange(len(bad)), [d for *_, d in bad]] = 1
        x = matrix([(q, a) for q, a, _ in bad])
        return matrix(rows + asking(rows, rng)), x, y, cls._more(rows, x[y[:, 2] > 0])

    @staticmethod
    def _more(rows: list[tuple[str, str]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Further examples for the refusal output: refusals of which no word is known, answers
        that begin as a refusal does but go on, and answers of which no word is known."""
        words = slice(NUMBERS, -1)
        new = x[::2].copy()
        new[:, words] = 0
        going = [(q, REFUSALS[language(a)[0] or "en"][0][0] + a) for q, a in rows[::4]]
        plain = [(q, a) for q, a in rows if not DECLINE.search(a)]
        other = matrix(going + plain)
        other[len(going) :, words] = 0
        return np.concatenate([new, other]), np.repeat(np.float32([1, 0]), [len(new), len(other)])

    @staticmethod
    def _p(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, rounds: int, ridge: float, memory: int = 8) -> np.ndarray:
        """Logistic weights by the quasi-Newton method of limited memory."""
        shape = (x.shape[1], y.shape[1])

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = x @ w.reshape(shape)
            value = np.logaddexp(0, z).sum() - (z * y).sum()
            gradient = x.T @ (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            return float(value) / len(x) + ridge / 2 * float(w @ w), (gradient / len(x)).ravel() + ridge * w

        w = np.zeros(shape[0] * shape[1], np.float32)
        value, g = loss(w)
        kept: list[tuple[np.ndarray, np.ndarray, float]] = []
        for _ in range(rounds):
            d, alphas = g.copy(), []
            for s, t, r in reversed(kept):
                alphas.append(r * float(s @ d))
                d -= alphas[-1] * t
            if kept:
                s, t, _ = kept[-1]
                d *= float(s @ t) / float(t @ t)
            for (s, t, r), al in zip(kept, reversed(alphas)):
                d += (al - r * float(t @ d)) * s
            step, slope = 1.0, float(g @ d)
            while True:
                new, new_g = loss(w - step * d)
                if new <= value - 1e-4 * step * slope or step < 1e-4:
                    break
                step /= 2
            s, t = -step * d, new_g - g
            if float(s @ t) > 1e-10:
                kept = [*kept, (s, t, 1 / float(s @ t))][-memory:]
            done = value - new < 1e-7
            w, value, g = w + s, new, new_g
            if done:
                break
        return w.reshape(shape).astype(np.float32)

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        steps = np.arange(0.1, 0.96, 0.025)
        hit = np.array([((p > t) & (y > 0)).sum() for t in steps])
        f1 = 2 * hit / np.maximum(1, np.array([(p > t).sum() for t in steps]) + y.sum())
        best = np.flatnonzero(f1 >= f1.max() - 0.002)
        return float(steps[best[len(best) // 2]])

    def __call__(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        if not pairs or not self.ready:
            return [None] * len(pairs)
        found = [features(q, a) for q, a in pairs]
        numbers = np.array([n for n, _ in found], np.float32)
        sizes = np.array([len(s) for _, s in found])
        grams = self.weights[NUMBERS + np.array([i for _, s in found for i in s], np.int64)]
        sums = np.zeros((len(pairs), len(DEFECTS)), np.float32)
        some = sizes > 0  # an empty answer has no n-grams
        sums[some] = np.add.reduceat(grams, (np.cumsum(sizes) - sizes)[some]) if some.any() else 0
        z = 4 * numbers @ self.weights[:NUMBERS] + sums * (GRAMS / np.sqrt(np.maximum(1, sizes)))[:, None] + self.weights[-1]
        over = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.thresholds) / (1 - self.thresholds)
        best = over.argmax(1)
        # emptiness is exact
        return ["empty" if numbers[i, 0] else DEFECTS[b] if b and over[i, b] > 0 else None for i, b in enumerate(best)]


def train(pairs: DataFrame, key: str = "id", question: str = "question", answer: str = "answer", limit: int = SAMPLE_ROWS) -> Classifier:
    """From a sample by the hash of the key, of at most ``limit`` pairs; built-in ones fill it up to FILL."""
    some = pairs.where(F.col(question).isNotNull() & (F.length(F.trim(answer)) > 1)).select(key, question, answer)
    rows = some.orderBy(F.xxhash64(key), key).limit(limit).collect()
    model = Classifier(list({r[0]: (r[1], r[2]) for r in rows}.values()))
    model.ready = bool(rows or pairs.limit(1).count())
    return model


def broken_pairs(pairs: DataFrame, model: Classifier, key: str = "id", question: str = "question", answer: str = "answer") -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                k, q, a = (batch.column(i).slice(at, 2000).to_pylist() for i in range(3))
                found = [(i, d) for i, d in zip(k, shared.value(list(zip(q, a)))) if d]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.schema[0].type), pa.array([f[1] for f in found], pa.string())], [key, "defect"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, question, answer).mapInArrow(run, f"`{key}` {kind}, defect string")
