"""Text functions as column expressions; only NFKC needs Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 1_048_576
WORD = r"[a-zA-Z0-9_-]+|[\x{4e00}-\x{9fff}]+"
FILE = r"[a-zA-Z0-9_-]+\.[a-zA-Z0-9]+"

# Prefixes that begin a major syntactic unit.
BOUNDARIES = [
    "class ", "def ", "async def ", "@", "function ", "export ", "import ", "const ", "let ", "var ", "internal class ", "public ", "private ", "protected ", "namespace ", "using ",
    "func ", "type ", "package ", "fn ", "struct ", "enum ", "impl ", "trait ", "mod ", "use ", "pub fn ", "pub struct ", "pub enum ", "pub trait ", "pub mod ",
    "template ", "template<", "#include ", "#define ", "extern ", "static ", "inline ", "virtual ", "public:", "private:", "protected:",
]


def tokens(text: Column) -> Column:
    """Distinct tokens of more than one character: words, CJK runs, file names and their stems."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names = F.regexp_extract_all(low, F.lit(FILE), F.lit(0))
    stems = F.transform(names, lambda x: F.split_part(x, F.lit("."), F.lit(1)))
    every = F.concat(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), names, stems)
    return F.array_distinct(F.filter(every, lambda x: F.length(x) > 1))


def nonws_len(text: Column) -> Column:
    """Characters that are not Unicode white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", "")).cast("long")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def clean(text: Column, normalise: bool = True) -> Column:
    """Control characters out, compatibility forms folded, line ends and blanks tidied.

    Runs of blank lines are shortened before trailing blanks go, in this order.
    """
    t = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = nfkc(t) if normalise else t
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1; null beyond the size limit."""
    text = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n|\r", "\n"), "^﻿", "")
    return F.when(F.length(text) <= MAX_CHARS, text)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("long")


def major_boundary(text: Column) -> Column:
    """Whether the text, outer blanks aside, begins a class, function or the like."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    found = F.lit(False)
    for prefix in BOUNDARIES:
        found = found | F.startswith(bare, F.lit(prefix))
    return found
