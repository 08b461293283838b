"""Text canonicalisation. Three folds differ on purpose: for titles, for rules and for search."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters without a decomposition.
PLAIN = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "ħ": "h"}
_PLAIN = str.maketrans(PLAIN | {k.upper(): v.upper() for k, v in PLAIN.items() if len(k.upper()) == 1})
_BRACKETED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）|【[^【】]*】|〔[^〔〕]*〕")


def fold_latin(text: str) -> str:
    """Drops marks after Latin letters only, so that kana keep theirs; compatibility forms become plain ones."""
    out, latin = [], False
    for c in unicodedata.normalize("NFKD", text):
        if unicodedata.combining(c):
            if latin:
                continue
        else:
            latin = "LATIN" in unicodedata.name(c, "")
        out.append(c)
    return unicodedata.normalize("NFKC", "".join(out)).translate(_PLAIN)


def title_key(text: str) -> str:
    """Folded, lower-cased, without bracketed notes and separators."""
    s, before = fold_latin(text).lower(), None
    while s != before:
        before, s = s, _BRACKETED.sub(" ", s)
    return exact_key(s) or exact_key(text)


def exact_key(text: str) -> str:
    """Folded, lower-cased, without spaces, punctuation and symbols."""
    return "".join(c for c in fold_latin(text).lower() if unicodedata.category(c)[0] not in "ZPSC")


def letter_key(text: str) -> str:
    """Letters and digits alone, without any marks, each lower-cased by itself; notes in brackets and letters that have no
    decomposition stay, but for ß."""
    s = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")
    s = "".join(c.lower() for c in unicodedata.normalize("NFC", s).replace("ß", "ss"))
    return "".join(c for c in s if unicodedata.category(c)[0] in "LN")


def rule_key(text: str) -> str:
    """Without zero-width characters and any combining mark, case-folded, other than letters and digits one space."""
    s = "".join(c for c in text if unicodedata.category(c) != "Cf").lower().translate(_PLAIN)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return " ".join(re.findall(r"[^\W_]+", s))


def search_key(text: str) -> str:
    return re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", text)).lower()


def natural_key(text: str) -> str:
    """Digit runs padded, so that 2 comes before 10."""
    return re.sub(r"\d+", lambda m: m.group().lstrip("0").rjust(20, "0"), text)


def slug(text: str) -> str:
    s = unicodedata.normalize("NFKD", fold_latin(text)).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", s).strip("-")


def _vectorised(f):
    @F.pandas_udf(StringType())
    def run(xs: pd.Series) -> pd.Series:
        known = {x: f(x) for x in xs.dropna().unique()}
        return pd.Series([known.get(x) for x in xs], dtype=object)

    return run


FOLDS = {f.__name__: f for f in (fold_latin, title_key, exact_key, letter_key, rule_key, search_key, natural_key, slug)}


def folded(name: str, column: Column | str) -> Column:
    """One of FOLDS over a column (null stays null), in Arrow batches."""
    return _vectorised(FOLDS[name])(column)


def decode(data: bytes) -> str:
    """Byte order mark, zero pattern, UTF-8, Shift_JIS where kana come out, else GB18030 or Big5."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    if len(data) >= 4 and b"\0" in data:
        even, odd = data[::2].count(0), data[1::2].count(0)
        return data.decode("utf-16-le" if odd >= even else "utf-16-be", "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    for name in ("cp932", "gb18030", "big5"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if name != "cp932" or re.search("[぀-ヿ]", text):
            return text
    return data.decode("latin-1")


def legacy_text(data: bytes) -> str:
    """Text of an old 8-bit field: UTF-8, else Shift_JIS, where they decode without an error, else Latin-1."""
    for name in ("utf-8", "cp932"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


#: Code pages of archive names, in order, and what the characters that come out speak for.
CODE_PAGES = ("utf-8", "cp932", "gbk", "big5", "cp949")
WEIGHTS = (
    (-6, ((0x00, 0x1F), (0x7F, 0x7F), (0xE000, 0xF8FF), (0xFFFD, 0xFFFD))),
    (0, ((0x20, 0x7E), (0xC0, 0x24F))),
    (3, ((0x3040, 0x30FF),)),
    (-4, ((0xFF61, 0xFF9F),)),
    (1, ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x3000, 0x303F), (0xFF01, 0xFF5E))),
)


def plausible(text: str) -> int:
    """How much a decoded name looks like text; characters of no listed range count -2."""
    return sum(next((w for w, ranges in WEIGHTS if any(a <= ord(c) <= b for a, b in ranges)), -2) for c in text)


def code_page(names: list[bytes]) -> str | None:
    """The code page under which an archive's names are the most plausible; null where all are ASCII."""
    data = b"".join(n for n in names if not n.isascii())
    if not data:
        return None
    scores = {}
    for name in CODE_PAGES:
        try:
            scores[name] = plausible("".join(n.decode(name) for n in names if not n.isascii()))
        except UnicodeDecodeError:
            continue
    return max(scores, key=scores.__getitem__) if scores else "cp932"


def read_bytes(name: str, column: Column | str) -> Column:
    """decode or legacy_text over a binary column, in Arrow batches."""
    f = {"decode": decode, "legacy_text": legacy_text}[name]

    @F.pandas_udf(StringType())
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else f(bytes(x)))

    return run(column)


def page_of(column: Column | str) -> Column:
    """code_page of an array of binary names."""

    @F.pandas_udf(StringType())
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda names: None if names is None else code_page([bytes(n) for n in names]))

    return run(column)
