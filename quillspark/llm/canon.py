"""One consistent form for values that look the same (problem 2).

All in SQL expressions: zero-width characters are removed, wide and compatibility spaces become a
space, full-width forms and ligatures their plain letters, and look-alike letters of the Latin,
Cyrillic and Greek scripts one prototype each (letter by letter, accents kept). The values are then
grouped under the accent- and case-sensitive collation UNICODE, in which composed and combining
accents are equal. The canonical member of a class is the preferred spelling in it (the smallest of
those marked as reference), else the most frequent spelling, ties to the smallest; it is joined back.

Values that look different stay different: letter case, superscripts and subscripts, other accents.

Defined results: null stays null and is in no class; an empty value or one of nothing but invisible
characters has the empty form. Repeated rows share their class; texts may have any length.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters drawn the same, each group under its Latin prototype.
LOOK_ALIKE = {
    "a": "\u0430\u03b1", "c": "\u0441\u03f2", "d": "\u0501", "e": "\u0435", "g": "\u0261", "h": "\u04bb", "i": "\u0456\u03b9", "j": "\u0458\u03f3",
    "l": "\u04cf", "o": "\u043e\u03bf\u0585", "p": "\u0440\u03c1", "q": "\u051b", "s": "\u0455", "u": "\u057d", "v": "\u03bd\u0475", "w": "\u051d",
    "x": "\u0445\u03c7", "y": "\u0443", "A": "\u0410\u0391", "B": "\u0412\u0392", "C": "\u0421\u03f9", "E": "\u0415\u0395", "G": "\u050c", "H": "\u041d\u0397",
    "I": "\u0406\u0399\u04c0", "J": "\u0408\u037f", "K": "\u041a\u039a\u212a", "M": "\u041c\u039c", "N": "\u039d", "O": "\u041e\u039f\u0555",
    "P": "\u0420\u03a1", "Q": "\u051a", "S": "\u0405", "T": "\u0422\u03a4", "V": "\u0474", "W": "\u051c", "X": "\u0425\u03a7", "Y": "\u04ae\u03a5", "Z": "\u0396",
}
#: Hyphens, apostrophes and middle dots drawn the same.
MARKS = {"-": "\u2010\u2011\ufe63", "'": "\u2019\u2018\u02bc\u02b9\u2032", "\u00b7": "\u2027\u30fb"}
#: Characters that no reader sees, besides all of Unicode category Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164" + "".join(map(chr, range(0xFE00, 0xFE10)))


def invisible_class() -> str:
    """The character class of INVISIBLE and category Cf."""
    return "[\\p{Cf}" + "".join(f"\\u{ord(c):04x}" for c in INVISIBLE) + "]"


@lru_cache(maxsize=1)
def letter_map() -> dict[str, str]:
    """One letter for each letter with a look-alike base, accents kept, from LOOK_ALIKE, MARKS and Unicode's own data."""
    base = {c: proto for proto, group in LOOK_ALIKE.items() for c in group}
    base |= {c: proto for proto, group in MARKS.items() for c in group}
    found = dict(base)
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        if c in found:
            continue
        if unicodedata.category(c) == "Zs":
            found[c] = " "
            continue
        shape = unicodedata.decomposition(c)
        if shape.startswith(("<wide>", "<narrow>")):
            plain = unicodedata.normalize("NFKC", c)
            found[c] = unicodedata.normalize("NFC", "".join(base.get(x, x) for x in unicodedata.normalize("NFD", plain)))
        elif shape and shape[0] != "<" and code < 0x3000:
            parts = unicodedata.normalize("NFD", c)
            if parts[0] in base:
                one = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
                if len(one) == 1:
                    found[c] = one
    return {a: b for a, b in found.items() if a != b}


def ligatures() -> dict[str, str]:
    """Latin and other ligatures that stand for several letters."""
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}


def skeleton(value: Column) -> Column:
    """The value with every look-alike replaced; null stays null."""
    letters = {a: b for a, b in letter_map().items() if len(b) == 1}
    out = F.regexp_replace(value, invisible_class(), "")
    out = F.translate(out, "".join(letters), "".join(letters.values()))
    for a, b in {**{a: b for a, b in letter_map().items() if len(b) > 1}, **ligatures()}.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[ \t]+", " "))


def canonical(values: DataFrame, kind: str, value: str, preferred: str | None = None, out: str = "canonical", cls: str = "form") -> DataFrame:
    """values with the form of each value and the canonical member of its class within its kind.

    preferred: a boolean column; where true, the spelling is a reference one. Columns named as the results give way.
    """
    marked = values.drop(out, cls).withColumn(cls, F.collate(skeleton(F.col(value)), "UNICODE"))
    prefer = F.coalesce(F.col(preferred), F.lit(False)) if preferred else F.lit(False)
    spelled = marked.where(F.col(value).isNotNull()).groupBy(F.col(kind).alias("__kind"), F.col(cls).alias("__form"), F.col(value).alias("__value")).agg(F.max(prefer).alias("__prefer"), F.count("*").alias("__n"))
    best = spelled.groupBy("__kind", "__form").agg(F.min(F.struct(~F.col("__prefer"), F.when(F.col("__prefer"), 0).otherwise(-F.col("__n")), "__value"))["__value"].alias(out))
    joined = marked.join(best, F.col(kind).eqNullSafe(F.col("__kind")) & (F.col(cls) == F.col("__form")), "left")
    return joined.drop("__kind", "__form")
