"""Devanagari to ITRANS by the public scheme's tables, in an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicons as lx
from . import text as tx

# The ITRANS scheme. Vowels with their signs, consonants, other signs.
VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ ऍ ऑ".split(), "a aa i ii u uu R^i e ai o au e.c o.c".split()))
SIGNS = dict(zip("ा ि ी ु ू ृ े ै ो ौ ॅ ॉ".split(), "aa i ii u uu R^i e ai o au e.c o.c".split()))
CONSONANTS = dict(
    zip(
        "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(),
        "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h L".split(),
    )
)
NUKTA = dict(zip("क ख ग ज ड ढ फ य".split(), "q K G z .D .Dh f Y".split()))
OTHERS = {"ं": ".m", "ः": "H", "ँ": "ँ", "।": ".", "॥": "..", "ऽ": ".a", "ॐ": "OM"} | {chr(0x966 + i): str(i) for i in range(10)}
HALANT, NUKTA_SIGN = "्", "़"
COMPOSED = {chr(0x958 + i): c + NUKTA_SIGN for i, c in enumerate("कखगजडढफय")}


def to_itrans(text: str) -> str:
    """A consonant carries ``a`` unless a vowel sign or halant follows."""
    for c, parts in COMPOSED.items():
        text = text.replace(c, parts)
    out, i, n = [], 0, len(text)
    while i < n:
        ch = text[i]
        i += 1
        if ch not in CONSONANTS:
            out.append(VOWELS.get(ch) or SIGNS.get(ch) or OTHERS.get(ch) or ("" if ch in (HALANT, NUKTA_SIGN) else ch))
            continue
        roman = CONSONANTS[ch]
        if i < n and text[i] == NUKTA_SIGN:
            roman = NUKTA.get(ch, roman)
            i += 1
        out.append(roman)
        if i < n and text[i] == HALANT:
            i += 1
        elif i < n and text[i] in SIGNS:
            out.append(SIGNS[text[i]])
            i += 1
        else:
            out.append("a")
    return "".join(out)


@F.pandas_udf(StringType())
def itrans(s: pd.Series) -> pd.Series:
    return s.map(to_itrans, na_action="ignore")


def transliterate(c: tx.C, keep: list[str] = lx.SCHWA_EXCEPTIONS) -> Column:
    """Devanagari text to casual romanization, sentence by sentence; null counts as empty.

    Romanization doesn't look across white space, so the whole text is turned to ITRANS
    at once and cut into sentences at its full stops afterwards.
    """
    cut = F.split(F.regexp_replace(F.coalesce(tx.col(c), F.lit("")), r"([।?!.])\s+", "$1\u0001"), "\u0001")
    roman = F.split(itrans(F.array_join(cut, "\u0001")), "\u0001")
    return tx.rejoin(F.transform(roman, lambda s: tx.smooth_roman(s, keep)))
