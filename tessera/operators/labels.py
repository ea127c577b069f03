"""Labels of the binary map: encodings, encoded lengths and interned offsets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the six-bit format.
SYMBOL_SHIFT, TERMINATOR = 0x1C, 0x3F
SYMBOLS = "@!\"#$%&'()*+,-./"
CODEPAGES = (1250, 1251, 1252)
#: Letters that the six-bit format spells in ASCII: Latin-1, some Czech ones and those without a base letter.
SPELLED = {chr(c): unicodedata.normalize("NFD", chr(c))[0].upper() for c in (*range(0xC0, 0x100), *map(ord, "ůŮňŇčČďĎťŤřŘšŠžŽěĚ")) if chr(c) not in "×÷"}
SPELLED |= {"ß": "SS", "æ": "AE", "Æ": "AE", "œ": "OE", "Œ": "OE", "ð": "D", "Ð": "D", "þ": "T", "Þ": "T", "ø": "O", "Ø": "O"}


def six_bit(text: str) -> bytes:
    """Six-bit codes as one bit stream from the highest bit, with a terminator, cut to whole bytes."""
    codes = []
    for c in "".join(SPELLED.get(c, c) for c in text):
        c = c.upper() if c.isascii() else c
        if c == " ":
            codes.append(0)
        elif "A" <= c <= "Z":
            codes.append(ord(c) - 64)
        elif "0" <= c <= "9":
            codes.append(ord(c) - 16)
        elif c in SYMBOLS:
            codes += [SYMBOL_SHIFT, SYMBOLS.index(c)]
    size = len(codes) * 6 // 8 + 1
    stream = 0
    for code in (*codes, TERMINATOR):
        stream = stream << 6 | code
    spare = 6 * (len(codes) + 1) - 8 * size
    return (stream >> spare if spare >= 0 else stream << -spare).to_bytes(size, "big") if text else b""


def encode_label(text: str | None, form: int, codepage: int = 1252) -> bytes | None:
    """Form 6 (six bits), 9 (one byte a letter, `?` if the code page lacks it) or 10 (UTF-8); 9 and 10 end with a zero."""
    if text is None:
        return None
    if form == 6:
        return six_bit(text)
    return text.encode(f"cp{codepage if codepage in CODEPAGES else 1252}" if form == 9 else "utf-8", "replace") + b"\0"


def encoded(text: Column, form: int, codepage: int = 1252) -> Column:
    """T6 on a column."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode_label(t, form, codepage))

    return run(text)


def encoded_length(text: Column, form: int) -> Column:
    """Bytes of a label, without encoding it."""
    if form != 6:
        return (F.char_length(text) if form == 9 else F.octet_length(text)) + 1
    for c, letters in SPELLED.items():
        if len(letters) == 2:
            text = F.replace(text, F.lit(c), F.lit(letters))
    single = {c: x for c, x in SPELLED.items() if len(x) == 1}
    plain = F.upper(F.regexp_replace(F.translate(text, "".join(single), "".join(single.values())), r"[^\x00-\x7f]", ""))
    codes = F.char_length(F.regexp_replace(plain, "[^ A-Z0-9]", "")) + 2 * F.char_length(F.regexp_replace(plain, r"""[^@!"#$%&'()*+,\-./]""", ""))
    return F.floor(codes * 6 / 8).cast("int") + 1


def interned(rows: DataFrame, text: str, scope: list[str], order: list[str], form: int = 9, offset: str = "label_offset") -> DataFrame:
    """Rows + offset of their label; each text of a scope (a tile) is stored once, at its first appearance.

    Offset 0 is the empty label. Forms 9 and 10 store labels at even bytes and halve the offset. Texts are grouped before
    the running sum, so a frequent label is one row of the window; a tile's label section is bounded by the format.
    """
    shift = 0 if form == 6 else 1
    step = 1 << shift
    stored = rows.where(F.col(text) != "").groupBy(*scope, text).agg(F.min(F.struct(*order)).alias("_first"))
    size = F.floor((encoded_length(F.col(text), form) + (step - 1)) / step) * step
    before = Window.partitionBy(*scope).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    at = stored.select(*scope, text, F.shiftright((F.coalesce(F.sum(size).over(before), F.lit(0)) + step).cast("long"), shift).alias(offset))
    return rows.join(at, [*scope, text], "left").withColumn(offset, F.coalesce(offset, F.lit(0).cast("long")))
