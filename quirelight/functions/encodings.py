"""Character codes and glyph names to Unicode, as small tables and as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def winansi(code: int) -> int:
    """WinAnsiEncoding is code page 1252; codes it leaves open stand for themselves."""
    try:
        return ord(bytes([code]).decode("cp1252"))
    except UnicodeDecodeError:
        return code


def macroman(code: int) -> int:
    """MacRomanEncoding is the Mac OS Roman code page."""
    return ord(bytes([code]).decode("mac_roman"))


_NAMES = (
    # fixed values: glyph names of the public Adobe Glyph List that no rule below gives
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at",
    "bracketleft backslash bracketright asciicircum underscore grave",
    "braceleft bar braceright asciitilde",
    "nbspace exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot softhyphen registered macron "
    "degree plusminus twosuperior threesuperior acute mu paragraph periodcentered cedilla onesuperior ordmasculine guillemotright onequarter onehalf threequarters questiondown",
)
_STARTS = (0x20, 0x5B, 0x7B, 0xA0)
_OTHERS = {
    "AE": 0xC6, "ae": 0xE6, "Eth": 0xD0, "eth": 0xF0, "Thorn": 0xDE, "thorn": 0xFE, "germandbls": 0xDF, "multiply": 0xD7, "divide": 0xF7, "Oslash": 0xD8, "oslash": 0xF8,
    "Dcroat": 0x110, "dcroat": 0x111, "dotlessi": 0x131, "IJ": 0x132, "ij": 0x133, "Ldot": 0x13F, "ldot": 0x140, "Lslash": 0x141, "lslash": 0x142, "Eng": 0x14A, "eng": 0x14B,
    "OE": 0x152, "oe": 0x153, "Tbar": 0x166, "tbar": 0x167, "florin": 0x192, "circumflex": 0x2C6, "tilde": 0x2DC, "endash": 0x2013, "emdash": 0x2014, "quoteleft": 0x2018, "quoteright": 0x2019,
    "quotesinglbase": 0x201A, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotedblbase": 0x201E, "dagger": 0x2020, "daggerdbl": 0x2021, "bullet": 0x2022, "ellipsis": 0x2026,
    "perthousand": 0x2030, "guilsinglleft": 0x2039, "guilsinglright": 0x203A, "fraction": 0x2044, "colonmonetary": 0x20A1, "franc": 0x20A3, "lira": 0x20A4, "peseta": 0x20A7, "won": 0x20A9,
    "dong": 0x20AB, "Euro": 0x20AC, "trademark": 0x2122, "minus": 0x2212, "fi": 0xFB01, "fl": 0xFB02,
}
_ACCENTS = {0x300: "grave", 0x301: "acute", 0x302: "circumflex", 0x303: "tilde", 0x304: "macron", 0x306: "breve", 0x307: "dotaccent", 0x308: "dieresis", 0x30A: "ring", 0x30B: "hungarumlaut", 0x30C: "caron", 0x328: "ogonek"}


def glyph_names() -> dict[str, int]:
    """Names of the supported subset. Accented letters of Latin-1 and Latin Extended-A get theirs by rule."""
    names = {n: start + i for start, line in zip(_STARTS, _NAMES) for i, n in enumerate(line.split())} | _OTHERS
    for code in range(0xC0, 0x180):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0] != "<compat>" and (letter := int(parts[0], 16)) < 0x80:
            mark = int(parts[1], 16)
            accent = ("cedilla" if chr(letter) in "CcSs" else "commaaccent") if mark == 0x327 else _ACCENTS.get(mark)
            if accent:
                names[chr(letter) + accent] = code
    return names


def code_table(spark: SparkSession, encoding: str) -> DataFrame:
    """(code, unicode) for all 256 codes; fixed size, so it may be broadcast."""
    of = {"WinAnsiEncoding": winansi, "MacRomanEncoding": macroman}[encoding]
    return spark.createDataFrame([(c, of(c)) for c in range(256)], "code int, unicode int")


def decode_codes(df: DataFrame, encoding: str, code_col: str = "code") -> DataFrame:
    """Adds ``unicode`` by a broadcast join with the encoding's table."""
    t = code_table(df.sparkSession, encoding).withColumnRenamed("code", code_col)
    return df.join(F.broadcast(t), code_col)


def glyph_unicode(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Adds ``unicode``: uniXXXX, uXXXX to uXXXXXX, single characters, then known names; else 0."""
    base = F.element_at(F.split(F.col(name_col), r"\.", 2), 1)
    names = df.sparkSession.createDataFrame(list(glyph_names().items()), "_base string, _code int")  # fixed size
    hexed: Column = F.conv(F.regexp_extract("_base", "^(?:uni(?=.{4}$)|u(?!n))([0-9A-Fa-f]{4,6})$", 1), 16, 10).cast("int")
    known = df.withColumn("_base", base).join(F.broadcast(names), "_base", "left")
    value = F.when(hexed.between(1, 0xFFFF), hexed).when((F.length("_base") == 1) & (F.ascii("_base") >= 0x20), F.ascii("_base")).otherwise(F.coalesce("_code", F.lit(0)))
    return known.withColumn("unicode", value).drop("_base", "_code")


def is_subset_name(name: Column) -> Column:
    """Six capital letters, a plus and a name: the font is a subset already."""
    return name.rlike(r"^/?[A-Z]{6}\+.+")
