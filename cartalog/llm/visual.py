"""Visually identical text with different characters, brought to one form.

Distinct texts with any unusual character are exploded to positioned code points and joined with two broadcast tables: decompositions
(canonical ones, letter widths and kinds of blank, built from the Unicode data of the Python library) and look-alike letters (stated below).
Combining marks are put in the order of their classes within their letter, letters and marks recomposed, and the texts rebuilt in order of
position. Texts of plain characters only are their own form and take no part in it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cartalog.functions.blanks import trim
from cartalog.session import broadcast_if_small, cut

#: Letters that look like a Latin letter, as (script, letters, the Latin letters they look like).
LOOK_ALIKE = (
    ("Cyrillic small", "аеорсухіјѕһԁԛԝѵӏүҽ", "aeopcyxijshdqwvlye"),
    ("Cyrillic capital", "АВЕКМНОРСТУХІЈЅԌԚԜѴҮӀЗ", "ABEKMHOPCTYXIJSGQWVYI3"),
    ("Greek small", "ανοριυγχκ", "avopiuyxk"),
    ("Greek capital", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("Latin extensions", "ɡɑıƖǃ", "gail!"),
    ("Armenian", "օսհոզ", "ouhnq"),
    ("Cherokee", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("Lisu", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("Coptic", "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲥ", "ABEHIKMNOPCTXoc"),
    ("signs", "‐‑⁃－﹣ʼ‒−", "-----’––"),
)
#: Letters whose small capital looks like their small letter.
SAME_SMALL = "cosvwxz"
#: Characters without width that Unicode does not list as format characters.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Decompositions that change neither look nor meaning; raised, circled and styled signs are none of them.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
#: Shares that the records of one string are dealt into where pairs are made.
SALTS = 8
#: Printable ASCII, composed Latin letters without a look-alike, and the dashes and quotes of running text: never changed, alone or together.
PLAIN = "[ -~À-İĲ-ſ–—’“”„«»·]"


def _spread(ch: str) -> str:
    """A character's parts: full decomposition, blanks as one kind of blank, nothing for what has no width."""
    kind = unicodedata.category(ch)
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind in ("Cf", "Cc") or ch in INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return ch if not 0xAC00 <= ord(ch) <= 0xD7A3 else unicodedata.normalize("NFD", ch)
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return ch
        parts = parts[1:]
    return "".join(_spread(chr(int(p, 16))) for p in parts)


def _like_latin() -> dict[str, str]:
    """Look-alikes by their Unicode names: numerals of one letter, and small capitals of letters that only differ in size."""
    alike = {}
    for code in (*range(0x1D00, 0x1D80), *range(0x2160, 0x2180), *range(0xA730, 0xA7FF)):
        ch = chr(code)
        name = unicodedata.name(ch, "")
        if "ROMAN NUMERAL" in name and len(unicodedata.normalize("NFKC", ch)) == 1:
            alike[ch] = unicodedata.normalize("NFKC", ch)
        elif name.startswith("LATIN LETTER SMALL CAPITAL ") and name[27:].lower() in tuple(SAME_SMALL):
            alike[ch] = name[27:].lower()
    return alike


@cache
def mappings() -> pa.Table:
    """(ch, parts): what each character that is not itself comes apart into, look-alikes included; parts as structs of place, character, class."""
    alike = _like_latin() | {a: b for _, odd, plain in LOOK_ALIKE for a, b in zip(odd, plain, strict=True)}
    chars, parts = [], []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        spread = "".join(alike.get(p, p) for p in _spread(ch))
        if spread != ch or unicodedata.combining(ch):
            chars.append(ch)
            parts.append([(k, p, unicodedata.combining(p)) for k, p in enumerate(spread)])
    kind = pa.list_(pa.struct([("sub", pa.int32()), ("part", pa.string()), ("class", pa.int32())]))
    rows = [[{"sub": k, "part": p, "class": c} for k, p, c in own] for own in parts]
    return pa.table({"ch": pa.array(chars, type=pa.string()), "parts": pa.array(rows, type=kind)})


@F.pandas_udf(StringType())
def _compose(segments: pd.Series) -> pd.Series:
    """A letter with its ordered marks, recomposed."""
    return segments.map(lambda s: unicodedata.normalize("NFC", s))


def _mapping_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(mappings())


def visual_forms(df: DataFrame, text: str) -> DataFrame:
    """(text, form): each distinct text with its one form; texts that look the same have equal forms.

    Letter width, kinds of blank, outer blanks and characters without width make no difference; letter case, accents, raised digits and the
    number of blanks do. Null has no row; a text of blanks or invisible characters only has the form ''. Texts may be of any length.
    """
    texts = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    plain = F.col("text").rlike(f"^{PLAIN}*$")
    # Rows of code points carry a number in place of their text, which may be long.
    odd = cut(texts.where(~plain).withColumn("id", F.monotonically_increasing_id()))
    points = odd.select("id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    spread = points.join(F.broadcast(_mapping_table(df.sparkSession)), "ch", "left")
    kept = F.array(F.struct(F.lit(0).alias("sub"), F.col("ch").alias("part"), F.lit(0).alias("class")))
    parts = spread.select("id", "pos", F.explode(F.coalesce("parts", kept)).alias("p")).select("id", "pos", "p.sub", "p.part", "p.class")
    # A segment is a letter with the marks that follow it.
    in_order = Window.partitionBy("id").orderBy("pos", "sub")
    segments = parts.withColumn("segment", F.sum((F.col("class") == 0).cast("int")).over(in_order))
    joined = segments.groupBy("id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class", "pos", "sub", "part"))), lambda p: p["part"]), "").alias("raw"))
    composed = joined.select("raw").where("length(raw) > 1").distinct().withColumn("whole", _compose("raw"))
    whole = joined.join(broadcast_if_small(composed), "raw", "left").select("id", "segment", F.coalesce("whole", "raw").alias("whole"))
    rebuilt = whole.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "whole"))), lambda s: s["whole"]), "").alias("form"))
    # Texts of which nothing is left have no code points to be rebuilt from.
    odd = odd.join(rebuilt, "id", "left").select("text", trim(F.coalesce("form", F.lit(""))).alias("form"))
    return texts.where(plain).select("text", trim(F.col("text")).alias("form")).unionByName(odd)


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b): records whose texts look the same but are not the same string, the smaller key first, each pair once.

    Null, empty, blank and invisible texts, and null keys, give no pair; repeated rows change nothing; an empty table gives an empty one.
    Distinct strings are paired first, records only then, so records of one string never meet. Other columns play no part.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text")).where("k is not null and text is not null").distinct()
    # Forms are read four times below, and are made once.
    forms = cut(visual_forms(rows, "text").where("form <> ''"))
    several = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    strings = forms.join(several, "form")
    pairs = strings.select("form", F.col("text").alias("text_a")).join(strings.select("form", F.col("text").alias("text_b")), "form").where("text_a < text_b")
    left = rows.select(F.col("k").alias("ka"), F.col("text").alias("text_a"))
    # The records of one string are dealt into shares, so that those of a frequent one are not one task's.
    right = rows.select(F.col("k").alias("kb"), F.col("text").alias("text_b"), F.pmod(F.xxhash64("k"), F.lit(SALTS)).alias("share"))
    shares = F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(SALTS)])).alias("share")
    met = pairs.select("text_a", "text_b").join(left, "text_a").select("ka", "text_b", shares).join(right, ["text_b", "share"]).where("ka <> kb")
    return met.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
