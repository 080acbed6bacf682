"""Free-typed values mapped to the entries of a reference list.

Distinct values are looked up, not rows. The reference list's entries, with the forms people give them, go into BK-trees under a
true edit metric: shards of a bounded number of entries, each sent to the executors in turn. Each shard returns every entry within the
threshold of a value's length; the shards' winners are merged per value. What is within no threshold is reported as matching none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartalog.functions.blanks import trim
from cartalog.llm.edits import BkTree, typing_cost

#: Entries, at most, of one tree sent to the executors.
SHARD_ENTRIES = 20_000
NONE = -1
#: Letters, at most, of a reading that is looked up: no label is so long, and no reading that is has few edits.
LONGEST = 200
#: Words that people put beside a kind of route without changing it.
QUALIFIERS = frozenset(
    "public publique publik öffentlich öffentliche öffentlicher regional regionale régional régionale local lokal lokale night nacht nuit "
    "nocturne city stadt urban urbain urbaine express schnell rapide school schul scolaire tourist line lines linie linien ligne lignes "
    "route routes service services scheduled seasonal saisonal saisonnier saisonnière regular type kind mode code art nr no the der die das le la les de of".split()
)


def most_edits(length: int) -> int:
    """Edits at most that a form of that length may have lost or gained."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 13 else 3


def folded(text: str) -> str:
    """Without letter case, width, accents and marks between words: single blanks only."""
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(" " if not (ch.isalnum() or unicodedata.combining(ch)) else ch for ch in text)
    return " ".join("".join(ch for ch in text if not unicodedata.combining(ch)).split())


def spellings(label: str) -> set[str]:
    """The folded forms of a label: as it is, with umlauts written out, and in one word."""
    out = unicodedata.normalize("NFC", label).lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        out = out.replace(a, b)
    forms = {folded(label), folded(out)}
    return {f for f in forms | {f.replace(" ", "") for f in forms} if f}


_QUALIFIERS = frozenset(folded(w) for w in QUALIFIERS)


def _whole(text: str) -> str | None:
    """Plain digits of a whole number."""
    hit = re.fullmatch(r"\s*([+-]?)0*([0-9]+)(?:[.,]0*)?\s*", unicodedata.normalize("NFKC", text))
    return hit and ("-" if hit[1] == "-" else "") + hit[2]


def readings(value: str) -> Iterator[str]:
    """What a value may name, the whole first: without remarks in brackets or after a semicolon, without qualifying words."""
    value = unicodedata.normalize("NFKC", value)
    if not any(w.isdigit() for w in folded(value).split()):
        yield folded(value)
    bare = re.split(r"[;|]", re.sub(r"\([^)]*\)|\[[^]]*\]", " ", value))[0]
    words = [w for w in folded(bare).split() if not w.isdigit()]
    yield " ".join(words)
    # Qualifying words go from either end, one by one, until none is left.
    for ends in ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2)):
        cut = words[ends[0] : len(words) - ends[1]]
        gone = words[: ends[0]] + words[len(words) - ends[1] :]
        if cut and all(w in _QUALIFIERS for w in gone):
            yield " ".join(cut)
    before = len(list(takewhile(_QUALIFIERS.__contains__, words)))
    after = len(list(takewhile(_QUALIFIERS.__contains__, reversed(words))))
    # What keeps more words than LONGEST letters is too long in any case.
    for n in range(max(3, len(words) - LONGEST), min(before + after, len(words) - 1) + 1):
        for k in range(min(n, before), max(0, n - after) - 1, -1):
            yield " ".join(words[k : len(words) - n + k])


class Matcher:
    """One shard of the reference list: codes, and a tree over the labels' forms."""

    def __init__(self, entries: list[tuple[int, list[str]]]) -> None:
        self.codes = {str(code) for code, _ in entries}
        self.forms: dict[str, set[int]] = {}
        for code, labels in entries:
            for label in labels:
                for form in spellings(label):
                    self.forms.setdefault(form, set()).add(code)
        self.tree = BkTree(sorted(self.forms))

    def find(self, value: str) -> list[tuple[int, float, int]]:
        """(edits, typing cost, code) of every entry that the value may mean."""
        number = _whole(value)
        if number is not None:
            return [(0, 0.0, int(number))] if number in self.codes else []
        found: dict[int, tuple[int, float]] = {}
        for reading in dict.fromkeys(r for v in readings(value) for r in (v, v.replace(" ", ""))):
            if not reading or len(reading) > LONGEST:
                continue
            for d, form in self.tree.within(reading, most_edits(len(reading))):
                if d <= most_edits(len(form)) and (not d or len(reading) > 2):
                    for code in self.forms[form]:
                        found[code] = min(found.get(code, (99, 99.0)), (d, typing_cost(reading, form)))
            if found:
                break
        if not found:
            # A number beside a word that no list has: type 3, 3 - something.
            parts = folded(value).split()
            numbers = [w for w in parts if w.isdigit()]
            if len(numbers) == 1 and len(numbers[0]) <= LONGEST and all(w in _QUALIFIERS for w in parts if not w.isdigit()) and str(int(numbers[0])) in self.codes:
                return [(0, 0.0, int(numbers[0]))]
        return [(d, cost, code) for code, (d, cost) in found.items()]


def to_canonical(df: DataFrame, value: str, entries: DataFrame, code: str, labels: list[str], shard: int = SHARD_ENTRIES) -> DataFrame:
    """(value, code): each distinct value that is neither null nor blank, with the code of the entry meant, -1 if none is.

    The fewest edits win, then the likeliest typing errors, then the smallest code. Values that are a code or label exactly map to it.
    Repeated rows count once; empty tables of values give an empty one, an empty list of entries -1 everywhere. Very long readings match nothing.
    """
    values = df.select(F.col(value).alias("value")).where(F.col("value").isNotNull() & (trim(F.col("value")) != "")).distinct()
    listed = entries.select(F.col(code).alias("code"), F.array(*labels).alias("labels")).where("code is not null").distinct()
    spark, best = df.sparkSession, values.select("value", F.lit(None).cast("struct<edits:int,cost:double,code:bigint>").alias("hit"))
    count = listed.count()
    shards = max(1, -(-count // shard))
    for k in range(shards):
        rows = listed.where(F.pmod(F.xxhash64("code"), F.lit(shards)) == k).collect()
        sent = spark.sparkContext.broadcast(Matcher([(r["code"], [x for x in r["labels"] if x]) for r in rows]))

        def look_up(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = [(v, *h) for v in batch["value"] for h in sent.value.find(v)]
                yield pd.DataFrame(hits, columns=["value", "edits", "cost", "code"])

        hits = values.mapInPandas(look_up, "value string, edits int, cost double, code bigint")
        best = best.unionByName(hits.select("value", F.struct("edits", "cost", "code").alias("hit")))
    return best.groupBy("value").agg(F.min("hit").alias("hit")).select("value", F.coalesce("hit.code", F.lit(NONE)).cast("int").alias("code"))


def mapped_rows(df: DataFrame, key: str, value: str, entries: DataFrame, code: str, labels: list[str]) -> DataFrame:
    """(row_id, code): to_canonical() for the rows whose value is no exact code or label; each row and value once."""
    rows = df.select(F.col(key).alias("row_id"), F.col(value).alias("value")).where(F.col("row_id").isNotNull() & (trim(F.col("value")) != "")).distinct()
    exact = entries.select(F.explode(F.array(F.col(code).cast("string"), *[F.col(c) for c in labels])).alias("value")).where("value is not null").distinct()
    free = rows.join(exact, "value", "left_anti")
    return free.join(to_canonical(free, "value", entries, code, labels), "value").select("row_id", "code").distinct()
