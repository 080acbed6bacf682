"""Variant spellings of organisations and persons, linked to the entity they name.

Spellings become tokens: folded words without legal forms at the end. All distinct tokens of all names go into a symmetric-delete neighbourhood
index, each under its hashes with up to two letters left out; in a bucket a token meets the most used one and every one that is no
misspelling itself; true edit distances decide, and a token joins the closest clearly more used one. Spellings that have the same tokens then are one
signature. Signatures meet under all their tokens, fullest first, and each is aligned with the fuller ones that stand for themselves: equal tokens
first, then an optimal assignment of the rest, in which a token may be another's initial, abbreviation or short form; what is left on both sides
may be each other's initials or run together. The cheapest alignment links; what leaves different words on both sides is no link.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartalog.llm.edits import distance
from cartalog.session import broadcast_if_small, cut

#: Legal forms at the end of a name.
LEGAL = r"(?:& co\.? ?kg|gmbh ?& ?co\.? ?kg|e\. ?k\.?|ek|s\.? ?a\.?|s\.? ?a\.? ?r\.? ?l\.?|gmbh|mbh|ag|plc|ltd\.?|limited|inc\.?|llc|kg|ohg|gbr|e\. ?v\.?|sas|srl|bv|nv|oy|ab)"
#: Words that a name may have or not.
SLIGHT = frozenset("de des du la le les der die das den dem von of the and und et fur for".split())
#: First names with their short and pet forms, in the corpus' languages. Hints only: names outside are aligned by their letters.
NICKNAMES = (
    "alexander alex sascha xander sandro", "johannes hans hannes johann jan hansi", "josef sepp jupp joseph beppo pepi jo", "friedrich fritz friedel fred frieder", "wilhelm willi willy bill will helm william",
    "richard dick rick ricky rich", "robert bob rob bobby bert robbie", "susanne susi sanne susanna suse susan", "elisabeth lisl betty liesel lisbeth elise lisa elsbeth beth", "margarete grete gretel margret gretchen marga",
    "katharina kathi käthe katrin kathrin trina kate", "theodora thea dora theda", "heinrich heinz heiner hinnerk harry henry", "georg schorsch jörg george", "franz franzl francis frank", "ludwig lutz lois louis", "karl kalle carl charles charlie",
    "michael michi michel mike", "matthias matze hias matthew", "andreas andi andy andrew", "christian chris christel", "stefan steffen stephan steve", "thomas tom tommy", "ulrich uli ulli", "maria mia mitzi marie mary", "anna anni anne annette", "barbara bärbel babsi", "franziska franzi fanny", "magdalena leni lena magda", "brigitte gitte gitti",
    "edward ed eddie ted ned", "james jim jimmy", "john jack johnny", "margaret maggie peggy meg", "anton toni antoine tony", "peter pit peer pete", "philipp phil lipp", "leopold poldi leo", "gertrud trude gerti", "charlotte lotte", "helene hella helen", "dorothea dorle doris", "therese resi", "walburga burgi", "rosa rosi rose",
)
#: Letters of a token that the index takes: with two letters pushed out at the end, tokens within two edits still share a form. Distances take all.
INDEXED_LETTERS = 40
#: Tokens used so seldom are taken for misspellings of one MORE_USED times as much used, by one edit of one about twice as much used, and once of any.
SELDOM, MORE_USED = 3, 3
#: How much more used a token has to be than another, used more often, that is taken for its misspelling: abbreviations are words of their own.
FAR_MORE_USED = 10
#: How much more used a token has to be than another where one of them has three letters only.
SHORT_MORE_USED = 100
#: Names under one token from which on those that may be aligned are looked up; fewer are all compared. Letters are counted in so many bins.
CROWD, LETTER_BINS = 24, 48
#: Shares that the records of one entity are dealt into where pairs are made.
SALTS = 8


def plain(text: str) -> str:
    """Lower case without accents; umlauts, written out or not, as their plain vowels."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower().replace("ß", "ss"))
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    for vowel in "aou":
        text = text.replace(vowel + "e", vowel)
    return text


@cache
def _letters() -> tuple[str, str]:
    """Letters with accents or of full width, and their plain ones: a rule over the Latin blocks of Unicode."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        bare = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(ch))
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(name: Column) -> Column:
    """The words of a name as written: folded, without legal forms at the end; the ending -er of long words, as of places, is dropped."""
    text = F.regexp_replace(F.translate(F.lower(name), *_letters()), r"\p{M}+", "")
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"[\s\p{Z},]+", " ")), rf"(?<=\S)(?: {LEGAL})+$", "")
    text = F.regexp_replace(F.replace(text, F.lit("ß"), F.lit("ss")), r"(?<=\p{L}{5})er(?!\p{L})", "")
    return F.regexp_extract_all(F.regexp_replace(text, "([aou])e", "$1"), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


def _allowed(length: Column) -> Column:
    return F.when(length < 3, 0).when(length < 6, 1).otherwise(2)


def shortened(word: Column) -> Column:
    """The word's first INDEXED_LETTERS with up to as many letters left out as edits are allowed."""

    def without_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    start = F.left(word, F.lit(INDEXED_LETTERS))
    once = without_one(start)
    return F.array_distinct(F.when(F.length(word) < 6, F.concat(F.array(start), once)).otherwise(F.concat(F.array(start), once, F.flatten(F.transform(once, without_one)))))


def close_edits(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance up to 2, else 3: plain edits, and those left after one or two swaps of neighbours."""

    def swapped(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1)), F.substring(w, i + 2, F.length(w))))

    plain_edits = F.levenshtein(a, b, 4)
    once = lambda most: F.exists(swapped(a), lambda s: F.levenshtein(s, b, most) >= 0)
    twice = F.exists(swapped(a), lambda s: F.array_contains(swapped(s), b))
    return (
        F.when(plain_edits.between(0, 1), plain_edits)
        .when((plain_edits == 2) & F.array_contains(swapped(a), b), 1)
        .when(plain_edits == 2, 2)
        .when((plain_edits == 3) & once(1), 2)
        .when((plain_edits == 4) & twice, 2)
        .otherwise(3)
    )


@cache
def short_forms() -> dict[str, frozenset[int]]:
    """Of each listed first name, which groups it belongs to."""
    found: dict[str, set[int]] = {}
    for k, group in enumerate(NICKNAMES):
        for name in group.split():
            found.setdefault(re.sub(r"(?<=\w{5})er$", "", plain(name)), set()).add(k)
    return {name: frozenset(groups) for name, groups in found.items()}


def roots(words: DataFrame) -> DataFrame:
    """(word, root) of the tokens that are misspellings: the more used token that each goes back to. words: (word, n), n its records."""
    known = sorted(short_forms())
    index = words.where(F.length("word") >= 3).select("word", "n", F.explode(shortened(F.col("word"))).alias("short")).select("word", "n", F.xxhash64("short").alias("bucket"))
    index = cut(index)
    rank = F.struct(F.col("n").alias("n"), F.col("word").alias("word"))
    top = index.groupBy("bucket").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = cut(index.join(top, "bucket").select("bucket", "word", "n", "top"))

    def joined(met: DataFrame) -> DataFrame:
        """(word, b) of met (word, n, up, up_n): the closest clearly more used one; order by use, then by word, so that no two join each other."""
        clearly = (F.col("n") == 1) | (F.col("n") * F.when(F.col("n") <= SELDOM, MORE_USED).otherwise(FAR_MORE_USED) <= F.col("up_n"))
        likely = clearly | ((F.col("n") <= SELDOM) & (F.col("up_n") >= 2 * F.col("n") - 1))
        higher = (F.col("up_n") > F.col("n")) | ((F.col("up_n") == F.col("n")) & (F.col("up") > F.col("word")))
        near = (F.abs(F.length("word") - F.length("up")) <= 2) & ((F.least(F.length("word"), F.length("up")) > 3) | (F.col("n") * SHORT_MORE_USED <= F.col("up_n")))
        pairs = met.where(higher & likely & near & ~F.col("word").isin(known)).groupBy("word", "n", "up", "up_n").agg(F.lit(1).alias("one"))
        pairs = pairs.withColumn("d", close_edits(F.col("word"), F.col("up"))).where((F.col("d") <= F.least(_allowed(F.length("word")), _allowed(F.length("up")))) & (clearly | (F.col("d") == 1)))
        return pairs.groupBy("word").agg(F.min(F.struct("d", (-F.col("up_n")).alias("less"), "up")).alias("b"))

    first = cut(joined(crowded.select("word", "n", F.col("top.word").alias("up"), F.col("top.n").alias("up_n"))))
    # All tokens meet all that joined nothing: of a bucket's crowd few are left.
    alone = crowded.select("bucket", F.col("word").alias("up"), F.col("n").alias("up_n")).join(first.select(F.col("word").alias("up")), "up", "left_anti")
    second = joined(crowded.select("bucket", "word", "n").join(alone, "bucket").where("up <> word"))
    links = cut(first.unionByName(second).groupBy("word").agg(F.min("b").alias("b")).select("word", F.col("b.up").alias("up")))
    return ends(links, "word", "up").select("word", F.col("up").alias("root"))


def ends(links: DataFrame, low: str, high: str) -> DataFrame:
    """Links (low, high) upwards, one of each low at most, followed to their ends; each round halves what is left of them."""
    while True:
        above = links.select(F.col(low).alias(high), F.col(high).alias("_higher"))
        longer = links.join(above, high, "left")
        if not longer.where("_higher is not null").limit(1).count():
            return links
        links = cut(longer.select(low, F.coalesce("_higher", high).alias(high)))


def _subsequence(short: str, long: str) -> bool:
    letters = iter(long)
    return all(ch in letters for ch in short)


@lru_cache(maxsize=200_000)
def token_cost(a: str, b: str) -> float | None:
    """What it costs to read one token for the other, None if it cannot be; a is the shorter. Misspellings went back to their roots before."""
    if a == b:
        return 0.0
    groups = short_forms()
    if a in groups and b in groups:
        return 0.2 if groups[a] & groups[b] else None
    if len(a) == 1:
        return 0.3 if b[0] == a else None
    if b.startswith(a):
        return 0.21
    if a[0] == b[0] and _subsequence(a, b):
        return 0.4
    if len(a) >= 5 and (a in b or (a[:5] == b[:5] and a[: -(-4 * len(a) // 5)] == b[: -(-4 * len(a) // 5)])):
        return 0.4
    return None


def _cost(a: str, b: str) -> float | None:
    return token_cost(a, b) if len(a) <= len(b) else token_cost(b, a)


def assignment(costs: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment: shortest augmenting paths with potentials. No fewer columns than rows."""
    rows, columns = len(costs), len(costs[0]) if costs else 0
    row_price, column_price, owner = [0.0] * rows, [0.0] * columns, [-1] * columns
    for row in range(rows):
        reach, before, done = [float("inf")] * columns, [-1] * columns, [False] * columns
        at, column = row, -1
        while True:
            for j in range(columns):
                if not done[j]:
                    way = costs[at][j] - row_price[at] - column_price[j] + (reach[column] if column >= 0 else 0.0)
                    if way < reach[j]:
                        reach[j], before[j] = way, column
            column = min((j for j in range(columns) if not done[j]), key=reach.__getitem__)
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        total = reach[column]
        for j in range(columns):
            if done[j] and owner[j] >= 0:
                row_price[owner[j]] += total - reach[j]
                column_price[j] -= total - reach[j]
        row_price[row] += total
        while column >= 0:
            owner[column] = owner[before[column]] if before[column] >= 0 else row
            column = before[column]
    out = [-1] * rows
    for j, row in enumerate(owner):
        if row >= 0:
            out[row] = j
    return out


def _run_together(xs: list[str], ys: list[str]) -> float | None:
    """What it costs to read some words for some others together: initials, a compound's parts, blanks lost or put in."""
    if len(xs) + len(ys) <= 2:
        return None
    x, y = "".join(xs), "".join(ys)
    if x == y:
        return 0.1
    for one, many in ((xs, ys), (ys, xs)):
        if len(one) == 1 and len(many) > 1 and one[0] in ("".join(w[0] for w in many), "".join(w[0] for w in many if w not in SLIGHT)):
            return 0.3
    short, long = sorted((x, y), key=len)
    if len(short) >= 6 and len(long) - len(short) <= 2 and distance(short, long, 2) <= 2:
        return 0.4
    if min(len(xs), len(ys)) == 1 and short[0] == long[0] and len(short) >= 0.4 * len(long) and _subsequence(short, long):
        return 0.4
    return None


def alignment(a: list[str], b: list[str]) -> float | None:
    """The cost of reading both names for the same, None if words of both are left that do not go together."""
    shared, rest_a, rest_b = 0, [], list(b)
    for w in a:
        if w in rest_b:
            rest_b.remove(w)
            shared += 1
        else:
            rest_a.append(w)
    if not shared:
        return None
    telling_a, telling_b = [w for w in rest_a if w not in SLIGHT], [w for w in rest_b if w not in SLIGHT]
    if not telling_a and not telling_b:
        return 0.02 * (len(rest_a) + len(rest_b))
    if len(telling_a) > len(telling_b):
        rest_a, rest_b, telling_a, telling_b = rest_b, rest_a, telling_b, telling_a
    found = _run_together(rest_a, rest_b) if rest_a else None
    if telling_a and telling_a != rest_a or telling_b != rest_b:
        again = _run_together(telling_a, telling_b) if telling_a else None
        found = min((c for c in (found, again) if c is not None), default=None)
    dropped = len(telling_b) - len(telling_a)
    # A word may be left out where the others are there, not shortened; one of two words may not.
    if dropped > 1 or (dropped and shared + len(telling_a) < 2):
        return found
    never, costs = 99.0, []
    for x in telling_a:
        costs.append([never if (c := _cost(x, y)) is None or (dropped and c > 0.2) else c for y in telling_b])
        if min(costs[-1]) == never:
            return found
    chosen = [costs[k][j] for k, j in enumerate(assignment(costs))]
    if all(c < never for c in chosen):
        total = sum(chosen) + 0.6 * dropped
        found = total if found is None else min(found, total)
    return found


class Crowd:
    """Names that stand for themselves under one token, and of any other name those that alignment() may not be None with; none of these is left out.

    Three ways lead to an alignment. Words that run together, or that differ in one more telling word, leave letters that differ by two edits or are
    all among the other's. Else as many telling words are on both sides, or one more whose others are equal or short forms: then every one
    of the smaller side, also the one that fewest others may be read for, has its like on the other.
    """

    def __init__(self, token: str) -> None:
        self.token, self.counts, self.size, self.index = token, np.zeros((64, 2, LETTER_BINS), np.int32), 0, {}

    def _letters(self, words: list[str]) -> np.ndarray:
        own = [np.bincount([ord(ch) % LETTER_BINS for ch in "".join(ws)], minlength=LETTER_BINS) for ws in (words, [w for w in words if w not in SLIGHT])]
        return np.array(own, np.int32)

    def _telling(self, words: list[str]) -> tuple[int, list[str]]:
        """How many telling words there are; these without the token that all share."""
        telling = [w for w in words if w not in SLIGHT]
        n = len(telling)
        if self.token in telling:
            telling.remove(self.token)
        return n, telling

    @staticmethod
    def _alike(word: str) -> set[tuple]:
        """What a word has in common with each that it equals or is a short form of."""
        return {("w", word), *(("g", k) for k in short_forms().get(word, ()))}

    @staticmethod
    def _read(word: str) -> set[tuple]:
        """What a word has in common with each that token_cost() reads it for: the first letter, a group of short forms, or five letters in a row."""
        return {("f", word[0]), *(("g", k) for k in short_forms().get(word, ())), *(("n", word[k : k + 5]) for k in range(len(word) - 4))}

    def add(self, words: list[str]) -> None:
        if self.size == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[self.size] = self._letters(words)
        n, telling = self._telling(words)
        for key in set().union(*[self._alike(w) | self._read(w) for w in telling]):
            self.index.setdefault((n, key), []).append(self.size)
        self.size += 1

    def _held(self, n: int, keys: set[tuple]) -> set[int]:
        return {k for key in keys for k in self.index.get((n, key), ())}

    def near(self, words: list[str]) -> list[int]:
        counts, own = self.counts[: self.size], self._letters(words)
        more = counts - own
        letters = (np.abs(more).sum(2) <= 4) | (more >= 0).all(2) | (more <= 0).all(2)
        found = set(np.flatnonzero(letters.any(1)).tolist())
        n, telling = self._telling(words)
        if telling:
            found |= min((self._held(n, self._read(w)) for w in telling), key=len)
            found |= min((self._held(n + 1, self._alike(w)) for w in telling), key=len)
            found |= self._held(n - 1, set().union(*map(self._alike, telling)))
        return sorted(found)


def link_block(names: list[tuple[str, list[str], int]], token: str | None = None) -> list[tuple[str, str, float, int]]:
    """(signature, up, cost, up's records) among signatures that share a token: fullest first, each linked to the cheapest that stands for itself.

    Seldom ones come last, however full: a misspelling that no root was found for is not what others are read for. The order is the same in all blocks.
    """
    order = sorted(names, key=lambda s: (s[2] <= SELDOM, -sum(map(len, s[1])), -s[2], s[0]))
    own, used, out = [], {}, []
    crowd = Crowd(token) if token is not None and len(names) >= CROWD else None
    for signature, words, n in order:
        best = None
        for up, up_words in own if crowd is None else [own[k] for k in crowd.near(words)]:
            cost = alignment(words, up_words)
            if cost is not None and (best is None or (cost, -used[up], up) < best):
                best = (cost, -used[up], up)
        if best is None:
            own.append((signature, words))
            used[signature] = n
            if crowd is not None:
                crowd.add(words)
        else:
            used[best[2]] += n
            out.append((signature, best[2], best[0], used[best[2]]))
    return out


def _blocks(signatures: DataFrame) -> DataFrame:
    """(word, names): of each token, the signatures that have it. Names that share none are not aligned, and all that share one meet under it."""
    own = signatures.select(F.explode(F.array_distinct("words")).alias("word"), F.struct("signature", "words", "n").alias("s"))
    return own.groupBy("word").agg(F.collect_list("s").alias("names")).where(F.size("names") > 1)


def entities(records: DataFrame) -> DataFrame:
    """(tab, id, entity) of records (tab, id, name): equal entities name the same organisation or person.

    Null, empty and blank names, and null ids, have no row; a name of marks only has none either; repeated rows count once. Names may be of
    any length. An empty table gives an empty one.
    """
    spark = records.sparkSession
    rows = cut(records.select("tab", "id", F.trim("name").alias("name")).where("id is not null and name is not null and name <> ''").distinct())
    spellings = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    spellings = cut(spellings.repartition(spark.sparkContext.defaultParallelism, "name").select("name", "n", tokens(F.col("name")).alias("words")).where(F.size("words") > 0))
    words = spellings.select(F.explode(F.array_distinct("words")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    changed = cut(roots(words))
    placed = spellings.select("name", "n", F.posexplode("words").alias("pos", "word")).join(broadcast_if_small(changed), "word", "left")
    rooted = placed.groupBy("name", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("root", "word").alias("w")))), lambda p: p["w"]).alias("words"))
    rooted = cut(rooted.withColumn("signature", F.array_join(F.array_sort("words"), " ")))
    signatures = cut(rooted.groupBy("signature").agg(F.max_by("words", F.struct("n", "name")).alias("words"), F.sum("n").alias("n")))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [link for word, names in zip(batch["word"], batch["names"], strict=True) for link in link_block([(s["signature"], list(s["words"]), s["n"]) for s in names], word)]
            yield pd.DataFrame(found, columns=["signature", "up", "cost", "n"])

    tasks = 2 * spark.sparkContext.defaultParallelism
    links = _blocks(signatures).repartition(tasks).mapInPandas(align, "signature string, up string, cost double, n bigint")
    links = links.groupBy("signature").agg(F.min(F.struct("cost", (-F.col("n")).alias("less"), "up")).alias("b")).select("signature", F.col("b.up").alias("up"))
    linked = ends(cut(links), "signature", "up")
    named = rooted.select("name", "signature").join(linked, "signature", "left").select("name", F.coalesce("up", "signature").alias("entity"))
    return rows.join(named, "name").select("tab", "id", "entity").distinct()


def same_entity_pairs(records: DataFrame, base: str) -> DataFrame:
    """(base_id, other_tab, other_id): pairs of a record of the base table and another record, of any table, that name the same entity.

    Two base records come once, the smaller id first. Pairs are only built with base records, never among the others of an entity, and the
    others of an entity are dealt into SALTS shares, so that no entity is one task's. entities() is the same result without pairs.
    """
    found = cut(entities(records))
    share = F.pmod(F.xxhash64("tab", "id"), F.lit(SALTS))
    bases = found.where(F.col("tab") == base).select("entity", F.col("id").alias("base_id"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(SALTS)])).alias("share"))
    others = found.select("entity", share.alias("share"), F.col("tab").alias("other_tab"), F.col("id").alias("other_id"))
    pairs = bases.join(others, ["entity", "share"]).where((F.col("other_tab") != base) | (F.col("base_id") < F.col("other_id")))
    return pairs.select("base_id", "other_tab", "other_id").distinct()
