"""Evaluation texts leaking into training texts, found by a positional inverted index.

The test side is bounded and fixed: its words get numbers, and training texts become arrays of these numbers. Terms of the index are three words
in a row, counted over all training texts; of every stretch of an item the rarest are looked up: their postings are (term, document, position),
kept by document and intersected with the test items' own. Offset-adjusted, the hits of one passage fall on one diagonal or, with words put in or left out, on close
ones. Where enough do, document and item are compared: LEAST_WORDS words in a row are a case whatever they are; else both are aligned word by word,
and a place is a stretch that matches but for small changes, rare words included, as stock phrases match in all but their names and numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartalog.llm.tokenizer import spread
from cartalog.llm.words import plain_words
from cartalog.session import cut

#: Words of an item, in their order, at one place or two, that make a case.
LEAST_WORDS = 24
#: A second place counts from so many words on.
LEAST_PLACE = 8
#: Of every stretch of an item of WINDOW words, the KEPT terms rarest in the training texts are looked up, so any copy of a stretch hits them.
WINDOW, KEPT = 12, 4
#: Hits on close diagonals that make a document worth an alignment, if one of them is of a term with a rare word; how far apart close ones are.
LEAST_HITS, DRIFT = 4, 12
#: So many hits make it worth a look for words copied as they are: each LEAST_WORDS of those have two stretches of WINDOW words.
SURE_HITS = 2 * KEPT
#: A word is rare if it is in so small a share of documents without such hits, and of items; so is any number. So much of a place's rare words must match.
RARE_SHARE, RARE_ITEM_SHARE, RARE_MATCHED = 0.01, 0.03, 0.6
#: What a word put in, left out or changed costs, in matching words.
PENALTY = 2
#: Test words at most: the vocabulary is sent to the executors.
MOST_WORDS = 2_000_000


def _item_words(items: DataFrame, item: str, text: str) -> dict[tuple[str, ...], list]:
    """Items by their words: equal ones are looked up once."""
    groups: dict[tuple[str, ...], list] = {}
    total = 0
    for row in items.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct().toLocalIterator():
        words = tuple(plain_words(row["t"]))
        total += len(words)
        if total > MOST_WORDS:
            raise ValueError(f"the evaluation texts have more than {MOST_WORDS} words; share them out")
        if len(words) >= 3:
            groups.setdefault(words, []).append(row["i"])
    return groups


def _terms(words: np.ndarray, size: int) -> np.ndarray:
    """The terms that begin at each place but the last two, as numbers; -1 where a word has no number."""
    a, b, c = words[:-2].astype(np.int64), words[1:-1].astype(np.int64), words[2:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * size + b) * size + c, -1)


def _seed_rows(items: list[np.ndarray], terms: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(term, item, position) of the terms to be looked up; counts: how often each of the sorted terms is in the training texts."""
    rows = []
    for k, words in enumerate(items):
        own = np.searchsorted(terms, _terms(words, size))
        often = counts[own]
        kept = np.zeros(len(own), dtype=bool)
        for start in range(max(1, len(own) - (WINDOW - 2) + 1)):
            kept[start + np.argsort(often[start : start + WINDOW - 2], kind="stable")[:KEPT]] = True
        rows += [(int(own[p]), k, int(p)) for p in np.flatnonzero(kept)]
    return rows


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch (doc, words) one after another, and where each document's begin, with the end of the last."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _places(batch: pa.RecordBatch, terms: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document rows, places and indices of all occurrences of the sorted terms in a batch (doc, words)."""
    words, offsets = _flat(batch)
    if len(words) < 3 or not len(terms):
        return (np.zeros(0, dtype=np.int64),) * 3
    found = _terms(words, size)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == found)
    row = np.searchsorted(offsets, hit, side="right") - 1
    inside = hit + 2 < offsets[row + 1]
    return row[inside], (hit - offsets[row])[inside], at[hit[inside]]


def _best(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """The best local alignment of a text of any length: spans in document and item, and the matching places (document, item).

    Long texts are gone through in windows that overlap by more than a place can be long.
    """
    step = 4000
    best = (0, (0, 0, 0, 0, []))
    for start in range(0, max(1, len(doc)), step):
        score, (d0, d1, i0, i1, matches) = _local(doc[start : start + step + 2 * len(item)], item)
        if score > best[0]:
            best = (score, (d0 + start, d1 + start, i0, i1, [(d + start, i) for d, i in matches]))
    return best[1]


def _local(doc: np.ndarray, item: np.ndarray) -> tuple[int, tuple[int, int, int, int, list[tuple[int, int]]]]:
    """The score and the alignment, as _best() has it, of a text of bounded length."""
    n, m = len(doc), len(item)
    table = np.zeros((m + 1, n + 1), dtype=np.int32)
    slope = PENALTY * np.arange(n + 1, dtype=np.int32)
    for k in range(1, m + 1):
        above = table[k - 1]
        step = np.where(doc == item[k - 1], 1, -PENALTY) if item[k - 1] >= 0 else np.full(n, -PENALTY)
        row = np.maximum(above - PENALTY, 0)
        np.maximum(row[1:], above[:-1] + step, out=row[1:])
        table[k] = np.maximum.accumulate(row + slope) - slope
    k, j = np.unravel_index(int(table.argmax()), table.shape)
    k, j, matches = int(k), int(j), []
    end_item, end_doc = k, j
    while k and j and table[k, j] > 0:
        here = table[k, j]
        if item[k - 1] >= 0 and doc[j - 1] == item[k - 1] and here == table[k - 1, j - 1] + 1:
            k, j = k - 1, j - 1
            matches.append((j, k))
        elif here == table[k - 1, j - 1] - PENALTY:
            k, j = k - 1, j - 1
        elif here == table[k - 1, j] - PENALTY:
            k -= 1
        else:
            j -= 1
    return int(table[end_item, end_doc]), (j, end_doc, k, end_item, matches)


def copied(doc: np.ndarray, item: np.ndarray, least: int = LEAST_WORDS) -> bool:
    """Whether the document holds so many words of the item in a row as they are, whatever words they are."""
    text, width = np.ascontiguousarray(doc, dtype=np.int32).tobytes(), np.dtype(np.int32).itemsize
    for k in range(len(item) - least + 1):
        if (item[k : k + least] < 0).any():
            continue
        stretch, at = np.ascontiguousarray(item[k : k + least], dtype=np.int32).tobytes(), -1
        while (at := text.find(stretch, at + 1)) >= 0:
            if at % width == 0:
                return True
    return False


def leaked_words(doc: np.ndarray, item: np.ndarray, rare: np.ndarray) -> int:
    """Words of the item that the document holds in order at its best place or two; words without number are -1.

    Alignments are made until no place can be left; stock phrases, however many, are passed over and take no words of the item.
    """
    doc, found, places = doc.copy(), 0, []
    listed = np.unique(item[item >= 0])
    telling_words = listed[rare[listed]]
    rare_at = {k for k, w in enumerate(item.tolist()) if w >= 0 and rare[w]}

    def telling(span: set[int], told: set[int]) -> bool:
        wanted = len(span & rare_at)
        return wanted > 0 and len(told & span & rare_at) >= RARE_MATCHED * wanted

    while True:
        # A place holds a rare word of the item; what is farther from all of them than a place is long belongs to none.
        marks = np.flatnonzero(np.isin(doc, telling_words))
        if not len(marks):
            return found
        steps = np.zeros(len(doc) + 1, dtype=np.int32)
        np.add.at(steps, np.maximum(marks - 2 * len(item), 0), 1)
        np.add.at(steps, np.minimum(marks + 2 * len(item) + 1, len(doc)), -1)
        doc[np.cumsum(steps)[:-1] == 0] = -1
        # In LEAST_PLACE words with more than PENALTY matching ones to each change, so many match.
        if np.isin(doc, listed).sum() <= PENALTY * LEAST_PLACE // (PENALTY + 1):
            return found
        d0, d1, i0, i1, matches = _best(doc, item)
        doc[d0:d1] = -1
        span, told = set(range(i0, i1)), {k for _, k in matches}
        if not telling(span, told) or (len(span) < LEAST_PLACE and places):
            continue
        if len(told & rare_at) >= 2:
            found = max(found, len(span))
        for first, one, second, two in [x for s, t in places for x in ((s, t, span, told), (span, told, s, t))]:
            more = second - first
            if len(more) >= LEAST_PLACE and telling(more, two) and len((one & first | two & more) & rare_at) >= 2:
                found = max(found, len(first) + len(more))
        if found >= LEAST_WORDS:
            return found
        places.append((span, told))


def leaked(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, item): documents that hold at least so many words of an item in their order, at one place or two, with small changes.

    Null texts and ids give no row, nor do empty or blank texts; repeated rows give a row once; empty tables give an empty one. Texts
    are taken whole, however long. Equal items are all reported. Other columns play no part.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    groups = _item_words(items, item, item_text)
    if not groups:
        return spark.createDataFrame([], f"doc {doc_kind}, item {item_kind}")
    numbers = {w: k for k, w in enumerate(sorted({w for words in groups for w in words}))}
    size = len(numbers)
    coded = [np.array([numbers[w] for w in words], dtype=np.int32) for words in groups]
    shared = spark.sparkContext.broadcast((numbers, coded))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [[known.get(w, -1) for w in plain_words(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, type=pa.list_(pa.int32()))], names=["doc", "words"])

    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    texts = cut(spread(texts).mapInArrow(encode, f"doc {doc_kind}, words array<int>").where("size(words) >= 3"))

    # How often each test term, and in how many documents each test word, is in the training texts.
    terms = np.unique(np.concatenate([_terms(words, size) for words in coded]))
    terms_sent = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms_sent.value
        seen = np.zeros(len(known) + size, dtype=np.int64)
        for batch in batches:
            seen[: len(known)] += np.bincount(_places(batch, known, size)[2], minlength=len(known))
            words, offsets = _flat(batch)
            # Each word once a document.
            pairs = np.unique(np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offsets))[words >= 0] * size + words[words >= 0])
            seen[len(known) :] += np.bincount(pairs % size, minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["k", "n"])

    def counted(of: DataFrame) -> np.ndarray:
        out = np.zeros(len(terms) + size, dtype=np.int64)
        sums = of.mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row for each test term and word
        out[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
        return out

    total = counted(texts)
    seeds = _seed_rows(coded, terms, total[: len(terms)], size)
    looked_up = np.unique([t for t, _, _ in seeds])
    seeds_sent = spark.sparkContext.broadcast(terms[looked_up])

    # The index of the training texts: postings of the terms looked up, kept by document.
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, term = _places(batch, seeds_sent.value, size)
            held, ends = np.unique(row, return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, place)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(held)) for c in batch.columns), *lists], names=["doc", "words", "terms", "places"])

    index = cut(texts.mapInArrow(post, f"doc {doc_kind}, words array<int>, terms array<int>, places array<int>"))
    own = sorted((int(k), i, p) for k, (_, i, p) in zip(np.searchsorted(looked_up, [t for t, _, _ in seeds]), seeds, strict=True))
    starts = np.searchsorted([k for k, _, _ in own], np.arange(len(looked_up) + 1))
    lists_sent = spark.sparkContext.broadcast((starts, np.array([i for _, i, _ in own]), np.array([p for _, _, p in own])))

    # Intersection with the test items' own lists, offsets adjusted: all of a document's hits are in its row, so nothing is shuffled.
    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, item_of, at_of = lists_sent.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                lists = batch.column(2)
                offsets = lists.offsets.to_numpy()
                term = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                place = batch.column(3).values.to_numpy()[offsets[0] : offsets[-1]]
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                many = starts[term + 1] - starts[term]
                pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[term], many)
                row, item, at = np.repeat(row, many), item_of[pick], at_of[pick]
                diagonal = np.repeat(place, many) - at
                band = np.concatenate([diagonal // DRIFT * 2, (diagonal + DRIFT // 2) // DRIFT * 2 + 1])
                hits = np.stack([np.tile(row, 2), np.tile(item, 2), band, np.tile(at, 2)])
                hits = hits[:, np.lexsort(hits[::-1])]
                hits = hits[:, np.flatnonzero(np.r_[True, (hits[:, 1:] != hits[:, :-1]).any(axis=0)])] if hits.shape[1] else hits
                group = np.r_[True, (hits[:3, 1:] != hits[:3, :-1]).any(axis=0)].cumsum() - 1 if hits.shape[1] else np.zeros(0, dtype=np.int64)
                dense = hits[:, np.bincount(group)[group] >= LEAST_HITS] if hits.shape[1] else hits
                sure = np.bincount(group)[group] >= SURE_HITS if hits.shape[1] else np.zeros(0, dtype=bool)
                found: dict[int, dict[int, tuple[set[int], list[bool]]]] = {}
                for r, i, p, s in zip(dense[0].tolist(), dense[1].tolist(), dense[3].tolist(), sure[np.bincount(group)[group] >= LEAST_HITS].tolist() if hits.shape[1] else [], strict=True):
                    entry = found.setdefault(r, {}).setdefault(i, (set(), [False]))
                    entry[0].add(p)
                    entry[1][0] |= s
                rows = sorted(found)
                columns = [[list(found[r]) for r in rows], [[sorted(e[0]) for e in found[r].values()] for r in rows], [[e[1][0] for e in found[r].values()] for r in rows]]
                kinds = (pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), batch.column(1).take(pa.array(rows, type=pa.int64())), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=["doc", "words", "items", "ats", "sure"])

    dense = cut(index.mapInArrow(intersect, f"doc {doc_kind}, words array<int>, items array<int>, ats array<array<int>>, sure array<boolean>"))

    # How many documents each test word is in, of all that no item may be in: leaks, however many, make none of their words common.
    frequency = (total - counted(dense.select("doc", "words")))[len(terms) :]
    in_items = np.zeros(size)
    for words in coded:
        in_items[np.unique(words)] += 1
    rare = (frequency <= max(RARE_SHARE * (texts.count() - dense.count()), 2)) & (in_items <= max(RARE_ITEM_SHARE * len(coded), 2))
    rare |= np.array([w[0].isdigit() for w in sorted(numbers)])

    # Stock phrases hit one another everywhere; terms with a rare word do not.
    telling = [{p for p in range(len(words) - 2) if rare[words[p : p + 3]].any()} for words in coded]
    known_sent = spark.sparkContext.broadcast((rare, telling))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_words, (rare_words, telling_at) = shared.value[1], known_sent.value
        for batch in batches:
            keys, found = [], []
            for k in range(batch.num_rows):
                words = np.array(batch.column(1)[k].values, dtype=np.int32)
                for i, ats, sure in zip(*(batch.column(c)[k].as_py() for c in (2, 3, 4)), strict=True):
                    if (sure and copied(words, items_words[i], least)) or (not telling_at[i].isdisjoint(ats) and leaked_words(words, items_words[i], rare_words) >= least):
                        keys.append(k)
                        found.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, type=pa.int64())), pa.array(found, type=pa.int32())], names=["doc", "item"])

    # Few bytes, much work: shared out over all cores, whatever the sizes.
    tasks = 4 * spark.sparkContext.defaultParallelism
    cases = dense.repartition(tasks).mapInArrow(align, f"doc {doc_kind}, item int").distinct()
    names = spark.createDataFrame([(k, i) for k, ids in enumerate(groups.values()) for i in ids], f"item int, id {item_kind}")
    return cases.join(F.broadcast(names), "item").select("doc", F.col("id").alias("item")).distinct()
