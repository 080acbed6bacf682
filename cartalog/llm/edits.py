"""Edit distances that are true metrics, and trees over them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: The rows of letters of keyboards; neighbours in them are mistyped for each other.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm"), ("qwertzuiopü", "asdfghjklöä", "yxcvbnm"), ("azertyuiop", "qsdfghjklm", "wxcvbn")


def _neighbours() -> set[tuple[str, str]]:
    pairs = set()
    for rows in KEY_ROWS:
        for k, row in enumerate(rows):
            near = list(zip(row, row[1:], strict=False))
            if k:
                near += [(a, b) for i, a in enumerate(rows[k - 1]) for b in row[max(0, i - 1) : i + 1]]
            pairs.update(near)
            pairs.update((b, a) for a, b in near)
    return pairs


NEIGHBOURS = _neighbours()


def distance(a: str, b: str, most: int | None = None) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions, a metric; most + 1 as soon as it is more than most."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    far = len(a) + len(b)
    last: dict[str, int] = {}
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match, least = 0, far
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            else:
                cost = 1
            here = min(table[i][j] + cost, table[i + 1][j] + 1, table[i][j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1))
            table[i + 1][j + 1] = here
            least = min(least, here)
        last[a[i - 1]] = i
        # A later row can be less only by a transposition over it; each row passed by costs one.
        if most is not None and least > most + 1:
            return most + 1
    return table[-1][-1]


def typing_cost(a: str, b: str) -> float:
    """How unlikely a is as a mistyped b: neighbouring keys, doubled and swapped letters cost half; for telling ties apart."""
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                rows[i][j] = float(i + j)
                continue
            same = a[i - 1] == b[j - 1]
            best = rows[i - 1][j - 1] + (0.0 if same else 0.5 if (a[i - 1], b[j - 1]) in NEIGHBOURS else 1.0)
            best = min(best, rows[i - 1][j] + (0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.0), rows[i][j - 1] + (0.9 if i else 1.0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 0.5)
            rows[i][j] = best
    return rows[-1][-1]


class BkTree:
    """Burkhard-Keller tree: children by their distance from the node; the triangle inequality tells which can hold a match."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.root: tuple[str, dict] | None = None
        for entry in entries:
            if self.root is None:
                self.root = (entry, {})
                continue
            node = self.root
            while True:
                d = distance(entry, node[0])
                if d == 0:
                    break
                if d not in node[1]:
                    node[1][d] = (entry, {})
                    break
                node = node[1][d]

    def within(self, word: str, most: int) -> Iterator[tuple[int, str]]:
        """Every entry at most so far from the word, with its distance."""
        todo = [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            d = distance(word, entry)
            if d <= most:
                yield d, entry
            todo.extend(child for step, child in children.items() if d - most <= step <= d + most)
