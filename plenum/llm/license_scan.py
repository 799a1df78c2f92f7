"""License scans by patience alignment of texts with license templates.

A template is aligned with a stretch of text by anchors: words that are unique
in both, in the longest run that keeps the order of both; the gaps between
anchors are aligned the same way.  A template is found where the aligned words
cover enough of it and lie close together.

The stretches come from a few words of each template: from its rarest marked word
(see below), or without marks, since at least the share ``COVERAGE`` of its words
must be aligned, from the rarest words, one more than may be missing.

A stretch that reaches into further copies of its template holds no word once.
So the ranges around a probe word that hold one copy are aligned too: the
template's own length, and the text between the neighbouring occurrences of the
probe word, with the probe word as first anchor.

Notices of different licenses differ in a word or two.  Those words are marked in
the templates; they must be aligned, and a run of them must stand in the text
without another word between, or the template is not found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.license_texts import TEMPLATES

COVERAGE = 0.8
STRETCH = 1.5  # aligned words may lie over so many times the template's length

# a version such as 2.1 is one word, so it does not begin with the word 2
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)+|[a-z0-9]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def required_runs(template: str) -> list[tuple[int, int]]:
    """Ranges of words that stand in braces."""
    counts = [len(words(part)) for part in re.split(r"[{}]", template)]
    ends = list(accumulate(counts))
    return [(ends[k] - counts[k], ends[k]) for k in range(1, len(counts), 2)]


def _longest_rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for at, value in enumerate(values):
        place = bisect_left(tails, value)
        if place:
            back[at] = ends[place - 1]
        if place == len(tails):
            tails.append(value)
            ends.append(at)
        else:
            tails[place], ends[place] = value, at
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def _anchors(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Pairs of places of words unique in both ranges, in an order both share."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    place_b = {w: at for at, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
    pairs = [(at, place_b[w]) for at, w in enumerate(a[a0:a1], a0) if w in place_b and in_a[w] == 1]
    return [pairs[i] for i in _longest_rising([p for _, p in pairs])]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both."""
    aligned, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            aligned.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            aligned.append((a1, b1))
        anchors = _anchors(a, b, a0, a1, b0, b1) if a0 < a1 and b0 < b1 else []
        if not anchors:
            continue
        aligned += anchors
        bounds = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        ranges += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(bounds, bounds[1:])]
    return sorted(aligned)


class Templates:
    """Words of the templates, and the probe words that find stretches to align."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.words = [words(text) for _, text in templates]
        self.runs = [required_runs(text) for _, text in templates]
        self.required = [Counter(w for a, b in runs for w in ws[a:b]) for ws, runs in zip(self.words, self.runs)]
        spread = Counter(w for ws in self.words for w in set(ws))
        self.counts = [Counter(ws) for ws in self.words]
        self.probes: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, ws in enumerate(self.words):
            # words of few templates first, then long ones; the choice does not change what is found
            rank = lambda at, ws=ws: (spread[ws[at]], -len(ws[at]), ws[at], at)
            marked = [at for a, b in self.runs[number] for at in range(a, b)]
            # a marked word is always aligned; without one, any set of more words than may be missing has an aligned one
            chosen = [min(marked, key=rank)] if marked else sorted(range(len(ws)), key=rank)[: len(ws) - self.needed(number) + 1]
            for at in chosen:
                self.probes[ws[at]].append((number, at))

    def needed(self, number: int) -> int:
        return -int(-COVERAGE * len(self.words[number]) // 1)

    def probed(self, text: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Places of probe words of each template (in the text, in the template)."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for place, word in enumerate(text):
            for number, at in self.probes.get(word, ()):
                found[number].append((place, at))
        return found

    def stretch(self, number: int, first: int, length: int) -> tuple[int, int]:
        """Range of text words in which the template may lie that would begin at ``first``, had it no gaps."""
        size = len(self.words[number])
        slack = int((STRETCH - 1) * size) + 4
        return max(0, first - slack), min(length, first + size + slack)

    def stretches(self, text: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Ranges of text words in which each template may lie."""
        return defaultdict(list, {n: [self.stretch(n, place - at, len(text)) for place, at in found] for n, found in self.probed(text).items()})

    def _enough(self, text: list[str], number: int, start: int, stop: int) -> bool:
        """Whether a range has as many words of a template as must be aligned, in any order."""
        own, there = self.counts[number], Counter(text[start:stop])
        if any(there[w] < n for w, n in self.required[number].items()):
            return False
        return sum(min(n, own[w]) for w, n in there.items() if w in own) >= self.needed(number)

    def _named(self, number: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether all required words are aligned, each run without a word between."""
        place = {at: p for p, at in pairs} if self.runs[number] else {}
        return all(
            a in place and all(place.get(at) == place[a] + at - a for at in range(a, b)) for a, b in self.runs[number]
        )

    def _hits(self, text: list[str], number: int, found: list[tuple[int, int]]) -> set[tuple[int, int, int]]:
        """(first word, end word, aligned words) of a template, from the places of its probe words."""
        template, size = self.words[number], len(self.words[number])
        hits: set[tuple[int, int, int]] = set()
        whole: set[int] = set()  # first words of copies without a gap

        def add(pairs: list[tuple[int, int]]) -> None:
            if len(pairs) >= self.needed(number) and self._named(number, pairs):
                first, last = pairs[0][0], pairs[-1][0] + 1
                if last - first <= STRETCH * size + 4:
                    hits.add((first, last, len(pairs)))
                    if len(pairs) == last - first == size:
                        whole.add(first)

        def aligned(start: int, stop: int, low: int, high: int) -> list[tuple[int, int]]:
            return [(start + p, low + q) for p, q in align(text[start:stop], template[low:high])]

        likely: dict[int, tuple[int, int]] = {}
        for first in dict.fromkeys(place - at for place, at in found):
            start, stop = self.stretch(number, first, len(text))
            if self._enough(text, number, start, stop):
                likely[first] = start, stop
        for start, stop in dict.fromkeys(likely.values()):
            add(aligned(start, stop, 0, size))
        for first in likely:
            if first not in whole:
                add(aligned(max(0, first), min(len(text), first + size), 0, size))
        in_text: dict[str, list[int]] = defaultdict(list)
        for place in dict.fromkeys(place for place, _ in found):
            in_text[text[place]].append(place)
        order = sorted(whole)
        for place, at in found:
            if place - at not in likely:
                continue
            near = bisect_right(order, place) - 1
            if near >= 0 and place < order[near] + size:
                continue  # nothing aligns better than a copy without a gap
            start, stop = likely[place - at]
            # the other occurrences of the word in this copy, as many as the template has, stay in
            spots, i = in_text[text[place]], template[:at].count(text[place])
            j, many = bisect_left(spots, place), self.counts[number][text[place]]
            if j - i > 0:
                start = max(start, spots[j - i - 1] + 1)
            if j - i + many < len(spots):
                stop = min(stop, spots[j - i + many])
            add([*aligned(start, place, 0, at), (place, at), *aligned(place + 1, stop, at + 1, size)])
        return hits

    def scan(self, text: list[str]) -> list[tuple[int, int, str, int, float]]:
        """(first word, end word, name, aligned words, coverage), apart from each other, in order."""
        hits = []
        for number, found in self.probed(text).items():
            for first, last, aligned in self._hits(text, number, found):
                hits.append((-aligned, -aligned / len(self.words[number]), last - first, first, last, self.names[number]))
        kept: list[tuple[int, int, str, int, float]] = []
        for aligned, share, _, first, last, name in sorted(set(hits)):  # more aligned words win, then more of the template
            at = bisect_left(kept, (first,))
            if (at == 0 or kept[at - 1][1] <= first) and (at == len(kept) or last <= kept[at][0]):
                kept.insert(at, (first, last, name, -aligned, -share))
        return kept


_SPAN = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)


def license_spans(text: Column, templates=TEMPLATES) -> Column:
    """Array of (license, start, end, coverage) per text; offsets are code points, ends exclusive."""
    known = Templates(templates)
    probes = frozenset(known.probes)

    @F.pandas_udf(T.ArrayType(_SPAN))
    def spans(texts: pd.Series) -> pd.Series:
        rows = []
        for raw in texts:
            text = (raw or b"").decode("utf-8", "replace")
            # lower-casing A-Z alone keeps every character in its place
            low = text.translate(_LOWER)
            found = _WORD.findall(low)
            row = []
            if not probes.isdisjoint(found):
                places = [m.span() for m in _WORD.finditer(low)]
                row = [(name, places[first][0], places[last - 1][1], share) for first, last, name, _, share in known.scan(found)]
            rows.append([dict(zip(_SPAN.names, span)) for span in row])
        return pd.Series(rows, dtype=object)

    return spans(text.cast("binary"))


_LOWER = {code: code + 32 for code in range(65, 91)}


def scan(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document row: doc_id, found (array of spans).

    Null and empty texts have none; repeated rows get equal rows; a null doc_id
    is returned as such; other columns are not touched; no rows give no rows.
    """
    return documents.select("doc_id", license_spans(F.col("text"), templates).alias("found"))
