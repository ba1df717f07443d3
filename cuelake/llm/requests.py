"""Requests as they are compared: what is left of a query's words when slips and introductions are taken away."""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

import regex
import xxhash

WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*")
HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}\p{Cc}--[\n\r\t]]", regex.V1)

#: Words that only introduce or fill a request, or that any request may have or lack. English, Turkish.
INTRODUCING = frozenset(
    """a an the find show me us search for look where is are when do does did we i you see jump go to locate get which scene moment
    what point part at in on of with please hi hey hello ok okay um uh er so well just can could would like want there that this
    's ara bul goster nerede ne zaman su ani an sey lutfen selam merhaba hani iste yani bir mi""".split()
)
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
#: Number words below a hundred, English and Turkish (without marks over letters).
NUMBERS = {w: n for n, w in enumerate(_UNITS.split())} | {w: 10 * n for n, w in enumerate(_TENS.split(), 2)}
NUMBERS |= {w: n for n, w in enumerate("iki uc dort bes alti yedi sekiz dokuz on".split(), 2)} | {w: 10 * n for n, w in enumerate("yirmi otuz kirk elli altmis yetmis seksen doksan".split(), 2)}
#: The edit distance up to which two unknown words may be slips of one word, for words of at least so many letters.
SLIPS = {1: 4, 2: 7}
#: How many readings a request has at most.
READINGS = 64


def folded(text: str) -> str:
    """Small letters without marks and invisible characters; compatibility forms become plain ones."""
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return HIDDEN.sub("", t).replace("ı", "i").replace("’", "'")


def words(text: str | None) -> list[str]:
    """Words of a text, number words as digits, a word that is said twice in a row once."""
    out: list[str] = []
    tens = False
    for w in WORD.findall(folded(text or "")):
        w = w.removesuffix("'s")
        if w == "on" or w not in NUMBERS:
            n = None
        else:
            n = NUMBERS[w]
        if n is not None and tens and 0 < n < 10:
            out[-1] = str(int(out[-1]) + n)
            tens = False
            continue
        tens = n is not None and n >= 20 and n % 10 == 0
        w = str(n) if n is not None else w.lstrip("0") or "0" if w.isdigit() else w
        if not out or out[-1] != w:
            out.append(w)
    return out


def shortened(w: str) -> set[str]:
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def distance(a: str, b: str, most: int) -> int:
    """Edits (one letter more, less or other, or two neighbours swapped) from a to b; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def twice_shortened(w: str) -> set[str]:
    return {w[:i] + w[i + 1 : j] + w[j + 1 :] for i in range(len(w)) for j in range(i + 1, len(w))}


def variants(w: str) -> set[str]:
    """The forms of ``w`` that lack as many letters as SLIPS allows edits: words within that distance share one."""
    out = {w}
    if len(w) >= SLIPS[1]:
        out |= shortened(w)
    if len(w) >= SLIPS[2]:
        out |= twice_shortened(w)
    return out


class Speller:
    """Sets right slips in the common words of a corpus.

    ``counts`` are the texts that have each established word, a bounded set. An unknown word may stand for each established
    word within one edit; if there is none, and it is long enough, for each within two; if there is none either, for two
    words that it is run together from, of which one at least is established and the other may hide a slip as well. An established word may stand for another one within one edit that
    is ``ratio`` times as frequent: in a large corpus, frequent slips are established words as well. Introducing words of
    FAR letters or more are set right within one edit however rare they are.
    """

    #: Letters that an unknown word and the established one must have to be taken for one with two edits between them.
    FAR = 5

    def __init__(self, counts: dict[str, int], ratio: int = 40):
        self.counts, self.ratio = counts, ratio
        self.near: dict[str, list[str]] = defaultdict(list)
        rare = [w for w in sorted(INTRODUCING) if len(w) >= self.FAR and w.isalpha() and w not in counts]
        for w in rare:
            for v in {w} | shortened(w):
                self.near[v].append(w)
        for w in counts:
            if len(w) >= 4 and w.isalpha():
                for v in {w} | shortened(w) | (twice_shortened(w) if len(w) >= self.FAR else set()):
                    self.near[v].append(w)
        self.forms = frozenset(self.near)
        self.logs = {w: math.log(n) for w, n in counts.items()}
        self.kept: dict[str, list[tuple[str, ...]]] = {}

    def _within(self, w: str, forms: set[str], most: int) -> list[str]:
        """Words to set right to at a distance of 1 to ``most`` (1 if not established) that share one of ``forms``, the most frequent first."""
        found = {c for v in forms & self.forms for c in self.near[v] if c != w and distance(w, c, most) <= (most if c in self.counts else 1)}
        return sorted(found, key=lambda c: (-self.counts.get(c, 0), c))

    def _options(self, w: str) -> list[tuple[str, ...]]:
        mine, forms = self.counts.get(w, 0), {w} | shortened(w)
        one = self._within(w, forms, 1)
        if mine:
            return [*((c,) for c in one if self.counts.get(c, 0) >= self.ratio * mine), (w,)]
        if not one and len(w) >= self.FAR:
            one = [c for c in self._within(w, forms | twice_shortened(w), 2) if len(c) >= self.FAR]
        if one:
            return [*((c,) for c in one), (w,)]
        halves = [(w[:i], w[i:]) for i in range(2, len(w) - 1)]
        cuts = sorted((h for h in halves if h[0] in self.counts and h[1] in self.counts), key=lambda h: -min(self.counts[x] for x in h))
        named = [h for h in halves if any(len(x) >= 3 and x in self.counts and len(y) >= 4 and y not in self.counts for x, y in (h, h[::-1]))]
        mended = [h for x, y in halves for h in (*((x, c) for c in self._mended(x, y)), *((c, y) for c in self._mended(y, x)))]
        return [*cuts, *named, *mended, (w,)]

    def _mended(self, known: str, other: str) -> list[str]:
        """What ``other`` may be a slip of, one edit away, if it is run together with an established word."""
        if known not in self.counts or other in self.counts or len(other) < self.FAR:
            return []
        return [c for c in self._within(other, {other} | shortened(other), 1) if len(c) >= self.FAR]

    def __call__(self, w: str) -> list[tuple[str, ...]]:
        """What ``w`` may stand for, the most probable first."""
        if len(w) < 3 or not w.isalpha():
            return [(w,)]
        if w not in self.kept:
            if len(self.kept) > 300_000:
                self.kept.clear()
            self.kept[w] = self._options(w)
        return self.kept[w]

    def line(self, ws: list[str]) -> list[list[tuple[str, ...]]]:
        """What each of ``ws`` may stand for; two neighbours that only together make an established word are one."""
        out, i = [], 0
        while i < len(ws):
            if i + 1 < len(ws) and ws[i] + ws[i + 1] in self.counts and not (ws[i] in self.counts and ws[i + 1] in self.counts):
                out.append([(ws[i] + ws[i + 1],)])
                i += 2
            else:
                out.append(self.kept.get(ws[i]) or self(ws[i]))
                i += 1
        return out

    def doubtful(self, w: str) -> bool:
        """Whether ``w`` may hide a slip that nothing sets right, as a name may: letters only, long enough, not established."""
        return len(w) >= SLIPS[1] and w.isalpha() and w not in self.counts


class Reading(NamedTuple):
    """One way to understand a request: its sure words and its doubtful ones, each sorted."""

    sure: list[str]
    doubtful: list[str]


def readings(ws: list[str], speller: Speller) -> list[Reading]:
    """The readings of a request's words without those that only introduce it, which tell it from other requests.

    Words are sorted: where in the sentence the place stands doesn't matter. A request of introducing words only keeps
    them all; one without words has no reading. If words may stand for several others, each combination is a reading,
    up to READINGS; in longer products the words beyond stand for the most probable one.
    """
    if not ws:
        return []
    line, many = speller.line(ws), 1
    for i, options in enumerate(line):
        if many * len(options) > READINGS:
            line[i] = options[:1]
        else:
            many *= len(options)
    out: list[Reading] = []
    for chosen in product(*line):
        right = [w for o in chosen for w in o]
        kept = [w for i, w in enumerate(right) if w not in INTRODUCING and (not i or right[i - 1] != w)] or right
        r = Reading([], [])
        for w in sorted(kept):
            (r.doubtful if speller.doubtful(w) else r.sure).append(w)
        if r not in out:
            out.append(r)
    return out


def gram_hash(parts: Sequence[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def ngrams(sure: list[str], n: int = 5) -> list[tuple[str, ...]]:
    """The runs of ``n`` words; all words as one run if there are fewer."""
    return [tuple(sure[i : i + n]) for i in range(max(1, len(sure) - n + 1))]


def rarest(grams: list[tuple[str, ...]], logs: dict[str, float]) -> tuple[str, ...]:
    """The gram whose words are the rarest taken together, by the logarithms of their counts; 0 for words without."""
    return min(grams, key=lambda g: (sum([logs.get(w, 0.0) for w in g]), g)) if len(grams) > 1 else grams[0]


def same_word(a: str, b: str) -> bool:
    """Whether two doubtful words may be one but for slips."""
    most = max((d for d, n in SLIPS.items() if min(len(a), len(b)) >= n), default=0)
    return a == b or most > 0 and distance(a, b, most) <= most


def slips_only(a: Sequence[str], b: Sequence[str]) -> bool:
    """Whether doubtful words can be paired so that all pairs are one word but for slips (augmenting paths)."""
    if len(a) != len(b):
        return False
    taken: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j, w in enumerate(b):
            if j not in tried and same_word(a[i], w):
                tried.add(j)
                if j not in taken or place(taken[j], tried):
                    taken[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(a)))
