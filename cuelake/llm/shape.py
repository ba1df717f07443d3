"""What a text is made of: sentences, items, rows and noise, told apart line by line."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import regex

#: A line's mark: bullet, number, time, count or evidence mark, each followed by white space.
MARK = regex.compile(r"\s*(?:[-–—*•·+>]|\(?\d{1,3}[.)]|\(\d{1,3}\)|\[?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\]?|\d{1,4}\s?[x×]|#{1,6})\s+")
LABEL = regex.compile(r"\p{L}[\p{L}\p{M}\d_-]*(?: \d+)?:\s+")
ENDS, CLOSERS = frozenset(".!?…。？！"), "\"'”’»)]"
#: Characters of an evidence mark in brackets that may follow the end of a sentence, at most.
EVIDENCE = 12
_CLOSED = r"[\"'”’»)\]]*(?:\s*\[[^\]\s]{1,12}\])?\s+"
_OPEN = r"[\"'“‘«¿¡(\[]*"
#: The end of a sentence before another one. A point behind a digit ends none before a small letter: it makes an ordinal.
INNER = regex.compile(rf"(?:[!?…。？！]|(?<!\d)\.|\.(?={_CLOSED}{_OPEN}[\p{{Lu}}\d])){_CLOSED}(?={_OPEN}[\p{{L}}\d])")
WORD = regex.compile(r"[\p{L}\p{M}\d]+(?:['’][\p{L}\p{M}]+)*")
#: The same words in plain ASCII, where the quicker engine suffices.
ASCII_WORD = re.compile(r"[a-zA-Z0-9]+(?:'[a-zA-Z]+)*")
ALPHA = regex.compile(r"\p{L}")
SOLID = regex.compile(r"[\p{L}\p{M}\p{N}]+")
STRANGE = regex.compile("[\x80-\xbf\ufffdÃÂðÐ]+")
VOWEL = regex.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿıœāēīōūăěůő]|[^\x00-ɏ]", regex.I)
TAG = regex.compile(r"<[^<>]*>")
VALUE = regex.compile(r"[-+±]?[\d.,:/]*\d[\d.,:/]*\s?[%€$£‰]?|-|–|—|n/?a|\?|∅", regex.I)
#: What parts fields: a character, or none for a gap of white space; and its pattern.
FIELDS = [(c, regex.compile(p)) for c, p in (("\t", r"\t"), ("|", r"\s*\|\s*"), (";", r"\s*;\s*"), ("", r"\s{2,}"), (",", r"\s*,\s*"))]
GAP = regex.compile(r"\s\s")
#: Lines of a table beside the main one, at least.
LEAST_RUN = 3
PARTING = regex.compile(r"[^\p{L}\p{M}\p{N}\s.'’\"%()\[\]]|(?<=\s)[-–—](?=\s)")
#: How many classes words are dealt out to where periods are sought.
CLASSES = 4
HEX = frozenset("0123456789abcdefABCDEF")
CONTROL = regex.compile(r"[\p{Cf}\p{Cc}--[\n\r\t]]", regex.V1)


def words_of(text: str) -> list[str]:
    """The words of a text in small letters."""
    low = text.lower()
    return ASCII_WORD.findall(low) if low.isascii() else WORD.findall(low)


def _fields(line: str, cut: regex.Pattern) -> list[str]:
    return [f for f in cut.split(line.strip().strip("|").strip()) if f]


def _alike(parted: dict[int, list[str]]) -> set[int]:
    """Which of some parted lines are rows of one table: of about one width, short fields, many of them values."""
    widths = [len(f) for f in parted.values()]
    usual = max(set(widths), key=widths.count)
    near = {i: f for i, f in parted.items() if abs(len(f) - usual) <= 1}
    n = sum(map(len, near.values()))
    values = sum(bool(VALUE.fullmatch(x.strip())) for f in near.values() for x in f)
    spoken = sum(len(x.split()) for f in near.values() for x in f)
    return set(near) if len(near) >= 2 and values >= 0.3 * n and spoken <= 2 * n else set()


def rows(lines: list[str]) -> set[int]:
    """Which lines are rows: parted alike into three or more short fields, of which many are values.

    Lines anywhere in the text make one table, that of the parting which most lines share; besides, lines that follow
    each other make tables of their own, as where a text holds several, each parted in its way.
    """
    best: set[int] = set()
    local: set[int] = set()
    for mark, cut in FIELDS:
        parted = {i: f for i, line in enumerate(lines) if (line.count(mark) >= 2 if mark else GAP.search(line)) and len(f := _fields(line, cut)) >= 3}
        if len(parted) < 2:
            continue
        found = _alike(parted)
        best = max(best, found, key=len)
        run: list[int] = []
        for i in [*parted, -1]:
            if run and (i != run[-1] + 1 or abs(len(parted[i]) - len(parted[run[0]])) > 1):
                if len(run) >= LEAST_RUN:
                    local |= found if len(run) == len(parted) else _alike({k: parted[k] for k in run})
                run = []
            run.append(i)
    return best | local


def repeats(words: list[str], least: float = 0.8) -> float:
    """The greatest share of words that equal the one a period before, over all periods up to a third of them; 0 if it isn't above ``least``.

    Words are dealt out to a few classes of about one size. Equal words are of one class, so the matches of classes, counted
    for all periods at once by Fourier transforms, bound those of words from above; only periods whose bound lies above
    what was found are counted word by word.
    """
    n = len(words)
    if n < 6:
        return 0.0
    counts = Counter(words)
    if len(counts) >= n - least * (n - n // 3):  # each match is a word that stands before: too few can match
        return 0.0
    classes, load = {}, [0] * CLASSES
    for w, c in counts.most_common():
        classes[w] = k = load.index(min(load))
        load[k] += c
    at = np.fromiter((classes[w] for w in words), np.int8, n)
    size = 1 << (2 * n - 1).bit_length()
    power = sum(np.abs(np.fft.rfft(at == k, size)) ** 2 for k in range(CLASSES))
    periods = np.arange(1, n // 3 + 1)
    bound = np.rint(np.fft.irfft(power, size)[1 : n // 3 + 1]) / (n - periods)
    ids = {w: i for i, w in enumerate(counts)}
    own, best = np.fromiter((ids[w] for w in words), np.int32, n), least
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= best:
            break
        p = int(periods[i])
        best = max(best, float(np.count_nonzero(own[p:] == own[:-p])) / (n - p))
    return best if best > least else 0.0


def items_of(line: str) -> int:
    """How many items a line without sentences holds that marks part, 0 if it isn't such a line."""
    words = len(line.split())
    for mark, n in Counter(PARTING.findall(line)).items():
        if n < 3 or words - n > 4.5 * (n + 1):  # n marks make n + 1 parts at most and take n words at most
            continue
        parts = [x for x in line.split(mark) if x.strip()]
        if len(parts) >= 4 and sum(len(x.split()) for x in parts) <= 4.5 * len(parts) and max(len(x.split()) for x in parts) <= 8:
            return len(parts)
    return 0


def ended(text: str) -> bool:
    """Whether a text ends as a sentence does: a mark of ENDS, closing quotes or brackets, perhaps an evidence mark."""
    t = text.rstrip()
    if t.rstrip(CLOSERS)[-1:] in ENDS and t:
        return bool(t.rstrip(CLOSERS))
    if not t.endswith("]"):
        return False
    at = t.rfind("[", 0, len(t) - 1)
    inside = t[at + 1 : -1]
    if at < 0 or not 1 <= len(inside) <= EVIDENCE or "]" in inside or len(inside.split()) != 1 or inside != inside.strip():
        return False
    return t[:at].rstrip().rstrip(CLOSERS)[-1:] in ENDS and bool(t[:at].rstrip().rstrip(CLOSERS))


def solid(text: str) -> int:
    """Letters, marks and digits."""
    return sum(map(str.isalnum, text)) if text.isascii() else sum(map(len, SOLID.findall(text)))


class _Spelling(dict):
    """Of a word: 1 if it counts as spelled by letters, 1 + 2**32 if it has no vowel either; 0 for others. Kept by worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        counts = len(word) >= 2 and (word.isalpha() or not any(map(str.isdigit, word)))
        self[word] = out = counts * (1 if VOWEL.search(word) else 1 | 1 << 32)
        return out


_spelling = _Spelling()


def noisy(text: str, words: list[str]) -> bool:
    """Neither sentences nor items nor rows: symbols, markup, or letters that spell nothing."""
    tokens = text.split()
    dense = sum(map(len, tokens))
    if dense == 0:
        return False
    if solid(text) < 0.5 * dense or "<" in text and sum(map(len, TAG.findall(text))) > 0.6 * len(text):
        return True
    if not text.isascii() and sum(map(len, STRANGE.findall(text))) > 0.25 * dense:
        return True
    if len(words) >= 8 and dense < 12 * len(tokens) and sum([len(t) <= 2 for t in tokens]) > 0.7 * len(tokens) and sum(len(t) <= 2 and HEX.issuperset(t) for t in tokens) > 0.7 * len(tokens):
        return True
    spelled = sum(map(_spelling.__getitem__, words))
    if (latin := spelled & 0xFFFFFFFF) >= 5 and spelled >> 32 > 0.5 * latin:
        return True
    if dense > 40 and max(map(len, tokens)) > 40 and sum(len(t) for t in tokens if len(t) > 40) > 0.5 * dense:
        return True
    odd = [t for t in tokens if not t.isalnum() and not t[:-1].isalnum() and len(t) > 2 or len(t) == 3 and not t.isalnum()]
    return len(odd) > 0.5 * len(tokens) and sum(solid(t) < 0.75 * len(t) for t in odd) > 0.5 * len(tokens)


def shape(text: str, share_common, words: list[str] | None = None) -> dict[str, float]:
    """Characters of prose, list, table and junk in ``text``, and numbers of sentences, items and rows.

    ``share_common`` gives the share of common words among some words. Lines that go on in small letters where the one
    before had no end belong to one paragraph, as in text wrapped at a width. ``words`` are those of the text in small
    letters, if they are known.
    """
    clean = CONTROL.sub("", text)
    words = words_of(clean) if words is None or len(clean) != len(text) else words
    text = clean
    lines = [x for x in regex.split(r"\r\n|[\n\r  \u0085]", text) if x.strip()]
    out = dict.fromkeys(("prose", "list", "table", "junk", "sentences", "items", "rows"), 0)
    if not lines:
        return out
    if repeats(words) > 0.8 or (len(lines) > 5 and len(set(map(str.strip, lines))) <= 0.2 * len(lines)):
        out["junk"] = len(text)
        return out
    table = rows(lines)
    parts: list[list] = []  # [text, marked]
    for i, line in enumerate(lines):
        if i in table:
            out["table"] += len(line)
            out["rows"] += 1
            parts.append(["", True])
            continue
        m = MARK.match(line)
        if table and not ALPHA.search(line):
            out["table"] += len(line)
            continue
        rest = line[m.end():] if m else line.strip()
        if not rest:
            continue
        if parts and parts[-1][0] and not m and not ended(parts[-1][0]) and rest[:1].islower() and not LABEL.match(rest):
            parts[-1][0] += " " + rest
        else:
            parts.append([rest, bool(m)])
    unsure: list[int] = []
    for body, marked in parts:
        if not body:
            continue
        label = LABEL.match(body)
        inner = body[label.end():] if label else body
        w = words if len(parts) == 1 and len(inner) == len(text) else words_of(inner)
        common = share_common(w)
        n = len(body)
        closed = ended(inner)
        loose = not closed and not INNER.search(inner)
        if noisy(inner, w):
            out["junk"] += n
        elif len(w) <= 7 and not (closed and (len(w) >= 3 or label)):
            if len(w) >= 6 and common >= 0.4 and not marked and not label:
                unsure.append(n)  # a short unmarked line of common words: an item among items, else a wrapped line
            else:
                out["list"] += n
                out["items"] += 1
        elif loose and (k := items_of(inner)):
            out["list"] += n
            out["items"] += k
        elif loose and len(w) >= 8 and common < 0.12:
            out["junk"] += n  # words that make no sentence
        else:
            out["prose"] += n
            out["sentences"] += 1 + len(INNER.findall(inner))
    listed = out["items"] >= len(unsure)
    out["list" if listed else "prose"] += sum(unsure)
    out["items" if listed else "sentences"] += len(unsure)
    return out


def lean(s: dict[str, float]) -> tuple[str | None, float]:
    """What a text is mostly if it isn't prose (``table``, ``list``, ``junk``), and how large a share of it isn't prose.

    One sentence ahead of items or rows is no prose: the share is 1 then. A text of prose only has none of the kinds,
    nor has one of sentences under a single heading or label.
    """
    rest = s["list"] + s["table"] + s["junk"]
    if rest == 0 or rest == s["list"] and s["items"] < 2 and s["sentences"]:
        return None, 0.0
    other = max(("table", "list", "junk"), key=lambda k: s[k])
    return other, 1.0 if s["sentences"] <= 1 and s["items"] + s["rows"] >= 2 else rest / (rest + s["prose"])


def kind_of(s: dict[str, float]) -> str:
    """``prose``, ``list``, ``table`` or ``junk`` by lines alone: what most of a text is."""
    other, share = lean(s)
    return other if other and share > 0.5 else "prose"
