"""Evidence for questions: chunks, units and sections of a transcript, budgeted selection, and what an answer may cite."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.operators import vectors
from cuelake.operators.metrics import quantiles
from cuelake.operators.timeline import regions
from cuelake.storage import materialize

#: Limits of chunks, units, sections, packages and summaries, in seconds and characters.
CHUNK_S, CHUNK_CHARS = 45.0, 900
FINE_S, FINE_CHARS = 30.0, 600
SECTION_LEAST_S, SECTION_MOST_S, PAUSE_S, TOPIC = 35.0, 180.0, 3.0, 0.40
PACKAGE_UNITS, PACKAGE_CHARS = 5, 3600
SUMMARY_UNITS, SUMMARY_CHARS = 2, 420


def folded_by(df: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs ``step`` over the ordered rows of each group, for choices that depend on the choices before.

    A group is one medium, so its rows are bounded by its length; groups spread over all tasks.
    """
    return df.groupBy(*keys).applyInPandas(lambda p: step(p.sort_values(order, kind="stable").reset_index(drop=True)), schema)


def chunk_bounds(start: np.ndarray, end: np.ndarray, chars: np.ndarray, seconds: float = CHUNK_S, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Half-open ranges of segments: each as long as time and characters allow, one segment shared with the next."""
    n, i = len(start), 0
    while i < n:
        j, total = i, 0
        while j < n:
            grown = total + int(chars[j]) + (j > i)
            if j > i and (grown > most or end[j] - start[i] > seconds):
                break
            total, j = grown, j + 1
        yield i, j
        if j >= n:
            return
        i += max(1, j - i - 1)


def unit_bounds(start: np.ndarray, end: np.ndarray, chars: np.ndarray, seconds: float = FINE_S, most: int = FINE_CHARS) -> Iterator[tuple[int, int]]:
    """Half-open ranges that follow each other without a shared segment."""
    i, total = 0, 0
    for j in range(len(start)):
        if j > i and (total + int(chars[j]) + 1 > most or end[j] - start[i] > seconds):
            yield i, j
            i, total = j, 0
        total += int(chars[j]) + (j > i)
    if len(start):
        yield i, len(start)


def _packed(bounds, letter: str, stripped: bool):
    def step(p: pd.DataFrame) -> pd.DataFrame:
        key, text = p["video_id"].iloc[0], p["text"]
        chars = (text.str.strip() if stripped else text).str.len().to_numpy()
        rows = []
        for k, (i, j) in enumerate(bounds(p["start_s"].to_numpy(), p["end_s"].to_numpy(), chars), 1):
            rows.append((key, f"{letter}{k:0{3 if letter == 'E' else 4}d}", round(float(p["start_s"][i]), 3), round(float(p["end_s"][j - 1]), 3), " ".join(t.strip() for t in text[i:j]), p["segment_id"][i:j].tolist()))
        return pd.DataFrame(rows, columns=["video_id", "unit_id", "start_seconds", "end_seconds", "text", "segment_ids"])

    return step


UNIT = "video_id string, unit_id string, start_seconds double, end_seconds double, text string, segment_ids array<bigint>"


def chunks(segments: DataFrame) -> DataFrame:
    """Overlapping chunks of each video, at most 45 s and 900 characters as stored; a longer segment is a chunk of its own."""
    return folded_by(segments, ["video_id"], ["start_s", "segment_id"], _packed(chunk_bounds, "E", False), UNIT)


def fine_units(segments: DataFrame) -> DataFrame:
    """Units of each video without overlap, at most 30 s and 600 characters without outer white space."""
    return folded_by(segments, ["video_id"], ["start_s", "segment_id"], _packed(unit_bounds, "F", True), UNIT)


def section_groups(start: np.ndarray, end: np.ndarray, similarity: np.ndarray) -> list[list[int]]:
    """Units grouped into sections; ``similarity[i]`` is that of unit i to the one before.

    A section ends before it would pass 180 s, or from 35 s on at a pause of 3 s or a change of topic. A short last
    section joins the one before if both fit.
    """
    if not len(start):
        return []
    groups = [[0]]
    for i in range(1, len(start)):
        first = start[groups[-1][0]]
        settled = end[i - 1] - first >= SECTION_LEAST_S
        if end[i] - first > SECTION_MOST_S or settled and (start[i] - end[i - 1] >= PAUSE_S or similarity[i] < TOPIC):
            groups.append([])
        groups[-1].append(i)
    if len(groups) > 1 and end[groups[-1][-1]] - start[groups[-1][0]] < SECTION_LEAST_S and end[groups[-1][-1]] - start[groups[-2][0]] <= SECTION_MOST_S:
        last = groups.pop()
        groups[-1] += last
    return groups


def summary_of(texts: list[str], vectors: np.ndarray) -> list[int]:
    """Positions of the texts nearest to the centroid, two at most and 420 characters, in order; the first if none fits."""
    mid = vectors.mean(0)
    mid = mid / (np.linalg.norm(mid) or 1)
    chosen, used = [], 0
    for i in sorted(range(len(texts)), key=lambda i: (-round(float(vectors[i] @ mid), 9), i)):
        size = len(texts[i].strip())
        if len(chosen) < SUMMARY_UNITS and used + size <= SUMMARY_CHARS:
            chosen.append(i)
            used += size
    return sorted(chosen) or [0]


SECTION = "video_id string, section_id string, start_seconds double, end_seconds double, fine_ids array<string>, summary string, summary_ids array<string>, text string"


def sections(units: DataFrame) -> DataFrame:
    """Sections of each video over ``(video_id, unit_id, start_seconds, end_seconds, text, embedding)``, with a summary."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        v = np.array(p["embedding"].tolist(), np.float64)
        near = np.r_[1.0, (v[1:] * v[:-1]).sum(1)]
        rows = []
        for k, g in enumerate(section_groups(p["start_seconds"].to_numpy(), p["end_seconds"].to_numpy(), near), 1):
            texts, ids = p["text"][g].tolist(), p["unit_id"][g].tolist()
            kept = summary_of(texts, v[g])
            rows.append((p["video_id"][0], f"S{k:04d}", float(p["start_seconds"][g[0]]), float(p["end_seconds"][g[-1]]), ids, " ".join(texts[i].strip() for i in kept), [ids[i] for i in kept], " ".join(texts)))
        return pd.DataFrame(rows, columns=["video_id", "section_id", "start_seconds", "end_seconds", "fine_ids", "summary", "summary_ids", "text"])

    return folded_by(units, ["video_id"], ["start_seconds", "unit_id"], step, SECTION)


def within_budget(ranked: Column, units: int = PACKAGE_UNITS, chars: int = PACKAGE_CHARS, dedup: bool = True) -> Column:
    """Of a ranked array of ``(id, chars, segments)``, the ids that fit: what doesn't fit is skipped, not the end.

    Units with the segments of one already taken are skipped as well. The array is one query's bounded list.
    """
    empty = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<array<bigint>>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        segs = F.array_sort(x.segments)
        full = (F.size(acc.ids) >= units) | (acc.used + x.chars > chars)
        if dedup:
            full = full | F.exists(acc.seen, lambda s: s == segs)
        return F.when(full, acc).otherwise(F.struct(F.array_append(acc.ids, x.id).alias("ids"), (acc.used + x.chars).alias("used"), F.array_append(acc.seen, segs).alias("seen")))

    return F.aggregate(ranked, empty, step, lambda acc: acc.ids)


def packages(ranked: DataFrame, keys: list[str], ident: str, dedup: bool = True) -> DataFrame:
    """``(*keys, selected, characters)``: the package of each query from rows ``(*keys, rank, ident, text, segment_ids)``."""
    item = F.struct("rank", F.col(ident).alias("id"), F.length("text").cast("bigint").alias("chars"), F.col("segment_ids").alias("segments"))
    g = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("l"))
    g = g.withColumn("selected", within_budget(F.col("l"), dedup=dedup))
    used = F.aggregate(F.filter("l", lambda x: F.array_contains(F.col("selected"), x.id)), F.lit(0).cast("bigint"), lambda a, x: a + x.chars)
    return g.select(*keys, "selected", used.alias("characters"))


def mmr(scores: np.ndarray, times: np.ndarray, vectors: np.ndarray, weight: float, limit: int) -> list[int]:
    """Positions by marginal relevance: the first, then whatever gains most from its score less its likeness to the chosen."""
    if not len(scores):
        return []
    chosen, left = [0], list(range(1, len(scores)))
    likeness = vectors @ vectors.T
    while left and len(chosen) < limit:
        best = max(left, key=lambda i: (round(weight * scores[i] - (1 - weight) * likeness[i, chosen].max(), 9), scores[i], -times[i]))
        chosen.append(best)
        left.remove(best)
    return chosen


def diversified(candidates: DataFrame, keys: list[str], weight: float, limit: int) -> DataFrame:
    """``(*keys, candidate_id, rank)``: candidates of each list ``(rank, ts, score, embedding)`` in order of marginal relevance."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        at = mmr(p["score"].to_numpy(), p["ts"].to_numpy(), np.array(p["embedding"].tolist(), np.float64), weight, limit)
        out = p.loc[at, [*keys, "candidate_id"]].copy()
        out["rank"] = np.arange(1, len(at) + 1)
        return out

    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in [*keys, "candidate_id"])
    return folded_by(candidates, keys, ["rank"], step, f"{kinds}, rank bigint")


_SPACE = regex.compile(r"\s+")
#: Fixed value: a term of recognised screen text.
_TERM = regex.compile(r"[^\W_]+(?:[-.'/:][^\W_]+)*|[-]{1,2}[a-z0-9-]+")


def screen_text(text: str | None) -> str:
    """Recognised text in compatibility form, without soft hyphens and byte order marks, white space single."""
    t = unicodedata.normalize("NFKC", text or "").replace("­", "").replace("﻿", "")
    return _SPACE.sub(" ", t).strip()


def screen_terms(text: str | None) -> str:
    return " ".join(_TERM.findall(screen_text(text).casefold()))


def likeness(a: str, b: str) -> float:
    """Of two texts' terms: the share of lengths if one holds the other, else the ratio of matching blocks; 0 for none."""
    a, b = screen_terms(a), screen_terms(b)
    if not a or not b:
        return 0.0
    return min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else SequenceMatcher(None, a, b).ratio()


SCREEN = "video_id string, evidence_id string, start_seconds double, end_seconds double, text string, confidence double, frame_ids array<string>"


def merged_screens(frames: DataFrame, similar: float = 0.88, gap: float = 5.25) -> DataFrame:
    """Spans of repeated screen text from frames ``(video_id, frame_id, ts, text, confidence)``.

    A frame joins the span before it if it comes within ``gap`` of that span's end and its text is like the span's; the
    longer text stays, and the confidence is the mean of the span's and the frame's, pair by pair. Blank frames are
    passed over.
    """

    def step(p: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for f, t, raw, c in zip(p["frame_id"], p["ts"], p["text"], p["confidence"]):
            text, c = screen_text(raw), None if c is None or c != c else float(c)
            if not text:
                continue
            if out and t - out[-1][1] <= gap and likeness(out[-1][2], text) >= similar:
                last = out[-1]
                known = [x for x in (last[3], c) if x is not None]
                last[1], last[3] = t, sum(known) / len(known) if known else None
                if len(screen_terms(text)) > len(screen_terms(last[2])):
                    last[2] = text
                last[4].append(f)
            else:
                out.append([t, t, text, c, [f]])
        rows = [(p["video_id"].iloc[0], f"ocr-{k:05d}", *r) for k, r in enumerate(out, 1)]
        return pd.DataFrame(rows, columns=["video_id", "evidence_id", "start_seconds", "end_seconds", "text", "confidence", "frame_ids"])

    return folded_by(frames, ["video_id"], ["ts", "frame_id"], step, SCREEN)


#: Texts of so many characters or more have popular characters, which start no match (SequenceMatcher's rule).
POPULAR = 200


class Windows:
    """The runs of one to eight lines of each of several units, for many references.

    Likeness is SequenceMatcher's ratio of the terms of a reference and of a run. Runs are sorted by their length, those
    of a reference's length come first, and no run is compared to its end that can't reach the best one so far.
    """

    def __init__(self, units: Sequence[Sequence[str]]):
        self.units = units
        runs = []
        for u, lines in enumerate(units):
            terms = [screen_terms(x) for x in lines]
            for i in range(len(lines)):
                text = ""
                for j in range(i, min(len(lines), i + 8)):
                    text = f"{text} {terms[j]}" if text and terms[j] else text or terms[j]
                    runs.append((len(text), (u, i, j + 1), text))
        self.runs = sorted(runs)
        self.lengths = [n for n, _, _ in self.runs]
        self.rare: dict[int, dict[str, list[int]]] = {}

    def _matched(self, a: str, k: int, need: float) -> int:
        """Characters of all matching blocks of ``a`` and run k; 0 if they are fewer than ``need``."""
        b = self.runs[k][2]
        if len(b) < POPULAR:
            return _matched(a, b, need)
        if k not in self.rare:
            counts = Counter(b)
            places = {c: [] for c, n in counts.items() if n <= len(b) // 100 + 1}
            for j, c in enumerate(b):
                if c in places:
                    places[c].append(j)
            self.rare[k] = places
        return _matched_by_rare(a, b, self.rare[k], need)

    def best(self, reference: str | None) -> tuple[int, str, float]:
        """The unit, the run most like ``reference``, of equals the first, and its likeness; the first unit and an empty run if none is."""
        a, most, at = screen_terms(reference), 0.0, (0, 0, 0)
        size = len(a)
        hi = bisect_left(self.lengths, size)
        lo = hi - 1
        while size:
            n = self.lengths[lo] if lo >= 0 else 0
            low = 2.0 * n / (n + size)
            high = 2.0 * size / (self.lengths[hi] + size) if hi < len(self.lengths) else 0.0
            if max(low, high) < most or not max(low, high):
                break
            k, lo, hi = (lo, lo - 1, hi) if low >= high else (hi, lo, hi + 1)
            total = self.lengths[k] + size
            r = 2.0 * self._matched(a, k, most * total / 2 - 1e-6) / total
            if r > most or r == most > 0 and self.runs[k][1] < at:
                most, at = r, self.runs[k][1]
        u, i, j = at
        return u, " ".join(self.units[u][i:j]) if most else "", most


def _matched(a: str, b: str, need: float) -> int:
    """Characters of all matching blocks, none of them popular; 0 if they are fewer than ``need``.

    The longest block, the first in a and then in b, is grown along a; then what lies before it and after it is matched.
    """
    todo, found, most = [(a, b)], 0, min(len(a), len(b))
    while todo:
        a, b = todo.pop()
        i = n = at = 0
        end = len(a)
        while i + n < end:
            if a[i : i + n + 1] in b:
                at = i
                n += 1
            else:
                i += 1
        most -= min(end, len(b))
        if n:
            j = b.find(a[at : at + n])
            left, right = min(at, j), min(end - at, len(b) - j) - n
            most, found = most + n + left + right, found + n
            if most < need:
                return 0
            one, two = (a[:at], b[:j]), (a[at + n :], b[j + n :])
            if left > right:  # the larger part comes next, as it takes away the most
                if right:
                    todo.append(two)
                todo.append(one)
            else:
                if left:
                    todo.append(one)
                if right:
                    todo.append(two)
        elif most < need:
            return 0
    return found


def _matched_by_rare(a: str, b: str, places: dict[str, list[int]], need: float) -> int:
    """As ``_matched``, but a block starts as the longest run of characters that ``places`` has and is then grown both ways."""
    todo, found, most = [(0, len(a), 0, len(b), [(i, places[c]) for i, c in enumerate(a) if c in places])], 0, min(len(a), len(b))
    while todo:
        alo, ahi, blo, bhi, rare = todo.pop()
        n, before, last = 0, {}, -2
        for i, js in rare:
            now = {}
            for j in js:
                if blo <= j < bhi:
                    k = now[j] = before.get(j - 1, 0) + 1 if i == last + 1 else 1
                    if k > n:
                        n, x, y = k, i - k + 1, j - k + 1
            before, last = now, i
        most -= min(ahi - alo, bhi - blo)
        if n:
            while x > alo and y > blo and a[x - 1] == b[y - 1]:
                x, y, n = x - 1, y - 1, n + 1
            while x + n < ahi and y + n < bhi and a[x + n] == b[y + n]:
                n += 1
            found += n
            most += n
            for part in ((alo, x, blo, y), (x + n, ahi, y + n, bhi)):
                inside = [r for r in rare if part[0] <= r[0] < part[1]]
                if inside and part[2] < part[3]:
                    most += min(part[1] - part[0], part[3] - part[2])
                    todo.append((*part, inside))
        if most < need:
            return 0
    return found


def best_window(reference: str, lines: list[str]) -> tuple[str, float]:
    """The run of one to eight lines most like a reference, and how like it is."""
    return Windows([lines]).best(reference)[1:]


def detections_kept(df: DataFrame, most: float = 0.45) -> DataFrame:
    """Detections ``(frame_id, class, confidence, x1, y1, x2, y2)`` without those that cover a better one of their class.

    In order of confidence, each is kept unless its overlap with a kept one, divided by the area of both, is above
    ``most``. Folded over the detections of one frame and class, a bounded list; nothing leaves the JVM.
    """
    box = F.struct((-F.col("confidence")).alias("o"), "x1", "y1", "x2", "y2", "confidence")
    g = df.groupBy("frame_id", "class").agg(F.array_sort(F.collect_list(box)).alias("l"))
    area = lambda b: (b.x2 - b.x1) * (b.y2 - b.y1)

    def share(a: Column, b: Column) -> Column:
        both = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0)) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
        return both / F.greatest(area(a) + area(b) - both, F.lit(1e-12))

    kept = F.aggregate("l", F.slice("l", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: share(k, x) > most), acc).otherwise(F.array_append(acc, x)))
    return g.select("frame_id", "class", F.inline_outer(kept)).select("frame_id", "class", "confidence", "x1", "y1", "x2", "y2")


def anchor_candidates(segments: DataFrame) -> DataFrame:
    """Single segments and pairs of neighbours of each video: ``(video_id, unit_id, parts, start_s, end_s, text)``."""
    w = W.partitionBy("video_id").orderBy("start_s", "segment_id")
    s = segments.withColumns({"_t": F.lead("text").over(w), "_e": F.lead("end_s").over(w), "_i": F.lead("segment_id").over(w)})
    name = lambda c: F.lpad(F.col(c).cast("string"), 7, "0")
    one = s.select("video_id", F.concat(F.lit("T"), name("segment_id")).alias("unit_id"), F.lit(1).alias("parts"), "start_s", "end_s", F.trim("text").alias("text"))
    two = s.where(F.col("_i").isNotNull()).select("video_id", F.concat(F.lit("T"), name("segment_id"), F.lit("-"), name("_i")).alias("unit_id"), F.lit(2).alias("parts"), "start_s", F.col("_e").alias("end_s"), F.concat_ws(" ", F.trim("text"), F.trim("_t")).alias("text"))
    return one.unionByName(two)


def resolved_answer(answer: DataFrame, known: str = "known_ids") -> DataFrame:
    """Adds ``verdict``: ``unknown_citation``, ``abstain`` or ``answer``, and ``citations`` in order of first use.

    Columns: answerable, answer, evidence_ids, claims (array of text and evidence_ids), gaps, requested_count, temporal,
    and the known ids. An answer holds if it is said, has claims, cites exactly what its claims cite, declares no gaps,
    makes as many different claims as asked for, and its question is not one of time.
    """
    cited = F.array_distinct(F.flatten(F.transform("claims", lambda c: c.evidence_ids)))
    unknown = F.size(F.array_except(F.array_union(F.col("evidence_ids"), cited), F.col(known))) > 0
    texts = F.transform("claims", lambda c: F.lower(F.trim(c.text)))
    same = (F.size(F.array_except("evidence_ids", cited)) == 0) & (F.size(F.array_except(cited, F.col("evidence_ids"))) == 0)
    holds = (
        F.col("answerable") & (F.size(cited) > 0) & (F.trim("answer") != "") & (F.size("claims") > 0) & (F.size("gaps") == 0) & same
        & (F.col("requested_count").isNull() | (F.size("claims") == F.col("requested_count"))) & (F.size(F.array_distinct(texts)) == F.size("claims")) & ~F.col("temporal")
    )
    verdict = F.when(unknown, "unknown_citation").when(F.coalesce(holds, F.lit(False)), "answer").otherwise("abstain")
    return answer.withColumn("verdict", verdict).withColumn("citations", F.when(F.col("verdict") == "answer", cited).otherwise(F.array().cast("array<string>")))


def expanded(base: list[dict], around: dict[str, tuple[dict | None, dict | None]], most_added: int = 3, units: int = 8, chars: int = 6000, span: float = 90.0) -> list[dict]:
    """A list question's package with the neighbours of its units, while number, characters and distance allow."""
    chosen, ids, added = list(base), {b["id"] for b in base}, 0
    for b in base:
        for n in around.get(b["id"], (None, None)):
            if added >= most_added:
                return chosen
            near = n and max(abs(n["start"] - b["start"]), abs(n["end"] - b["end"])) <= span
            if near and n["id"] not in ids and len(chosen) < units and sum(len(c["text"]) for c in chosen) + len(n["text"]) <= chars:
                chosen.append(n)
                ids.add(n["id"])
                added += 1
    return chosen


def redundancy(candidates: DataFrame, keys: list[str], at: str, score: str, ident: str, vector: str, off: float, same: float = 0.98) -> DataFrame:
    """How much a list repeats itself: one row for each list of candidates, which its depth bounds.

    ``pairs_r`` within r seconds (and ``off``, by which sampled times may be off) and ``near_r``, the candidates in
    them, for 1, 2, 5 and 10 s; sorted ``gaps``; 5 s ``regions``; ``spread`` of the scores; ``duplicates``, pairs of a
    cosine of ``same`` or more, and their share of all pairs. Unknown times, scores or vectors take no part.
    """
    c = F.struct(F.col(at).cast("double").alias("t"), F.col(ident).alias("i"), vectors.normalized(F.col(vector)).alias("v"))
    g = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias("c"), F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    index = F.when(F.size("c") > 1, F.sequence(F.lit(0), F.size("c") - 2)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, b: F.struct(a.i.alias("a"), b.i.alias("b"), (b.t - a.t).alias("gap"), F.round(vectors.dot(a.v, b.v), 9).alias("cosine"))
    pairs = F.flatten(F.transform(index, lambda k: F.transform(F.slice(F.col("c"), k + 2, F.size("c")), lambda b: pair(F.get(F.col("c"), k), b))))
    g = g.withColumn("p", pairs)
    times = F.filter(F.transform("c", lambda x: x.t), lambda t: t.isNotNull())
    out = {}
    for r in (1, 2, 5, 10):
        reach = r + off
        near = F.filter("p", lambda x: x.gap <= reach)  # noqa: B023
        out[f"pairs_{r}"] = F.size(near).cast("bigint")
        out[f"near_{r}"] = F.size(F.array_distinct(F.flatten(F.transform(near, lambda x: F.array(x.a, x.b))))).cast("bigint")
    n = F.size("p")
    dup = F.size(F.filter("p", lambda x: x.cosine >= same))
    gaps = F.array_sort(F.when(F.size(times) > 1, F.zip_with(F.slice(times, 2, F.size(times)), F.slice(times, F.lit(1), F.size(times) - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>")))
    out |= {"gaps": gaps, "regions": regions(times, 5 + off), "spread": F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0)), "duplicates": dup.cast("bigint"), "duplicate_rate": F.when(n > 0, dup / n).otherwise(0.0)}
    return g.select(*keys, *(v.alias(k) for k, v in out.items()))


def screen_report(targets: DataFrame, results: DataFrame, frames: DataFrame, spans: DataFrame, minutes: float, detects: float = 0.75) -> DataFrame:
    """``(metric, value)``: how well screen text is sampled, read, found and stored. A rate of nothing is 0, a median of nothing null.

    ``targets``: target_id, reference, frame_ids (the sampled frames that show it), lines (their recognised lines),
    intervals. ``results``: target_id, rank, start_seconds, frame_ids of what its search returned. ``frames``: text of
    every frame. ``spans``: video_id, evidence_id, text after merging. Detection and accuracy take the run of lines most
    like the reference; retrieval counts results that share a frame with the target, over all targets and over those
    that a sampled frame shows.
    """
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("likeness", T.DoubleType())])

    @F.pandas_udf(kind)
    def read(reference: pd.Series, lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(a or "", list(b) if b is not None else []) for a, b in zip(reference, lines)], columns=["text", "likeness"])

    @F.pandas_udf(T.StringType())
    def terms(text: pd.Series) -> pd.Series:
        return text.map(screen_terms)

    t = targets.withColumns({"seen": F.coalesce(F.size("frame_ids") > 0, F.lit(False)), "w": read("reference", "lines")})
    shown = results.select("target_id", "rank", "start_seconds", F.col("frame_ids").alias("_r")).join(t.select("target_id", "frame_ids"), "target_id").where(F.arrays_overlap("_r", "frame_ids"))
    first = shown.groupBy("target_id").agg(F.min("rank").alias("hit"), F.min_by("start_seconds", "rank").alias("at"))
    t = t.join(first, "target_id", "left")
    away = F.array_min(F.transform("intervals", lambda i: F.when(F.col("at").between(i[0], i[1]), F.lit(0.0)).otherwise(F.least(F.abs(F.col("at") - i[0]), F.abs(F.col("at") - i[1])))))
    t = materialize(t.select("seen", "hit", F.col("w.likeness").alias("likeness"), F.levenshtein(F.coalesce("reference", F.lit("")), F.col("w.text")).alias("edits"), F.length(F.coalesce("reference", F.lit(""))).alias("size"), F.when(F.col("hit") == 1, away).alias("error")), "targets")
    n = lambda c: F.count(F.when(c, 1))
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    s, every = F.col("seen"), F.count("*")
    rows = {"targets": every, "visible_targets": n(s), "sampling_coverage": z(n(s), every), "detection_recall_visible": z(n(s & (F.col("likeness") >= detects)), n(s)), "text_accuracy_visible": F.greatest(F.lit(0.0), 1 - z(F.sum(F.when(s, F.col("edits"))), F.sum(F.when(s, F.col("size")))))}
    rows |= {f"retrieval_at_{k}{name}": z(n(c & (F.col("hit") <= k)), n(c)) for k in (1, 3, 5) for name, c in (("_all", F.lit(True)), ("_visible", s))}
    one = t.agg(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in rows.items())).alias("x")).select(F.inline("x"))
    raw = frames.select(terms("text").alias("k")).agg(n(F.col("k") != "").alias("raw"))
    w = W.partitionBy("video_id").orderBy("evidence_id")
    kept = spans.withColumn("k", terms("text")).withColumn("same", F.col("k") == F.lag("k").over(w)).agg(every.alias("kept"), n(F.col("same")).alias("again"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    stored = {"raw_duplicate_rate": z(F.col("raw") - F.col("kept"), F.col("raw")), "residual_duplicate_rate": z(F.col("again"), F.col("kept")), "index_bytes": F.col("bytes").cast("double"), "index_bytes_per_minute": F.col("bytes") / max(minutes, 1e-9)}
    two = raw.crossJoin(F.broadcast(kept)).select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in stored.items()))))
    middle = quantiles(t, [], "error", {"value": ("linear", 0.5)}).select(F.lit("median_timestamp_error").alias("metric"), "value")
    return one.unionByName(two).unionByName(middle)
