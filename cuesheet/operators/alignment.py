"""Lyric lines placed in time: scored windows for each line, and the best path through them that never goes back."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions.text import estimated_line_seconds
from cuesheet.operators.asof import NO_ANCHOR_S, fill_between_anchors
from cuesheet.operators.intervals import Keys


#: the tasks of a comparison; given by number, they aren't joined for having few bytes
PARTS = 96
#: counts of characters that are compared at a time
COUNTS = 1 << 22


def begins(rows: pa.Table, keys: Keys) -> np.ndarray:
    """Of each row whether its keys are others than those of the row before."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        x = rows.column(k).combine_chunks()
        a, b = x.slice(0, max(0, len(x) - 1)), x.slice(1)
        new[1:] |= pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def whole_songs(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a song does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        before = [held[-1].slice(len(held[-1]) - 1)] if held else []
        new = np.flatnonzero(begins(pa.Table.from_batches([*before, batch]), keys)[len(before) :])
        if not len(new):
            held.append(batch)
            continue
        last = int(new[-1])
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def song_by_song(rows: DataFrame, keys: Keys, order: list[str | Column], f: Callable[[pa.Table, list[tuple[int, int]]], pa.Table], schema: str) -> DataFrame:
    """What `f` gives for tables of whole songs, each sorted, and where their songs begin and end; a task reads its songs in batches, not in a group for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_songs(batches, keys):
            first = np.flatnonzero(begins(table, keys)).tolist()
            yield from f(table, list(zip(first, [*first[1:], len(table)], strict=True))).to_batches()

    return rows.repartition(PARTS, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def common_subsequence(masks: Iterable[int], size: int) -> int:
    """The length of the longest common subsequence of a text, as the mask of each character's places in another, with that other of `size` characters. No matches of difflib's are more."""
    left = (1 << size) - 1
    for mask in masks:
        some = left & mask
        left = (left + some) | (left - some)
    return size - (left & (1 << size) - 1).bit_count()


class WindowTexts:
    """The windows of one song, in order, as stretches (first, end) of one text, with their characters counted."""

    def __init__(self, texts: list[str], centres: np.ndarray) -> None:
        places, end = {}, 0
        for x in texts:
            if x not in places:
                places[x] = (end, end + len(x))
                end += len(x)
        self._lay("".join(places), [places[x] for x in texts], centres)

    def _lay(self, text: str, spans: list[tuple[int, int]], centres: np.ndarray) -> None:
        self.text, self.centres = text, centres
        self.places = {c: i for i, c in enumerate(sorted(set(text)))}
        distinct, self.which = np.unique(np.array(spans, np.int64).reshape(-1, 2), axis=0, return_inverse=True)
        upto = np.zeros((len(text) + 1, len(self.places)), np.int32)
        upto[np.arange(1, len(text) + 1), [self.places[c] for c in text]] = 1
        upto = upto.cumsum(0, dtype=np.int32)
        self.spans, self.counts, self.sizes = distinct.tolist(), upto[distinct[:, 1]] - upto[distinct[:, 0]], distinct[:, 1] - distinct[:, 0]

    @classmethod
    def of_words(cls, words: list[str], starts: np.ndarray, ends: np.ndarray, step: float, half: float) -> WindowTexts:
        """The windows of 2 x half seconds every `step` seconds over words in order; those without characters are left out (see `lyrics.time_windows`)."""
        timed = np.flatnonzero(~(np.isnan(starts) | np.isnan(ends)))
        words = [words[i] for i in timed.tolist()]
        low = np.maximum(np.ceil((starts[timed] - half) / step), 0).astype(np.int64)
        high = np.floor((ends[timed] + half) / step).astype(np.int64)
        if (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all():
            upto = np.append(0, np.cumsum([len(x) for x in words])).astype(np.int64)
            at = np.arange(low.min(initial=0), high.max(initial=-1) + 1)
            a, b = upto[np.searchsorted(high, at, "left")], upto[np.searchsorted(low, at, "right")]
            windows = cls.__new__(cls)
            windows._lay("".join(words), np.stack([a, b], 1)[a < b].tolist(), at[a < b] * step)
            return windows
        # words out of time: the windows' texts one after the other
        said: dict[int, list[str]] = {}
        for word, a, b in zip(words, low.tolist(), high.tolist(), strict=True):
            for c in range(a, b + 1) if word else ():
                said.setdefault(c, []).append(word)
        at = sorted(said)
        return cls(["".join(said[c]) for c in at], np.array(at, float) * step)

    def bounds(self, texts: list[str]) -> np.ndarray:
        """Of each text the bound of its similarity with each window (see `bound`) by the characters in common, whatever their order."""
        own, size = np.zeros((len(texts), len(self.places)), np.int32), np.array([len(x) for x in texts])[:, None]
        for row, x in zip(own, texts, strict=True):
            for c, n in Counter(x).items():
                if c in self.places:
                    row[self.places[c]] = n
        both = np.minimum(self.counts[None], own[:, None]).sum(2)
        held = np.where(both == size, 0.45 * size / self.sizes + 0.08, np.where(both == self.sizes, 0.40 * self.sizes / size + 0.08, 0.0))
        return np.minimum(1.0, np.maximum(2 * both / (self.sizes + size), held))[:, self.which]

    def best(self, text: str, expected: float | None, penalty: float, drift: float, k: int, least: float, reach: float | None) -> list[tuple[float, float, float]]:
        """The k best windows (centre, similarity, score) for a line."""
        return next(self.best_of([(text, expected, penalty)], drift, k, least, reach))

    def best_of(self, lines: list[tuple[str, float | None, float]], drift: float, k: int, least: float, reach: float | None) -> Iterator[list[tuple[float, float, float]]]:
        """The k best windows (centre, similarity, score) for each line (text, expected time, penalty)."""
        at_once = max(1, COUNTS // max(1, self.counts.size))
        for i in range(0, len(lines), at_once):
            some = lines[i : i + at_once]
            for line, bound in zip(some, self.bounds([x for x, *_ in some]), strict=True):
                yield self._best(*line, bound, drift, k, least, reach)

    def _best(self, text: str, expected: float | None, penalty: float, bound: np.ndarray, drift: float, k: int, least: float, reach: float | None) -> list[tuple[float, float, float]]:
        """Windows are bounded by their characters in common and, from the highest bound on, by their longest common subsequence with the line; from the highest of those on they are
        compared, until k have a score that none of the others can reach. Equal texts are compared once.
        """
        near = np.full(len(bound), 0.5) if expected is None else np.maximum(0.0, 1 - np.abs(self.centres - expected) / drift)
        usable = bound >= least
        if reach is not None and expected is not None:
            usable &= np.abs(self.centres - expected) <= reach
        most = 0.82 * bound + 0.18 * near - penalty
        order = np.argsort(-most, kind="stable")
        order = order[usable[order]].tolist()
        most, near, size = most.tolist(), near.tolist(), len(text)
        masks = dict.fromkeys(self.places, 0)
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        matcher, closer, known, kept, heap, nr = None, {}, {}, [], [], 0
        while nr < len(order) or heap:
            here = heap[0][0] if heap else np.inf
            first = nr < len(order) and -most[order[nr]] <= here
            if len(kept) == k and -(-most[order[nr]] if first else here) < -kept[-1][0] - 1e-8:
                break
            i = order[nr] if first else heap[0][1]
            of = int(self.which[i])
            a, b = self.spans[of]
            if first:
                nr += 1
                if of not in closer:
                    x, m = self.text[a:b], b - a
                    # from 200 characters on difflib leaves out the frequent ones
                    if size < 200 and (text in x or x in text):
                        closer[of] = known[of] = tx.lifted(2.0 * min(m, size) / (m + size), x, text)
                    else:
                        n = common_subsequence(map(masks.__getitem__, x), size)
                        # a text that holds the other may be lifted (see `similarity_ratio`)
                        held = 0.45 * size / m + 0.08 if n == size else 0.40 * m / size + 0.08 if n == m else 0.0
                        closer[of] = min(1.0, max(2 * n / (m + size), held))
                if closer[of] >= least:
                    heapq.heappush(heap, (-(0.82 * closer[of] + 0.18 * near[i] - penalty), i))
                continue
            heapq.heappop(heap)
            if of not in known:
                matcher = matcher or tx.BitMatcher(None, "", text)
                known[of] = tx.lifted_ratio(matcher, self.text[a:b], text)
            if known[of] >= least:
                score = round(0.82 * known[of] + 0.18 * near[i] - penalty, 9)
                kept = sorted([*kept, (-score, float(self.centres[i]), known[of])])[:k]
        return [(centre, ratio, -score) for score, centre, ratio in kept]


def line_window_candidates(lines: DataFrame, windows: DataFrame, keys: Keys, scale: float = 1.0, offset: float = 0.0, drift: float = 6.0, k: int = 8, least: float = 0.06, reach: float | None = None) -> DataFrame:
    """The k best windows (center, text) for each line (line, text, t): keys, line, t, center, similarity, score.

    The score is 0.82 of the similarity and 0.18 of how near the window is to the line's expected time, less for short lines and for
    lines that occur often. Windows that by their characters can't be among the k best, or reach the least similarity, aren't compared; nor are, where `reach` is given,
    those further than that from a timed line's expected time. Of equals the earlier window.
    """
    others = windows.select(*keys, tx.norm_text_align(F.col("text")).alias("_n"), F.col("center").cast("double").alias("_a"), F.lit(None).cast("double").alias("_b"), F.lit(None).cast("long").alias("_nr"))

    def known(texts: list[str], a: np.ndarray, b: np.ndarray) -> WindowTexts:
        at = np.argsort(a, kind="stable")
        return WindowTexts([texts[i] for i in at.tolist()], a[at])

    return _candidates(lines, others.where("_n <> ''"), keys, known, scale, offset, drift, k, least, reach)


def line_word_candidates(lines: DataFrame, words: DataFrame, keys: Keys, order: str, scale: float = 1.0, offset: float = 0.0, drift: float = 6.0, k: int = 8, least: float = 0.06, reach: float | None = None, step: float = 0.25, half: float = 3.2) -> DataFrame:
    """`line_window_candidates` with the windows of `lyrics.time_windows` over the words (order, word, start_s, end_s), which are made song by song and not stored."""
    times = (F.col("start_s").cast("double").alias("_a"), F.col("end_s").cast("double").alias("_b"))
    others = words.select(*(F.col(c).alias(c) for c in keys), tx.norm_text_align(F.col("word")).alias("_n"), *times, F.col(order).cast("long").alias("_nr"))
    return _candidates(lines, others, keys, lambda texts, a, b: WindowTexts.of_words(texts, a, b, step, half), scale, offset, drift, k, least, reach)


def _candidates(lines: DataFrame, others: DataFrame, keys: Keys, known: Callable[[list[str], np.ndarray, np.ndarray], WindowTexts], scale: float, offset: float, drift: float, k: int, least: float, reach: float | None) -> DataFrame:
    """The k best of the windows that `known` makes of a song's others (_n, _a, _b by _nr) for each of its lines."""
    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "line")) + ", t double, center double, similarity double, score double"
    mine = lines.select(*keys, F.lit(False).alias("_said"), "line", tx.norm_text_align(F.col("text")).alias("_n"), F.col("t").cast("double").alias("_a"), F.lit(None).cast("double").alias("_b"), F.lit(None).cast("long").alias("_nr"))
    both = mine.where("_n <> ''").unionByName(others.withColumns({"_said": F.lit(True), "line": F.lit(None).cast(types["line"])}))

    def run(rows: pa.Table, songs: list[tuple[int, int]]) -> pa.Table:
        found, of = [], []
        texts, said = rows.column("_n").to_pylist(), rows.column("_said").to_numpy()
        a, b = (rows.column(c).to_numpy() for c in ("_a", "_b"))
        for first, end in songs:
            mid = first + int(np.searchsorted(said[first:end], True))
            if first < mid < end:
                windows = known(texts[mid:end], a[mid:end], b[mid:end])
                often = Counter(texts[first:mid])
                penalty = lambda x: (0.08 if len(x) <= 3 else 0.0) + min(0.12, (often[x] - 1) * 0.03)  # noqa: B023, E731
                asked = [(x, None if np.isnan(t) else float(t) * scale + offset, penalty(x)) for x, t in zip(texts[first:mid], a[first:mid], strict=True)]
                for i, some in enumerate(windows.best_of(asked, max(drift, 0.6), k, least, reach)):
                    found += some
                    of += [first + i] * len(some)
        heads = {c: rows.column(c).take(pa.array(of, pa.int64())) for c in (*keys, "line")} | {"t": rows.column("_a").take(pa.array(of, pa.int64()))}
        values = {c: pa.array([x[j] for x in found], pa.float64()) for j, c in enumerate(("center", "similarity", "score"))}
        return pa.table(heads | values)

    return song_by_song(both, keys, ["_said", "line", "_nr", "_n"], run, schema)


def best_path(groups: list[tuple[float | None, np.ndarray, np.ndarray]], scale: float, drift: float, back: float = 0.2) -> list[int]:
    """Of each line (its time, its candidates' centres and scores) the candidate on the best path, -1 for lines without.

    From one line to the next the centre may go back by at most `back`; steps of the expected length earn up to 0.12.
    """
    totals, came, kept = [], [], [i for i, g in enumerate(groups) if len(g[1])]
    for nr, i in enumerate(kept):
        t, centres, scores = groups[i]
        if not nr:
            totals.append(scores.astype(float))
            came.append(np.full(len(scores), -1))
            continue
        t0, before, _ = groups[kept[nr - 1]]
        step = centres[:, None] - before[None, :]
        bonus = np.zeros_like(step)
        if t is not None and t0 is not None and kept[nr - 1] == i - 1:
            bonus = 0.12 * np.maximum(-0.4, 1 - np.abs(step - (t - t0) * scale) / max(drift, 0.8))
        value = np.where(step >= -back, totals[-1][None, :] + bonus, -np.inf)
        came.append(value.argmax(1))
        totals.append(scores + value.max(1))
    out = [-1] * len(groups)
    if kept and np.isfinite(totals[-1]).any():
        at = int(totals[-1].argmax())
        for nr in range(len(kept) - 1, -1, -1):
            out[kept[nr]] = at
            at = int(came[nr][at])
    return out


def monotone_alignment(lines: DataFrame, candidates: DataFrame, keys: Keys, scale: float = 1.0, drift: float = 6.0) -> DataFrame:
    """Each line with the candidate on the best path: keys, line, start_s, similarity, confidence (the score from 0 to 1), status (confirmed from a similarity of 0.5 on, review, or interpolated without)."""
    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "line")) + ", start_s double, similarity double, confidence double, status string"
    values = ("center", "similarity", "score")
    mine = lines.select(*keys, "line", F.lit(False).alias("_placed"), F.col("t").cast("double").alias("t"), *(F.lit(None).cast("double").alias(c) for c in values))
    others = candidates.select(*(F.col(c).alias(c) for c in keys), F.col("line").cast(types["line"]).alias("line"), F.lit(True).alias("_placed"), F.lit(None).cast("double").alias("t"), *(F.col(c).cast("double").alias(c) for c in values))

    def run(rows: pa.Table, songs: list[tuple[int, int]]) -> pa.Table:
        t, center, similarity, score = (rows.column(c).to_numpy() for c in ("t", *values))
        placed = rows.column("_placed").to_numpy()
        new = begins(rows, [*keys, "line"])
        heads, at = [], []
        for a, b in songs:
            first = a + np.flatnonzero(new[a:b])
            groups = [(i, np.arange(i, j)[placed[i:j] & ~np.isnan(center[i:j])]) for i, j in zip(first.tolist(), [*first[1:].tolist(), b], strict=True) if not placed[i]]
            path = best_path([(None if np.isnan(t[i]) else float(t[i]), center[g], score[g]) for i, g in groups], scale, drift)
            heads += [i for i, _ in groups]
            at += [-1 if x < 0 else g[x] for (_, g), x in zip(groups, path, strict=True)]
        at = np.array(at, np.int64)
        none = at < 0
        sure = np.clip(score[at], 0.0, 1.0)
        status = np.where(none, "interpolated", np.where(similarity[at] >= 0.5, "confirmed", "review"))
        named = {k: rows.column(k).take(pa.array(heads, pa.int64())) for k in (*keys, "line")}
        return pa.table(named | {"start_s": pa.array(center[at], mask=none), "similarity": pa.array(similarity[at], mask=none), "confidence": pa.array(sure, mask=none), "status": pa.array(status.tolist(), pa.string())})

    return song_by_song(mine.unionByName(others), keys, ["line", "_placed", "center"], run, schema)


def placed_lines(lines: DataFrame, candidates: DataFrame, keys: Keys, scale: float = 1.0, offset: float = NO_ANCHOR_S, drift: float = 6.0) -> DataFrame:
    """All lines (line, t, text) with a time: on the best path through their candidates, and where that isn't sure by the anchors around them (see `fill_between_anchors`)."""
    aligned = monotone_alignment(lines, candidates, keys, scale, drift)
    both = lines.select(*keys, "line", "t", "text").join(aligned, [*keys, "line"]).withColumn("end_s", F.col("start_s") + estimated_line_seconds(F.col("text")))
    return fill_between_anchors(both, keys, "line", scale, offset)


#: what doesn't count in a line or word: blanks and some punctuation
SKIPPED = re.compile(r"[\s，。、？！…—·\-\(\)\[\]]")


class Likeness:
    """difflib's ratio of one line with windows of a text, which share what they hold: the matches of a part of the line in a stretch of the text are found once."""

    #: a larger table of pairs of characters isn't made
    MOST = 1 << 22

    def __init__(self, line: str, chars: str) -> None:
        self.line, self.chars, self.runs, self.known, self.matcher = line, chars, None, {}, None
        self.masks = dict.fromkeys(chars, 0)
        for i, c in enumerate(line):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def bound(self, first: int, end: int) -> float:
        """What the ratio can't exceed."""
        return 2 * common_subsequence(map(self.masks.__getitem__, self.chars[first:end]), len(self.line)) / (len(self.line) + end - first)

    def ratio(self, first: int, end: int) -> float:
        line, window = self.line, self.chars[first:end]
        if len(window) >= 200:
            return 2.0 * self._matched_by_rare(first, end) / (len(line) + len(window))
        if len(line) * len(self.chars) > self.MOST:
            self.matcher = self.matcher or SequenceMatcher(None, line, "")
            self.matcher.set_seq2(window)
            return self.matcher.ratio()
        inside = window in line or line in window
        return 2.0 * (min(len(line), len(window)) if inside else self.matched(0, len(line), first, end)) / (len(line) + len(window))

    def matched(self, alo: int, ahi: int, blo: int, bhi: int) -> int:
        """How many characters of a part of the line are matched in a stretch of the text: its longest match, the first of equals, and what is matched on both sides of it."""
        if self.runs is None:
            self._count_runs()
        total, parts, known = 0, [(alo, ahi, blo, bhi)], self.known
        while parts:
            part = parts.pop()
            found = known.get(part)
            if found is None:
                found = known[part] = self._longest(*part)
            i, j, size = found
            if size:
                total += size
                alo, ahi, blo, bhi = part
                if alo < i and blo < j:
                    parts.append((alo, i, blo, j))
                if i + size < ahi and j + size < bhi:
                    parts.append((i + size, ahi, j + size, bhi))
        return total

    def _longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        if ahi - alo == 1:
            j = self.chars.find(self.line[alo], blo, bhi)
            return alo, max(j, blo), int(j >= 0)
        if bhi - blo == 1:
            i = self.line.find(self.chars[blo], alo, ahi)
            return max(i, alo), blo, int(i >= 0)
        # a run that leaves the part is cut at its edge
        sizes = np.minimum(self.runs[alo:ahi, blo:bhi], np.minimum(self.left[len(self.left) - (ahi - alo) :, None], self.left[None, len(self.left) - (bhi - blo) :]))
        at = int(sizes.argmax())
        i, j = divmod(at, bhi - blo)
        return alo + i, blo + j, int(sizes[i, j])

    def _matched_by_rare(self, first: int, end: int) -> int:
        """The same for windows of 200 characters or more, where frequent characters only lengthen a match."""
        line, chars, most, seeds = self.line, self.chars, (end - first) // 100 + 1, []
        for c, n in Counter(chars[first:end]).items():
            if n <= most and c in line:
                mine, j = [i for i, x in enumerate(line) if x == c], first - 1
                for _ in range(n):
                    j = chars.index(c, j + 1)
                    seeds += [(i, j) for i in mine]
        total, parts = 0, [(0, len(line), first, end, sorted(seeds))]
        while parts:
            alo, ahi, blo, bhi, seeds = parts.pop()
            i, j, size, lengths = alo, blo, 0, {}
            for x, y in seeds:
                lengths[x, y] = k = lengths.get((x - 1, y - 1), 0) + 1
                if k > size:
                    i, j, size = x - k + 1, y - k + 1, k
            while i > alo and j > blo and line[i - 1] == chars[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and line[i + size] == chars[j + size]:
                size += 1
            if size:
                total += size
                if alo < i and blo < j:
                    parts.append((alo, i, blo, j, [(x, y) for x, y in seeds if x < i and y < j]))
                if i + size < ahi and j + size < bhi:
                    parts.append((i + size, ahi, j + size, bhi, [(x, y) for x, y in seeds if x >= i + size and y >= j + size]))
        return total

    def _count_runs(self) -> None:
        """Of each pair of places in line and text how many characters are equal from there on."""
        a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (self.line, self.chars))
        self.runs = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i in range(len(a) - 1, -1, -1):
            np.multiply(self.runs[i + 1, 1:] + 1, b == a[i], out=self.runs[i, :-1])
        self.left = np.arange(max(len(a), len(b)), 0, -1, dtype=np.int32)


def next_match(line: str, chars: str, least: float, reach: int) -> tuple[float, int, int] | None:
    """The window of `chars` most like a line (score, first, end), among those that begin up to `reach` times its length on; None under `least`. Of equals the first."""
    if len(line) < 2 or not chars:
        return None
    size, n = max(len(line) - 2, min(len(line) + 5, 20)), min(len(chars), reach * len(line) + 2)
    left, both, bounds = Counter(line), 0, []
    for at, c in enumerate(chars[: n - 1 + size]):  # characters in common with the line, whatever their order, bound the likeness
        both += left[c] > 0
        left[c] -= 1
        if at >= size:
            left[chars[at - size]] += 1
            both -= left[chars[at - size]] > 0
        if at >= size - 1:
            bounds.append(2 * both / (len(line) + size))
    left, both, short = Counter(line), 0, []
    for at in range(len(chars) - 1, len(bounds) - 1, -1) if len(bounds) < n else ():  # windows cut short by the end
        both += left[chars[at]] > 0
        left[chars[at]] -= 1
        if at < n:
            short.append(2 * both / (len(line) + len(chars) - at))
    bounds += reversed(short)
    best, score, likeness = None, -1.0, Likeness(line, chars[: n - 1 + size])
    # from the highest bound on: by characters, then by the longest common subsequence, then compared
    waiting, heap, nr = sorted(range(n), key=lambda i: (-bounds[i], i)), [], 0
    while nr < n or heap:
        fresh = nr < n and (not heap or (-bounds[waiting[nr]], waiting[nr]) <= heap[0])
        bound, first = (-bounds[waiting[nr]], waiting[nr]) if fresh else heap[0]
        if best is not None and (bound, first) > (-score, best[1]):
            break
        if fresh:
            nr += 1
            heapq.heappush(heap, (-likeness.bound(first, min(first + size, len(chars))), first))
            continue
        heapq.heappop(heap)
        end = min(first + size, len(chars))
        ratio = likeness.ratio(first, end)
        if best is None or (-ratio, first) < (-score, best[1]):
            best, score = (ratio, first, end), ratio
    return best if score >= least else None


def sequential_line_match(lines: DataFrame, words: DataFrame, keys: Keys, least: float = 0.25, reach: int = 3, default_s: float = 5.0) -> DataFrame:
    """Lines (line, text, t) in order, each with the words (nr, word, start_s, end_s) most like it after the match before: score, matched, start_s, end_s, first_word, last_word.

    The words' characters run on from the cursor, which stands behind the last word of the match before; a window over them has about the line's length and begins within `reach` times it. The match
    ends with the word of the character after its window, and so does its time. A line whose best window is less like it than `least`, or that has under two characters, has score 0 and its
    own time until the next line's, or for `default_s` seconds. One song's lines and words are in one task.
    """
    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "line")) + ", score double, matched string, start_s double, end_s double, first_word long, last_word long"

    def run(rows: pa.Table, songs: list[tuple[int, int]]) -> pa.Table:
        texts = [SKIPPED.sub("", x or "") for x in rows.column("text").to_pylist()]
        said = rows.column("_said").to_numpy()
        nr, t, end_s = (rows.column(c).to_pylist() for c in ("nr", "_a", "_b"))
        out, of_row = [], []
        for a, b in songs:
            mid = a + int(np.searchsorted(said[a:b], True))
            out += matched(texts[a:mid], t[a:mid], nr[mid:b], texts[mid:b], t[mid:b], end_s[mid:b])
            of_row += range(a, mid)
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = (pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = ("score", "matched", "start_s", "end_s", "first_word", "last_word")
        heads = {k: rows.column(k).take(pa.array(of_row, pa.int64())) for k in (*keys, "line")}
        return pa.table(heads | {n: pa.array(list(x), k) for n, x, k in zip(names, columns, kinds, strict=True)})

    def matched(texts: list[str], times: list[float | None], nr: list[int], spoken: list[str], starts: list[float], ends: list[float]) -> list[tuple]:
        """Of one song's lines, without what doesn't count, the matches in its words."""
        times = [*times, None]
        chars, of = "".join(spoken), np.repeat(np.arange(len(spoken)), [len(x) for x in spoken])
        first_char = np.append(0, np.cumsum([len(x) for x in spoken])).astype(int)
        out, cursor = [], 0
        for i, text in enumerate(texts):
            begin = int(first_char[cursor])
            found = next_match(text, chars[begin : begin + (reach + 1) * len(text) + 30], least, reach)
            if found is None:
                after = times[i + 1] if i + 1 < len(texts) and times[i + 1] is not None else None if times[i] is None else times[i] + default_s
                out.append((0.0, "", times[i], after, None, None))
                continue
            ratio, a, b = found
            one, last = int(of[begin + a]), int(of[min(begin + b, len(of) - 1)])
            out.append((round(ratio, 3), chars[begin + a : begin + b], round(starts[one], 2), round(ends[last], 2), nr[one], nr[last]))
            cursor = last + 1
        return out

    none = F.lit(None)
    mine = lines.select(*keys, F.lit(False).alias("_said"), "line", none.cast("long").alias("nr"), "text", F.col("t").cast("double").alias("_a"), none.cast("double").alias("_b"))
    said = words.select(*(F.col(k).alias(k) for k in keys), F.lit(True).alias("_said"), none.cast(types["line"]).alias("line"), F.col("nr").cast("long").alias("nr"), F.col("word").alias("text"), F.col("start_s").cast("double").alias("_a"), F.col("end_s").cast("double").alias("_b"))
    return song_by_song(mine.unionByName(said), keys, ["_said", "line", "nr"], run, schema)
