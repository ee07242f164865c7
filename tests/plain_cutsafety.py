"""The plain version of cut safety that the tests compare with: one timeline's clips as a list, step by step."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from cuesheet.functions.labels import TYPE_WEIGHTS

# Fixed values, in seconds: what counts as equal, as an overlap, as a shared boundary, as a sentence's end, and the pad after one.
EQUAL, OVERLAP, SHARED, NEAR_END, PAD = 0.05, 0.30, 0.50, 0.12, 0.35


@dataclass(frozen=True)
class Clip:
    start: float
    end: float
    song: int
    kind: str
    highlight: bool
    ident: int
    filled: bool = False

    @property
    def size(self) -> float:
        return self.end - self.start

    @property
    def weight(self) -> int:
        return TYPE_WEIGHTS.get(self.kind, 0) + 20 * self.highlight


@dataclass
class Sung:
    """A media's sentences (start, end) and words (start, end, units) by song, in order."""

    sentences: dict[int, list[tuple[float, float]]] = field(default_factory=dict)
    words: dict[int, list[tuple[float, float, int]]] = field(default_factory=dict)

    def seconds(self, song: int, start: float, end: float) -> float:
        return sum(max(0.0, min(end, e) - max(start, s)) for s, e in self.sentences.get(song, ()))


@dataclass(frozen=True)
class Limits:
    shortest: float
    longest: float

    def best(self, left: Clip, right: Clip, reference: float, cuts: Iterable[tuple[float, float]]) -> float | None:
        """Of cuts (place, cost) between two clips the one that fits the limits, else costs least, else is nearest; the first of equals."""
        rated = []
        for nr, (cut, cost) in enumerate(cuts):
            sides = (cut - left.start, right.end - cut)
            if min(sides) <= 0.1:
                continue
            fits = all(self.shortest <= x <= self.longest * 1.1 for x in sides)
            for x in sides:
                cost += 20 * max(0.0, self.shortest - x) + (4 * (x - self.longest) if x > self.longest * 1.1 else 0.0)
            off = abs(cut - reference)
            rated.append((not fits, cost + 0.05 * off, off, nr, cut))
        return min(rated)[-1] if rated else None


def overlap_cut(left: Clip, right: Clip, sentences: Sequence[tuple[float, float]], limits: Limits) -> float:
    """Where two overlapping clips part: between sentences, at a sentence's edge, or with a shared sentence on its larger side."""
    first, last = max(left.start, right.start), min(left.end, right.end)
    middle = (first + last) / 2
    cuts = [((max(a, first) + min(b, last)) / 2, 0.0) for (_, a), (b, _) in zip(sentences, sentences[1:], strict=False) if a < b and b >= first and a <= last]
    cuts += [(edge, 1.0) for s in sentences for edge in s if first <= edge <= last]
    for s, e in sentences:
        mine, other = (max(0.0, min(e, c.end) - max(s, c.start)) for c in (left, right))
        if mine > 0 and other > 0:
            cuts.append((e if mine >= other else s, 2.0))
    inside = any(s + EQUAL < middle < e - EQUAL for s, e in sentences)
    usable = limits.best(left, right, middle, cuts) is not None
    cuts.append((middle, 500.0 if inside and usable else 5.0))
    found = limits.best(left, right, middle, cuts)
    return middle if found is None else found


def sentence_cut(left: Clip, right: Clip, sentence: tuple[float, float], boundary: float, words: Sequence[tuple[float, float, int]], limits: Limits) -> float | None:
    """A boundary inside a sentence moves to its end if most of it was sung before, else to its start; None if it stays."""
    s, e = sentence
    rest = max(0.0, e - boundary)
    held = [w for w in words if w[0] < e and w[1] > s]
    total = sum(u for *_, u in held)
    if total:
        done = sum(u if boundary >= b else max(0, min(u, round(u * (boundary - a) / max(EQUAL, b - a)))) if boundary > a else 0 for a, b, u in held)
        before = done / total >= 0.6 and (done > 3 or rest <= 0.45) or rest <= 0.45 and done / total >= 0.5
    else:
        before = (boundary - s) / (e - s) >= 0.55 or rest <= 0.45
    found = limits.best(left, right, boundary, [(e, 0.0 if before else 3.0), (s, 3.5 if before else 0.0)])
    return found if found is not None and abs(found - boundary) > EQUAL else None


def padded_cut(left: Clip, right: Clip, sentences: Sequence[tuple[float, float]], boundary: float, limits: Limits) -> float | None:
    """A boundary at a sentence's end moves a little past it, but not into the next sentence; None if it stays."""
    ended = [e for _, e in sentences if abs(e - boundary) <= NEAR_END]
    if not ended:
        return None
    end = min(ended, key=lambda e: abs(e - boundary))
    after = [s for s, _ in sentences if s > end + EQUAL]
    cut = end + PAD if not after else min(end + PAD, max(end, min(after) - EQUAL))
    return limits.best(left, right, boundary, [(cut, 0.5)]) if cut > boundary + EQUAL else None


def protect(clips: list[Clip], sung: Sung, limits: Limits) -> None:
    """Moves boundaries that neighbours of one song share out of sentences, in order."""
    for i, (left, right) in enumerate(zip(clips, clips[1:], strict=False)):
        left = clips[i]
        if abs(right.start - left.end) > SHARED or left.song != right.song:
            continue
        boundary, sentences = (left.end + right.start) / 2, sung.sentences.get(left.song, [])
        inside = next((x for x in sentences if x[0] + EQUAL < boundary < x[1] - EQUAL), None)
        cut = sentence_cut(left, right, inside, boundary, sung.words.get(left.song, ()), limits) if inside else padded_cut(left, right, sentences, boundary, limits)
        if cut is not None:
            clips[i], clips[i + 1] = replace(left, end=round(cut, 3)), replace(right, start=round(cut, 3))


def part_overlaps(clips: list[Clip], sung: Sung, limits: Limits) -> None:
    for i in range(len(clips) - 1):
        left, right = clips[i], clips[i + 1]
        over = left.end - right.start
        if over <= 0:
            continue
        if over <= OVERLAP:
            clips[i] = replace(left, end=right.start)
            continue
        cut = right.start if left.song != right.song else overlap_cut(left, right, sung.sentences.get(left.song, []), limits)
        clips[i], clips[i + 1] = replace(left, end=round(cut, 3)), replace(right, start=round(cut, 3))


def united(a: Clip, b: Clip) -> Clip:
    kind = b.kind if b.weight > a.weight else a.kind
    return replace(a, start=min(a.start, b.start), end=max(a.end, b.end), highlight=a.highlight or b.highlight, kind=kind)


def repair_short(clips: list[Clip], sung: Sung, limits: Limits) -> list[Clip]:
    """Clips that are too short borrow from a neighbour that can spare it, else join one of their kind, else stay if they are sung, else go.

    After each change the clip before is looked at again.
    """
    clips, i = sorted(clips, key=lambda c: (c.start, c.end)), 0
    if len(clips) < 2:
        return clips
    while i < len(clips):
        clip = clips[i]
        missing = limits.shortest - clip.size
        if missing <= EQUAL:
            i += 1
            continue
        before, after = clips[i - 1] if i else None, clips[i + 1] if i + 1 < len(clips) else None
        spare = lambda c, gap: c is not None and gap <= OVERLAP and c.size - missing >= limits.shortest
        joins = lambda c, size: c is not None and c.kind == clip.kind and c.song == clip.song and size <= limits.longest + EQUAL
        if after is not None and spare(after, after.start - clip.end):
            edge = round(clip.end + missing, 3)
            clips[i : i + 2] = [replace(clip, end=edge), replace(after, start=edge)]
        elif before is not None and spare(before, clip.start - before.end):
            edge = round(clip.start - missing, 3)
            clips[i - 1 : i + 1] = [replace(before, end=edge), replace(clip, start=edge)]
        elif before is not None and joins(before, clip.end - before.start):
            clips[i - 1 : i + 1] = [united(before, clip)]
            i -= 1
        elif after is not None and joins(after, after.end - clip.start):
            clips[i : i + 2] = [united(clip, after)]
        elif sung.seconds(clip.song, clip.start, clip.end) >= 0.3:
            i += 2  # kept; the step back below makes it one
        else:
            del clips[i]
        i = max(0, i - 1)
    return clips


def gap_parts(start: float, end: float, longest: float) -> list[tuple[float, float]]:
    size = end - start
    n = 1 if size <= longest + EQUAL else max(1, int((size + longest - EQUAL) // longest))
    n += n > 1 and start + n * longest < end - EQUAL
    edges = [start + size / n * k for k in range(n)] + [end]
    return [(round(a, 3), round(b, 3)) for a, b in zip(edges, edges[1:], strict=False)]


def fill_gaps(clips: list[Clip], sung: Sung, limits: Limits) -> list[Clip]:
    """Fills gaps of a song that are sung enough, as the weightier neighbour."""
    out = list(clips)
    for left, right in zip(clips, clips[1:], strict=False):
        gap = right.start - left.end
        if gap <= SHARED or left.song != right.song or sung.seconds(left.song, left.end, right.start) < max(0.5, min(2.0, gap * 0.2)):
            continue
        model = left if left.weight >= right.weight else right
        out += [replace(model, start=a, end=b, highlight=left.highlight or right.highlight, filled=True) for a, b in gap_parts(left.end, right.start, limits.longest) if b - a > EQUAL]
    return sorted(out, key=lambda c: (c.start, c.end))


STEPS = ("part", "protect", "repair", "protect", "fill")


def normalize(clips: Iterable[Clip], sung: Sung, limits: Limits, steps: Sequence[str] = STEPS) -> list[Clip]:
    """All steps by default: part overlaps, protect sentences, repair short clips, protect again, fill gaps."""
    clips = sorted(clips, key=lambda c: (c.start, c.end))
    if len(clips) < 2:
        return clips
    for step in steps:
        if step == "part":
            part_overlaps(clips, sung, limits)
        elif step == "protect":
            protect(clips, sung, limits)
        elif step == "repair":
            clips = repair_short([c for c in clips if c.size > EQUAL], sung, limits)
        else:
            clips = fill_gaps(clips, sung, limits)
    return clips
