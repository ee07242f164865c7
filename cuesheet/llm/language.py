"""Language identification of mixed texts: script ranges, per-word scores, and Viterbi with a switching penalty.

Learning counts hashed character n-grams of words, by language, on a bounded sample: of each language the SAMPLE labelled
different documents (id and text) whose hash is smallest, about, or all if there are fewer. The model is a table of languages by GRAMS buckets, whatever the corpus.

A run of more than LONGEST letters counts as words of at most that many. A word's score for a language is the mean log probability of its n-grams times a weight that grows with its length; languages
whose learning texts hardly use the word's script are out. The best path over a text's words pays PENALTY for each change of
language. Where one language beats every other by less than half of that on any run of words, no change can pay, and the path
need not be searched.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import only, remainder, table

LONGEST = 64
#: what a pattern's word characters hold besides letters, digits and the underscore: numerals such as ½, ² and ①
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: a word, or a piece of a longer run of letters; the first pattern is faster, and right in texts without such numerals
SOME, LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}"), re.compile(rf"[^\W\d_{NUMERALS}]{{1,{LONGEST}}}")


def words_of(text: str) -> tuple[re.Pattern[str], list[str]]:
    """The text's words, and the pattern that finds them."""
    found = SOME.findall(text)
    return (SOME, found) if not found or "".join(found).isalpha() else (LETTERS, LETTERS.findall(text))


GRAMS, SAMPLE, PENALTY, SMOOTHING, SCRIPT_SHARE, REMEMBERED = 1 << 16, 2000, 24.0, 0.1, 0.02, 300_000
# First code points of Unicode ranges and the script that letters from there on mostly have.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0E00, "thai"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2C00, "other"),
    (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
STARTS, NAMES = np.array([x for x, _ in SCRIPTS]), [x for _, x in SCRIPTS]


PRIME = np.uint64(0x9E3779B97F4A7C15)


def script(word: str) -> str:
    """Of most of the word's letters; of equally many the first."""
    found = Counter(NAMES[i] for i in np.searchsorted(STARTS, [ord(c) for c in word], side="right") - 1)
    return max(found, key=found.get)


def scripts(words: list[str]) -> list[str]:
    return ["latin" if w.isascii() else script(w) for w in words]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of one to four characters of each word, its ends marked, and of the whole word.

    Returns all buckets, and for each the number of its word. No word is longer than LONGEST letters.
    """
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    word, ends = np.repeat(np.arange(len(marked)), lengths), np.repeat(np.cumsum(lengths), lengths)
    found, owners = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(codes), np.uint64)
        for n in range(1, 5):
            rolled[: len(codes) - n + 1] = rolled[: len(codes) - n + 1] * PRIME + codes[n - 1 :]
            inside = np.flatnonzero(np.arange(len(codes)) + n <= ends)
            found.append((rolled[inside] ^ np.uint64(n)) * PRIME >> np.uint64(48))
            owners.append(word[inside])
        at = np.arange(len(codes)) - (ends - lengths[word])
        powers = np.cumprod(np.full(LONGEST * 3 + 3, PRIME))
        whole = np.add.reduceat(codes * powers[at], np.cumsum(lengths) - lengths)
        found.append((whole ^ np.uint64(5)) * PRIME >> np.uint64(48))
        owners.append(np.arange(len(marked)))
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, script, n) of the n-grams and of the letters by script of each language in this task."""
    words: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text)[1])
    for lang, found in words.items():
        total, letters, names = np.zeros(GRAMS, np.int64), Counter(), list(found)
        for i in range(0, len(names), 10_000):
            some = names[i : i + 10_000]
            buckets, owners = grams(some)
            total += np.bincount(buckets, np.array([found[w] for w in some])[owners], GRAMS).astype(np.int64)
            for w, x in zip(some, scripts(some), strict=True):
                letters[x] += found[w] * len(w)
        some = np.flatnonzero(total)
        k = len(some) + len(letters)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([*some.tolist(), *[-1] * len(letters)], pa.int32()), pa.array([*[None] * len(some), *letters], pa.string()), pa.array([*total[some].tolist(), *letters.values()], pa.int64())], names=["lang", "bucket", "script", "n"])


class Model:
    """Languages, their n-gram log probabilities, and the scripts that each of them uses."""

    def __init__(self, rows: list[tuple[str, int, str | None, int]]) -> None:
        self.langs = sorted({x[0] for x in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        counts, letters = np.zeros((GRAMS, len(self.langs))), {x: Counter() for x in self.langs}
        for lang, bucket, name, n in rows:
            if name is None:
                counts[bucket, at[lang]] += n
            else:
                letters[lang][name] += n
        self.logs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * GRAMS)).astype(np.float32)
        self.uses = {s: np.array([letters[x][s] >= SCRIPT_SHARE * letters[x].total() for x in self.langs]) for s in {n for c in letters.values() for n in c}}

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: zero for the best language, less for others, a large loss for those without the word's script."""
        buckets, owners = grams(words)
        order = np.argsort(owners, kind="stable")
        sizes = np.bincount(owners, minlength=len(words))
        made = np.add.reduceat(self.logs[buckets[order]], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        made *= np.minimum(8.0, 2 + 0.5 * np.fromiter(map(len, words), np.int64, len(words)))[:, None]
        names = np.array(scripts(words))
        for name, able in self.uses.items():
            rows = names == name
            if able.any() and not able.all() and rows.any():
                made[np.ix_(rows, ~able)] = made[rows].min(axis=1, keepdims=True) - 40
        return np.maximum(made - made.max(axis=1, keepdims=True), -40).astype(np.float32)


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path; of equal paths the one that stays, then the first language."""
    n, k = scores.shape
    best = int(scores.sum(0, dtype=np.float64).argmax())
    gain = np.vstack((np.zeros((1, k)), np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)))
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(n, best)
    now, came, langs = scores[0].tolist(), [], range(k)
    for row in scores[1:].tolist():
        top = max(now)
        lead, switched = now.index(top), top - penalty
        came.append([i if now[i] >= switched else lead for i in langs])
        now = [(x if x >= switched else switched) + s for x, s in zip(now, row, strict=True)]
    at = now.index(max(now))
    path = [at]
    for row in reversed(came):
        at = row[at]
        path.append(at)
    return np.array(path[::-1])


class Labeller:
    """Labels texts, remembering the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows, self.table = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def __call__(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """The language of most letters, its share of the letters, and the spans (start, end, language)."""
        patterns, words = zip(*map(words_of, texts), strict=True) if texts else ((), ())
        if not self.model.langs:
            return [("und", 0.0, [])] * len(texts)
        if len(self.rows) > REMEMBERED:
            self.rows, self.table = {}, self.table[:0]
        new = list(set().union(*words).difference(self.rows))
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.table = np.vstack((self.table, self.model.scores(new)))
        return [self._label(t, p, w) if w else ("und", 0.0, []) for t, p, w in zip(texts, patterns, words, strict=True)]

    def _label(self, text: str, pattern: re.Pattern[str], words: list[str]) -> tuple[str, float, list[tuple[int, int, str]]]:
        langs = self.model.langs
        path = best_path(self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))])
        letters = np.bincount(path, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(langs))
        best = int(letters.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(words)]
        if len(cuts) == 2:  # the first letter to the last
            spans = [(text.index(words[0]), text.rindex(words[-1]) + len(words[-1]), langs[best])]
        else:
            places = [m.span() for m in pattern.finditer(text)]
            spans = [(places[i][0], places[j - 1][1], langs[path[i]]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return langs[best], float(letters[best] / letters.sum()), spans


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From rows (doc_id, text, lang); null languages and texts without letters teach nothing."""
    known = labelled.where("lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count_distinct("hash").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model([])
    # of each language the documents whose hash is in the lowest part that holds `sample` of them on average
    edge = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n) * 2.0**32)))
    some = known.where(F.pmod("hash", F.lit(1 << 32)) < edge[F.col("lang")]).dropDuplicates(["lang", "hash"]).select("lang", "text")
    made = some.mapInArrow(_counted, "lang string, bucket int, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n"))
    rows = made.toArrow()  # at most GRAMS and the scripts for each language
    return Model(list(zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True)))


SPANS = "doc_id long, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row.

    lang_pred is the language of most letters (of equally many the first by name), score its share of the letters, spans the runs
    of words of one language in code points, end exclusive. A text that is null, empty or without letters (numerals such as ½ are none) is `und` with
    score 0 and no spans, and so is every text if nothing was learned. Texts of any length are read whole. Repeated rows are labelled alike; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value)
        for b in (x.slice(i, 1024) for x in batches for i in range(0, x.num_rows, 1024)):
            found = label(b.column(1).to_pylist())
            spans = [[{"start": s, "end": e, "lang": k} for s, e, k in x[2]] for x in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return only(docs, doc_id, text).mapInArrow(run, SPANS)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    model = learn(rows.where(F.coalesce(remainder("doc_id", 5), F.lit(1)) != 0))
    return identify(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
