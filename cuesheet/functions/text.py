"""Text of lyrics, titles, paths and subtitles as column expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Punctuation dropped before lyrics are compared, title placeholders, words of file and title noise.
ALIGN_PUNCTUATION = r"[\s　、。！，．：；？（）—‘’\"'…“”]"
UNKNOWN_NAMES = ("unknown", "n_a", "na", "null", "none", "???")
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10)))
TITLE_NOISE = "live|music|mv|karaoke|official|version|ver"
QUOTES = "\"'“”‘’"


def norm_text_align(text: Column, keep_ascii: bool = True) -> Column:
    """Without blanks and punctuation; in compat mode (keep_ascii false) also without ASCII letters and digits."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), ALIGN_PUNCTUATION, "")
    return bare if keep_ascii else F.regexp_replace(bare, "[a-zA-Z0-9_]+", "")


def norm_text_key(text: Column) -> Column:
    """Lower case, without bracketed tags, word characters only."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\[[^\]]+\]", "")
    return F.regexp_replace(low, r"[^\p{L}\p{N}_]+", "")


def song_key(title: Column, artist: Column) -> Column:
    return F.concat(norm_text_key(title), F.lit("::"), norm_text_key(artist))


def norm_title(text: Column) -> Column:
    """Lower case, without bracketed text and words of noise; ASCII letters, digits and CJK only."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\(\[\{<].*?[\)\]\}>]", " ")
    return F.regexp_replace(F.regexp_replace(low, f"({TITLE_NOISE})", " "), r"[^0-9a-z一-龥]+", "")


def clean_ocr_text(text: Column) -> Column:
    one_line = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[\r\n\t]+", " ")
    spaced = F.trim(F.regexp_replace(one_line, r"\s{2,}", " "))
    return F.substring(F.regexp_replace(spaced, r"[|｜]+", " | "), 1, 120)


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC; null stays null."""
    return pd.Series([None if x is None or x != x else unicodedata.normalize("NFKC", x) for x in text], dtype=object)


def nfkc(text: Column) -> Column:
    """NFKC; ASCII texts, which it doesn't change, don't leave the JVM."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, text).otherwise(compatible(F.when(~plain, text)))


def sanitize_filename(text: Column, fallback: str = "unknown") -> Column:
    """A safe file name: NFKC, no control characters, illegal ones and blanks as `_`, reserved names suffixed."""
    value = F.regexp_replace(F.trim(nfkc(F.coalesce(text, F.lit("")))), r"[\x00-\x1f]+", "")
    value = F.regexp_replace(F.regexp_replace(value, r'[\\/:*?"<>|]+', "_"), r"\s+", "_")
    value = F.regexp_replace(F.regexp_replace(value, "_+", "_"), r"^[ ._]+|[ ._]+$", "")
    safe = F.when(F.upper(value).isin(*RESERVED_NAMES), F.concat(value, F.lit("_"))).otherwise(value)
    return F.when((value == "") | F.lower(value).isin(*UNKNOWN_NAMES), F.lit(fallback)).otherwise(safe)


def normalize_pasted_path(path: Column) -> Column:
    """Trimmed, without up to four layers of quotes around it; null as empty."""
    value = F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), "^﻿+", "")
    for _ in range(4):
        value = F.regexp_replace(F.trim(value), rf"(?s)^[{QUOTES}](.*)[{QUOTES}]$", "$1")
    return F.trim(value)


def parse_performer_event(stem: Column) -> Column:
    """Struct performer, event: split at ` - `, `_` or ` live `, in this order, without bracketed tails and leading digits; null if too short."""
    base = F.trim(F.regexp_replace(F.regexp_replace(stem, r"[\(\[【（].*$", ""), r"^[0-9]+[ ._-]*", ""))
    pairs = [(F.regexp_extract(base, p, 1), F.regexp_extract(base, p, 2)) for p in (r"^(.+?) +- +(.+)$", r"^([^_]+)_(.+)$", r"(?i)^(.+?) +live +(.+)$")]
    ok = lambda a: (F.length(F.trim(a)) >= 2) & ~F.trim(a).rlike("^[0-9]+$")
    return F.coalesce(*(F.when(ok(a), F.struct(F.trim(a).alias("performer"), F.trim(b).alias("event"))) for a, b in pairs))


def title_unknown(title: Column) -> Column:
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).isin("", "unknown", "none", "null", "n/a", "未知歌曲", "未识别歌曲")


def title_low_quality(title: Column) -> Column:
    return title_unknown(title) | (F.length(title) > 40) | title.rlike(r"(?i)(live|official|karaoke|www\.|http)") | title.rlike(r"[-_|/·]{2,}")


def hint_usable(title: Column) -> Column:
    """Whether a title names a song and isn't a placeholder such as song_01."""
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & ~F.lower(F.trim(title)).rlike(r"^song[_ -]?[0-9]+$")


def needs_space(a: Column, b: Column) -> Column:
    return a.rlike("[A-Za-z0-9]$") & b.rlike("^[A-Za-z0-9]")


def ends_with_punctuation(text: Column) -> Column:
    return F.trim(text).rlike("[。！？!?,，、；;：:.…]$")


def format_ass_time(seconds: Column) -> Column:
    """h:mm:ss.cc, negative times as zero."""
    s = F.greatest(F.lit(0.0), seconds)
    return F.format_string("%d:%02d:%05.2f", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60), F.pmod(s, F.lit(60.0)))


def format_srt_time(seconds: Column) -> Column:
    """hh:mm:ss,mmm."""
    ms = F.floor(F.greatest(F.lit(0.0), seconds) * 1000 + 1e-6).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def escape_ass(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.replace(out, F.lit("\n"), F.lit("\\N"))


def escape_srt(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def estimated_line_seconds(text: Column) -> Column:
    return F.greatest(F.lit(0.9), F.least(F.lit(4.5), 1.0 + 0.09 * F.length(norm_text_align(text))))


def text_units(text: Column) -> Column:
    return F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"\s", "")))


# Marks after which a subtitle may be cut, and those after which a line may be broken.
SPLIT_MARKS = "。！？、，；：,.;:!? "
WRAP_MARKS = "。！？、，；：,.;:!?"


def auto_wrap(text: Column, max_chars: int = 10, joint: str = "\\N") -> Column:
    """The text in lines of at most max_chars: broken after the first mark in the second half of a line, else at the limit; null as it is."""
    some = rf"(?s).{{1,{max_chars}}}\z|.{{{max(1, max_chars // 2) - 1},{max_chars - 1}}}?[{WRAP_MARKS}]|.{{{max_chars}}}"
    return F.array_join(F.regexp_extract_all(text, F.lit(some), F.lit(0)), joint)


def subtitle_split_index(text: Column, max_chars: int = 10) -> Column:
    """Where to cut a text: its length if it is short, else after the last punctuation of the final four places, else at the limit."""
    n = F.length(text)
    end, start = F.least(n - 1, F.lit(max_chars)), max(1, max_chars - 4)
    places = F.filter(F.sequence(F.lit(start), F.greatest(end, F.lit(start))), lambda i: (i <= end) & F.contains(F.lit(SPLIT_MARKS), F.substring(text, i, F.lit(1))))
    return F.when(n <= max_chars, n).otherwise(F.coalesce(F.array_max(places), F.least(F.lit(max_chars), n - 1)))


def strictness_threshold(base: Column, strictness: Column) -> Column:
    """The confidence that a line needs, moved by the strictness and held in [0.25, 0.9]."""
    s = F.lower(F.trim(F.coalesce(strictness, F.lit("standard"))))
    bias = F.when(s.isin("strict", "严格"), 0.08).when(s.isin("loose", "宽松"), -0.07).otherwise(0.0)
    return F.least(F.lit(0.9), F.greatest(F.lit(0.25), base + bias))


def similarity_floor(strictness: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(strictness, F.lit("standard"))))
    return F.when(s.isin("strict", "严格"), 0.34).when(s.isin("loose", "宽松"), 0.28).otherwise(0.30)


def vocabulary_overlap(text: Column, stopwords: str) -> Column:
    return F.size(F.array_intersect(F.split(text, ""), F.array(*map(F.lit, stopwords))))


def title_from_lyrics(text: Column) -> Column:
    """The first title in quotes or brackets, of 2 to 30 characters; null without."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ("《([^》]{2,30})》", "“([^”]{2,30})”", '"([^"]{2,30})"', "【([^】]{2,30})】")]
    return F.coalesce(*found)


class BitMatcher(SequenceMatcher):
    """difflib's matcher, with the same matches; the longest one of a large block is found in one integer, a bit for each equal pair of characters."""

    #: blocks of fewer pairs are left to difflib
    LEAST = 1000

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> tuple[int, int, int]:
        a, b = self.a, self.b
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        if (ahi - alo) * (bhi - blo) < self.LEAST:
            return super().find_longest_match(alo, ahi, blo, bhi)
        # a row of bytes for each character of a, with a free bit at its end, so that no run of the diagonal goes on in the next row but one
        wide, rows = (bhi - blo) // 8 + 1, {}
        for c in set(a[alo:ahi]):
            rows[c] = sum(1 << j - blo for j in self.b2j.get(c, ()) if blo <= j < bhi).to_bytes(wide, "little")
        runs = [int.from_bytes(b"".join(map(rows.__getitem__, a[alo:ahi])), "little")]
        i, j, size, step = alo, blo, 0, 8 * wide + 1
        if runs[0]:
            # runs[k] has the places where 2^k equal pairs begin
            while longer := runs[-1] & runs[-1] >> (step << len(runs) - 1):
                runs.append(longer)
            found, size = runs[-1], 1 << len(runs) - 1
            for k in range(len(runs) - 2, -1, -1):
                if longer := found & runs[k] >> step * size:
                    found, size = longer, size + (1 << k)
            y, x = divmod((found & -found).bit_length() - 1, 8 * wide)
            i, j = alo + y, blo + x
        # very frequent characters of a long text are not in b2j; they lengthen a match only
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        return i, j, size


def whole_ratio(x: str, y: str) -> float:
    return BitMatcher(None, x, y).ratio()


#: the ratios of short texts, which recur, are remembered
short_ratio = lru_cache(1 << 16)(whole_ratio)


def ratio(x: str, y: str) -> float:
    """difflib's ratio of two texts."""
    return short_ratio(x, y) if len(x) + len(y) <= 128 else whole_ratio(x, y)


def lifted(found: float, x: str, y: str) -> float:
    """A ratio of two texts, neither of them empty, raised to floors where one holds the other."""
    held = 0.45 * len(y) / len(x) + 0.08 if y in x else 0.40 * len(x) / len(y) + 0.08 if x in y else 0.0
    return min(1.0, max(found, held))


def lifted_ratio(matcher: SequenceMatcher, x: str, y: str) -> float:
    """The ratio of x and the matcher's second text y, lifted."""
    matcher.set_seq1(x)
    return lifted(matcher.ratio(), x, y)


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, raised to floors where one text holds the other; 0 where either is empty."""
    return pd.Series([lifted(ratio(x, y), x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def plain_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio alone."""
    return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def text_similarity(a: Column, b: Column, keep_ascii: bool = True) -> Column:
    """`similarity_ratio` of the texts without blanks and punctuation; where one holds the other its matches are known, and they don't leave the JVM."""
    x, y = norm_text_align(a, keep_ascii), norm_text_align(b, keep_ascii)
    n, m = F.length(x), F.length(y)
    # from 200 characters on difflib leaves out the frequent ones
    inside = (x != "") & (y != "") & (m < 200) & (F.contains(x, y) | F.contains(y, x))
    held = F.when(F.contains(x, y), 0.45 * m / n + 0.08).otherwise(0.40 * n / m + 0.08)
    known = F.least(F.lit(1.0), F.greatest(2.0 * F.least(n, m) / (n + m), held))
    return F.when(inside, known).otherwise(similarity_ratio(F.when(~inside, x), F.when(~inside, y)))


def title_similarity(a: Column, b: Column) -> Column:
    return plain_ratio(norm_title(a), norm_title(b))


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts is larger: a filter before the dear comparison."""
    return 2 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0))
