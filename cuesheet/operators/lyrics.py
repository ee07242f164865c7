"""Lyric lines and their alignment to recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators.asof import next_non_null_start
from cuesheet.operators.intervals import Keys, islands, to_millis

# The pattern of a time stamp, and of metadata lines.
STAMP = r"\[(\d{2}):(\d{2})(?:\.(\d{1,3}))?\]"
META = r"(?i)^\[(ti|ar|al|au|by|offset|length|tool|ve):"


def parse_lrc(texts: DataFrame, keys: Keys, text: str) -> DataFrame:
    """A row for each stamp of each lyric line, in order: keys, index, text, t (null without a stamp), end_s (the next row's start).

    Metadata and empty lines are dropped. A fraction is tenths, hundredths or thousandths by its digits.
    """
    lines = texts.select(*keys, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("_line", "_raw")).withColumn("_raw", F.trim("_raw"))
    lines = lines.where((F.col("_raw") != "") & ~F.col("_raw").rlike(META)).withColumn("text", F.trim(F.regexp_replace("_raw", STAMP, ""))).where("text <> ''")
    stamps = F.regexp_extract_all("_raw", F.lit(STAMP), F.lit(0))
    part = lambda i: F.regexp_extract("_stamp", STAMP, i)
    rows = lines.select(*keys, "_line", "text", F.posexplode_outer(stamps).alias("_nr", "_stamp"))
    fraction = F.when(part(3) == "", 0.0).otherwise(part(3).cast("int") / F.pow(F.lit(10.0), F.length(part(3))))
    rows = rows.withColumn("t", F.when(F.col("_stamp").isNotNull(), part(1).cast("int") * 60 + part(2).cast("int") + fraction))
    w = Window.partitionBy(*keys).orderBy("_line", "_nr")
    after = F.lead("t").over(w)
    return rows.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("index"), "text", "t", F.when(F.col("t").isNotNull() & after.isNotNull(), F.greatest("t", after)).alias("end_s"))


def parse_lrc_first_stamp(texts: DataFrame, keys: Keys, text: str, credits: str) -> DataFrame:
    """The variant with the earliest stamp of a line, without credit lines, each text once at its first time, in time order: keys, index, text, t."""
    rows = parse_lrc(texts, keys, text).where(F.col("t").isNotNull() & ~F.col("text").rlike(credits))
    first = rows.groupBy(*keys, "text").agg(F.min("t").alias("t"))
    return first.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("t", "text")) - 1).cast("long").alias("index"), "text", "t")


def clean_words(words: DataFrame, time_unit: str = "s") -> DataFrame:
    """Words with text and times in seconds: blank ones go, starts are at least 0, ends at least 0.08 s after the start if they weren't after it."""
    scale = {"s": 1.0, "ms": 0.001}[time_unit]
    rows = words.withColumns({"word": F.trim("word"), "start_s": F.expr("try_cast(start_s AS double)") * scale, "end_s": F.expr("try_cast(end_s AS double)") * scale})
    rows = rows.where("word <> '' and start_s is not null and end_s is not null")
    end = F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + 0.08).otherwise(F.col("end_s"))
    return rows.withColumns({"end_s": end, "start_s": F.greatest(F.lit(0.0), F.col("start_s"))})


def time_windows(words: DataFrame, keys: Keys, order: Keys, step: float = 0.25, half: float = 3.2) -> DataFrame:
    """Windows of 2 x half seconds every `step` seconds with the words that touch them: keys, center, text, n."""
    centres = F.sequence(F.ceil((F.col("start_s") - half) / step).cast("long"), F.floor((F.col("end_s") + half) / step).cast("long"))
    rows = words.select(*keys, F.explode(centres).alias("_c"), F.struct(*order, "word").alias("_w")).where("_c >= 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_w")), lambda w: w["word"]), "")
    return rows.groupBy(*keys, "_c").agg(text.alias("text"), F.count("*").alias("n")).select(*keys, (F.col("_c") * step).alias("center"), "text", "n")


def enforce_monotone_starts(lines: DataFrame, keys: Keys, order: str, step: float = 0.02, shortest: float = 0.35) -> DataFrame:
    """Starts at least `step` after the one before, ends at least `shortest` after the start, to 3 decimals.

    The running largest of start - step x i, plus step x i, is what repeated pushing gives.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumn("_i", F.row_number().over(w))
    pushed = F.max(F.col("start_s") - step * F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + step * F.col("_i")
    rows = rows.withColumn("start_s", pushed)
    return rows.withColumns({"end_s": to_millis(F.greatest(F.col("end_s"), F.col("start_s") + shortest)), "start_s": to_millis(F.col("start_s"))}).drop("_i")


def trim_to_next_start(lines: DataFrame, keys: Keys, order: str, shortest: float = 0.35, gap: float = 0.03) -> DataFrame:
    """Ends that reach the next start are cut `gap` before it, but keep `shortest`."""
    after = F.lead("start_s").over(Window.partitionBy(*keys).orderBy(order))
    cut = to_millis(F.greatest(F.col("start_s") + shortest, F.col("_next") - gap))
    return lines.withColumn("_next", after).withColumn("end_s", F.when(F.col("end_s") >= F.col("_next"), cut).otherwise(F.col("end_s"))).drop("_next")


def fuse_alignments(a: DataFrame, b: DataFrame, keys: Keys, near: float = 0.6) -> DataFrame:
    """Two engines' lines (start_s, confidence, confirmed) as one: near confirmed ones weighted by confidence, others the more confident, for
    review; one-sided ones as they are. Columns start_s, confidence, status."""
    x = a.select(*keys, F.struct("start_s", "confidence", "confirmed").alias("x"))
    y = b.select(*keys, F.struct("start_s", "confidence", "confirmed").alias("y"))
    both = x.join(y, list(keys), "full_outer")
    agree = F.col("x.confirmed") & F.col("y.confirmed") & (F.abs(F.col("x.start_s") - F.col("y.start_s")) < near)
    weight = F.col("x.confidence") + F.col("y.confidence")
    mean = F.when(weight > 0, (F.col("x.start_s") * F.col("x.confidence") + F.col("y.start_s") * F.col("y.confidence")) / weight).otherwise(F.col("x.start_s"))
    better = F.when(F.col("y").isNull() | (F.coalesce("x.confidence", F.lit(-1.0)) >= F.coalesce("y.confidence", F.lit(-1.0))), F.col("x")).otherwise(F.col("y"))
    one = F.col("x").isNull() | F.col("y").isNull()
    status = F.when(one, F.when(better["confirmed"], "confirmed").otherwise("review")).when(agree, "confirmed").otherwise("review")
    return both.select(*keys, F.when(agree, mean).otherwise(better["start_s"]).alias("start_s"), F.when(agree, F.greatest("x.confidence", "y.confidence")).otherwise(better["confidence"]).alias("confidence"), status.alias("status"))


def alignment_summary(lines: DataFrame, keys: Keys) -> DataFrame:
    """Of lines (status, shift_s): shares and counts by status, mean shift, and how much drift is to be feared."""
    found = lines.groupBy(*keys).agg(F.avg((F.col("status") == "confirmed").cast("double")).alias("confirmed_ratio"), F.count_if(F.col("status") == "review").alias("review"), F.count_if(F.col("status") == "interpolated").alias("interpolated"), F.avg(F.abs("shift_s")).alias("mean_shift"))
    return found.withColumn("drift_risk", F.when(F.col("confirmed_ratio") >= 0.7, "low").when(F.col("confirmed_ratio") >= 0.4, "medium").otherwise("high"))


def hotwords(lines: DataFrame, keys: Keys, text: str, k: int) -> DataFrame:
    """The k commonest pairs of adjacent characters of each timeline's text, of equally common ones the first by text: keys, gram, n, nr."""
    rows = lines.select(*keys, F.regexp_extract_all(text, F.lit(r"\S"), F.lit(0)).alias("_c"))
    n = F.greatest(F.lit(0), F.size("_c") - 1)
    grams = F.zip_with(F.slice("_c", F.lit(1), n), F.slice("_c", F.lit(2), n), lambda a, b: F.concat(a, b))
    counts = rows.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")).cast("long")
    return counts.withColumn("nr", nr).where(F.col("nr") <= k)


def weighted_transform_fusion(rows: DataFrame, keys: Keys) -> DataFrame:
    """Offset and scale of several engines, weighted by confirmed_ratio; (0, 1) without weight."""
    mean = lambda c, d: F.coalesce(F.sum(F.col(c) * F.col("confirmed_ratio")) / F.nullif(F.sum("confirmed_ratio"), F.lit(0.0)), F.lit(d)).alias(c)
    return rows.groupBy(*keys).agg(mean("offset", 0.0), mean("scale", 1.0))


def proportional_times(lines: DataFrame, keys: Keys, order: str, size: Column, duration: float, shortest: float = 0.2) -> DataFrame:
    """A duration shared among lines by their size; a line lasts at least `shortest`."""
    w = Window.partitionBy(*keys)
    rows = lines.withColumn("_u", F.greatest(F.lit(1), size).cast("double"))
    rows = rows.withColumns({"_all": F.sum("_u").over(w), "_to": F.sum("_u").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))})
    start, end = duration * (F.col("_to") - F.col("_u")) / F.col("_all"), duration * F.col("_to") / F.col("_all")
    return rows.withColumns({"start_s": start, "end_s": F.greatest(end, start + shortest)}).drop("_u", "_all", "_to")


def lines_in_time_window(lines: DataFrame, clip_start: float, duration: float) -> DataFrame:
    """Timed lines that touch a clip; a line without an end lasts 0.8 s."""
    return lines.where(F.col("t").isNotNull() & (F.coalesce("end_s", F.col("t") + 0.8) >= clip_start) & (F.col("t") <= clip_start + duration))


def slice_lines(lines: DataFrame, keys: Keys, order: str, start: int, end: int) -> DataFrame:
    """Lines by number, the range held inside what there is, at least one line."""
    w = Window.partitionBy(*keys)
    rows = lines.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    first = F.greatest(F.lit(0), F.least(F.lit(start), F.col("_n") - 1))
    last = F.greatest(first + 1, F.least(F.lit(end), F.col("_n")))
    return rows.where((F.col("_i") >= first) & (F.col("_i") < last)).drop("_i", "_n")


def merge_repeated_lines(lines: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Equal lines in a row as one, from the first's start to the last's end: keys, text, start_s, end_s, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = islands(lines, keys, [order], ~F.coalesce(F.col("text") == F.lag("text").over(w), F.lit(False)))
    return runs.groupBy(*keys, "island", "text").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n")).drop("island")


def word_progress(points: DataFrame, words: DataFrame, keys: Keys, sentence: str) -> DataFrame:
    """The share of a sentence's characters spoken before a time t inside it, a word under way counted in part: keys, sentence, t, progress."""
    units = F.greatest(F.lit(1), F.length(F.regexp_replace("word", r"\s", "")))
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("start_s")) / F.nullif(F.col("end_s") - F.col("start_s"), F.lit(0.0))))
    both = points.join(words.select(*keys, sentence, "word", "start_s", "end_s"), [*keys, sentence]).withColumn("_u", units)
    return both.groupBy(*keys, sentence, "t").agg((F.sum(F.col("_u") * done) / F.sum("_u")).alias("progress"))


def cut_candidate_score(prev_start: Column, next_end: Column, cut: Column, reference: Column, shortest: float, longest: float, base: Column) -> Column:
    """Struct rank, score, distance, cut; null for a cut that leaves a side of 0.1 s or less. The least struct is the best cut."""
    a, b = cut - prev_start, next_end - cut
    ok = (a >= shortest) & (b >= shortest) & (a <= longest * 1.10) & (b <= longest * 1.10)
    short = lambda x: F.when(x < shortest, (shortest - x) * 20).otherwise(0.0)
    long = lambda x: F.when(x > longest * 1.10, (x - longest) * 4).otherwise(0.0)
    score = base + F.abs(cut - reference) * 0.05 + short(a) + short(b) + long(a) + long(b)
    return F.when((a > 0.1) & (b > 0.1), F.struct(F.when(ok, 0).otherwise(1).alias("rank"), score.alias("score"), F.abs(cut - reference).alias("distance"), cut.alias("cut")))


def transcript_stability(words: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """Of recognised words: the share with a likely duration (0.02 to 4 s), the share that doesn't go back in time (by over 0.15 s), and their mean."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = words.withColumn("_before", F.lag("start_s").over(w))
    valid = F.avg((F.col("end_s") - F.col("start_s")).between(0.02, 4.0).cast("double"))
    forward = F.avg((F.col("_before").isNull() | (F.col("start_s") >= F.col("_before") - 0.15)).cast("double"))
    return rows.groupBy(*keys).agg(valid.alias("valid_share"), forward.alias("monotone_share"), ((valid + forward) / 2).alias("stability"))


def transcript_quality(words: DataFrame, lyrics: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """Coverage of the lyrics (lyrics) by the words in order, first 1200 characters of each, blended 0.72 to 0.28 with the words' stability."""
    said = words.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "word"))), lambda x: x["word"]), "").alias("_said"))
    both = said.join(lyrics, list(keys)).join(transcript_stability(words, keys, order), list(keys))
    rows = both.withColumn("coverage", tx.text_similarity(F.substring("_said", 1, 1200), F.substring("lyrics", 1, 1200)))
    return rows.select(*keys, "coverage", "stability", (0.72 * F.col("coverage") + 0.28 * F.col("stability")).alias("quality"))


def lines_to_segments(lines: DataFrame, keys: Keys, order: Keys, duration: float, clip_start: float, clip_end: float, shortest: float = 0.8) -> DataFrame:
    """Timed lines (t, text) that touch a clip as sentences in the clip's time, cut to it; a line ends where the next timed one starts, at `duration` the last."""
    timed = next_non_null_start(lines, keys, order, duration, shortest).where("trim(text) <> ''")
    inside = timed.where((F.col("end_s") > clip_start) & (F.col("t") < clip_end))
    last = F.least(F.lit(clip_end - clip_start), F.greatest(F.col("end_s") - clip_start, F.col("t") - clip_start + shortest))
    return inside.withColumns({"start_s": F.greatest(F.lit(0.0), F.col("t") - clip_start), "end_s": last}).where("end_s > 0")


def joined_result(sentences: DataFrame, keys: Keys, order: str) -> DataFrame:
    """One row for each timeline: its sentences' trimmed text in order, a line each, and their number."""
    rows = sentences.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.trim("text").alias("text")))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("text"), F.size("x").cast("long").alias("n"))
