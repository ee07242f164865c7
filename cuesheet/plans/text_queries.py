"""Text, lyric, cache and document operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators import cache as ca
from cuesheet.operators import folds as fo
from cuesheet.operators import lyrics as ly
from cuesheet.operators import snapping as sn
from cuesheet.operators import titles as ti
from cuesheet.plans.fold_queries import CHUNKS
from cuesheet.plans.registry import query
from cuesheet.plans.song_queries import SPLIT
from cuesheet.sources import documents as dc

M = ["media_id"]
TASKS = 96
# a lyric text for each sentence: its words as stamped lines
LRC = "lrc AS (SELECT media_id, pos, '[ti:x]' || chr(10) || '[00:' || lpad((pos % 60)::VARCHAR, 2, '0') || '.5][01:' || lpad((pos % 60)::VARCHAR, 2, '0') || '.25]' || replace(text, chr(10), chr(10) || '[02:10.125]') || chr(10) || ' tail ' AS lrc FROM sent)"


def lrc(v):
    two = F.lpad((F.col("pos") % 60).cast("string"), 2, "0")
    text = F.concat(F.lit("[ti:x]\n[00:"), two, F.lit(".5][01:"), two, F.lit(".25]"), F.replace("text", F.lit("\n"), F.lit("\n[02:10.125]")), F.lit("\n tail "))
    return v.sent.select("media_id", "pos", text.alias("lrc"))


STAMPED = r"""l AS (SELECT media_id, pos, generate_subscripts(w, 1) AS ln, trim(unnest(w)) AS raw FROM (SELECT media_id, pos, string_split(lrc, chr(10)) AS w FROM lrc)),
    k AS (SELECT *, trim(regexp_replace(raw, '\[\d{2}:\d{2}(?:\.\d{1,3})?\]', '', 'g')) AS text, regexp_extract_all(raw, '\[\d{2}:\d{2}(?:\.\d{1,3})?\]') AS st FROM l WHERE raw <> '' AND NOT regexp_matches(raw, '^\[(ti|ar|al|au|by|offset|length|tool|ve):', 'i')),
    e AS (SELECT media_id, pos, ln, text, generate_subscripts(CASE WHEN len(st) = 0 THEN [NULL] ELSE st END, 1) AS nr, unnest(CASE WHEN len(st) = 0 THEN [NULL] ELSE st END) AS stamp FROM k WHERE text <> ''),
    t AS (SELECT *, CASE WHEN stamp IS NOT NULL THEN stamp[2:3]::INT * 60 + stamp[5:-2]::DOUBLE END AS t FROM e),
    p AS (SELECT media_id, pos, row_number() OVER w - 1 AS index, text, t, CASE WHEN t IS NOT NULL AND lead(t) OVER w IS NOT NULL THEN greatest(t, lead(t) OVER w) END AS end_s FROM t WINDOW w AS (PARTITION BY media_id, pos ORDER BY ln, nr))"""


@query("P01_parse_lrc", f"WITH {LRC}, {STAMPED} SELECT * FROM p", "t end_s")
def p01(v):
    return ly.parse_lrc(lrc(v), ["media_id", "pos"], "lrc")


@query("P02_parse_lrc_first_stamp", f"WITH {LRC}, {STAMPED} SELECT media_id, pos, row_number() OVER (PARTITION BY media_id, pos ORDER BY t, text) - 1 AS index, text, t FROM (SELECT media_id, pos, text, min(t) AS t FROM p WHERE t IS NOT NULL AND NOT regexp_matches(text, '^(The|Les) ') GROUP BY ALL)", "t")
def p02(v):
    return ly.parse_lrc_first_stamp(lrc(v), ["media_id", "pos"], "lrc", "^(The|Les) ")


@query("P03_clean_words", "SELECT media_id, pos, word_pos, trim(word) AS word, greatest(0.0, (start_s - 1) / 1) AS start_s, CASE WHEN word_pos % 7 = 0 THEN start_s - 1 + 0.08 ELSE end_s - 1 END AS end_s FROM word WHERE trim(word) <> ''", "start_s end_s")
def p03(v):
    rows = v.word.select("media_id", "pos", "word_pos", "word", (F.col("start_s") - 1).alias("start_s"), F.when(F.col("word_pos") % 7 == 0, F.col("start_s") - 1).otherwise(F.col("end_s") - 1).alias("end_s"))
    return ly.clean_words(rows).withColumn("word_pos", F.col("word_pos").cast("long"))


@query("P16_slice_lines", "SELECT media_id, line FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY line) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM line) WHERE i >= greatest(0, least(2, n - 1)) AND i < greatest(greatest(0, least(2, n - 1)) + 1, least(6, n))")
def p16(v):
    return ly.slice_lines(v.line, M, "line", 2, 6).select("media_id", "line")


@query("P17_lines_in_time_window", "SELECT media_id, line FROM line WHERE t IS NOT NULL AND t + 0.8 >= 10 AND t <= 40")
def p17(v):
    return ly.lines_in_time_window(v.line.withColumn("end_s", F.lit(None).cast("double")), 10.0, 30.0).select("media_id", "line")


@query("P18_title_low_quality", "SELECT page_id, lower(trim(title)) IN ('', 'unknown', 'none', 'null', 'n/a') AS unknown_, lower(trim(title)) IN ('', 'unknown', 'none', 'null', 'n/a') OR length(title) > 40 OR regexp_matches(title, '(live|official|karaoke|www\\.|http)', 'i') OR regexp_matches(title, '[-_|/·]{2,}') AS low FROM title")
def p18(v):
    return v.title.select("page_id", tx.title_unknown(F.col("title")).alias("unknown_"), tx.title_low_quality(F.col("title")).alias("low"))


@query("P20_keep_title_frames", "SELECT page_id FROM title WHERE page_id % 100 / 100.0 > CASE WHEN length(title) > 30 THEN 0.6 ELSE 0.8 END")
def p20(v):
    return v.title.where(F.col("page_id") % 100 / 100 > F.when(F.length("title") > 30, 0.6).otherwise(0.8)).select("page_id")


@query("P22_parse_performer_event", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN split_part(title, ' ', 1) ELSE split_part(title, ' ', 2) END AS performer, CASE WHEN page_id % 2 = 0 THEN 'Tour' ELSE 'Hall' END AS event FROM title WHERE regexp_matches(title, '^[A-Za-z]{2,} [A-Za-z]{2,} ')")
def p22(v):
    rows = v.title.where(F.col("title").rlike("^[A-Za-z]{2,} [A-Za-z]{2,} "))
    stem = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("01. "), F.split_part("title", F.lit(" "), F.lit(1)), F.lit(" - Tour (2024)"))).otherwise(F.concat(F.split_part("title", F.lit(" "), F.lit(2)), F.lit("_Hall [x]")))
    return rows.select("page_id", tx.parse_performer_event(stem).alias("x")).select("page_id", "x.performer", "x.event")


@query("P23_sanitize_filename", r"""SELECT page_id, CASE WHEN v = '' OR lower(v) IN ('unknown', 'n_a', 'na', 'null', 'none', '???') THEN 'unknown' ELSE v END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '[\x00-\x1f]+', '', 'g'), '[\\/:*?"<>|]+', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS v FROM title)""")
def p23(v):
    return v.title.select("page_id", tx.sanitize_filename(F.col("title")).alias("name"))


@query("P24_normalize_pasted_path", "SELECT page_id, path AS clean FROM path")
def p24(v):
    quoted = F.concat(F.lit(" \""), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("“"), F.col("path"), F.lit("”"))).otherwise(F.col("path")), F.lit("\" "))
    return v.path.select("page_id", tx.normalize_pasted_path(quoted).alias("clean"))


@query("P27_hint_usable", "SELECT page_id, trim(title) <> '' AND page_id % 3 <> 0 AS usable FROM title")
def p27(v):
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Song_0"), F.col("page_id"))).otherwise(F.col("title"))
    return v.title.select("page_id", tx.hint_usable(name).alias("usable"))


@query("F01_norm_text_align", "SELECT media_id, line, regexp_replace(text, '[\\s　、。！，．：；？（）—‘’\"''…“”]', '', 'g') AS norm, regexp_replace(regexp_replace(text, '[\\s　、。！，．：；？（）—‘’\"''…“”]', '', 'g'), '[a-zA-Z0-9_]+', '', 'g') AS compat FROM line")
def f01(v):
    return v.line.select("media_id", "line", tx.norm_text_align(F.col("text")).alias("norm"), tx.norm_text_align(F.col("text"), False).alias("compat"))


@query("F02_song_key", r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(title)), '\[[^\]]+\]', '', 'g'), '[^\p{L}\p{N}_]+', '', 'g') || '::x' AS key FROM title")
def f02(v):
    return v.title.select("page_id", tx.song_key(F.col("title"), F.lit(" X! ")).alias("key"))


@query("F03_norm_title", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[\(\[\{<].*?[\)\]\}>]', ' ', 'g'), '(live|music|mv|karaoke|official|version|ver)', ' ', 'g'), '[^0-9a-z一-龥]+', '', 'g') AS norm FROM title")
def f03(v):
    return v.title.select("page_id", tx.norm_title(F.col("title")).alias("norm"))


@query("F04_clean_ocr_text", r"SELECT media_id, line, substr(regexp_replace(trim(regexp_replace(regexp_replace(trim(text), '[\r\n\t]+', ' ', 'g'), '\s{2,}', ' ', 'g')), '[|｜]+', ' | ', 'g'), 1, 120) AS clean FROM line")
def f04(v):
    return v.line.select("media_id", "line", tx.clean_ocr_text(F.col("text")).alias("clean"))


@query("F05_text_similarity")
def f05(v):
    # dealt by number: comparing takes long for few bytes, and small parts would be put together
    dealt = lambda rows: rows.repartition(TASKS, "media_id", "line")
    pairs = dealt(v.line.where("line > 0").select("media_id", "line", "text")).join(dealt(v.line.select("media_id", (F.col("line") + 1).alias("line"), F.col("text").alias("before"))), ["media_id", "line"])
    return pairs.select("media_id", "line", tx.text_similarity(F.col("text"), F.col("before")).alias("similarity"))


@query("F06_title_similarity")
def f06(v):
    return v.title.join(v.title.select((F.col("page_id") + 1).alias("page_id"), F.col("title").alias("other")), "page_id").select("page_id", tx.title_similarity(F.col("title"), F.col("other")).alias("similarity"))


@query("F08_title_from_lyrics", "SELECT media_id, line, CASE WHEN line % 3 = 0 THEN substr(text, 1, 5) END AS title FROM line WHERE regexp_matches(substr(text, 1, 5), '^[a-zA-Z]{5}$')")
def f08(v):
    rows = v.line.where(F.substring("text", 1, 5).rlike("^[a-zA-Z]{5}$"))
    told = F.when(F.col("line") % 3 == 0, F.concat(F.lit("so 《"), F.substring("text", 1, 5), F.lit("》 \"other\""))).otherwise(F.lit("none"))
    return rows.select("media_id", "line", tx.title_from_lyrics(told).alias("title"))


@query("F09_format_times", "SELECT media_id, pos, printf('%d:%02d:%05.2f', floor(start_s / 3600)::INT, floor((start_s % 3600) / 60)::INT, start_s % 60) AS ass, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt FROM (SELECT *, floor(start_s * 1000 + 1e-6)::BIGINT AS ms FROM sent)")
def f09(v):
    return v.sent.select("media_id", "pos", tx.format_ass_time(F.col("start_s")).alias("ass"), tx.format_srt_time(F.col("start_s")).alias("srt"))


@query("F10_escape", r"SELECT page_id, replace(replace(replace(replace('{' || title || '}', '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\N') AS ass, replace(replace(replace('<' || title || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS srt FROM title")
def f10(v):
    return v.title.select("page_id", tx.escape_ass(F.concat(F.lit("{"), F.col("title"), F.lit("}"))).alias("ass"), tx.escape_srt(F.concat(F.lit("<"), F.col("title"), F.lit(">"))).alias("srt"))


@query("F12_cache_key", "SELECT entry_id, md5(concat_ws('_', 'h' || cache_key, entry_id, 'zh', 'ass')) AS key, sha1(bytes || 'head' || cache_key || 'tail' || entry_id) AS file_key FROM ttl")
def f12(v):
    key = ca.subtitle_cache_key(F.concat(F.lit("h"), F.col("cache_key")), F.col("entry_id"), F.lit("zh"), F.lit("ass"))
    file = ca.file_key(F.col("bytes"), F.concat(F.lit("head"), F.col("cache_key")), F.concat(F.lit("tail"), F.col("entry_id")))
    return v.ttl.select("entry_id", key.alias("key"), file.alias("file_key"))


@query("F13_strictness_threshold", "SELECT media_id, line, least(0.9, greatest(0.25, line % 10 / 10.0 + CASE line % 3 WHEN 0 THEN 0.08 WHEN 1 THEN -0.07 ELSE 0.0 END))::DOUBLE AS threshold, CASE line % 3 WHEN 0 THEN 0.34 WHEN 1 THEN 0.28 ELSE 0.3 END::DOUBLE AS floor_ FROM line", "threshold floor_")
def f13(v):
    word = F.when(F.col("line") % 3 == 0, " Strict").when(F.col("line") % 3 == 1, "loose")
    return v.line.select("media_id", "line", tx.strictness_threshold(F.col("line") % 10 / 10, word).alias("threshold"), tx.similarity_floor(word).alias("floor_"))


@query("F14_estimated_line_seconds", "SELECT media_id, line, greatest(0.9, least(4.5, 1.0 + 0.09::DOUBLE * length(regexp_replace(text, '[\\s　、。！，．：；？（）—‘’\"''…“”]', '', 'g')))) AS seconds FROM line", "seconds")
def f14(v):
    return v.line.select("media_id", "line", tx.estimated_line_seconds(F.col("text")).alias("seconds"))


@query("F15_text_units", r"SELECT media_id, line, greatest(1, length(regexp_replace(text, '\s', '', 'g'))) AS units FROM line")
def f15(v):
    return v.line.select("media_id", "line", tx.text_units(F.col("text")).cast("long").alias("units"))


@query("F16_subtitle_split_index", "SELECT media_id, line, CASE WHEN length(text) <= 10 THEN length(text) ELSE coalesce(list_max(list_filter(range(6, least(length(text) - 1, 10) + 1), lambda i: contains('，。！？；：、,.!?;: ', substr(text, i, 1)))), least(10, length(text) - 1)) END AS at FROM line")
def f16(v):
    return v.line.select("media_id", "line", tx.subtitle_split_index(F.col("text")).cast("long").alias("at"))


@query("F17_auto_wrap", r"SELECT media_id, line, array_to_string(regexp_extract_all(text, '(?s).{1,10}\z|.{4,9}?[。！？、，；：,.;:!?]|.{10}'), '\N') AS wrapped FROM line")
def f17(v):
    return v.line.select("media_id", "line", tx.auto_wrap(F.col("text")).alias("wrapped"))


@query("F18_joints", "SELECT media_id, pos, word_pos, regexp_matches(word, '[A-Za-z0-9]$') AS spaced, regexp_matches(trim(word), '[。！？!?,，、；;：:.…]$') AS ended FROM word")
def f18(v):
    return v.word.select("media_id", "pos", F.col("word_pos").cast("long").alias("word_pos"), tx.needs_space(F.col("word"), F.lit("a")).alias("spaced"), tx.ends_with_punctuation(F.col("word")).alias("ended"))


@query("F20_json_safe", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k')::INT END AS k, CASE WHEN event_id % 5 <> 0 THEN '{\"k\":' || json_extract_string(props, '$.k') || '}' ELSE '{}' END AS text FROM events")
def f20(v):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("oops "), F.col("props"))).otherwise(F.col("props"))
    rows = v.table("events").select("event_id", dc.json_safe(raw, "k int").alias("p"))
    return rows.select("event_id", "p.k", dc.json_text(F.col("p")).alias("text"))


@query("F21_first_visible_time", "SELECT media_id, (min(start_s) + arg_min(end_s, pos)) / 2 AS first_s FROM sent GROUP BY media_id", "first_s")
def f21(v):
    rows = v.sent.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start_s", "end_s"))).alias("s"))
    words = F.array().cast("array<struct<text: string, start_s: double, end_s: double>>")
    return rows.select("media_id", dc.first_visible_time(F.col("s"), words).alias("first_s"))


@query("F22_new_ids", "SELECT sample_id, 'sample_' || substr(sha256(sample_id || '|' || lang), 1, 16) AS id FROM lab")
def f22(v):
    return v.lab.select("sample_id", ca.new_id("sample_", F.col("sample_id"), F.col("lang")).alias("id"))


@query("F23_preview_key", "SELECT media_id, seg_index, printf('%d_%.3f_%.3f_%s', seg_index, start_s, end_s, '1080x1920') AS key FROM seg")
def f23(v):
    return v.seg.select("media_id", "seg_index", F.format_string("%d_%.3f_%.3f_%s", "seg_index", "start_s", "end_s", F.lit("1080x1920")).alias("key"))


@query("U06_vocabulary_overlap", "SELECT page_id, len(list_intersect(list_distinct(string_split(title, '')), ['e', 't', 'h', 'é', 'z'])) AS shared FROM title")
def u06(v):
    return v.title.select("page_id", tx.vocabulary_overlap(F.col("title"), "ethéz").cast("long").alias("shared"))


@query("J12_time_windows", """WITH c AS (SELECT media_id, pos, word_pos, word, unnest(range(ceil((start_s - 2) / 4)::BIGINT, floor((end_s + 2) / 4)::BIGINT + 1)) AS c FROM word)
    SELECT media_id, c * 4.0 AS center, string_agg(word, '' ORDER BY pos, word_pos) AS text, count(*) AS n FROM c WHERE c >= 0 GROUP BY media_id, c""", "center")
def j12(v):
    return ly.time_windows(v.word, M, ["pos", "word_pos"], 4.0, 2.0)


ENGINES = "a AS (SELECT media_id, line, line * 3.0 AS start_s, line % 10 / 10.0 AS confidence, line % 2 = 0 AS confirmed FROM line WHERE line % 7 <> 0), b AS (SELECT media_id, line, line * 3.0 + line % 4 * 0.25 AS start_s, line % 9 / 9.0 AS confidence, line % 4 < 3 AS confirmed FROM line WHERE line % 5 <> 0)"


def engines(v):
    a = v.line.where("line % 7 <> 0").select("media_id", "line", (F.col("line") * 3.0).alias("start_s"), (F.col("line") % 10 / 10).alias("confidence"), (F.col("line") % 2 == 0).alias("confirmed"))
    b = v.line.where("line % 5 <> 0").select("media_id", "line", (F.col("line") * 3.0 + F.col("line") % 4 * 0.25).alias("start_s"), (F.col("line") % 9 / 9).alias("confidence"), (F.col("line") % 4 < 3).alias("confirmed"))
    return a, b


FUSED = f"""WITH {ENGINES}, f AS (SELECT media_id, line, a.start_s AS s, a.confidence::DOUBLE AS c, a.confirmed AS k, b.start_s AS s2, b.confidence::DOUBLE AS c2, b.confirmed AS k2 FROM a FULL JOIN b USING (media_id, line)),
    g AS (SELECT *, coalesce(k AND k2 AND abs(s - s2) < 0.6, false) AS agree, s2 IS NULL OR coalesce(c, -1) >= coalesce(c2, -1) AS left_ FROM f)
    SELECT media_id, line, CASE WHEN agree THEN CASE WHEN c + c2 > 0 THEN (s * c + s2 * c2) / (c + c2) ELSE s END WHEN left_ THEN s ELSE s2 END::DOUBLE AS start_s, CASE WHEN agree THEN greatest(c, c2) WHEN left_ THEN c ELSE c2 END AS confidence, CASE WHEN s IS NULL OR s2 IS NULL THEN CASE WHEN CASE WHEN left_ THEN k ELSE k2 END THEN 'confirmed' ELSE 'review' END WHEN agree THEN 'confirmed' ELSE 'review' END AS status FROM g"""


@query("J14_fuse_alignments", FUSED, "start_s confidence")
def j14(v):
    return ly.fuse_alignments(*engines(v), ["media_id", "line"])


@query("A13_alignment_summary", f"SELECT media_id, avg((status = 'confirmed')::INT) AS confirmed_ratio, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'interpolated') AS interpolated, avg(abs(start_s - line * 3.0)) AS mean_shift, CASE WHEN avg((status = 'confirmed')::INT) >= 0.7 THEN 'low' WHEN avg((status = 'confirmed')::INT) >= 0.4 THEN 'medium' ELSE 'high' END AS drift_risk FROM ({FUSED}) GROUP BY media_id", "confirmed_ratio mean_shift")
def a13(v):
    rows = ly.fuse_alignments(*engines(v), ["media_id", "line"]).withColumn("shift_s", F.col("start_s") - F.col("line") * 3.0)
    return ly.alignment_summary(rows, M)


@query("A14_hotwords", r"""WITH x AS (SELECT media_id, regexp_replace(text, '\s', '', 'g') AS t FROM sent), g AS (SELECT media_id, substr(t, i, 2) AS gram, count(*) AS n FROM (SELECT media_id, t, unnest(range(1, length(t))) AS i FROM x WHERE length(t) >= 2) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY n DESC, encode(gram)) AS nr FROM g) WHERE nr <= 10""")
def a14(v):
    return ly.hotwords(v.sent, M, "text", 10)


@query("A18_weighted_transform_fusion", "SELECT l_orderkey AS song, round(coalesce(sum(l_tax * l_discount) / nullif(sum(l_discount), 0), 0.0) + 1e-9, 4) AS \"offset\", round(coalesce(sum(l_quantity * l_discount) / nullif(sum(l_discount), 0), 1.0) + 1e-9, 4) AS scale FROM lineitem GROUP BY l_orderkey", '"offset" scale')
def a18(v):
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("song"), F.col("l_tax").alias("offset"), F.col("l_quantity").alias("scale"), F.col("l_discount").alias("confirmed_ratio"))
    found = ly.weighted_transform_fusion(rows, ["song"])
    return found.select("song", F.round(F.col("offset") + 1e-9, 4).alias("offset"), F.round(F.col("scale") + 1e-9, 4).alias("scale"))


@query("A19_cache_stats", "SELECT cache_key, count(*) AS entries, sum(bytes)::BIGINT AS bytes, sum(bytes) / (1024 * 1024) AS mb FROM ttl GROUP BY cache_key", "mb")
def a19(v):
    return ca.cache_stats(v.ttl, "bytes", "cache_key")


@query("Q41_proportional_times", "SELECT media_id, line, 200 * (hi - u) / total AS start_s, greatest(200 * hi / total, 200 * (hi - u) / total + 0.2) AS end_s FROM (SELECT media_id, line, u, sum(u) OVER (PARTITION BY media_id) AS total, sum(u) OVER (PARTITION BY media_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS hi FROM (SELECT media_id, line, greatest(1, length(text))::DOUBLE AS u FROM line))", "start_s end_s")
def q41(v):
    return ly.proportional_times(v.line, M, "line", F.length("text"), 200.0).select("media_id", "line", "start_s", "end_s")


CLIPPED = "sg AS (SELECT media_id, line, greatest(0.0, t - 10) AS start_s, least(30.0, greatest(e - 10, t - 10 + 0.8)) AS end_s, text FROM (SELECT media_id, line, t, greatest(coalesce(first_value(t IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 40.0), t + 0.8) AS e, text FROM line) WHERE t IS NOT NULL AND e > 10 AND t < 40 AND trim(text) <> '')"


@query("Q42_lines_to_segments", f"WITH {CLIPPED} SELECT media_id, line, start_s, end_s FROM sg WHERE end_s > 0", "start_s end_s")
def q42(v):
    return ly.lines_to_segments(v.line, M, ["line"], 40.0, 10.0, 40.0).select("media_id", "line", "start_s", "end_s")


@query("Q42_joined_result", f"WITH {CLIPPED} SELECT media_id, string_agg(trim(text), chr(10) ORDER BY line) AS text, count(*) AS n FROM sg WHERE end_s > 0 GROUP BY media_id")
def q42_result(v):
    return ly.joined_result(ly.lines_to_segments(v.line, M, ["line"], 40.0, 10.0, 40.0), M, "line")


JITTER = "j AS (SELECT media_id, line, line * 1.0 - line % 4 * 0.75 AS start_s, line * 1.0 + 0.1 AS end_s FROM line)"


def jitter(v):
    return v.line.select("media_id", "line", (F.col("line") * 1.0 - F.col("line") % 4 * 0.75).alias("start_s"), (F.col("line") * 1.0 + 0.1).alias("end_s"))


@query("W11_enforce_monotone_starts", f"WITH {JITTER}, m AS (SELECT media_id, line, end_s, max(start_s - 0.02 * i) OVER (PARTITION BY media_id ORDER BY line ROWS UNBOUNDED PRECEDING) + 0.02 * i AS s FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY line) AS i FROM j)) SELECT media_id, line, round(s + 1e-9, 3) AS start_s, round(greatest(end_s, s + 0.35) + 1e-9, 3) AS end_s FROM m", "start_s end_s")
def w11(v):
    return ly.enforce_monotone_starts(jitter(v), M, "line")


@query("W12_trim_to_next_start", f"WITH {JITTER} SELECT media_id, line, start_s, CASE WHEN end_s >= nxt THEN round(greatest(start_s + 0.35, nxt - 0.03) + 1e-9, 3) ELSE end_s END AS end_s FROM (SELECT *, lead(start_s) OVER (PARTITION BY media_id ORDER BY line) AS nxt FROM j)", "start_s end_s")
def w12(v):
    return ly.trim_to_next_start(jitter(v), M, "line")


@query("W21_word_progress", r"SELECT media_id, pos, t, sum(u * done) / sum(u) AS progress FROM (SELECT w.media_id, w.pos, s.t, greatest(1, length(regexp_replace(word, '\s', '', 'g'))) AS u, greatest(0.0, least(1.0, (s.t - w.start_s) / nullif(w.end_s - w.start_s, 0))) AS done FROM word w JOIN (SELECT media_id, pos, (start_s + end_s) / 2 AS t FROM sent) s USING (media_id, pos)) GROUP BY ALL", "t progress")
def w21(v):
    return ly.word_progress(v.sent.select("media_id", "pos", ((F.col("start_s") + F.col("end_s")) / 2).alias("t")), v.word, M, "pos")


@query("Q16_cut_candidate_score", """SELECT media_id, seg_index, CASE WHEN ok THEN 0 ELSE 1 END AS rank, abs(cut - end_s) * 0.05 + CASE WHEN x < 8 THEN (8 - x) * 20 ELSE 0 END + CASE WHEN y < 8 THEN (8 - y) * 20 ELSE 0 END + CASE WHEN x > 18 * 1.1 THEN (x - 18) * 4 ELSE 0 END + CASE WHEN y > 18 * 1.1 THEN (y - 18) * 4 ELSE 0 END AS score FROM
    (SELECT *, x >= 8 AND y >= 8 AND x <= 18 * 1.1 AND y <= 18 * 1.1 AS ok FROM (SELECT media_id, seg_index, end_s, cut, cut - start_s AS x, e2 - cut AS y FROM (SELECT *, end_s - 0.5 AS cut, lead(end_s) OVER (PARTITION BY media_id ORDER BY start_s, seg_index) AS e2 FROM seg))) WHERE x > 0.1 AND y > 0.1""", "score")
def q16(v):
    rows = v.seg.withColumn("e2", F.lead("end_s").over(Window.partitionBy("media_id").orderBy("start_s", "seg_index")))
    score = ly.cut_candidate_score(F.col("start_s"), F.col("e2"), F.col("end_s") - 0.5, F.col("end_s"), 8.0, 18.0, F.lit(0.0))
    return rows.select("media_id", "seg_index", score.alias("x")).where("x is not null").select("media_id", "seg_index", "x.rank", "x.score")


@query("Q22_merge_repeated_lines", "WITH r AS (SELECT media_id, frame, kind AS text, t AS start_s, t + rms AS end_s, CASE WHEN kind = lag(kind) OVER (PARTITION BY media_id ORDER BY frame) THEN 0 ELSE 1 END AS f FROM tl), g AS (SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT media_id, text, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM g GROUP BY media_id, island, text", "start_s end_s")
def q22(v):
    rows = v.tl.select("media_id", "frame", F.col("kind").alias("text"), F.col("t").alias("start_s"), (F.col("t") + F.col("rms")).alias("end_s"))
    return ly.merge_repeated_lines(rows, M, "frame")


@query("J18_title_candidates_for_song", "SELECT s.media_id, s.song_index, p.point_id FROM (SELECT media_id, song_index, min(start_s) AS a, max(end_s) AS b FROM seg GROUP BY ALL) s JOIN bnd p ON p.media_id = s.media_id AND p.t BETWEEN s.a - 20 AND least(s.b + 20, s.a + 90) WHERE p.source = 'title'")
def j18(v):
    songs = v.seg.groupBy("media_id", "song_index").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return ti.title_candidates(v.bnd.where("source = 'title'"), songs, M).select("media_id", "song_index", "point_id")


def title_sql(t):
    """The score of a Latin text `t`, trimmed."""
    k = f"len(regexp_extract_all({t}, '[a-zA-Z0-9]'))"
    return rf"""greatest(0.0, least(100.0, round(50 + CASE WHEN length({t}) BETWEEN 3 AND 15 THEN 20 WHEN length({t}) BETWEEN 16 AND 25 THEN 8 ELSE 0 END + CASE WHEN NOT regexp_matches({t}, '[，。！？、；：""''【】《》()（）\[\].,!?;:\-]') THEN 8 ELSE 0 END + 5 + CASE WHEN regexp_matches({t}, '^ *[A-Z][A-Za-z ]*$') THEN 8 ELSE 0 END
    - CASE WHEN length({t}) <= 2 OR length({t}) > 35 THEN 40 ELSE 0 END - CASE WHEN len(regexp_extract_all({t}, '[，。！？!?;；]')) >= 2 THEN 25 ELSE 0 END - CASE WHEN {t} <> '' AND len(string_split_regex({t}, '\s+')) >= 6 THEN least(25.0, 12.0 + 3 * (len(string_split_regex({t}, '\s+')) - 6)) ELSE 0 END
    - CASE WHEN len(regexp_extract_all({t}, '[@_:;/\&*#%$~^]')) > 2 THEN 20 ELSE 0 END - CASE WHEN length({t}) > 0 AND {k} < 2 THEN 30 ELSE 0 END, 1)))"""


def seen(v):
    """Probes as texts on frames, in two parts."""
    text = F.concat(F.substring("title", 1, 9), F.lit("|"), F.expr("substring(title, 10)"))
    return v.probe.select("song", text.alias("text"), F.col("confidence").alias("score"), (F.col("probe") % 2 * 0.5).alias("ocr_score"), F.greatest(F.lit(0.0), 1 - F.abs(F.col("probe") - 2) / 6).alias("closeness"))


POOLED = f"""s AS (SELECT song, title, round(sum((score + ocr + near) * CASE WHEN length(title) <= 4 THEN 1.5 WHEN length(title) <= 10 THEN 1.3 WHEN length(title) <= 18 THEN 1.0 ELSE 0.6 END::DOUBLE * (1 + ocr * 0.5)), 6) AS votes
      FROM (SELECT song, trim(unnest([substr(title, 1, 9), substr(title, 10)])) AS title, confidence AS score, probe % 2 * 0.5::DOUBLE AS ocr, greatest(0.0::DOUBLE, 1 - abs(probe - 2) / 6.0::DOUBLE) AS near FROM probe) WHERE title <> '' AND {title_sql('title')} >= 60 GROUP BY ALL),
    po AS (SELECT song, title, votes FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY votes DESC, encode(title)) AS nr FROM s) WHERE nr = 1)"""


@query("A15_title_pool_vote", f"WITH {POOLED} SELECT * FROM po", "votes")
def a15(v):
    return ti.title_pool_vote(seen(v), ["song"])


NORM = "regexp_replace(regexp_replace(lower(trim({0})), '(live|music|mv|karaoke|official|version|ver)', ' ', 'g'), '[^0-9a-z一-龥]+', '', 'g')"
LOW = "(lower(trim({0})) IN ('', 'unknown', 'none', 'null', 'n/a') OR length({0}) > 40 OR regexp_matches({0}, '(live|official|karaoke|www\\.|http)', 'i') OR regexp_matches({0}, '[-_|/·]{{2,}}'))"
DECIDED = f"""WITH {POOLED}, p AS (SELECT song, coalesce(max(title) FILTER (probe = 1 AND track_id < 4), '') AS audio, coalesce(max(title) FILTER (probe = 2), '') AS artist, max(title) FILTER (probe = 3 AND track_id = 0) AS lyric, max(confidence) > 0.7 AS sure, song % 2 = 0 AS named FROM probe GROUP BY song),
    q AS (SELECT p.*, coalesce(po.title, '') AS ocr, CASE WHEN named THEN artist ELSE 'somebody else' END AS singer, NOT named AND artist <> '' AND NOT (contains({NORM.format("'somebody else'")}, {NORM.format('artist')}) OR contains({NORM.format('artist')}, {NORM.format("'somebody else'")})) AS unfit FROM p LEFT JOIN po USING (song)),
    f AS (SELECT *, CASE WHEN trim(audio) <> '' AND NOT {LOW.format('trim(audio)')} AND NOT unfit THEN trim(audio) WHEN lyric IS NOT NULL THEN lyric WHEN trim(ocr) <> '' AND (sure OR {title_sql('trim(ocr)')} >= 60) THEN trim(ocr) WHEN trim(audio) <> '' THEN trim(audio) ELSE '未知歌曲' END AS found FROM q)
    SELECT song, CASE WHEN found = '未知歌曲' AND named AND artist <> '' THEN 'hinted' ELSE found END AS title FROM f"""


@query("Q43_decide_title", DECIDED)
def q43(v):
    pick = lambda cond: F.max(F.when(F.expr(cond), F.col("title")))
    rows = v.probe.groupBy("song").agg(F.coalesce(pick("probe = 1 and track_id < 4"), F.lit("")).alias("audio"), F.coalesce(pick("probe = 2"), F.lit("")).alias("artist"), pick("probe = 3 and track_id = 0").alias("lyric"), (F.max("confidence") > 0.7).alias("sure"))
    rows = rows.join(ti.title_pool_vote(seen(v), ["song"]).select("song", F.col("title").alias("ocr")), "song", "left")
    singer = F.when(F.col("song") % 2 == 0, F.col("artist")).otherwise("somebody else")
    fits = ti.consistent(singer, F.col("artist")), ti.consistent(singer, F.col("artist"), known=True)
    return rows.select("song", ti.decide_title(F.col("audio"), fits[0], F.col("lyric"), F.col("ocr"), F.col("sure"), F.lit("hinted"), fits[1]).alias("title"))


LATEST = "SELECT cache_key, arg_max(entry_id, saved_at) AS entry_id, max(saved_at) AS saved_at, arg_max(bytes, saved_at) AS bytes FROM ttl {where} GROUP BY cache_key"


def entries(v):
    return v.ttl.select("cache_key", "entry_id", "saved_at", "bytes")


@query("S05_sample_library", LATEST.format(where="WHERE cache_key % 7 <> 0"), "saved_at")
def s05(v):
    gone = entries(v).where("cache_key % 7 = 0")
    return ca.delete(ca.latest(entries(v), ["cache_key"], "saved_at", "entry_id"), gone, ["cache_key"]).select("cache_key", "entry_id", "saved_at", "bytes")


@query("S06_optimization_history", "SELECT entry_id, saved_at, json_extract_string(props, '$.k')::INT AS k, entry_id % 2 = 0 AS applied FROM ttl JOIN events ON entry_id = event_id ORDER BY saved_at DESC, entry_id LIMIT 20", "saved_at")
def s06(v):
    rows = v.ttl.join(v.table("events").select(F.col("event_id").alias("entry_id"), "props"), "entry_id")
    rows = rows.select("entry_id", "saved_at", F.from_json("props", "map<string, int>")["k"].alias("k"), (F.col("entry_id") % 2 == 0).alias("applied"))
    return ca.newest(rows, 20, "saved_at", "entry_id")


@query("S07_cache_upsert", LATEST.format(where=""), "saved_at")
def s07(v):
    old, new = entries(v).where("entry_id % 2 = 0"), entries(v).where("entry_id % 2 = 1")
    broken = new.withColumns({"cache_key": F.lit(None).cast("int"), "saved_at": F.col("saved_at") + 1})
    return ca.upsert(old, new.unionByName(broken), ["cache_key"], "saved_at", "entry_id").select("cache_key", "entry_id", "saved_at", "bytes")


@query("S08_cache_lookup", f"SELECT w.media_id, w.cache_key, c.entry_id FROM (SELECT DISTINCT media_id, (media_id % 130)::INT AS cache_key FROM tl) w LEFT JOIN ({LATEST.format(where='')}) c USING (cache_key)")
def s08(v):
    wanted = v.tl.select("media_id", (F.col("media_id") % 130).cast("int").alias("cache_key")).distinct()
    return ca.lookup(wanted, ca.latest(entries(v), ["cache_key"], "saved_at", "entry_id").select("cache_key", "entry_id"), ["cache_key"]).select("media_id", "cache_key", "entry_id")


@query("T01_ttl_cache_batch", "SELECT r.cache_key, r.read_id, r.read_at, CASE WHEN r.read_at - s <= 86400 THEN s END AS saved_at FROM (SELECT r.*, (SELECT max(e.saved_at) FROM ttl e WHERE e.cache_key = r.cache_key AND e.usable AND e.saved_at <= r.read_at) AS s FROM (SELECT cache_key, entry_id AS read_id, saved_at + 3600 AS read_at FROM ttl) r) r", "read_at saved_at")
def t01(v):
    reads = v.ttl.select("cache_key", F.col("entry_id").alias("read_id"), (F.col("saved_at") + 3600).alias("read_at"))
    return ca.still_valid(reads, v.ttl.where("usable"), ["cache_key"], 86400.0)


@query("S01_analysis_json", "SELECT media_id, song_index, printf('song_%02d', song_index) AS name, start_s, end_s, label, confidence FROM seg", "start_s end_s")
def s01(v):
    return dc.analysis_from_json(dc.analysis_to_json(v.seg, M), M, "json")


@query("P08_asr_usable", "SELECT entry_id, usable AND (bytes > 500 OR entry_id % 2 = 0) AS ok FROM ttl")
def p08(v):
    return v.ttl.select("entry_id", dc.asr_usable(F.when(~F.col("usable"), "failed"), F.when(F.col("bytes") > 500, 1).otherwise(0), F.lit(None), F.when(F.col("entry_id") % 2 == 0, "x").otherwise(" ")).alias("ok"))


@query("S04_normalize_provider_payload", "SELECT media_id, pos AS key, 0 AS pos, CASE WHEN pos % 5 <> 0 THEN text END AS text, CASE WHEN pos % 5 <> 0 THEN floor(start_s * 1000) / 1000 END AS start_s, CASE WHEN pos % 5 <> 0 THEN floor(end_s * 1000) / 1000 END AS end_s, CASE WHEN pos % 5 <> 0 THEN 1 ELSE 0 END AS n_words, CASE WHEN pos % 5 = 0 THEN 'no quota' END AS error FROM sent", "start_s end_s")
def s04(v):
    ms = lambda c: F.floor(F.col(c) * 1000)
    word = F.struct(F.lit("w").alias("text"), ms("start_s").alias("start_time"), ms("end_s").alias("end_time"))
    said = F.struct("text", ms("start_s").alias("start_time"), ms("end_s").alias("end_time"), F.array(word).alias("words"))
    payload = F.to_json(F.struct(F.when(F.col("pos") % 5 == 0, 45).otherwise(0).alias("code"), F.lit("no quota").alias("message"), F.array(said).alias("utterances")))
    return dc.normalize_provider_payload(v.sent.select("media_id", F.col("pos").alias("key"), payload.alias("p")), ["media_id", "key"], "p")


@query("S09_load_hints", "SELECT page_id::VARCHAR AS song, CASE WHEN page_id % 2 = 0 THEN 'A' ELSE title END AS title FROM title")
def s09(v):
    first = v.title.where("page_id % 2 = 0").select(F.lit(1).alias("priority"), F.to_json(F.create_map(F.col("page_id").cast("string"), F.struct(F.lit("A").alias("title"), F.lit(1).alias("n")))).alias("json"))
    second = v.title.select(F.lit(2).alias("priority"), F.to_json(F.create_map(F.col("page_id").cast("string"), F.col("title"))).alias("json"))
    return dc.load_hints(first.unionByName(second), "song", "json", "priority")


@query("S10_write_ass", rf"SELECT media_id, string_agg('Dialogue: 0,' || printf('%d:%02d:%05.2f', floor(start_s / 3600)::INT, floor((start_s % 3600) / 60)::INT, start_s % 60) || ',' || printf('%d:%02d:%05.2f', floor(end_s / 3600)::INT, floor((end_s % 3600) / 60)::INT, end_s % 60) || ',Default,,0,0,0,,' || replace(replace(replace(replace(text, '\', '\\'), '{{', '\{{'), '}}', '\}}'), chr(10), '\N'), chr(10) ORDER BY a, b, text) AS document FROM (SELECT media_id, start_s AS a, end_s AS b, round(start_s + 1e-9, 2) AS start_s, round(end_s + 1e-9, 2) AS end_s, text FROM ({SPLIT})) GROUP BY media_id")
def s10(v):
    return dc.ass_documents(sn.split_subtitles(v.sent), M)


WHOLE_CHUNKS = CHUNKS.replace("media_id * 100000 + pos AS k, row_number() OVER (PARTITION BY media_id, pos ORDER BY word_pos)", "media_id AS k, row_number() OVER (PARTITION BY media_id ORDER BY pos, word_pos)")


@query("S11_write_srt", f"SELECT media_id, string_agg(nr || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10), chr(10) ORDER BY nr) AS document FROM (SELECT k AS media_id, s.text AS text, row_number() OVER (PARTITION BY k ORDER BY s.a, s.b) AS nr, floor(s.a * 1000 + 1e-6)::BIGINT AS a, floor(s.b * 1000 + 1e-6)::BIGINT AS b FROM ({WHOLE_CHUNKS})) GROUP BY media_id")
def s11(v):
    words = v.word.withColumn("word_pos", F.col("pos") * 100_000 + F.col("word_pos"))
    return dc.srt_documents(fo.words_to_chunks(words, M), M)


@query("S12_export_manifest", "SELECT *, '20240101_' || folder || '_' || lpad(sequence::VARCHAR, 3, '0') || '_' || type || '.mp4' AS file FROM (SELECT media_id, seg_index, row_number() OVER (PARTITION BY media_id ORDER BY start_s, seg_index) AS sequence, 'Song_' || song_index AS folder, label AS type, 'Song: ' || song_index AS title, confidence > 0.5 AS is_highlight, start_s, end_s FROM seg)", "start_s end_s")
def s12(v):
    rows = v.seg.select("media_id", "seg_index", F.col("label").alias("type"), F.concat(F.lit("Song: "), F.col("song_index")).alias("title"), (F.col("confidence") > 0.5).alias("is_highlight"), "start_s", "end_s")
    return dc.export_manifest(rows, M, ["start_s", "seg_index"], "20240101")


@query("S13_sample_json", 'SELECT sample_id, "old" AS original_label, "new" AS current_label, CASE WHEN sample_id % 3 = 0 THEN false ELSE is_modified END AS is_modified, 0 AS n_tags, \'\' AS notes FROM lab')
def s13(v):
    fields = [F.col("sample_id"), F.col("old").alias("original_label"), F.col("new").alias("current_label"), F.when(F.col("sample_id") % 3 != 0, F.col("is_modified")).alias("is_modified")]
    rows = dc.sample_from_json(v.lab.select(F.to_json(F.struct(*fields)).alias("json")), "json")
    return rows.select("sample_id", "original_label", "current_label", "is_modified", F.size("tags").alias("n_tags"), "notes")


@query("S14_inventory_report", "SELECT CASE WHEN entry_id % 2 = 0 THEN 'previews' ELSE 'uploads' END AS category, count(*) AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER ((2592000 - floor(saved_at)) / 3600 > CASE WHEN entry_id % 2 = 0 THEN 24 ELSE 48 END) AS expired FROM ttl GROUP BY ALL")
def s14(v):
    rows = v.ttl.select("entry_id", "bytes", F.timestamp_seconds(F.floor("saved_at")).alias("modified"))
    return dc.inventory_report(rows, F.when(F.col("entry_id") % 2 == 0, "previews").otherwise("uploads"), F.timestamp_seconds(F.lit(2592000)), {"previews": 24, "uploads": 48})


@query("S16_explode_cache_index", "SELECT 'k' || cache_key || '_' || entry_id AS cache_key, 'p' || entry_id AS path, bytes FROM ttl")
def s16(v):
    entry = F.struct(F.concat(F.lit("p"), F.col("entry_id")).alias("path"), "bytes")
    index = v.ttl.groupBy(F.floor(F.col("entry_id") / 1000)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), F.col("cache_key"), F.lit("_"), F.col("entry_id")), entry)))).alias("json"))
    return dc.explode_cache_index(index, "json").select("cache_key", "path", "bytes")


@query("A12_transcript_stability", "SELECT media_id, valid_share, monotone_share, (valid_share + monotone_share) / 2 AS stability FROM (SELECT media_id, avg((round(end_s, 9) - start_s BETWEEN 0.02 AND 4)::INT) AS valid_share, avg((b IS NULL OR start_s >= b - 0.15)::INT) AS monotone_share FROM (SELECT *, lag(start_s) OVER (PARTITION BY media_id ORDER BY word, pos, word_pos) AS b FROM word) GROUP BY media_id)", "valid_share monotone_share stability")
def a12(v):
    # in alphabetical order, so that some words go back in time
    return ly.transcript_stability(v.word.select("media_id", "pos", "word_pos", "word", "start_s", F.round("end_s", 9).alias("end_s")), M, ["word", "pos", "word_pos"])
