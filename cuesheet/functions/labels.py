"""Segment labels: canonical names, export types, rules on features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical labels, other spellings of them, and their localised names.
CANONICAL = ("silence", "speech", "talk", "crowd", "audience", "intro", "interlude", "solo", "verse", "chorus", "outro", "other", "prechorus", "bridge", "inst")
ALIASES = {"pre-chorus": "prechorus", "instrumental": "inst"}
LOCAL_NAMES = {
    "静默": "silence", "讲话串场": "speech", "合唱": "crowd", "前奏": "intro", "间奏": "interlude", "独奏": "solo", "主歌": "verse",
    "副歌": "chorus", "尾奏": "outro", "其他": "other", "导歌": "prechorus", "桥段": "bridge", "纯音乐": "inst",
}
# Export types by label, display types by label, and the weight of each type.
EXPORT_TYPES = {
    "chorus": "副歌", "prechorus": "副歌", "bridge": "副歌", "crowd": "合唱", "audience": "合唱", "speech": "讲话串场", "talk": "讲话串场",
    "solo": "乐器SOLO", "inst": "乐器SOLO", "verse": "主歌", "intro": "主歌", "outro": "主歌", "interlude": "主歌",
}
DISPLAY_TYPES = {"verse": "主歌", "chorus": "副歌", "audience": "合唱", "crowd": "合唱", "speech": "讲话串场", "talk": "讲话串场", "solo": "乐器SOLO"}
UNLABELLED = "未标注"
TYPE_WEIGHTS = {"高光瞬间": 100, "合唱": 90, "副歌": 80, "主歌": 60, "乐器SOLO": 50, "讲话串场": 40}
# Fixed values: (type, marks anywhere in a file stem, marks in its lower case, ends of its lower case), first match wins.
FILE_MARKS = (
    ("讲话串场", ("讲话串场",), (), ()), ("乐器SOLO", ("乐器SOLO", "独奏"), (), ()), ("主歌", ("主歌",), (), ()), ("副歌", ("副歌",), (), ()), ("合唱", ("合唱",), (), ()),
    ("主歌", (), ("_verse_",), ("_verse",)), ("副歌", (), ("_chorus_",), ("_chorus",)), ("合唱", (), ("_audience_", "_crowd_"), ()), ("讲话串场", (), ("_speech_", "_talk_"), ()), ("乐器SOLO", (), ("_solo_",), ()),
)


def looked_up(key: Column, names: Mapping[str, object]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def canonical_label(label: Column) -> Column:
    """Trimmed, in lower case, aliases and localised names resolved; unknown labels as they are, null as empty."""
    raw = F.trim(F.coalesce(label, F.lit("")))
    low = F.lower(raw)
    return F.coalesce(looked_up(low, ALIASES), looked_up(raw, LOCAL_NAMES), low)


def export_type(label: Column) -> Column:
    """Null for silence, other and no label; unknown labels count as verse."""
    name = canonical_label(label)
    return F.when(name.isin("", "silence", "other"), F.lit(None)).otherwise(F.coalesce(looked_up(name, EXPORT_TYPES), F.lit(EXPORT_TYPES["verse"])))


def display_type(label: Column) -> Column:
    return F.coalesce(looked_up(F.lower(F.trim(F.coalesce(label, F.lit("")))), DISPLAY_TYPES), F.lit(UNLABELLED))


def is_highlight(label: Column, kind: Column, confidence: Column, relative_energy: Column, repeat: Column, voice: Column) -> Column:
    loud = (F.coalesce(relative_energy, F.lit(1.0)) >= 1.35) | (F.coalesce(repeat, F.lit(0.0)) >= 0.65) | (F.coalesce(voice, F.lit(0.0)) >= 0.9)
    sure = F.coalesce(kind.isin("副歌", "合唱"), F.lit(False)) & (F.coalesce(confidence, F.lit(0.0)) >= 0.55)
    return sure | canonical_label(label).isin("chorus", "crowd", "audience") | loud


def type_priority(kind: Column, highlight: Column) -> Column:
    return F.coalesce(looked_up(kind, TYPE_WEIGHTS), F.lit(0)) + F.when(highlight, 20).otherwise(0)


def type_from_filename(name: Column) -> Column:
    stem = F.regexp_replace(name, r"(?<=.)\.[^./]*$", "")
    low = F.lower(stem)
    found = F.lit(None).cast("string")
    for kind, marks, low_marks, ends in reversed(FILE_MARKS):
        test = F.lit(False)
        for m in marks:
            test = test | F.contains(stem, F.lit(m))
        for m in low_marks:
            test = test | F.contains(low, F.lit(m))
        for m in ends:
            test = test | F.endswith(low, F.lit(m))
        found = F.when(test, kind).otherwise(found)
    return F.coalesce(found, F.lit(UNLABELLED))


# The scenes in order; the thresholds of the two rules below are fixed too.
SCENES = ("speech", "clap", "crowd", "music")


def scene_by_rule(rms: Column, zcr: Column, centroid: Column) -> Column:
    """The likeliest scene and its probability, by thresholds; of equal ones the first in SCENES."""
    kind = F.when(rms < 0.01, "quiet").when((zcr > 0.15) & (centroid < 2000), "applause").when((zcr < 0.08) & (rms > 0.05), "music").otherwise("mixed")
    best = F.when(kind == "applause", F.struct(F.lit("clap").alias("scene"), F.lit(0.4).alias("p"))).when(kind == "mixed", F.struct(F.lit("music").alias("scene"), F.lit(0.4).alias("p")))
    return best.otherwise(F.struct(F.lit("music").alias("scene"), F.lit(0.7).alias("p")))


def structure_by_rule(position: Column, relative_rms: Column, centroid_share: Column) -> Column:
    name = F.when(position < 0.1, "intro").when(position > 0.9, "outro").when(relative_rms > 1.2, "chorus").when((relative_rms < 0.8) & (centroid_share < 0.9), "bridge").otherwise("verse")
    sure = F.when((position < 0.1) | (position > 0.9), 0.6).when(relative_rms > 1.2, 0.65).when((relative_rms < 0.8) & (centroid_share < 0.9), 0.5).otherwise(0.6)
    return F.struct(name.alias("structure"), sure.alias("p"))


def scene_structure_label(scene: Column, structure: Column, compat: bool = False) -> Column:
    """The label of a scene and, for music, a structure. Other scenes have labels of their own; in compat mode only where the structure is music."""
    music = looked_up(structure, {"chorus": "chorus", "verse": "verse", "intro": "intro", "bridge": "interlude", "outro": "outro", "solo": "solo"})
    other = looked_up(scene, {"crowd": "audience", "clap": "crowd", "speech": "speech"})
    other = F.when(structure == "music", other) if compat else other
    return F.coalesce(F.when(scene == "music", music).otherwise(other), F.lit("other"))


def relabel_by_position(label: Column, start: Column, duration: Column, total: Column) -> Column:
    where = start / total
    return F.when((label == "verse") & (where < 0.15) & (duration < 30), "intro").when((label == "verse") & (where > 0.85), "outro").otherwise(label)


def weighted_condition_score(rules: Sequence[tuple[str, float]]) -> Column:
    """The sum of the weights of the SQL conditions that hold."""
    score = F.lit(0.0)
    for condition, weight in rules:
        score = score + F.when(F.expr(condition), F.lit(float(weight))).otherwise(0.0)
    return score


def feature_value(features: Column, key: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(features, F.lit(key)), F.lit(default))


def refined_by_activity(label: Column, confidence: Column, singing: Column, speech: Column, intro: str = "intro", spoken: Sequence[str] = ("speech", "talk")) -> Column:
    """Struct label, confidence by the shares of a segment that are sung and spoken: sung talk is a verse, a spoken intro or anything spoken and unsung is talk."""
    sung = (singing > 0.5) & label.isin(*spoken)
    talk = (label == intro) & (speech > 0.65) & (singing < 0.45) | (speech > 0.75) & (singing < 0.25)
    return F.struct(F.when(sung, "verse").when(talk, "talk").otherwise(label).alias("label"), F.least(F.lit(1.0), confidence + F.when(sung, 0.3).when(talk, 0.1).otherwise(0.0)).alias("confidence"))


# What a feature must be for each flag, by the features' names.
FLAGS = {
    "high_energy": "rms > rms_p50", "very_high_energy": "rms > rms_p75", "has_voice": "voice_ratio > 0.25 and voice_ratio < 0.90", "speech_like": "voice_ratio < 0.25", "stable_beat": "beat_regularity > 0.3",
    "zcr_above_mean": "zcr > zcr_mean", "flatness_above_mean": "flatness > flatness_mean", "song_high_energy": "song_rms_baseline > 0 and relative_energy > 1.0",
    "song_very_high_energy": "song_rms_p85 > 0 and relative_energy > song_rms_p85 / greatest(song_rms_baseline, 1e-8)",
}


def feature_flags() -> list[Column]:
    """The nine flags as columns over features named as in FLAGS."""
    return [F.expr(x).alias(k) for k, x in FLAGS.items()]
