"""Two-stage classification of segments by weighted rules on their features.

A score is the sum of the weights of the conditions that hold. Stage 1 gates exclude what isn't music, first gate first; stage 2 compares
six scores. Some of these rise after a verse or a chorus; `candidates` has the decision for each label that can come before.

Features (columns): silence, rms, beat, voice, harmonic, entropy, flux, dmfcc, flat (flatness over its mean), hf_zcr, hf_energy, rms_var, spread, pitch,
rr (rms over its mean), stability (of the centroid), crel (centroid over the song's), cmean (centroid over the mean), pos, rel (relative energy),
likelihood, bpm, repeats, alike, prev_rms, next_rms, and the timeline's quantiles of rms p10, p15, p25, p50, p60, p75.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.labels import weighted_condition_score

Rules = Sequence[tuple[str, float]]
QUIET_BEAT = "not (beat < 0.1 and silence > 0.3)"

# The conditions and weights of each gate and score.
SPEECH: Rules = (
    ("beat < 0.15", 4), ("beat < 0.25", 2), ("silence > 0.35", 3.5), ("silence > 0.50", 2), ("voice > 0.20 and voice < 0.60", 3), ("voice < 0.20", 1), ("rms < p15", 3), ("rms > p10 and rms < p25", 2),
    ("flux < 2.5", 2), ("dmfcc < 1.5", 1.5), ("harmonic < 0.3", 2), ("entropy > 2.5", 1), ("beat > 0.5", -5), ("rms > p75", -4), ("entropy < 1.5", -3), ("beat > 0.35 and harmonic > 0.5 and voice > 0.25", -8),
    ("beat > 0.35 and harmonic > 0.6", -6), ("voice > 0.7 and harmonic > 0.7", -12), ("voice > 0.8 and harmonic > 0.6", -10), (f"voice > 0.3 and harmonic > 0.6 and {QUIET_BEAT}", -8), (f"voice > 0.25 and harmonic > 0.7 and {QUIET_BEAT}", -10),
)
TALK: Rules = (
    ("silence > 0.25", 3), ("beat > 0.15 and beat < 0.40", 3), ("voice > 0.20 and voice < 0.55", 2.5), ("harmonic > 0.3", 2), ("rms < p50", 2), ("flux < 4", 1.5), ("entropy > 2", 1), ("beat > 0.6", -4), ("rms > p75", -3),
    ("beat > 0.35 and harmonic > 0.5", -8), ("beat > 0.35 and harmonic > 0.6", -6), ("voice > 0.7 and harmonic > 0.7", -12), ("voice > 0.8 and harmonic > 0.6", -10), ("voice > 0.3 and harmonic > 0.6", -8),
    (f"voice > 0.25 and harmonic > 0.7 and {QUIET_BEAT}", -10), ("flat > 2", -3), ("hf_zcr > 0.12", -2),
)
CROWD: Rules = (
    ("hf_energy > 0.35", 4), ("hf_energy > 0.25", 2), ("rms_var > 2 * rms", 3.5), ("flat > 2.5", 3), ("flat > 1.8", 1.5), ("harmonic < 0.2", 3), ("hf_zcr > 0.15", 3), ("spread > 3500", 2), ("beat < 0.3", 2),
    ("entropy > 3", 1.5), ("pitch < 0.05", 1.5), ("hf_zcr > 0.12 and harmonic < 0.5", 2), ("harmonic > 0.4", -5), ("pitch > 0.15", -3), ("entropy < 2", -3),
)
AUDIENCE: Rules = (
    ("flat > 1.5", 2.5), ("hf_zcr > 0.12", 2), ("hf_energy > 0.25", 3), ("hf_energy > 0.15", 1.5), ("voice > 0.15 and voice < 0.95", 2), ("beat < 0.75", 1.5), ("pitch > 0.05", 2), ("entropy > 1.2 and entropy < 4", 1.5),
    ("harmonic > 0.15", 1.5), ("voice > 0.95 and entropy < 2.5", -4), ("voice > 0.90 and harmonic > 0.85", -3), ("beat > 0.5 and voice > 0.90", -3), ("beat > 0.6 and harmonic > 0.75", -4), ("rr > 1.2 and harmonic > 0.8", -3),
    ("beat > 0.5 and harmonic > 0.8", -5), ("voice > 0.5 and harmonic > 0.85", -4), ("voice > 0.4 and harmonic > 0.8 and hf_zcr <= 0.12", -6), ("stability > 0.75 and harmonic > 0.7", -4),
    ("crel > 0.8 and crel < 1.3 and harmonic > 0.7", -3), ("hf_energy < 0.15 and harmonic > 0.75", -5),
)
REPEATED = "(repeats >= 1 and alike > 0.75)"
NO_VOICE, SUNG_AGAIN = "voice < 0.15", f"({REPEATED} and voice >= 0.15 and voice > 0.30)"
PLAYED_AGAIN, ONCE = f"({REPEATED} and voice >= 0.15 and voice <= 0.30)", f"(not {REPEATED} and voice >= 0.15)"
SILENT_AGAIN, SILENT_ONCE = f"({NO_VOICE} and {REPEATED})", f"({NO_VOICE} and not {REPEATED})"
MUSIC: dict[str, Rules] = {
    "intro": (
        ("voice < 0.15", 5), ("voice > 0.15 and voice < 0.25", 2.5), ("beat > 0.5", 3), ("harmonic > 0.5", 2), ("entropy < 2", 2), ("flux < 4", 1.5), ("pitch < 0.15", 1.5), ("pos < 0.20", 3), ("pos >= 0.20 and pos < 0.30", 1.5),
        ("rr < 1", 1), ("voice > 0.4", -4), (f"{SILENT_ONCE} and pos < 0.15", 8), (f"{ONCE} and pos < 0.15", 4),
    ),
    "interlude": (
        ("voice < 0.15", 4), ("voice > 0.15 and voice < 0.25", 2), ("beat > 0.4", 2.5), ("harmonic > 0.4", 2), ("entropy < 2.5", 1.5), ("pos > 0.25 and pos < 0.80", 3), ("not (pos > 0.25 and pos < 0.80) and pos > 0.15 and pos < 0.90", 1),
        ("pos < 0.15", -3), ("pos > 0.85", -3), ("voice > 0.4", -4), (SILENT_AGAIN, 8), (f"{SILENT_ONCE} and pos > 0.20 and pos < 0.80", 6), (f"{SILENT_ONCE} and pos > 0.20 and pos < 0.80 and harmonic > 0.5", -2),
        (f"{SUNG_AGAIN} and rel < 0.50", 3), (PLAYED_AGAIN, 5),
    ),
    "solo": (
        ("voice < 0.15", 3.5), ("voice > 0.15 and voice < 0.25", 1.5), ("pitch > 0.15", 3), ("harmonic > 0.5", 2), ("cmean > 1", 1.5), ("entropy > 1 and entropy < 2.5", 1.5), ("pos > 0.20 and pos < 0.85", 2.5), ("rms_var > 0.5 * rms", 1),
        ("voice > 0.35", -4), (f"{SILENT_ONCE} and pos > 0.20 and pos < 0.80", 4), (f"{SILENT_ONCE} and pos > 0.20 and pos < 0.80 and harmonic > 0.5", 3), (f"{PLAYED_AGAIN} and harmonic > 0.4 and pitch > 0.10", 3),
    ),
    "verse": (
        (SILENT_AGAIN, -4), (SILENT_ONCE, -6), (SUNG_AGAIN, -4), (PLAYED_AGAIN, -3), (ONCE, 4), (f"{ONCE} and rel <= 1.05", 2), (f"{ONCE} and rms < 0.85 * next_rms", 2),
    ),
    "chorus": (
        ("rel >= 1", 3), ("rel < 0.8", -2), ("voice > 0.25 and voice < 0.90", 2), ("voice > 0.35", 1.5), ("harmonic > 0.4", 1.5), ("entropy < 2.5", 1), ("flux > 4", 1), ("dmfcc > 2.5", 1), ("spread > 2500", 1), ("voice < 0.15", -5), ("pos < 0.20", -2),
        ("pos > 0.90", -2), ("rms > 1.2 * prev_rms", 2), ("harmonic < 0.2", -2), (SILENT_AGAIN, -6), (SILENT_ONCE, -8), (SUNG_AGAIN, 5), (f"{SUNG_AGAIN} and rel > 1.05", 3), (f"{SUNG_AGAIN} and rel < 0.70", -1), (PLAYED_AGAIN, -3),
        (f"{ONCE} and rel > 1.05 and voice > 0.40 and harmonic > 0.5", 4), (f"{ONCE} and not (rel > 1.05 and voice > 0.40 and harmonic > 0.5)", -2),
    ),
    "outro": (
        ("voice < 0.25", 3.5), ("voice > 0.20 and voice < 0.35", 1.5), ("beat > 0.4", 2), ("harmonic > 0.3", 1.5), ("rms < p60", 2), ("flux < 3", 1.5), ("silence > 0.15", 1.5), ("pos > 0.80", 3.5), ("pos > 0.70 and pos <= 0.80", 2), ("rr > 1.3", -2),
        ("voice > 0.4", -3), (f"{SILENT_ONCE} and pos > 0.85", 8), (f"{SUNG_AGAIN} and pos > 0.90", 3), (f"{ONCE} and pos > 0.85", 4),
    ),
}
VERSE_BASE: Rules = (
    ("rel >= 0.5 and rel < 1", 2), ("rel < 0.5", 0.5), ("rel >= 1", -3), ("rel > 1.15", -2), ("rel > 1.30", -2), ("voice > 0.25 and voice < 0.90", 2.5), ("beat > 0.35", 1.5), ("harmonic > 0.3", 1.5), ("entropy > 1.5 and entropy < 3.5", 1.5),
    ("voice > 0.2", 1), ("voice < 0.15", -3), ("harmonic < 0.2", -2), ("pos < 0.30", 1.5), ("pos >= 0.30 and pos < 0.40", 0.5), ("rms < 0.85 * next_rms", 2),
)
#: terms that aren't weights of conditions, as SQL
EXTRA = {
    "verse": "greatest(0.0, ({base}) + 0.5 * bpm + {after})",
    "chorus": "case when rel >= 1 then least(10 * (rel - 1), 5.0) else 0.0 end + 5 * likelihood + 2 * bpm + 1.5 * stability + case when {sung} then 2 * least(repeats, 3) + 3 * alike else 0.0 end + case when {loud} then 5 * likelihood else 0.0 end",
}
#: labels that change the scores of what comes after them, as states from 1 on; any other label is state 0
STATES = ("", "verse", "chorus")
# What a label adds to the scores after it, and the part of a verse's that isn't bounded below.
AFTER = {("verse", "verse"): 1.0, ("chorus", "verse"): 1.0, ("outro", "chorus"): 1.5}
VERSE_AFTER_VERSE = f"case when {ONCE} then 1.0 else 0.0 end"
LOUD = f"{ONCE} and rel > 1.05 and voice > 0.40 and harmonic > 0.5"


def as_sql(rules: Rules) -> str:
    return " + ".join(f"case when {c} then {float(w)} else 0.0 end" for c, w in rules)


def music_sql(label: str, before: str = "") -> str:
    """The score of a label after another."""
    after = AFTER.get((label, before), 0.0)
    extra = EXTRA.get(label, "{after}").format(base=as_sql(VERSE_BASE), sung=SUNG_AGAIN, loud=LOUD, after=after)
    if label == "chorus":
        extra += f" + {after}"
    if label == before == "verse":
        extra += f" + {VERSE_AFTER_VERSE}"
    return f"{as_sql(MUSIC[label])} + {extra}"


def gate() -> Column:
    """The label of the first gate that opens; null for music."""
    silent = F.expr("silence > 0.7 or rms < 1e-4")
    talk = F.expr("voice > 0.15 and harmonic < 0.75") & (weighted_condition_score(TALK) >= 6)
    audience = F.expr("voice > 0.15") & (weighted_condition_score(AUDIENCE) >= 4)
    spoken = F.when(F.expr("harmonic > 0.3 and beat > 0.15"), "talk").otherwise("speech")
    return F.when(silent, "silence").when(weighted_condition_score(SPEECH) >= 6, spoken).when(talk, "talk").when(weighted_condition_score(CROWD) >= 3.5, "crowd").when(audience, "audience")


def _decided(gate_: Column, scores: dict[str, Column]) -> Column:
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(c.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("l")) for i, (k, c) in enumerate(scores.items())))))
    top, second = ranked[0]["s"], ranked[1]["s"]
    gap = F.when(top > 0, 0.5 + F.least(F.lit(0.45), 0.5 * (top - second) / (top + 0.01))).otherwise(0.8)
    sure = F.when(gate_.isNull(), F.greatest(F.lit(0.4), F.least(F.lit(0.98), gap)))
    return F.struct(F.coalesce(gate_, ranked[0]["l"]).alias("label"), sure.alias("confidence"))


def candidates(rows: DataFrame) -> DataFrame:
    """Adds `after`: for each of STATES the decision (label, confidence) if that came before. Confidence, for music only, comes from the gap between the two best
    scores; of equal scores the first in the order of MUSIC wins."""
    scored = rows.withColumns({"_gate": gate()} | {f"_{k}_{i}": F.round(F.expr(music_sql(k, before)) + 1e-9, 6) for i, before in enumerate(STATES) for k in MUSIC if not i or (k, before) in AFTER})
    column = lambda k, i: F.col(f"_{k}_{i}") if (k, STATES[i]) in AFTER else F.col(f"_{k}_0")
    decided = F.array(*(_decided(F.col("_gate"), {k: column(k, i) for k in MUSIC}) for i in range(len(STATES))))
    return scored.select(*rows.columns, decided.alias("after"))


def two_stage_classify(rows: DataFrame) -> DataFrame:
    """Adds label and confidence of segments on their own, as if no other came before."""
    return candidates(rows).select(*rows.columns, F.col("after")[0]["label"].alias("label"), F.col("after")[0]["confidence"].alias("confidence"))


#: labels that aren't music
UNMUSICAL = ("speech", "talk", "crowd", "audience")


def score_table(rows: DataFrame) -> DataFrame:
    """Adds top, top_score, chorus_score and verse_score by the rules of both stages, as if no segment came before; without features (rms) nulls. A gate's score stands alone."""
    gated = rows.withColumns({"_gate": gate(), "_speech": weighted_condition_score(SPEECH), "_talk": weighted_condition_score(TALK), "_crowd": weighted_condition_score(CROWD), "_audience": weighted_condition_score(AUDIENCE)})
    score = F.when(F.col("_gate") == "silence", 10.0).when(F.col("_speech") >= 6, F.col("_speech")).when(F.col("_gate") == "talk", F.col("_talk")).when(F.col("_gate") == "crowd", F.col("_crowd")).otherwise(F.col("_audience"))
    scored = gated.withColumns({"_score": score} | {f"_{k}_0": F.round(F.expr(music_sql(k)) + 1e-9, 6) for k in MUSIC})
    best = F.array_max(F.array(*(F.struct(F.col(f"_{k}_0").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("l")) for i, k in enumerate(MUSIC))))
    music, known = F.col("_gate").isNull(), F.col("rms").isNotNull()
    only = lambda c: F.when(known, F.when(music, c).otherwise(0.0))
    columns = {"top": F.when(known, F.coalesce("_gate", best["l"])), "top_score": F.when(known, F.when(music, best["s"]).otherwise(F.col("_score"))), "chorus_score": only(F.col("_chorus_0")), "verse_score": only(F.col("_verse_0"))}
    return scored.select(*rows.columns, *(c.alias(k) for k, c in columns.items()))


def refine_labels(rows: DataFrame, *song: str) -> DataFrame:
    """Segments (label, confidence, features) with label and confidence revised by their score table; `song` are the columns that name a song.

    What isn't music takes over from a score of 4, a solo from 3.5; a chorus whose verse score is 1.2 higher is a verse, and what scores best as chorus, 1.5 over verse, is one. Where then half of a
    song or more is chorus, choruses of little relative energy (rel) and likelihood become verses. Confidence rises to the best score. Segments without features stay.
    """
    top, best, chorus, verse = (F.col(c) for c in ("top", "top_score", "chorus_score", "verse_score"))
    over = F.when(top.isin(*UNMUSICAL) & (best >= 4), top).when((top == "solo") & (best >= 3.5), "solo")
    label = F.coalesce(over, F.when((F.lower("label") == "chorus") & (verse >= chorus + 1.2), "verse").when((top == "chorus") & (chorus >= verse + 1.5), "chorus"), F.col("label"))
    revised = score_table(rows).withColumns({"label": label, "confidence": F.when(best.isNull(), F.col("confidence")).otherwise(F.greatest(F.coalesce("confidence", F.lit(0.0)), best))})
    share = F.avg((F.coalesce(F.col("label") == "chorus", F.lit(False)) & best.isNotNull()).cast("double")).over(Window.partitionBy(*song))
    weak = (F.lower("label") == "chorus") & (F.coalesce("rel", F.lit(1.0)) < 0.95) & (F.coalesce("likelihood", F.lit(0.0)) < 0.40)
    return revised.withColumn("_share", share).withColumn("label", F.when((F.col("_share") >= 0.5) & weak, "verse").otherwise(F.col("label"))).select(*rows.columns)
