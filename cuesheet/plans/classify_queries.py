"""Two-stage classification on frames of the driver's events, whose features are made from frame numbers and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import classify as cl
from cuesheet.operators import classification as cn
from cuesheet.plans.registry import query

# the same text serves both engines; 1e0 is a double in both
FEATURES = """media_id, frame, rms, (frame * 7 % 11) / 11e0 AS silence, (frame * 3 % 10) / 10e0 AS beat, (frame * 13 % 17) / 17e0 AS voice, (frame * 5 % 19) / 19e0 AS harmonic, (frame * 11 % 41) / 10e0 AS entropy, (frame * 17 % 23) / 4e0 AS flux,
    (frame * 19 % 29) / 8e0 AS dmfcc, (frame * 23 % 31) / 10e0 AS flat, (frame * 29 % 37) / 200e0 AS hf_zcr, (frame * 31 % 43) / 100e0 AS hf_energy, rms * (frame % 5) / 2e0 AS rms_var, frame * 37 % 4000 + 500.0 AS spread, (frame * 41 % 47) / 150e0 AS pitch, rms / 50e0 AS rr,
    (frame * 43 % 53) / 53e0 AS stability, (frame * 47 % 59) / 40e0 AS crel, (frame * 53 % 61) / 40e0 AS cmean, t / 4320e0 AS pos, rms / 45e0 AS rel, (frame * 59 % 67) / 67e0 AS likelihood, (frame * 61 % 71) / 71e0 AS bpm, frame % 4 AS repeats, (frame * 67 % 73) / 73e0 AS alike,
    rms * 0.9 AS prev_rms, rms * 1.1 AS next_rms, 3.0 AS p10, 5.0 AS p15, 12.0 AS p25, 33.0 AS p50, 45.0 AS p60, 70.0 AS p75"""
ORDER = list(cl.MUSIC)
SCORES = ", ".join(f"round({cl.music_sql(k, before)} + 1e-9, 6) AS s_{k}_{i}" for i, before in enumerate(cl.STATES) for k in ORDER)
GATE = f"""CASE WHEN silence > 0.7 OR rms < 1e-4 THEN 'silence' WHEN {cl.as_sql(cl.SPEECH)} >= 6 THEN CASE WHEN harmonic > 0.3 AND beat > 0.15 THEN 'talk' ELSE 'speech' END
    WHEN voice > 0.15 AND harmonic < 0.75 AND {cl.as_sql(cl.TALK)} >= 6 THEN 'talk' WHEN {cl.as_sql(cl.CROWD)} >= 3.5 THEN 'crowd' WHEN voice > 0.15 AND {cl.as_sql(cl.AUDIENCE)} >= 4 THEN 'audience' END"""


def picked(i: int) -> str:
    best = "greatest(" + ", ".join(f"s_{k}_{i}" for k in ORDER) + ")"
    return "coalesce(gate, CASE " + " ".join(f"WHEN s_{k}_{i} = {best} THEN '{k}'" for k in ORDER) + f" END) AS l_{i}"


def sure(i: int) -> str:
    first, second = (f"list_reverse_sort([{', '.join(f's_{k}_{i}' for k in ORDER)}])[{n}]" for n in (1, 2))
    return f"CASE WHEN gate IS NULL THEN greatest(0.4, least(0.98, CASE WHEN {first} > 0 THEN 0.5 + least(0.45, 0.5 * ({first} - {second}) / ({first} + 0.01)) ELSE 0.8 END))::DOUBLE END AS c_{i}"


@query("Q36_two_stage_classify", f"""SELECT * FROM (WITH RECURSIVE f AS (SELECT {FEATURES} FROM tl), s AS (SELECT *, {GATE} AS gate, {SCORES} FROM f),
    d AS MATERIALIZED (SELECT media_id, frame, row_number() OVER (PARTITION BY media_id ORDER BY frame) AS nr, {', '.join(f'{picked(i)}, {sure(i)}' for i in range(3))} FROM s),
    w AS (SELECT media_id, nr, frame, l_0 AS label, c_0 AS confidence FROM d WHERE nr = 1 UNION ALL
      SELECT d.media_id, d.nr, d.frame, CASE w.label WHEN 'verse' THEN l_1 WHEN 'chorus' THEN l_2 ELSE l_0 END, CASE w.label WHEN 'verse' THEN c_1 WHEN 'chorus' THEN c_2 ELSE c_0 END FROM w JOIN d ON d.media_id = w.media_id AND d.nr = w.nr + 1)
    SELECT media_id, frame, label, round(confidence + 1e-9, 6) AS confidence FROM w)""", "confidence")
def q36(v):
    rows = v.tl.selectExpr(*FEATURES.replace("\n", " ").split(", "))
    return cn.classify_in_order(rows, ["media_id"], "frame", 16).select("media_id", "frame", "label", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"))


LABELLED = "t, kind, CASE kind WHEN 'purchase' THEN 'chorus' WHEN 'click' THEN 'chorus' WHEN 'view' THEN 'verse' ELSE 'intro' END AS label, round(rms - floor(rms), 2) AS confidence, CAST(floor(t / 72) AS INT) AS song"
GATE_SCORE = f"CASE WHEN gate = 'silence' THEN 10.0 WHEN {cl.as_sql(cl.SPEECH)} >= 6 THEN {cl.as_sql(cl.SPEECH)} WHEN gate = 'talk' THEN {cl.as_sql(cl.TALK)} WHEN gate = 'crowd' THEN {cl.as_sql(cl.CROWD)} ELSE {cl.as_sql(cl.AUDIENCE)} END"
TOP = "CASE " + " ".join(f"WHEN s_{k}_0 = greatest({', '.join(f's_{x}_0' for x in ORDER)}) THEN '{k}'" for k in ORDER) + " END"


@query("Q37_refine_labels", f"""WITH f AS (SELECT {FEATURES}, {LABELLED} FROM tl), s AS (SELECT *, {GATE} AS gate, {SCORES} FROM f),
    x AS (SELECT *, coalesce(gate, {TOP}) AS top, CASE WHEN gate IS NULL THEN greatest({', '.join(f's_{k}_0' for k in ORDER)}) ELSE {GATE_SCORE} END::DOUBLE AS best, CASE WHEN gate IS NULL THEN s_chorus_0 ELSE 0 END AS chorus, CASE WHEN gate IS NULL THEN s_verse_0 ELSE 0 END AS verse FROM s),
    r AS (SELECT *, CASE WHEN top IN ('speech', 'talk', 'crowd', 'audience') AND best >= 4 THEN top WHEN top = 'solo' AND best >= 3.5 THEN 'solo' WHEN label = 'chorus' AND verse >= chorus + 1.2 THEN 'verse' WHEN top = 'chorus' AND chorus >= verse + 1.5 THEN 'chorus' ELSE label END AS new FROM x),
    q AS (SELECT *, avg((new = 'chorus')::INT) OVER (PARTITION BY media_id, song) AS share FROM r)
    SELECT media_id, frame, CASE WHEN share >= 0.5 AND new = 'chorus' AND rel < 0.95 AND likelihood < 0.40 THEN 'verse' ELSE new END AS label, greatest(confidence, best) AS confidence FROM q""", "confidence")
def q37(v):
    rows = v.tl.selectExpr(*FEATURES.replace("\n", " ").split(", "), *LABELLED.split(", ", 2)[:2], LABELLED.split(", ", 2)[2].split(" AS label, ")[0] + " AS label", "round(rms - floor(rms), 2) AS confidence", "CAST(floor(t / 72) AS INT) AS song")
    return cl.refine_labels(rows, "media_id", "song").select("media_id", "frame", "label", "confidence")
