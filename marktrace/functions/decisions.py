"""Decision ladders as CASE expressions (C16, C21, C22, C24-C29, C32-C35, C37, F16, A34). All JVM-side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marktrace.functions.tags import is_real


def lighting_class(mean: Column, std: Column, bright: Column, saturated: Column) -> Column:
    """C16."""
    return (
        F.when((saturated > 0.025) & (bright > 0.12), "glare")
        .when(mean < 65, "dark")
        .when(mean > 190, "bright")
        .when(std < 22, "low_contrast")
        .otherwise("normal")
    )


def quality_class(height: Column, width: Column, blur: Column, std: Column, dark: Column, saturated: Column, lighting: Column) -> Column:
    """C16."""
    return (
        F.when((height < 18) | (width < 80) | (blur < 12) | (std < 8), "reject")
        .when((blur < 35) | (std < 16) | (dark > 0.55) | (saturated > 0.08), "poor")
        .when((blur < 80) | (std < 25) | (lighting != "normal"), "medium")
        .otherwise("good")
    )


def quality_score(conf: Column, sharpness: Column, mean: Column, height: Column, width: Column, tilt: Column | None = None) -> Column:
    """Weighted detector, sharpness, exposure and size terms minus an optional tilt penalty."""
    one, zero = F.lit(1.0), F.lit(0.0)
    score = (
        0.40 * conf
        + 0.30 * F.least(sharpness / 300.0, one)
        + 0.15 * F.greatest(zero, 1.0 - F.abs(mean - 125.0) / 125.0)
        + 0.15 * F.least(height * width / 4800.0, one)
    )
    return score if tilt is None else score - 0.25 * F.least(F.abs(tilt) / 45.0, one)


def failure_stage(c: dict[str, Column] | None = None) -> Column:
    """The first broken step of a session; columns as produced by ``stage_counters``."""
    col = lambda n: c[n] if c and n in c else F.col(n)
    none = lambda n: F.coalesce(col(n), F.lit(0)) == 0
    return (
        F.when(col("failure_reason") == "MISSED_CAPTURE_WINDOW", "MISSED_CAPTURE_WINDOW")
        .when(col("failure_reason") == "DATABASE_FAILED", "DATABASE_FAILURE")
        .when(is_real(col("identifier")), F.lit(None).cast("string"))
        .when(none("payloads"), "NO_PAYLOAD")
        .when(none("decoded"), "DECODE_FAILED")
        .when(none("detections"), "NO_DETECTION")
        .when(none("crops"), "NO_CROP")
        .when(col("crops") == col("rejected"), "CROP_REJECTED")
        .when(none("submitted"), "OCR_NOT_SUBMITTED")
        .when(none("completed"), "OCR_NOT_STARTED")
        .when(col("timeouts") > 0, "OCR_TIMEOUT")
        .when(col("ambiguous") > 0, "OCR_AMBIGUOUS")
        .otherwise("OCR_NO_READ")
    )


def final_status(has_id: Column, has_tag: Column, exit_mode: bool, tag_required: bool = True) -> tuple[Column, Column]:
    """(status, reason) of a finished session under the exit-signal or the single-signal policy."""
    tag_ok = has_tag if tag_required else F.lit(True)
    done = has_id & tag_ok
    if not exit_mode:
        status = F.when(done, "SUCCESS").otherwise("TIMEOUT")
        return status, F.when(done, F.lit(None).cast("string")).otherwise("RESULT_TIMEOUT")
    partial = has_id | has_tag
    status = F.when(done, "SUCCESS").when(partial, "PARTIAL_SUCCESS").otherwise("TIMEOUT")
    reason = (
        F.when(done, F.lit(None).cast("string"))
        .when(has_id, "VIN_OK_RFID_TIMEOUT")
        .when(has_tag, "RFID_OK_VIN_TIMEOUT")
        .otherwise("BOTH_TIMEOUT")
    )
    return status, reason


def feed_health(state: Column, connected: Column, age_ms: Column, stale_ms: int = 3000) -> Column:
    """STALE when connected but silent too long, unless the feed is already in a down state."""
    down = state.isin("RECONNECTING", "FAILED", "STOPPING", "DISCONNECTED")
    return F.when(connected & (age_ms > stale_ms) & ~down, "STALE").otherwise(state)


def threshold_status(value: Column, warning: float, critical: float) -> Column:
    """Status of a metric that is bad when low (free space)."""
    return F.when(value <= critical, "critical").when(value <= warning, "warning").otherwise("ok")


def gate_characters(predictions: Column, thresholds: dict[str, float], default: float, min_margin: float = 0.10, unknown: str = "?") -> Column:
    """String of accepted characters; reject class, low confidence or low margin become unknown.

    ``predictions`` is array<struct<char, confidence, second>>; an empty char is the reject class.
    """
    limits = [F.lit(v) for kv in thresholds.items() for v in kv]
    table = F.create_map(*limits) if limits else F.map_from_arrays(F.array(), F.array())

    def gate(p: Column) -> Column:
        need = F.coalesce(F.try_element_at(table, p.char), F.lit(default)) if limits else F.lit(default)
        bad = (F.coalesce(p.char, F.lit("")) == "") | (p.confidence < need) | (p.confidence - p.second < min_margin)
        return F.when(bad, unknown).otherwise(p.char)

    return F.array_join(F.transform(predictions, gate), "")


def sequence_ok(gated: Column, unknown: str = "?") -> Column:
    return (gated != "") & ~F.contains(gated, F.lit(unknown))


@dataclass(frozen=True)
class ReleasePolicy:
    guarded: bool = True
    weak_classes: str = ""
    allow_weak: bool = True


def release_decision(primary_status: Column, primary_raw: Column, primary_text: Column, baseline: Column, second: Column, policy: ReleasePolicy) -> dict[str, Column]:
    """Text, source and reason released from three engines; see the operator docs for the precedence."""
    p, b, s = (F.coalesce(x, F.lit("")) for x in (primary_text, baseline, second))
    raw = F.coalesce(primary_raw, F.lit(""))
    distinct = F.size(F.array_distinct(F.filter(F.array(p, b, s), lambda x: x != "")))
    disagreement = distinct > 1
    if not policy.guarded:
        return {
            "final_text": b,
            "final_source": F.when(b != "", "baseline"),
            "final_reason": F.lit("SHADOW_ONLY"),
            "engines_disagree": disagreement,
        }
    weak = p.rlike(f"[{policy.weak_classes}]") if policy.weak_classes and not policy.allow_weak else F.lit(False)
    status = F.coalesce(primary_status, F.lit("UNAVAILABLE"))
    cause = (
        F.when(status.isin("TIMEOUT", "UNAVAILABLE"), "ENGINE_TIMEOUT")
        .when(F.contains(raw, F.lit("?")) & (p == ""), "ENGRAVED_UNKNOWN_CHAR")
        .when((p == "") | F.contains(p, F.lit("?")), "ENGRAVED_LOW_CONFIDENCE")
        .when(weak, "ENGRAVED_WEAK_CLASS_BLOCKED")
    )
    both = (b != "") & (s != "")
    fallback = (
        F.when(both & (b == s), "CONSENSUS").when(both, "ENGINES_DISAGREE").when(b != "", "BASELINE_ONLY").when(s != "", "SECOND_ONLY").otherwise("NO_SAFE_RESULT")
    )
    text = F.when(cause.isNull(), p).when(b != "", b).otherwise(s)
    source = F.when(cause.isNull(), "primary").when(both & (b == s), "consensus").when(b != "", "baseline").when(s != "", "second")
    reason = F.when(cause.isNull(), "PRIMARY_ACCEPTED").otherwise(F.concat_ws("->", cause, fallback))
    return {"final_text": text, "final_source": source, "final_reason": reason, "engines_disagree": disagreement}


def second_reader_check(text: Column, valid: Column, avg: Column, low: Column, model: Column, structure_ok: Column, min_avg: float = 0.80, min_char: float = 0.35, require_model: bool = True) -> Column:
    """``ok`` or the first reason why the second recogniser's reading is unusable. A missing confidence counts as 0, missing validity as false."""
    no_model = model.isNull() if require_model else F.lit(False)
    return (
        F.when(text.isNull(), "no_prediction")
        .when(~F.coalesce(valid, F.lit(False)), "invalid_vin")
        .when(F.coalesce(avg, F.lit(0.0)) < min_avg, f"avg_conf<{min_avg:.2f}")
        .when(F.coalesce(low, F.lit(0.0)) < min_char, f"min_char_conf<{min_char:.2f}")
        .when(no_model, "unknown_model")
        .when(model.isNotNull() & ~structure_ok, "structure_mismatch")
        .otherwise("ok")
    )


def weak_position_ok(char: Column, engine_chars: Column, frames: Column, conf: Column, weak: str, min_frames: int = 2, min_agree: int = 2, min_conf: float = 0.85) -> Column:
    """A weak character needs two frames, two agreeing engines or high confidence."""
    strong = F.coalesce(char, F.lit("")) == ""
    agree = F.size(F.filter(engine_chars, lambda x: x.eqNullSafe(char))) >= min_agree
    return strong | ~F.contains(F.lit(weak), F.coalesce(char, F.lit(""))) | (frames >= min_frames) | agree | (conf >= min_conf)


@dataclass(frozen=True)
class CollectionPolicy:
    min_conf: float = 0.85
    min_margin: float = 0.10
    weak: str = ""
    targets: str = ""
    supported: str = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
    good_alignment: tuple[str, ...] = ("ENGRAVED_BOXES", "ADAPTIVE_PROJECTION")


def collection_reasons(char: Column, gated: Column, conf: Column, second: Column, disagree: Column, expected: Column, policy: CollectionPolicy) -> Column:
    """Sorted reasons joined with ';', empty when the position is not worth collecting."""
    c = F.coalesce(char, F.lit(""))
    known = F.coalesce(expected, F.lit("")) != ""
    reasons = F.array(
        F.when((c == "") | gated.eqNullSafe(F.lit("?")), "UNKNOWN"),
        F.when(conf < policy.min_conf, "LOW_CONFIDENCE"),
        F.when(conf - second < policy.min_margin, "LOW_MARGIN"),
        F.when((c != "") & F.contains(F.lit(policy.weak), c), "WEAK_CLASS"),
        F.when(disagree, "ENGINE_DISAGREEMENT"),
        F.when(known & ~F.contains(F.lit(policy.supported), expected), "UNSUPPORTED_EXPECTED_CLASS"),
        F.when(known & F.contains(F.lit(policy.targets), expected), "TARGET_CHAR"),
    )
    return F.array_join(F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull()))), ";")


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: Column | float = 0) -> Column:
    """Box widened by ``pad`` and cut to the image; NULL when nothing is left."""
    zero = F.lit(0)
    p = pad if isinstance(pad, Column) else F.lit(pad)
    a, b = F.greatest(zero, x1 - p), F.greatest(zero, y1 - p)
    c, d = F.least(width, x2 + p), F.least(height, y2 + p)
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def margin_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, share: float) -> Column:
    """Box widened by a share of its own size on each side."""
    mx, my = ((x2 - x1) * share).cast("int"), ((y2 - y1) * share).cast("int")
    zero = F.lit(0)
    a, b = F.greatest(zero, x1 - mx), F.greatest(zero, y1 - my)
    c, d = F.least(width, x2 + mx), F.least(height, y2 + my)
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def counter(*candidates: Column) -> Column:
    """First present value as an integer; missing or non-numeric counts as 0."""
    return F.coalesce(F.coalesce(*candidates).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def job_outcome(reads: Column, unavailable: Column, errors: Column, timeouts: Column, crashes: Column, fusion: Column) -> Column:
    """F16: outcome class of a recognition job, telemetry first, then the fusion status."""
    none = reads == 0
    return (
        F.when(none & ((unavailable > 0) | (errors > 0)), "ENGINE_UNAVAILABLE")
        .when(none & (timeouts > 0), "TIMEOUT")
        .when(none & (crashes > 0), "CRASH")
        .when(none | (F.coalesce(fusion, F.lit("NO_READ")) == "NO_READ"), "NO_READ")
        .when(fusion != "ACCEPT", "AMBIGUOUS")
        .otherwise("ACCEPT")
    )


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 for an empty whole."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0))), F.lit(0.0))


__all__ = [n for n in dir() if not n.startswith("_")]
