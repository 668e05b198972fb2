"""Dataset curation jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.functions import text as X
from marktrace.functions.decisions import CollectionPolicy, collection_reasons, lighting_class, quality_class
from marktrace.operators.joins import dealt, new_items
from marktrace.operators.predicates import importable, pending_review
from marktrace.operators.windows import review_rank


def prepare_review_dataset(images: DataFrame, suggestions: DataFrame, session_pattern: str = r"(S\d+)_", key: str = "path") -> DataFrame:
    """H7: one review row per image: file-name parts, image classes, best suggestion, split and priority.

    images: path, width, height, mean, std, blur, dark_ratio, bright_ratio, saturated_ratio;
    suggestions: path, ocr_suggested, ocr_status, ocr_raw_best.
    """
    j = images.join(suggestions, key, "left")
    j = j.withColumns(
        {
            "session_id": X.name_part(F.col(key), session_pattern),
            "filename_guess": X.name_guess(F.col(key)),
            "lighting": lighting_class(F.col("mean"), F.col("std"), F.col("bright_ratio"), F.col("saturated_ratio")),
        }
    )
    j = j.withColumns(
        {
            "quality": quality_class(F.col("height"), F.col("width"), F.col("blur"), F.col("std"), F.col("dark_ratio"), F.col("saturated_ratio"), F.col("lighting")),
            "best_suggestion": X.best_suggestion(F.col("ocr_suggested"), F.col("ocr_raw_best"), F.col("filename_guess")),
            "group_key": X.group_key(F.col("session_id"), F.col("filename_guess"), X.file_stem(F.col(key))),
            "agreement": F.when((F.col("filename_guess") != "") & (F.col("filename_guess") == F.col("ocr_suggested")), "yes").otherwise("no"),
        }
    )
    return j.withColumns(
        {
            "split": X.hash_split(F.col("group_key")),
            "review_priority": X.review_priority(F.col("best_suggestion"), F.col("ocr_status"), F.col("filename_guess"), F.col("ocr_suggested"), F.col("quality")),
        }
    )


def curation_queue(items: DataFrame, priority: Sequence[str], risk: str) -> DataFrame:
    """H9: pending items in review order with 1-based position and confusion risk."""
    q = review_rank(pending_review(items), F.col("expected_character"), priority, "model_confidence", "collection_id")
    return q.withColumns(
        {"confusion_risk": F.contains(F.lit(risk), F.coalesce(F.col("model_character"), F.lit("-"))), "display_position": F.col("character_position") + 1}
    )


def import_reviewed(items: DataFrame, known: DataFrame, supported: str, key: str = "item_key") -> tuple[DataFrame, DataFrame]:
    """H9: (new manifest rows, items with updated review status). Running it again imports nothing.

    Only rows that are imported or already known are marked; unsupported classes stay ACCEPTED.
    """
    ready = importable(items, supported)
    fresh = new_items(ready, known, key, ["collection_id"])
    handled = ready.select("collection_id").withColumn("_done", F.lit(True))
    marked = items.join(handled, "collection_id", "left")
    status = F.when(F.col("_done"), "IMPORTED").otherwise(F.col("review_status"))
    return fresh, marked.withColumn("review_status", status).drop("_done")


def collect_active_learning(positions: DataFrame, sessions: DataFrame, policy: CollectionPolicy) -> DataFrame:
    """Positions worth labelling, with label status and eligibility.

    positions: session_id, position (0-based), char, gated, confidence, second, disagree, alignment, crop_hash, source_hash;
    sessions: session_id, trusted_id (NULL when not owned by the session).
    """
    j = dealt(positions, ["session_id"]).join(sessions, "session_id", "left")
    trusted = F.col("trusted_id").isNotNull()
    expected = F.when(trusted, F.nullif(F.substr("trusted_id", F.col("position") + 1, F.lit(1)), F.lit("")))
    j = j.withColumn("expected_character", expected)
    reasons = collection_reasons(F.col("char"), F.col("gated"), F.col("confidence"), F.col("second"), F.col("disagree"), F.col("expected_character"), policy)
    unsupported = F.col("expected_character").isNotNull() & ~F.contains(F.lit(policy.supported), F.col("expected_character"))
    good = F.col("alignment").isin(list(policy.good_alignment))
    out = j.withColumns(
        {
            "collection_reason": reasons,
            "label_status": F.when(trusted, "TRUSTED_LABEL").otherwise("UNLABELED"),
            "review_status": F.when(good, "PENDING").otherwise("PENDING_REVIEW"),
            "eligible": good & trusted,
            "model_character": F.when(unsupported, "UNKNOWN_CHAR").otherwise(F.col("char")),
        }
    )
    out = out.filter("collection_reason <> ''")
    return out.dropDuplicates(["source_hash", "position", "crop_hash", "session_id"])
