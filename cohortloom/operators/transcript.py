"""Entity-level features of spoken transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numeric import coerce_numeric
from cohortloom.functions.text import READING_PROMPT, norm_text, reference_deviation, sequence_ratio, text_profile
from cohortloom.operators.ranking import exact_quantiles


def sentence_rows(transcripts: DataFrame) -> DataFrame:
    """(entity_id, text, duration, rate, silence, emotion), one row per sentence; none for an empty list."""
    return transcripts.select("entity_id", F.explode("detailed_results").alias("s")).where(
        F.col("s").isNotNull()
    ).select(
        "entity_id",
        F.col("s.text").alias("text"),
        coerce_numeric(F.col("s.duration")).alias("duration"),
        coerce_numeric(F.col("s.raw_sentence.SpeechRate")).alias("rate"),
        coerce_numeric(F.col("s.raw_sentence.SilenceDuration")).alias("silence"),
        coerce_numeric(F.col("s.raw_sentence.EmotionValue")).alias("emotion"),
    )


def sentence_stats(sentences: DataFrame) -> DataFrame:
    """Twenty-five timing features per entity from its sentence rows.

    Medians come from bucketed exact quantiles; everything else combines map-side, so an entity with a
    third of all sentences is no single task.
    """
    n_chars = F.length(norm_text(F.col("text"))).cast("double")
    rows = sentences.withColumn("chars", F.when(n_chars > 0, n_chars))
    pause, long_pause = F.count_if(F.col("silence") > 0), F.count_if(F.col("silence") >= 5)
    count = F.count("*").cast("double")
    total, quiet = F.coalesce(F.sum("duration"), F.lit(0.0)), F.coalesce(F.sum("silence"), F.lit(0.0))
    flat = rows.groupBy("entity_id").agg(
        count.alias("sentence_count"),
        total.alias("duration_total"),
        F.avg("duration").alias("duration_mean"),
        F.stddev_pop("duration").alias("duration_std"),
        F.min("duration").alias("duration_min"),
        F.max("duration").alias("duration_max"),
        F.avg("rate").alias("rate_mean"),
        F.stddev_pop("rate").alias("rate_std"),
        F.min("rate").alias("rate_min"),
        F.max("rate").alias("rate_max"),
        quiet.alias("silence_total"),
        F.avg("silence").alias("silence_mean"),
        F.max("silence").alias("silence_max"),
        pause.cast("double").alias("pause_count"),
        long_pause.cast("double").alias("long_pause_count"),
        (pause / count).alias("pause_ratio"),
        (long_pause / count).alias("long_pause_ratio"),
        F.try_divide(quiet, total).alias("silence_to_duration"),
        F.avg("emotion").alias("emotion_mean"),
        F.stddev_pop("emotion").alias("emotion_std"),
        F.avg("chars").alias("chars_per_sentence_mean"),
        F.stddev_pop("chars").alias("chars_per_sentence_std"),
    )
    long = rows.select("entity_id", *[F.col(m).cast("double").alias(m) for m in ("duration", "rate", "emotion")])
    long = long.unpivot(["entity_id"], ["duration", "rate", "emotion"], "measure", "value")
    medians = exact_quantiles(long, ["entity_id", "measure"], "value", {"median": 0.5})
    wide = medians.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"{m}_median")
            for m in ("duration", "rate", "emotion")
        ]
    )
    return flat.join(wide, "entity_id", "left")


def transcript_features(transcripts: DataFrame, reference: str = READING_PROMPT) -> DataFrame:
    """All 44 features per transcript (entity_id, text, detailed_results)."""
    stats = sentence_stats(sentence_rows(transcripts))
    both = transcripts.select("entity_id", "text").join(stats, "entity_id", "left")
    zero = ("sentence_count", "duration_total", "silence_total", "pause_count", "long_pause_count")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})
    ref = F.lit(reference)
    return both.withColumns(
        {
            **text_profile(F.col("text"), F.col("sentence_count"), F.col("duration_total")),
            **reference_deviation(F.col("text"), ref),
            "sequence_ratio": sequence_ratio(F.col("text"), ref),
        }
    )
