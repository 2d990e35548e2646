"""Scores: diversity-velocity-depth spike, standardised virality, viral weight, hype risk. Columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_HOURS = 36.0


def diversity(n_axes: Column) -> Column:
    return F.when(n_axes >= 3, 5.0).when(n_axes == 2, 2.5).otherwise(1.0)


def decay(hours: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    return F.exp(hours * (-math.log(2) / half_life))


def age_hours(as_of: Column, earliest: Column) -> Column:
    """Hours since `earliest`, half an hour at least."""
    seconds = F.timestamp_diff("SECOND", earliest, as_of).cast("double")
    return F.greatest(seconds, F.lit(1800.0)) / 3600.0


def spike(n_sources: Column, n_axes: Column, n_platforms: Column, hours: Column, comments: Column, viral: Column, delta: Column) -> dict[str, Column]:
    """velocity, depth, raw, score and is_spiking of an item."""
    zero = F.lit(0.0)
    velocity = n_sources / F.sqrt(F.greatest(F.lit(1.0), hours)) * (1 + F.least(F.lit(2.5), delta / 40.0))
    depth = F.log10(F.greatest(F.lit(1.0), 10 + 2.0 * comments + 0.5 * F.greatest(zero, viral) + 0.5 * F.greatest(zero, delta)))
    raw = diversity(n_axes) * velocity * depth * 10
    score = F.round(raw * decay(hours), 1)
    spiking = (score >= 0.3) & (n_sources >= 2) & ((n_platforms >= 2) | (n_axes >= 2))
    return {"velocity": velocity, "depth": depth, "raw": raw, "score": score, "is_spiking": spiking}


def standardized(platform: Column, number: Column, rating: Column) -> Column:
    """0 to 100 on the scale of a platform; with a rating (0 to 5) 70 to 30. Fixed caps and fallbacks by platform."""

    def scaled(cap: float, fallback: int) -> Column:
        return F.when(number > 0, F.log10(number + 1.0) / math.log10(cap) * 100).otherwise(F.lit(float(fallback)))

    norm = F.when(platform.contains("GitHub"), scaled(5000, 25)).when(platform.contains("Hacker News"), scaled(800, 30)).when(platform.contains("Hugging Face"), scaled(300, 30)).when(platform.contains("GeekNews"), scaled(100, 35)).when(platform.contains("ArXiv"), 55.0).otherwise(25.0)
    norm = F.greatest(F.lit(5.0), F.least(F.lit(100.0), F.floor(norm + 0.5)))
    return F.when(rating > 0, F.floor(norm * 0.7 + rating * 20 * 0.3 + 0.5)).otherwise(norm).cast("long")


def viral_weight(value: Column, n_platforms: Column, days_old: Column, is_spiking: Column, growth: Column, enriched: Column) -> Column:
    fresh = F.when(days_old == 0, 20.0).when(days_old == 1, 10.0).when(days_old == 2, 2.0).otherwise(0.01)
    recent = days_old.between(0, 2)
    cross = F.when(n_platforms > 1, n_platforms * 1.5).otherwise(1.0)
    burst = F.when(recent & is_spiking, 3.0).otherwise(1.0)
    rising = F.when(recent & (growth > 0), 1 + F.least(F.lit(2.0), growth / 50.0)).otherwise(1.0)
    return F.greatest(F.lit(1.0), value) * cross * fresh * burst * rising * F.when(enriched, 1.2).otherwise(1.0)


def hype_risk(text: Column, platform: Column, stars: Column, description_length: Column) -> Column:
    """0 to 100; text is title, description and metric in lower case. Fixed phrases and weights."""
    hit = lambda pattern, weight: F.when(text.rlike(pattern), weight).otherwise(0)
    boast = hit(r"\b(beats o1|beats gpt-4o|crushes claude|100x faster|kills openai)\b", 35)
    income = hit(r"(?U)\b(make \$|passive income|월 1000|자동 수익|shorts automation|tiktok bot)\b", 40)
    farming = F.when((platform == "GitHub Official") & (stars > 3000) & (description_length < 30), 25).otherwise(0)
    masked = F.when(text.rlike(r"\b(open source|free for everyone)\b") & text.rlike(r"\b(fair source|non-commercial|business license|\$1m)\b"), 20).otherwise(0)
    return F.least(F.lit(100), F.lit(15) + boast + income + farming + masked)
