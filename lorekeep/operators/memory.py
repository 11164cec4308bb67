"""Usage memory: an event log becomes time-decayed strengths, with one hop of spreading inside presentations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameters:
    """Fixed defaults: decay exponent, spreading factor, weights by kind, the largest group that spreads."""

    decay: float = 0.5
    spreading: float = 0.3
    opened: float = 1.0
    cited: float = 2.0
    pinned: float = 3.0
    dismissed: float = 2.0
    largest_group: int = 2000

    def __post_init__(self):
        values = (self.decay, self.spreading, self.opened, self.cited, self.pinned, self.dismissed)
        if not all(0 <= v < float("inf") for v in values) or self.decay <= 0 or self.spreading >= 1 or self.largest_group < 1:
            raise ValueError("parameters must be finite and not negative, decay above 0, spreading below 1")


KINDS = ("shown", "opened", "cited", "pinned", "dismissed")


def decayed(ts: Column, instant: Column, p: Parameters) -> Column:
    """(1 + age in days) to the power of minus decay; ages below zero count as zero."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(instant) - F.unix_micros(ts)) / F.lit(86400e6))
    return F.pow(1 + age, F.lit(-p.decay))


def live(events: DataFrame, instant: Column, corpus: DataFrame | None = None) -> DataFrame:
    """Events not after the instant whose anchor is in the corpus (anchors), if one is given."""
    past = events.where(F.col("ts") <= instant)
    return past if corpus is None else past.join(corpus.select("anchor").distinct(), "anchor", "left_semi")


def orphans(events: DataFrame, instant: Column, corpus: DataFrame) -> DataFrame:
    return events.where(F.col("ts") <= instant).join(corpus.select("anchor"), "anchor", "left_anti").select("anchor").distinct()


def future_events(events: DataFrame, instant: Column) -> DataFrame:
    return events.agg(F.count_if(F.col("ts") > instant).alias("future_events"))


def direct_strength(events: DataFrame, instant: Column, p: Parameters) -> DataFrame:
    """(anchor, reinforcement, suppression, impressions, last_deliberate, deliberate counts by kind)."""
    kind, by = F.col("kind"), decayed(F.col("ts"), instant, p)
    weight = F.when(kind == "opened", p.opened).when(kind == "cited", p.cited).when(kind == "pinned", p.pinned).otherwise(0.0)
    return events.groupBy("anchor").agg(
        F.sum(weight * by).alias("reinforcement"),
        F.sum(F.when(kind == "dismissed", p.dismissed * by).otherwise(0.0)).alias("suppression"),
        F.count_if(kind == "shown").alias("impressions"),
        F.max(F.when(kind != "shown", F.col("ts"))).alias("last_deliberate"),
        *[F.count_if(kind == k).alias(k) for k in KINDS[1:]],
    )


def spread(events: DataFrame, instant: Column, p: Parameters) -> DataFrame:
    """(anchor, spread): what each anchor gains from others' events in presentations that it was a member of.

    Contributions are added up by (presentation, anchor) first, so the join meets distinct members alone; groups above
    ``largest_group`` are out before it, which bounds what a presentation can give. A member's gain is the group's sum
    less its own, so no pairs are formed: each (presentation, member) is one row.
    """
    kind = F.col("kind")
    weight = F.when(kind == "opened", p.opened).when(kind == "cited", p.cited).when(kind == "pinned", p.pinned).otherwise(0.0)
    members = events.where("presentation is not null").groupBy("presentation", "anchor").agg(F.sum(weight * decayed(F.col("ts"), instant, p)).alias("own"))
    groups = members.groupBy("presentation").agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("n")).where((F.col("n") <= p.largest_group) & (F.col("n") > 1))
    dismissed = events.where("kind = 'dismissed'").select("anchor").distinct()
    gain = members.join(groups, "presentation").join(dismissed, "anchor", "left_anti")
    return gain.groupBy("anchor").agg((p.spreading * F.sum(F.col("all") - F.col("own"))).alias("spread"))


def project(events: DataFrame, instant: Column, p: Parameters = Parameters(), corpus: DataFrame | None = None) -> DataFrame:
    """The projection: direct strength and spreading together, with net strength; anchors with any of them."""
    past = live(events, instant, corpus)
    direct, extra = direct_strength(past, instant, p), spread(past, instant, p)
    both = direct.join(extra, "anchor", "full_outer").withColumn("reinforcement", F.coalesce("reinforcement", F.lit(0.0)) + F.coalesce("spread", F.lit(0.0)))
    filled = both.fillna(0, ["suppression", "impressions", *KINDS[1:]]).drop("spread")
    return filled.withColumn("net", F.col("reinforcement") - F.col("suppression")).where("reinforcement > 0 or suppression > 0 or impressions > 0")


def validate_events(events: DataFrame) -> DataFrame:
    """Rows that break the log's rules, with the rule: kind of the closed set; a note if and only if pinned;
    identifiers of the allowed shape; no free text."""
    from lorekeep.functions.text import is_identifier

    rule = (
        F.when(~F.col("kind").isin(*KINDS) | F.col("kind").isNull(), "kind")
        .when((F.col("kind") == "pinned") != F.col("note_ref").isNotNull(), "note_ref")
        .when(F.col("presentation").isNotNull() & ~is_identifier(F.col("presentation")), "presentation")
        .when(F.col("ts").isNull(), "ts")
    )
    return events.withColumn("rule", rule).where("rule is not null")
