"""Re-ranking under bounds: strategies move results at most a few places, and a guard reports every broken rule.

A ranking is rows (qid, anchor, pos, base_score, band) with bands not decreasing along pos. Strategies get net
strengths (anchor, net). The bounded pass is sequential by nature, over at most a result page for each query and
segment, so it is an ordered fold for one pass and ``applyInPandas`` by query in general.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.memory import KINDS
from lorekeep.sources.shipping import ship_package



@dataclass(frozen=True)
class Strategy:
    """What a strategy is by name: how far it may move results at most and by default, within what, what share spreads in
    its projection, and which signals it reads."""

    name: str
    ceiling: int
    bound: int
    segment: str  # band or run
    spreading: float = 0.0
    signals: tuple[str, ...] = ("opened", "cited", "pinned", "dismissed")


STRATEGIES = {
    s.name: s
    for s in (Strategy("archival", 0, 0, "run", signals=()), Strategy("human-like", 10, 3, "band", spreading=0.3), Strategy("conservative", 10, 1, "run"))
}


def authorised(strategy: str | Strategy, bound: int | None = None) -> tuple[Strategy, int]:
    """The registered strategy and the bound in force. Unknown names, other strategies under a registered name, negative
    bounds and bounds above the ceiling are refused."""
    name = strategy if isinstance(strategy, str) else strategy.name
    own = STRATEGIES.get(name)
    if own is None:
        raise ValueError(f"no strategy {name!r} is registered")
    if not isinstance(strategy, str) and strategy != own:
        raise ValueError(f"this strategy passes itself off as {name!r}")
    bound = own.bound if bound is None else bound
    if bound < 0:
        raise ValueError(f"a bound of {bound} places is negative")
    if bound > own.ceiling:
        raise ValueError(f"{name} may move results by {own.ceiling} places at most, not {bound}")
    return own, bound


#: A result page of one query is never longer.
MOST_RESULTS = 1000


def tie_runs(ranked: DataFrame) -> DataFrame:
    """Adds ``run``: the number of the maximal stretch of equal (band, base_score) that a row is in."""
    order = Window.partitionBy("qid").orderBy("pos")
    changed = ~(F.col("band").eqNullSafe(F.lag("band").over(order)) & (F.col("base_score") == F.lag("base_score").over(order)))
    return ranked.withColumn("run", F.sum(F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0)).over(order))


def bounded_pass(strengths: list[float], bound: int) -> list[int]:
    """Places after ``bound`` passes from left to right: neighbours swap where the right one is strictly stronger and
    neither has moved in this pass."""
    order = list(range(len(strengths)))
    for _ in range(bound):
        moved, i = False, 0
        while i + 1 < len(order):
            if strengths[order[i + 1]] > strengths[order[i]]:
                order[i], order[i + 1], moved, i = order[i + 1], order[i], True, i + 2
            else:
                i += 1
        if not moved:
            break
    return order


def rerank(ranked: DataFrame, strengths: DataFrame, strategy: str | Strategy, bound: int | None = None) -> DataFrame:
    """(qid, anchor, pos, base_score, band, new_pos, displacement, history, movement).

    archival keeps the order and reads no history; human-like reorders within bands (bound 3 by default); conservative
    only within runs of exact ties (bound 1). displacement is the old place less the new one.
    """
    own, bound = authorised(strategy, bound)
    rows = tie_runs(ranked).join(strengths.select("anchor", "net"), "anchor", "left")
    segment, known = own.segment, F.col("net").isNotNull() if own.signals else F.lit(False)
    rows = rows.select("qid", "anchor", "pos", "base_score", "band", F.col(segment).cast("long").alias("segment"), F.coalesce("net", F.lit(0.0)).alias("net"), known.alias("known"))
    if bound:
        ship_package(ranked.sparkSession)

        def moved(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("pos").reset_index(drop=True)
            new = group["pos"].to_numpy().copy()
            for _, part in group.groupby("segment", sort=False):
                for place, i in enumerate(bounded_pass(part["net"].tolist(), bound)):
                    new[part.index[i]] = part["pos"].iloc[place]
            return group.assign(new_pos=new)

        rows = rows.groupBy("qid").applyInPandas(moved, rows.select("*", F.col("pos").alias("new_pos")).schema)
    else:
        rows = rows.withColumn("new_pos", F.col("pos"))
    shift = F.col("pos") - F.col("new_pos")
    return rows.select(
        "qid", "anchor", "pos", "base_score", "band", "new_pos", shift.alias("displacement"), F.when(F.col("known"), F.col("net")).alias("history"),
        F.when(shift > 0, F.concat(F.lit("advanced "), shift)).when(shift < 0, F.concat(F.lit("receded "), -shift)).otherwise("unmoved").alias("movement"),
    )


def one_pass_fold(ranked: DataFrame, strengths: DataFrame, segment: str) -> DataFrame:
    """The bounded pass with bound 1 as a fold over each segment's ordered array, without Python:
    (qid, anchor, new_pos). ``segment``: band or run."""
    rows = tie_runs(ranked).join(strengths.select("anchor", "net"), "anchor", "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    item = F.struct("pos", "anchor", "net")
    lists = rows.groupBy("qid", F.col(segment).alias("segment")).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        swap = acc["free"] & (x["net"] > last["net"])
        out = F.when(swap, F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(x, last))).otherwise(F.concat(acc["out"], F.array(x)))
        return F.struct(out.alias("out"), (~swap).alias("free"))

    start = F.struct(F.slice("items", 1, 1).alias("out"), F.lit(True).alias("free"))
    folded = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.lit(0), F.size("items") - 1)), start, step, lambda a: a["out"])
    return lists.select("qid", F.posexplode(folded).alias("nth", "x"), F.get("items", F.lit(0))["pos"].alias("first")).select("qid", "x.anchor", (F.col("first") + F.col("nth")).alias("new_pos"))


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, anchor, displacement) between two orders of the same results."""
    return before.select("qid", "anchor", "pos").join(after.select("qid", "anchor", F.col("pos").alias("new_pos")), ["qid", "anchor"]).select("qid", "anchor", (F.col("pos") - F.col("new_pos")).alias("displacement"))


def guard_violations(before: DataFrame, after: DataFrame, bound: int, within_ties: bool = False, strengths: DataFrame | None = None) -> DataFrame:
    """(qid, rule, detail): one row for every broken rule; empty for a sound re-ranking.

    ``before``: qid, anchor, pos, base_score, band. ``after``: qid, anchor, pos, and what the strategy claims:
    base_score, band, displacement, movement, history. ``strengths`` (anchor, net, and what it is made of), given where the
    strategy reads signals, must be well formed, and a claimed history must be what they say; none may be claimed less.
    """
    runs = tie_runs(before)
    joined = runs.join(after.select("qid", "anchor", F.col("pos").alias("to"), F.col("band").alias("to_band"), "displacement", "movement", (F.col("history") if "history" in after.columns else F.lit(None).cast("double")).alias("history")), ["qid", "anchor"], "full_outer")
    at = runs.select("qid", F.col("pos").alias("to"), F.col("band").alias("place_band"), F.col("run").alias("place_run"))
    seen = joined.join(at, ["qid", "to"], "left")
    measures = [c for c in ("reinforcement", "suppression", "impressions", *KINDS[1:]) if strengths is not None and c in strengths.columns]
    if strengths is not None:
        seen = seen.join(strengths.select("anchor", "net", *[F.col(m).alias(f"of_{m}") for m in measures]), "anchor", "left")
    real = F.col("pos") - F.col("to")
    said = F.when(real > 0, F.concat(F.lit("advanced "), real)).when(real < 0, F.concat(F.lit("receded "), -real)).otherwise("unmoved")
    score_ok = F.coalesce(~F.isnan("base_score") & (F.abs("base_score") < float("inf")), F.lit(False))
    order = Window.partitionBy("qid").orderBy("pos")
    rules = {
        "finite_scores": F.col("pos").isNotNull() & ~score_ok,
        "permutation": F.col("pos").isNull() | F.col("to").isNull(),
        "band_per_place": F.col("band") != F.col("place_band"),
        "bound": F.abs(real) > bound,
        "honest_displacement": F.col("displacement") != real,
        "honest_movement": F.col("movement") != said,
    }
    if strengths is None:
        rules["honest_history"] = F.col("history").isNotNull()
    else:
        odd = lambda c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        rules["honest_history"] = F.col("history").isNotNull() & ~F.col("history").eqNullSafe(F.col("net"))
        rules["well_formed_statistics"] = reduce(Column.__or__, [odd(f"of_{m}") | (F.col(f"of_{m}") < 0) for m in measures], odd("net"))
    if within_ties:
        rules["ties_only"] = F.col("run") != F.col("place_run")
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    rows = seen.select("qid", F.explode(broken).alias("rule"), F.col("anchor").cast("string").alias("detail"))
    falls = before.withColumn("prior", F.lag("band").over(order)).where("prior > band").select("qid", F.lit("bands_in_order").alias("rule"), F.col("anchor").cast("string").alias("detail"))
    twice = after.groupBy("qid", "anchor").count().where("count > 1").select("qid", F.lit("permutation").alias("rule"), F.col("anchor").cast("string").alias("detail"))
    return rows.unionByName(falls).unionByName(twice)


def require_sound(violations: DataFrame) -> None:
    if (first := violations.first()) is not None:
        raise ValueError(f"the re-ranking broke {first['rule']} in query {first['qid']} ({first['detail']})")
