"""Evaluation: interleaved comparisons and their report, known-item retrieval, ties, percentiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.sources.tables import written

CREDIT = ("opened", "cited", "pinned")
RECALL_AT, NDCG_AT = 20, 10


def interleave(a: DataFrame, b: DataFrame, sides: DataFrame) -> DataFrame:
    """(qid, place, anchor, credited_to): A and B alternate, each turn taking its highest result not yet taken.

    ``a`` and ``b``: qid, anchor, pos over the same results. ``sides``: qid, side (``a`` or ``b`` starts). Queries whose
    rankings agree are null comparisons: their results are listed with credited_to null. One group is one result page.
    """
    both = a.select("qid", "anchor", F.col("pos").alias("pos_a")).join(b.select("qid", "anchor", F.col("pos").alias("pos_b")), ["qid", "anchor"]).join(sides, "qid")

    def merged(page: pd.DataFrame) -> pd.DataFrame:
        orders = {s: page.sort_values(f"pos_{s}")["anchor"].tolist() for s in "ab"}
        same = orders["a"] == orders["b"]
        turn, taken, out = page["side"].iloc[0], set(), []
        heads = {"a": iter(orders["a"]), "b": iter(orders["b"])}
        while len(out) < len(page):
            pick = next((x for x in heads[turn] if x not in taken), None)
            if pick is not None:
                taken.add(pick)
                out.append((pick, None if same else turn))
            turn = "b" if turn == "a" else "a"
        return pd.DataFrame({"qid": page["qid"].iloc[0], "place": range(len(out)), "anchor": [x for x, _ in out], "credited_to": [c for _, c in out]})

    kinds = dict(both.dtypes)
    return both.groupBy("qid").applyInPandas(merged, f"qid {kinds['qid']}, place int, anchor {kinds['anchor']}, credited_to string")


def record_faults(presentations: DataFrame) -> DataFrame:
    """(id, fault) for presentations of a wrong shape: both sides under one strategy, credit in a null comparison, none in
    a real one, an anchor twice, credit for neither side, an id twice, another pair of strategies than the first id's."""
    pair = F.array_sort(F.array("strategy_a", "strategy_b"))
    credited = F.col("attribution.credited_to")
    first = presentations.agg(F.min_by(pair, "id").alias("first_pair"))  # one row
    times = presentations.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    rows = presentations.join(times, "id").crossJoin(F.broadcast(first))
    faults = {
        "one strategy": F.col("strategy_a") == F.col("strategy_b"),
        "credit in a null comparison": F.col("is_null_comparison") & F.exists(credited, lambda c: c.isNotNull()),
        "no credit in a comparison": ~F.col("is_null_comparison") & F.exists(credited, lambda c: c.isNull()),
        "duplicate anchor": F.size(F.array_distinct("attribution.anchor")) < F.size("attribution"),
        "third strategy": F.exists(credited, lambda c: ~c.isin("a", "b")),
        "duplicate id": F.col("times") > 1,
        "differing pairs": pair != F.col("first_pair"),
    }
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in faults.items()]))).alias("fault"))


def require_usable(events: DataFrame, presentations: DataFrame) -> None:
    """Refuses records of a wrong shape and events that contradict their record: a report over them would mislead."""
    if (wrong := record_faults(presentations).first()) is not None:
        raise ValueError(f"presentation {wrong['id']}: {wrong['fault']}")
    if (wrong := disposed_events(events, presentations).where("startswith(disposition, 'reject')").first()) is not None:
        raise ValueError(f"an event of presentation {wrong['presentation']}: {wrong['disposition']}")


def disposed_events(events: DataFrame, presentations: DataFrame) -> DataFrame:
    """Each event with the presentation it belongs to and a disposition: score, skip (with the reason) or reject.

    ``events``: kind, anchor, ts, generation, policy, presentation. ``presentations``: id, query_class, strategy_a,
    strategy_b, generation, attribution (array of anchor, credited_to), starting_side, is_null_comparison.
    """
    records = presentations.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(f"p_{c}") for c in ("query_class", "strategy_a", "strategy_b", "generation", "starting_side", "is_null_comparison")])
    given = presentations.where("not is_null_comparison").select(F.col("id").alias("presentation"), F.explode("attribution").alias("x")).select("presentation", "x.anchor", "x.credited_to")
    given = given.groupBy("presentation", "anchor").agg(F.first("credited_to").alias("credited_to"), F.count(F.lit(1)).alias("times"))
    joined = events.join(records.withColumnRenamed("id", "presentation"), "presentation", "left").join(given, ["presentation", "anchor"], "left")
    disposition = (
        F.when(F.col("presentation").isNull(), "skip: no presentation")
        .when(F.col("copies").isNull(), "skip: unknown presentation")
        .when(F.col("copies") > 1, "reject: duplicate id")
        .when(F.col("p_is_null_comparison"), "skip: null comparison")
        .when(F.col("generation") != F.col("p_generation"), "reject: generation")
        .when(F.col("times").isNull(), "reject: not shown")
        .when(F.col("times") > 1, "reject: duplicate anchor")
        .when(~F.col("credited_to").isin("a", "b"), "reject: third strategy")
        .when((F.col("policy") != "interleaved") & (F.col("policy") != F.when(F.col("credited_to") == "a", F.col("p_strategy_a")).otherwise(F.col("p_strategy_b"))), "reject: policy")
        .otherwise("score")
    )
    return joined.withColumn("disposition", disposition)


def comparison_report(events: DataFrame, presentations: DataFrame) -> DataFrame:
    """Rows by level: ``class`` and ``total`` (while one generation is scored), ``generation``, ``generation_class``.

    (level, strategy, query_class, generation, presented, credits, penalties, net, rate); rate is null where nothing was
    presented. Every strategy has a row for every class and generation of the records, with zeros if need be. One
    grouping-sets aggregate over conditional sums.
    """
    scored = disposed_events(events, presentations).where("disposition = 'score'").select(
        F.when(F.col("credited_to") == "a", F.col("p_strategy_a")).otherwise(F.col("p_strategy_b")).alias("strategy"), F.col("p_query_class").alias("query_class"), F.col("p_generation").alias("generation"), "kind"
    )
    seeds = presentations.where("not is_null_comparison").select(F.explode(F.array("strategy_a", "strategy_b")).alias("strategy"), "query_class", "generation").distinct().withColumn("kind", F.lit(None).cast("string"))
    rows = scored.unionByName(seeds)
    sets = rows.groupingSets(
        [["strategy", "query_class"], ["strategy", "generation"], ["strategy", "query_class", "generation"], ["strategy"]], "strategy", "query_class", "generation"
    ).agg(
        F.grouping_id().alias("gid"), F.count_if(F.col("kind") == "shown").alias("presented"), F.count_if(F.col("kind").isin(*CREDIT)).alias("credits"), F.count_if(F.col("kind") == "dismissed").alias("penalties"),
    )
    level = F.when(F.col("gid") == 1, "class").when(F.col("gid") == 2, "generation").when(F.col("gid") == 0, "generation_class").otherwise("total")
    generations = scored.agg(F.count_distinct("generation").alias("generations"))  # one row
    out = sets.withColumn("level", level).crossJoin(F.broadcast(generations)).where((F.col("generations") <= 1) | F.col("level").startswith("generation"))
    net = F.col("credits") - F.col("penalties")
    return out.select("level", "strategy", "query_class", "generation", "presented", "credits", "penalties", net.alias("net"), F.try_divide(net, F.col("presented")).alias("rate"))


def skip_counts(events: DataFrame, presentations: DataFrame) -> DataFrame:
    return disposed_events(events, presentations).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def corrected_preference(outcomes: DataFrame) -> DataFrame:
    """(pooled, corrected, a_first, b_first, severe): the share that prefers A, and the mean of the shares by starting
    side, null if a side is empty. ``outcomes``: starting_side, prefers_a. Severe: a side has under a quarter."""
    a, b, won = F.col("starting_side") == "a", F.col("starting_side") == "b", F.col("prefers_a").cast("double")
    n_a, n_b = F.count_if(a), F.count_if(b)
    return outcomes.agg(
        F.avg(won).alias("pooled"), ((F.avg(F.when(a, won)) + F.avg(F.when(b, won))) / 2).alias("corrected"), n_a.alias("a_first"), n_b.alias("b_first"), (F.least(n_a, n_b) * 4 < n_a + n_b).alias("severe")
    )


def gain(rank: Column) -> Column:
    """nDCG gain of a rank from 1, zero beyond ``NDCG_AT``."""
    return F.when(rank <= NDCG_AT, 1 / F.log2(rank + 1)).otherwise(F.lit(0.0))


def known_item_report(expected: DataFrame, hits: DataFrame, scored: DataFrame | None = None, channels: list[str] | None = None) -> DataFrame:
    """(query_class, channel, scored, recalled, recall_rate, mean_ndcg) of known-item queries.

    ``expected``: qid, chunk_id, query_class. ``hits``: qid, channel, chunk_id, rank (from 1). ``scored``: the (qid,
    channel) that count, all by default. ``channels``: those that get rows, hits or not; by default those with hits.
    Items that are not recalled carry no nDCG; means over nothing are null.
    """
    named = hits.select("channel").distinct() if channels is None else expected.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    asked = expected.crossJoin(F.broadcast(named))  # a handful of channels
    counts = F.lit(True) if scored is None else F.col("counts")
    if scored is not None:
        asked = asked.join(scored.select("qid", "channel", F.lit(True).alias("counts")), ["qid", "channel"], "left")
    asked = asked.withColumn("counts", F.coalesce(counts, F.lit(False)))
    found = asked.join(hits.select("qid", "channel", "chunk_id", "rank"), ["qid", "channel", "chunk_id"], "left")
    best = found.groupBy("qid", "channel", "query_class", "counts").agg(F.min(F.when(F.col("counts") & (F.col("rank") <= RECALL_AT), F.col("rank"))).alias("rank"))
    return best.groupBy("query_class", "channel").agg(
        F.count_if("counts").alias("scored"), F.count("rank").alias("recalled"), F.try_divide(F.count("rank"), F.count_if("counts")).alias("recall_rate"), F.avg(F.when(F.col("rank").isNotNull(), gain(F.col("rank")))).alias("mean_ndcg")
    )


def sample_order(seed: int, key: Column) -> Column:
    """What a seeded sample is ordered by: a hash of seed and key, so that samples of one seed nest."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def known_items(chunks: DataFrame, seed: int, n: int) -> DataFrame:
    """(chunk_id, text): n chunks with a derivable query, in an order fixed by the seed; samples of one seed nest."""
    from lorekeep.functions.text import derived_query

    derived = chunks.select("chunk_id", derived_query(F.col("text"), seed).alias("text")).where("text is not null")
    return derived.orderBy(sample_order(seed, F.col("chunk_id")), "chunk_id").limit(n)


def known_item_run(items: DataFrame, search: Callable[[DataFrame, tuple[str, ...]], DataFrame], corpus_size: int, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The known-item report of three rankings (lexical, vector, fused) for ``items``: qid, chunk_id, text.

    ``embed`` gives the batch of queries its ``embedding`` at once (null where a text has none); without it there are no
    vectors, and the vector ranking isn't reported. ``search(queries, channels)`` answers a batch of queries; the vector
    ranking is that of the vector channel alone. A ranking that is shorter than min(``RECALL_AT``, corpus) says nothing
    about an item and isn't scored, unless the item is in it.
    """
    from lorekeep.functions.text import query_class

    q = items.select("qid", "text", F.lit(RECALL_AT).alias("k"), F.lit(None).cast("string").alias("project"), F.lit(0).alias("variant"))
    kinds = {"lexical": ("trigram", "segment"), "fused": ("trigram", "segment", "vector")}
    if embed is not None:
        q, kinds = written(embed(q)), {"lexical": kinds["lexical"], "vector": ("vector",), "fused": kinds["fused"]}
    expected = items.select("qid", "chunk_id", query_class(F.col("text")).alias("query_class"))
    own = [search(q, channels).select("qid", F.lit(name).alias("channel"), "chunk_id", (F.col("pos") + 1).alias("rank")) for name, channels in kinds.items()]
    hits = written(reduce(DataFrame.unionByName, own))
    shallow = hits.groupBy("qid", "channel").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(RECALL_AT, corpus_size)).select("qid", "channel")
    found = hits.join(expected.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi").select("qid", "channel")
    deep = shallow.unionByName(found).distinct()
    return known_item_report(expected, hits, deep, list(kinds))


def tie_statistics(ranked: DataFrame) -> DataFrame:
    """(qid, n, tied_pairs, tied_score_pairs, runs, covered, longest) over each query's ranking: neighbours that tie by
    (band, score) and by score alone, runs of two or more, results inside runs, and the longest run."""
    order = Window.partitionBy("qid").orderBy("pos")
    same_score = F.coalesce(F.col("base_score") == F.lag("base_score").over(order), F.lit(False))
    same = same_score & F.coalesce(F.col("band") == F.lag("band").over(order), F.lit(False))
    rows = ranked.withColumn("same_score", same_score).withColumn("same", same)
    rows = rows.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order))
    runs = rows.groupBy("qid", "run").agg(F.count(F.lit(1)).alias("size"), F.count_if("same").alias("tied"), F.count_if("same_score").alias("tied_score"))
    in_run = F.col("size") > 1
    return runs.groupBy("qid").agg(
        F.sum("size").alias("n"), F.sum("tied").alias("tied_pairs"), F.sum("tied_score").alias("tied_score_pairs"), F.count_if(in_run).alias("runs"),
        F.sum(F.when(in_run, F.col("size")).otherwise(0)).alias("covered"), F.max("size").alias("longest"),
    )


def run_lengths(ranked: DataFrame) -> DataFrame:
    """(length, runs): how many stretches of results that tie by (band, score) there are of each length from two."""
    from lorekeep.operators.rerank import tie_runs

    sizes = tie_runs(ranked).groupBy("qid", "run").agg(F.count(F.lit(1)).alias("length"))
    return sizes.where("length > 1").groupBy("length").agg(F.count(F.lit(1)).alias("runs"))


def latency_percentile(samples: DataFrame, column: str, by: str, share: float = 0.95) -> DataFrame:
    """Nearest-rank percentile of each group: the value at place ceil(share times n)."""
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").alias("p95"))


def marks(presented: DataFrame, choices: DataFrame) -> DataFrame:
    """Deliberate events from (presentation, rank from 1, kind, ts): the anchor at that rank, under the strategy that is
    credited with it. A pin gets a random note reference. ``presented``: id, generation, strategy_a, strategy_b, attribution."""
    places = presented.select(F.col("id").alias("presentation"), "generation", "strategy_a", "strategy_b", F.posexplode("attribution").alias("place", "x"))
    picked = choices.join(places, (choices["presentation"] == places["presentation"]) & (choices["rank"] == places["place"] + 1)).drop(places["presentation"])
    policy = F.when(F.col("x.credited_to") == "a", F.col("strategy_a")).when(F.col("x.credited_to") == "b", F.col("strategy_b")).otherwise("interleaved")
    return picked.select("kind", F.col("x.anchor").alias("anchor"), "ts", "generation", policy.alias("policy"), F.when(F.col("kind") == "pinned", F.uuid()).alias("note_ref"), "presentation")


def script_cooccurrence(texts: DataFrame) -> DataFrame:
    """One row: texts, those with Han characters, with Latin words, and with both."""
    from lorekeep.functions.text import HAN

    han, latin = F.col("text").rlike(HAN), F.col("text").rlike("[A-Za-z]{2,}")
    return texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if(han).alias("han"), F.count_if(latin).alias("latin"), F.count_if(han & latin).alias("both"))
