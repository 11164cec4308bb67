"""Worked examples: small inputs with results that were worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as fn
from lorekeep.operators import evaluate, memory, postings, rerank, retrieval


def test_fusion_of_three_cyclic_rankings(spark):
    ranked = spark.createDataFrame([(1, 1, "trigram", 1), (1, 2, "trigram", 2), (1, 2, "segment", 1), (1, 3, "segment", 2), (1, 3, "vector", 1), (1, 1, "vector", 2)], "qid int, chunk_id long, channel string, rank int")
    asked = spark.createDataFrame([(1, "x", 10, None, 0)], "qid int, text string, k int, project string, variant int")
    got = {r["chunk_id"]: r for r in retrieval.fuse(ranked, asked).collect()}
    assert got[1]["score"] == 1 / 61 + 1 / 62 and got[2]["score"] == 1 / 62 + 1 / 61 and got[3]["score"] == 1 / 62 + 1 / 61
    assert {r["band"] for r in got.values()} == {1} and [got[i]["pos"] for i in (1, 2, 3)] == [0, 1, 2]


def test_fused_scores_can_tie_exactly(spark):
    places = {1: (36, 100), 2: (40, 90), 3: (60, 60)}
    ranked = spark.createDataFrame([(1, c, ch, r) for c, (a, b) in places.items() for ch, r in (("trigram", a), ("segment", b))], "qid int, chunk_id long, channel string, rank int")
    asked = spark.createDataFrame([(1, "x", 10, None, 0)], "qid int, text string, k int, project string, variant int")
    assert {r["score"] for r in retrieval.fuse(ranked, asked).collect()} == {1 / 60}


def _index(chunks, tmp_path):
    return postings.build_index(chunks, str(tmp_path), layout=postings.Layout(2, 2))


def test_short_and_empty_phrases_match_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "p", "abab ababa"), (2, "p", "xy")], "chunk_id long, project string, text string")
    asked = spark.createDataFrame([(1, "ab", 5, None, 0), (2, "aba", 5, None, 0), (3, " ", 5, None, 0)], "qid int, text string, k int, project string, variant int")
    index = _index(chunks, tmp_path)
    got = postings.matches(index, asked, "trigram").collect()
    assert [(r["qid"], r["chunk_id"], r["tf"]) for r in got] == [(2, 1, 3)]  # overlapping places count
    assert postings.matches(index, asked, "segment").count() == 0


def test_han_phrases_match_as_runs_of_characters(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "p", "記憶釘選版本 tokenizer"), (2, "p", "選釘")], "chunk_id long, project string, text string")
    asked = spark.createDataFrame([(1, "釘選", 5, None, 0)], "qid int, text string, k int, project string, variant int")
    assert [r["chunk_id"] for r in postings.matches(_index(chunks, tmp_path), asked, "segment").collect()] == [1]
    forms = retrieval.with_variants(asked).orderBy("variant").collect()
    assert [r["text"] for r in forms] == ["釘選", "钉选"]


def test_query_classes(spark):
    expected = {"釘選": "cjk-2char", "釘選版": "cjk-3char", "釘選版本比較": "cjk-4plus", "tokenizer": "latin-alnum", "FTS5 分詞": "mixed", "": "latin-alnum", "?!": "latin-alnum", "かな": "latin-alnum", "한글": "latin-alnum", "記憶する": "cjk-2char"}
    got = spark.createDataFrame([(q,) for q in expected], "q string").select("q", fn.query_class(F.col("q")).alias("c")).collect()
    assert {r["q"]: r["c"] for r in got} == expected


def test_spans_are_code_points(spark):
    got = spark.createDataFrame([("a😀語b", 1, 3), ("abc", 2, 9), ("abc", -1, 2), ("abc", 2, 2)], "t string, lo int, hi int").select(fn.span_slice(F.col("t"), F.col("lo"), F.col("hi"))).collect()
    assert [r[0] for r in got] == ["😀語", None, None, None]


def _events(spark, rows):
    return spark.createDataFrame(rows, "kind string, anchor string, ts string, presentation string").withColumn("ts", F.to_timestamp("ts"))


NOW = "2024-01-10 00:00:00"


def _projected(spark, rows, **p):
    got = memory.project(_events(spark, rows), F.to_timestamp(F.lit(NOW)), memory.Parameters(**p))
    return {r["anchor"]: r for r in got.collect()}


def test_strength_weights_decay_and_future(spark):
    got = _projected(spark, [("opened", "a", NOW, None), ("cited", "b", "2024-01-07 00:00:00", None), ("dismissed", "c", NOW, None), ("pinned", "d", "2024-02-01 00:00:00", None), ("shown", "e", NOW, None)])
    assert got["a"]["net"] == 1.0 and got["b"]["reinforcement"] == pytest.approx(2 / math.sqrt(4)) and got["c"]["net"] == -2.0
    assert "d" not in got and got["e"]["net"] == 0 and got["e"]["impressions"] == 1


def test_spreading_is_one_hop_within_a_presentation(spark):
    rows = [("opened", "a", NOW, "p"), ("shown", "b", NOW, "p"), ("shown", "c", NOW, "q"), ("shown", "b", NOW, "q"), ("dismissed", "x", NOW, None), ("shown", "x", NOW, "p")]
    got = _projected(spark, rows)
    assert got["b"]["reinforcement"] == pytest.approx(0.3) and got["c"]["reinforcement"] == 0 and got["x"]["reinforcement"] == 0
    assert _projected(spark, rows, largest_group=2)["b"]["reinforcement"] == 0
    assert _projected(spark, rows, spreading=0.0)["b"]["reinforcement"] == 0


def test_parameters_are_checked():
    for bad in ({"decay": 0}, {"spreading": 1.0}, {"cited": -1}, {"opened": float("nan")}):
        with pytest.raises(ValueError):
            memory.Parameters(**bad)


def _page(spark, n, score=lambda i: 1.0 - i / 100, band=lambda i: 0):
    return spark.createDataFrame([(1, f"r{i}", i, float(score(i)), band(i)) for i in range(n)], "qid int, anchor string, pos int, base_score double, band int")


@pytest.mark.parametrize("bound,place", [(1, 4), (3, 2)])
def test_bounded_reorder(spark, bound, place):
    strength = spark.createDataFrame([("r5", 20.0)], "anchor string, net double")
    got = {r["anchor"]: r for r in rerank.rerank(_page(spark, 8), strength, "human-like", bound).collect()}
    assert got["r5"]["new_pos"] == place and got["r5"]["displacement"] == 5 - place and got["r5"]["movement"] == f"advanced {5 - place}"


def test_reorder_stays_in_bands_and_ties():
    assert rerank.bounded_pass([0, 1, 0, 1], 1) == [1, 0, 3, 2]
    assert rerank.bounded_pass([0, 0, 0], 5) == [0, 1, 2]


def test_conservative_moves_ties_alone(spark):
    page = _page(spark, 4, score=lambda i: (3, 2, 2, 1)[i])
    strength = spark.createDataFrame([("r1", 1.0), ("r2", 5.0), ("r3", 9.0)], "anchor string, net double")
    got = {r["anchor"]: r["new_pos"] for r in rerank.rerank(page, strength, "conservative").collect()}
    assert got == {"r0": 0, "r1": 2, "r2": 1, "r3": 3}


def test_guard_reports_each_broken_rule(spark):
    page = _page(spark, 4, band=lambda i: i // 2)
    honest = page.select("qid", "anchor", "pos", "base_score", "band", F.lit(0).alias("displacement"), F.lit("unmoved").alias("movement"))
    assert rerank.guard_violations(page, honest, 0).count() == 0
    swapped = honest.withColumn("pos", F.when(F.col("pos") == 1, 2).when(F.col("pos") == 2, 1).otherwise(F.col("pos")))
    assert {r["rule"] for r in rerank.guard_violations(page, swapped, 0, True).collect()} == {"band_per_place", "bound", "honest_displacement", "honest_movement", "ties_only"}
    lost = honest.where("pos < 3")
    assert {r["rule"] for r in rerank.guard_violations(page, lost, 0).collect()} == {"permutation"}
    assert {r["rule"] for r in rerank.guard_violations(page, honest.unionByName(lost), 0).collect()} == {"permutation"}
    nan = page.withColumn("base_score", F.when(F.col("pos") == 0, float("nan")).otherwise(F.col("base_score")))
    assert "finite_scores" in {r["rule"] for r in rerank.guard_violations(nan, honest, 0).collect()}
    falling = page.withColumn("band", 1 - F.col("band"))
    assert "bands_in_order" in {r["rule"] for r in rerank.guard_violations(falling, honest, 9).collect()}
    with pytest.raises(ValueError):
        rerank.require_sound(rerank.guard_violations(page, lost, 0))
    with pytest.raises(ValueError):
        rerank.rerank(page, honest, "archival", 1)


def test_interleaving_alternates(spark):
    a = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcd")] + [(2, x, i) for i, x in enumerate("ab")], "qid int, anchor string, pos int")
    b = spark.createDataFrame([(1, x, i) for i, x in enumerate("badc")] + [(2, x, i) for i, x in enumerate("ab")], "qid int, anchor string, pos int")
    sides = spark.createDataFrame([(1, "b"), (2, "a")], "qid int, side string")
    got = evaluate.interleave(a, b, sides).orderBy("qid", "place").collect()
    assert [(r["anchor"], r["credited_to"]) for r in got if r["qid"] == 1] == [("b", "b"), ("a", "a"), ("d", "b"), ("c", "a")]
    assert {r["credited_to"] for r in got if r["qid"] == 2} == {None}


def test_starting_side_correction(spark):
    rows = [("a", i < 30) for i in range(60)] + [("b", i < 36) for i in range(40)]
    got = evaluate.corrected_preference(spark.createDataFrame(rows, "starting_side string, prefers_a boolean")).first()
    assert got["pooled"] == pytest.approx(0.66) and got["corrected"] == pytest.approx(0.70) and not got["severe"]
    one = evaluate.corrected_preference(spark.createDataFrame(rows[:60], "starting_side string, prefers_a boolean")).first()
    assert one["corrected"] is None and one["severe"]


def test_known_item_scores(spark):
    expected = spark.createDataFrame([(i, i, "mixed") for i in range(1, 5)], "qid int, chunk_id long, query_class string")
    hits = spark.createDataFrame([(1, "x", 1, 1), (2, "x", 2, 10), (3, "x", 3, 15), (4, "x", 4, 26)], "qid int, channel string, chunk_id long, rank int")
    got = evaluate.known_item_report(expected, hits).first()
    assert (got["scored"], got["recalled"]) == (4, 3) and got["mean_ndcg"] == pytest.approx((1 + 1 / math.log2(11) + 0) / 3)


def test_tie_table(spark):
    page = _page(spark, 6, score=lambda i: (5, 5, 5, 2, 1, 1)[i], band=lambda i: 0)
    got = evaluate.tie_statistics(page).first()
    assert (got["n"], got["tied_pairs"], got["runs"], got["covered"], got["longest"]) == (6, 3, 2, 5, 3)


def test_event_rules(spark):
    rows = [("opened", None, "p"), ("pinned", None, "p"), ("liked", None, "p"), ("pinned", "n", "p q"), ("pinned", "n", "p")]
    e = spark.createDataFrame(rows, "kind string, note_ref string, presentation string").withColumn("ts", F.current_timestamp())
    assert [r["rule"] for r in memory.validate_events(e).collect()] == ["note_ref", "kind", "presentation"]
