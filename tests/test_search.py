"""Search over postings: phrases, blocks that are left out, and how many jobs and scans a batch takes."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.operators import postings, retrieval

ASKED = "qid int, text string, k int, project string, variant int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["beta", "gamma", "delta", "of the", "naan"]
    own = lambda i: "alpha " * (8 if i % 20 == 0 else i % 3 > 0)
    rows = [(i, f"p{i % 3}", own(i) + " ".join(rng.choices(words, weights=[3, 5, 9, 2, 2], k=rng.randrange(15, 30)))) for i in range(2000)]
    df = spark.createDataFrame(rows, "chunk_id long, project string, text string")
    folder = str(tmp_path_factory.mktemp("index"))
    return dict((i, (p, t)) for i, p, t in rows), postings.build_index(df, folder, layout=postings.Layout(1, 128), frequent=1), df


QUERIES = [(1, "alpha", 1, None, 0), (2, "delta", 3, None, 0), (3, "of the", 5, None, 0), (4, "alpha", 2, "p1", 0), (5, "naa", 4, None, 0), (6, "amma de", 4, None, 0), (7, "ta", 2, None, 0), (8, "missing", 2, None, 0)]


def count(text, phrase, channel):
    if channel == "trigram":
        return sum(text.startswith(phrase, i) for i in range(len(text))) if len(phrase) >= 3 else 0
    own, asked = text.split(), phrase.split()
    return sum(own[i : i + len(asked)] == asked for i in range(len(own)))


@pytest.mark.parametrize("channel", postings.LEXICAL)
def test_matches_equal_a_scan_of_the_texts(spark, corpus, channel):
    texts, index, _ = corpus
    got = {(r["qid"], r["chunk_id"]): r["tf"] for r in postings.matches(index, spark.createDataFrame(QUERIES, ASKED), channel).collect()}
    assert got == {(q, i): n for q, phrase, *_ in QUERIES for i, (_, t) in texts.items() if (n := count(t, phrase, channel))}


@pytest.mark.parametrize("channel", postings.LEXICAL)
def test_blocks_that_are_left_out_change_nothing(spark, corpus, channel):
    _, index, _ = corpus
    asked = spark.createDataFrame(QUERIES, ASKED)
    whole = postings.SearchIndex(index.tables, index.statistics, index.layout)  # without summaries
    told = lambda i: sorted(map(tuple, retrieval.lexical_channel(i, asked, channel).collect()))
    assert told(index) == told(whole) and len(told(whole)) > 100


def test_rows_that_are_ranked_fall_with_k(spark, corpus):
    _, index, _ = corpus

    def ranked(k):
        batch = postings.phrases(index, spark.createDataFrame([(1, "alpha", k, None, 0)], ASKED), ("segment",))
        postings.narrow(index, batch)
        return postings.found(index, batch, spark).count(), batch[0]

    few, phrase = ranked(1)
    all_, wide = ranked(40)  # deeper than there are blocks
    assert phrase.df == wide.df == all_ and wide.blocks is None
    assert few < 0.8 * all_ and 50 <= len(phrase.blocks) < 100


def test_every_third_trigram_covers_a_phrase():
    for n in range(3, 30):
        run = "".join(chr(97 + i % 26) for i in range(n))
        places = postings._covering(run)
        assert {i + j for i, _ in places for j in range(3)} == set(range(n)) and all(run[i : i + 3] == t for i, t in places)
    assert postings._covering("ab") == [] and len(postings._covering("a" * 30)) == 10


def test_layout_grows_with_the_corpus(spark):
    sizes = [postings.Layout.of(n) for n in (0, 1000, 10**6, 10**8, 10**10)]
    files = [x.buckets * x.blocks for x in sizes]
    assert files[0] == files[1] == 64 and files[2] >= 400 and files[3] >= 40_000 and files == sorted(files)
    assert all(n / f <= postings.CHUNKS_PER_FILE for n, f in zip((10**6, 10**8, 10**10), files[2:], strict=True))
    terms = ["alpha", "記憶", "x", "", "of ", "é😀"]
    df = spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(512)).cast("int"))
    assert [r[0] for r in df.collect()] == [postings.Layout(512, 4).bucket(t) for t in terms] and xxhash.xxh64_intdigest(b"", 42) % 512 == postings.Layout(512, 4).bucket("")


def test_writing_uses_a_task_for_each_bucket_and_block(spark, corpus):
    _, _, df = corpus
    grown = postings.Layout(32, 8)
    spread = postings.postings(df, "segment").withColumn("bucket", F.lit(0))
    assert spread.columns[:2] == ["term", "chunk_id"] and grown.buckets * grown.blocks > 64


def test_many_terms_are_joined_instead_of_named(spark, corpus, monkeypatch):
    _, index, _ = corpus
    asked = spark.createDataFrame(QUERIES, ASKED)
    told = lambda: sorted(map(tuple, retrieval.lexical_channels(index, asked).collect()))
    named = told()
    monkeypatch.setattr(postings, "MOST_NAMED", 1)
    batch = postings.phrases(index, asked, postings.LEXICAL)
    plan = postings.found(index, batch, spark)._jdf.queryExecution().optimizedPlan().toString()
    assert told() == named and "missing" not in plan


def test_a_batch_takes_few_jobs(spark, corpus):
    """One job looks at the queries, two read summaries, the statistics are read once; the rest is one plan."""
    _, index, _ = corpus
    index.corpus  # noqa: B018
    asked = spark.sql("SELECT * FROM VALUES (1, 'of the', 5, CAST(NULL AS STRING), 0), (2, 'delta', 5, NULL, 0) AS t(qid, text, k, project, variant)")
    spark.sparkContext.setJobGroup("planning", "planning")
    hits = retrieval.search(index, asked, channels=("trigram", "segment"))
    planning = len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))
    spark.sparkContext.setJobGroup("running", "running")
    assert hits.count() == 10
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert planning <= 2


def test_hot_terms_of_a_phrase_are_read_once_for_counts_and_ranks(spark, corpus):
    _, index, _ = corpus
    hits = retrieval.lexical_channels(index, spark.createDataFrame([(1, "of the", 5, None, 0)], ASKED), ("segment",))
    hits.collect()
    final = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet") <= 2


def test_vectors_of_ties_scopes_and_dimensions(spark):
    rows = [(i, f"p{i % 2}", [float(i % 5), 1.0]) for i in range(400)] + [(900, "p0", [1.0, 2.0, 3.0]), (901, "p1", None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, project string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(1, 2, None, 0, [1.0, 0.0]), (2, 3, "p1", 0, [1.0, 0.0]), (3, 1, None, 0, [0.0, 0.0, 1.0]), (4, 1, "p9", 0, [1.0, 1.0])], "qid int, k int, project string, variant int, embedding array<float>")
    got = {}
    for r in retrieval.vector_channel(vectors, asked).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["chunk_id"])
    best = sorted(range(400), key=lambda i: (-(i % 5), i))
    assert got == {1: best[:50], 2: [i for i in best if i % 2][:50], 3: [900]}


def test_building_shuffles_texts_not_postings(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "p0", "".join(rng.choices("abcdefghij   ", k=1500))) for i in range(400)]
    df = spark.createDataFrame(rows, "chunk_id long, project string, text string")
    df.write.parquet(str(tmp_path / "texts"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = shuffled()
    layout = postings.Layout(16, 2)
    postings.write_postings(spark.read.parquet(str(tmp_path / "texts")), str(tmp_path / "trigram"), "trigram", layout)
    assert 0 < shuffled() - before < 2 * sum(len(t) for _, _, t in rows)
    told = spark.read.parquet(str(tmp_path / "trigram"))
    assert told.select(F.sum("tf"), F.sum(F.size("positions"))).first()[:] == (400 * 1498,) * 2
    assert {r["n"] for r in told.groupBy(F.input_file_name()).agg(F.count_distinct("block").alias("n")).collect()} == {1}


@pytest.mark.parametrize("channel", postings.LEXICAL)
def test_postings_come_in_sorted_runs_of_bounded_size(spark, monkeypatch, channel):
    monkeypatch.setattr(postings, "OCCURRENCES", 300)
    rng = random.Random(6)
    texts = {i: "".join(rng.choices("abé😀記 ", k=rng.choice([0, 2, 3, 90, 700]))) for i in range(60)}
    df = spark.createDataFrame([(i, None, t) for i, t in texts.items()], "chunk_id long, project string, text string").coalesce(1)
    layout, runs = postings.Layout(4, 1), [[]]
    for r in postings.postings(df, channel, layout=layout).collect():
        key = (r["bucket"], r["term"].encode(), r["chunk_id"])
        if runs[-1] and key < runs[-1][-1][0]:
            runs.append([])
        runs[-1].append((key, r))
    assert len(runs) > 10 and all(sum(r["tf"] for _, r in run) <= 300 or len({r["chunk_id"] for _, r in run}) == 1 for run in runs)
    got = {(r["term"], r["chunk_id"]): r["positions"] for run in runs for _, r in run}
    want = {}
    split = lambda t: [t[i : i + 3] for i in range(len(t) - 2)] if channel == "trigram" else re.findall("[ab\u00e9]+|\u8a18", t)
    for i, t in texts.items():
        for at, term in enumerate(split(t)):
            want.setdefault((term, i), []).append(at)
    assert got == want and all(k[0] == layout.bucket(r["term"]) and r["tf"] == len(r["positions"]) and r["dl"] == len(split(texts[r["chunk_id"]])) for run in runs for k, r in run)


@pytest.fixture
def moved(spark):
    """Bytes shuffled since the last call."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    at = [total()]

    def since() -> int:
        before, at[0] = at[0], total()
        return at[0] - before

    return since


def test_an_index_shuffles_its_texts_once_for_all_channels(spark, tmp_path, moved):
    rng = random.Random(7)
    rows = [(i, "p0", " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(200))) for i in range(500)]  # hardly a word twice
    spark.createDataFrame(rows, "chunk_id long, project string, text string").repartition(2).write.parquet(str(tmp_path / "texts"))
    size, texts = sum(len(t) for _, _, t in rows), spark.read.parquet(str(tmp_path / "texts"))
    moved()
    postings.write_channels(texts, str(tmp_path / "index"), postings.LEXICAL, postings.Layout(16, 2))
    assert 0 < moved() < 1.2 * size
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    for channel in postings.LEXICAL:
        postings.write_postings(texts, str(tmp_path / channel), channel, postings.Layout(16, 2))
        own, told = spark.read.parquet(str(tmp_path / channel)), spark.read.parquet(f"{tmp_path}/index/channel={channel}")
        assert own.columns == told.columns and own.exceptAll(told).isEmpty() and own.count() == told.count()
    moved()
    assert postings.summarise(spark.read.parquet(str(tmp_path / "segment")), 1024).isEmpty() and moved() < 1.5 * size


@pytest.mark.parametrize("most", [500_000, 2])
def test_summaries_are_of_frequent_terms(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(postings, "MOST_SUMMARISED", most)
    _, index, _ = corpus
    rows, want = index.tables["segment"].select("term", "block", "tf", "dl").collect(), {}
    for r in rows:
        n, tf, lo, hi = want.get((r["term"], r["block"]), (0, 0, 1 << 30, 0))
        want[r["term"], r["block"]] = (n + 1, max(tf, r["tf"]), min(lo, r["dl"]), max(hi, r["dl"]))
    held = {t: sum(v[0] for (x, _), v in want.items() if x == t) for t, _ in want}
    kept = sorted((t for t in held if held[t] >= 1500), key=lambda t: -held[t])[:most]
    got = {(r["term"], r["block"]): (r["n"], r["most"], r["shortest"], r["longest"]) for r in postings.summarise(index.tables["segment"], 1500).collect()}
    assert got == {k: v for k, v in want.items() if k[0] in kept} and 2 <= len(kept) < len(held)


def test_an_index_has_the_channels_that_are_asked(spark, sf):
    from lorekeep.plans import catalog

    before = dict(catalog._indexes)
    catalog._indexes.clear()
    try:
        index = catalog.search_index(spark, sf, ("segment",))
        segment = index.tables["segment"]
        assert set(index.tables) == set(index.summaries) == {"segment"}
        assert catalog.search_index(spark, sf) is index and set(index.tables) == set(index.summaries) == set(postings.LEXICAL)
        assert index.tables["segment"] is segment and len(catalog._indexes) == 1
        hits = retrieval.search(index, catalog.asked(spark), channels=postings.LEXICAL)
        whole = postings.build_index(catalog.chunks(spark, sf), catalog.scratch_folder(spark) + "/whole")
        assert sorted(map(str, hits.collect())) == sorted(map(str, retrieval.search(whole, catalog.asked(spark), channels=postings.LEXICAL).collect()))
    finally:
        catalog._indexes.clear()
        catalog._indexes.update(before)
