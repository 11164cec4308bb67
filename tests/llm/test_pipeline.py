"""The pipeline's stages against brute force over a small fixture with odd rows, and with empty tables."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import quality
from lorekeep.llm.common import materialise
from tests.llm.test_native import brute_contamination
from tests.llm.test_text_operators import brute_components, brute_fingerprint


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "river", "runs", "below", "old", "town", "and", "people", "walk", "there", "every", "morning", "with", "bread"]) + rng.choice(["", "", ",", "."]) + rng.choice(["", f" {rng.choice('abcdefgh') * 3}{rng.randrange(90)}"]) for _ in range(n))


def junk(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["CLICK", "$$$", "###", "1234", "!!!!", "xXxX", "||||"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, make, odd_rows):
    rows = [(100 + i, prose(i, 60 + i)) for i in range(120)] + [(300 + i, junk(i, 60 + i)) for i in range(60)]
    rows += [(420 + i, prose(400 + i, 1200)) for i in range(20)]
    rows += [(500, prose(3, 63)), (501, prose(3, 63)), (502, prose(4, 64)), (503, prose(5, 65) + " end"), (504, prose(200, 30) + " " + prose(999, 40)), (505, prose(999, 40)), (506, prose(201, 1200) + " " + prose(999, 40))]
    to = str(tmp_path_factory.mktemp("tables"))
    make(rows + odd_rows).write.parquet(f"{to}/documents.parquet")
    labels = [(100 + i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(60)] + [(420 + i, 1, 0) for i in range(20)] + [(None, 1, 0), (100, None, None), (9999, 1, 1), (300, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 40)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = materialise(stages["quality"](spark, docs, folder))
    accepted = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert pairs(good) == [p for p in pairs(docs) if p[0] in accepted] and {500, 501, 504, 505, 506} <= accepted and not any(300 <= i < 360 for i in accepted if i)

    unique = materialise(stages["exact_dedup"](spark, good, folder))
    best = {}
    for i, t in pairs(good):
        best[t or ""] = max((x for x in (best.get(t or ""), i) if x is not None), default=None)
    assert pairs(unique.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))) == sorted(((i, t) for t, i in best.items()), key=str)

    far = materialise(stages["near_dedup"](spark, unique, folder))
    own = pairs(unique)
    roots = brute_components([brute_fingerprint(t, 4) for _, t in own])
    least = {}
    for (i, _), r in zip(own, roots, strict=True):
        least[r] = min(x for x in (least.get(r), i) if x is not None)
    assert pairs(far) == [p for p, r in zip(own, roots, strict=True) if p[0] == least[r]]

    clean = materialise(stages["decontamination"](spark, far, folder))
    hit = {i for i, n, h, *_ in brute_contamination(pairs(far), [(1, prose(999, 40)), (2, None), (3, "")]) if h and 20 * h >= n}
    assert pairs(clean) == [p for p in pairs(far) if p[0] not in hit] and {504, 505} <= hit and 506 not in hit

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(ids := own.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(clean)]
    assert sorted(map(tuple, stages["tokens"](spark, clean, folder).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, folder, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        (table.where("false") if name == empty else table.where("doc_id < 140 or doc_id = 300") if name == "documents" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert (n == 0) == (empty == "documents")
