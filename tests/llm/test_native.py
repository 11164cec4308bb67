"""Exact dedup, decontamination and license scans against brute force, with the odd cases of each."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import decontamination, exact_dedup, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_exact_marks(make, odd_rows):
    got = sorted(map(tuple, exact_dedup.mark_duplicates(make(odd_rows)).collect()), key=str)
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_rows]
    assert got == sorted(expected, key=str)


def test_exact_drop_keeps_columns_and_one_of_each(make, odd_rows):
    docs = make(odd_rows)
    got = exact_dedup.drop_duplicates_exact(docs)
    assert got.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert len(rows) == len({t or "" for _, t in odd_rows}) and (5, "same text here again") in rows and (7, odd_rows[6][1]) in rows and (2, "") in rows
    assert exact_dedup.drop_duplicates_exact(make([])).count() == 0 and exact_dedup.mark_duplicates(make([])).count() == 0


def test_filter_never_clears_a_repeat_even_when_full(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", 64)
    monkeypatch.setattr(exact_dedup, "MOST_BLOCKS", 1)  # a filter of 64 bits for 300 repeated texts
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    got = {r["doc_id"]: r for r in exact_dedup.mark_duplicates(make(rows)).collect()}
    assert all(got[i]["keep_id"] == (i + 700 if i + 700 < 1000 else i) for i in range(1000))
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates_exact(make(rows)).collect()) == list(range(300, 1000))


def test_only_candidates_and_few_losers_travel(make):
    """One text in a third of all rows: whole rows that are shuffled are those that stay."""
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i} of its own") for i in range(900)]
    docs = make(rows)
    flagged = exact_dedup.probe(docs, exact_dedup.repeated_hashes(docs), exact_dedup._text_hash("text"), "c")
    assert 300 <= flagged.where("c").count() <= 310
    got = exact_dedup.drop_duplicates_exact(docs)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted([i for i, _ in rows if i % 3] + [897])


def cells(frame):
    """Rows as text, so that a column of numbers with nulls reads the same from both engines."""
    one = lambda x: "null" if pd.isna(x) else f"{float(x):.8f}" if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(one, row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("query,sql", [(exact_dedup.op5_exact_dedup, exact_dedup.ORACLE_SQL), (decontamination.op8_decontamination, decontamination.ORACLE_SQL), (licenses.op4_license_scan, licenses.ORACLE_SQL)])
def test_equals_its_sql(spark, sf, duck, query, sql):
    got, want = query(spark, sf).toPandas(), duck.execute(sql).fetchdf()
    assert sorted(want.columns) == sorted(got.columns) and cells(got) == cells(want)


def test_license_scan_of_chained_phrases_equals_its_sql(spark, make, tmp_path):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice(PHRASES) for _ in range(rng.randrange(1, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, "été MIT License ñ"), (103, "license: MIT\nauthor: someone")]
    make(docs).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = licenses.op4_license_scan(spark, str(tmp_path)).toPandas()
    assert cells(got) == cells(con.execute(licenses.ORACLE_SQL).fetchdf()) and got.set_index("doc_id")["labels"][103] == "mit"


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j : j + n]))) is not None:
                    found |= own
                    hit.update(range(j, j + n))
        out.append((i, len(w), len(hit), len(found), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contamination_equals_brute_force(spark, make, odd_rows, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(decontamination, "_cells_for", lambda windows: 4)  # a filter that lets nearly all through
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "delta", "né", "x1"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 5, 6, 12, 13, 14, 30]))) for k in range(25)] + [(98, None), (99, "!!"), (3, say(20))]
    long = [(k, t) for k, t in items if t and len(t.split()) >= 13]
    docs = [(k, say(rng.randrange(60)) + " " + rng.choice(long)[1] + " " + say(rng.randrange(40))) for k in range(40)] + odd_rows
    docs += [(200, " ".join(["the"] * 400)), (201, rng.choice(items[:20])[1]), (202, "-".join(rng.choice(long)[1].split()[:12]))]
    table = spark.createDataFrame(items, "item_id int, text string")
    got = decontamination.find_contamination(make(docs), table)
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute_contamination(docs, items), key=str)


def test_only_matches_and_one_row_a_document_are_shuffled(spark, make):
    """What is let through: of a long clean text next to nothing, of a match its surroundings alone."""
    rng = random.Random(5)
    items = spark.createDataFrame([(k, " ".join(f"b{rng.randrange(10**6)}" for _ in range(40))) for k in range(20)], "item_id int, text string")
    passage = items.first()["text"]
    docs = make([(1, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20000))), (2, " ".join(f"w{rng.randrange(10**6)}" for _ in range(5000)) + " " + passage)])
    windows = decontamination.benchmark_windows(items)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), decontamination.ascii_words(F.col("text")).alias("words"))
    marks = decontamination._fingerprints(decontamination._with_grams(rows.withColumn("n_words", F.size("words"))))
    met = decontamination._let_through(marks, decontamination._filter(windows, 1024), 1024).where("gram <> 0").collect()
    assert marks.count() > 5000 and len([r for r in met if r["doc_id"] == 1]) < 40 and len([r for r in met if r["doc_id"] == 2]) < 40
    assert all(len(r["around"]) <= 20 for r in met)
    got = {r["doc_id"]: r["n_hit"] for r in decontamination.find_contamination(docs, items).collect()}
    assert got == {1: 0, 2: 40}


def test_shared_one_word_items_multiply_nothing(spark, make, monkeypatch):
    """Thousands of items of one word in documents that hold nothing else, with broadcasts off: a row a place, and items once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        items = spark.range(10000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 5 == 4, "no").otherwise("yes").alias("text"))
        docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 2, "a clean text of some words").otherwise(F.repeat(F.lit("yes "), F.lit(100))).alias("text"))
        got = {(r["n_hit"], r["n_items"], r["items_sha256"]): r["n"] for r in decontamination.digest_contamination(docs, items).groupBy("n_hit", "n_items", "items_sha256").agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    own = ",".join(sorted(str(k) for k in range(10000) if k % 5 != 4))
    assert got == {(100, 8000, hashlib.sha256(own.encode()).hexdigest()): 1334, (0, 0, hashlib.sha256(b"").hexdigest()): 666}


def test_windows_that_share_a_fingerprint_are_one_row_a_match(spark, make):
    """Items that share six words and nothing else: a document's place meets its own window, not all of theirs."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, f"{say(7)} which of the following is true {say(7)}") for k in range(300)]
    docs = [(k, f"{say(20)} {items[k][1]} {say(20)}") for k in range(50)]
    table = spark.createDataFrame(items, "item_id int, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.find_contamination(make(docs), table).collect()}
    assert got == {k: [str(k)] for k in range(50)}


def test_contamination_with_empty_sides(spark, make):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id int, text string")
    docs = make([(1, "x " + " ".join(f"W{i}" for i in range(3, 17))), (2, "clean")])
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, items).collect()}
    assert (got[1]["n_hit"], got[1]["n_words"], got[2]["n_hit"]) == (14, 15, 0)
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()] == [2]
    assert decontamination.find_contamination(make([]), items).count() == 0
    assert {r["n_hit"] for r in decontamination.find_contamination(docs, items.where("false")).collect()} == {0}


def brute_base(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSED = [
    (20, "Licensed under CC BY-NC 4.0.\nAll rights reserved. all Rights RESERVED"), (21, "This work is licensed under the GNU General Public License, version 3."),
    (22, "Licensed under the Apache License, Version 2.0 (the License)"), (23, "SPDX-License-Identifier: MIT"), (24, "mit der Lizenz, general public"), (25, "Copyright (c) 2019 Someone"),
    (26, "https://opensource.org/licenses/BSD-3-Clause and the BSD 3-Clause License"), (27, "general public license " * 3000),
]


def test_license_base_counts_and_labels(make, odd_rows):
    docs = LICENSED + odd_rows
    got = licenses.scan_licenses(make(docs)).collect()
    out = [(r["doc_id"], r["n_words"], len(r["base_places"]), min(r["base_places"], default=None), max(r["base_places"], default=None), ",".join(r["base_labels"])) for r in got]
    assert sorted(out, key=str) == sorted([(i, *brute_base(t)) for i, t in docs], key=str)
    labels = {r["doc_id"]: ",".join(r["labels"]) for r in got}
    assert labels[20] == "cc-by,cc-by-nc-4.0,reserved" and labels[21] == "gpl,gpl-3.0" and labels[22] == "apache-2.0" and labels[23] == "mit" and labels[24] == "" and labels[25] == "copyright"
    assert labels[4] == "" and all(0 <= r["score"] <= 1 for r in got) and licenses.scan_licenses(make([])).count() == 0


def test_license_places_and_suppression(make):
    r = licenses.scan_licenses(make([(1, "Text first. Released under the MIT License. More.")])).first()
    assert [(d["lo"], d["hi"], d["label"], d["priority"]) for d in r["detections"]] == [(2, 7, "mit", 2)]  # the title inside the grant is suppressed


def brute_detections(text):
    """All matches of all rules, and of these the ones that no better one contains, by comparing each with each."""
    w = words(text)
    joined = f" {' '.join(w)} "
    found = []
    for r in RULES:
        if set(r["keys"]) & set(w):
            for m in re.finditer(r["regex"], joined):
                lo = joined[: m.start()].count(" ") - 1
                found.append((lo, lo + m[0].count(" ") + 1, r["rule"], r["priority"], r["label"]))
    better = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[3] < d[3] or e[3] == d[3] and (e[1] - e[0] > d[1] - d[0] or e[1] - e[0] == d[1] - d[0] and e[2] < d[2]))
    return sorted(d for d in found if not any(better(e, d) for e in found))


PHRASES = ["Licensed under the MIT License", "GPLv3", "GPLv2 or later", "SPDX-License-Identifier: Apache-2.0", "general public license version 3", "CC BY-SA 4.0", "all rights reserved", "Copyright (c) 2020-2021",
    "https://www.gnu.org/licenses/gpl-3.0.html", "the 3-clause BSD license", "is released into the public domain", "Apache License, Version 2.0, January 2004", "word", "the", "GNU Lesser General Public License v2.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "creativecommons.org/licenses/by/4.0/", "EUPL 1.2"]

RULES = licenses.rules()


def test_license_detections_equal_brute_force(spark, make):
    """Over the driver's documents that hold a keyword, and made-up ones that chain many phrases."""
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(PHRASES) for _ in range(rng.randrange(1, 60)))) for k in range(60)]
    keys = {k for r in RULES for k in r["keys"]}
    docs += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if keys & set(words(r["text"]))][:150]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(make(docs)).collect()}
    for i, t in docs:
        want = brute_detections(t)
        assert sorted((d["lo"], d["hi"], d["rule"], d["priority"], d["label"]) for d in got[i]["detections"]) == want
        assert got[i]["labels"] == sorted({d[4] for d in want} | set(got[i]["base_labels"]))


def test_license_scan_is_quick_on_long_repeats(make):
    import time

    docs = make([(1, "general public license " * 7000), (2, "cc by " * 10000), (3, "MIT License and Apache License, Version 2.0. " * 3000)])
    licenses.scan_licenses(make([(1, "cc by")])).collect()
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got[1]["base_places"]) == 7000 and len(got[3]["detections"]) == 6000 and time.time() - began < 20


@pytest.mark.filterwarnings("ignore")
def test_every_rule_matches_and_its_keywords_let_it():
    """Texts drawn from each rule's own expression: the rule finds them, and they hold one of its keywords."""
    for r in RULES:
        drawn = []
        inside = r["regex"].removeprefix("(?<= )").removesuffix("(?= )").replace("[^ ]", "[a-z0-9]")

        @settings(max_examples=8, deadline=None, database=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(inside, re.A), fullmatch=True))
        def draw(x):
            drawn.append(x.split())  # noqa: B023 called at once

        draw()
        assert drawn and all(re.search(r["regex"], f" {' '.join(w)} ") and set(r["keys"]) & set(w) for w in drawn), r


def test_there_are_hundreds_of_rules():
    rules = RULES
    assert len(rules) >= 300 and len({r["regex"] + r["label"] for r in rules}) == len(rules)
    assert all(re.compile(r["regex"]) and r["keys"] for r in rules)
