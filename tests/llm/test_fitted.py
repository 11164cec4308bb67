"""Quality, language and toxicity: held-out accuracy, exactness of the search, odd cases; the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import fitting, language, quality, registry, toxicity
from lorekeep.llm.common import read_table

SF = "/root/testdata/sf0.01"


def auc(y, s):
    s0, s1 = s[y == 0], s[y == 1]
    return (s1[:, None] > s0).mean() + 0.5 * (s1[:, None] == s0).mean()


def held_out(spark, query, label):
    got = query(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    return got[label].to_numpy(), got["score"].to_numpy(), got["predicted"].to_numpy()


def test_quality_held_out(spark):
    y, s, p = held_out(spark, quality.op1_quality, "quality")
    assert auc(y, s) > 0.97 and (p == y).mean() > 0.93


def test_toxicity_held_out(spark):
    y, s, p = held_out(spark, toxicity.op9_toxicity, "toxic")
    assert auc(y, s) > 0.9 and (p == y).mean() > 0.9


def test_language_held_out(spark):
    got = language.op2_language(spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_cases_of_fitted_operators(spark, make, odd_rows):
    docs = make(odd_rows)
    some = _labels(spark, [(4, 1, 0), (6, 0, 1), (9, 1, 1), (10, 0, 0), (777, 1, 1), (None, 1, 1), (2, None, None), (4, 1, 0)])
    for labels in (some, some.where("false")):
        for scored in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
            rows = scored.collect()
            assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
        assert quality.score_quality(make([]), labels).count() == 0 and toxicity.score_toxicity(make([]), labels).count() == 0
    kept = quality.keep_good(docs, some)
    assert kept.columns == docs.columns


def test_language_odd_cases(spark, make, odd_rows):
    docs = make(odd_rows)
    nothing = language.identify(docs, language.fit(docs.where("false")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("x", None), ("1 2", "de")] * 4)], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["text"]): r for r in language.identify(docs, language.fit(train)).collect()}
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not any(c.isalpha() for c in t or "")) for (_, t), r in got.items())
    assert language.identify(make([(1, "und der Hund")]), language.fit(train)).first()["lang_pred"] == "de"


def test_kernel_features_are_the_kernel():
    texts = ["the cat sat", "der Hund lief", "el perro corre", "a dog"]

    def grams(t):
        t = " " + t.lower() + " "
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    k = np.array([[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in texts] for a in texts])
    rows = [language.ngrams(t) for t in texts]
    m = language.Model.over([], rows)
    assert np.allclose(m.kernel(rows), k)
    z = m.features(rows)
    assert np.allclose(z @ z.T, k, atol=1e-4)  # with all texts as landmarks, Nyström is exact


def test_rare_languages_and_long_texts(spark):
    """Three rows of 6,000 are of a rare language; long texts of different languages don't look alike."""
    say = {"en": "the cat and the dog ran home ", "de": "der Hund und die Katze liefen heim ", "eo": "la hundo kaj la kato kuris hejmen "}
    rows = [(i, say["eo" if i in (17, 2500, 5555) else "en" if i % 2 else "de"] + str(i), "eo" if i in (17, 2500, 5555) else "en" if i % 2 else "de") for i in range(6000)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "eo"]
    for lang, text in say.items():
        assert model.predict([text * 20000])[0] == [lang]


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    m = quality.Model(np.zeros(32), np.ones(32))
    x = rng.normal(0, 1, (40, 32))
    z = m.basis(x)
    want = np.exp(-((x[:, None] - x) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - want).mean() < 0.06


def test_normal_equations_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "features array<double>, y double")
    ztz, zty = fitting.normal_equations(rows, lambda a: a, 3, ["y"])
    z = np.column_stack([x, np.ones(200)])
    assert np.allclose(ztz, z.T @ z) and np.allclose(zty[:, 0], z.T @ y)


def test_isotonic_rises():
    x, p = fitting.isotonic(np.array([3.0, 1, 2, 4]), np.array([1.0, 0, 1, 0]), np.ones(4))
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] < p[-1] < 1


def test_block_max_search_is_exact(spark):
    index = toxicity.fit(read_table(spark, SF, "documents").select("doc_id", "text"), quality.learnable_labels(read_table(spark, SF, "labels"), "toxic"))
    texts = [r["text"] for r in read_table(spark, SF, "documents").orderBy("doc_id").limit(300).collect()] + ["", "zzzz"]
    full = np.concatenate([index.cosines(texts[at : at + 64], prune=False) for at in range(0, len(texts), 64)])
    assert index.matrix.shape[1] and len(index.list_who)  # both kinds of terms are there
    for (best, cos), every in zip(index.nearest(texts), full, strict=True):
        want = np.argsort(-every, kind="stable")[: toxicity.NEAREST]
        want = want[every[want] > 0]
        assert np.allclose(cos, every[want], atol=1e-5) and np.allclose(every[best], every[want], atol=1e-5)


def test_neighbours_are_those_of_all_terms(spark):
    """Against cosines over every term of the texts, weighed as the index does; no text with words lacks neighbours."""
    rows = [(i, f"common shared{'abc'[i % 3]} texttext{chr(97 + i % 26)} {'vile' if i % 4 == 0 else 'mild'} own{chr(97 + i // 3)} own{chr(97 + i // 3)}", int(i % 4 == 0)) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], float(r[2])) for r in rows], "label_id long, label double")
    index = toxicity.fit(docs, labels)
    text = {i: t for i, t, _ in rows}
    number = {t: k for k, t in enumerate(index.words)}
    assert all(t in number for i in index.ids for w in toxicity._WORD.findall(text[i].lower()) for t in toxicity.word_terms(w))

    def vector(t):
        counts = {}
        for w in toxicity._WORD.findall(t.lower()):
            for x in toxicity.word_terms(w):
                counts[x] = counts.get(x, 0) + 1
        v = {x: (1 + np.log(n)) * index.idf[number.get(x, -1)] for x, n in counts.items()}
        length = np.sqrt(sum(y * y for y in v.values()))
        return {x: y / length for x, y in v.items()}

    whole = {i: vector(text[i]) for i in index.ids}
    for t in [*text.values(), "text shared strange words", "common owned texttext", "unheard"]:
        v = vector(t)
        want = sorted((sum(y * whole[i].get(x, 0) for x, y in v.items()) for i in index.ids), reverse=True)[: toxicity.NEAREST]
        got = index.raw([t])[0][2]
        assert np.allclose(got, [c for c in want if c > 1e-9], atol=1e-5) and (len(got) > 0) == (t != "unheard")


def test_toxicity_scores_are_those_of_a_plain_search(spark):
    """Weights of terms, neighbours, votes and calibration worked out by loops over every term and every example."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}word"[: 4 + k % 5] + b for k, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in "klmnopq")]
    rows = []
    for i in range(150):
        said = list(rng.choice(vocabulary, int(rng.integers(6, 25))))
        bad = i % 3 == 0
        rows.append((i, " ".join(said + (["vileness"] * int(rng.integers(1, 4)) if bad else ["mildness"] * int(rng.integers(0, 3)))), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    part = {r["doc_id"]: r["part"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(8)).alias("part")).collect()}
    labels = spark.createDataFrame([(r[0], float(r[2])) for r in rows], "label_id long, label double")
    index = toxicity.fit(docs, labels)

    def counts(text):
        out = {}
        for w in text.split():
            for t in {w, *((w[:5] + "-", "-" + w[-5:]) if len(w) > 5 else ())}:
                out[t] = out.get(t, 0) + 1
        return out

    learned = [r for r in rows if part[r[0]] > 0]
    total, n1 = len(learned), sum(r[2] for r in learned)
    assert sorted(index.ids.tolist()) == [r[0] for r in learned]

    def weight(term):
        a, b = (sum(term in counts(t) for _, t, y in learned if y == k) for k in (1, 0))
        n0 = total - n1
        phi = abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(n1 * n0 * max(a + b, 1) * (total - a - b + 0.5)) if a + b else 0.0
        return np.log((total + 1) / max(a + b, 1)) * (toxicity.BASE + phi)

    weights = {t: weight(t) for t in {t for _, text, _ in rows for t in counts(text)}}

    def vector(text):
        v = {t: (1 + np.log(n)) * weights[t] for t, n in counts(text).items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    examples = [(vector(t), y) for _, t, y in learned]

    def raw(text):
        v = vector(text)
        near = sorted(((sum(x * e.get(t, 0.0) for t, x in v.items()), y) for e, y in examples), key=lambda g: -g[0])[: toxicity.NEAREST]
        votes = [(n1 / total / n1 if y else (total - n1) / total / (total - n1)) / (1.05 - min(c, 1.0)) for c, y in near]
        return sum(w * y for w, (_, y) in zip(votes, near, strict=True)) / sum(votes) * np.mean([c for c, _ in near])

    tested = sorted((raw(t), y) for i, t, y in rows if part[i] == 0)
    bins = {}
    for s, y in tested:
        bins.setdefault(int(np.floor(s * (2000 / 3))), []).append((s, y))
    x, p = fitting.isotonic(*(np.array(c) for c in zip(*((np.mean([s for s, _ in g]), np.mean([y for _, y in g]), float(len(g))) for g in bins.values()), strict=True)))
    assert np.allclose(index.points[0], x, atol=1e-4) and np.allclose(index.points[1], p, atol=1e-6)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_with(docs, index).collect()}
    want = fitting.calibrated(np.array([raw(t) for _, t, _ in rows]), (x, p))
    assert np.allclose([got[i] for i, _, _ in rows], want, atol=5e-3)


def test_a_term_repeated_beyond_sixteen_bits_keeps_its_count(spark):
    rows = [(i, ("spam " * 70_000 if i % 10 == 0 else "spam eggs ") + f"own{chr(97 + i % 26)}{chr(97 + i // 26)}", int(i % 2 == 0)) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], float(r[2])) for r in rows], "label_id long, label double")
    index = toxicity.fit(docs, labels)
    assert any(i % 10 == 0 for i in index.ids) and index.tf.max() == 70_000


def test_languages_of_the_held_out_and_names_are_never_inputs(spark, sf, tmp_path):
    """Held-out languages and all sources changed, ids permuted among the held-out rows: no prediction moves."""
    from lorekeep.llm.common import fold

    docs = read_table(spark, sf, "documents")
    out = fold(F.col("doc_id"), 5) == 0
    held = [r["doc_id"] for r in docs.where(out).select("doc_id").orderBy("doc_id").collect()]
    back = dict(zip(held, held[1:] + held[:1]))
    moved = spark.createDataFrame(list(back.items()), "doc_id long, new_id long")
    lang = F.when(out, F.when(F.col("lang") == "de", "en").otherwise("de")).otherwise(F.col("lang"))
    other = docs.withColumn("lang", lang).withColumn("source", F.lit("x")).join(moved, "doc_id", "left").withColumn("doc_id", F.coalesce("new_id", "doc_id")).drop("new_id")
    other.write.parquet(f"{tmp_path}/documents.parquet")
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.op2_language(spark, at).collect()} for at in (sf, str(tmp_path)))
    assert len(a) == len(b) and len(held) > 10
    assert all(a[i][0] == b[back.get(i, i)][0] and abs(a[i][1] - b[back.get(i, i)][1]) < 1e-6 for i in a)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_labels_of_the_held_out_and_names_are_never_inputs(spark, score):
    """Held-out labels turned around, other columns changed, and ids permuted among rows of the held-out fold: no score moves."""
    from lorekeep.llm.common import fold

    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    out = fold(F.col("doc_id"), 4) == 2
    turned = labels.select("doc_id", *[F.when(out, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    other = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit("x").alias("source"), F.lit(0).alias("n_chars"))
    held = [r["doc_id"] for r in docs.where(out).select("doc_id").orderBy("doc_id").collect()]
    moved = spark.createDataFrame(list(zip(held, held[1:] + held[:1])), "doc_id long, new_id long")
    renamed = other.join(moved, "doc_id", "left").withColumn("doc_id", F.coalesce("new_id", "doc_id")).drop("new_id")
    a = {r["doc_id"]: r["score"] for r in score(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in score(other, turned).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)
    c = {r["doc_id"]: r["score"] for r in score(renamed, turned).collect()}
    back = dict(zip(held, held[1:] + held[:1]))
    assert all(abs(a[i] - c[back.get(i, i)]) < 1e-6 for i in a)


def test_pipeline_stages(spark):
    docs = read_table(spark, SF, "documents")
    at, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == columns, name
        n, m = at.count(), after.count()
        assert 0 < m <= n
        at = corpus_pipeline.materialise(after)
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() == at.count() == corpus_pipeline.run(spark, SF).count()


def test_registry_names():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))


if __name__ == "__main__":
    pytest.main([__file__])
