"""Word cutting, script conversion and normal forms: worked examples, and brute force over small alphabets."""

import itertools
import re
import sys
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import embedding, words
from lorekeep.functions import text as fn
from lorekeep.functions.conversion import TO_SIMPLIFIED, TO_TRADITIONAL, Conversion
from lorekeep.functions.words import UNKNOWN, Lexicon, learned, tokens
from lorekeep.operators import postings, retrieval
from lorekeep.plans import catalog

ASKED = "qid int, text string, k int, project string, variant int"
LEXICON = Lexicon.of([("記憶", 50), ("釘選", 40), ("版本", 30), ("選版", 1), ("記", 5), ("本", 5), ("記憶體", 20)])


def every_cut(run):
    for n in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), n):
            yield [run[a:b] for a, b in zip((0, *at), (*at, len(run)), strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="天地人日", max_size=8), st.dictionaries(st.text(alphabet="天地人日", min_size=1, max_size=3), st.integers(1, 50), max_size=8))
def test_cuts_are_the_cheapest_of_all(run, counts):
    lexicon = Lexicon.of(counts.items())
    cost = lambda w: lexicon.costs.get(w, lexicon.unknown if len(w) == 1 else None)
    known = [c for c in every_cut(run) if run and all(cost(w) is not None for w in c)]
    got = lexicon.words(run)
    assert "".join(got) == run
    if run:
        best = min((sum(map(cost, c)), len(c)) for c in known)
        assert (sum(map(cost, got)), len(got)) == best


def test_words_of_a_run_and_unknown_characters():
    assert LEXICON.words("記憶釘選版本") == ["記憶", "釘選", "版本"]
    assert LEXICON.words("記憶體") == ["記憶體"] and LEXICON.words("釘日選") == ["釘", "日", "選"] and LEXICON.words("") == []
    assert LEXICON.unknown - UNKNOWN >= max(LEXICON.costs.values()) - 1000
    assert len(LEXICON.words("記憶釘" * 20000)) == 40000  # long runs take time in proportion
    assert Lexicon.of([]).words("記憶") == ["記", "憶"]


def test_tokens_of_mixed_texts(spark):
    rows = [("Read 記憶釘選 now，記憶體x9",), ("no Han at all_here",), (None,), ("",), ("かな한글",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(tokens(F.col("t"), LEXICON)).collect()]
    assert got == [["read", "記憶", "釘選", "now", "記憶體", "x9"], ["no", "han", "at", "all", "here"], None, [], ["か", "な", "한", "글"]]
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()][0] == ["read", "記", "憶", "釘", "選", "now", "記", "憶", "體", "x9"]


def test_a_lexicon_is_bounded_and_named(spark, monkeypatch):
    monkeypatch.setattr("lorekeep.functions.words.MOST_WORDS", 2)
    with pytest.raises(ValueError):
        Lexicon.of([("一", 1), ("二", 1), ("三", 1)])
    with pytest.raises(ValueError):
        Lexicon.from_table(spark.createDataFrame([("一", 1), ("二", 1), ("三", 1)], "word string, n long"))
    assert Lexicon.of([("一", 1)]).revision == Lexicon.of([("一", 1)]).revision != Lexicon.of([("二", 1)]).revision


def test_two_character_queries_hit_whole_words_only(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "p", "記憶釘選版本"), (2, "p", "選版"), (3, "p", "記憶體"), (4, "p", "釘選 記憶")], "chunk_id long, project string, text string")
    asked = spark.createDataFrame([(1, "記憶", 5, None, 0), (2, "選版", 5, None, 0), (3, "釘選版本", 5, None, 0)], ASKED)
    index = postings.build_index(chunks, str(tmp_path / "w"), LEXICON, postings.Layout(2, 2))
    got = sorted((r["qid"], r["chunk_id"]) for r in postings.matches(index, asked, "segment").collect())
    assert got == [(1, 1), (1, 4), (2, 2), (3, 1)]
    plain = postings.build_index(chunks, str(tmp_path / "c"), layout=postings.Layout(2, 2))
    assert (2, 1) in {(r["qid"], r["chunk_id"]) for r in postings.matches(plain, asked, "segment").collect()}  # as characters, the seam of two words is a hit


def test_workers_get_tokens_as_one_string(spark):
    df = spark.createDataFrame([(1, "記憶釘選 abc・版本x"), (2, None), (3, "plain text"), (4, "・"), (5, "記憶")], "i int, t string").select("i", tokens(F.col("t"), LEXICON).alias("words"))
    assert [r["words"] for r in df.orderBy("i").collect()] == [["記憶", "釘選", "abc", "版本", "x"], None, ["plain", "text"], [], ["記憶"]]
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "ArrowEvalPython":
        node = node.children().head()
    assert node.schema().apply("pythonUDF0").dataType().simpleString() == "string"


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.none() | st.text(alphabet="天地人日𠀀か月 aé", max_size=40), max_size=8),
    st.dictionaries(st.text(alphabet="天地人日𠀀かa", min_size=1, max_size=6), st.integers(1, 50), max_size=10), st.sampled_from([4, 64]), st.sampled_from([4, 1 << 22]),
)
def test_texts_cut_together_are_cut_as_each_alone(texts, counts, short, cells):
    lexicon = Lexicon.of(counts.items())
    with pytest.MonkeyPatch.context() as patch:
        for name, value in (("SHORT", short), ("_CELLS", cells), ("_NEIGHBOURS", cells)):
            patch.setattr(words, name, value)
        got = lexicon.arrays.tokens(pa.array(["before", *texts], pa.string()).slice(1)).to_pylist()
    for text, own in zip(texts, got, strict=True):
        apart = re.sub("[^ aé]+", r" \g<0> ", text or "").split()
        assert own == [w for t in apart for w in (lexicon.words(t) if t[0] not in "aé" else [t])]


def test_equal_pieces_are_cut_once(monkeypatch):
    seen = []
    monkeypatch.setattr(words.Arrays, "starts", lambda self, letters, sizes, of=words.Arrays.starts: seen.append(len(sizes)) or of(self, letters, sizes))
    monkeypatch.setattr(Lexicon, "words", lambda self, run: pytest.fail("one by one"))
    got = LEXICON.arrays.tokens(pa.array(["記憶釘選版本 記憶體日" * 500, None, "釘選記憶" * 500])).to_pylist()
    assert got == [["記憶", "釘選", "版本", "記憶體", "日"] * 500, [], ["釘選", "記憶"] * 500]
    assert seen == [4]  # 記憶, 釘選版本, 記憶體 and 釘選, between which no word stands


def test_texts_are_cut_once_for_an_index(spark, tmp_path, monkeypatch):
    rows = [(1, "p", "記憶釘選 x"), (2, "p", "no Han"), (3, "p", None), (4, "p", ""), (5, "p", "・")]
    chunks, read_as = spark.createDataFrame(rows, "chunk_id long, project string, text string"), lambda text: F.concat(text, F.lit(" 版本"))
    plain = postings.statistics(chunks.select(*postings.lengths(read_as(F.col("text")), LEXICON))).first()
    with monkeypatch.context() as patch:
        patch.setattr(postings, "tokens", lambda *_: pytest.fail("texts are cut for their lengths"))
        index = postings.build_index(chunks, str(tmp_path / "s"), LEXICON, postings.Layout(2, 2), channels=("segment",), read_as=read_as)
    assert index.corpus == {"n": 5, "trigram_avgdl": None, "segment_avgdl": plain["segment_avgdl"]}
    index.add(postings.build_index(chunks, str(tmp_path / "t"), LEXICON, postings.Layout(2, 2), channels=("trigram",), read_as=read_as))
    assert index.corpus == plain.asDict() and set(index.tables) == set(index.summaries) == {"trigram", "segment"}
    asked = spark.createDataFrame([(1, "記憶", 5, None, 0), (2, "版本", 5, None, 0), (3, "憶釘", 5, None, 0)], ASKED)
    assert sorted((r["qid"], r["chunk_id"]) for r in postings.matches(index, asked, "segment").collect()) == [(1, 1), (2, 1), (2, 2), (2, 4), (2, 5)]


def test_what_texts_are_read_as_is_made_after_the_shuffle_alone(spark):
    chunks = spark.createDataFrame([(1, "p", "ab cd"), (2, "p", None)], "chunk_id long, project string, text string")
    rows = postings._in_blocks(postings._spread(chunks, postings.Layout(2, 2)), "segment", postings.Layout(2, 2), LEXICON, catalog.in_han)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("RepartitionById" if "RepartitionById" in plan else "Repartition")
    assert {r["chunk_id"] for r in rows.collect()} == {1}


def test_texts_in_han_and_their_lexicon(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(words, "AT_ONCE", 50)
    rng = __import__("random").Random(5)
    rows = [(i, None if i % 20 == 0 else "".join(rng.choice("abz    é天XY.\n😀") for _ in range(rng.choice([0, 1, 2, 5, 60])))) for i in range(2000)]
    docs = spark.createDataFrame([*rows, (-1, " ab"), (-2, "ab cd ef gh"), (-3, "ab "), (-4, "ab cdé ef gh")], "doc_id long, text string").repartition(3)
    plain = F.translate(F.regexp_replace("text", "([a-z]+) ([a-z]+)", "$1$2"), catalog.LETTERS, catalog.HAN)
    catalog.ship_package(spark)
    assert docs.select("text", catalog.in_han(F.col("text")).alias("told"), plain.alias("plain")).where("not told <=> plain").collect() == []
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "HAN_WORDS", 25)
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))).alias("w")).where(F.length("w").between(2, 4))
    best = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(25)
    assert catalog.han_lexicon(spark, str(tmp_path)) == Lexicon.from_table(best.select(F.translate("w", catalog.LETTERS, catalog.HAN).alias("word"), "n"))


def test_a_lexicon_is_learned_from_counts(spark):
    rng = __import__("random").Random(3)
    words = ["記憶", "釘選", "版本", "天", "地", "人"]
    texts = ["".join(rng.choice(words) for _ in range(30)) for _ in range(120)]
    got = {r["word"]: r["n"] for r in learned(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("latin only",)], "text string"), cohesion=3.0).collect()}
    assert {"記憶", "釘選", "版本"} == {w for w in got if len(w) == 2} and {"天", "地", "人", "記"} <= set(got)
    assert got["記憶"] == sum(t.count("記憶") for t in texts)
    lexicon = Lexicon.of(got.items())
    assert lexicon.words("釘選版本天記憶") == ["釘選", "版本", "天", "記憶"]
    assert learned(spark.createDataFrame([], "text string")).count() == 0


# -- conversion -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("simple,old", [("头发", "頭髮"), ("发现", "發現"), ("理发店", "理髮店"), ("皇后在后面", "皇后在後面"), ("干净的干部干", "乾淨的幹部乾"), ("制造", "製造"), ("制", "制")])
def test_phrases_decide_between_characters(simple, old):
    assert TO_TRADITIONAL.convert(simple) == old and TO_SIMPLIFIED.convert(old) == simple


def test_longest_match_and_uncovered_text():
    own = Conversion.of([("ab", "1"), ("abc", "2"), ("a", "3"), ("bcd", "4"), ("a", "never")])
    assert own.convert("abcd abd xa") == "2d 1d x3" and own.convert("") == "" and own.convert("b") == "b"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=3), st.sampled_from(["x", "yy", ""]), max_size=6))
def test_conversion_equals_an_alternation(text, table):
    pattern = "|".join(sorted(table, key=len, reverse=True))
    assert Conversion.of(table.items()).convert(text) == (re.sub(pattern, lambda m: table[m[0]], text) if pattern else text)


def test_equal_runs_are_converted_once(monkeypatch):
    own, seen = Conversion.of([("ab", "1"), ("b", "2")]), []
    monkeypatch.setattr(Conversion, "_of_run", lambda self, run, of=Conversion._of_run: seen.append(run) or of(self, run))
    assert own.convert("x ab x ab, bab " * 50) == "x 1 x 1, 21 " * 50 and sorted(seen) == ["ab", "bab"]
    long = "ab" * 20
    assert own.convert(f"{long} {long}") == "1" * 20 + " " + "1" * 20 and long not in own.known


def test_conversion_tables_come_from_tables(spark):
    rows = [("发", "髮", 2), ("发", "發", 1), ("头发", "頭髮", 1)]
    own = Conversion.from_table(spark.createDataFrame(rows, "source string, target string, rank int"))
    assert own.convert("头发发") == "頭髮發"


def test_variants_find_what_the_query_alone_does_not(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "p", "她的頭髮很長"), (2, "p", "她的头发很长"), (3, "p", "發現")], "chunk_id long, project string, text string")
    index = postings.build_index(chunks, str(tmp_path), layout=postings.Layout(2, 2))
    asked = retrieval.with_variants(spark.createDataFrame([(1, "头发", 5, None), (2, "latin", 5, None), (3, "", 5, None)], "qid int, text string, k int, project string"))
    assert sorted((r["qid"], r["variant"], r["text"]) for r in asked.collect()) == [(1, 0, "头发"), (1, 1, "頭髮"), (2, 0, "latin")]
    got = {r["chunk_id"]: r["rank"] for r in retrieval.lexical_channel(index, asked, "segment").collect()}
    assert got == {2: 1, 1: 2}  # the query's own hits come first


# -- normal forms -----------------------------------------------------------------------------------------------------


def test_no_character_that_composition_may_change_is_missed(spark):
    alone = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    changed = [c for c in alone if unicodedata.normalize("NFC", c) != c]
    joins = []  # second characters of all compositions
    for c in alone:
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c:
            joins.extend(apart[1:])
    df = spark.createDataFrame([(c,) for c in sorted({*changed, *joins})], "c string")
    assert df.where(~F.col("c").rlike(fn.MAY_COMPOSE)).count() == 0


def test_normal_form(spark):
    rows = [("é  x\n",), ("é x",), (None,), ("",), ("Å",), ("plain  text",), ("한",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(fn.normal_form(F.col("t"))).collect()] == ["é x", "é x", "", "", "Å", "plain text", "한"]


def test_vectors_of_several_texts_are_those_of_each(spark, monkeypatch):
    monkeypatch.setattr(embedding, "MOST_KNOWN", 5)
    texts = ["one two", "", None, "Two  three two", " ", "one two"] + [f"w{i} w{i + 1}" for i in range(300)]
    told = embedding.HashingEmbedder(16).vectors(texts)
    for t, v in zip(texts, told, strict=True):
        alone = embedding.HashingEmbedder(16).vector(t) if t and t.strip() else None
        assert (v is None) == (alone is None) and (v is None or v.tolist() == alone and abs(sum(x * x for x in alone) - 1) < 1e-9)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", embedding.embedded(F.col("t"), embedding.HashingEmbedder(16)).alias("v"))
    got = [r["v"] for r in df.orderBy("i").collect()]
    assert all((g is None) == (v is None) and (v is None or max(abs(a - b) for a, b in zip(g, v, strict=True)) < 1e-6) for g, v in zip(got, told, strict=True))
    assert len({tuple(v) for v in told if v is not None}) == 302  # of word and word, each pair its own
