"""License scans: ordered signature rules, all in the document's own row, with built-in functions alone.

A text becomes its words, joined by single spaces. Words of a short keyword list decide which rules are tried at all;
the regular expressions of those rules run over the joined words and put marks around their matches, whose places in
words are those of the marks. Detections that lie inside a better one (of a better priority, or of the same and longer)
are suppressed, in one walk over the detections by place. There is no join, shuffle, group or broadcast table: the rules
are one constant, and a row's cost depends on its text alone, about in proportion to its length. Texts without a keyword
(nearly all) cost the word split and the look-up of their words.

Rules (``license_rules``): tags that machines read (priority 1), grants and addresses (2), sentences of the licenses
themselves (3), and names and general notices (4).

Besides, base phrases are counted at all places where their words stand consecutively; their labels always stay.

Defined cases: null and empty texts have no words, no labels and score 0; equal rows each get their row; ties between
detections of one interval go to the rule that stands first; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import ascii_words, read_table
from lorekeep.llm.license_rules import rules

BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_RULE_TYPE = "array<struct<rule:int,label:string,keys:array<string>,regex:string,priority:int,weight:double>>"

#: Around a match; no word holds a control character.
BEGIN, END = "\x01", "\x02"
PIECE = 256
_FOUND_TYPE = "array<struct<lo:int,hi:int,rule:int,label:string,priority:int,weight:double>>"


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Word positions (from 0) at which the phrase's words stand consecutively."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.when(joined.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _detections(joined: Column, rule: Column) -> Column:
    """A rule's matches as structs with their word interval [lo, hi): marks around each match stand on its first and
    last word, and no word can hold them itself."""
    marked = F.split(F.regexp_replace(joined, rule["regex"], F.lit(BEGIN + "$0" + END)), " ")
    at = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i - 1)), lambda i: i.isNotNull())
    begins, ends = at(lambda w: F.startswith(w, F.lit(BEGIN))), at(lambda w: F.endswith(w, F.lit(END)))

    def found(lo: Column, last: Column) -> Column:
        return F.struct(lo.alias("lo"), (last + 1).alias("hi"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight"))

    return F.when(F.rlike(joined, rule["regex"]), F.zip_with(begins, ends, found)).otherwise(F.from_json(F.lit("[]"), _FOUND_TYPE))


def _unsuppressed(found: Column) -> Column:
    """The detections that no better one contains, by place.

    In the order (lo, longest, priority, rule) whatever contains a detection stands before it. So a walk that knows how far
    detections of each priority have reached tells: it is suppressed if one of its own or a better priority reached its
    end. The walk goes by pieces of ``PIECE`` detections, so that what it gathers is not copied over and over.
    """
    entry = lambda d: F.struct(d["lo"].alias("lo"), (-d["hi"]).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d.alias("d"))
    placed = F.array_sort(F.transform(found, entry))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(placed) - 1) / PIECE)).cast("int")), lambda k: F.slice(placed, k * PIECE + 1, F.lit(PIECE)))
    levels = [1, 2, 3, 4]

    def step(state: Column, x: Column) -> Column:
        reached = F.lit(-1)
        for p in levels:
            reached = F.greatest(reached, F.when(x["priority"] >= p, state[f"to{p}"]).otherwise(F.lit(-1)))
        inside = reached >= -x["end"]
        kept = F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(x["d"])))
        return F.struct(*[F.when(x["priority"] == p, F.greatest(state[f"to{p}"], -x["end"])).otherwise(state[f"to{p}"]).alias(f"to{p}") for p in levels], kept.alias("kept"))

    none = F.from_json(F.lit("[]"), _FOUND_TYPE)
    start = F.struct(*[F.lit(-1).alias(f"to{p}") for p in levels], F.from_json(F.lit("[]"), f"array<{_FOUND_TYPE}>").alias("pieces"))

    def whole(state: Column, piece: Column) -> Column:
        begin = F.struct(*[state[f"to{p}"].alias(f"to{p}") for p in levels], none.alias("kept"))
        done = F.aggregate(piece, begin, step)
        return F.struct(*[done[f"to{p}"].alias(f"to{p}") for p in levels], F.concat(state["pieces"], F.array(done["kept"])).alias("pieces"))

    return F.aggregate(pieces, start, whole, lambda s: F.flatten(s["pieces"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, base_places (array), base_labels (array), detections (lo, hi, rule,
    label, priority, weight of those that are not suppressed), labels (array), score."""
    every = rules()
    keys = sorted({k for r in every for k in r["keys"]})
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_words(F.col(text_col)).alias("words"))
    rows = rows.select(
        "doc_id", "words", F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" ")).alias("joined"),
        F.array_intersect("words", F.array(*map(F.lit, keys))).alias("keys"),
    )
    words, joined, found_keys = F.col("words"), F.col("joined"), F.col("keys")
    table = F.from_json(F.lit(json.dumps(every)), _RULE_TYPE)
    tried = F.filter(table, lambda r: F.arrays_overlap(r["keys"], found_keys))
    found = F.when(F.size(found_keys) > 0, F.flatten(F.transform(tried, lambda r: _detections(joined, r)))).otherwise(F.from_json(F.lit("[]"), _FOUND_TYPE))
    rows = rows.select(
        "doc_id", F.size(words).cast("long").alias("n_words"), found.alias("all"), *[_places(words, joined, p).alias(f"base{k}") for k, (p, _) in enumerate(BASE_PHRASES)]
    )
    base = [F.col(f"base{k}") for k in range(len(BASE_PHRASES))]
    base_labels = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, (_, label) in zip(base, BASE_PHRASES, strict=True)]))
    rows = rows.select(
        "doc_id", "n_words", F.concat(*base).alias("base_places"), F.array_sort(base_labels).alias("base_labels"),
        F.when(F.size("all") > 1, _unsuppressed(F.col("all"))).otherwise(F.col("all")).alias("detections"),
    )
    weight = F.coalesce(F.array_max(F.col("detections.weight")), F.lit(0.0))
    return rows.select(
        "*", F.array_sort(F.array_distinct(F.concat(F.col("base_labels"), F.col("detections.label")))).alias("labels"),
        F.greatest(weight, F.when(F.size("base_labels") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark, sf_dir):
    return scan_licenses(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _oracle() -> str:
    """The whole query as SQL. Its regular expressions have no look-around: each word has a space of its own on both sides,
    so that a match takes its words' spaces and leaves the neighbours theirs."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    array = lambda xs: f"[{', '.join(map(text, xs))}]"
    wide = lambda r: r["regex"].removeprefix("(?<= )").removesuffix("(?= )").replace("[^ ]", "\0").replace(" ", "(?:  )").replace("\0", "[^ ]")
    every = rules()
    table = ",\n    ".join(f"({r['rule']}, {text(r['label'])}, {array(r['keys'])}, {text(' (' + wide(r) + ') ')}, {r['priority']}, {r['weight']}::DOUBLE)" for r in every)
    keys = array(sorted({k for r in every for k in r["keys"]}))
    place = lambda p: "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(), 1)) + ")"
    places = [f"base{k}" for k in range(len(BASE_PHRASES))]
    named = ", ".join(f"CASE WHEN len({b}) > 0 THEN '{label}' END" for b, (_, label) in zip(places, BASE_PHRASES, strict=True))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
b AS (SELECT doc_id, row, w, {", ".join(f"{place(p)} AS {b}" for b, (p, _) in zip(places, BASE_PHRASES, strict=True))} FROM d),
c AS (SELECT *, {" || ".join(places)} AS places, list_filter([{named}], lambda x: x IS NOT NULL) AS base FROM b),
r(rule, label, keys, regex, priority, weight) AS (VALUES
    {table}),
k AS (SELECT row, list_intersect(w, {keys}) AS found, ' ' || array_to_string(w, '  ') || ' ' AS joined FROM d),
m AS (SELECT row, rule, label, priority, weight, list_filter(string_split(regexp_replace(joined, regex, ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), ' '), lambda x: x <> '') AS marked
    FROM k JOIN r ON list_has_any(k.found, r.keys) WHERE len(k.found) > 0),
p AS (SELECT row, rule, label, priority, weight, list_filter(range(0, len(marked)), lambda i: starts_with(marked[i + 1], chr(1))) AS los, list_filter(range(0, len(marked)), lambda i: ends_with(marked[i + 1], chr(2))) AS lasts FROM m),
f AS (SELECT row, rule, label, priority, weight, unnest(los) AS lo, unnest(lasts) + 1 AS hi FROM p),
s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.row = f.row AND o.lo <= f.lo AND o.hi >= f.hi
    AND (o.priority < f.priority OR o.priority = f.priority AND (o.hi - o.lo > f.hi - f.lo OR o.hi - o.lo = f.hi - f.lo AND o.rule < f.rule)))),
l AS (SELECT row, list(DISTINCT label) AS own, max(weight) AS weight FROM s GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ',') AS labels, greatest(coalesce(weight, 0.0), CASE WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM c LEFT JOIN l USING (row)
"""


ORACLE_SQL = _oracle()
