"""Benchmark decontamination by winnowing.

Every run of 13 words holds eight 6-word grams. On both sides the smallest gram hash of each such window is a
fingerprint, so a run of 13 words that a document shares with a benchmark item gives both the same fingerprint: no
shared span of 13 or more words can be missed. Document fingerprints are joined with those of the benchmark; each
match is then extended to the whole window and compared word by word, so that no hash collision counts.

Items of under 13 words are one window of their own length. Their whole-item hash is joined with the hashes of all
document grams of that length (winnowing can't guarantee spans that short); lengths are at most 12, so at most 12.

A document's fingerprints first meet a filter: two bits in one of at most ``MOST_CELLS`` 64-bit cells for each benchmark
fingerprint. It is broadcast, of bounded size whatever the benchmark's (about 100 MB at most; with more than some ten
million windows only its error rate rises), and met in the row, so fingerprints that the benchmark lacks are never
shuffled. Those let through carry the 20 words around them and nothing else of the text, and extend to each window that
they may belong to: the SHA-256 of its fingerprint, the fingerprint's place and its words names the window, so a match is
one row and no fingerprint that many windows share multiplies rows. Beside them there is one small row for each document.
A passage in a third of all documents is one more small row for each, and stays where it is (``join_split``).

Windows are numbers from there on. Items meet documents last: documents with the same windows share one set, and a set's
items are gathered once, however many documents or items have it. The list of a set's items is one row, as its digest
asks for it.

Defined cases: null or empty texts have no words (n_words 0, not contaminated) and such items no window; repeated
rows each get their row; equal item_ids count as one, a null item_id has the empty name; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import ascii_words, join_split, materialise, read_table

WINDOW = 13
GRAM = 6
#: Cells of 64 bits of the filter at most, each a row of about 50 bytes where it is broadcast.
MOST_CELLS = 1 << 21
PER_WINDOW = WINDOW - GRAM + 1


def _gram_hashes(words: Column) -> tuple[Column, Column]:
    """Hashes of two words and, from column ``pairs``, of six words from each position; the last five mean nothing."""
    pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    return pairs, F.transform("pairs", lambda p, i: F.xxhash64(p, F.get("pairs", i + 2), F.get("pairs", i + 4)))


def _with_grams(df: DataFrame) -> DataFrame:
    pairs, grams = _gram_hashes(F.col("words"))
    return df.withColumn("pairs", pairs).withColumn("grams", grams).drop("pairs")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item and distinct window of it: item, value (its fingerprint), gram (the fingerprint's length in words), at
    (its first word in the window, from 0), len, key (see ``_window_key``)."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), ascii_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = _with_grams(items)
    n = F.size("words")
    of_long = (
        items.where(n >= WINDOW)
        .select("item", "words", "grams", F.explode(F.sequence(F.lit(1), n - (WINDOW - 1))).alias("pos"))
        .select("item", F.slice("words", F.col("pos"), WINDOW).alias("words"), F.slice("grams", F.col("pos"), PER_WINDOW).alias("h"))
        .select("item", F.lit(GRAM).alias("gram"), F.lit(WINDOW).alias("len"), "words", F.array_min("h").alias("value"), (F.array_position("h", F.array_min("h")) - 1).cast("int").alias("at"))
    )
    of_short = items.where(n < WINDOW).select("item", (-n).alias("gram"), n.alias("len"), "words", F.xxhash64("words").alias("value"), F.lit(0).alias("at"))
    key = _window_key(F.col("gram"), F.col("value"), F.col("at"), F.col("words"))
    return of_long.unionByName(of_short).select("item", "gram", "len", "value", "at", key.alias("key")).distinct()


def _window_key(gram: Column, value: Column, at: Column, words: Column) -> Column:
    """Names a window by its fingerprint, the fingerprint's place, and its words."""
    return F.sha2(F.concat_ws(" ", gram, value, at, words), 256)


def _fingerprints(rows: DataFrame) -> DataFrame:
    """A row for each change of the window's leftmost minimum: gram, value, place (the gram's first word, from 1).
    Besides, one row of each document with gram 0, whatever it holds; its place means nothing."""
    pos = F.col("pos")
    windows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words") - (WINDOW - 1)))).alias("pos"))
    grams = windows.select("*", *[F.get("grams", pos + (j - 2)).alias(f"g{j}") for j in range(PER_WINDOW + 1)])
    # g0 is the gram that has just left the window, the last one has just come in
    inner = F.least(*[F.col(f"g{j}") for j in range(1, PER_WINDOW)])
    grams = grams.select("*", inner.alias("inner"))
    last = F.col(f"g{PER_WINDOW}")
    changed = grams.where((pos <= 1) | (F.col("g0") <= F.col("inner")) | (last < F.col("inner")))
    value = F.least(F.col("inner"), last)
    offset = F.lit(PER_WINDOW - 1)
    for j in reversed(range(1, PER_WINDOW)):
        offset = F.when(F.col(f"g{j}") == value, F.lit(j - 1)).otherwise(offset)
    own = pos == 0
    return changed.select(
        *rows.columns,
        F.when(own, F.lit(0)).otherwise(F.lit(GRAM)).alias("gram"),
        F.when(own, F.lit(0).cast("long")).otherwise(value).alias("value"),
        (pos + offset).alias("place"),
    )


def _short_grams(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each run of as many words as a short item has: gram (minus the length), value, place (from 1)."""
    each = rows.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len")).where(F.col("n_words") >= F.col("len"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("len") + 1)).alias("place"))
    return each.select(*rows.columns, (-F.col("len")).alias("gram"), F.xxhash64(F.slice("words", F.col("place"), F.col("len"))).alias("value"), "place")


def _cells_for(windows: int) -> int:
    cells = 1024
    while cells < windows and cells < MOST_CELLS:
        cells *= 2
    return cells


def _cell(value: Column, gram: Column, cells: int) -> tuple[Column, Column]:
    """Which cell a fingerprint falls in, and its two bits there, from its hash."""
    h = F.xxhash64(value, gram)
    bit = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit(0)).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(6)))
    return F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(cells - 1)), mask


def _filter(windows: DataFrame, cells: int) -> DataFrame:
    """(cell, bits), at most ``cells`` rows and one for the documents' own rows (gram 0), which always pass."""
    cell, mask = _cell(F.col("value"), F.col("gram"), cells)
    held = windows.select("value", "gram").distinct().select(cell.alias("cell"), mask.alias("mask")).groupBy("cell").agg(F.bit_or("mask").alias("bits"))
    return held.unionByName(windows.sparkSession.createDataFrame([(-1, -1)], "cell long, bits long"))


def _let_through(marks: DataFrame, filt: DataFrame, cells: int) -> DataFrame:
    """Fingerprints that the filter lets through, with the words around them: ``around`` starts at word ``from``."""
    cell, mask = _cell(F.col("value"), F.col("gram"), cells)
    own = F.col("gram") == 0
    asked = marks.select("*", F.when(own, F.lit(-1).cast("long")).otherwise(cell).alias("cell"), F.when(own, F.lit(0).cast("long")).otherwise(mask).alias("mask"))
    met = asked.join(F.broadcast(filt), "cell").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    start = F.greatest(F.lit(1), F.col("place") - (PER_WINDOW - 1))
    around = F.when(own, F.slice("words", 1, 0)).otherwise(F.slice("words", start, F.col("place") + WINDOW - start))
    return met.select("doc_id", "text_hash", "n_words", "gram", "value", "place", start.alias("from"), around.alias("around"))


def _extended(met: DataFrame) -> DataFrame:
    """Windows that the fingerprints let through may belong to: doc_id, text_hash, n_words, lo (first word, from 1), len, key."""
    offsets = F.when(F.col("gram") > 0, F.sequence(F.lit(0), F.lit(PER_WINDOW - 1))).otherwise(F.array(F.lit(0)))
    size = F.when(F.col("gram") > 0, F.lit(WINDOW)).otherwise(-F.col("gram"))
    each = met.where("gram <> 0").select("*", F.explode(offsets).alias("at"), size.alias("len")).withColumn("lo", F.col("place") - F.col("at"))
    inside = each.where((F.col("lo") >= 1) & (F.col("lo") + F.col("len") - 1 <= F.col("n_words")))
    words = F.slice("around", F.col("lo") - F.col("from") + 1, F.col("len"))
    return inside.select("doc_id", "text_hash", "n_words", "lo", "len", _window_key(F.col("gram"), F.col("value"), F.col("at"), words).alias("key"))


def _hits(docs: DataFrame, of_items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per distinct document and text: doc_id, n_words, copies, n_hit, spans, wins (its windows' numbers), set_key (of
    these, null if none); and the windows: win, key, items (how many have it). Both written."""
    windows = materialise(of_items.groupBy("key", "value", "gram", "len").agg(F.count(F.lit(1)).alias("items")).withColumn("win", F.monotonically_increasing_id()))
    sizes = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("gram") < 0, F.col("len"))).alias("short")).first()  # at most 12 lengths
    cells = _cells_for(sizes["n"])
    filt = materialise(_filter(windows, cells))

    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), ascii_words(F.col(text_col)).alias("words")
    )
    rows = _with_grams(rows.withColumn("n_words", F.size("words")))
    marks = [_fingerprints(rows)] + ([_short_grams(rows, sorted(sizes["short"]))] if sizes["short"] else [])
    met = materialise(reduce(DataFrame.unionByName, [_let_through(m, filt, cells) for m in marks]))

    extended = _extended(met)
    often = extended.groupBy("key").agg(F.count(F.lit(1)).alias("places"))
    named = materialise(windows.join(often, "key").select("key", "win", "places"))
    places = named.agg(F.sum("places")).first()[0] or 0
    span = F.struct((F.col("lo") - 1).alias("lo"), (F.col("lo") - 1 + F.col("len")).alias("hi"))
    matched = join_split(extended, named, "key", "places", places).select("doc_id", "text_hash", "n_words", F.lit(False).alias("own"), span.alias("span"), "win").distinct()
    none = met.where("gram = 0").select("doc_id", "text_hash", "n_words", F.lit(True).alias("own"), F.lit(None).cast(dict(matched.dtypes)["span"]).alias("span"), F.lit(None).cast("long").alias("win"))
    merged = none.unionByName(matched).groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if("own").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("win")).alias("wins")
    )
    zero = F.struct(F.lit(0).alias("hi"), F.lit(0).alias("n"))
    n_hit = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(F.greatest(a["hi"], s["hi"]).alias("hi"), (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(a["hi"], s["lo"]))).alias("n")),
        lambda a: a["n"],
    )
    set_key = F.when(F.size("wins") > 0, F.sha2(F.array_join(F.transform("wins", lambda w: w.cast("string")), ","), 256))
    return materialise(merged.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "copies", n_hit.cast("long").alias("n_hit"), "spans", "wins", set_key.alias("set_key"))), windows


def _sets(hits: DataFrame, of_items: DataFrame, windows: DataFrame) -> DataFrame:
    """(set_key, items, rows): the sorted items of each distinct set of windows, and how many hits have it. Written."""
    members = join_split(of_items.select("item", "key"), windows.select("key", "win", "items"), "key", "items", of_items.count()).groupBy("win").agg(F.collect_set("item").alias("items"))
    sets = materialise(hits.where("set_key is not null").groupBy("set_key").agg(F.first("wins").alias("wins"), F.count(F.lit(1)).alias("rows")))
    each = sets.select("set_key", F.explode("wins").alias("win"))
    often = each.groupBy("win").agg(F.count(F.lit(1)).alias("sets"))
    met = join_split(each, materialise(members.join(often, "win")), "win", "sets", each.count())
    gathered = met.groupBy("set_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return materialise(gathered.join(sets.select("set_key", "rows"), "set_key"))


def _with_sets(hits: DataFrame, sets: DataFrame, nothing: dict[str, Column]) -> DataFrame:
    """``hits`` once for each copy, with what their set says, or ``nothing``."""
    found = hits.where("set_key is not null")
    met = join_split(found, sets, "set_key", "rows", found.count())
    rest = hits.where("set_key is null").select("*", *[value.alias(name) for name, value in nothing.items()])
    every = met.select(*rest.columns).unionByName(rest)
    return every.select(F.explode(F.array_repeat(F.struct(*[c for c in every.columns if c not in ("copies", "wins", "set_key")]), F.col("copies").cast("int"))).alias("r")).select("r.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (lo, hi of each window)."""
    of_items = materialise(benchmark_windows(benchmark))
    hits, windows = _hits(docs, of_items, id_col, text_col)
    found = _with_sets(hits, _sets(hits, of_items, windows), {"items": F.array().cast("array<string>")})
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans")


def digest_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``find_contamination``, with the number and the digest of items alone: lists stay with their sets."""
    of_items = materialise(benchmark_windows(benchmark))
    hits, windows = _hits(docs, of_items, id_col, text_col)
    digest = lambda items: F.sha2(F.array_join(items, ","), 256)
    sets = materialise(_sets(hits, of_items, windows).select("set_key", "rows", F.size("items").cast("long").alias("n_items"), digest(F.col("items")).alias("items_sha256")))
    return _with_sets(hits, sets, {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents (of rows that share an id, all go if one does). Columns stay as they are;
    only the ids that go are joined back, usually few enough to be broadcast by their size."""
    hits, _ = _hits(docs, materialise(benchmark_windows(benchmark)))
    gone = materialise(hits.where(is_contaminated()).select(F.col("doc_id").alias("__dc_gone")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__dc_gone"]), "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir):
    return digest_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).withColumn("contaminated", is_contaminated())


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT * FROM (SELECT item_id::VARCHAR AS item, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
bw AS (SELECT DISTINCT item, least(len(words), 13) AS n, array_to_string(words[j:j + least(len(words), 13) - 1], ' ') AS win FROM b, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS t(j)),
dw AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM (SELECT d.*, l.n FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(words) >= l.n) x, unnest(range(1, len(words) - n + 2)) AS t(i)),
h AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h) x, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
"""
