"""Words of scripts that are written without spaces.

A lexicon gives words integer costs, a thousand times the negative logarithm of their share of all counts. A run of CJK
characters is cut into the words that cost least in sum: a shortest path over the lattice of all words that the lexicon
finds in the run, looked up in a trie, position by position. Characters that no word covers stand alone, at more than any
word costs; of equally cheap paths the one with fewer words wins, then that with the shorter last word.

Texts are cut many at once: between two characters that stand side by side in no word every cut has a border, so runs fall
into short pieces, of which equal ones are cut once, all pieces of a batch together, a position at a time.

A lexicon comes from counts that are known (``Lexicon.of``), from a table (``from_table``) or from a corpus (``learned``). It
travels to tasks whole, so its size is bounded: ``MOST_WORDS`` words of at most ``LONGEST`` characters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import CJK

MOST_WORDS = 200_000
LONGEST = 8
#: How much more an unknown character costs than a word that was seen once.
UNKNOWN = 2000
#: What counts as CJK in ``functions.text``, as code points.
_RANGES = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF), (0x20000, 0x2FA1F)]
#: Characters of texts that are cut at once, and of a piece that is cut together with others; longer ones are cut alone.
AT_ONCE, SHORT = 1_000_000, 64
#: Cells of the table of neighbours; pairs that share one only make a piece longer.
_NEIGHBOURS = 1 << 22
#: Cells of a trie's table, where one is made.
_CELLS = 1 << 22
_FAR = 1 << 50


@dataclass(frozen=True)
class Lexicon:
    """Costs of words, and the trie that finds them (nested by character; the empty key holds a word's cost)."""

    costs: dict[str, int]
    unknown: int
    trie: dict = field(repr=False, compare=False)

    @staticmethod
    def of(counts: Iterable[tuple[str, int]]) -> Lexicon:
        known = {w: int(n) for w, n in counts if w and n > 0 and len(w) <= LONGEST}
        if len(known) > MOST_WORDS:
            raise ValueError(f"a lexicon holds at most {MOST_WORDS} words")
        total = sum(known.values())
        costs = {w: round(1000 * math.log(total / n)) for w, n in known.items()}
        trie: dict = {}
        for word, cost in costs.items():
            node = trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = cost
        return Lexicon(costs, round(1000 * math.log(total)) + UNKNOWN if total else UNKNOWN, trie)

    @staticmethod
    def from_table(words: DataFrame) -> Lexicon:
        """Of a table (word, n); more than ``MOST_WORDS`` rows are refused."""
        rows = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).limit(MOST_WORDS + 1).collect()
        return Lexicon.of((r["word"], r["n"]) for r in rows)

    @property
    def revision(self) -> str:
        """A name for these words and costs, which an index keeps beside what it cut with them."""
        told = "\n".join(f"{w}\t{c}" for w, c in sorted(self.costs.items()))
        return hashlib.sha256(f"{self.unknown}\n{told}".encode()).hexdigest()[:16]

    def words(self, run: str) -> list[str]:
        """The cheapest cut of a run."""
        n = len(run)
        best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(1 << 62, 0, 0)] * n  # cost, words, length of the last word
        for i in range(n):
            cost, count, _ = best[i]
            node, j = self.trie.get(run[i]), i + 1
            alone = (cost + (node.get("", self.unknown) if node else self.unknown), count + 1, 1)
            best[j] = min(best[j], alone)
            while node and j < n:
                node = node.get(run[j])
                j += 1
                if node and "" in node:
                    best[j] = min(best[j], (cost + node[""], count + 1, j - i))
        out, at = [], n
        while at:
            out.append(run[at - best[at][2] : at])
            at -= best[at][2]
        return out[::-1]

    @cached_property
    def arrays(self) -> Arrays:
        """This lexicon for many texts at once; made in the task that asks for it."""
        return Arrays(self)


class Arrays:
    """A lexicon as arrays: letters by code point, neighbours within words, the trie's edges and the weights of its nodes."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        letters = sorted({c for w in lexicon.costs for c in w})
        number = {c: i for i, c in enumerate(letters, 1)}
        self.base = len(letters) + 1
        self.letters = np.full(0x110000, -1, np.int32)  # -1: not CJK, 0: in no word
        for lo, hi in _RANGES:
            self.letters[lo : hi + 1] = 0
        for c, i in number.items():
            if self.letters[ord(c)] == 0:
                self.letters[ord(c)] = i
        pairs = {number[a] * self.base + number[b] for w in lexicon.costs for a, b in zip(w, w[1:])}
        self.neighbours = np.zeros(min(1 << (self.base**2).bit_length(), _NEIGHBOURS), bool)  # a power of two
        self.neighbours[np.array(sorted(pairs), np.int64) & (len(self.neighbours) - 1)] = True
        nodes, keys = [lexicon.trie], []
        for at, node in enumerate(nodes):  # grows: the k-th edge leads to node k + 1
            for c, child in node.items():
                if c:
                    keys.append(at * self.base + number[c])
                    nodes.append(child)
        # an edge's place: its own key where that takes few cells, else that among the sorted keys
        keys, to = np.array(keys, np.int64), np.arange(1, len(nodes), dtype=np.int32)
        self.table = np.full(len(nodes) * self.base, -1, np.int32) if len(nodes) * self.base <= _CELLS else None
        if self.table is not None:
            self.table[keys] = to
        order = np.argsort(keys)
        self.edges, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], -1)
        # a cost and, below it, one word; the last entry is for no node
        self.weights = np.array([n[""] * 128 + 1 if "" in n else 2 * _FAR for n in nodes] + [2 * _FAR], np.int64)
        self.longest = max(map(len, lexicon.costs), default=1)

    def _child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        wanted = node * self.base + letter  # below the root's keys, where there is no node
        if self.table is not None:
            return np.where(node < 0, -1, self.table[np.maximum(wanted, 0)])
        at = np.searchsorted(self.edges, wanted)
        return np.where(self.edges[at] == wanted, self.to[at], -1)

    def starts(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a word of its piece's cheapest cut starts at a letter; pieces of up to ``SHORT`` letters stand end to end."""
        order = np.argsort(-sizes, kind="stable")
        begin, longest = (np.cumsum(sizes) - sizes)[order], int(sizes[order[0]])
        active = np.searchsorted(-sizes[order], -np.arange(longest + 1))  # pieces that have a letter there
        step = [letters[begin[: active[j]] + j].astype(np.int64) for j in range(longest)]
        best, last = [np.full(n, _FAR) for n in active[:-1]], [np.zeros(n, np.int8) for n in active[:-1]]
        alone = self.weights.copy()
        alone[alone > _FAR] = self.lexicon.unknown * 128 + 1
        for j in range(longest):
            before, node = (best[j - 1] if j else np.zeros(active[0], np.int64)), np.zeros(active[j], np.int64)
            for end in range(j, min(j + self.longest, longest)):
                n = active[end]
                node = self._child(node[:n], step[end])
                cost = before[:n] + (alone if end == j else self.weights)[node]
                better = cost <= best[end]  # the shorter last word comes later
                np.copyto(best[end], cost, where=better)
                np.copyto(last[end], end - j + 1, where=better)
        ends, first = [np.arange(active[j]) >= active[j + 1] for j in range(longest)], [np.zeros(n, bool) for n in active[:-1]]
        for j in reversed(range(longest)):
            for size in range(1, min(self.longest, j + 1) + 1):
                here = ends[j] & (last[j] == size)
                first[j - size + 1][: len(here)] |= here
                if size <= j:
                    ends[j - size][: len(here)] |= here
        out = np.zeros(len(letters), bool)
        for j in range(longest):
            out[begin[: active[j]] + j] = first[j]
        return out

    def _words_start(self, codes: np.ndarray) -> np.ndarray:
        """Whether a token starts at a character of texts that stand end to end; only spaces separate."""
        letters, space = self.letters[codes], codes == 32
        cjk, other = letters >= 0, (letters < 0) & ~space
        joined = np.zeros(len(codes) + 1, bool)  # with the character before
        joined[1:-1] = self.neighbours[(letters[:-1] * np.int32(self.base) + letters[1:]) & np.int32(len(self.neighbours) - 1)]
        joined[1:-1] &= cjk[:-1] & cjk[1:]
        joined[1:-1] |= other[:-1] & other[1:]
        out = ~joined[:-1] & ~space
        inside = cjk & (joined[:-1] | joined[1:])  # pieces of two and more
        begin = np.flatnonzero(inside & out)
        size = np.diff(np.append(np.flatnonzero(out[inside]), np.count_nonzero(inside)))
        for i in np.flatnonzero(size > SHORT):
            at = begin[i]
            for w in self.lexicon.words(codes[at : at + size[i]].tobytes().decode("utf-32-le")):
                out[at] = True
                at += len(w)
            inside[begin[i] : begin[i] + size[i]] = False
        size = size[size <= SHORT]
        if len(size):
            own = letters[inside]
            pieces = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, 4 * np.cumsum(size)).astype(np.int32)), pa.py_buffer(own)]).dictionary_encode()
            known = pieces.dictionary
            _, borders, held = known.buffers()
            borders = np.frombuffer(borders, np.int32)[: len(known) + 1] // 4
            cut = self.starts(np.frombuffer(held, np.int32)[: borders[-1]], np.diff(borders))
            cuts = pa.BinaryArray.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(borders), pa.py_buffer(cut.view(np.uint8))]).take(pieces.indices)
            out[inside] = np.frombuffer(cuts.buffers()[2], bool)[: len(own)]
        return out

    def tokens(self, rows: pa.Array) -> pa.ListArray:
        """Of texts whose tokens are CJK runs or stand between spaces; null texts have none."""
        held, ends = end_to_end(rows)
        codes = np.frombuffer(held.decode().encode("utf-32-le"), np.uint32)
        first, kept = self._words_start(codes), codes != 32
        at = np.cumsum(utf8_sizes(codes[kept]), dtype=np.int32)
        begin = first[kept]
        borders = np.append(0, at)[np.append(np.flatnonzero(begin), len(at))]  # in bytes without spaces
        held = np.frombuffer(held, np.uint8)
        values = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(held[held != 32]))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(np.flatnonzero(first), ends)).astype(np.int32)), values)


def end_to_end(rows: pa.Array) -> tuple[bytes, np.ndarray]:
    """Texts in a row, a space after each (null counts as empty), and where, in characters, each ends."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(rows) + 1], pa.int32()), pa.concat_arrays([rows.fill_null(""), pa.array([""], rows.type)]))
    ends = np.cumsum(pc.utf8_length(whole.values.slice(0, len(rows))).to_numpy() + 1, dtype=np.int64) - 1
    return pc.binary_join(whole, " ")[0].as_buffer().to_pybytes(), ends


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)


def portions(rows: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about ``AT_ONCE`` characters, as bounds: so many are cut at once, or one that has more."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(rows):
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + AT_ONCE, side="right")))
        yield lo, hi
        lo = hi


def separated(text: Column) -> Column:
    """Lower-cased, one space for each stretch of other characters than letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def tokens(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Lower-cased runs of letters and digits; of CJK runs the lexicon's words, or single characters without one.

    Runs of other scripts never leave the JVM; rows without a CJK character reach the lexicon as null.
    """
    low = F.lower(text)
    has_cjk = low.rlike(r"[\x{3040}-\x{10FFFF}]")  # most texts need no second look
    if lexicon is None:
        spaced = F.regexp_replace(low, f"({CJK})", " $1 ")
        return F.array_remove(F.split(F.when(has_cjk, spaced).otherwise(low), r"[^\p{L}\p{N}]+"), "")

    @F.arrow_udf("string")
    def cut(rows: pa.Array) -> pa.Array:
        told = [pc.binary_join(lexicon.arrays.tokens(rows.slice(lo, hi - lo)), " ") for lo, hi in portions(rows)]
        return pc.if_else(rows.is_valid(), pa.concat_arrays(told), None) if told else rows

    # as one string: tokens hold no spaces, and their lists would be many times as large in a worker
    words = F.split(cut(F.when(has_cjk, separated(text))), " ")
    return F.array_remove(F.when(has_cjk, words).otherwise(F.split(low, r"[^\p{L}\p{N}]+")), "")


def cjk_grams(texts: DataFrame, text_col: str, longest: int) -> DataFrame:
    """(w, n): how often each stretch of up to ``longest`` characters stands in the CJK runs of ``texts``."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({CJK}+)"), F.lit(1))).alias("run"))
    runs = runs.groupBy("run").agg(F.count(F.lit(1)).alias("times"))  # equal runs once
    each = runs.select("run", "times", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("i") + 1)))
    return each.select("run", "times", "i", sizes.alias("size")).select(F.expr("substring(run, i, size)").alias("w"), "times").groupBy("w").agg(F.sum("times").alias("n"))


def learned(texts: DataFrame, text_col: str = "text", longest: int = 4, least: int = 5, cohesion: float = 8.0, freedom: float = 0.9, most: int = MOST_WORDS) -> DataFrame:
    """A lexicon (word, n) from a corpus, by counts alone: stretches of two to ``longest`` characters that occur ``least``
    times, stand together ``cohesion`` times as often as any two pieces of theirs would by chance, and are not followed
    or preceded by one and the same character more than the share ``freedom`` of times; beside them all characters. The
    ``most`` frequent ones stay.

    Counts are grouped by stretch, so no key is larger than its own row; pieces are looked up by equi-joins.
    """
    grams = cjk_grams(texts, text_col, longest + 1)
    total = F.lit(grams.where(F.length("w") == 1).agg(F.sum("n")).first()[0] or 1).cast("double")
    frequent = grams.where(F.col("n") >= least)
    words = frequent.where(F.length("w").between(2, longest))
    cuts = words.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("at"))
    pieces = cuts.select("w", "n", F.expr("substring(w, 1, at)").alias("head"), F.expr("substring(w, at + 1)").alias("tail"))
    heads, tails = (grams.select(F.col("w").alias(side), F.col("n").alias(f"{side}_n")) for side in ("head", "tail"))
    held = pieces.join(heads, "head").join(tails, "tail").groupBy("w", "n").agg(F.min(F.col("n") * total / (F.col("head_n").cast("double") * F.col("tail_n"))).alias("together"))
    longer = frequent.where(F.length("w").between(3, longest + 1))
    beside = longer.select(F.expr("substring(w, 1, length(w) - 1)").alias("w"), "n").unionByName(longer.select(F.expr("substring(w, 2)").alias("w"), "n"))
    bound = beside.groupBy("w").agg(F.max("n").alias("bound"))
    free = held.where(F.col("together") >= cohesion).join(bound, "w", "left").where(F.coalesce(F.col("bound"), F.lit(0)) <= freedom * F.col("n"))
    all_words = free.select(F.col("w").alias("word"), "n").unionByName(grams.where(F.length("w") == 1).select(F.col("w").alias("word"), "n"))
    return all_words.orderBy(F.desc("n"), "word").limit(most)
