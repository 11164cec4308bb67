"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each Spark task.

A task splits its texts into pretokens. Pretokens that the worker has not met go to an in-process DuckDB as
token-position rows (word, place, token). A recursive query joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of the least rank, one a round, until no word has a pair left. An ordered
aggregation gives each word's ids, and another, over the vocabulary's bytes, decodes ids again. A document's ids are
those of its pretokens in order; so are its decoded bytes.

Memory: a task holds one Arrow batch, the DuckDB limit (``DUCKDB_MB``; it spills nowhere), and words met before, which are forgotten
beyond about ``WORDS_KEPT``, those not used of late first. Nothing is shuffled. Rows are sent in blocks of at most
``BLOCK_BYTES`` bytes and ``BLOCK_ROWS`` rows over all rounds. The recursive query stores a word of n bytes up to n
times, so pretokens of more than ``LONG_BYTES`` bytes go by a recursion that keeps each place once and replaces the two
that a round changes. Both take a round for each contraction, each over all the word's places; so unbroken runs of more
than ``HUGE_BYTES`` bytes, which would take minutes, are contracted by a queue of pairs instead, in the same order, in
n log n steps. Long pretokens are forgotten beyond about ``LONG_KEPT`` bytes.

Defined cases: null and empty texts encode to no ids and decode to no bytes; repeated rows each get their row; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import read_table, ship_package

DUCKDB_MB = 96
WORDS_KEPT = 200_000
BLOCK_BYTES = 200_000
#: Rows that the recursive query may store for a block: about half the square of each word's bytes.
BLOCK_ROWS = 1_500_000
LONG_BYTES = 64
HUGE_BYTES = 2048
#: Bytes of long pretokens in a block; every round goes over the whole block.
LONG_BLOCK = 50_000
LONG_KEPT = 16_000_000
#: Characters of text whose pretokens are held at once; the more, the fewer recursive queries.
CHARS_AT_ONCE = 2_000_000

#: Each round finds every word's least (rank, place) among its neighbours that merge, then contracts that pair. A row holds
#: its token, the next one, and what both merge to, if anything; so only the two rows beside a contraction ask the merge
#: table again. The pair's first row is dropped, its second takes the merged token and moves up with those behind it. Words
#: without a pair are not carried on; a word's rows of its last round are its tokens.
_ENCODE = """
WITH RECURSIVE t(word, place, token, next, merged, round) AS (
    SELECT p.word, p.place, p.token, p.next, g.merged, 0 FROM pieces p LEFT JOIN merges g ON g.pair = (p.token::BIGINT << 32) + p.next
    UNION ALL
    (WITH best AS (SELECT word, min((merged::BIGINT << 32) + place) AS pick FROM t WHERE merged IS NOT NULL GROUP BY word),
    spot AS (SELECT word, (pick & 4294967295)::INT AS place, (pick >> 32)::INT AS merged FROM best),
    moved AS (
        SELECT t.word, t.place - (t.place > s.place)::INT AS place, CASE WHEN t.place = s.place + 1 THEN s.merged ELSE t.token END AS token,
            CASE WHEN t.place = s.place - 1 THEN s.merged ELSE t.next END AS next, CASE WHEN abs(t.place - s.place) <> 1 THEN t.merged END AS merged, abs(t.place - s.place) = 1 AS beside, t.round + 1 AS round
        FROM t JOIN spot s ON s.word = t.word WHERE t.place <> s.place
    )
    SELECT m.word, m.place, m.token, m.next, coalesce(m.merged, g.merged), m.round
    FROM moved m LEFT JOIN merges g ON g.pair = CASE WHEN m.beside THEN (m.token::BIGINT << 32) + m.next END)
)
SELECT t.word, t.place, t.token FROM t JOIN (SELECT word, max(round) AS round FROM t GROUP BY word) USING (word, round)
"""
#: The same for long words. A place keeps its key for good: it holds a token and the place of the next one, or -1 once its
#: token has been taken into the one before. Words without a pair drop out of the working table ``t``.
_ENCODE_LONG = """
WITH RECURSIVE t(word, place, token, next) USING KEY (word, place) AS (
    SELECT word, place, token, place + 1 FROM pieces
    UNION ALL
    (WITH best AS (
        SELECT a.word, min((g.merged::BIGINT << 32) + a.place) AS pick
        FROM recurring.t a JOIN recurring.t b ON b.word = a.word AND b.place = a.next JOIN merges g ON g.pair = (a.token::BIGINT << 32) + b.token
        WHERE a.token >= 0 AND a.word IN (SELECT word FROM t)
        GROUP BY a.word
    ), spot AS (SELECT word, (pick & 4294967295)::INT AS place, (pick >> 32)::INT AS merged FROM best),
    two AS (
        SELECT a.word, a.place, s.merged, a.next AS gone, b.next
        FROM spot s JOIN recurring.t a ON a.word = s.word AND a.place = s.place JOIN recurring.t b ON b.word = a.word AND b.place = a.next
    )
    SELECT word, place, merged, next FROM two UNION ALL SELECT word, gone, -1, next FROM two)
)
SELECT word, place, token FROM t WHERE token >= 0
"""
#: One ordered aggregation gives tokens and their bytes: sorting each word's rows is its cost, so they are told together, as
#: ``id.hex id.hex``, and then taken apart.
_READ = """
SELECT word, regexp_replace(told, '\\.[0-9a-f]+', '', 'g') AS ids, unhex(regexp_replace(told, ' ?[0-9]+\\.', '', 'g')) AS bytes
FROM (SELECT word, string_agg(v.told, ' ' ORDER BY place) AS told FROM coded JOIN vocabulary v USING (token) GROUP BY word)
"""


class Codec:
    """A vocabulary's encoder and decoder over one DuckDB connection."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        pair, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None:
                    pair.append((a << 32) + b), merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": "", "preserve_insertion_order": False})
        self._table("merges", pa.table({"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        self._table("vocabulary", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "told": [f"{n}.{t.hex()}" for t, n in self.ranks.items()]}))
        self.known: dict[str, str] = {}  # ids of the words used of late, in decimal, joined by spaces
        self.older: dict[str, str] = {}
        self.long = 0  # bytes of the long words met since the last forgetting
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.odd: dict[str, bytes] = {}  # decoded bytes where they are not the word's own

    def _table(self, name: str, data) -> None:
        self.db.register("incoming", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _block(self, words: list[str], encode: str = _ENCODE) -> None:
        import numpy as np
        import pyarrow as pa

        parts = [w.encode() for w in words]
        lengths = np.array([len(p) for p in parts])
        whole = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(lengths)
        place = np.arange(len(whole)) - np.repeat(ends - lengths, lengths)
        token = np.array(self.byte, np.int32)[whole]
        last = np.zeros(len(whole), bool)
        last[ends - 1] = True
        follows = pa.array(np.roll(token, -1), mask=last)  # null behind a word's last token
        self._table("pieces", pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "place": place.astype(np.int32), "token": token, "next": follows}))
        self.db.execute(f"CREATE OR REPLACE TABLE coded AS {encode}")
        for word, ids, back in self.db.execute(_READ).fetchall():
            self.known[words[word]] = ids
            if back != parts[word]:
                self.odd[words[word]] = back

    def _contract(self, word: bytes) -> list[int]:
        """The word's ids: of all pairs that merge, the leftmost of the least rank is contracted, until none is left."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # of the piece that starts at a place; 0 where none starts any more
        before = list(range(-1, n))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, to = heapq.heappop(queue)
            mid = end[i]
            if not mid or mid >= to or end[mid] != to:  # one of the two has changed since
                continue
            end[i], end[mid] = to, 0
            if to < n:
                before[to] = i
                if (r := ranks.get(word[i : end[to]])) is not None:
                    heapq.heappush(queue, (r, i, end[to]))
            if i and (r := ranks.get(word[before[i] : to])) is not None:
                heapq.heappush(queue, (r, before[i], to))
        return [ranks[word[i:e]] for i, e in enumerate(end) if e]

    def _huge(self, word: str) -> None:
        part = word.encode()
        ids = self._contract(part)
        self.known[word] = " ".join(map(str, ids))
        if (back := b"".join(map(self.token.__getitem__, ids))) != part:
            self.odd[word] = back

    def learn(self, words) -> None:
        """Encodes and decodes the words that aren't known yet."""
        if len(self.known) > WORDS_KEPT // 2 or self.long > LONG_KEPT // 2:
            self.known, self.older, self.long = {}, self.known, 0
        new = set(words) - self.known.keys()
        for w in new & self.older.keys():
            self.known[w] = self.older[w]
        block, size, rows, long, long_size = [], 0, 0, [], 0
        for w in sorted(new - self.known.keys(), key=len):  # words of like length need like numbers of rounds
            n = len(w.encode())
            if n > LONG_BYTES:
                self.long += n
                if n > HUGE_BYTES:
                    self._huge(w)
                    continue
                if long and long_size + n > LONG_BLOCK:
                    self._block(long, _ENCODE_LONG)
                    long, long_size = [], 0
                long.append(w)
                long_size += n
                continue
            if block and (size + n > BLOCK_BYTES or rows + n * n // 2 > BLOCK_ROWS):
                self._block(block)
                block, size, rows = [], 0, 0
            block.append(w)
            size += n
            rows += n * n // 2
        if block:
            self._block(block)
        if long:
            self._block(long, _ENCODE_LONG)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.known[w].split()]

    def decode(self, ids: list[int]) -> bytes:
        import numpy as np
        import pyarrow as pa

        if not ids:
            return b""
        rows = {"word": np.zeros(len(ids), np.int32), "place": np.arange(len(ids)), "token": np.array(ids, np.int32)}
        self._table("coded", pa.table(rows))
        return self.db.execute(_READ).fetchall()[0][2]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids in decimal joined by spaces, SHA-256 of the decoded bytes."""
        one: dict[str, str] = {}  # one object for all places of a pretoken
        split = [list(map(one.setdefault, w, w)) for w in map(self.split, texts)]
        self.learn(one.keys())
        ids_of, odd, out = self.known.__getitem__, self.odd, []
        for words in split:
            ids = " ".join(map(ids_of, words))
            # where each word's decoded bytes were found to be its own, joined they are the text's
            back = b"".join([odd[w] if w in odd else w.encode() for w in words]) if odd else "".join(words).encode()
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: str, pattern: str | None = None) -> Codec:
    """This worker's codec for a vocabulary file of the installed tokenizers; built once."""
    import public_tokenizers

    key = (vocabulary, pattern or public_tokenizers.PATTERN)
    if key not in _codecs:
        _codecs[key] = Codec(public_tokenizers.path(vocabulary), key[1])
    return _codecs[key]


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids): each text's ids."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        c = codec(vocabulary)
        return pd.Series([c.encode(t) for t in texts])

    return docs.select(F.col(id_col).alias("doc_id"), encoded(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode_ids(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, bytes): the bytes of each list of ids; null counts as no ids."""
    ship_package(coded.sparkSession)

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        c = codec(vocabulary)
        return pd.Series([c.decode([] if x is None else list(map(int, x))) for x in ids])

    return coded.select(F.col(id_col).alias("doc_id"), decoded(F.col(ids_col)).alias("bytes"))


def _chunks(texts: pd.Series) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t) > CHARS_AT_ONCE:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    yield chunk


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        c = codec(vocabulary)
        return pd.DataFrame([r for chunk in _chunks(texts) for r in c.digests(chunk)], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digests(F.coalesce(F.col(text_col), F.lit(""))).alias("d")).select("doc_id", "d.*")


def op3_bpe(spark, sf_dir):
    return round_trip(read_table(spark, sf_dir, "documents"))
