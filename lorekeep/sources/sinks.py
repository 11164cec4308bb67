"""Results as text, JSON lines and a bounded block for a prompt. All take a result page, which is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import flatten_clip

# The block's markers, its size, and how snippets are shortened until it fits.
OPEN, CLOSE = "<!-- recall:begin -->", "<!-- recall:end -->"
MOST_CHARS, LONGEST, SHORTEST = 4000, 200, 20
MOST_RESULTS = 1000


#: What is told of a hit besides its pointer, where it is known.
EXTRAS = ("displacement", "history", "movement", "credited_to", "presentation")


def pointered(hits: DataFrame, chunks: DataFrame, clip: int = 160) -> DataFrame:
    """Hits with their pointer (project, sessions, uuid, time) and a one-line snippet. ``chunks``: with sessions."""
    # clipped before the join, so that it never moves whole texts
    told = chunks.select("chunk_id", "project", "uuid", "ts", flatten_clip(F.col("text"), clip).alias("snippet"), "sessions")
    rows = hits.join(told, "chunk_id")
    extras = [c for c in EXTRAS if c in hits.columns]
    return rows.select("qid", "pos", "project", "uuid", "ts", "snippet", "score", "band", "channels", "sessions", *extras)


def json_lines(results: DataFrame) -> DataFrame:
    return results.orderBy("qid", "pos").select(F.to_json(F.struct(*results.columns)).alias("line"))


def human(results: DataFrame) -> str:
    rows = results.orderBy("qid", "pos").limit(MOST_RESULTS).collect()
    return "\n".join(f"{r['pos'] + 1}. [{r['project']}] {r['uuid']} {r['ts']} {r['snippet']}  (band {r['band']}, {'+'.join(r['channels'])}; {', '.join(r['sessions'])})" for r in rows)


def recall_block(results: DataFrame) -> str:
    """At most ``MOST_CHARS`` characters between markers: snippets are halved down to ``SHORTEST``, then trailing entries
    are dropped. Comment openers in texts are defused."""
    rows = results.orderBy("qid", "pos").limit(MOST_RESULTS).collect()
    limit = LONGEST
    while True:
        lines = []
        for r in rows:
            text = r["snippet"].replace("<!--", "<! --")
            lines.append(f"- [{r['project']}] {r['uuid']} {r['ts']}: {text if len(text) <= limit else text[: limit - 1] + '…'}")
        block = "\n".join([OPEN, *lines, CLOSE])
        if len(block) <= MOST_CHARS or not rows:
            return block
        if limit > SHORTEST:
            limit = max(SHORTEST, limit // 2)
        else:
            rows = rows[:-1]
