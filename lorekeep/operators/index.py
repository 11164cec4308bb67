"""The index as tables: chunks by content identity, links to the sources that hold them, derived counts, audits.

A turn seen in several source files is one chunk, with one link for each source. Counts are derived by aggregation at
write time; the audit recomputes them with joins and reports what differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import is_fingerprint, is_identifier


def build_chunks(turns: DataFrame) -> DataFrame:
    """One row per (project_fingerprint, uuid): the latest observation by ``seq`` wins; ``ts`` is the latest of all
    sources and ``source_count`` their number. Chunk ids are hashes of the identity, so the same on every build.

    ``turns``: project, project_fingerprint, uuid, source_key, session_id, ts, role, text, seq. One partial aggregate
    and one shuffle of an observation for each task and identity.
    """
    key = ["project_fingerprint", "uuid"]
    latest = F.max_by(F.struct("project", "role", "text"), F.struct("seq", "source_key"))
    grouped = turns.groupBy(*key).agg(latest.alias("last"), F.max("ts").alias("ts"), F.count_distinct("source_key").alias("source_count"))
    return grouped.select(F.xxhash64(*key).alias("chunk_id"), *key, "last.*", "ts", "source_count")


def build_links(turns: DataFrame) -> DataFrame:
    """(chunk_id, source_key, session_id, ts): the last observation of a chunk in a source."""
    last = F.max_by(F.struct("session_id", "ts"), "seq").alias("last")
    return turns.groupBy("project_fingerprint", "uuid", "source_key").agg(last).select(F.xxhash64("project_fingerprint", "uuid").alias("chunk_id"), "source_key", "last.*")


def sessions_per_chunk(links: DataFrame) -> DataFrame:
    """(chunk_id, sessions): in the order of source keys."""
    pairs = F.array_sort(F.collect_list(F.struct("source_key", "session_id")))
    return links.groupBy("chunk_id").agg(F.transform(pairs, lambda p: p["session_id"]).alias("sessions"))


def is_sound() -> Column:
    """Whether a chunk (uuid, project_fingerprint, text, sessions) may be told as a result: it has a pointer, text and a source."""
    sound = is_identifier(F.col("uuid")) & is_fingerprint(F.col("project_fingerprint")) & (F.trim("text") != "") & (F.size("sessions") > 0)
    return F.coalesce(sound, F.lit(False))


def source_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("source_key").agg(F.count(F.lit(1)).alias("chunk_count"))


def remove_sources(chunks: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and links without the sources ``gone`` (source_key): chunks that only they held go too, the others'
    latest time and count are derived anew."""
    left = links.join(gone, "source_key", "left_anti")
    derived = left.groupBy("chunk_id").agg(F.max("ts").alias("ts"), F.count_distinct("source_key").alias("source_count"))
    return chunks.drop("ts", "source_count").join(derived, "chunk_id"), left


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last writer's row for each key: any new one before the old, of several new ones that with the largest
    ``sequence`` (of equal ones the largest row). Partial sums keep one row for each key and task."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    row = F.struct(*old.columns)
    return both.groupBy(*keys).agg(F.max_by(row, F.struct("__gen", sequence, row)).alias("row")).select("row.*")


# -- audit ------------------------------------------------------------------------------------------------------------


def divergent_chunks(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks whose stored source count is not that of their links."""
    real = links.groupBy("chunk_id").agg(F.count_distinct("source_key").alias("real_count"))
    joined = chunks.select("chunk_id", "source_count").join(real, "chunk_id", "left")
    return joined.where(~F.col("source_count").eqNullSafe(F.coalesce("real_count", F.lit(0)))).select("chunk_id", "source_count", F.coalesce("real_count", F.lit(0)).alias("real_count"))


def divergent_sources(stored: DataFrame, links: DataFrame) -> DataFrame:
    """Sources whose stored chunk count differs from their links', in either direction."""
    real = source_counts(links).withColumnRenamed("chunk_count", "real_count")
    joined = stored.join(real, "source_key", "full_outer")
    return joined.where(~F.col("chunk_count").eqNullSafe(F.col("real_count"))).select("source_key", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("real_count", F.lit(0)).alias("real_count"))


def dangling_links(chunks: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "source_key")


def orphan_chunks(chunks: DataFrame, links: DataFrame) -> DataFrame:
    return chunks.join(links.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")


def uncovered_sources(links: DataFrame, scan_state: DataFrame) -> DataFrame:
    """Sources that hold chunks but have no cursor."""
    return links.select("source_key").distinct().subtract(scan_state.select("source_key"))


def audit(chunks: DataFrame, links: DataFrame, stored: DataFrame, scan_state: DataFrame) -> DataFrame:
    """(figure, n): five counts, all zero on a sound index."""
    parts = {
        "divergent_chunks": divergent_chunks(chunks, links), "divergent_sources": divergent_sources(stored, links), "dangling_links": dangling_links(chunks, links),
        "orphan_chunks": orphan_chunks(chunks, links), "uncovered_sources": uncovered_sources(links, scan_state),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("figure"), "n") for name, df in parts.items()])


def coverage_gate(chunks: DataFrame, links: DataFrame, scan_state: DataFrame) -> None:
    """Refuses an increment over an index that has chunks without sources or sources without cursors."""
    if not chunks.where("source_count = 0").isEmpty() or not uncovered_sources(links, scan_state).isEmpty():
        raise ValueError("the index does not cover its sources; rebuild it")


def manifest_difference(found: DataFrame, scan_state: DataFrame, unreadable_projects: DataFrame) -> DataFrame:
    """(source_key, action): new, same, appended, rewritten, vanished, or kept where the project can't be read.

    ``found``: source_key, project, prefix_hash (of the first ``processed_bytes`` of the stored cursor), size.
    """
    state = scan_state.select("source_key", F.col("prefix_hash").alias("old_hash"), "processed_bytes")
    joined = found.join(state, "source_key", "full_outer").withColumn("of", F.coalesce("project", F.substring_index("source_key", "/", 1)))
    blocked = joined.join(F.broadcast(unreadable_projects.select(F.col("project").alias("of")).distinct().withColumn("blocked", F.lit(True))), "of", "left")
    action = (
        F.when(F.col("size").isNull(), F.when(F.col("blocked"), "kept").otherwise("vanished"))
        .when(F.col("processed_bytes").isNull(), "new")
        .when((F.col("processed_bytes") < 0) | (F.col("size") < F.col("processed_bytes")) | (F.col("prefix_hash") != F.col("old_hash")), "rewritten")
        .when(F.col("size") > F.col("processed_bytes"), "appended")
        .otherwise("same")
    )
    return blocked.select("source_key", action.alias("action"))


def duplication_statistics(links: DataFrame, turns: DataFrame) -> DataFrame:
    """One row: identities, those in more than one source, of these with one text, and with differing sessions."""
    per = turns.groupBy("uuid").agg(F.count_distinct("source_key").alias("files"), F.count_distinct("text").alias("texts"), F.count_distinct("session_id").alias("sessions"))
    shared = F.col("files") > 1
    return per.agg(
        F.count(F.lit(1)).alias("uuids"), F.count_if(shared).alias("in_several"), F.count_if(shared & (F.col("texts") == 1)).alias("same_content"), F.count_if(shared & (F.col("sessions") > 1)).alias("other_sessions")
    )


def resolve_anchors(anchors: DataFrame, chunks: DataFrame, key: bytes) -> DataFrame:
    """Each anchor (turn_id, source, content_hash, lo, hi) with its text, or the reason why it is an orphan.

    ``chunks``: project_fingerprint, uuid, text. Left join on the pointer alone; the span's content hash (keyed, over the
    normal form) is worked out anew. The reasons are fixed values.
    """
    from lorekeep.functions.hashing import content_hash
    from lorekeep.functions.text import span_slice

    held = chunks.select(F.col("uuid").alias("turn_id"), F.col("project_fingerprint").alias("source"), F.col("text").alias("turn_text"), F.lit(True).alias("there"))
    joined = anchors.join(held, ["turn_id", "source"], "left").withColumn("span", span_slice(F.col("turn_text"), F.col("lo"), F.col("hi")))
    joined = joined.withColumn("real_hash", content_hash(F.col("span"), key))
    reason = (
        F.when(F.col("there").isNull(), "turnMissing")
        .when(F.col("span").isNull(), "spanOutOfBounds")
        .when(F.col("real_hash").isNull(), "contentNormalizesToNothing")
        .when(F.col("real_hash") != F.col("content_hash"), "contentHashMismatch")
    )
    return joined.select("turn_id", "source", "lo", "hi", reason.alias("orphan_reason"), F.when(reason.isNull(), F.col("span")).alias("text"))
