"""JSON-lines conversation logs: raw records to turns, with a reason for every record that is skipped."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import fingerprint, normalise_space
from lorekeep.sources.tables import written

# What is told of a tool call, in this order, and how much of each.
TOOL_FIELDS = ("command", "file_path", "path", "pattern", "query", "url", "description")
TOOL_CLIP = 200
SKIPS = ("unparseableLine", "notATurn", "missingPointerField", "malformedIdentifier", "toolResultOnly", "noIndexableText", "incompleteTrailingRecord")

#: An ISO-8601 time with a zone, as records carry it.
_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$"


def _list(fs, path) -> list[tuple[str, bool]]:
    """(path, is a directory) of what a directory holds, hidden names left out."""
    return [(str(s.getPath().toString()), s.isDirectory()) for s in fs.listStatus(path) if not s.getPath().getName().startswith(".")]


def readable(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """The projects below ``root`` that can be listed in whole, as paths, and the names of those that can't, both sorted. A
    root that can't be listed is an error: it must not look like one without projects. Names alone are listed, by the file
    system that Spark reads from."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        projects = sorted(p for p, is_folder in _list(fs, top) if is_folder)
    except Exception as failed:
        raise ValueError(f"the root {root} can't be listed") from failed

    def is_whole(project: str) -> bool:
        todo = [project]
        while todo:
            try:
                todo += [p for p, is_folder in _list(fs, jvm.org.apache.hadoop.fs.Path(todo.pop())) if is_folder]
            except Exception:  # no permission, a lost mount, a folder that went away: not the same as an empty one
                return False
        return True

    with ThreadPoolExecutor(16) as pool:
        whole = dict(zip(projects, pool.map(is_whole, projects), strict=True))
    return [p for p in projects if whole[p]], [p.rstrip("/").rsplit("/", 1)[-1] for p in projects if not whole[p]]


def read_lines(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(source_key, project, line_no, raw, bytes, complete) of ``<root>/<project>/**/*.jsonl``, by Spark's splittable text
    source: a file of any size is read by as many tasks as it has blocks. ``paths``: the projects to be read (default: all).

    A line's number is that of its block's first line plus its place in the block; block sizes are counted first, a row
    for each block. ``complete`` is false for a last line without a newline; ``bytes`` counts the newline.
    """
    if paths is not None and not paths:
        return spark.createDataFrame([], "source_key string, project string, line_no long, raw string, bytes int, complete boolean")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(paths or root)
    numbered = number_lines(text, source_key(root, F.col("_metadata.file_path")))
    return numbered.select("source_key", F.substring_index("source_key", "/", 1).alias("project"), "line_no", "raw", "bytes", "complete")


def number_lines(text: DataFrame, key: Column) -> DataFrame:
    """(source_key, line_no, raw, bytes, complete) of files that Spark's text source reads, numbered from 0 within each file;
    ``key`` names a file by its ``_metadata``."""
    rows = text.select(
        key.alias("source_key"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").alias("raw"), (F.octet_length("value") + 1).alias("bytes"),
    )
    blocks = rows.groupBy("source_key", "block").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("block_bytes"), F.max("size").alias("size"))
    before = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_key")
    starts = written(
        blocks.select(
            "source_key", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"), F.sum("lines").over(whole).alias("file_lines"),
            (F.sum("block_bytes").over(whole) <= F.col("size")).alias("ends"),
        )
    )
    numbered = rows.join(starts, ["source_key", "block"]).withColumn("line_no", F.col("base") + F.col("nth") - F.col("first"))
    return numbered.select("source_key", "line_no", "raw", "bytes", (F.col("ends") | (F.col("line_no") < F.col("file_lines") - 1)).alias("complete"))


def source_key(root: str, path: Column) -> Column:
    base = root.rstrip("/").removeprefix("file://") + "/"
    return F.substring_index(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), base, -1)


def tails(lines: DataFrame, done: DataFrame) -> DataFrame:
    """Lines beyond what the cursors in ``done`` (source_key, processed_lines) cover, without empty ones; ``raw`` is null
    for an incomplete one."""
    joined = lines.join(done.select("source_key", "processed_lines"), "source_key", "left")
    new = joined.where((F.col("line_no") >= F.coalesce("processed_lines", F.lit(0))) & (F.col("raw") != ""))
    return new.select("source_key", "project", F.col("line_no").cast("int").alias("line_no"), F.when(F.col("complete"), F.col("raw")).alias("raw"))


def _digest_sums(counted: Column) -> list[Column]:
    """Sums of 120 bits of SHA-256 over each counted line with its number, in two halves. Partial sums add up, so a file's
    prefix is never gathered in one place."""
    digest = F.sha2(F.concat_ws(":", F.col("line_no").cast("string"), F.col("raw")), 256)
    return [F.sum(F.when(counted, F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))) for at in (1, 16)]


def _checksum(counted: Column) -> Column:
    """A digest of the lines that count."""
    return F.concat_ws("-", *[s.cast("string") for s in _digest_sums(counted)])


def found_sources(lines: DataFrame, scan_state: DataFrame) -> DataFrame:
    """(source_key, project, size, lines, prefix_hash, whole_hash): complete bytes and lines of each file, the checksum of
    as many lines as its stored cursor covers, and that of all."""
    state = scan_state.select("source_key", "processed_lines")
    joined = lines.join(state, "source_key", "left")
    covered = F.col("complete") & (F.col("line_no") < F.coalesce("processed_lines", F.lit(0)))
    return joined.groupBy("source_key", "project").agg(
        F.sum(F.when(F.col("complete"), F.col("bytes")).otherwise(0)).alias("size"), F.count_if("complete").alias("lines"), _checksum(covered).alias("prefix_hash"), _checksum(F.col("complete")).alias("whole_hash")
    )


def cursors(found: DataFrame) -> DataFrame:
    """(source_key, project, prefix_hash, processed_bytes, processed_lines): up to each file's last newline."""
    return found.select("source_key", "project", F.col("whole_hash").alias("prefix_hash"), F.col("size").alias("processed_bytes"), F.col("lines").alias("processed_lines"))


def cursors_at(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cursors within files: source_key, project, prefix_hash, processed_bytes, processed_lines, batch. ``cuts``: source_key,
    batch, cut (how many lines are covered). Every line is looked at once and counts for its stretch between two cuts;
    stretches add up."""
    per = cuts.groupBy("source_key").agg(F.sort_array(F.collect_list(F.struct("cut", "batch"))).alias("cuts"))  # a row for each batch of a source
    own = lines.join(per, "source_key").withColumn("stretch", F.size(F.filter("cuts", lambda c: c["cut"] <= F.col("line_no"))))
    first, second = _digest_sums(F.col("complete"))
    sums = own.groupBy("source_key", "project", "cuts", "stretch").agg(first.alias("a"), second.alias("b"), F.sum("bytes").alias("bytes"))
    upto = Window.partitionBy("source_key").orderBy("stretch")
    told = sums.select("source_key", "project", "cuts", "stretch", *[F.sum(c).over(upto).alias(c) for c in ("a", "b", "bytes")]).where(F.col("stretch") < F.size("cuts"))
    at = F.get("cuts", F.col("stretch"))
    return told.select("source_key", "project", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("prefix_hash"), F.col("bytes").alias("processed_bytes"), at["cut"].cast("long").alias("processed_lines"), at["batch"].alias("batch"))


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _string(value: Column, path: str) -> Column:
    """The string at a path; null for anything else, numbers included."""
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def _clip(value: Column) -> Column:
    return F.when(F.length(value) > TOOL_CLIP, F.concat(F.substring(value, 1, TOOL_CLIP), F.lit("…"))).otherwise(value)


def tool_summary(block: Column) -> Column:
    """A tool call's name and the listed fields of its input, each on one line and clipped; empty ones are left out."""
    fields = []
    for f in TOOL_FIELDS:
        told = _string(block, f"$.input.{f}")
        fields.append(F.when(told != "", F.concat(F.lit(f" {f}="), _clip(F.replace(told, F.lit("\n"), F.lit(" "))))).otherwise(""))
    return F.concat(F.lit("⟨tool "), F.coalesce(_string(block, "$.name"), F.lit("?")), *[F.coalesce(f, F.lit("")) for f in fields], F.lit("⟩"))


def _block_text(block: Column) -> Column:
    """What a block tells: its text, a tool call's summary, whether a tool's result is an error (its content is not told)."""
    kind = _string(block, "$.type")
    failed = F.coalesce(F.try_variant_get(block, "$.is_error", "boolean"), F.lit(False))
    result = F.when(failed, "⟨tool_result error⟩").otherwise("⟨tool_result ok⟩")
    return F.when(kind == "text", _string(block, "$.text")).when(kind == "tool_use", tool_summary(block)).when(kind == "tool_result", result)


def classify(lines: DataFrame) -> DataFrame:
    """Each line as a turn (text, ts, ...) or with a ``skip_reason``. The order of checks decides the reason; fields of
    another type than theirs count as missing. An array of content with anything but objects in it has no text."""
    record = F.col("record")
    rows = lines.withColumn("record", F.try_parse_json("raw"))
    rows = rows.select(
        "source_key", "project", "line_no", "raw", "record", _string(record, "$.type").alias("type"), _string(record, "$.uuid").alias("uuid"), _string(record, "$.sessionId").alias("session_id"),
        _string(record, "$.timestamp").alias("time"), _kind(record, "$.message").startswith("OBJECT").alias("has_message"), _string(record, "$.message.role").alias("role"),
        _string(record, "$.message.content").alias("plain"), F.when(_kind(record, "$.message.content").startswith("ARRAY"), F.try_variant_get(record, "$.message.content", "array<variant>")).alias("blocks"),
    )
    all_objects = F.forall("blocks", lambda b: F.coalesce(F.schema_of_variant(b).startswith("OBJECT"), F.lit(False)))
    rows = rows.withColumn("blocks", F.when(all_objects, F.col("blocks")))
    told = F.array_join(F.filter(F.transform("blocks", _block_text), lambda t: F.coalesce(t != "", F.lit(False))), "\n")
    rows = rows.withColumn("text", F.coalesce("plain", told, F.lit(""))).withColumn("ts", F.when(F.col("time").rlike(_TIME), F.try_to_timestamp("time")))
    kind = lambda b: F.coalesce(_string(b, "$.type"), F.lit(""))
    speaks = lambda b: (kind(b) == "tool_use") | ((kind(b) == "text") & (F.coalesce(normalise_space(_string(b, "$.text")), F.lit("")) != ""))
    only_results = F.coalesce(F.exists("blocks", lambda b: kind(b) == "tool_result") & ~F.exists("blocks", speaks), F.lit(False))
    shape = "^[A-Za-z0-9._-]{1,64}$"
    reason = (
        F.when(F.col("raw").isNull(), "incompleteTrailingRecord")
        .when(F.col("record").isNull() | ~F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)), "unparseableLine")
        .when(~F.coalesce(F.col("type").isin("user", "assistant"), F.lit(False)), "notATurn")
        .when(F.col("uuid").isNull() | F.col("session_id").isNull() | F.col("ts").isNull(), "missingPointerField")
        .when(~F.col("uuid").rlike(shape) | ~F.col("session_id").rlike(shape), "malformedIdentifier")
        .when(~F.coalesce("has_message", F.lit(False)), "notATurn")
        .when(normalise_space(F.col("text")) == "", "noIndexableText")
        .when(only_results, "toolResultOnly")
    )
    return rows.select("source_key", "project", "line_no", "uuid", "session_id", "ts", F.coalesce("role", "type").alias("role"), "text", reason.alias("skip_reason"))


def turns(classified: DataFrame) -> DataFrame:
    """The turns among classified lines, as ``operators.index.build_chunks`` takes them. ``seq`` orders observations by
    what they say, time and line, so a chunk's last observation is the same however its sources were read."""
    seq = F.concat_ws(":", F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("line_no").cast("string"), 9, "0"))
    return classified.where("skip_reason is null").select("project", fingerprint(F.col("project")).alias("project_fingerprint"), "uuid", "source_key", "session_id", "ts", "role", "text", seq.alias("seq"))


def skip_tally(classified: DataFrame) -> DataFrame:
    return classified.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))
