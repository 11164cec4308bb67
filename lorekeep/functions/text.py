"""Text functions as column expressions: normal forms, tokens, phrase counts, query classes, identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges that count as CJK for segmentation (kana and hangul included), and as Han for query classes.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{20000}-\x{2FA1F}]"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"


def normalise_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Characters that a canonical composition may change, alone or with the one before: marks, Hangul jamo, and those that stand for
#: others. A superset is enough: texts that hold none of these are in normal form as they are.
MAY_COMPOSE = (
    r"[\p{M}\x{0374}\x{037E}\x{0387}\x{0958}-\x{0FFF}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}"
    r"\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{11000}-\x{11FFF}\x{16100}-\x{16FFF}\x{1D15E}-\x{1D1FF}\x{2F800}-\x{2FA1F}]"
)


def nfc(text: Column) -> Column:
    """Canonical composition, for which Spark has no function: texts that it can't change stay in the JVM."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    asked = text.rlike(MAY_COMPOSE)
    return F.when(asked, of(F.when(asked, text))).otherwise(text)


def normal_form(text: Column) -> Column:
    """Canonical composition, then runs of Unicode white space as one space, ends trimmed; null counts as empty."""
    return normalise_space(nfc(F.coalesce(text, F.lit(""))))


def flatten_clip(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters and an ellipsis."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def span_slice(text: Column, lo: Column, hi: Column) -> Column:
    """Characters [lo, hi); null where that is out of bounds or empty."""
    return F.when((lo >= 0) & (hi > lo) & (hi <= F.length(text)), F.substring(text, lo.cast("int") + 1, (hi - lo).cast("int")))


def is_identifier(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._-]{1,64}$")


def is_fingerprint(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{32}$")


def fingerprint(name: Column) -> Column:
    """The first 32 hex digits of a name's SHA-256."""
    return F.substring(F.sha2(name, 256), 1, 32)


def project_of_directory(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("-"))


def script_runs(text: Column) -> Column:
    """Stretches of CJK and of other characters in turn, as structs (run, is_cjk); together they are the text."""
    other = f"[^{CJK[1:]}"
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}+|{other}+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(r.alias("run"), F.substring(r, 1, 1).rlike(CJK).alias("is_cjk")))


def query_class(query: Column) -> Column:
    """cjk-2char, cjk-3char, cjk-4plus, latin-alnum or mixed, by counts of Han characters and ASCII letters and digits."""
    han, ascii_ = F.regexp_count(query, F.lit(HAN)), F.regexp_count(query, F.lit("[A-Za-z0-9]"))
    return (
        F.when((han > 0) & (ascii_ > 0), "mixed").when(han == 0, "latin-alnum").when(han <= 2, "cjk-2char").when(han == 3, "cjk-3char").otherwise("cjk-4plus")
    )


def strip_reminders(prompt: Column) -> Column:
    return F.trim(F.regexp_replace(prompt, r"(?s)<system-reminder>.*?</system-reminder>", ""))


def gate(prompt: Column, cues: list[str], synthetic: list[str], mode: Column | None = None) -> Column:
    """What a prompt hook does: ``synthetic`` (by prefix), ``hit`` (a cue matches) or ``miss``. ``mode`` is ``cued``, ``always`` (all
    but synthetic prompts are hits) or ``off`` (which is the answer, too); anything else counts as ``cued``."""
    own = strip_reminders(prompt)
    is_synthetic, is_hit = F.lit(False), F.lit(False) if mode is None else F.coalesce(mode == "always", F.lit(False))
    for prefix in synthetic:
        is_synthetic = is_synthetic | own.startswith(prefix)
    for cue in cues:
        is_hit = is_hit | own.rlike(cue)
    told = F.when((own == "") | is_synthetic, "synthetic").when(is_hit, "hit").otherwise("miss")
    return told if mode is None else F.when(F.coalesce(mode == "off", F.lit(False)), "off").otherwise(told)


def derived_query(text: Column, seed: int) -> Column:
    """A known-item query from a text: an inner stretch of two to four characters of a Han run, else a word of at
    least four letters or digits, else null. Picked by a hash of the text, so the same every time."""

    def pick(n: Column, salt: str) -> Column:
        digits = F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}{salt}"), text), 256), 1, 8)
        return F.pmod(F.conv(digits, 16, 10).cast("long"), F.greatest(n, F.lit(1)))

    runs = F.filter(F.regexp_extract_all(text, F.lit(f"({HAN}{{3,}})"), F.lit(1)), lambda r: F.length(r) > 2)
    run = F.get(runs, pick(F.size(runs), "run").cast("int"))
    size = F.least(F.lit(4), F.length(run) - 1, 2 + pick(F.lit(3), "size")).cast("int")
    inner = F.substring(run, (1 + pick(F.length(run) - size + 1, "at")).cast("int"), size)
    words = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]{4,})"), F.lit(1)), lambda w: w != F.trim(text))
    return F.when(F.size(runs) > 0, inner).otherwise(F.get(words, pick(F.size(words), "word").cast("int")))
