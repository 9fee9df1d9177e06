"""Line-first quality rules, as Column expressions only.

Every line of a text is tested by itself: does it end like a sentence, is it navigation, is it
boilerplate, is it shouted or full of symbols.  Failing lines are removed, and a document that loses
too much of its text this way, or fails the base rules, is rejected.

Defined results: a null text has no words, fails the base rules and cleans to an empty text; lines
without a word are dropped silently and count for nothing; repeated rows and repeated ids are judged one by
one; the columns of the input travel in one struct, so no name of theirs can clash.  Windows are compared by
64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.tables import SPACE, WORD, word_list

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_LOST_PERCENT = 50

#: Characters that may end a line of prose, closing quotes and brackets included.
LINE_END = r"""[.!?:;,\x{2026}\x{3002}\x{ff01}\x{ff1f}]["'\x{201d}\x{2019}\x{00bb})\]]*[\x20\x09-\x0D]*$"""
SYMBOLS = r"[#*$%&|<>]"
#: Menu separators between words, or a line that is one link or page control.
NAVIGATION = r"(?i)(\S\x20+[|\x{00bb}\x{203a}\x{00b7}\x{2022}]\x20+.*){2}|^\x20*(home|menu|next|previous|back to top|skip to content|log ?in|sign ?up|read more|share this)\x20*$"
BOILERPLATE = (
    r"(?i)\b(all rights reserved|cookie policy|we use cookies|accept cookies|privacy policy|terms of (use|service)"
    r"|enable javascript|javascript is (disabled|required)|subscribe to our newsletter|lorem ipsum"
    r"|click here|powered by|page not found)\b"
)


def line_fails(line: Column) -> Column:
    """Whether a line with at least one word breaks a line rule."""
    n = F.regexp_count(line, F.lit(WORD))
    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    return (
        ~line.rlike(LINE_END)
        | line.rlike(NAVIGATION)
        | (line.rlike(SYMBOLS) & (symbols * 5 >= n))
        | (line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}") & (n >= 4))
        | line.rlike(BOILERPLATE)
    )


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _windows(a: Column, size: int) -> Column:
    """Hash of every ``size`` neighbouring elements."""
    starts = F.slice(a, F.lit(1), F.greatest(F.size(a) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda _, i: F.xxhash64(F.slice(a, i + 1, F.lit(size))))


def with_quality(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows of ``docs`` as the struct ``row``, their measures, ``clean_text`` and the verdict ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.struct(*docs.columns).alias("row"), body.alias("body"), word_list(text).alias("words"))
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
            "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")),
        }
    )
    # only texts that repeat a window go on
    out = out.withColumn("windows", _windows(F.col("hashes"), WINDOW)).drop("hashes")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(repeats, placed)).drop("windows")
    same = F.zip_with("placed", _shifted(F.col("placed"), 1), lambda a, b: F.coalesce(a.h == b.h, F.lit(False)))
    out = out.withColumn("same", same)
    # in hash order a window is repeated if it equals the next or the one before
    either = F.zip_with("same", F.concat(F.array(F.lit(False)), F.col("same")), lambda a, b: a | b)
    out = out.withColumn("either", either)
    hit = F.zip_with("placed", "either", lambda p, e: F.when(e, p.i))
    out = out.withColumn("at", F.sort_array(F.array_compact(hit))).drop("placed", "same", "either")
    steps = F.zip_with("at", _shifted(F.col("at"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
            "clean_text": F.array_join(F.filter("lines", lambda x: ~line_fails(x)), "\n"),
        }
    ).drop("body", "words", "lines", "at")
    out = out.withColumn("n_words_lost", F.col("n_words") - F.regexp_count("clean_text", F.lit(WORD)))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = out.withColumn("base_failed", failed)
    lost = F.col("n_words_lost") * 100 > F.col("n_words") * max_lost_percent
    return out.withColumn("kept", ~F.col("base_failed") & ~lost)


def clean_documents(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Documents that pass, without their failing lines; same columns as ``docs``."""
    judged = with_quality(docs, max_lost_percent=max_lost_percent)
    # a projection with a running number is not repeated inside the filter, where every measure would be worked out again
    judged = judged.withColumn("at", F.monotonically_increasing_id()).filter("kept AND at >= 0")
    changed = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.select([changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
