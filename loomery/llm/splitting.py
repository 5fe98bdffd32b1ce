"""Splitting oversized texts at natural boundaries, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as str.isspace has it.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CLOSERS = r"\"')\]}»”’*_`"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def boundary_pattern(limit: int, least: int) -> str:
    """A regex whose successive matches are segments of at most ``limit`` characters.

    The alternatives are tried from the strongest boundary to the weakest, each with a bounded quantifier that takes
    as much as fits: the end of the text, a heading or blank line, a line, a sentence, a clause, white space, and last
    any character. The strong boundaries must leave a segment of at least half or a third of the limit, all at least
    ``least`` characters.
    """
    half, third = max(least, limit // 2), max(least, limit // 3)
    gap = rf"[^\S\r\n]*(?:\r\n|\n|\r)"
    return "(?s)" + "|".join(
        [
            rf".{{1,{limit}}}\z",
            rf".{{{half},{limit - 4}}}{gap}{gap}(?![^\S\r\n]*[\r\n])",
            rf".{{{half},{limit - 2}}}\n(?=#{{1,6}} )",
            rf".{{{third},{limit - 2}}}(?:\r\n|\n|\r(?!\n))",
            rf".{{{third},{limit - 4}}}[.!?…。！？][{CLOSERS}]{{0,2}}[{SPACE}]",
            rf".{{{third},{limit - 2}}}[,;:][{SPACE}]",
            rf".{{{least},{limit - 1}}}[{SPACE}]",
            rf".{{1,{limit}}}",
        ]
    )


def segments(text: Column, limit: int, overlap: int) -> Column:
    """Consecutive parts of ``text`` that add up to it; all but the last are longer than ``overlap``."""
    return F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap, overlap + 1)), F.lit(0))


def split_oversized(df: DataFrame, text: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Rows whose trimmed ``text`` is over ``limit`` code points, as numbered pieces of at most ``limit``.

    Adds ``piece_no`` (from 0), ``start_pos`` (place of the piece in the trimmed text, from 1), ``piece``, ``cut``
    (``space`` when the piece ends at white space or the end, ``forced`` when inside unbroken text) and ``forced`` (1
    when the text has more than ``limit`` characters in a row without white space). Each piece after the first begins
    with the last ``overlap`` characters of the one before; without those, the pieces add up to the trimmed text.

    Null, empty and blank texts and those within the limit give no rows. Repeated rows give repeated pieces. Other
    columns pass through; columns named like the added ones are replaced.
    """
    if not 0 <= overlap < limit // 2 or limit < 20:
        raise ValueError("overlap must be at least 0 and under half of the limit, the limit at least 20")
    added = {"piece_no", "start_pos", "piece", "cut", "forced"}
    kept = [c for c in df.columns if c not in added]
    long = df.withColumn("__text", trim_space(F.col(text))).where(F.length("__text") > limit)
    run = rf"[^{SPACE}]{{{limit + 1}}}"
    long = long.withColumn("__forced", F.col("__text").rlike(run).cast("int")).withColumn("__parts", segments(F.col("__text"), limit, overlap))
    head = F.when(F.size("__parts") > 0, F.transform("__parts", lambda s: F.length(s)))
    long = long.withColumn("__sizes", head)
    begin = F.transform(
        F.col("__parts"),
        lambda s, i: F.struct(
            i.alias("no"),
            F.when(i > 0, F.concat(F.right(F.get("__parts", i - 1), F.lit(overlap)), s)).otherwise(s).alias("piece"),
            F.when(s.rlike(rf"[{SPACE}]\z") | (i == F.size("__parts") - 1), "space").otherwise("forced").alias("cut"),
            F.get("__sizes", i).alias("size"),
        ),
    )
    ends = F.aggregate(
        "__sizes",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
    )["all"]
    zipped = F.arrays_zip(begin.alias("p"), ends.alias("at"))
    out = long.select(*kept, F.col("__forced").alias("forced"), F.explode(zipped).alias("__z"))
    start = F.when(F.col("__z.p.no") > 0, F.col("__z.at") - overlap).otherwise(1)
    return out.select(
        *kept, F.col("__z.p.no").alias("piece_no"), start.alias("start_pos"), F.col("__z.p.piece").alias("piece"), F.col("__z.p.cut").alias("cut"), "forced"
    )
