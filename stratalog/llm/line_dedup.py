"""Lines that earlier documents hold already, with DataFrame functions alone.

Keys of lines are hashed to 128 bits and range-partitioned by hash and a salt
of the document, with a secondary sort by document and position. A window
streams each stripe and marks its first document; what another document of the
stripe holds is dropped there and then. Only the stripes' first documents are
compared across salts, so a line that a third of all documents share is split
over ``salts`` tasks, and its comparison has ``salts`` rows at most for each
repeat within one document. The result is a compressed bitmap for each
document and never its text.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are always kept; in the smallest document that holds
a key all its lines stay; repeated rows with one id count as one document; a
row without an id takes no part and keeps its lines; other columns are passed
on, but for those that have the name of a result, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, ascii_lower, stage


def _key(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(id, pos, h1, h2)`` of the lines whose keys are long enough."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    keyed = lines.select("id", "pos", _key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, salts: int) -> DataFrame:
    """``(id, pos)`` of the lines to drop."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written first: range partitioning reads its input twice, once to find the bounds
    lines = stage(line_table(docs, id_col, text_col, min_chars), "lines")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    stripe = Window.partitionBy("h1", "h2", "salt").orderBy("id", "pos")
    ranged = salted.repartitionByRange(n, "h1", "h2", "salt").withColumn(
        "first", F.first("id").over(stripe.rowsBetween(Window.unboundedPreceding, 0))
    )
    ranged = stage(ranged, "stripes")
    # one row for each stripe; the smallest first document of a key is the one that keeps it
    heads = ranged.where("id = first").groupBy("h1", "h2", "salt").agg(F.min("first").alias("first"))
    least = heads.groupBy("h1", "h2").agg(F.min("first").alias("least"), F.count("*").alias("stripes")).where("stripes > 1")
    late = heads.join(least, ["h1", "h2"]).where("first <> least").select("h1", "h2", "salt")
    return (
        ranged.where("id <> first")
        .select("id", "pos")
        .union(ranged.where("id = first").join(late, ["h1", "h2", "salt"], "left_semi").select("id", "pos"))
    )


def _kept_runs(gone: Column, n_lines: Column) -> Column:
    """``(begin, length)`` of the runs of kept lines, before, between and after the runs of dropped ones.

    Neighbours are read by index, so that the work grows with the lines of a
    text. Only the first and the last run can be empty.
    """
    begins = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != x + 1))
    from_ = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    return F.zip_with(from_, F.concat(begins, F.array(n_lines)), lambda a, b: F.struct(a.alias("begin"), (b - a).alias("length")))


def _keep_runs(kept: Column) -> Column:
    """A bitmap of lines as run lengths: kept, dropped, kept, and so on, from 0."""
    pairs = F.transform(
        kept,
        lambda x, i: F.when(i == 0, F.array(x["length"])).otherwise(
            F.array(x["begin"] - F.get(kept, i - 1)["begin"] - F.get(kept, i - 1)["length"], x["length"])
        ),
    )
    return F.flatten(pairs)


def dropped_positions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = 64
) -> DataFrame:
    """``(id, dropped)``: sorted positions; only documents that lose lines have a row."""
    gone = dropped_lines(docs, id_col, text_col, min_chars, salts)
    return gone.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = 64
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``keep_runs`` and ``kept_text``.

    ``keep_runs`` is the compressed bitmap: lengths of alternating runs of
    kept and dropped lines, the first of them kept. ``kept_text`` applies it.
    """
    gone = dropped_positions(docs, id_col, text_col, min_chars, salts)
    results = ("n_lines", "n_dropped", "keep_runs", "kept_text")
    rest = [c for c in docs.columns if c not in (id_col, text_col, *results)]
    # other columns travel in a struct, where their names cannot clash with those used here
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(id_col).alias("key"),
        F.col(text_col).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if rest else []),
    )
    joined = slim.join(gone, "id", "left").select(
        "*",
        F.coalesce(F.split("text", "\n"), F.array(F.lit(""))).alias("lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("gone"),
    )
    joined = joined.withColumn("kept", _kept_runs(F.col("gone"), F.size("lines")))
    # by data frame and not by name, as a result may bear the name of a column read here
    text, lines, gone, runs = joined["text"], joined["lines"], joined["gone"], joined["kept"]
    kept = F.when(F.size(gone) == 0, F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.flatten(F.transform(runs, lambda x: F.slice(lines, x["begin"] + 1, x["length"]))), "\n")
    )
    named = {id_col: joined["key"], text_col: text} | {c: joined["row"].getField(c) for c in rest}
    return joined.select(
        *[named[c].alias(c) for c in docs.columns if c in named],
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        _keep_runs(runs).alias("keep_runs"),
        kept.alias("kept_text"),
    )
