"""Line dedup by a fixed-depth template tree, in DataFrame operations only.

A line goes down the tree by its token count and then by its leading tokens, as
deep as half of them (five at least, or all of a shorter line).  Tokens with a
digit or an at sign are variable fields and read as ``<*>``; what lies below the
leaf is generalised as well.  The leaf is the line's template.  Tokens are what
single blanks part, after blanks, tabs and carriage returns at both ends went.

A template recurs when it stands in enough unrelated documents.  Documents count
by a signature: their rarest line, when it is in at most half as many documents
as the template.  A line counts as often as its beginning or its end (four tokens
each), whichever is in more documents, so an edit at one place of a copy makes no
rare line.  The lines of a shared passage are all in as many documents, so none of
them is a signature, and unrelated documents bring one each.  Of the groups of
copies that hold a template only one can be more than half of its documents; that
one, like any document without a rare line, counts by the other line whose
beginning is in the most documents, which copies have in common; lines without
fields go before those with fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import sized, text_of, written

MIN_DOCUMENTS = 5
MIN_TOKENS = 3
# Smaller leaves of the tree: depth is the larger of this and half the tokens.
MIN_DEPTH = 5
START_TOKENS = 4
# A document counts by its rarest line when the template is in at least this many times as many documents.
RARER = 2
FIELD = "(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*"


def _hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def _masked(text: Column) -> Column:
    return F.when(text.rlike("[0-9@]"), F.regexp_replace(text, FIELD, "<*>")).otherwise(text)


def _templates(lines: DataFrame, line: str) -> DataFrame:
    """Add _key, the leaf of the line: a hash of its token count and leading tokens; null for a line of under MIN_TOKENS tokens.

    One step per select, so that no step is computed twice.
    """
    n = F.length("_plain") - F.length(F.replace("_plain", F.lit(" "), F.lit(""))) + 1
    depth = F.greatest(F.lit(MIN_DEPTH), F.ceil(F.col("_n") / 2).cast("int"))
    key = F.when(F.col("_n") >= MIN_TOKENS, _hash(F.concat_ws(" ", F.col("_n").cast("string"), F.col("_lead"))))
    return (
        lines.withColumn("_plain", F.btrim(F.col(line), F.lit(" \t\r")))
        .withColumn("_n", n)
        .withColumn("_lead", F.call_function("substring_index", F.col("_plain"), F.lit(" "), depth))
        .withColumn("_lead", _masked(F.col("_lead")))
        .withColumn("_key", key)
        .drop("_n", "_lead")
    )


def _lines(documents: DataFrame) -> DataFrame:
    """One row per document: its lines as (key, start, first, last); lines without a template are left out.

    ``start`` is a hash of the beginning, ``first`` and ``last`` are hashes of the beginning and the end with fields masked.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), text_of().alias("_text"))
    parts = rows.select("_row", F.explode(F.split("_text", "\n")).alias("_line"))
    known = _templates(parts, "_line").where(F.col("_key").isNotNull())
    ends = known.select("_row", "_key", F.substring_index("_plain", " ", START_TOKENS).alias("_start"), F.substring_index("_plain", " ", -START_TOKENS).alias("_last"))
    line = F.struct(
        F.col("_key").alias("key"),
        F.xxhash64("_start").alias("start"),
        F.xxhash64(_masked(F.col("_start"))).alias("first"),
        F.xxhash64(_masked(F.col("_last")), F.lit(1)).alias("last"),
    )
    return ends.select("_row", line.alias("_part")).groupBy("_row").agg(F.collect_set("_part").alias("lines"))


def recurring(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Templates (key, documents) that stand in at least ``min_documents`` documents of different signature."""
    found = written(_lines(documents))
    every = found.select(F.explode(F.array_distinct("lines.key")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = sized(written(every.where(F.col("n") >= min_documents)))
    ends = found.select(F.explode(F.array_distinct(F.concat("lines.first", "lines.last"))).alias("end")).groupBy("end").agg(F.count("*").alias("n"))
    shared = sized(written(ends.where(F.col("n") > 1)))

    # The rarest line of each document, and the two of the commonest beginnings; an end that is not in the table is in one document.
    each = found.select("_row", F.explode("lines").alias("line")).select("_row", "line.start", "line.first", "line.last")
    for end in ("first", "last"):
        each = each.join(shared.select(F.col("end").alias(end), F.col("n").alias(f"n_{end}")), end, "left")
    n = F.greatest(F.coalesce("n_first", F.lit(1)), F.coalesce("n_last", F.lit(1)))
    common = F.when(F.col("n_first").isNotNull(), F.struct((F.col("start") == F.col("first")).alias("plain"), "n_first", "start"))
    told = each.groupBy("_row").agg(F.min(F.struct(n.alias("n"), "first", "last")).alias("rarest"), F.collect_set(common).alias("common"))
    told = told.select("_row", "rarest", F.slice(F.sort_array("common", asc=False), 1, 2)["start"].alias("common"))

    lines = found.select("_row", F.explode("lines").alias("line")).select("_row", "line.key", "line.start").join(often, "key")
    one, two = (F.coalesce(F.try_element_at("common", F.lit(i)), F.lit(0)) for i in (1, 2))
    other = F.when(one == F.col("start"), two).otherwise(one)
    rare = F.xxhash64("rarest.first", "rarest.last")
    signature = F.when(F.col("rarest.n") * RARER <= F.col("n"), rare).otherwise(other)
    seen = lines.join(told, "_row").select("key", signature.alias("signature")).groupBy("key", "signature").agg(F.lit(1).alias("one"))
    return seen.groupBy("key").agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents)


def dedup(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``documents`` with all lines of recurring templates taken out of ``text``, plus n_lines and n_dropped.

    Every row stays, with its other columns as they were; a text all of whose
    lines recur becomes empty, a null text stays null with no lines, and lines
    of under three tokens always stay.  Repeated rows and null ids are rows like
    any other.  The added columns replace columns of the same names.
    """
    templates = sized(written(recurring(documents, min_documents)).select(F.col("key").alias("_key"), F.lit(True).alias("_drop")))
    others = [c for c in documents.columns if c not in ("text", "n_lines", "n_dropped")]
    numbered = documents.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(f"`{c}`") for c in others], F.col("text").isNull().alias("_null")).alias("_rest"),
        F.split(text_of(), "\n").alias("_lines"),
    )
    row = numbered.select("_row", "_rest", F.posexplode("_lines").alias("_at", "_line"))
    lines = _templates(row, "_line").withColumn("_rest", F.when(F.col("_at") == 0, F.col("_rest"))).drop("_plain")
    kept = lines.join(templates, "_key", "left").select(
        "_row", "_rest", F.struct("_at", F.when(F.col("_drop").isNull(), F.col("_line")).alias("_line")).alias("_part")
    )
    whole = kept.groupBy("_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"), F.array_sort(F.collect_list("_part")).alias("_parts"))
    left = F.filter("_parts", lambda p: p["_line"].isNotNull())
    out = whole.select(
        *[F.col(f"_rest.`{c}`").alias(c) for c in others],
        F.when(~F.col("_rest._null"), F.array_join(F.transform(left, lambda p: p["_line"]), "\n")).alias("text"),
        F.when(F.col("_rest._null"), F.lit(0)).otherwise(F.size("_parts")).alias("n_lines"),
        (F.size("_parts") - F.size(left)).alias("n_dropped"),
    )
    return out.select(*[c for c in documents.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
