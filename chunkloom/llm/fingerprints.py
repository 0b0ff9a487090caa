"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases, built by SQL functions only.

A paragraph is a line. A section is a run of paragraphs that ends with a blank line, or with a paragraph whose digest
says so (one in four), so that an edit moves no borders beyond its own section. Phrases are the pieces of a sentence, of
WORDS words at most. Each paragraph's digest covers its text, each section's its paragraphs, and the root its sections.

The fingerprint is text: the root, then each section as /digest, then its paragraphs as ;digest:phrase,phrase,...
Equal roots mean equal texts. Otherwise equal sections and then equal paragraphs are passed over, and what is left shows
where the texts differ. Phrase digests have 32 bits, paragraph and section digests 128 and the root 256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = 6


def phrases(paragraph: Column) -> Column:
    """Pieces of a line whose concatenation is the line: cut after sentence ends, then after every WORDS words."""
    sentences = F.split(paragraph, r"(?<=[.!?][\x20\t])")
    return F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(rf"\s*+(?:\S++\s*+){{1,{WORDS}}}|\s++"), F.lit(0))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text (null: of the empty text)."""
    lines = F.split(F.coalesce(text, F.lit("")), r"(?<=\n)")

    def paragraph(line: Column) -> Column:
        own = F.md5(line.cast("binary"))
        leaves = F.array_join(F.transform(phrases(line), lambda p: F.substring(F.md5(p.cast("binary")), 1, 8)), ",")
        ends = line.isin("\n", "\r\n") | F.substring(own, 1, 1).isin("0", "1", "2", "3")
        return F.concat(F.lit(";"), own, F.lit(":"), leaves, F.when(ends, F.lit("/")).otherwise(F.lit("")))

    body = F.regexp_replace(F.array_join(F.transform(lines, paragraph), ""), "/$", "")
    sections = F.transform(F.split(body, "/"), lambda s: F.concat(F.md5(s.cast("binary")), s))
    joined = F.array_join(sections, "/")
    return F.concat(F.sha2(F.array_join(F.transform(F.split(joined, "/"), lambda s: F.substring(s, 1, 32)), ""), 256), F.lit("/"), joined)


def root(mark: Column) -> Column:
    """The root of a fingerprint; equal exactly for equal texts."""
    return F.substring_index(mark, "/", 1)


def leaves(mark: Column) -> Column:
    """Distinct phrase digests of a fingerprint."""
    return F.array_distinct(F.filter(F.split(mark, "[,:;/]"), lambda x: F.length(x) == 8))


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct phrases that two fingerprints have in common, of those in either; 1 for equal roots."""
    both, either = F.size(F.array_intersect(leaves(a), leaves(b))), F.size(F.array_union(leaves(a), leaves(b)))
    return F.when(root(a) == root(b), F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(both / either)


def differing(a: Column, b: Column) -> Column:
    """Paragraphs (from 0, in a) whose digests b lacks; sections that b has too are passed over without a look inside."""
    theirs = F.transform(F.split(b, "/"), lambda s: F.substring(s, 1, 32))
    known = F.filter(F.split(b, "[:;/]"), lambda x: F.length(x) == 32)
    flat = F.flatten(F.transform(F.slice(F.split(a, "/"), 2, 1 << 30), lambda s: F.transform(
        F.slice(F.split(s, ";"), 2, 1 << 30), lambda p: ~F.array_contains(theirs, F.substring(s, 1, 32)) & ~F.array_contains(known, F.substring(p, 1, 32)))))
    at = F.transform(flat, lambda x, i: F.when(x, i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.filter(at, lambda i: i.isNotNull()))


def with_next(df: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """df (id, text) with next_text: the text of the next row by descending id, after the last the first.

    Rows with equal ids follow one another by text; a null id comes last (rows without an id share a task). Rows are dealt out once, by ranges of ids; the
    first row of each range is also sent to the range above, whose last row it follows. Only the ranges' borders and
    largest ids reach the driver. Also returns the window, within which rows stay in order, and the column `own` tells
    rows from those copies.
    """
    spark = df.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    got = df.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"]
    borders = sorted(set(got or []))
    wide = max(1, int(len(borders) ** 0.5))
    rows = [borders[i : i + wide] for i in range(0, len(borders), wide)]
    coarse = F.lit([r[0] for r in rows]) if rows else None
    nested = F.array(*[F.lit(r) for r in rows]) if rows else None
    if rows:
        c = F.size(F.filter(coarse, lambda b: b <= key))
        bucket = F.when(c == 0, 0).otherwise((c - 1) * wide + F.size(F.filter(F.element_at(nested, F.greatest(c, F.lit(1))), lambda b: b <= key)))
    else:
        bucket = F.lit(0)
    placed = df.withColumn("_key", key).withColumn("bucket", bucket.cast("int"))
    top = {r["bucket"]: r["top"] for r in placed.groupBy("bucket").agg(F.max("_key").alias("top")).collect()}
    filled = sorted(top)
    if not filled:
        return df.withColumns({"next_text": F.col(text_col), "own": F.lit(True), "bucket": F.lit(0), "late": F.lit(0), "_key": key}), Window.partitionBy("bucket").orderBy("late", F.desc("_key"), text_col)
    tops = F.lit([top.get(i, 0) for i in range(filled[-1] + 1)])
    above = dict(zip(filled, filled[1:], strict=False))
    ups = F.lit([above.get(i, -1) for i in range(filled[-1] + 1)])
    place = lambda b, late: F.struct(b.cast("int").alias("bucket"), F.lit(late).alias("late"))
    is_top = F.col("_key") == F.element_at(tops, F.col("bucket") + 1)
    up = F.element_at(ups, F.col("bucket") + 1)
    copies = F.array_compact(F.array(place(F.col("bucket"), 0), F.when(is_top & (up >= 0), place(up, 1)), F.when(F.col("_key") == top[filled[-1]], place(F.lit(filled[0]), 2))))
    sent = placed.withColumn("_to", F.explode(copies)).drop("bucket").select("*", "_to.bucket", "_to.late").drop("_to")
    order = Window.partitionBy("bucket").orderBy("late", F.desc("_key"), F.col(text_col))
    return sent.withColumn("next_text", F.lead(text_col).over(order)).withColumn("own", F.col("late") == 0), order


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text has its last third replaced by the start of the next document's, by descending id. Null texts count
    as empty. A text of one or two characters is not edited. Repeated rows follow one another. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    laid, order = with_next(slim, "doc_id", "text")
    marked = laid.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("own")
    n = marked.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = n.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - third))"), F.expr("substring(next_text, 1, third)")))
    out = edited.withColumn("edited_fingerprint", F.when(F.col("edited") == F.col("text"), F.col("fingerprint")).otherwise(fingerprint(F.col("edited"))))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
