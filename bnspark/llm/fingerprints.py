"""Canonical exact digests of documents, with DataFrame functions only.

The canonical form of a text is NFKC, full case folding, NFKC again, and white space folded to single
spaces and trimmed.  Spark has no function for the first two, so `reflect` calls the static methods of
the ICU library that Spark itself ships; the rest are plain SQL functions, and no row leaves the JVM.
The digest is two xxHash64 of the canonical form under different seeds.  Documents that share a digest are
compared byte by byte; should canonical forms ever differ inside a bucket, all its digests get the
SHA-256 of the form as a suffix, so equal digests of documents mean equal canonical bytes.  Digests of edited
texts are compared byte by byte with their own document's, not with each other.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bnspark.llm.common import attach, drop, materialize, maybe_broadcast, maybe_in

# White space that NFKC leaves besides the plain space.
SPACE = r"\t\n\x0B\f\r\x{1C}-\x{1F}\x{85}\x{1680}\x{2028}\x{2029}"
FOLD = rf"[{SPACE}][ {SPACE}]*| [ {SPACE}]+"
ROWS_A_BUCKET = 512
MOST_BUCKETS, CLOSER = 32_768, 8


def canonical(text: Column) -> Column:
    """Canonical form; null counts as empty."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), FOLD, " "))


def wide_hash(c: Column, bits: int = 128) -> Column:
    """Hex of two 64-bit hashes under different seeds.  Fewer bits are for tests of collisions."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.left(F.concat(digits(F.xxhash64(c)), digits(F.xxhash64(F.lit(1), c))), F.lit(bits // 4))


def _bucket(ids: Column, bounds: list[int]) -> Column:
    """Index of the last of the ascending bounds that is at most ids, found over two levels."""
    width = isqrt(len(bounds) - 1) + 1
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= ids))
    coarse = F.greatest(below(longs(bounds[::width])) - 1, F.lit(0))
    return coarse * width + F.greatest(below(F.slice(longs(bounds), coarse * width + 1, F.lit(width))) - 1, F.lit(0))


def with_next(rows: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the row after, by ascending id; after the
    last comes the first.  Rows move once, into ranges of ids whose bounds are ids themselves: the
    first row of a range is also sent to the range before it, so no window spans the table.  Rows
    with a null id have no place in the order and get nulls; rows that repeat an id follow each
    other by the carried columns."""
    ids = rows.select(id_col).where(F.col(id_col).isNotNull())
    n, least = ids.agg(F.count("*"), F.min(id_col)).first()
    if not n:
        return rows.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias("next_" + c) for c in carried])
    parts = min(max(n // ROWS_A_BUCKET, 1), MOST_BUCKETS)
    # Ids chosen by a hash, some CLOSER in each range, of which every CLOSER-th is a bound.
    rate = F.lit(max(n // (parts * CLOSER), 1))
    chosen = ids.where(F.pmod(F.xxhash64(F.lit(5), id_col), rate) == 0).distinct().collect()  # some MOST_BUCKETS * CLOSER
    bounds = sorted({least, *sorted(r[0] for r in chosen)[CLOSER - 1 :: CLOSER]})
    last = len(bounds) - 1
    known = rows.where(F.col(id_col).isNotNull()).withColumn("_b", _bucket(F.col(id_col), bounds))
    starts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    first = F.element_at(starts, F.col("_b") + 1) == F.col(id_col)
    before = F.when(F.col("_b") == 0, F.lit(last)).otherwise(F.col("_b") - 1)
    own = F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("copy"))
    copy = F.struct(before.alias("bucket"), F.lit(1).alias("copy"))
    placed = known.withColumn("_at", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own)))).drop("_b")
    order = Window.partitionBy("_at.bucket").orderBy("_at.copy", id_col, *carried)
    ahead = placed.select("*", *[F.lead(c).over(order).alias("next_" + c) for c in carried])
    nameless = rows.where(F.col(id_col).isNull())
    return (
        ahead.where(F.col("_at.copy") == 0).drop("_at").unionByName(
            nameless.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias("next_" + c) for c in carried])
        )
    )


def clashes(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Digests (fp) of prints whose rows have different canonical forms.  Only documents of buckets with at least
    two rows, and a few more, are made canonical again, and they move reduced to the least and greatest of each
    task."""
    many = materialize(prints.groupBy("fp").count().where("count > 1").select("fp"), "buckets")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    some = prints.join(maybe_broadcast(many), "fp", "left_semi").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    some = materialize(some.distinct(), "holders")
    held = maybe_in(docs.select(own.alias("id"), F.col(text_col).cast("string").alias("text")), "id", some, some.count())
    forms = held.select(canonical(F.col("text")).alias("form"))
    forms = maybe_in(forms.select("form", wide_hash(F.col("form"), bits).alias("fp")), "fp", many, many.count())
    out = forms.groupBy("fp").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high")
    out = materialize(out.select("fp"), "clashes")
    drop(many)
    drop(some)
    return out


def _suffixed(rows: DataFrame, name: str, own: str, clashed: DataFrame) -> DataFrame:
    """rows with the SHA-256 in `own` behind the digests that different forms share."""
    hit = clashed.select(F.col("fp").alias(name), F.lit(True).alias("_hit"))
    suffix = F.when(F.col("_hit"), F.concat(F.lit("-"), F.col(own))).otherwise(F.lit(""))
    return rows.join(maybe_broadcast(hit), name, "left").withColumn(name, F.concat(name, suffix)).drop("_hit")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """Digest of each text and of its edited text, the last floor(n_chars / 2) code points replaced by
    the first as many of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next
    (1.0 where the canonical bytes are equal, else 0.0), group_id and group_size (the smallest doc_id
    and the number of rows of the canonical class).  One row for each row of docs, repeats included.  A
    null text counts as empty.  A row with a null doc_id has no next document: its edited text is what
    is left, and near_next compares it with the empty text.  An empty table gives no rows; other
    columns are not read."""

    def prints(clashed: DataFrame | None) -> DataFrame:
        rows = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
        )
        hashed = rows.withColumn("fp", wide_hash(canonical(F.col("text")), bits))
        ahead = with_next(hashed, "doc_id", ["text", "fp"]).withColumn("next", F.coalesce("next_text", F.lit("")))
        ahead = ahead.withColumn("n_chars", F.length("text").cast("long"))
        half = F.floor(F.col("n_chars") / 2).cast("int")
        ahead = ahead.withColumn(
            "edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next", half))
        )
        forms = ahead.select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "fp", "next_fp", "next", "edited",
            canonical(F.col("edited")).alias("edited_form"),
        )
        forms = forms.withColumn("edited_fp", wide_hash(F.col("edited_form"), bits))
        # Bytes are compared where the hashes agree; a row without a next document is held against "".
        own = canonical(F.col("text"))
        near_edited = F.when(F.col("fp") == F.col("edited_fp"), own == F.col("edited_form")).otherwise(F.lit(False))
        near_next = F.when(F.coalesce(F.col("fp") == F.col("next_fp"), F.lit(True)), own == canonical(F.col("next"))).otherwise(F.lit(False))
        forms = forms.select(
            "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", near_edited.cast("double").alias("near_edited"),
            near_next.cast("double").alias("near_next"),
            *([F.sha2(own, 256).alias("own"), F.sha2("edited_form", 256).alias("edited_own")] if clashed is not None else []),
        )
        if clashed is not None:
            forms = _suffixed(_suffixed(forms, "fp", "own", clashed), "edited_fp", "edited_own", clashed).drop("own", "edited_own")
        return materialize(forms, "prints")

    out = prints(None)
    clashed = clashes(docs, out, id_col, text_col, bits)
    if not clashed.isEmpty():
        drop(out)
        out = prints(clashed)
    drop(clashed)
    groups = out.groupBy("fp").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").withColumn("_n", F.col("group_size"))
    found = attach(out, materialize(groups, "groups"), "fp", "_n", out.count())
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited",
        "near_next", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )
