"""Operator 10: benchmark decontamination by winnowing, in DataFrame functions only.

Method (Schleimer, Wilkerson and Aiken, 2003).  Of each text the hashes of all
K-word grams are taken, and of every WINDOW - K + 1 consecutive ones the minimum
is kept.  Two texts that share any WINDOW consecutive words keep at least one
common hash, so an equality join of kept hashes finds every document that can
hold a window of an item.  Those documents' hits are then extended: all their
windows are compared with all windows of the benchmark (128 bits of hash), and
hit words are counted as the union of the windows' places.  Items of fewer words
than WINDOW are one window; for each such length that occurs (nine at most) the
grams of that length join the kept hashes directly.

Defined cases.  A null text, or one without words, has n_words 0 and no hits; an
item without words is no window.  Repeated rows of one doc_id are judged by their
own text.  Equal items all count, each with its item_id; an item whose id is null
makes hits but is not listed.  An empty benchmark leaves all documents clean.
Extra columns are ignored.  items_sha256 of no items is that of the empty text.

explode_outer is used throughout: for explode the optimizer adds a filter on the
array's size, which repeats the whole hashing in a place where it is slow.

Scale.  One scan of the documents cuts, hashes and joins in one stage while the
benchmark's hashes have at most BROADCAST_ROWS rows; beyond, the join shuffles
only kept hashes.  A second scan reads the documents that have a kept hash in
common.  A passage that very many documents share costs each of them its own
rows only: documents are never joined with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave.llm.tables import Scratch, fresh, small

K = 5
WINDOW = 10
#: Rows of (hash) or (hash, hash, length, item) up to which a benchmark table is broadcast: at most about 20 MB.
BROADCAST_ROWS = 400_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words, A-Z lower-cased; no words for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def _each(count: Column, value) -> Column:  # noqa: ANN001
    """value(i) for i in 0 .. count - 1."""
    none = F.array().cast("array<bigint>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), value)).otherwise(none)


def _gram(w: Column, i: Column, length: int, *salt: int) -> Column:
    return F.xxhash64(*map(F.lit, salt), *[w[i + j] for j in range(length)])


def kept_hashes(frame: DataFrame, short: list[int], k: int = K, window: int = WINDOW) -> DataFrame:
    """The frame (with columns w and n_words) plus ``kept``: winnowed k-gram hashes, and all grams of the short lengths."""
    span = window - k + 1
    frame = frame.withColumn("grams", _each(F.when(F.col("n_words") >= window, F.col("n_words") - k + 1).otherwise(0), lambda i: _gram(F.col("w"), i, k)))
    least = _each(F.size("grams") - span + 1, lambda i: F.least(*[F.col("grams")[i + j] for j in range(span)]))
    of = lambda n: _each(F.col("n_words") - n + 1, lambda i: _gram(F.col("w"), i, n, n))
    grams = [of(n) for n in short]
    return frame.withColumn("kept", F.array_distinct(F.concat(least, *grams) if grams else least))


def _windows(frame: DataFrame, lengths: list[int]) -> DataFrame:
    """The frame plus ``windows``: (place, length, two hashes) of every run of words of the given lengths."""
    w = F.col("w")

    def of(n: int) -> Column:
        none = F.array().cast("array<struct<place:int,length:int,h1:bigint,h2:bigint>>")
        count = F.col("n_words") - n + 1
        one = lambda i: F.struct(i.alias("place"), F.lit(n).alias("length"), _gram(w, i, n, n).alias("h1"), _gram(w, i, n, -n).alias("h2"))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(none)

    return frame.withColumn("windows", F.concat(*[of(n) for n in lengths]))


def _checked(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Every row's (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    docs: doc_id, text; benchmark: item_id, text.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    cut = lambda frame, id_: frame.select(id_, words(F.col("text")).alias("w"), F.xxhash64("text").alias("text_hash")).withColumn("n_words", F.size("w"))
    items = scratch.save(cut(benchmark, "item_id").where("n_words > 0"), "items")
    short = sorted(r[0] for r in items.where(F.col("n_words") < window).select("n_words").distinct().collect())
    item_hashes = scratch.save(kept_hashes(items, [], k, window).select(F.explode_outer("kept").alias("hash")).where("hash IS NOT NULL").distinct(), "item-hashes")
    for n in short:
        item_hashes = item_hashes.unionByName(items.where(F.col("n_words") == n).select(_gram(F.col("w"), F.lit(0), n, n).alias("hash")).distinct())
    hashes = item_hashes.count()
    if not hashes:
        judged = cut(docs, "doc_id").select("doc_id", "text_hash", "n_words")
        hits = judged.where("false").select("doc_id", "text_hash").withColumns({"n_hit": F.lit(0), "items": F.array().cast("array<string>")})
        return scratch.finish(_report(judged, hits))

    hashed = kept_hashes(cut(docs, "doc_id"), short, k, window)
    if hashes <= BROADCAST_ROWS:
        # a null first element keeps a row for every document through the join
        own = hashed.select("doc_id", "text_hash", "n_words", F.explode_outer(F.concat(F.array(F.lit(None).cast("bigint")), F.col("kept"))).alias("hash"))
        found = own.join(F.broadcast(item_hashes.withColumn("shared", F.lit(True))), "hash", "left").where("hash IS NULL OR shared")
        found = scratch.save(found.select("doc_id", "text_hash", "n_words", F.coalesce("shared", F.lit(False)).alias("shared")), "found")
        judged, possible = found.where("NOT shared"), found.where("shared").select("doc_id", "text_hash").distinct()
    else:
        judged = cut(docs, "doc_id").select("doc_id", "text_hash", "n_words")
        own = hashed.select("doc_id", "text_hash", F.explode_outer("kept").alias("hash"))
        possible = scratch.save(own.join(item_hashes, "hash").select("doc_id", "text_hash").distinct(), "found")

    lengths = [*short, window] if not items.where(F.col("n_words") >= window).isEmpty() else short
    item_windows = items.where(F.col("n_words") >= window).withColumn("fit", F.lit(window)).unionByName(items.where(F.col("n_words") < window).withColumn("fit", F.col("n_words")))
    item_windows = _windows(item_windows, lengths).select("item_id", "fit", F.explode_outer("windows").alias("x")).where("x.length = fit")
    item_windows = scratch.save(item_windows.select("item_id", "x.length", "x.h1", "x.h2").distinct(), "item-windows")
    suspects = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    suspects = suspects.join(small(possible.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left_semi")
    suspects = suspects.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    places = _windows(suspects, lengths).select("doc_id", "text_hash", F.explode_outer("windows").alias("x")).select("doc_id", "text_hash", "x.*")
    hit = scratch.save(places.join(_checked(item_windows, item_windows.count()), ["length", "h1", "h2"]).select("doc_id", "text_hash", "place", "length", "item_id"), "hits")

    before = Window.partitionBy("doc_id", "text_hash").orderBy("place", "length").rowsBetween(Window.unboundedPreceding, -1)
    covered = hit.select("doc_id", "text_hash", "place", "length").distinct().withColumn("end", F.col("place") + F.col("length"))
    covered = covered.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("place", F.coalesce(F.max("end").over(before), F.lit(0)))))
    n_hit = covered.groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"))
    named = hit.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))
    hits = n_hit.join(named.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}), same).select("doc_id", "text_hash", "n_hit", "items")
    return scratch.finish(_report(judged, hits))


def _report(judged: DataFrame, hits: DataFrame) -> DataFrame:
    hits = hits.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    both = judged.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows that hold no window of any benchmark item, each judged by its own text (told apart by 64 bits of a hash)."""
    name, (hashed,) = F.xxhash64(F.lit("clean"), F.col("text")), fresh(docs, "_hashed")
    hit = contamination(docs.select(name.alias("doc_id"), "text"), benchmark, window, k).where("contaminated").select(F.col("doc_id").alias(hashed)).distinct()
    return docs.join(small(hit), name == F.col(hashed), "left_anti")
