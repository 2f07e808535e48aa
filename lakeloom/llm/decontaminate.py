"""Benchmark decontamination in DataFrame operations only.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A window is 13
consecutive words of a benchmark item; an item of fewer words is one window. The hashed windows are
broadcast as a set, and every document is scanned: of each window, some 5 consecutive words start
at a multiple of 9, so only every ninth 5-word sequence of a document is looked up. Around a hit,
all windows that contain it are looked up in full, and the words themselves are compared. The scan,
both look-ups and the comparison run in one pass over the documents, without a shuffle of text.

The broadcast has a bound: beyond MAX_BROADCAST_BYTES of windows, the sequences and windows are
joined by shuffles of hashes instead, with the same result.

Null text and null items have no words. Rows that repeat, and items that repeat, give what one
gives; a null item_id is listed as nothing but its windows count; a null doc_id is kept; columns
beside id and text are not read. An empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import ascii_lower, same_document, slim

#: Between words: everything in ASCII but letters and digits, once A-Z is in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SEED = 13, 5
MAX_BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")


def grams(of: Column, size: Column, at: Column) -> Column:
    """The hash of the `size` words from 0-based position `at`, which says their number too."""
    return F.xxhash64(size, F.slice(of, at + 1, size))


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct windows: hash, size, its words, and the ids of the items that have it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("item"))
    items = items.filter(F.size("item") > 0).withColumn("size", F.least(F.size("item"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(0), F.size("item") - F.col("size"))).alias("at")
    of = F.slice("item", F.col("at") + 1, F.col("size")).alias("window")
    return (
        items.select("item_id", "item", "size", at)
        .select("item_id", "size", of)
        .groupBy("size", "window")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("hash", F.xxhash64("size", "window"))
    )


def seeds_of(windows: DataFrame, seed: int) -> DataFrame:
    """The hashes of all seeds of the windows, under the window size they belong to."""
    n = F.least(F.col("size"), F.lit(seed))
    hashes = F.transform(F.sequence(F.lit(0), F.col("size") - n), lambda i: F.xxhash64("size", grams(F.col("window"), n, i)))
    return windows.select(F.explode(hashes).alias("seed")).distinct()


def hits(
    docs: DataFrame, windows: DataFrame, sizes: list[int], seed: int = SEED, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Every occurrence of a window: doc_id, row_key, at (first word, from 0), size, hash.

    `docs` has doc_id, row_key and words.
    """
    stats = windows.agg(
        F.coalesce(F.sum(F.size("window") * 24 + F.length(F.concat_ws(" ", "window"))), F.lit(0))
    ).first()[0]
    small = stats <= max_bytes
    hold = F.broadcast if small else (lambda df: df.hint("shuffle_merge"))

    def probes(size: int) -> Column:
        n = min(size, seed)
        last = F.size("words") - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(size - n + 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places,
            lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.lit(size), grams(F.col("words"), F.lit(n), i)).alias("seed")),
        )

    keys = ["doc_id", "row_key"]
    every = docs.select(*keys, "words", F.explode(F.concat(*map(probes, sizes))).alias("p"))
    probe = [F.col("p.at").alias("seed_at"), F.col("p.size").alias("size"), F.col("p.seed").alias("seed")]
    seeds = seeds_of(windows, seed)
    if small:
        found = every.select(*keys, "words", *probe).join(hold(seeds), "seed", "left_semi")
    else:  # only hashes are shuffled; the text comes back for the documents with a hit
        found = every.select(*keys, *probe).join(hold(seeds), "seed", "left_semi").groupBy(*keys).agg(
            F.collect_set(F.struct("seed_at", "size")).alias("found")
        )
        found = same_document(docs, found, "inner").select(*keys, "words", F.inline("found"))
    # A window of the size that holds this seed starts at most size - n words before it.
    n = F.least(F.col("size"), F.lit(seed))
    low = F.greatest(F.lit(0), F.col("seed_at") - (F.col("size") - n))
    high = F.least(F.col("seed_at"), F.size("words") - F.col("size"))
    around = found.filter(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    full = around.select(*keys, "at", F.slice("words", F.col("at") + 1, F.col("size")).alias("here"), "size")
    full = full.withColumn("hash", F.xxhash64("size", "here"))
    named = windows.select(F.col("hash").alias("w_hash"), "window")
    verified = full.join(hold(named), (F.col("hash") == F.col("w_hash")) & (F.col("here") == F.col("window")))
    return verified.select(*keys, "at", "size", "hash")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    seed: int = SEED,
    share: float = 0.05,
    max_bytes: int = MAX_BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, n_hit, spans, items, contaminated.

    `spans` lists the hit words as (first, behind the last), in order; `items` the benchmark items
    found, sorted. A document is contaminated if at least `share` of its words, and at least one,
    are hit. row_key is a fingerprint of the text, to tell rows of one doc_id apart.
    """
    windows = settle(benchmark_windows(benchmark, window, item_id_col, item_text_col), "windows")
    # At most `window` numbers.
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    base = slim(docs, id_col, text_col).withColumn("row_key", F.xxhash64("text"))
    counted = base.select("doc_id", "row_key", F.size(words(F.col("text"))).alias("n_words"))
    empty = "array<struct<first:int,behind:int>>"
    if not sizes:
        return counted.select(
            "*", F.lit(0).alias("n_hit"), F.array().cast(empty).alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated")
        )
    found = hits(base.select("doc_id", "row_key", words(F.col("text")).alias("words")), windows, sizes, seed, max_bytes)
    found = settle(found, "hits")
    keys = ["doc_id", "row_key"]
    # A document's hits are at most its words; starts that follow on grow one span.
    spans = found.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("starts"))
    merged = F.aggregate(
        "starts",
        F.array().cast(empty),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["behind"] >= x["at"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["first"].alias("first"),
                        F.greatest(F.element_at(acc, -1)["behind"], x["at"] + x["size"]).alias("behind"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["at"].alias("first"), (x["at"] + x["size"]).alias("behind"))))),
    )
    # A window in a document counts once before its items are listed.
    items = (
        found.select(*keys, "hash")
        .distinct()
        .join(windows.select("hash", "items"), "hash")
        .select(*keys, F.explode("items").alias("item"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    out = same_document(counted, spans.select(*keys, merged.alias("spans")))
    out = same_document(out, items)
    spans_of = F.coalesce("spans", F.array().cast(empty))
    out = out.select(*keys, "n_words", spans_of.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["behind"] - s["first"])
    enough = F.col("n_hit") >= F.col("n_words") * F.lit(share).cast("decimal(10,6)")
    out = out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & enough)
    return out.select(*keys, "n_words", "n_hit", "spans", "items", "contaminated")


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` without the contaminated documents; the columns stay as they are."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how).filter("contaminated")
    drop = found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(drop, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with the hit words cut out of the text, each with what stands between it and the next word."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how).filter("n_hit > 0")
    cut = found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("spans").alias("_spans")).distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    both = docs.join(cut, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # as GAP, with A-Z among the words
    word = gap.replace("[", "[^", 1)
    lead = F.regexp_extract(F.col(text_col), f"^({gap}*)", 1)
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"({word}+{gap}*)"), 1)
    left = F.filter(parts, lambda p, i: ~F.exists("_spans", lambda s: (s["first"] <= i) & (i < s["behind"])))
    text = F.when(F.col("_spans").isNotNull(), F.concat(lead, F.array_join(left, ""))).otherwise(F.col(text_col))
    return both.withColumn(text_col, text).select(*docs.columns)
