"""Benchmark decontamination: documents that hold passages of benchmark items, by DataFrame functions only.

Items and documents are cut into words of lower-cased letters, digits and characters beyond ASCII. Every run of ten
words of an item is a window (all words of a shorter item). The hashes of all windows form a set that every task has; runs of
a document's words whose hash is in it are then compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from sieveline.llm.common import small
from sieveline.sources.shared import written

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word with what stands before it, in a text as it is.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"
WINDOW = 10
#: Most window hashes that go into the plan of the scan; beyond, they are joined.
HASHES = 50_000


def words(text: Column) -> Column:
    """The words of a text; none if it is NULL."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, gram (the words of one window), n (its words), hash; each once per item. Items without words have none."""
    cut = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text).cast("string")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    grams = cut.select("item_id", length.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("gram"))
    return grams.distinct().withColumn("hash", F.xxhash64("gram"))


def _starts(w: str, sizes: list[int], wanted: str) -> Column:
    """(at, n) for each run of words of the given sizes; `wanted` is a condition on the run's hash, h."""
    runs = [f"""transform(filter(if(size({w}) >= {n}, sequence(1, size({w}) - {n - 1}), CAST(array() AS array<int>)),
                                 i -> {wanted.format(h=f"xxhash64(slice({w}, i, {n}))")}), i -> named_struct('at', i, 'n', {n}))""" for n in sizes]
    return F.expr(f"concat({', '.join(runs)})" if runs else "CAST(array() AS array<struct<at:int,n:int>>)")


def hits(docs: DataFrame, items: DataFrame, carried: list[Column], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The carried columns, n_words, n_hit, hit_spans, item_ids for every row of `docs`.

    hit_spans are the runs of hit words (first word from 1, number of words), apart from each other and in order;
    item_ids are the items with occurring windows, sorted as strings. A NULL or empty text has no words and no hits.
    Items with a NULL id take part as item "". Equal windows of several items count for each.
    """
    windows = written(item_windows(items, item_id, item_text).fillna("", ["item_id"]))
    sizes = sorted(row.n for row in windows.select("n").distinct().collect())  # at most WINDOW of them
    grams = windows.select("hash").distinct()
    cut = docs.select(F.struct(*carried).alias("carried"), words(F.col(text).cast("string")).alias("w"))
    row_id = F.monotonically_increasing_id().alias("row_id")
    found = [row.hash for row in grams.limit(HASHES + 1).collect()]  # bounded by the limit
    if len(found) <= HASHES:
        rows = cut.select("carried", row_id, F.size("w").alias("n_words"), "w", _starts("w", sizes, f"{{h}} IN ({', '.join(f'{h}L' for h in found)})" if found else "false").alias("runs"))
    else:  # a set too large for a plan: runs meet it by a join
        stored = written(cut.select("carried", row_id, "w"))
        runs = stored.select("row_id", F.explode(_starts("w", sizes, "true")).alias("run"), "w")
        runs = runs.select("row_id", "run", F.xxhash64(F.slice("w", F.col("run.at"), F.col("run.n"))).alias("hash")).join(small(grams), "hash", "left_semi")
        runs = runs.groupBy("row_id").agg(F.collect_list("run").alias("runs"))
        rows = stored.join(runs, "row_id", "left").select("carried", "row_id", F.size("w").alias("n_words"), "w", "runs")
    gram = F.transform("runs", lambda r: F.struct(r.at.alias("at"), F.slice("w", r.at, r.n).alias("gram")))
    runs = rows.select("carried", "row_id", "n_words", F.posexplode_outer(gram).alias("number", "run"))
    # What is carried goes with the first run alone.
    runs = runs.select(F.when(F.coalesce("number", F.lit(0)) == 0, F.col("carried")).alias("carried"), "row_id", "n_words", "run.at",
                       F.col("run.gram").alias("run_gram"), F.xxhash64("run.gram").alias("run_hash"))
    items_of = small(written(windows.groupBy("hash", "gram").agg(F.collect_set("item_id").alias("ids"))))
    verified = runs.join(items_of, (F.col("run_hash") == F.col("hash")) & (F.col("run_gram") == F.col("gram")), "left")
    verified = verified.select("carried", "row_id", "n_words", "ids", F.when(F.col("ids").isNotNull(), F.struct("at", F.size("run_gram").alias("n"))).alias("span"))
    each = verified.groupBy("row_id").agg(F.first("carried", ignorenulls=True).alias("carried"), F.first("n_words").alias("n_words"),
                                          F.array_sort(F.collect_list("span")).alias("spans"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    merged = F.expr("""aggregate(spans, CAST(array() AS array<struct<at:int,n:int>>), (done, s) ->
        CASE WHEN size(done) = 0 OR element_at(done, -1).at + element_at(done, -1).n < s.at THEN array_append(done, named_struct('at', s.at, 'n', s.n))
             ELSE array_append(slice(done, 1, size(done) - 1), named_struct('at', element_at(done, -1).at,
                  'n', greatest(element_at(done, -1).n, s.at + s.n - element_at(done, -1).at))) END)""")
    return (each.withColumn("hit_spans", merged)
            .select("carried.*", F.col("n_words").cast("long").alias("n_words"),
                    F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s.n).alias("n_hit"), "hit_spans", "item_ids"))


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`; see `hits`."""
    found = hits(docs, items, [F.col(id_column).alias("doc_id")], text, item_id, item_text)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without what the items leak: whole documents, or ("spans") the hit words and what stands before them.

    Rows without a hit stay as they are; a text that is all hit becomes what stands after its last word.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"no such mode: {mode}")
    found = hits(docs, items, [F.struct(*[F.col(c) for c in docs.columns]).alias("doc")], text, item_id, item_text)
    if mode == "documents":
        return found.where("n_hit = 0").select("doc.*")
    body = F.col(f"doc.{text}")
    left = F.filter(F.regexp_extract_all(body, F.lit(f"({_PIECE})"), F.lit(1)),
                    lambda _, i: ~F.exists("hit_spans", lambda s: (i + 1 >= s.at) & (i + 1 < s.at + s.n)))
    cleaned = F.when(F.col("n_hit") == 0, body).otherwise(F.concat(F.array_join(left, ""), F.regexp_extract(body, f"({_TAIL})", 1)))
    return found.select(*[cleaned.alias(c) if c.lower() == text.lower() else F.col(f"doc.{c}") for c in docs.columns])
