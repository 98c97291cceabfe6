"""Benchmark decontamination with DataFrame functions only.

The benchmark's distinct windows of ``WINDOW`` normalised words are a hash set.
While its measured bytes allow, the set is broadcast and every window of the
training text probes it in the scan; beyond ``BROADCAST_BYTES`` the same join
is a shuffle join of the windows. A match of hashes is verified word by
word. Matches of a document come back together (never more than it has words),
and merge into covered words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ascii_lower, cut_lineage, without

WINDOW = 13
#: A document is contaminated if SHARE * n_hit >= n_words and n_hit > 0.
SHARE = 20
#: Measured size up to which the window set is broadcast.
BROADCAST_BYTES = 64 << 20
#: Fixed value: what separates words (after lower-casing A-Z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> Column:
    """Normalised words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _hash_at(array: Column, pos: Column, n: int) -> Column:
    """Hash of ``n`` words from 0-based ``pos``; evaluated in generated code."""
    return F.xxhash64(F.lit(n), *[F.get(array, pos + k) for k in range(n)])


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(len, hash, words, items)``: distinct windows with the items they occur
    in. An item of fewer words is one window; one without words has none. Items
    without an id are one item together, a null in ``items``."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    at = w.withColumn("len", F.least(F.size("w"), F.lit(window))).select(
        "item", "w", "len", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("p"))
    each = at.select("item", "len", F.slice("w", F.col("p") + 1, F.col("len")).alias("g"))
    hashed = F.when(F.col("len") == 1, _hash_at(F.col("g"), F.lit(0), 1))
    for n in range(2, window + 1):
        hashed = hashed.when(F.col("len") == n, _hash_at(F.col("g"), F.lit(0), n))
    some = each.groupBy("len", "g").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
    items = F.when(F.col("unnamed"), F.array_append("items", F.lit(None).cast("string"))).otherwise(F.col("items"))
    return some.select("len", "g", items.alias("items")).withColumn("h", hashed)


def _verified(words_at: Column, window: Column) -> Column:
    """Equality of word lists as a test after the match of hashes (written as a
    membership so that the planner does not take the lists for a join key)."""
    return F.array_contains(F.array(window), words_at)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(row, doc_id, n_words, pos, len, items)``: every verified occurrence of
    a window, and one line with ``pos`` -1 per row of ``docs``. ``row`` tells
    apart rows that repeat an id."""
    found = cut_lineage(windows(benchmark, window, item_col, item_text_col))
    size = found.groupBy("len").agg(F.sum(F.length(F.array_join("g", " ")) + 24 + 16 * F.size("g") + 24 * F.size("items")).alias("bytes")).collect()
    lengths = sorted((r["len"] for r in size), reverse=True) or [window]  # at most `window` values
    small = sum(r["bytes"] for r in size) <= BROADCAST_BYTES
    w, code = F.col("w"), F.col("code")
    text = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), words(docs[text_col]).alias("w"))
    # one pass: codes -1 (the row itself), then the positions of every length in turn
    total, starts = F.lit(0), []
    for n in lengths:
        starts.append(total)
        total = total + F.greatest(F.size(w) - (n - 1), F.lit(0))
    at = text.select("row", "doc_id", F.size(w).cast("long").alias("n_words"), "w", F.explode(F.sequence(F.lit(-1), total - 1)).alias("code"))
    pos = length = hashed = None
    for n, start in reversed(list(zip(lengths, starts))):  # the last length's codes start last
        p, h = code - start, _hash_at(w, code - start, n)
        pos = p if pos is None else F.when(code >= last, pos).otherwise(p)
        length = F.lit(n) if length is None else F.when(code >= last, length).otherwise(F.lit(n))
        hashed = h if hashed is None else F.when(code >= last, hashed).otherwise(h)
        last = start
    # a row's own line matches nothing: no hash, or one of its own where null keys would meet in one task
    nothing = F.lit(None).cast("long") if small else F.xxhash64("row")
    probe = at.select("row", "doc_id", "n_words", *(["w"] if small else []), F.when(code < 0, F.lit(-1)).otherwise(pos).alias("pos"), length.alias("len"),
                      F.when(code < 0, nothing).otherwise(hashed).alias("h"), *([] if small else [F.when(code >= 0, F.slice(w, pos + 1, length)).alias("s")]))
    mine = found.select("h", "g", "items")
    words_at = F.slice("p.w", F.col("p.pos") + 1, F.col("p.len")) if small else F.col("p.s")
    met = probe.alias("p").join((F.broadcast(mine) if small else mine).alias("m"), (F.col("p.h") == F.col("m.h")) & _verified(words_at, F.col("m.g")), "left")
    return met.where("pos = -1 or items is not null").select("row", "doc_id", "n_words", "pos", "len", F.when(F.col("pos") >= 0, F.col("items")).alias("items"))


def _covered(matches: Column) -> Column:
    """Words in the union of sorted (pos, len) intervals."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, m):
        end = m["pos"] + m["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(end - F.greatest(acc["end"], m["pos"]), F.lit(0))).cast("long").alias("n"))

    return F.aggregate(matches, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Benchmark items without an id count as one item; the digest is over ids only.
    Null and wordless texts have no words and are clean. Rows that repeat an id
    or have none are judged each by their own text. Extra columns are not read.
    An empty benchmark leaves all clean, an empty table gives no rows.
    """
    per_row = hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col).groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "len")))).alias("m"), F.collect_set("items").alias("i"))
    found = per_row.select("doc_id", "n_words", _covered(F.col("m")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("i"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, all columns as they were. Rows
    that repeat an id go together; rows without an id stay."""
    return without(docs, id_col, report(docs, benchmark, window, share, id_col, text_col).where("contaminated").select("doc_id"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with the hit words cut out of every document.

    A cut runs from the first hit word of a span to its last; what separates the
    words outside stays. Clean texts come back unchanged, null stays null. Rows
    that repeat an id should have the same text: a hit in one is cut in all.
    """
    found = hits(docs, benchmark, window, id_col, text_col).where("pos >= 0").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("m"))
    found = found.select(F.col("doc_id").alias("hit_id"), "m")
    text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    hit = text.join(found, text["doc_id"] == found["hit_id"], "left")
    # pieces: word and what precedes it; every word's piece is dropped if covered
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    tail = F.regexp_extract(F.col("text"), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$", 1)
    kept = F.filter(F.col("p"), lambda x, k: ~F.exists(F.col("m"), lambda s: (k >= s["pos"]) & (k < s["pos"] + s["len"])))
    return hit.withColumn("p", F.when(F.col("m").isNotNull(), pieces)).select(
        "doc_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail)).alias("text"))
