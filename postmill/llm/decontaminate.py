"""Benchmark decontamination by spaced-seed hashing. DataFrame operations only.

A seed is a fixed mask over a few neighbouring words; words at its zeros are ignored, so a
substituted word leaves most seeds around it intact. Seeds of documents and of test items are joined by hash,
and around each hit document and item are laid side by side: they overlap where a stretch of the item has
enough equal words at equal places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import own_name
from postmill.operators.settle import settle

MASKS = ("111010011", "110101101", "101100111")  # one span for all: it is the shortest item that can be found
MORE = ("011011011",)  # with it, no two substitutions in a stretch of 13 hide it
STRETCH = 13  # words of an item laid beside the document; a shorter item is compared whole
SIMILAR = 80  # percent of equal words
FEW_SEEDS = 1_000_000  # seeds of test items that are broadcast at most (some 40 MB)
SLOTS = 1 << 15  # rows of the table of marked seeds (16 MB in all)
LETTERS = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case; none for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def with_seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Rows (with ``words``) by position and mask: ``at``, ``seed``."""
    span = len(masks[0])
    keys = [F.xxhash64(F.lit(n), *(F.get("words", F.col("at") + o) for o, bit in enumerate(m) if bit == "1")) for n, m in enumerate(masks)]
    placed = rows.filter(F.size("words") >= span).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - span)))
    return placed.withColumn("seed", F.explode(F.array(*keys)))


def piece_of(n: int, percent: int) -> tuple[int, int]:
    """Length and number of the pieces of an item of n words: one more than may be substituted, so one is intact."""
    pieces = n * (100 - percent) // 100 + 1
    return n // pieces, pieces


def marked(seeds: DataFrame) -> DataFrame:
    """A table of fixed size that tells nearly all other seeds from these: 2**27 bits, in SLOTS rows (``slot``, ``bits``) of 64 longs."""
    at = seeds.select(slot_of(F.col("seed")).alias("slot"), word_of(F.col("seed")).alias("w"), bit_of(F.col("seed")).alias("b"))
    words = at.groupBy("slot", "w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("v"))
    held = words.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return held.select("slot", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("bits"))


def slot_of(seed: Column) -> Column:
    return F.pmod(seed, F.lit(SLOTS)).cast("int")


def word_of(seed: Column) -> Column:
    return F.shiftrightunsigned(seed, 58).cast("int")


def bit_of(seed: Column) -> Column:
    return F.shiftrightunsigned(seed, 52).bitwiseAND(F.lit(63)).cast("int")


def overlaps(docs: DataFrame, items: DataFrame, masks=MASKS, stretch=STRETCH, percent=SIMILAR, doc_id="doc_id", text="text", item_id="item_id", whole=False) -> DataFrame:
    """Verified overlaps: (doc_id, text_hash, item_id), each once. Items and documents shorter than a mask have none.

    ``whole`` finds what the masks miss, too: items of up to ``stretch`` words, down to one word, are also sought by
    intact pieces, and stretches of longer items also with the masks of MORE.

    Items of equal words are sought as one. A position of a document is a row of its seed alone; the words of
    a document come back once, for those with hits. Where the seeds of the items are too many to broadcast, positions
    that cannot match are dropped by a table of fixed size before the exchange.
    """
    masks = (*masks, *MORE) if whole else masks
    named = items.select(F.col(item_id).alias("item_id"), word_hashes(F.col("text")).alias("words")).filter(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct()
    named = settle(named, "items")
    tests = settle(named.groupBy("words").agg(F.min("item_id").alias("item")), "item-texts")
    planted = with_seeds(tests, masks).select("seed", "item", "at", F.size("words").alias("n"))
    lengths = sorted(r["n"] for r in tests.select(F.size("words").alias("n")).filter(F.col("n").between(1, stretch)).distinct().collect()) if whole else []
    for n in lengths:
        size, pieces = piece_of(n, percent)
        starts = F.array(*(F.lit(size * i) for i in range(pieces)))
        short = with_seeds(tests.filter(F.size("words") == n), ("1" * size,)).filter(F.array_contains(starts, F.col("at")))
        planted = planted.unionByName(short.select("seed", "item", "at", F.lit(n).alias("n")))
    seeds = settle(planted.withColumnRenamed("at", "item_at").distinct(), "seeds")
    few = seeds.count() <= FEW_SEEDS
    small = F.broadcast if few else (lambda df: df)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), word_hashes(F.col(text)).alias("words"))
    columns = ["doc_id", "text_hash", "at", "seed"]
    sown = with_seeds(rows, masks).select(columns)
    for size in sorted({piece_of(n, percent)[0] for n in lengths}):
        sown = sown.unionByName(with_seeds(rows, ("1" * size,)).select(columns))
    if not few:
        bits = F.broadcast(settle(marked(seeds.select("seed").distinct()), "seed-bits"))
        hit = F.call_function("getbit", F.get("bits", word_of(F.col("seed"))), bit_of(F.col("seed"))) == 1
        sown = sown.withColumn("slot", slot_of(F.col("seed"))).join(bits, "slot").filter(hit).select(columns)
    # Seeds of one overlap lie on one diagonal: it is laid out once.
    hits = sown.join(small(seeds), "seed").select("doc_id", "text_hash", "item", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    held, hashed = own_name("id"), own_name("hash")
    per_text = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "n", "shift")).alias("hits"))
    per_text = settle(per_text.select(F.col("doc_id").alias(held), F.col("text_hash").alias(hashed), "hits"), "hits")
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    met = met.join(per_text, F.col("doc_id").eqNullSafe(F.col(held)) & (F.xxhash64("text") == F.col(hashed)))
    met = met.select("doc_id", F.col(hashed).alias("text_hash"), "hits", word_hashes(F.col("text")).alias("words"))
    beside = lambda h: F.transform(F.sequence(F.lit(0), h["n"] - 1), lambda i: F.get("words", i + h["shift"]))
    laid = met.select("doc_id", "text_hash", F.inline(F.transform("hits", lambda h: F.struct(h["item"].alias("item"), beside(h).alias("beside")))))
    laid = laid.join(small(tests.select("item", F.col("words").alias("item_words"))), "item")

    equal = F.zip_with("item_words", "beside", lambda w, d: F.when(d == w, 1).otherwise(0))
    length = F.least(F.size("item_words"), F.lit(stretch))
    alike = F.exists(
        F.sequence(F.lit(1), F.size("equal") - F.col("length") + 1),
        lambda s: 100 * F.aggregate(F.slice("equal", s, F.col("length")), F.lit(0), lambda a, x: a + x) >= percent * F.col("length"),
    )
    laid = laid.select("doc_id", "text_hash", "item", equal.alias("equal"), length.alias("length"))
    found = laid.filter(alike).select("doc_id", "text_hash", "item").distinct()
    same = named.join(small(tests), "words").select("item", "item_id")
    return found.join(small(same), "item").select("doc_id", "text_hash", "item_id")


def contamination(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ids of the test items it holds, ascending).

    Null and empty texts hold none; a null id is an id like any other; repeated rows get equal results;
    rows of one id and different texts are judged apart. Test items without id, text or with fewer words than
    a mask spans (9) are not searched, unless ``whole`` is given. Empty tables: no documents, or none contaminated. Other columns are ignored.
    """
    found = overlaps(docs, items, doc_id=doc_id, text=text, **how).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "items")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_text"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    return joined.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """The documents that hold no test item, in the input's columns, whatever their names.

    Null and empty texts stay; a null id is an id like any other; rows that repeat id and text stay or go together, rows
    of one id and different texts are judged apart. An empty table stays empty; without items all documents stay.
    """
    held, hashed = own_name("id"), own_name("hash")
    bad = overlaps(docs, items, doc_id=doc_id, text=text, **how).select(F.col("doc_id").alias(held), F.col("text_hash").alias(hashed)).distinct()
    bad = settle(bad, "contaminated")
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(held)) & (F.xxhash64(F.col(text)) == F.col(hashed)), "left_anti")


def _sql() -> str:
    span = len(MASKS[0])
    leads = ", ".join(f"lead(w, {o}) OVER p AS w{o}" for o in range(span))
    hits = "\nUNION\n".join(
        f"SELECT d.doc_id, i.item_id, d.pos - i.pos AS shift FROM dl d JOIN il i ON d.w{span - 1} IS NOT NULL AND i.w{span - 1} IS NOT NULL AND "
        + " AND ".join(f"d.w{o} = i.w{o}" for o, bit in enumerate(m) if bit == "1")
        for m in MASKS
    )
    return rf"""
WITH da AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
ia AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM da),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM ia),
dl AS (SELECT doc_id, pos, {leads} FROM dw WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
il AS (SELECT item_id, pos, {leads} FROM iw WINDOW p AS (PARTITION BY item_id ORDER BY pos)),
hits AS ({hits}),
laid AS (SELECT h.doc_id, h.item_id, h.shift, i.pos, i.n, (d.w IS NOT NULL)::INT AS same
  FROM hits h JOIN iw i USING (item_id) LEFT JOIN dw d ON d.doc_id = h.doc_id AND d.pos = i.pos + h.shift AND d.w = i.w),
run AS (SELECT doc_id, item_id, pos, least(n, {STRETCH}) AS len, n,
  sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN {STRETCH - 1} PRECEDING AND CURRENT ROW) AS same FROM laid),
found AS (SELECT DISTINCT doc_id, item_id FROM run WHERE pos + 1 >= len AND 100 * same >= {SIMILAR} * len),
per AS (SELECT doc_id, list_sort(list(item_id)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, per.items IS NOT NULL AS contaminated, coalesce(len(per.items), 0)::BIGINT AS n_items, coalesce(array_to_string(per.items, ','), '') AS items
FROM documents LEFT JOIN per USING (doc_id)
"""


SQL = _sql()
