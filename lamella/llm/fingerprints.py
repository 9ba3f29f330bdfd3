"""I-Match fingerprints: distinct terms of a chosen inverse-document-frequency band, sorted and hashed, over
several randomised subsets of that lexicon.  Column functions only.

The lexicon is the terms found in a share of ``low`` to ``high`` of the documents (and in two at least).  A document's distinct terms
number m on average, so that at most m / low terms can reach the share ``low``, however many documents there are: the lexicon
is bounded, and is handed to every task as a hash table of slots.

A fingerprint is the hash of a text's sorted lexicon terms (its first part, I-Match proper), and for each of ``families``
random orders of the lexicon the hash of those terms of the text that fall in the smallest randomised subset that holds
any: subsets halve, 1, 1/2, 1/4 ... of the lexicon.  So a long and a short text are both told by a few of their terms,
and texts that differ in some places still share parts.  Likeness is 1 where the first parts are equal,
else the share of equal parts among the others.

Cases: null counts as empty; a text without lexicon terms is told by all its distinct terms; equal texts have equal
fingerprints; a corpus of one document has itself as the next one; rows with a null id are left out, as they have no
place in the order; rows that repeat an id count as one (its least text); other columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SLOTS = 1 << 16
SPACE = "[\\t-\\r ]+"


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text, as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str, low: float, high: float) -> DataFrame:
    """(term hash, df) of the band."""
    n = docs.count()
    rows = docs.select(F.explode(terms(F.col(text_col))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return rows.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n)))


def slots(lex: DataFrame) -> DataFrame:
    """One row: an array of SLOTS arrays of the term hashes that fall in each slot."""
    full = lex.select(F.pmod("t", F.lit(SLOTS)).alias("s"), "t").groupBy("s").agg(F.collect_list("t").alias("ts"))
    every = lex.sparkSession.range(SLOTS).withColumnRenamed("id", "s").join(full, "s", "left").select("s", F.coalesce("ts", F.array().cast("array<long>")).alias("ts"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "ts"))), lambda x: x["ts"]).alias("slots"))


def _hex(a: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(a))), 16, "0")


def fingerprint(text: Column, table: Column, families: int) -> Column:
    """array<string> of 1 + families parts."""
    own = terms(text)
    kept = F.filter(own, lambda t: F.array_contains(F.element_at(table, (F.pmod(t, F.lit(SLOTS)) + 1).cast("int")), t))
    base = F.sort_array(F.when(F.size(kept) > 0, kept).otherwise(own))

    def part(b, f):
        # the family's random order of terms, as 62-bit numbers
        ranks = F.transform(b, lambda t: F.shiftrightunsigned(F.xxhash64(t, F.lit(f)), 2))
        # the smallest subset that holds a term of the text: the numbers of fewer bits than the least has, and as many
        held = F.transform(F.array(ranks), lambda r: F.struct(r.alias("r"), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.array_min(r)))).alias("top")))
        return F.element_at(F.transform(held, lambda p: _hex(F.sort_array(F.filter(p["r"], lambda x: x < p["top"])))), 1)

    def parts(b):
        return F.array(_hex(b), *(part(b, f) for f in range(1, families + 1)))

    # bound once, so that the terms are made once for all parts
    return F.element_at(F.transform(F.array(base), parts), 1)


def _all(families: int) -> Column:
    """Fingerprints of each of ``texts``.  ``table`` (a subquery) is named once, outside of the lambda, so that the optimizer
    puts the subquery in its place: it is bound by reference and never copied into rows."""
    bound = F.array(F.struct(F.col("texts"), F.col("table")))
    return F.element_at(F.transform(bound, lambda s: F.transform(s["texts"], lambda t: fingerprint(t, s["table"], families))), 1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints as arrays."""
    same = F.zip_with(F.slice(a, 2, F.size(a)), F.slice(b, 2, F.size(b)), lambda x, y: (x == y).cast("int"))
    share = F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / F.size(same)
    return F.when(F.element_at(a, 1) == F.element_at(b, 1), F.lit(1.0)).otherwise(share)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): null ids left out, repeated ids made one row, null texts empty."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    twice = d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return d.groupBy("id").agg(F.min("text").alias("text")) if twice else d


def next_ids(ids: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """(id, n, next): the next greater id of each (after the last: the first).

    Ids are dealt by range; a window runs within each range, and the first id of each range closes the one before.
    Only ids and lengths move, and the window over ranges has one row a range.
    """
    spark = ids.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // rows))
    dealt = materialize(ids.repartitionByRange(parts, "id").withColumn("p", F.spark_partition_id()), "ids-by-range")
    firsts = dealt.groupBy("p").agg(F.min("id").alias("first"))
    order = W.orderBy("p")
    after = firsts.select("p", F.coalesce(F.lead("first").over(order), F.min("first").over(order)).alias("after"))
    inner = dealt.withColumn("next", F.lead("id").over(W.partitionBy("p").orderBy("id")))
    return inner.join(after, "p").select("id", "n", F.coalesce("next", "after").alias("next"))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.0005, high: float = 0.1, families: int = 10) -> DataFrame:
    """(id, fingerprint: array of parts) of each text."""
    d = keyed(docs, id_col, text_col)
    table = slots(lexicon(d, "text", low, high)).scalar()
    d = d.select("id", F.array("text").alias("texts"), table.alias("table"))
    return d.select(F.col("id").alias(id_col), F.element_at(_all(families), 1).alias("fingerprint"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.0005, high: float = 0.1, families: int = 10) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and their likeness: see ``op1``.

    The edited text is the text with its last quarter replaced by as many of the next document's first characters.
    A text moves once, by its id; of the next document's only the characters that are needed move again.
    """
    d = keyed(docs, id_col, text_col)
    table = slots(materialize(lexicon(d, "text", low, high), "imatch-lexicon")).scalar()
    following = materialize(next_ids(d.select("id", F.length("text").cast("long").alias("n"))), "imatch-next")
    need = following.select(F.col("id").alias("of"), F.col("next").alias("id"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    heads = d.join(need, "id").select(F.col("of").alias("id"), F.expr("substring(text, 1, need)").alias("head"), "need")
    edited = F.concat(F.expr("substring(text, 1, length(text) - need)"), F.col("head"))
    both = d.join(heads, "id").select("id", "text", edited.alias("edited"))
    both = both.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array("text", "edited").alias("texts"), table.alias("table"))
    made = materialize(both.select("id", "n_chars", "edited_sha256", _all(families).alias("f")), "imatch-parts")
    made = made.select("id", "n_chars", "edited_sha256", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
    other = made.select(F.col("id").alias("next"), F.col("a").alias("c"))
    out = made.join(following.select("id", "next"), "id").join(other, "next")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.array_join("a", ":").alias("fingerprint"), F.array_join("b", ":").alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next")
    )


def op1_document_fingerprints(spark, sf_dir):
    """Fingerprints of all ``documents`` and of their edited texts."""
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
