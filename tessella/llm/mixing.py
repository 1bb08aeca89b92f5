"""Mixing sources to target weights: hash-random order, prefix sums, exact budgets.

Every document gets a hash-random key. Within a source the key order is cut into
buckets that are ranges of the key; bucket totals give offsets, and a running sum
inside a bucket gives each document its place in its source's words. The source's
budget is then cut exactly: whole epochs first, and in the last one the words up
to the budget, the document at the border in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, mapped, named, staged


def word_count(text):
    """The number of words, runs of characters that are no ASCII white space; null has 0."""
    parts = F.size(F.split(text, f"[{SPACES}]+", -1))
    edge = F.when(text.rlike(f"^[{SPACES}]"), 1).otherwise(0) + F.when(text.rlike(rf"[{SPACES}]\z"), 1).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(parts - edge).cast("long")


def targets(sized: DataFrame, weights=(3, 1, 2), share=1.5, epochs=2) -> DataFrame:
    """(source, n_rows, source_size, target), one row per source.

    Sources in code point order (null last) get the weights in turn. They share
    share * all words by weight; no target passes epochs * its source's words, and
    what is above is shared again by weight: the level at which the shares add up
    is found from running sums over the sources in order of cap by weight. This
    table has one row per source and is all that is ever ordered as a whole.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    upto = everything.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = (
        per.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("r", F.col("cap") / F.col("w"))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("cap_to", F.sum("cap").over(upto))
        .withColumn("w_to", F.sum("w").over(upto))
    )
    full = F.col("cap_to") + F.col("r") * (F.col("w_all") - F.col("w_to")) <= F.col("all")
    level = total.withColumn("full", full).withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)))
    level = level.withColumn("w_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0.0)))
    rest = F.when(F.col("w_all") > F.col("w_full"), (F.col("all") - F.col("cap_full")) / (F.col("w_all") - F.col("w_full")))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", rest * F.col("w")))
    return level.select("source", "n_rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, epochs=2, carry=(), bucket_rows=4096) -> DataFrame:
    """What the mix takes of each document.

    Returns id, size (words), source_size, target (the source's), taken (words the
    mix takes, repeats counted), then carried_<name> for the columns named in carry. The targets are
    those of targets(); each source's taken words add up to its target, rounded.
    Sizes are cut in the order of a hash of the id, so a rerun agrees.

    Null and empty texts have size 0 and take nothing; a null source is a source of
    its own, the last; rows with equal ids are cut one after the other; an empty
    table gives an empty result. Columns beyond those named are not looked at.
    bucket_rows: about how many rows of a source are ordered in one task.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"),
        F.xxhash64(F.col(id_col), F.lit("mix")).alias("key"), *[named(c).alias(f"carried_{c}") for c in carry],
    )
    narrow = staged(base.select("id", "source", "size", "key"), "sizes")
    per = staged(targets(narrow, weights, share, epochs), "targets")
    bits = F.greatest(F.ceil(F.log2(F.col("n_rows") / F.lit(float(bucket_rows)))), F.lit(0)).cast("int")
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * epochs).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    per = per.select(
        F.col("source").alias("of"), "source_size", "target", bits.alias("bits"), whole.alias("whole"), (budget - whole * F.col("source_size")).alias("rest")
    )

    def bucketed(df):
        # The upper bits of the key: buckets are ranges of the key, in its unsigned order.
        bucket = F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(key, 64 - bits)")).cast("long")
        return df.join(per, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", bucket)

    sums = bucketed(narrow).groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset")), "offsets")
    rows = bucketed(base if carry else narrow)
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).drop("of", "at")
    order = Window.partitionBy("source", "bucket").orderBy(F.expr("shiftrightunsigned(key, 1)"), "key", "id", "size")
    start = F.col("offset") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.least(F.greatest(F.col("rest") - start, F.lit(0)), F.col("size"))
    out = rows.withColumn("taken", (F.col("whole") * F.col("size") + last).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", *[named(f"carried_{c}") for c in carry])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, with the columns of docs.

    A document taken in full e times comes e times; one taken in part comes once
    more with the text up to its last taken word, and n_chars, if docs has it, says
    the length of what is there. Other columns come through, whatever they are called;
    what mix() says of nulls, repeated ids and empty tables holds here.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rest = [c for c in docs.columns if c != id_col]
    plan = mix(docs, carry=rest, **options).where("taken > 0")
    wanted = F.when(F.col("taken") >= F.col("size"), F.when(F.col("taken") >= 2 * F.col("size"), F.array(F.col("size"), F.col("size"))).otherwise(F.array(F.col("size"), F.col("taken") - F.col("size")))).otherwise(F.array(F.col("taken")))
    rows = plan.select(named(id_col), F.explode(F.filter(wanted, lambda x: x > 0)), "size", *[named(f"carried_{c}") for c in rest])
    at = [rest.index(text_col), rest.index("n_chars") if "n_chars" in rest else None]
    return mapped(rows, _Cut(*at), docs.select(*map(named, (id_col, *rest))).schema).select(*map(named, docs.columns))


class _Cut:
    """(id, wanted words, words, columns) to (id, columns): each text up to its last wanted word.

    text_at, chars_at: the places of the text and its length among the columns.
    """

    def __init__(self, text_at: int, chars_at: int | None):
        self.text_at, self.chars_at = text_at, chars_at

    def __call__(self, batches):
        import re
        from itertools import islice

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            columns = list(batch.columns[3:])
            texts, words, sizes = columns[self.text_at].to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cut = [t if w >= s else t[: next(islice(word.finditer(t), w - 1, None)).end()] for t, w, s in zip(texts, words, sizes)]
            columns[self.text_at] = pa.array(cut, columns[self.text_at].type)
            if self.chars_at is not None:
                columns[self.chars_at] = pa.array([len(t) for t in cut]).cast(columns[self.chars_at].type)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f"c{k}" for k in range(len(columns) + 1)])
