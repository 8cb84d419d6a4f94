"""Document fingerprints by SpotSigs: chains of content words that follow common words. DataFrame functions only.

A spot is an occurrence of a common word (an anchor); its signature is the anchor with the chain of the next
content words, anchors between them left out. A text's fingerprint is the set of its signatures, so what
stands in running prose counts, and lists, menus and numbers hardly do. Sets are compared by their Jaccard
similarity. For a search they are partitioned by their length: sets of a similarity of at least `similarity`
lie in the same or in neighbouring partitions, and share a signature among the first few of each.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, text_or_empty, written
from registry_jobs.sources.tables import width

# Fixed list: common words of four languages.
ANCHORS = """a about after all also an and are as at be been but by can could for from had has have he her his i if in into is it its
more most no not of on one or other our she so some than that the their them there these they this to up was we were what when
which who will with would you
als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist kann mit nach
nicht noch nur oder sich sie sind so um und vom von vor war werden wie wird zu zum zur über
au aux avec ce cette ces dans de du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour que
qui sa se ses son sont sur un une vous y
al como con del el ella ellos era eran esta este fue ha han las lo los más muy ni no o para pero por porque quien sin sobre su sus
también tiene todo una uno ya""".split()
CHAIN = 3
GAP = 1
DIGITS = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ"
LOWER = "abcdefghijklmnopqrstuvwxyzäöüàâçéèêëîïôùûñáíóú"
SIMILARITY = 0.8
#: Bounds of a range that are looked through at once.
RUN = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def digest(text: Column) -> Column:
    return F.substring(F.md5(text), 1, DIGITS)


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, gap: int = GAP) -> Column:
    """The sorted set of a text's spot signatures, as hexadecimal digits.

    An anchor's chain has `chain` content words, each the gap-th after the one before. A text without any
    spot (null and empty ones too) has one signature of all its words, behind `=`.
    """

    def spots(ts: Column) -> Column:
        content = F.filter(F.transform(ts, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].isin(*anchors))

        def of(cs: Column) -> Column:
            def at(c: Column, j: Column) -> Column:
                before = F.when(j > 0, F.get(cs, j - 1)["i"]).otherwise(-1)
                words = F.concat_ws(" ", *[F.get(cs, j + k * gap)["w"] for k in range(chain)])
                here = let(words, lambda t: F.transform(F.array_distinct(F.slice(ts, before + 2, c["i"] - before - 1)), lambda a: digest(F.concat(a, F.lit(" "), t))))
                some = (c["i"] - before > 1) & (j + (chain - 1) * gap < F.size(cs))
                return F.when(some, here).otherwise(F.array().cast("array<string>"))

            return F.flatten(F.transform(cs, at))

        found = let(content, of)
        return let(found, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.array(F.concat(F.lit("="), digest(F.array_join(ts, " "))))))

    return let(tokens(F.coalesce(text, F.lit(""))), spots)


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sets of signatures."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def fingerprint(signatures_: Column) -> Column:
    return F.array_join(signatures_, " ")


def length_class(n: Column, similarity: float = SIMILARITY) -> Column:
    """The partition of a set of n signatures: sets of the similarity are at most one partition apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1 / similarity) + 1e-9)).cast("int")


def _key() -> list[Column]:
    """Descending ids, nulls last, then by the text's hash: ascending columns."""
    return [F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("down"), F.xxhash64("text").alias("h")]


def _ranges(keys: DataFrame, parts: int) -> list[tuple]:
    """The first key of each of at most `parts` ranges of even size."""
    dealt = keys.select("none", "down", "h").repartitionByRange(parts, "none", "down", "h")
    return sorted(tuple(r["first"]) for r in dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("none", "down", "h")).alias("first")).collect())


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, times, next_text): each text with that of the next document by descending id; after the last comes the first.

    Rows equal in id and text are one here, with their number in `times`. Ranges of ids are found on hashes
    (24 bytes a row); then texts are dealt out once, the first of each range also to the range before it.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    keys = written(base.select(*_key()).groupBy("none", "down", "h").agg(F.count(F.lit(1)).alias("times")))
    if keys.where("times > 1").isEmpty():
        base = base.withColumn("times", F.lit(1).cast("long"))
    else:
        base = base.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
    firsts = _ranges(keys, width(docs.sparkSession))
    dropped(keys)
    kind = "struct<none:boolean,down:bigint,h:bigint>"
    rows = [dict(zip(("none", "down", "h"), f)) for f in firsts]
    runs = [rows[k : k + RUN] for k in range(0, len(rows), RUN)]
    starts = F.from_json(F.lit(json.dumps([r[0] for r in runs])), f"array<{kind}>")
    nested = F.from_json(F.lit(json.dumps(runs)), f"array<array<{kind}>>")
    upto = lambda bounds, key: F.size(F.filter(bounds, lambda b: b <= key)) - 1
    placed = base.withColumn("key", F.struct(*_key()))
    placed = placed.withColumn("run", F.greatest(upto(starts, F.col("key")), F.lit(0)))
    placed = placed.withColumn("bucket", F.greatest(F.col("run") * RUN + upto(F.get(nested, F.col("run")), F.col("key")), F.lit(0)))
    first = F.get(F.get(nested, F.floor(F.col("bucket") / RUN).cast("int")), F.pmod("bucket", F.lit(RUN))) == F.col("key")
    own = F.struct(F.col("bucket"), F.lit(1).alias("guest"))
    before = F.struct(F.when(F.col("bucket") == 0, len(firsts) - 1).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(2).alias("guest"))
    return placed.withColumn("at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own)))).select("doc_id", "text", "times", "key", "at.bucket", "at.guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] = ANCHORS, chain: int = CHAIN, gap: int = GAP) -> DataFrame:
    """(doc_id, signatures, length_class): one row per row of docs, no shuffle. A null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), signatures(F.col(text_col).cast("string"), anchors, chain, gap).alias("signatures")).withColumn("length_class", length_class(F.size("signatures")))


def fingerprint_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] = ANCHORS, chain: int = CHAIN, gap: int = GAP) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, length_class, edited_length_class.

    One row per row of docs: its fingerprint, that of its text with the second half replaced by the beginning
    of the next document's, and how like it is to that and to the next document's. Null texts are empty.
    Documents follow each other by descending id, null ids last; rows of one id go by a hash of their texts.
    Of rows equal in id and text each but the last is followed by its like. A single row follows itself. An empty
    table gives an empty result; a text of any length is one row; columns besides id and text are not read.
    """
    sign = lambda c: signatures(F.col(c), anchors, chain, gap)
    dealt = with_next(docs, id_col, text_col).repartition("bucket").withColumn("signatures", sign("text"))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    both = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_signatures", F.lead("signatures").over(order)).where("guest = 1")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = lambda following: F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(following, F.lit(1), half))
    last = F.struct(edited(F.col("next_text")).alias("edited"), F.col("next_signatures"), F.lit(1).cast("long").alias("n"))
    like = F.struct(edited(F.col("text")).alias("edited"), F.col("signatures").alias("next_signatures"), (F.col("times") - 1).alias("n"))
    rows = both.withColumn("x", F.explode(F.when(F.col("times") > 1, F.array(last, like)).otherwise(F.array(last)))).select("doc_id", F.length("text").cast("long").alias("n_chars"), "signatures", "x.*")
    rows = rows.withColumn("edited_signatures", sign("edited"))
    out = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        length_class(F.size("signatures")).alias("length_class"),
        length_class(F.size("edited_signatures")).alias("edited_length_class"),
        "n",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "copy")


def similar_documents(queries: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links (query_key, key, likeness) between different fingerprints, and members (doc_id, key) of docs, both written.

    queries and docs are fingerprints(). Equal fingerprints are one; a query's partition and its neighbours
    are searched, by the signatures of which one must be shared: in the order of the digits, the first
    n - ceil(similarity * n) + 1 of n. A query's equal fingerprint in docs has its own key and no link.
    """
    key = F.md5(fingerprint(F.col("signatures"))).alias("key")
    members = written(docs.select("doc_id", key))
    one = lambda df: df.select(key, "signatures", "length_class").groupBy("key").agg(F.first("signatures").alias("signatures"), F.first("length_class").alias("length_class"))
    asked, there = written(one(queries)), written(one(docs))
    n = F.size("signatures")
    first = F.slice("signatures", F.lit(1), n - F.ceil(n * F.lit(similarity - 1e-9)).cast("int") + 1)
    near = F.sequence(F.col("length_class") - 1, F.col("length_class") + 1)
    x = asked.select(F.col("key").alias("query_key"), n.alias("nq"), F.explode(near).alias("part"), first.alias("s")).select("query_key", "nq", "part", F.explode("s").alias("s"))
    y = there.select("key", n.alias("nd"), F.col("length_class").alias("part"), F.explode(first).alias("s"))
    fits = F.least("nq", "nd") >= F.greatest("nq", "nd") * F.lit(similarity - 1e-9)
    met = x.join(y.hint("merge"), ["s", "part"]).where(fits & (F.col("query_key") != F.col("key"))).select("query_key", "key").distinct()
    a = asked.select(F.col("key").alias("query_key"), F.col("signatures").alias("a"))
    both = met.join(a.hint("merge"), "query_key").join(there.select("key", F.col("signatures").alias("b")).hint("merge"), "key")
    links = written(both.select("query_key", "key", likeness(F.col("a"), F.col("b")).alias("likeness")).where(F.col("likeness") >= similarity - 1e-12))
    dropped(asked, there)
    return links, members
