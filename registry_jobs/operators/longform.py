"""Lines as rows: sections, label values and entries of documents of any length.

The array forms hold a document in one cell of one row. Here a line is a row, and documents are cut into
runs of CHUNK lines: what must be known of a whole document is summed by run, carried over the document's runs
(a row each), and joined back to the lines by document and run. So no task gathers the lines of a document. Steps that read their
input twice write it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.predicates import is_header, noise_cleaned
from registry_jobs.functions.text import clean_value, compact
from registry_jobs.operators.events import is_entry_start
from registry_jobs.operators.title import label_value
from registry_jobs.sources.tables import written

CHUNK = 4096
_RUN = ["doc_id", "run"]


def in_runs(rows: DataFrame, order: str, chunk: int = CHUNK) -> DataFrame:
    return rows.withColumn("run", F.floor(F.col(order) / chunk))


def _joined(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """rows with what is carried for their run, a row each: lines are dealt out, not sorted."""
    return rows.join(carried.hint("shuffle_hash"), _RUN)


def with_whole(rows: DataFrame, **of: Column) -> DataFrame:
    """rows (doc_id, run, ...) with aggregates of their whole document: sums under names n_..., maxima under last_..., minima under others."""
    rows = written(rows)  # read twice: without it each step would double the work of all steps before
    per = rows.groupBy(*_RUN).agg(*[c.alias(n) for n, c in of.items()])
    whole = Window.partitionBy("doc_id")
    again = lambda n: F.sum(n) if n.startswith("n_") else F.max(n) if n.startswith("last_") else F.min(n)
    carried = per.select(*_RUN, *[again(n).over(whole).alias(n) for n in of])
    return _joined(rows, carried)


def with_running(rows: DataFrame, order: str, of: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with running sums and maxima of their document up to each row: name -> ("sum" or "max", value)."""
    rows = written(rows)
    how = {"sum": F.sum, "max": F.max}
    per = rows.groupBy(*_RUN).agg(*[how[f](c).alias(f"own_{n}") for n, (f, c) in of.items()])
    before = Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*_RUN, *[how[f](f"own_{n}").over(before).alias(f"carry_{n}") for n, (f, _) in of.items()])
    inside = Window.partitionBy(*_RUN).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(rows, carried)
    for n, (f, c) in of.items():
        here, carry = how[f](c).over(inside), F.col(f"carry_{n}")
        out = out.withColumn(n, F.coalesce(carry, F.lit(0)) + here if f == "sum" else F.greatest(carry, here))
    return out.drop(*[f"carry_{n}" for n in of])


def first_line(rows: DataFrame, pattern: str, missing: int = -1) -> DataFrame:
    """(doc_id, at): the first line_no that matches, of every document with lines."""
    return rows.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("line").rlike(pattern), F.col("line_no"))), F.lit(missing)).alias("at"))


#: What cuts a document, and how the words of all are looked for at once.
_MARKS = {"title": P.TITLE_START, "rights": "権利部", "kouku": "甲区", "otsuku": "乙区", "stop": P.TITLE_STOP, "collateral": P.COLLATERAL, "excluded": P.EXCLUDED_RIGHTS}
_WORDS = sorted({w for p in _MARKS.values() for w in p.split("|")})
_ANY_MARK = f"(?=[{''.join(sorted({w[0] for w in _WORDS}))}])(?:{'|'.join(_WORDS)})"


def split_sections(rows: DataFrame, chunk: int = CHUNK, only: str | None = None) -> DataFrame:
    """(doc_id, section, line_no, line) from lines (doc_id, line_no, line), line_no dense from 0: three rounds of first positions.

    The rounds are over the runs, a row each with the places of its lines that hold a word which cuts; the lines meet the result once.
    Of one section only, where it is named.
    """
    at, line = F.col("line_no"), F.col("line")
    own = in_runs(rows.select("doc_id", "line_no", "line"), "line_no", chunk)
    held = F.struct(at.alias("at"), *[line.rlike(p).alias(n) for n, p in _MARKS.items()])
    marks = own.where(line.rlike(_ANY_MARK)).groupBy(*_RUN).agg(F.collect_list(held).alias("marks"))  # chunk lines at most
    runs = own.groupBy(*_RUN).agg(F.count(F.lit(1)).alias("n")).join(marks, _RUN, "left")
    whole = Window.partitionBy("doc_id")

    def first(word: str, begin: Column | None = None, end: Column | None = None) -> Column:
        fit = lambda m: m[word] & (F.lit(True) if begin is None else m["at"] >= begin) & (F.lit(True) if end is None else m["at"] < end)
        return F.min(F.array_min(F.transform(F.filter("marks", fit), lambda m: m["at"]))).over(whole)

    runs = runs.select("*", F.sum("n").over(whole).alias("n_lines"), F.coalesce(first("title"), F.lit(0)).alias("title"), first("rights").alias("rights"), first("kouku").alias("heading"))
    runs = runs.withColumn("begin", F.coalesce("rights", "heading", F.least(F.col("n_lines"), F.col("title") + 120)))
    runs = runs.withColumn("title_end", F.when(F.col("begin") > F.col("title"), F.col("begin")).otherwise(F.col("n_lines")))
    right = lambda word: first(word, F.col("begin"))
    runs = runs.select("*", first("stop", F.col("title"), F.col("title_end")).alias("stop"), right("kouku").alias("k"), right("otsuku").alias("o"), right("collateral").alias("c"))
    n, k, o, c = F.col("n_lines"), F.col("k"), F.col("o"), F.col("c")
    both = k.isNotNull() & o.isNotNull()
    runs = runs.withColumn("k_from", F.coalesce(k, F.col("begin")))
    runs = runs.withColumn("k_to", F.when(both & (k < o), o).when(both, n).when(k.isNotNull(), F.when(c > k, c).otherwise(n)).otherwise(n))
    runs = runs.withColumn("cut", first("excluded", F.col("k_from"), F.col("k_to")))
    ranges = {
        "title": (F.col("title"), F.coalesce("stop", "title_end")),
        "rights": (F.col("begin"), n),
        "kouku": (F.col("k_from"), F.coalesce("cut", "k_to")),
        "otsuku": (F.when(both, o), F.when(k < o, F.when(c > o, c).otherwise(n)).otherwise(k)),
        "collateral": (c, n),
    }
    ends = [x.alias(f"{s}_{e}") for s, r in ranges.items() for e, x in zip(("a", "b"), r) if only in (None, s)]
    own = _joined(own, runs.select(*_RUN, *ends))
    if only:
        a, b = F.col(f"{only}_a"), F.col(f"{only}_b")
        return own.where((at >= a) & (at < b)).select("doc_id", F.lit(only).alias("section"), (at - a).cast("int").alias("line_no"), "line")
    of = lambda s: (F.col(f"{s}_a"), F.col(f"{s}_b"))
    lies = [F.when((at >= a) & (at < b), F.struct(F.lit(s).alias("section"), (at - a).cast("int").alias("line_no"))) for s, (a, b) in ((s, of(s)) for s in ranges)]
    return own.select("doc_id", F.explode(F.filter(F.array(*lies), lambda x: x.isNotNull())).alias("at"), "line").select("doc_id", "at.section", "at.line_no", "line")


def label_values(rows: DataFrame, label: str, ahead: int, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, value) of every document with lines: the value at its first line with the label, or in the `ahead` lines after it."""
    own = with_whole(in_runs(rows.select("doc_id", "line_no", "line"), "line_no", chunk), first=F.min(F.when(F.col("line").contains(label), F.col("line_no"))))
    near = F.col("line_no").between(F.col("first"), F.col("first") + ahead)
    held = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(near, F.struct("line_no", "line")))).alias("held"))  # ahead + 1 lines at most
    return held.select("doc_id", label_value(F.transform("held", lambda x: x["line"]), label, ahead).alias("value"))


def segment_entries(kouku: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, block_no, line_no, line) from the lines of the ownership register: a start line opens a block, lines before the first start are the first.

    So a line's block is the number of starts up to it, less one where the first line is a start.
    """
    line = F.col("line")
    body = kouku.where(~line.rlike("甲区|権利部") & ~is_header(line)).select("doc_id", "line_no", "line", is_entry_start(line).cast("int").alias("starts"))
    own = written(in_runs(body, "line_no", chunk))
    per = own.groupBy(*_RUN).agg(F.sum("starts").alias("n"), F.min(F.col("line_no").cast("long") * 2 + F.col("starts")).alias("first"))
    doc = Window.partitionBy("doc_id").orderBy("run")
    earlier = F.coalesce(F.sum("n").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opening = F.min("first").over(doc.rowsBetween(Window.unboundedPreceding, 0)) % 2  # the first run holds the first line
    inside = Window.partitionBy(*_RUN).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    block = F.col("carry") + F.sum("starts").over(inside)
    return _joined(own, per.select(*_RUN, (earlier - opening).alias("carry"))).select("doc_id", block.alias("block_no"), "line_no", "line")


def receipt_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, receipt): whether a block is a receipt number only, without joining its lines: its signs are counted."""
    text = compact(F.col("line"))
    some = F.when(text != "", F.struct("line_no", text.alias("t")))
    return lines.groupBy("doc_id", "block_no").agg(
        (
            F.coalesce(F.max(F.length(F.regexp_replace(text, "[0-9第号]", ""))) == 0, F.lit(False))
            & (F.sum(F.length(F.regexp_replace(text, "[^0-9]", ""))) > 0)
            & (F.sum(F.length(F.regexp_replace(text, "[^号]", ""))) == 1)
            & F.coalesce(F.max(some)["t"].endswith("号"), F.lit(False))
            & (F.sum(F.length(F.regexp_replace(text, "[^第]", ""))) == F.min(some)["t"].startswith("第").cast("int"))
        ).alias("receipt")
    )


def merge_receipt_blocks(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """segment_entries() with every other receipt-only block of a run merged into the next block, blocks numbered anew.

    A block's place in its run is its distance from the last block that is no receipt.
    """
    blocks = in_runs(receipt_blocks(lines), "block_no", chunk)
    blocks = with_whole(blocks, last_block=F.max("block_no"))
    blocks = with_running(blocks, "block_no", {"solid": ("max", F.when(~F.col("receipt"), F.col("block_no")))})
    odd = F.pmod(F.col("block_no") - F.coalesce("solid", F.lit(-1)), F.lit(2)) == 1
    blocks = blocks.withColumn("goes", (F.col("receipt") & odd & (F.col("block_no") < F.col("last_block"))).cast("int"))
    blocks = with_running(blocks, "block_no", {"gone": ("sum", F.col("goes"))})
    # a block that goes and the one it goes to have the same number of earlier ones that went
    placed = blocks.select("doc_id", "block_no", (F.col("block_no") - F.col("gone") + F.col("goes")).alias("to"))
    there = in_runs(lines, "line_no", chunk)
    # the blocks of a run of lines are one range: the join is by document, run and block
    spans = there.select("doc_id", "run", "block_no").distinct().join(placed, ["doc_id", "block_no"])
    return there.join(spans, ["doc_id", "run", "block_no"]).select("doc_id", F.col("to").alias("block_no"), "line_no", "line")


def block_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, lines): what the array forms return, joined; for documents of common size."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id", "block_no").agg(F.array_join(ordered, " | ").alias("lines"))


def clean_lines(raw: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, line) from raw lines (doc_id, line_no, line): cleaned, without empty and noise lines, numbered anew from 0."""
    # exploded, a value is cleaned once; in a filter it would be for each look at it
    good = F.filter(F.array(clean_value(F.coalesce("line", F.lit("")))), lambda x: (x != "") & ~noise_cleaned(x))
    kept = raw.select("doc_id", "line_no", F.explode(good).alias("line"))
    return with_running(in_runs(kept, "line_no", chunk), "line_no", {"nth": ("sum", F.lit(1))}).select("doc_id", (F.col("nth") - 1).alias("line_no"), "line")
