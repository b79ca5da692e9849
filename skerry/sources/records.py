"""Records of delimited text over any number of lines, files and input splits.

A quoted cell may hold line breaks, so where a record begins depends on everything before it. Each line is taken as a function of one bit,
whether the line before it left a quote open: a fold over its cells says, for both cases, whether it leaves one open and
how many cells it ends. Lines compose: within an input split by the last line whose outcome doesn't depend on the bit and the parity of those
that turn it round since, over splits by a fold over one row for each. So a file of many splits is read once and in parallel, and only lines that
share a record are brought together.

A quote opens a cell only at its start; two quotes inside are one; what follows the closing quote up to the separator belongs to the
cell. A quote left open at the file's end closes there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.session import shared_folder, written

WHERE = ["file", "block"]


def step(cells: Column, open_at_start: bool) -> Column:
    """(open, cells): whether a quote is open after the line, and how many cells end in it."""

    def closes(text: Column) -> Column:
        return F.contains(F.replace(text, F.lit('""'), F.lit("")), F.lit('"'))

    def over(at: Column, cell: Column) -> Column:
        opened = F.when(at["open"], ~closes(cell)).otherwise(F.startswith(cell, F.lit('"')) & ~closes(F.substr(cell, F.lit(2))))
        # the struct is built from one evaluation of the condition
        return F.get(F.transform(F.array(opened), lambda o: F.struct(o.alias("open"), (at["cells"] + F.when(o, 0).otherwise(1)).alias("cells"))), F.lit(0))

    return F.aggregate(cells, F.struct(F.lit(open_at_start).alias("open"), F.lit(0).alias("cells")), over)


def stepped(lines: DataFrame, sep: str) -> DataFrame:
    """lines with the outcomes of step() for a closed (_c) and an open (_o) start. Lines without a quote need no fold."""
    cells = F.split("value", re.escape(sep))
    plain = ~F.contains("value", F.lit('"'))

    def fixed(opened: bool, n: Column) -> Column:
        return F.struct(F.lit(opened).alias("open"), n.cast("int").alias("cells"))

    closed = F.when(plain, fixed(False, F.size(cells))).otherwise(step(cells, False))
    return lines.withColumn("_c", closed).withColumn("_o", F.when(plain, fixed(True, F.lit(0))).otherwise(step(cells, True)))


def placed(lines: DataFrame, sep: str, folder: str) -> DataFrame:
    """lines (file, block, at, value) with record (from 1 in each file), physical_line (from 1), starts (the record begins here), open (a quote is
    open after the line), and cells (how many end in it). block orders a file's input splits, at the lines of one.
    Lines and their outcomes are a table in folder, so they are read and folded once, and the splits' outcomes take no text along."""
    own = Window.partitionBy(*WHERE).orderBy("at")
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("_c.open") == F.col("_o.open")
    lines = written(stepped(lines, sep), f"{folder}/lines").withColumn("_turns", F.when(F.col("_c.open") & ~F.col("_o.open"), 1).otherwise(0))
    lines = lines.withColumn("_sum", F.sum("_turns").over(upto))
    last = F.when(fixed, F.struct(F.col("_c.open").alias("open"), F.col("_sum").alias("sum")))
    turned = F.coalesce(F.sum("_turns").over(before), F.lit(0))
    lines = lines.withColumn("_last", F.last(last, ignorenulls=True).over(before)).withColumn("_turned", turned)

    def start(came_open: bool) -> Column:
        """Whether a quote is open where the line starts, if one was, or not, where its split starts."""
        odd = (F.col("_turned") - F.coalesce("_last.sum", F.lit(0))) % 2 == 1
        return F.coalesce("_last.open", F.lit(came_open)) != odd

    lines = lines.select(*WHERE, "at", "value", "_c", "_o", start(False).alias("_sc"), start(True).alias("_so"), F.row_number().over(own).alias("_n"))
    for s in ("c", "o"):
        lines = lines.withColumn(f"_r{s}", F.sum(F.when(F.col(f"_s{s}"), 0).otherwise(1)).over(upto))
    after = {s: F.when(F.col(f"_s{s}"), F.col("_o.open")).otherwise(F.col("_c.open")) for s in "co"}
    ends = lines.groupBy(*WHERE).agg(F.max("_n").alias("lines"), *(F.max("_r" + s).alias("n" + s) for s in "co"), *(F.max_by(after[s], "at").alias("e" + s) for s in "co"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("records"), F.lit(0).cast("long").alias("lines"))
    taken = lambda at, e: F.struct(F.when(at["open"], e["eo"]).otherwise(e["ec"]).alias("open"), (at["records"] + F.when(at["open"], e["no"]).otherwise(e["nc"])).alias("records"), (at["lines"] + e["lines"]).alias("lines"))
    came = ends.select(*WHERE, F.aggregate(F.collect_list(F.struct("lines", "nc", "no", "ec", "eo")).over(earlier), nothing, taken).alias("_came"))
    lines = lines.join(came, WHERE)
    by = lambda c, o: F.when(F.col("_came.open"), F.col(o)).otherwise(F.col(c))
    lines = lines.select("file", "block", "at", "value", "_c", "_o", by("_sc", "_so").alias("_s"), (F.col("_came.records") + by("_rc", "_ro")).alias("record"), (F.col("_came.lines") + F.col("_n")).alias("physical_line"))
    done = F.when(F.col("_s"), F.col("_o")).otherwise(F.col("_c"))
    return lines.select("file", "block", "at", "value", "record", "physical_line", (~F.col("_s")).alias("starts"), done["open"].alias("open"), done["cells"].alias("cells"))


def records(lines: DataFrame, sep: str, longest: int, folder: str | None = None) -> DataFrame:
    """(file, record, physical_line, cells, value): a row for each record; physical_line is its first. value is null for a record of more than
    `longest` characters, of which only the cells are counted. A blank line is a record of no cells. Lines of one record alone are shuffled by record.
    Placed lines are a table in folder (a new one of the cluster, if none is given), which the result is read from."""
    folder = folder or shared_folder(lines.sparkSession, "csv-rows")
    lines = written(placed(lines, sep, folder), f"{folder}/placed")
    ended = lambda c: F.regexp_replace(c, "\r$", "")
    alone = F.col("starts") & ~F.col("open")
    text = ended(F.col("value"))
    single = lines.where(alone).select("file", "record", "physical_line", F.when(text == "", 0).otherwise(F.col("cells")).alias("cells"), F.when(F.char_length(text) <= longest, text).alias("value"))
    parts = lines.where(~alone)
    sizes = parts.groupBy("file", "record").agg(F.min("physical_line").alias("physical_line"), F.sum("cells").alias("cells"), F.max_by("open", "physical_line").alias("unended"), F.sum(F.char_length("value") + 1).alias("length"))
    sizes = sizes.select("file", "record", F.col("physical_line").alias("first"), (F.col("cells") + F.when(F.col("unended"), 1).otherwise(0)).cast("int").alias("cells"), "length")
    short = sizes.where(F.col("length") <= longest)
    held = parts.select("file", "record", "physical_line", "value").join(short.select("file", "record", "first", F.col("cells").alias("all")), ["file", "record"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("physical_line", "value"))), lambda x: x["value"]), "\n")
    several = held.groupBy("file", "record", "first", "all").agg(ended(joined).alias("value")).select("file", "record", F.col("first").alias("physical_line"), F.col("all").alias("cells"), "value")
    long = sizes.where(F.col("length") > longest).select("file", "record", F.col("first").alias("physical_line"), "cells", F.lit(None).cast("string").alias("value"))
    return single.union(several).union(long)
