"""Markdown tables of pages, mended so that they can be read as tables, in DataFrame steps.

A page's lines are rows of a shuffle on (doc_id, page). Lines that go on in the next ones are closed by a look ahead;
neighbouring table lines are a run, numbered by a running count; a run is cut where a second table begins in it; and what
a part's labels, width and body are follows from the classes of its rows, as expressions over one array. A last
aggregation puts the lines of a page together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import trim_all

#: A cell goes on over so many lines at most; a cell of a rule; a cell that is a table's caption.
WRAPPED = 8
DASHES, CAPTION = r"^:?-+:?$", r"(?i)^[*_]*(?:table|tab\.|figure|fig\.|exhibit|chart)\s*[A-Z]?[.-]?\d"
#: What a cut run is: parts by their first row and the row after their last, with the caption that stood behind.
_CUTS = "array<struct<start:int,stop:int,caption:string>>"


def _begins(s: Column) -> Column:
    return F.startswith(s, F.lit("|"))


def _closes(s: Column) -> Column:
    return F.endswith(s, F.lit("|"))


def _whole_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, n, line, joined: lines, with those of a row whose cells were written over several in one. A line that
    begins with a bar and doesn't close with one goes on to the next line that does, if that is near and neither a blank
    line nor a new row lies between."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line")).withColumn("s", trim_all(F.col("line")))
    page = Window.partitionBy("doc_id", "page").orderBy("n")
    end = F.when((F.col("s") == "") | _begins(F.col("s")) | _closes(F.col("s")), F.struct("n", (_closes(F.col("s")) & ~_begins(F.col("s"))).alias("closes")))
    ahead = F.first(end, ignorenulls=True).over(page.rowsBetween(1, WRAPPED))
    opens = _begins(F.col("s")) & ~_closes(F.col("s")) & (F.char_length("s") > 1) & F.coalesce(ahead["closes"], F.lit(False))
    lines = lines.withColumn("opened", F.when(opens, F.struct("n", ahead["n"].alias("to"))))
    last = F.last("opened", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("last", last).withColumn("first", F.when(F.col("n") <= F.col("last.to"), F.col("last.n")).otherwise(F.col("n")))
    each = F.array_sort(F.collect_list(F.struct("n", "s", "line")))
    whole = lines.groupBy("doc_id", "page", F.col("first").alias("n")).agg(each.alias("each"))
    joined = F.size("each") > 1
    return whole.select("doc_id", "page", "n", F.when(joined, F.array_join(F.col("each.s"), " ")).otherwise(F.col("each")[0]["line"]).alias("line"), joined.alias("joined"))


def _cells(s: Column) -> Column:
    """The trimmed cells of a table line; a bar after a backslash belongs to its cell."""
    inner = F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), trim_all)


def _names(cells: Column) -> Column:
    return F.filter(cells, lambda c: c != "")


def _digits(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.rlike(r"\d"))


def _classed(lines: DataFrame) -> DataFrame:
    """Lines with is_row and, for rows, r: line, cells, whether they are a rule, and the caption that they may be."""
    s = trim_all(F.col("line"))
    bars = F.regexp_count(F.replace(s, F.lit("\\|"), F.lit("")), F.lit(r"\|"))
    cells = _cells(s)
    rows = lines.withColumns({"is_row": (s != "") & (_begins(s) | _closes(s) | (bars >= 2)), "cells": cells})
    dashes = F.size(F.filter("cells", lambda c: c.rlike(DASHES)))
    rule = (2 * dashes > F.size("cells")) & (dashes + F.size(F.filter("cells", lambda c: c == "")) == F.size("cells"))
    name = F.get(_names(F.col("cells")), F.lit(0))
    caption = F.when((F.size(_names(F.col("cells"))) == 1) & name.rlike(CAPTION), F.regexp_replace(name, r"^\*+|\*+$", ""))
    return rows.select("doc_id", "page", "n", "line", "joined", "is_row", F.when(F.col("is_row"), F.struct("line", "cells", rule.alias("rule"), caption.alias("caption"))).alias("r"))


def _cuts(r: str) -> str:
    """SQL for the parts of a run whose second row is a rule. A later rule below a row of names begins another table from
    that row on, and a caption above goes between; but the same names once more are left out with their rule, and a table
    that would be left with fewer than three rows stays with the rest."""
    back = f"if({r}[p - 2].caption is null, 1, 2)"
    kept = "'stop', {stop}, 'dropped', {dropped}, 'cuts', {cuts}"
    state = lambda start, gone, stop, dropped, cuts: f"named_struct('start', {start}, 'gone', {gone}, " + kept.format(stop=stop, dropped=dropped, cuts=cuts) + ")"
    return f"""aggregate(if(size({r}) > 4, filter(sequence(4, size({r}) - 1), p -> {r}[p].rule and not {r}[p - 1].rule), cast(array() as array<int>)),
        {state("0", "0", f"not coalesce(get({r}, 1).rule, false)", "cast(array() as array<int>)", f"cast(array() as {_CUTS})")},
        (s, p) -> case when s.stop or p - s.start - s.gone < 4 then s
            when {r}[p - 1].cells = {r}[s.start].cells then {state("s.start", "s.gone + 2", "false", "concat(s.dropped, array(p - 1, p))", "s.cuts")}
            when p - {back} - s.start - s.gone < 3 then {state("s.start", "s.gone", "true", "s.dropped", "s.cuts")}
            else {state("p - 1", "0", "false", "s.dropped", f"concat(s.cuts, array(named_struct('start', s.start, 'stop', p - {back}, 'caption', {r}[p - 2].caption)))")} end)"""


def _padded(cells: Column, width: Column) -> Column:
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def _written(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _labels(heads: Column, width: Column) -> Column:
    """One label a column. Where all heading rows are full, the lowest name; else the row with most names gives them, and
    the next one what is missing at the ends."""
    at = F.sequence(F.lit(0), width - 1)
    full = (F.size(heads) > 1) & F.forall(heads, lambda h: F.size(h) == width)
    lowest = F.transform(at, lambda c: F.coalesce(F.try_element_at(F.filter(F.transform(heads, lambda h: F.get(h, c)), lambda x: x != ""), F.lit(-1)), F.lit("")))
    ranked = F.array_sort(F.transform(heads, lambda h, i: F.struct((-F.size(_names(h))).alias("k"), i.alias("i"), h.alias("h"))))
    fine = F.coalesce(F.get(ranked, F.lit(0))["h"], F.array().cast("array<string>"))
    names, ends = _names(fine), _names(F.coalesce(F.get(ranked, F.lit(1))["h"], F.array().cast("array<string>")))
    left, right = F.coalesce(F.get(ends, F.lit(0)), F.lit("")), F.when(F.size(ends) > 1, F.try_element_at(ends, F.lit(-1))).otherwise("")
    filled = F.transform(fine, lambda c, i: F.when(c != "", c).when(i == 0, left).when(i == width - 1, right).otherwise(""))
    missing = width - F.size(names)
    return (
        F.when(full, lowest).when(F.size(fine) == width, filled).when(missing == 1, F.concat(F.array(left), names))
        .when((missing == 2) & (F.size(ends) > 1), F.concat(F.array(left), names, F.array(right))).otherwise(_padded(names, width))
    )


def _mended(parts: DataFrame) -> DataFrame:
    """``parts`` (p: the rows) with fixed: the part's lines as one well-formed table, null where they may stay as they are."""
    cells = F.col("p.cells")
    bare = lambda k: F.coalesce(F.get(F.col("p"), F.lit(k))["cells"], F.array().cast("array<string>"))
    rules = F.filter(F.transform("p", lambda x, i: F.when(x["rule"], i)), lambda i: i.isNotNull())
    rest = F.slice(cells, F.lit(3), F.greatest(F.size("p") - 2, F.lit(0)))
    rows = parts.withColumns({"last": F.array_max(rules), "n_rules": F.size(rules), "rest": rest})
    # a lone title above a row of names, and values below
    titled = (F.size("p") > 2) & (F.size(_names(bare(0))) == 1) & (F.get(bare(0), F.lit(0)) != "") & (F.size(bare(1)) > 1) & F.forall(bare(1), lambda c: c != "") & ~_digits(bare(1)) & F.exists("rest", _digits)
    sound = (F.col("n_rules") == 1) & (F.col("last") == 1) & (F.size(bare(1)) == F.size(bare(0))) & (F.size(_names(bare(0))) > 0) & F.forall("rest", lambda c: F.size(c) <= F.size(bare(0)))
    body = F.slice(cells, F.col("last") + 2, F.greatest(F.size("p") - F.col("last") - 1, F.lit(0)))
    above = F.transform(F.filter(F.slice(F.col("p"), F.lit(1), F.col("last")), lambda x: ~x["rule"]), lambda x: x["cells"])
    rows = rows.withColumns({"body": body, "above": above}).withColumn("width", F.array_max(F.transform("body", F.size)))
    # names right below the dashes are labels too, as long as those above don't name every column
    value = F.transform("body", lambda c, i: F.when(_digits(c) | (F.size(_names(c)) >= F.col("width")), i))
    short = F.coalesce(F.array_max(F.transform("above", lambda h: F.size(_names(h)))), F.lit(0)) < F.col("width")
    more = F.when(short, F.least(F.coalesce(F.array_min(value), F.size("body")), F.size("body") - 1)).otherwise(0)
    rows = rows.withColumn("more", F.greatest(more, F.lit(0)))
    rows = rows.withColumns({"heads": F.concat("above", F.slice("body", F.lit(1), F.col("more"))), "body": F.slice("body", F.col("more") + 1, F.size("body"))})
    rows = rows.withColumn("labels", F.when(F.col("width") > 0, _labels(F.col("heads"), F.col("width"))))
    table = lambda labels, body: F.concat(F.array(_written(labels), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(labels)))), F.transform(body, lambda c: _written(_padded(c, F.size(labels)))))
    with_title = F.concat(F.array(F.concat(F.lit("**"), F.get(bare(0), F.lit(0)), F.lit("**")), F.lit("")), table(bare(1), F.col("rest")))
    fixed = F.when((F.size("p") > 1) & (F.col("n_rules") == 0) & titled, with_title).when((F.size("p") > 1) & (F.col("n_rules") > 0) & ~sound & (F.size("body") > 0), table(F.col("labels"), F.col("body")))
    return rows.withColumn("fixed", fixed)


def repair_tables(pages: DataFrame) -> DataFrame:
    """``pages`` (one row for each doc_id and page) with mended text, and repaired, joined_rows, separated of each page: the
    tables rebuilt, rows joined from several lines, and blank lines put between tables and what follows them. Well-formed
    tables stay as they are. Null text becomes empty."""
    page = Window.partitionBy("doc_id", "page").orderBy("n")
    lines = _classed(_whole_lines(pages))
    starts = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(page), F.lit(False))
    lines = lines.withColumns({"run": F.sum(starts.cast("int")).over(page), "next": F.lead("line").over(page)})
    runs = lines.where("is_row").groupBy("doc_id", "page", "run").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "r", "next"))).alias("each"))
    runs = runs.select("doc_id", "page", "n", F.col("each.r").alias("r"), F.try_element_at(F.col("each.next"), F.lit(-1)).alias("after")).withColumn("cut", F.expr(_cuts("r")))
    whole = "concat(cut.cuts, array(named_struct('start', cut.start, 'stop', size(r), 'caption', cast(null as string))))"
    parts = runs.select("doc_id", "page", "n", "r", "after", F.col("cut.dropped").alias("dropped"), F.expr(whole).alias("parts")).select("*", F.posexplode("parts").alias("k", "part"))
    rows = F.expr("transform(filter(sequence(part.start, part.stop - 1), i -> not array_contains(dropped, i)), i -> r[i])")
    parts = _mended(parts.withColumns({"p": rows, "caption": F.when(F.col("k") > 0, F.get("parts", F.col("k") - 1)["caption"])}))
    none = F.array().cast("array<string>")
    lead = F.when(F.col("k") == 0, none).when(F.col("caption").isNotNull(), F.array(F.lit(""), F.concat(F.lit("**"), "caption", F.lit("**")), F.lit(""))).otherwise(F.array(F.lit("")))
    glued = (F.col("k") == F.size("parts") - 1) & (F.size("r") > 1) & (trim_all(F.coalesce("after", F.lit(""))) != "")
    text = F.concat(lead, F.coalesce("fixed", F.col("p.line")), F.when(glued, F.array(F.lit(""))).otherwise(none))
    apart = F.size(F.filter(lead, lambda x: x == "")) + glued.cast("int")
    tabled = parts.select("doc_id", "page", "n", "k", text.alias("lines"), F.col("fixed").isNotNull().cast("int").alias("repaired"), apart.alias("separated"))
    others = lines.where("not is_row").select("doc_id", "page", "n", F.lit(0).alias("k"), F.array("line").alias("lines"), F.lit(0).alias("repaired"), F.lit(0).alias("separated"))
    joined = lines.groupBy("doc_id", "page").agg(F.count_if("joined").cast("int").alias("joined_rows"))
    every = tabled.unionByName(others).groupBy("doc_id", "page").agg(
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "lines"))), lambda x: x["lines"])), "\n").alias("text"),
        F.sum("repaired").cast("int").alias("repaired"), F.sum("separated").cast("int").alias("separated"),
    )
    found = every.join(joined, ["doc_id", "page"])
    return pages.drop("text").join(found, ["doc_id", "page"]).select(*pages.columns, "repaired", "joined_rows", "separated")
