"""Line deduplication by content-defined chunks of lines, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: One boundary in so many lines, by the rolling hash.
EVERY = 4
#: A line of more words than this is a chunk by itself.
LONG = 50
#: A chunk of several lines has so many characters at least before it counts as repeated.
LEAST = 40


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _last(run: Column) -> Column:
    """The line at which the words of run (array of i, w) come to more than LONG; null if they do not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("i"))
    add = lambda a, t: F.when(a["n"] > LONG, a).otherwise(F.struct((a["n"] + t["w"]).alias("n"), t["i"].alias("i")))
    return F.aggregate(run, start, add, lambda a: F.when(a["n"] > LONG, a["i"]))


def _windows(full: str) -> Column:
    """(begin, end) of the shortest runs of over LONG words from each of the lines `full` (i, w), and up to each.

    Any run of whole lines with over LONG words between two lines with words is the union of the windows inside it:
    those from its lines reach the end of the last that fits, and the one up to its last line covers the rest.
    """
    ahead = F.transform(full, lambda s, p: F.struct(s["i"].alias("begin"), _last(F.slice(full, p + 1, LONG + 1)).alias("end")))
    behind = lambda p: F.reverse(F.slice(full, F.greatest(p - LONG, F.lit(0)) + 1, F.least(p, F.lit(LONG)) + 1))
    back = F.transform(full, lambda s, p: F.struct(_last(behind(p)).alias("begin"), s["i"].alias("end")))
    return F.filter(F.concat(ahead, back), lambda s: s["begin"].isNotNull() & s["end"].isNotNull())


def _chunked(rows: DataFrame, passages: bool = False) -> DataFrame:
    """rows (…, lines) with `chunks`: begin, end (line numbers, both inside), and x, the hash of the chunk's line hashes.

    Line i ends a chunk if the hash of the two hashes that end there is 0 modulo EVERY, or if it or the next line is
    long. That depends on lines close by alone, so lines put in before do not move later boundaries. Chunks that are
    too small to count are left out. passages adds the windows of several lines, which may overlap.
    """
    blank = F.lit(" "), F.lit("")
    marked = rows.withColumn("h", F.transform("lines", lambda t: F.xxhash64(t))).withColumn(
        "long", F.transform("lines", lambda t: F.length(t) - F.length(F.replace(t, *blank)) >= LONG)
    )
    n = F.size("lines")
    ends = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == n - 1)
        | F.get("long", i)
        | F.coalesce(F.get("long", i + 1), F.lit(False))
        | (F.pmod(F.xxhash64(F.coalesce(F.get("h", i - 1), F.lit(0).cast("long")), F.get("h", i)), F.lit(EVERY)) == 0),
    )
    cut = marked.withColumn("ends", ends)
    spans = F.transform("ends", lambda e, k: F.struct((F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 1).alias("begin"), e.alias("end")))
    cut = cut.withColumn("spans", spans)
    size = lambda s: F.aggregate(F.slice("lines", s["begin"] + 1, s["end"] - s["begin"] + 1), F.lit(0), lambda a, t: a + F.length(t))
    counted = F.filter("spans", lambda s: F.get("long", s["begin"]) | ((s["end"] > s["begin"]) & (size(s) >= LEAST)))
    cut = cut.withColumn("counted", counted)
    if passages:
        words = lambda t: F.when(F.length(F.trim(t)) > 0, F.length(t) - F.length(F.replace(t, *blank)) + 1).otherwise(0)
        cut = cut.withColumn("full", F.filter(F.transform("lines", lambda t, i: F.struct(i.alias("i"), words(t).alias("w"))), lambda s: s["w"] > 0))
        cut = cut.withColumn("counted", F.array_distinct(F.concat("counted", _windows("full"))))
    hashed = F.transform("counted", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.xxhash64(F.slice("h", s["begin"] + 1, s["end"] - s["begin"] + 1)).alias("x")))
    return cut.withColumn("chunks", hashed)


def _merged(spans: Column) -> Column:
    """spans (begin, end, …), ascending, as stretches (begin, end): those that overlap are one."""
    empty = F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"), F.lit(None).cast("struct<begin:int,end:int>").alias("at"))

    def add(a: Column, s: Column) -> Column:
        new = F.struct(s["begin"].alias("begin"), s["end"].alias("end"))
        longer = F.struct(a["at"]["begin"].alias("begin"), F.greatest(a["at"]["end"], s["end"]).alias("end"))
        moved = F.struct(F.when(a["at"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["at"]))).alias("done"), new.alias("at"))
        return F.when(a["at"].isNotNull() & (s["begin"] <= a["at"]["end"]), F.struct(a["done"].alias("done"), longer.alias("at"))).otherwise(moved)

    return F.aggregate(spans, empty, add, lambda a: F.when(a["at"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["at"]))))


def _text(lines: str, begin: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, begin + 1, end - begin + 1), "\n")


def repeated_spans(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(id, th, spans) of the docs (doc_id, text) that hold candidates: chunks whose 64-bit hash repeats.

    th is the text's hash; a span has begin, end, x, and `first`, true at the copy that stays: the one of the least
    (doc_id, text hash, line). A window that overlaps its own first copy is no second one and stays too.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("lines"))
    # explode_outer, since explode would put a filter with the whole of `chunks` written out below the projections
    cut = _chunked(rows, passages).select("id", "th", F.explode_outer("chunks").alias("c")).where("c is not null")
    chunks = stored(cut.select("id", "th", "c.begin", "c.end", "c.x"), "chunks")
    often = chunks.groupBy("x").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1").select("x", "low")
    found = stored(chunks.join(often, "x"), "repeated")
    least = found.where("id = low").groupBy("x").agg(F.min(F.struct("id", "th", "begin", "end")).alias("f"))
    stays = (F.col("id") == F.col("f.id")) & (F.col("th") == F.col("f.th")) & (F.col("begin") <= F.col("f.end"))
    marked = found.join(least, "x").withColumn("first", stays)
    return marked.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "x", "first"))).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__th"), *[F.col(f"`{c}`") for c in docs.columns])


def _unequal(rows: DataFrame) -> DataFrame:
    """(x): hashes that stand for different bytes, found by grouping the candidates' texts themselves."""
    texts = rows.where("__spans is not null").select(_lines(F.col("text")).alias("lines"), "__spans", F.size("__spans").alias("n"))
    texts = texts.select(F.explode_outer(F.transform("__spans", lambda c: F.struct(c["x"].alias("x"), _text("lines", c["begin"], c["end"]).alias("t")))).alias("c")).select("c.x", "c.t")
    return texts.groupBy("x", "t").agg(F.count("*").alias("n")).groupBy("x").agg(F.count("*").alias("kinds")).where("kinds > 1").select("x")


def deduplicate(docs: DataFrame, report: bool = False, passages: bool = False) -> DataFrame:
    """docs without the chunks of lines that an earlier document, or an earlier place of the same one, holds.

    A chunk is a long line or several lines (see _chunked). Chunks are matched by hash and then byte for byte: a hash
    that stands for two different texts removes nothing. Every row stays, with all its columns; n_chars, if there,
    follows the text. A text that loses all its lines is empty. Null texts and rows with a null doc_id stay as they
    are; repeated rows count as one. report adds removed_chunks and removed_lines.

    passages removes, besides, every run of whole lines with over LONG words together that an earlier place holds,
    wherever the boundaries lie (see _windows). A line goes only if an earlier place has it, so the first copy of each
    stays; chunks that overlap are removed, and counted, as one stretch.

    Whole texts are shuffled once, to meet their candidates; that table is stored and serves both the comparison of
    bytes and the result. The hint keeps that plan at every size.
    """
    spans = repeated_spans(docs.select("doc_id", "text"), passages).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    rows = stored(_keyed(docs).join(spans.hint("merge"), ["__id", "__th"], "left"), "candidates")
    unequal = stored(_unequal(rows), "unequal")
    if not unequal.isEmpty():  # two texts of one 64-bit hash
        held = rows.where("__spans is not null").select("__id", "__th", F.explode("__spans").alias("s")).join(unequal, F.col("s.x") == F.col("x"))
        held = held.groupBy("__id", "__th").agg(F.collect_set("x").alias("__held"))
        rows = rows.join(held, ["__id", "__th"], "left")
        rows = rows.withColumn("__spans", F.filter("__spans", lambda s: ~F.array_contains(F.coalesce("__held", F.array().cast("array<long>")), s["x"])))
    rows = rows.withColumn("__gone", _merged(F.filter("__spans", lambda s: ~s["first"])))
    lost = F.size("__gone") > 0
    rows = rows.withColumn("__lines", F.when(lost, _lines(F.col("text"))))
    kept = F.transform(
        F.sequence(F.lit(0), F.size("__gone")),
        lambda j: F.slice(
            "__lines",
            F.coalesce(F.get("__gone", j - 1)["end"] + 1, F.lit(0)) + 1,
            F.coalesce(F.get("__gone", j)["begin"], F.size("__lines")) - F.coalesce(F.get("__gone", j - 1)["end"] + 1, F.lit(0)),
        ),
    )
    out = rows.withColumn("__text", F.when(lost, F.array_join(F.flatten(kept), "\n")).otherwise(F.col("text")))
    made = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(lost, F.length("__text").cast("long")).otherwise(F.col("n_chars"))
    cols = [made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns]
    if report:
        lines = F.aggregate("__gone", F.lit(0), lambda a, s: a + s["end"] - s["begin"] + 1)
        cols += [F.when(lost, F.size("__gone")).otherwise(0).alias("removed_chunks"), F.when(lost, lines).otherwise(0).alias("removed_lines")]
    return out.select(*cols)
