"""Pages to units to chunks, and chunks to token-budgeted groups.

The text work (splitting, joining) is column expressions. The two greedy folds only need token counts, so Arrow
carries arrays of integers, never text: one array per page (or document) in, unit ranges out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def _word_windows(sentence: Column, count: Callable[[Column], Column], budget: int) -> Column:
    """Cut one over-long sentence into runs of words whose summed counts stay within the budget."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("used"))

    def add(state: Column, word: Column) -> Column:
        n = count(word)
        full = (state["buf"] != "") & (state["used"] + n > budget)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["buf"]))).otherwise(state["done"]).alias("done"),
            F.when(full | (state["buf"] == ""), word)
            .otherwise(F.concat(state["buf"], F.lit(" "), word)).alias("buf"),
            F.when(full, n).otherwise(state["used"] + n).alias("used"))

    return F.aggregate(X.bounded_words(sentence), start, add, lambda s: F.filter(
        F.concat(s["done"], F.array(s["buf"])), lambda p: p != ""))


def unit_array(col: Column, budget: int, count: Callable[[Column], Column] = X.n_tokens, windows: bool = True) -> Column:
    """Pieces that each fit the budget: paragraphs, else their sentences, else windows of words (left out without ``windows``)."""

    def non_empty(parts: Column) -> Column:
        return F.filter(F.transform(parts, X.strip), lambda p: p != "")

    def sentence(s: Column) -> Column:
        return F.when(count(s) <= budget, F.array(s)).otherwise(
            _word_windows(s, count, budget) if windows else F.array().cast("array<string>"))

    def paragraph(p: Column) -> Column:
        return F.when(count(p) <= budget, F.array(p)).otherwise(
            F.flatten(F.transform(non_empty(F.split(p, X.SENTENCE_GAP)), sentence)))

    return F.flatten(F.transform(non_empty(F.split(col, "\n\n")), paragraph))


def units(pages: DataFrame, budget: int = 500, keys: tuple[str, ...] = ("doc_id", "page"), text: str = "text",
          count: Callable[[Column], Column] = X.n_tokens, windows: bool = True, outer: bool = False) -> DataFrame:
    """One row per unit: keys, ``ord`` from 0, ``text``, ``n_tokens``. Without ``windows`` whole paragraphs and sentences only.
    With ``outer`` a page without units is one row whose other columns are NULL."""
    # outer + filter: a plain explode makes Spark test the array's size first, which computes the array twice
    rows = pages.select(*keys, F.posexplode_outer(unit_array(F.col(text), budget, count, windows)).alias("ord", "text"))
    return _counted(rows, count, outer)


def _counted(rows: DataFrame, count: Callable[[Column], Column], outer: bool) -> DataFrame:
    if outer:
        return rows.withColumn("n_tokens", F.when(F.col("ord").isNotNull(), count(F.col("text"))))
    return rows.filter("ord IS NOT NULL").withColumn("n_tokens", count(F.col("text")))


def pack_ranges(counts: Column, max_tokens: int, overlap: int) -> Column:
    """Token counts of consecutive units -> (first, last) unit of every chunk, as one fold over the counts.

    A chunk closes when the next unit would overflow it. The next chunk reopens with the trailing units that fit
    in ``overlap`` and still leave room for that unit.
    """
    size = F.size(counts)

    def fold(counts: Column) -> Column:
        empty = F.struct(F.lit(0).alias("first"), F.lit(0).cast("bigint").alias("used"),
                         F.array().cast(RANGES).alias("out"))

        def step(s: Column, i: Column) -> Column:
            n = F.element_at(counts, i + 1)
            full = (i > s["first"]) & (s["used"] + n > max_tokens)
            # tail sums from the end of the closing chunk: how many of its last units come along
            tail = F.aggregate(
                F.reverse(F.slice(counts, s["first"] + 1, F.greatest(i - s["first"], F.lit(0)))),
                F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("kept"), F.lit(True).alias("open")),
                lambda t, x: F.when(t["open"] & (t["kept"] + x <= overlap) & (t["kept"] + x + n <= max_tokens),
                                    F.struct((t["n"] + 1).alias("n"), (t["kept"] + x).alias("kept"), F.lit(True).alias("open")))
                .otherwise(F.struct(t["n"].alias("n"), t["kept"].alias("kept"), F.lit(False).alias("open"))))
            return F.when(full, X.let(tail, lambda t: F.struct(
                (i - t["n"]).alias("first"), (t["kept"] + n).alias("used"),
                F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), (i - 1).alias("last")))).alias("out")))
            ).otherwise(F.struct(s["first"].alias("first"), (s["used"] + n).alias("used"), s["out"].alias("out")))

        steps = F.when(F.size(counts) > 0, F.sequence(F.lit(0), F.size(counts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, empty, step, lambda s: F.when(F.size(counts) > 0, F.concat(
            s["out"], F.array(F.struct(s["first"].alias("first"), (F.size(counts) - 1).alias("last"))))).otherwise(s["out"]))

    return F.when(size >= 0, X.let(F.transform(counts, lambda c: c.cast("bigint")), fold))


def chunk_pages(pages: DataFrame, max_tokens: int = 500, overlap: int = 80,
                keys: tuple[str, ...] = ("doc_id", "page"), text: str = "text",
                count: Callable[[Column], Column] = X.n_tokens, outer: bool = False) -> DataFrame:
    """Page-aware chunks with overlap: keys, ``ord`` within the page, ``text``, ``n_tokens``.

    Row-local from end to end (no shuffle): a page is one row, so it can never leak into another one. With ``outer`` a page
    without chunks is one row whose other columns are NULL.
    """
    with_units = pages.select(*keys, unit_array(F.col(text), max_tokens, count).alias("_units"))
    counted = with_units.withColumn("_ranges", pack_ranges(F.transform("_units", lambda u: count(u)), max_tokens, overlap))
    rows = counted.select(*keys, "_units", F.posexplode_outer("_ranges").alias("ord", "_r"))
    joined = F.array_join(F.slice("_units", F.col("_r.first") + 1, F.col("_r.last") - F.col("_r.first") + 1), "\n")
    return _counted(rows.select(*keys, "ord", joined.alias("text")), count, outer)


def chunk_lists(pages: DataFrame, max_tokens: int = 500, overlap: int = 80, keys: tuple[str, ...] = ("doc_id", "page"),
                text: str = "text", count: Callable[[Column], Column] = X.n_tokens) -> DataFrame:
    """The chunks of :func:`chunk_pages` as one row per page: keys, ``chunks`` (ord, text, n_tokens), in order, without any
    shuffle; empty for a page without text."""
    with_units = pages.select(*keys, unit_array(F.col(text), max_tokens, count).alias("_units"))
    counted = with_units.withColumn("_ranges", pack_ranges(F.transform("_units", lambda u: count(u)), max_tokens, overlap))
    joined = F.transform("_ranges", lambda r: F.array_join(F.slice("_units", r["first"] + 1, r["last"] - r["first"] + 1), "\n"))
    return counted.select(*keys, F.transform(joined, lambda t, i: F.struct(i.alias("ord"), t.alias("text"), count(t).alias("n_tokens"))).alias("chunks"))


def chunk_meta(chunks: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``source, course, mtime`` of the document, and ``label, ocr`` of the page, to every chunk."""
    d = docs.select("doc_id", F.col("path").alias("source"), "course", "mtime")
    p = pages.select("doc_id", "page", "label", F.coalesce("ocr", F.lit(False)).alias("ocr"))
    return chunks.join(p, ["doc_id", "page"], "left").join(d, "doc_id")


def text_status(pages: DataFrame, min_per_page: int = 30) -> DataFrame:
    """Per document: visible characters, pages, and ``ok`` / ``empty_text``. Paged files need 30 per page."""
    g = pages.groupBy("doc_id").agg(F.sum(X.ink_chars(F.col("text"))).alias("chars"),
                                    F.count("*").alias("pages"), F.max("mime").alias("mime"))
    need = F.when(F.col("mime") == X.MIME_BY_EXTENSION["pdf"], F.col("pages") * min_per_page).otherwise(1)
    return g.select("doc_id", "chars", "pages", F.when(F.col("chars") >= need, "ok").otherwise("empty_text")
                    .alias("status"))


def drop_repeated(blocks: DataFrame, scope: str = "doc_id", block: str = "block", pos: str = "pos") -> DataFrame:
    """Blocks whose content occurs once in their file; anything repeated is template furniture.

    One aggregation keyed on (file, hash), so a block repeated a million times collapses map-side.
    """
    g = blocks.groupBy(scope, F.sha1(F.col(block)).alias("_sha")).agg(
        F.count("*").alias("_n"), F.min_by(F.struct(pos, block), F.col(pos)).alias("_b"))
    return g.filter("_n = 1").select(scope, f"_b.{pos}", f"_b.{block}")


def sections(lines: DataFrame, keys: list[str], order: str = "ord", text: str = "text",
             heading: str = "is_heading") -> DataFrame:
    """Cut each document's lines at its headings: keys, ``section`` number, ``label`` (the heading), ``text``.

    Text before the first heading has a NULL label; sections without any text are dropped.
    """
    from .scan import running_total

    numbered = running_total(lines, keys, order, F.col(heading).cast("int"), "section")
    parts = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text))))
    g = numbered.groupBy(*keys, "section").agg(
        F.max(F.when(F.col(heading), F.col(text))).alias("label"),
        F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("_body"))
    return g.withColumn("text", X.tidy_layout(F.col("_body"))).filter("text <> ''").drop("_body")


def group_ids(counts: Column, budget: int) -> Column:
    """Token counts in order -> group number of each item, as one fold; an oversize item stands alone."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        full = (F.size(s["out"]) > 0) & (s["used"] + n > budget)
        group = F.when(full, s["group"] + 1).otherwise(s["group"])
        return F.struct(group.alias("group"), F.when(full, n).otherwise(s["used"] + n).alias("used"),
                        F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(F.transform(counts, lambda c: c.cast("bigint")), start, step, lambda s: s["out"])


def token_groups(chunks: DataFrame, budget: int = 2500, key: str = "doc_id") -> DataFrame:
    """Consecutive chunks of a document packed to a token budget: key, ``ord``, ``group_no``.

    Only (ord, n_tokens) pairs are gathered. A document is one stored text, so its pair list is bounded by the
    size of that text; the chunk texts themselves never move.
    """
    g = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "n_tokens"))).alias("_c"))
    g = g.withColumn("_g", group_ids(F.transform("_c", lambda x: x["n_tokens"]), budget))
    pairs = F.arrays_zip(F.transform("_c", lambda x: x["ord"]).alias("ord"), F.col("_g").alias("group_no"))
    return g.select(key, F.inline(pairs).alias("ord", "group_no"))
