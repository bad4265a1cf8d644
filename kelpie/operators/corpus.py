"""Corpus shaping and the measures of retrieval quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of a summary, of a closed window, of a tail that stays alone; windows kept of a document; words of
# a lead and of a body that make an article; words of a heading; records of a batch.
SUMMARY_WORDS, WINDOW_WORDS, TAIL_WORDS, MOST_WINDOWS = 300, 800, 200, 10
LEAD_WORDS, BODY_WORDS, HEADING_WORDS, BATCH_ROWS = 60, 2400, 10, 250


#: Words of a sentence that becomes a query, and chunks of a document that is asked about.
SENTENCE_WORDS, LEAST_CHUNKS = (8, 40), 3
# Signs at whose end a line is no heading; white space.
CLOSING = ".!?:;,\"”)']"
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"


def words(text: Column) -> Column:
    """The blank-separated words; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE + "+"), lambda w: w != "")


def lead_summary(text: Column, n: int = SUMMARY_WORDS) -> Column:
    """The first n words, with single blanks between them."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def lines(text: Column) -> Column:
    """The lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")), lambda x: x != "")


def is_heading(line: Column) -> Column:
    """A heading is a line of at most HEADING_WORDS words that doesn't end in a closing sign."""
    return (line != "") & (F.size(words(line)) <= HEADING_WORDS) & ~F.right(line, F.lit(1)).isin(list(CLOSING))


def lead_and_body(text: Column) -> tuple[Column, Column]:
    """(lines before the first heading; the other lines after it, each below the headings right above it).

    So a block of the body never ends in a bare heading, and headings with nothing below are left out.
    """
    def parts(own: Column) -> Column:
        return _bound(F.transform(own, is_heading), lambda marked: _bound(F.array_position(marked, True), lambda first: split(own, marked, first)))

    def split(own: Column, marked: Column, first: Column) -> Column:
        plain = F.filter(F.transform(marked, lambda h, i: F.when(~h, i + 1)), lambda i: i.isNotNull())
        lead = F.when(first == 0, own).otherwise(F.slice(own, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")))
        return _bound(plain, lambda plain: F.struct(lead.alias("lead"), blocks(own, first, plain).alias("body")))

    def blocks(own: Column, first: Column, plain: Column) -> Column:
        spans = F.transform(plain, lambda i, j: F.struct(F.when(j > 0, F.get(plain, j - 1)).otherwise(0).alias("a"), i.alias("b")))
        below = F.filter(spans, lambda x: (first > 0) & (x["b"] > first))
        return F.transform(below, lambda x: F.array_join(F.slice(own, x["a"] + 1, x["b"] - x["a"]), "\n"))

    both = _bound(lines(text), parts)
    return both["lead"], both["body"]


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(blocks: Column, close: int = WINDOW_WORDS, tail: int = TAIL_WORDS, most: int | None = MOST_WINDOWS) -> Column:
    """Blocks packed greedily into windows that close at ``close`` words; a short last one joins the one before it.

    The first ``most`` windows are kept, all of them for None.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, b: Column) -> Column:
        text = F.when(s["open"] == "", b).otherwise(F.concat(s["open"], F.lit("\n\n"), b))
        n = s["n"] + F.size(words(b))
        return F.when(n >= close, F.struct(F.concat(s["done"], F.array(text)).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))).otherwise(F.struct(s["done"].alias("done"), text.alias("open"), n.alias("n")))

    def finish(s: Column) -> Column:
        done, last = s["done"], s["open"]
        count = F.size(done)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(count - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), F.lit("\n\n"), last)))
        packed = F.when(last == "", done).when((s["n"] < tail) & (count > 0), joined).otherwise(F.concat(done, F.array(last)))
        return packed if most is None else F.slice(packed, 1, most)

    return F.aggregate(blocks, state, step, finish)


def shaped(documents: DataFrame, lead: int = LEAD_WORDS, body: int = BODY_WORDS, close: int = WINDOW_WORDS, tail: int = TAIL_WORDS, most: int | None = MOST_WINDOWS, summary: int = SUMMARY_WORDS) -> DataFrame:
    """(id, doc_id, kind, title, text): the records of the documents (doc_id, title, text) that make an article.

    Left out are lists (by their title), documents with fewer words before the first heading or after it, and those
    with fewer than two windows. An article gives a summary of its lead and its windows as chunks. Null titles and
    texts count as empty.
    """
    first, rest = lead_and_body(F.col("text"))
    count = lambda blocks: F.aggregate(blocks, F.lit(0), lambda s, x: s + F.size(words(x)))
    own = documents.where(~F.coalesce(F.col("title"), F.lit("")).startswith("List of")).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), first.alias("lead"), rest.alias("body"))
    own = own.where((count(F.col("lead")) >= lead) & (count(F.col("body")) >= body))
    own = own.withColumn("chunks", windows(F.col("body"), close, tail, most)).where("size(chunks) >= 2")
    parts = F.concat(
        F.array(F.struct(F.concat(F.lit("w"), "doc_id").alias("id"), F.lit("summary").alias("kind"), lead_summary(F.array_join("lead", " "), summary).alias("text"))),
        F.transform("chunks", lambda c, i: F.struct(F.concat(F.lit("w"), "doc_id", F.lit("#"), i).alias("id"), F.lit("chunk").alias("kind"), c.alias("text"))),
    )
    return own.select("doc_id", "title", F.explode(parts).alias("r")).select("r.id", "doc_id", "r.kind", "title", "r.text")


def made_queries(records: DataFrame, length: tuple[int, int] = SENTENCE_WORDS, least_chunks: int = LEAST_CHUNKS) -> DataFrame:
    """(kind, doc_id, target, qtext): questions about shaped records, at most two for each document.

    summary: the title, aimed at the summary. indoc: a sentence of a chunk without its headings, aimed at that chunk; of
    documents with enough chunks, the sentence of least digest among those of the right length.
    """
    titles = records.where("kind = 'summary'").select(F.lit("summary").alias("kind"), "doc_id", F.col("id").alias("target"), F.col("title").alias("qtext"))
    enough = records.where("kind = 'chunk'").groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_chunks).select("doc_id")
    paragraph = F.filter(F.split("text", "\n"), lambda x: ~is_heading(x))
    cut = F.flatten(F.transform(paragraph, lambda x: F.split(F.regexp_replace(x, rf"([.!?]){WHITE}+", "$1\n"), "\n")))
    sentence = records.where("kind = 'chunk'").join(enough, "doc_id", "left_semi").select("doc_id", F.col("id").alias("target"), F.explode(cut).alias("qtext"))
    n = F.size(words(F.col("qtext")))
    fit = sentence.where(n.between(*length)).withColumn("_d", F.md5(F.concat_ws("/", "target", "qtext")))
    least = fit.groupBy("doc_id").agg(F.min(F.struct("_d", "target", "qtext")).alias("x"))
    return titles.unionByName(least.select(F.lit("indoc").alias("kind"), "doc_id", F.col("x.target").alias("target"), F.col("x.qtext").alias("qtext")))


def first_by_key(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The first row of each key by ``order``; keys and texts are trimmed, rows without either are left out."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), f"^{WHITE}+|{WHITE}+$", "")
    kept = rows.withColumn(key, trimmed(key)).withColumn(text, trimmed(text)).where((F.col(key) != "") & (F.col(text) != ""))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def batches(counts: DataFrame, by: str, key: str, n: str = "n", least: int = BATCH_ROWS) -> DataFrame:
    """(by, key, batch): whole documents packed in key order into batches of at least ``least`` rows, within each ``by``.

    A batch takes documents until it has enough rows; the next document begins the next one. Where a batch ends depends
    on the one before, so the rows of one ``by`` are streamed in order through one task, which holds a counter only.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, number = object(), 0, 0
        for part in parts:
            out = []
            for group, rows in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if group != now:
                    now, held, number = group, 0, 0
                elif held >= least:
                    held, number = 0, number + 1
                held += rows
                out.append(number)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int64())], names=[by, key, "batch"])

    kinds = {c: counts.schema[c].dataType.simpleString() for c in (by, key)}
    ordered = counts.select(by, key, F.col(n).cast("bigint").alias(n)).repartition(by).sortWithinPartitions(by, key)
    return ordered.mapInArrow(run, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, batch bigint")


def recall(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the mean over queries of the share of the true hits that were found."""
    both = truth.select("qid", "id").join(hits.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share")).agg(F.avg("share").alias("recall"))


def target_rate(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: the share of queries whose target (qid, target) is among the hits."""
    found = targets.join(hits.select("qid", F.col("id").alias("target")).withColumn("hit", F.lit(1)), ["qid", "target"], "left")
    return found.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("rate"))


def exclusive_percentile(rows: DataFrame, value: str, q: int, *by: str) -> DataFrame:
    """The q-th of 99 cut points by the exclusive method: position q (n + 1) / 100, interpolated, kept within the data."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    own = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    lower = F.greatest(F.lit(1), F.least(F.floor((F.col("_n") + 1) * q / 100), F.col("_n") - 1))
    part = ((F.col("_n") + 1) * q - lower * 100) / 100
    own = own.withColumn("_lo", lower).withColumn("_part", part)
    return own.groupBy(*by).agg(
        F.sum(F.when(F.col("_n") == 1, F.col(value)).when(F.col("_i") == F.col("_lo"), F.col(value) * (1 - F.col("_part"))).when(F.col("_i") == F.col("_lo") + 1, F.col(value) * F.col("_part")).otherwise(0.0)).alias("value")
    )


def band(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, median, band): the middle of repeated runs and their spread."""
    return rows.groupBy(*by).agg(F.median(value).alias("median"), (F.max(value) - F.min(value)).alias("band"))
