"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base counts come from each whole text: words `[^\\x20\\x09-\\x0D]+`, symbols, repeated
lines, and words in five-word windows that occur twice or more. Then the method: lines
are normalised (lower case, no white space) and hashed; a line found in more
documents of its host than the limit is boilerplate there and is removed; a document
that loses more than `depleted_percent` of its words is rejected. The limit is the
greater of `min_docs` and `host_permille` of the host's documents, so it behaves alike at
every size.

`cleaned` gives each row's text less its removed lines and their places; the query's
columns are taken from it.

Plan: texts are not shuffled, unless the cleaned ones are asked for. Lines travel as (host hash, line hash, document)
integers; counting distinct documents deduplicates by (line, document) first, so a line
that a third of all documents share is spread over all tasks and summed from partial
counts; the join back is an ordinary equi-join, which adaptive execution broadcasts
if small and splits if skewed.

Defined cases: a null text has no word; a null host is a host of its own; a null
doc_id counts for no line; rows that repeat a doc_id count as one document in line
frequencies and are judged each by its own text and host; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.session import ship

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class RulesConfig:
    min_docs: int = 10
    host_permille: int = 5
    depleted_percent: int = 60


def _bare(c: Column) -> Column:
    return F.translate(c, WHITE, "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _host() -> Column:
    return F.when(F.col("source").isNull(), F.lit(0)).otherwise(F.xxhash64("source")).cast("bigint")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs (doc_id, text, ...)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _bare(x) != "")
    d = docs.withColumn("_hashes", F.transform(_words(text), lambda w: F.xxhash64(w))).withColumn("_lines", lines)
    n = F.size("_hashes")
    at = lambda i, k: F.get("_hashes", i + k)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_windows", windows)
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(placed)))
    near = lambda k: F.get("_sorted", k)["h"]
    twice = F.filter("_sorted", lambda x, k: x["h"].eqNullSafe(near(k - 1)) | x["h"].eqNullSafe(near(k + 1)))
    d = d.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i.cast("bigint"), s["end"])).cast("bigint").alias("n"), (i + WINDOW).cast("bigint").alias("end")),
        lambda s: s["n"],
    )
    d = d.select(
        *docs.columns,
        n.cast("bigint").alias("n_words"),
        F.length(_bare(text)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, host, pos, line, line_words of every line with a word; host and line are hashes."""
    exploded = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), _host().alias("host"), F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    bare = F.lower(_bare(F.col("content")))
    return exploded.where(bare != "").select("doc_id", "text_hash", "host", "pos", F.xxhash64(bare).alias("line"), F.size(_words(F.col("content"))).alias("line_words"))


def frequent_lines(lines: DataFrame, docs: DataFrame, cfg: RulesConfig) -> DataFrame:
    """(host, line) found in more documents of the host than its limit."""
    hosts = docs.where("doc_id is not null").select(_host().alias("host"), "doc_id").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = lines.where("doc_id is not null").select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    over = counts.where(F.col("n_docs") > cfg.min_docs).join(hosts, "host")
    return over.where(F.col("n_docs") * 1000 > F.col("host_docs") * cfg.host_permille).select("host", "line")


def removed_lines(docs: DataFrame, cfg: RulesConfig = RulesConfig()) -> DataFrame:
    """doc_id, text_hash, host, removed: (pos, words) of the removed lines, by place, for every document with such a line; pos counts the text's lines from 0."""
    lines = line_rows(docs)
    hit = lines.join(frequent_lines(lines, docs, cfg), ["host", "line"])
    once = hit.select("doc_id", "text_hash", "host", F.struct("pos", F.col("line_words").alias("words")).alias("at")).distinct()  # rows may repeat
    return once.groupBy("doc_id", "text_hash", "host").agg(F.sort_array(F.collect_list("at")).alias("removed"))


def cleaned(docs: DataFrame, cfg: RulesConfig = RulesConfig()) -> DataFrame:
    """Every row of docs (doc_id, text, source) with the base counts, base_failed, removed (see removed_lines; empty if none), removed_words, kept and clean_text, the text less its removed lines.

    Unless clean_text or text is read, no text is shuffled."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    base = base_counts(docs.withColumn("text_hash", F.xxhash64("text")).withColumn("host", _host()))
    r = removed_lines(docs, cfg).withColumnsRenamed({"doc_id": "r_doc", "text_hash": "r_hash", "host": "r_host"})
    same = F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_hash") == F.col("r_hash")) & (F.col("host") == F.col("r_host"))
    d = base.join(r, same, "left").drop("r_doc", "r_hash", "r_host", "text_hash", "host")
    d = d.withColumn("removed", F.coalesce("removed", F.array().cast(r.schema["removed"].dataType)))
    d = d.withColumn("removed_words", F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["words"]))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") * 100 <= F.col("n_words") * cfg.depleted_percent))
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform("removed", lambda x: x["pos"]))
    left = F.array_join(F.transform(stay, lambda k: F.get(F.col("_lines"), k)), "\n")
    return d.withColumn("_lines", lines).withColumn("clean_text", F.when(F.size("removed") == 0, F.col("text")).otherwise(left)).drop("_lines")


def quality_rules(docs: DataFrame, cfg: RulesConfig = RulesConfig()) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_words and kept for every row of docs (doc_id, text, source)."""
    return cleaned(docs, cfg).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
l0 AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
l AS (SELECT *, lower(regexp_replace(content, '[\x20\x09-\x0D]+', '', 'g')) AS line, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS lw FROM l0 WHERE regexp_replace(content, '[\x20\x09-\x0D]+', '', 'g') <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT content) AS n FROM l GROUP BY r),
hosts AS (SELECT source, count(DISTINCT doc_id) AS hd FROM documents GROUP BY source),
freq AS (SELECT f.source, f.line FROM (SELECT source, line, count(DISTINCT doc_id) AS nd FROM l GROUP BY source, line) f
         JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.nd > 10 AND f.nd * 1000 > h.hd * 5),
rem AS (SELECT l.r, sum(l.lw) AS n FROM l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY l.r),
b AS (SELECT d.r, d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN rem USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, removed_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * removed_words <= 60 * n_words AS kept
FROM b
"""
