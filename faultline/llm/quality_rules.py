"""Quality rules per document and per host.

The rules of a document are counts over its whole text. Failures are then summed per host (the `source`
column), each host's failure rate is shrunk to a beta prior fitted to all hosts, and a host whose posterior
rate is surely high loses all its documents.

Defined results: null text counts as empty and fails; documents of a null host are judged by their own rules
alone; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import BLANKS, SPACE, WORD, beside, beta_prior, beta_prior_sql, saved, words

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
MAX_HOST_RATE = 0.5  # a host goes if its failure rate is above this ...
BOUND_Z = 3.0  # ... by this many posterior deviations


def _measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep` and the counts of every document, in one narrow pass.

    The 3-word windows are hashed to 64 bits and sorted with their positions; equal neighbours are repeats,
    and a repeat covers three words less those its predecessor covers already.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    first = docs.select(
        *keep,
        words(F.col("text")).alias("_w"),
        F.char_length(F.regexp_replace(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    kept = [c for c in first.columns if c not in ("_w", "_lines")]
    w = F.col("_w")
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    )
    second = first.select(
        *kept,
        F.size(w).cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_s"),
    )
    s = F.col("_s")

    def repeated(x: Column, i: Column) -> Column:
        return (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))

    third = second.select(
        *[c for c in second.columns if c != "_s"],
        F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"])).alias("_at"),
    )
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"].cast("bigint"),
    )
    return third.select(*[c for c in third.columns if c != "_at"], covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def any_rule_failed() -> Column:
    """What counts against a host: the base rules, many symbols, many repeated lines."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE, z: float = BOUND_Z) -> DataFrame:
    """(host, rejected) from (host, n, failed): posterior mean less z deviations above `max_rate`."""
    m, k = beta_prior(counts)
    a = F.col("failed") + m * k
    b = F.col("n") - F.col("failed") + (1 - m) * k
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return counts.select("host", (a / (a + b) - z * deviation > max_rate).alias("rejected"))


def judge_documents(docs: DataFrame, max_rate: float = MAX_HOST_RATE, z: float = BOUND_Z) -> DataFrame:
    """Per document (doc_id, text, source): the counts, base_failed, and kept."""
    measured = saved(_measured(docs, [F.col("doc_id"), F.col("source").alias("host")]), "quality")
    hosts = beside(saved(host_verdicts(saved(_host_counts(measured), "hosts"), max_rate, z), "verdicts"))
    return measured.join(hosts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )


def _host_counts(measured: DataFrame) -> DataFrame:
    known = measured.where(F.col("host").isNotNull())
    return known.groupBy("host").agg(F.count("*").alias("n"), F.sum(any_rule_failed().cast("bigint")).alias("failed"))


def keep_documents(docs: DataFrame, max_rate: float = MAX_HOST_RATE, z: float = BOUND_Z) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns; texts are read twice, not shuffled."""
    measured = saved(_measured(docs, [F.col("source").alias("host")]), "quality")
    rejected = beside(saved(host_verdicts(saved(_host_counts(measured), "hosts"), max_rate, z).where("rejected").select("host"), "rejected"))
    whole = F.struct(*docs.columns).alias("_row")
    judged = _measured(docs, [whole, F.col("source").alias("host")])
    # a filter on a plain column would be pushed below its definition, with the definition copied into every use
    judged = judged.select("_row", "host", F.explode(F.array(base_failed())).alias("_failed"))
    return judged.where(~F.col("_failed")).join(rejected, "host", "left_anti").select("_row.*")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '{WORD}') AS ws FROM d),
p AS (SELECT k, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT k, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM p WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, tri) AS n FROM g WHERE tri IS NOT NULL) WHERE n > 1),
c AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + x AS i FROM r, (SELECT unnest([0, 1, 2]) AS x)) GROUP BY k),
l AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
m AS (
  SELECT d.doc_id, d.source, len(w.ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM d JOIN w USING (k) JOIN l USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n,
    sum(CASE WHEN base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines THEN 1 ELSE 0 END) AS failed
  FROM b WHERE source IS NOT NULL GROUP BY source),
f AS ({beta_prior_sql("h")}),
q AS (SELECT source, failed + m * k AS a, n - failed + (1 - m) * k AS b FROM h, f),
j AS (SELECT source, a / (a + b) - {BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {MAX_HOST_RATE} AS rejected FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN j USING (source)
"""
