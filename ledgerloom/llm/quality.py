"""Quality rules with verdicts on hosts, in DataFrame functions only.

* Rules on a document: fewer than ``min_words`` words, or more than ``max_repeat`` percent of its words in runs of three
  words found twice or more in it.
* Rules on a host (here the source): its rate of failing documents, drawn towards the rate of all hosts by a beta
  prior whose mean and strength come from the hosts themselves (method of moments): the variance of the observed rates, less
  what chance alone gives them at their sizes, is that of the hosts. Hosts that differ no more than by chance get the prior's
  greatest strength, the number of all documents, so they are judged as one. A host whose shrunk rate is above ``max_rate`` takes
  all its documents with it; a small host with a few failures does not.

Null and empty texts have no words and fail. Hosts are compared null-safe: a null host is a host. Repeated rows
count each. An empty table gives no rows. With ``keep_rows`` further columns pass unchanged, whatever their names. Texts are read whole,
in n log n of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns_of, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first included. Windows are put in the order of
    their hashes, so a text costs n log n; texts without a repeated window stop before that."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def places(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(keyed, lambda s: F.filter(F.transform(s, lambda x, k: F.when(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
        return let(F.sort_array(same), lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.coalesce(F.least(F.get(p, k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(h)))


def base_rules(docs: DataFrame, text: Column, min_words: int, max_repeat: int) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns({
        "word_chars": without(t, BLANKS).cast("long"),
        "n_symbols": (F.length(t) - without(t, SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "__words": let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.when(F.size(w) > 3, repeated_words(w)).otherwise(0).cast("long").alias("again"))),
    })
    docs = docs.withColumns({"n_words": F.col("__words.n"), "n_repeat_words": F.col("__words.again")}).drop("__words")
    return docs.withColumn("base_failed", (F.col("n_words") < min_words)
                           | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat))


def host_verdicts(judged: DataFrame, host: str, max_rate: float) -> DataFrame:
    """host, host_rate (shrunk) and host_failed; ``judged`` has ``host`` and base_failed."""
    hosts = judged.groupBy(host).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("bad"))
    prior = hosts.agg((F.sum("bad") / F.sum("n")).alias("mean"), F.var_pop(F.col("bad") / F.col("n")).alias("var"),
                      F.avg(1 / F.col("n")).alias("per_host"), F.sum("n").cast("double").alias("total"))
    # Beta(mean x strength, (1 - mean) x strength); a host of n documents varies by spread / n by chance
    spread = F.col("mean") * (1 - F.col("mean"))
    own = F.col("var") - spread * F.col("per_host")
    strength = F.when(own > 0, F.least(F.greatest(spread / own - 1, F.lit(1.0)), F.col("total"))).otherwise(F.col("total"))
    prior = prior.select("mean", strength.alias("strength"))
    rate = (F.col("bad") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select(F.col(host).alias("__host"), rate.alias("host_rate"), (rate > max_rate).alias("host_failed"))


def judge(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, max_rate: float = 0.5, keep_rows: bool = False,
          id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts, base_failed, host_rate, host_failed and kept of each document; or, with ``keep_rows``, the rows of
    ``docs`` that stay."""
    if keep_rows:  # the row goes in one column, so its names meet none of the judgement's
        d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{host_col}`").alias("host"))
        judged = base_rules(d, F.col("text"), min_words, max_repeat).select(
            "host", F.when(~F.col("base_failed"), F.col("row")).alias("row"), "base_failed")
        host_col = "host"
    else:
        d = columns_of(docs, id_col, text_col, host_col)
        judged = base_rules(d, F.col(f"`{text_col}`"), min_words, max_repeat).drop(text_col)
    judged = stored(judged, "op6-judged")
    hosts = host_verdicts(judged, host_col, max_rate)
    out = judged.join(hosts, judged[host_col].eqNullSafe(hosts["__host"]), "left").drop("__host")
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    return out.where("kept").select("row.*") if keep_rows else out.drop(host_col)


#: DuckDB SQL of ``judge`` with its default parameters.
SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
places AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM again),
repeats AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
  coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dups ON w.doc_id = dups.doc_id LEFT JOIN repeats ON w.doc_id = repeats.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (base_failed))::DOUBLE AS bad FROM j GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) AS var, avg(1 / n) AS per_host, sum(n) AS total FROM h),
q AS (SELECT mean, CASE WHEN var > mean * (1 - mean) * per_host
  THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * per_host) - 1, 1.0), total) ELSE total END AS strength FROM p),
v AS (SELECT source, (bad + mean * strength) / (n + strength) AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, host_rate > 0.5 AS host_failed,
  NOT base_failed AND host_rate <= 0.5 AS kept FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
