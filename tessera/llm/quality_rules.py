"""Quality rules on documents and, from their failures, on hosts; DataFrame functions only.

A document fails the base rules outright. The soft rules (symbols per word, repeated lines, mean word length) only count
against a document where its host is bad: the share of its documents that fail any rule, shrunk towards an empirical beta prior
(method of moments over all hosts), reaches `host_limit`. Good documents of a bad host stay.

Rows: a null text has no words; a null host is a host of its own; equal or null doc_ids are rows of their own; a single
host, or hosts of equal rates, gives a prior so strong that all get the mean rate; an empty table gives no rows. Only the prior's three numbers reach the driver.
Host rates are broadcast up to `most_hosts` hosts; beyond, documents and rates are joined by host and salt, so a hot host's documents are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: White space of the word form, as Java's and RE2's classes write it.
SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
HOST_LIMIT = 0.5
#: Hosts whose rates are broadcast at most, and shares that a host's documents are dealt into beyond.
MOST_HOSTS, SALTS = 500_000, 32


def let(value: Column, use) -> Column:
    """use(value) with value computed once, as a lambda's variable; a lambda's body would compute an outer expression for each element."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def repeated_words(words: Column) -> Column:
    """Words within windows of three that occur twice or more in the text."""
    size = F.size(words)
    triples = F.arrays_zip(words.alias("a"), F.slice(words, 2, size).alias("b"), F.slice(words, 3, size).alias("c"))
    hashes = F.transform(F.slice(triples, 1, F.greatest(size - 2, F.lit(0))), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))

    def covered(order: Column) -> Column:
        n = F.size(order)
        twice = F.filter(order, lambda s, i: (F.get(order, i - 1)["h"] == s["h"]) | ((i + 1 < n) & (F.get(order, i + 1)["h"] == s["h"])))
        places = F.array_sort(F.transform(twice, lambda s: s["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda x, p: F.struct(p.alias("last"), (x["sum"] + F.least(F.lit(3), p - x["last"])).alias("sum"))
        return F.aggregate(places, start, step, lambda x: x["sum"])

    def counted(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(order, covered))

    return F.when(size < 3, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def measured(text: Column) -> Column:
    """A struct of the rules' counts."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        )

    return let(words_of(text), counts)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def soft_failed(m: Column) -> Column:
    """More than a symbol in ten words, over 30 % repeated lines, or a mean word length outside 2 to 15."""
    return (10 * m["n_symbols"] > m["n_words"]) | (100 * m["n_dup_lines"] > 30 * m["n_lines"]) | (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])


def judged(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT, columns: list[str] | None = None, most_hosts: int = MOST_HOSTS) -> DataFrame:
    """The given columns (all, if none are given) as struct `row`, the counts as struct `m`, and base_failed, soft_failed, host_rate, kept."""
    rows = docs.select(F.struct(*(docs[c] for c in columns or docs.columns)).alias("row"), docs[host_col].cast("string").alias("host"), measured(docs[text_col]).alias("m"))
    rows = rows.select("*", base_failed(F.col("m")).alias("base_failed"), soft_failed(F.col("m")).alias("soft_failed"))
    rows = saved(rows, "rules")
    failed = F.col("base_failed") | F.col("soft_failed")
    hosts = saved(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed.cast("int")).alias("bad")), "hosts")
    rate = F.col("bad") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.count("*").alias("n")).first()
    mean, spread = prior["m"] or 0.0, prior["v"] or 0.0
    strength = max(0.0, mean * (1 - mean) / spread - 1) if spread > 1e-12 else 1e12
    hosts = hosts.select(F.col("host").alias("of"), ((F.col("bad") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    if prior["n"] <= most_hosts:
        joined = rows.join(F.broadcast(hosts), rows["host"].eqNullSafe(hosts["of"]))
    else:
        dealt = rows.withColumn("salt", F.monotonically_increasing_id() % SALTS)
        hosts = hosts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = dealt.join(hosts.hint("merge"), dealt["host"].eqNullSafe(hosts["of"]) & (dealt["salt"] == hosts["share"]))
    return joined.select("row", "m", "base_failed", "soft_failed", "host_rate", (~F.col("base_failed") & ~(F.col("soft_failed") & (F.col("host_rate") >= host_limit))).alias("kept"))


def kept(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    return judged(docs, **options).where("kept").select("row.*")
