"""Quality rules of documents, and of hosts by their documents' failures. Built-ins only."""

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import let
from tracerisk.operators.skew import lookup, stage_lookup
from tracerisk.sources import materialize

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
# Evidence of a prior where the hosts differ no more than chance does.
POOLED = 1e6

# Rules whose failures are counted per host: the base rules one by one, and symbols in place of words.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
}
# A host fails a rule if its shrunk rate lies this many deviations of the prior above the prior's mean,
# but at FLOOR at least and at CEILING at most.
DEVIATIONS, FLOOR, CEILING = 3.0, 0.3, 0.8

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes within one text. Only a text with a
    repeated window sorts its windows, to find the places and how far they reach.
    """

    def hashes(w):
        last = F.size(w) - WINDOW
        window = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(window)

    def places(s):
        same = F.filter(
            s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h)
        )
        return F.sort_array(F.transform(same, lambda x: x.i))

    def reach(p):
        step = F.transform(
            p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def count(h):
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(F.sort_array(pairs), lambda s: let(places(s), reach))
        )

    return let(hashes(words), count)


def document_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of whole texts.

    A null text counts as empty: all are 0. Columns with these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    symbols = F.length(F.regexp_replace(body, "[^#*$%&|<>]+", ""))
    found = let(
        words_of(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    repeated = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    kept = [c for c in docs.columns if c not in METRICS]
    counted = docs.select(
        *kept,
        found.alias("_w"),
        symbols.cast("long").alias("n_symbols"),
        repeated.cast("long").alias("n_dup_lines"),
    )
    return counted.select(
        *kept,
        "_w.n_words",
        "_w.word_chars",
        "n_symbols",
        "n_dup_lines",
        "_w.n_repeat_words",
    )


def base_failed() -> Column:
    """Too few words, or over a fifth of them repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_rule_rates(judged: DataFrame, host: str, rules: Sequence[str]) -> DataFrame:
    """Per host: n_docs and, per rule, n_failed_, rate_ (shrunk towards all hosts' rate) and limit_ of the rule.

    The columns `rules` tell whether a document fails. A beta prior is fitted to the hosts' rates of each
    rule by moments: its mean is their mean rate, its strength comes from their variance
    less what sampling alone gives. The limit lies DEVIATIONS of the prior above its mean, within FLOOR and CEILING.
    Counts of all rules combine in one pass before the shuffle; the priors are one row.
    Rows without a host are left out.
    """
    failures = [F.count_if(F.col(r)).alias(f"n_failed_{r}") for r in rules]
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), *failures)
    hosts = materialize(hosts)
    moments = []
    for r in rules:
        rate = F.col(f"n_failed_{r}") / F.col("n_docs")
        noise = F.avg(rate) * (1 - F.avg(rate)) * F.avg(1 / F.col("n_docs"))
        moments += [
            F.coalesce(F.avg(rate), F.lit(0.0)).alias(f"mean_{r}"),
            F.coalesce(F.var_samp(rate) - noise, F.lit(0.0)).alias(f"spread_{r}"),
        ]
    prior = hosts.agg(*moments).first()
    for r in rules:
        mean, spread = prior[f"mean_{r}"], prior[f"spread_{r}"]
        strength = min(POOLED, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else POOLED
        above = mean + DEVIATIONS * sqrt(mean * (1 - mean) / (strength + 1))
        shrunk = (F.col(f"n_failed_{r}") + mean * strength) / (F.col("n_docs") + strength)
        hosts = hosts.withColumns({f"rate_{r}": shrunk, f"limit_{r}": F.lit(min(CEILING, max(FLOOR, above)))})
    return hosts


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host: n_docs, n_failed and `rate`, shrunk as in `host_rule_rates`, of one rule."""
    rates = host_rule_rates(judged, host, [failed])
    return rates.select(
        host, "n_docs", F.col(f"n_failed_{failed}").alias("n_failed"), F.col(f"rate_{failed}").alias("rate")
    )


def quality_rules(
    docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, host, the five metrics, base_failed, host_failed and kept for every document.

    A document is kept unless it fails a base rule, or its host fails a rule of RULES (host_failed names
    the first): the host's shrunk rate of documents that fail it is out of line with the other hosts (`host_rule_rates`).
    The metrics are written once to the shared folder,
    since both the host counts and the verdicts need them. Host verdicts are
    broadcast up to a checked size; beyond it large hosts are joined apart.

    One row per row that goes in. A null or empty text has no words and fails; a
    document without a host is judged by its own rules alone (host_failed null).
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text")
    )
    judged = document_metrics(narrow, "_text").drop("_text")
    judged = materialize(judged.withColumn("base_failed", base_failed()))
    failing = judged.select("host", *[F.expr(rule).alias(r) for r, rule in RULES.items()])
    rates = host_rule_rates(failing, "host", list(RULES))
    first = F.coalesce(*[F.when(F.col(f"rate_{r}") > F.col(f"limit_{r}"), r) for r in RULES])
    dim, small = stage_lookup(rates.select("host", "n_docs", first.alias("host_failed")))
    found = lookup(judged, dim, ["host"], rows="n_docs", small=small)
    return found.select(
        *judged.columns,
        "host_failed",
        (~F.col("base_failed") & F.col("host_failed").isNull()).alias("kept"),
    )
