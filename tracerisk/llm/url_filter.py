"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import BROADCAST_ROWS, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hex digits of a digest that the equi-join compares (32 bits); the full digest confirms.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or end; empty without `://`."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def expressions(host: Column, path: Column, lengths: Sequence[int], counts: Sequence[int]) -> Column:
    """Host suffixes of the given numbers of labels, each with the path prefixes of the given lengths.

    Only numbers and lengths that some rule has can match, so a host of many labels
    costs no more suffixes than a short one.
    """
    wanted = F.array(*[F.lit(k) for k in counts])
    suffixes = let(
        F.split(host, "\\."),
        lambda labels: F.transform(
            F.filter(wanted, lambda k: k <= F.size(labels)),
            lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
        ),
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                fitting,
                lambda n: F.struct(
                    F.sha2(F.concat(s, F.substr(path, F.lit(1), n)), 256).alias("digest"),
                    # Longest expression first, then the longest host; both fix the expression.
                    (
                        F.shiftleft((F.length(s) + n).cast("long"), 31) + F.length(s).cast("long")
                    ).alias("precedence"),
                ),
            ),
        )
    )


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
    salts: int = 32,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Judge every URL: `keep`, host, path, rule (null if none fits) and verdict.

    `rules` has host, path and verdict (`allow` or `block`). A rule fits its host and
    all subdomains, if the path starts with the rule's; the longest rule wins, of
    equally long ones that with the longer host, and of equal rules `block`.

    Each URL is expanded into its expressions, an equi-join compares the first 32
    bits of their digests with those of the rules, and equal digests confirm. The
    rules are broadcast up to `broadcast_rows` rows; beyond, they are repeated
    `salts` times so that a common expression (`com/`) is spread over as many tasks.
    The matches of a row are combined in the task that expanded it, so the shuffle
    has one narrow row per page, keyed by row and hence even.

    One row comes out per row that goes in, repeated rows included. A null URL, or
    one without `://`, has an empty host and path and gets the default, as does
    every URL when there are no rules. Rules with a null host or path are read as
    empty there; those with another verdict are ignored. Columns of `pages` outside
    `keep` are not carried; a kept column named host, path, rule or verdict gives way.
    """
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    known = (
        rules.filter(F.col("verdict").isin("allow", "block"))
        .select(
            F.coalesce("host", F.lit("")).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy("host", "path")
        .agg(F.max((F.col("verdict") == "block").cast("long")).alias("_block"))
    )
    # At most as many values as the longest path of a rule has characters.
    lengths = sorted(r[0] for r in known.select(F.length("path")).distinct().collect())
    # At most as many as the longest host of a rule has labels.
    counts = sorted(r[0] for r in known.select(F.size(F.split("host", "\\."))).distinct().collect())
    digest = F.sha2(F.concat("host", "path"), 256)
    table = known.select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("_prefix"), digest.alias("_rule"), "_block"
    )

    rows = pages.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(url).alias("_url"))
    rows = rows.withColumns({"_host": url_host(F.col("_url")), "_path": url_path(F.col("_url"))})
    rows = rows.drop("_url").withColumn("_row", F.monotonically_increasing_id())
    if lengths:
        exploded = F.explode_outer(expressions(F.col("_host"), F.col("_path"), lengths, counts))
        wide = rows.withColumn("_e", exploded).select("*", "_e.digest", "_e.precedence").drop("_e")
    else:
        wide = rows.withColumns({"digest": F.lit(""), "precedence": F.lit(0).cast("long")})
    wide = wide.withColumn("_prefix", F.substring("digest", 1, PREFIX_DIGITS))
    on = ["_prefix"]
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = F.broadcast(table)
    else:
        on = ["_prefix", "_salt"]
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        wide = wide.withColumn("_salt", (F.col("_row") % salts).cast("int"))
    confirmed = F.when(
        F.col("digest") == F.col("_rule"), F.col("precedence") * 2 + F.col("_block")
    )
    best = (
        wide.join(table, on, "left")
        .groupBy(*rows.columns)
        .agg(F.max(confirmed).alias("_best"))
    )
    ahead = F.shiftright("_best", 1)
    n_host = ahead.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    n_path = (F.shiftright(ahead, 31) - n_host).cast("int")
    suffix = F.substr("_host", F.length("_host") - n_host + 1)
    rule = F.concat(suffix, F.substr("_path", F.lit(1), n_path))
    verdict = F.when(F.col("_best").isNull(), default).when(F.col("_best") % 2 == 1, "block")
    return best.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best").isNotNull(), rule).alias("rule"),
        verdict.otherwise("allow").alias("verdict"),
    )
