"""URL filtering by given rules, and by association rules for the other URLs.

URLs that a given rule decides are the labels: FP-growth mines which combinations
of URL tokens go with which verdict, rules are pruned by support and confidence,
and an inverted index from token to rule finds the rules all of whose tokens a
URL has. URLs are first reduced to the tokens that occur in rules; the few
distinct sets of them are matched, never each URL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegrist.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of the labelled URLs in which a rule's tokens and verdict must be met,
#: and share of the URLs with its tokens that must have its verdict.
MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.8
VERDICT = "verdict="


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host(url: Column) -> Column:
    """Lower-cased (A-Z) host: what follows the first ``://`` up to ``/``, ``?``,
    ``#`` or the end; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def given_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits host or a parent domain and the path's start,
    as a struct of ``rule`` and ``verdict``; null if none fits. Of rules of equal
    length the one with the longer host wins. The rules become one expression."""
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host, r.path))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in order
    ]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, at most one of each kind: top-level domain,
    domain, first label, first, second and last path segment, names of the query
    fields, whether there is a fragment, and the scheme."""
    labels, segments = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    fields = F.array_sort(F.array_distinct(F.regexp_extract_all(
        F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"([^=&]+)(?:=[^&]*)?"), F.lit(1)
    )))
    kinds = {
        "tld=": F.element_at(labels, -1),
        "domain=": F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")),
        "label=": F.when(F.size(labels) > 2, F.element_at(labels, 1)),
        "first=": F.get(segments, F.lit(0)),
        "second=": F.get(segments, F.lit(1)),
        "last=": F.try_element_at(segments, F.lit(-1)),
        "query=": F.when(F.size(fields) > 0, F.array_join(fields, "&")),
        "fragment": F.when(F.contains(url, F.lit("#")), F.lit("")),
        "scheme=": F.regexp_extract(url, r"^([^:/?#]*)://", 1),
    }
    found = [F.when(F.length(host) > 0, F.concat(F.lit(k), v)) for k, v in kinds.items()]
    return F.array_distinct(F.array_compact(F.array(*found)))


def mined_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Association rules ``rule`` (number), ``tokens``, ``verdict``, ``confidence``,
    ``support`` from ``labelled`` (``tokens``, ``verdict``).

    A URL has at most nine tokens and a verdict, so at most 2^10 item sets of it
    count, and at most 2^10 / min_support rules come out whatever the input.
    """
    baskets = cut_lineage(labelled.select(
        F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items")
    ))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    is_verdict = lambda t: t.startswith(VERDICT)
    rules = model.associationRules.filter(
        is_verdict(F.col("consequent")[0]) & ~F.exists("antecedent", is_verdict)
    )
    return cut_lineage(rules.select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], len(VERDICT) + 1, 100).alias("verdict"),
        "confidence", "support",
    ).withColumn("rule", F.xxhash64("tokens", "verdict")))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` (distinct arrays ``tokens``) with the ``verdict`` of the best rule
    whose tokens they all hold: highest confidence, then highest support, then
    most tokens, then verdict and rule. Sets that no rule matches are left out."""
    index = rules.select(
        "rule", F.size("tokens").alias("needed"), "verdict", "confidence", "support",
        F.explode("tokens").alias("token"),
    )
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    full = hits.groupBy("tokens", "rule", "needed", "verdict", "confidence", "support").count()
    best = F.max(F.struct("confidence", "support", "needed", "verdict", "rule"))
    return full.filter("count = needed").groupBy("tokens").agg(best.getField("verdict").alias("verdict"))


def judged(
    pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", **limits: float
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and
    ``verdict``: the rule's, else that of the best mined rule, else ``default``.

    Null URLs and those without ``://`` have empty host and path, fit no rule and
    get ``default``. Repeated rows are judged alike. Columns of ``pages`` with
    the names of the new ones are replaced. Without any URL under a given rule
    there is nothing to learn from, and all others get ``default``.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(
        *[F.col(f"`{c}`") for c in kept],
        host(F.col(url)).alias("host"), path(F.col(url)).alias("path"),
    ).withColumn("__given", given_rule(F.col("host"), F.col("path"), rules))
    urls = parts.withColumn("__tokens", tokens(F.col(url), F.col("host"), F.col("path")))
    mined = mined_rules(
        urls.filter("__given is not null").select(
            F.col("__tokens").alias("tokens"), F.col("__given.verdict").alias("verdict")
        ), **limits,
    )
    # At most one token of each kind in every min_support-th URL: a short list.
    useful = mined.select(F.explode("tokens").alias("t")).distinct().agg(
        F.array_sort(F.collect_set("t"))
    ).first()[0]
    # As a text, so that the join below is on a plain key.
    shared = F.to_json(F.array_intersect("__tokens", F.array(*map(F.lit, useful)).cast("array<string>")))
    urls = urls.withColumn("__set", F.when(F.col("__given").isNull(), shared))
    sets = urls.select("__set").filter("__set is not null").distinct()
    known = matched(sets.select(F.from_json("__set", "array<string>").alias("tokens")), mined).select(
        F.to_json("tokens").alias("__set"), F.col("verdict").alias("__learnt")
    )
    out = urls.join(cut_lineage(known), "__set", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("__given.rule").alias("rule"),
        F.coalesce("__given.verdict", "__learnt", F.lit(default)).alias("verdict"),
    )
