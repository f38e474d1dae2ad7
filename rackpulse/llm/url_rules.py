"""URL filters: listed rules first, then association rules mined from labelled pages."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import stored


class Rule(NamedTuple):
    """A listed rule for a host with its subdomains, and the start of a path."""

    verdict: str
    host: str
    path: str


# Fixed rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# Mined rules: share of the labelled pages that hold all of a rule's tokens and the
# label, share of its pages that have the label, and most tokens of a rule.
LEAST_SUPPORT, LEAST_CONFIDENCE, MOST_TOKENS = 0.002, 0.6, 3
# However few pages are labelled, a rule rests on so many bad ones, and the share of bad
# ones among its pages lies so many standard errors above the share among all.
LEAST_PAGES, ERRORS = 20, 3.0
BLOCKED = "label=block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest listed rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.host) + len(rule.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host, path parts with digits folded, query keys."""
    parts = F.transform(
        F.split(F.lower(path), r"[/._-]+"), lambda part: F.concat(F.lit("p="), F.regexp_replace(part, r"\d+", "0"))
    )
    words = F.transform(F.split(host, r"[.-]"), lambda part: F.concat(F.lit("h="), part))
    keys = F.transform(
        F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)),
        lambda key: F.concat(F.lit("q="), key),
    )
    return F.filter(F.array_distinct(F.concat(words, parts, keys)), lambda token: F.length(token) > 2)


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path`` and ``tokens`` of every page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    split = rows.select("page_id", F.col("_url").alias("url"), host.alias("host"), path.alias("path"))
    return split.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))


def _beyond_chance(hits: Column, uses: Column, base: float, errors: float) -> Column:
    """Whether the lower Wilson bound of ``hits / uses`` lies above ``base``."""
    share, square = hits / uses, errors * errors
    margin = errors * F.sqrt(share * (1 - share) / uses + square / (4 * uses * uses))
    return (share + square / (2 * uses) - margin) / (1 + square / uses) > base


def _uses(held: DataFrame, sets: DataFrame, items: DataFrame) -> DataFrame:
    """How many rows of ``held`` hold each token set, through an index by the set's rarest token."""
    index = (
        sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
        .groupBy("tokens").agg(F.min_by("token", F.struct("uses", "token")).alias("anchor"))
    )
    asked = held.select("items", F.explode("items").alias("anchor")).join(index, "anchor")
    return asked.where(F.size(F.array_except("tokens", "items")) == 0).groupBy("tokens").agg(F.count("*").alias("uses"))


def mine(rows: DataFrame, labels: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE,
         most: int = MOST_TOKENS, pages: int = LEAST_PAGES, errors: float = ERRORS) -> DataFrame:
    """``tokens``, ``support`` and ``confidence`` of the rules that point to a bad page.

    A page is bad if any label of its id says low quality or toxic. Only tokens on enough
    bad pages can be in a rule; of tokens that stand on exactly the same pages the first
    speaks for all, so a long URL that is often repeated is one token. FP-growth finds the
    frequent token sets of the bad pages, and the pages that hold each set are counted
    over all labelled ones. A rule needs ``support``, ``pages`` bad pages, ``confidence``,
    and more bad pages than chance explains; of such rules those stay that no rule with
    fewer of the same tokens matches in confidence.
    """
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    baskets = stored(
        rows.join(bad, "page_id").select(
            F.monotonically_increasing_id().alias("basket"), "bad", "tokens",
        ), "baskets",
    )
    total, total_bad = baskets.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(pages, math.ceil(support * total))
    if total_bad < least:
        return rows.sparkSession.createDataFrame([], "tokens array<string>, support double, confidence double")
    uses = baskets.select("basket", "bad", F.explode("tokens").alias("token"))
    alike = F.sum(F.xxhash64("basket").cast("decimal(38,0)")).alias("alike")
    items = stored(
        uses.groupBy("token").agg(F.count("*").alias("uses"), F.sum("bad").alias("hits"), alike).where(F.col("hits") >= least)
        .groupBy("uses", "alike").agg(F.min("token").alias("token")).select("token", "uses"), "items",
    )
    held = stored(
        uses.join(items.select("token"), "token").groupBy("basket", "bad").agg(F.collect_list("token").alias("items")), "held"
    )
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total_bad).fit(held.where("bad = 1"))
    sets = stored(
        model.freqItemsets.where(F.size("items") <= most).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits")),
        "sets",
    )
    share = F.col("hits") / F.col("uses")
    rules = stored(
        sets.join(_uses(held, sets, items), "tokens")
        .where((share >= confidence) & _beyond_chance(F.col("hits"), F.col("uses"), total_bad / total, errors))
        .select("tokens", (F.col("hits") / total).alias("support"), share.alias("confidence")), "rules",
    )
    # A rule is dropped if leaving out tokens loses nothing; its sub-rules are looked up by key.
    one_less = rules.select(
        "tokens", "confidence",
        F.explode(F.transform("tokens", lambda token: F.array_except("tokens", F.array(token)))).alias("shorter"),
    )
    known = rules.select(F.col("tokens").alias("shorter"), F.col("confidence").alias("reached"))
    needless = one_less.join(known, "shorter").where("reached >= confidence").select("tokens").distinct()
    return rules.join(needless, "tokens", "left_anti")


def mined_matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(``page_id``, ``url``) of the rows that hold all tokens of some rule.

    The rules are indexed by the token that the fewest pages hold, so a page meets the
    rules of its tokens only and a token that many pages share anchors few rules.
    """
    held = rows.select("page_id", "url", "tokens", F.explode("tokens").alias("anchor"))
    spread = rules.select("tokens", F.explode("tokens").alias("token"))
    uses = held.groupBy(F.col("anchor").alias("token")).agg(F.count("*").alias("uses")).join(
        spread.select("token").distinct(), "token"
    )
    index = (
        spread.join(uses, "token").groupBy("tokens")
        .agg(F.min(F.struct("uses", "token"))["token"].alias("anchor"), F.count("*").alias("present"))
        .where(F.col("present") == F.size("tokens")).select(F.col("tokens").alias("needed"), "anchor")
    )
    return (
        held.join(index, "anchor").where(F.size(F.array_except("needed", "tokens")) == 0)
        .select("page_id", "url").distinct()
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` per row of ``pages``.

    A listed rule decides; where none fits, a mined rule blocks, and all else is
    allowed. A null URL has empty host and path and is allowed; null ids are kept but
    have no label; equal rows are judged alike; further columns are not read; without
    labels nothing is mined; an empty table gives no rows.
    """
    rows = parsed(pages)
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    judged = rows.withColumns({"rule": name, "listed": verdict})
    free = judged.where("rule is null and url is not null")
    hits = mined_matches(free, mine(rows, labels, **options)).withColumn("hit", F.lit(True))
    joined = judged.alias("r").join(
        hits.alias("m"),
        F.col("r.page_id").eqNullSafe(F.col("m.page_id")) & (F.col("r.url") == F.col("m.url")), "left",
    )
    return joined.select(
        "r.page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("hit", F.lit(False)).alias("mined"),
    )
