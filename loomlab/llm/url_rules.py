"""URL filters: written rules for hosts and paths, and rules mined from labels by frequent-pattern growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import fresh, stored

ALLOW, BLOCK = "allow", "block"
#: The item that stands for a bad label among the tokens of a URL; no token looks like it.
BAD = "label:bad"
#: FP-growth lists every set of a URL's tokens; URLs with more tokens than this that matter are mined level by level.
TOKENS_PER_URL = 10
#: Suffixes of a host that are tokens, beside the whole host.
SUFFIXES = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def written_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, host, path) rules that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: the host, its suffixes, its labels and their words between hyphens, path segments, query keys, the scheme."""
    host, path = host_and_path(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    # the last suffixes and the whole host: long chains of subdomains say nothing more
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(SUFFIXES))), lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), "."))
    hosts = F.transform(F.array_append(suffixes, host), lambda x: F.concat(F.lit("host:"), x))
    # a label or word says the same below any domain
    own = F.transform(F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), lambda x: F.concat(F.lit("label:"), x))
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    words = F.transform(F.filter(hyphened, lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.lower(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.lower(F.substring_index(x, "=", 1))))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1))))
    everything = F.array_distinct(F.concat(hosts, own, words, segments, keys, scheme))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(everything)


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_count: int, tokens_per_url: int = TOKENS_PER_URL) -> DataFrame:
    """(items, confidence, support) of token sets that foretell a bad label, from rows (url, bad).

    A rule needs ``min_support`` of the labelled URLs and ``min_count`` of them to be bad, and ``min_confidence`` of the
    URLs it fits. A rule from which one token can be dropped without loss of confidence is left out. So a token that is always
    bad, or on every URL, is only a rule by itself, and of tokens on the same URLs one stands for all until the end.
    FP-growth proposes the sets of the tokens that are left; where a URL has more than ``tokens_per_url`` of them,
    whose sets would double with each further token, :func:`free_sets` does. No token of a URL is left out. Support and
    confidence are counted over all tokens of all labelled URLs. Without labelled URLs there are no rules.
    """
    rows = stored(labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(tokens(F.col("url")).alias("items"), F.col("bad").cast("boolean").alias("bad")), "labelled-urls")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    none = rows.where(F.lit(False)).select("items", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    if not counts["bad"]:
        return none
    least = max(min_count, min_support * counts["n"])
    keyed = stored(rows.select(F.monotonically_increasing_id().alias("row"), "items", "bad"), "labelled-urls")
    # one row per frequent token, with what tells on which URLs it is
    marks = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    known = keyed.select("row", F.explode("items").alias("item"), "bad").groupBy("item").agg(F.count("*").alias("n"), F.count_if("bad").alias("k"), *marks)
    known = stored(known.where(F.col("k") >= least), "frequent-tokens")
    # a token that is always bad, or on every URL, adds nothing to a set
    left = known.where((F.col("k") < F.col("n")) & (F.col("n") < counts["n"]))
    alike = left.groupBy("n", "k", "mark0", "mark1").agg(F.min("item").alias("token"))
    members = stored(left.join(alike, ["n", "k", "mark0", "mark1"]).select("token", "item"), "alike-tokens")
    told = keyed.select("row", "bad", F.explode("items").alias("token")).join(members.select("token").distinct(), "token")
    baskets = stored(told.groupBy("row", "bad").agg(F.sort_array(F.collect_list("token")).alias("items")), "baskets")
    size = baskets.agg(F.count("*").alias("n"), F.max(F.size("items")).alias("most")).first()
    found = known.select(F.array("item").alias("items"))
    if size["n"]:
        if size["most"] <= tokens_per_url:
            marked = F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items"))
            model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / size["n"]) * (1 - 1e-9), minConfidence=min_confidence / 2).fit(stored(baskets.select(marked.alias("items")), "baskets"))
            sets = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.sort_array("antecedent").alias("items"))
        else:
            sets = free_sets(baskets, least, min_confidence)
        sets = stored(sets.where(F.size("items") > 1).withColumn("set", F.monotonically_increasing_id()), "token-sets")
        longest = sets.agg(F.max(F.size("items")).alias("n")).first()["n"] or 0
        spelled = sets.withColumn("spelled", F.array().cast("array<string>"))
        for i in range(longest):  # every token that stands for its like
            name = members.select(F.col("token").alias("_token"), "item")
            spelled = spelled.join(name, F.get("items", F.lit(i)) == F.col("_token"), "left")
            spelled = spelled.withColumn("spelled", F.when(F.col("item").isNotNull(), F.array_append("spelled", F.col("item"))).otherwise(F.col("spelled"))).drop("_token", "item")
        found = found.unionByName(spelled.select(F.sort_array("spelled").alias("items")))
    found = stored(found, "proposed-rules")
    fits = fitting(keyed.select("row", "bad", F.col("items").alias("tokens")), found)
    fits = fits.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("k"))
    found = fits.where((F.col("k") >= least) & (F.col("k") >= min_confidence * F.col("n")))
    found = stored(found.select("items", (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / F.lit(counts["n"])).alias("support")), "rules")
    # a rule is idle if dropping one token gives a rule that is as confident
    shorter = found.where(F.size("items") > 1).select("items", "confidence", F.explode("items").alias("less"))
    shorter = shorter.select("items", "confidence", F.array_remove("items", F.col("less")).alias("rest"))
    fewer = found.select(F.col("items").alias("rest"), F.col("confidence").alias("before"))
    idle = shorter.join(fewer, "rest").where(F.col("before") >= F.col("confidence")).select("items").distinct()
    return stored(found.join(idle, "items", "left_anti"), "rules")


def free_sets(baskets: DataFrame, least: float, min_confidence: float) -> DataFrame:
    """(items) of the token sets that can be rules worth keeping, from rows (row, bad, items); exact, level by level.

    A set that fits as many URLs as the set without one of its tokens is as confident as that, and so is every larger set; beyond
    a set that is always bad there is nothing more confident. Only the other sets grow, so the number of levels is
    bounded by how often the URLs they fit can become fewer. All work is joins and counts.
    """
    tail = F.get("items", F.size("items") - 1)
    there = stored(baskets.select("row", "bad", F.explode("items").alias("item")).select("row", "bad", F.array("item").alias("items")), "sets-on-urls")
    before = there.groupBy("items").agg(F.count("*").alias("n"))
    out = None
    while True:
        one = there.select("row", "bad", F.slice("items", 1, F.size("items") - 1).alias("head"), tail.alias("last"))
        two = one.select("row", "head", F.col("last").alias("next"))
        grown = one.join(two, ["row", "head"]).where(F.col("last") < F.col("next"))
        grown = stored(grown.select("row", "bad", F.concat("head", F.array("last", "next")).alias("items")), "sets-on-urls")
        sets = grown.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("k")).where(F.col("k") >= least)
        parts = sets.select("items", "n", F.explode("items").alias("less")).select("items", "n", F.array_remove("items", F.col("less")).alias("rest"))
        parts = parts.join(before.select(F.col("items").alias("rest"), F.col("n").alias("more")), "rest").where(F.col("more") > F.col("n"))
        free = parts.groupBy("items").agg(F.count("*").alias("parts")).where(F.col("parts") == F.size("items"))
        sets = stored(sets.join(free.select("items"), "items"), "free-sets")
        kept = sets.where(F.col("k") >= min_confidence * F.col("n")).select("items")
        out = kept if out is None else out.unionByName(kept)
        before = sets.where(F.col("k") < F.col("n")).select("items", "n")
        if before.isEmpty():
            return out
        there = stored(grown.join(before.select("items"), "items", "left_semi"), "sets-on-urls")


def fitting(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (tokens, and more) with each rule of ``rules`` (items, and more) that fits them.

    The inverted index has each rule under its rarest token only; rows look up their tokens and then compare whole
    token sets.
    """
    every = rules.select("items", F.explode("items").alias("token"))
    seen = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = every.join(seen, "token").groupBy("items").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = stored(index.join(rules, "items"), "rule-index")
    pairs = rows.withColumn("token", F.explode("tokens")).join(index, "token")
    return pairs.where(F.size(F.array_except("items", "tokens")) == 0).drop("token")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct ``urls`` that fit a mined rule, by the best of their rules."""
    fits = fitting(urls.select("url", tokens(F.col("url")).alias("tokens")), rules.select("items", "confidence"))
    return fits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url: str = "url",
    min_support: float = 0.002, min_confidence: float = 0.75, min_count: int = 5,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the mined confidence of each row.

    ``labelled`` has rows (url, bad). The longest written rule decides, else a fitting mined rule blocks, else the page
    is allowed. A null URL, or one without ``://``, has an empty host and path, no tokens, and is allowed. Repeated
    URLs are judged once and every row gets the verdict; an empty table gives no rows. Columns of ``pages`` keep their
    names; the five new ones get a trailing ``_`` where a name is taken.
    """
    host, path, rule, verdict, confidence, key, said = fresh(pages.columns, "host", "path", "rule", "verdict", "confidence", "url_key", "said")
    mined = mine_rules(labelled, min_support, min_confidence, min_count)
    links = F.col(f"`{url}`")
    urls = pages.where(links.isNotNull()).select(links.alias("url")).distinct()
    hits = matched(urls, mined).select(F.col("url").alias(key), F.col("confidence").alias(confidence))
    out = pages.join(hits, links == F.col(key), "left")
    h, p = host_and_path(links)
    r, v = written_rule(F.col(host), F.col(path), rules)
    out = out.withColumn(host, h).withColumn(path, p).withColumn(rule, r).withColumn(said, v)
    mined_verdict = F.when(F.col(confidence).isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    out = out.withColumn(verdict, F.coalesce(F.col(said), mined_verdict))
    names = [F.col(f"`{c}`") for c in (*pages.columns, host, path, rule, verdict, confidence)]
    return out.select(*names)
