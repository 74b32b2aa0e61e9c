"""URL filter: explicit host and path rules, then association rules mined from labels.

The tokens of a labelled URL and its label make a basket. Spark's FP-growth
finds the frequent sets of baskets; a set with the bad label and the same set
without it give a rule and its confidence. A set of n tokens has 2^n subsets,
so where baskets are longer than ``TOKENS`` sets are grown by a token at a time
instead, without those that no rule can need: the rules are the same. Rules stay whose support is high
enough and whose confidence is above the share of bad baskets even at its lower
bound, without those that a shorter and no weaker rule implies. Rules match by
an inverted index: each stands under its rarest token, so a URL looks only at
the rules of its own tokens. Rules are a table from the mining to the match;
nothing of them passes through the driver.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared

#: (verdict, host, path) of the explicit rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Share of baskets, and number of bad pages, that a rule rests on at least.
SUPPORT = 0.005
LEAST = 5
#: A rule's confidence is so many times the share of bad baskets at least, and stays above that share if its pages are a sample of so many standard errors.
LIFT = 1.2
ERRORS = 2.326
#: Tokens of a basket that FP-growth takes; where one has more, sets are grown from all of its tokens by :func:`grown`.
TOKENS = 12
BAD = "=block"
#: Keys that pages with the same tokens are dealt over.
SALT = 16


def _lower(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(at: Column, where: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null.

    Rules stand under their hosts; a URL looks up its host's suffixes.
    """
    index: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for verdict, h, p in rules:
        index[h].append((p, verdict))
    if not index:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    found = []
    for h, entries in index.items():
        below = (at == h) | F.endswith(at, F.lit("." + h))
        for p, verdict in entries:
            found.append(F.when(below & F.startswith(where, F.lit(p)), F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, labels of the host and its suffixes, path parts with digits as #, names of query parts, and whether it has a fragment."""
    parts = F.split(host(url), r"\.")
    labels = F.transform(parts, lambda x: F.concat(F.lit("h:"), x))
    scheme = F.array(F.concat(F.lit("s:"), _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    folders = F.transform(F.filter(F.split(F.regexp_replace(path(url), r"[0-9]+", "#"), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.element_at(F.split(x, "="), 1)))
    fragment = F.when(F.contains(url, F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.coalesce(F.concat(scheme, labels, folders, names, fragment), F.array().cast("array<string>")))


def baskets(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(tokens, bad)`` of each page with a url and a label.

    A page is bad if it is labelled toxic or of low quality. Pages without a
    url, an id or a label take no part; repeated labels of an id count as bad
    if one of them is.
    """
    kind = labels.select(F.col("doc_id").alias("label_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")).where("label_id is not null and bad is not null").groupBy("label_id").agg(F.max("bad").alias("bad"))
    urls = pages.where("url is not null").select(F.col("page_id").alias("label_id"), tokens(F.col("url")).alias("tokens")).where("size(tokens) > 0")
    return urls.join(kind, "label_id").select("tokens", "bad")


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, lift: float = LIFT, errors: float = ERRORS) -> DataFrame:
    """Pruned rules, ``(rule, items, confidence, anchor)``, from the labels of pages by id; ``anchor`` is the rarest of ``items``."""
    known = shared.table(baskets(pages, labels).withColumn("row", F.monotonically_increasing_id()), "baskets")
    n, bad = known.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    none = known.select(F.lit("").alias("rule"), F.col("tokens").alias("items"), F.lit(0.0).alias("confidence"), F.lit("").alias("anchor")).where(F.lit(False))
    if not bad or bad == n:
        return none
    need = max(support * n, LEAST)
    tallies = [F.count(F.lit(1)).alias("times"), F.count_if("bad").alias("hits"), *(F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"cover{k}") for k in (0, 1))]
    often = shared.table(known.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(*tallies), "tokens")
    # a rule's tokens are in enough bad baskets each; one of every basket tells nothing
    usable = often.where((F.col("hits") >= need) & (F.col("times") < n))
    each = known.select("row", "bad", F.explode("tokens").alias("token")).join(usable.select("token"), "token")
    longest = each.groupBy("row").count().agg(F.max("count")).first()[0] or 0
    found = (_frequent if longest <= TOKENS else grown)(each, usable, need, n)
    share, c = bad / n, F.col("hits") / F.col("times")
    # the score interval of a share, which also serves for few pages
    z2 = errors * errors
    bound = (c + z2 / (2 * F.col("times")) - errors * F.sqrt(c * (1 - c) / F.col("times") + z2 / (4 * F.col("times") * F.col("times")))) / (1 + z2 / F.col("times"))
    rules = found.where((c >= lift * share) & (bound > share)).select("rule", "items", c.alias("confidence"))
    kept = prune(shared.table(_anchored(rules, often), "rules"))
    if longest > TOKENS:
        kept = _anchored(_spelled(kept, usable), often)
    return shared.table(kept, "pruned")


def _key(items: Column) -> Column:
    """A set as a string of its sorted tokens."""
    return F.array_join(items, "\n")


def _anchored(rules: DataFrame, often: DataFrame) -> DataFrame:
    least = rules.select("rule", F.explode("items").alias("token")).join(often, "token").groupBy("rule").agg(F.min_by("token", F.struct("times", "token")).alias("anchor"))
    return rules.join(least, "rule")


def _frequent(each: DataFrame, usable: DataFrame, need: float, n: int) -> DataFrame:
    """``(rule, items, times, hits)`` of the sets in at least ``need`` bad baskets, by FP-growth; ``each`` has a row for each token of a basket."""
    mined = each.groupBy("row", "bad").agg(F.collect_list("token").alias("items")).select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    found = shared.table(FPGrowth(itemsCol="items", minSupport=min(need / n, 1.0), minConfidence=1.0).fit(mined).freqItemsets, "sets")
    # a set meets itself without the label
    items = F.array_sort(F.array_remove("items", BAD))
    marked = found.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(_key(items).alias("rule"), items.alias("items"), F.col("freq").alias("hits"))
    plain = found.where(~F.array_contains("items", BAD)).select(_key(items).alias("rule"), F.col("freq").alias("times"))
    return marked.join(plain, "rule").where(F.col("hits") >= need)


def grown(each: DataFrame, usable: DataFrame, need: float, n: int) -> DataFrame:
    """As :func:`_frequent`, without sets that a smaller one of the same or greater confidence implies for certain.

    Tokens of the same baskets count as one, the least (told by a 128-bit hash
    of their baskets). A set in as many baskets as one of its subsets is in the
    same ones, so neither it nor a set that holds it is needed; nor is a set
    that holds one of bad baskets only. Sets of k + 1 tokens come from two of k
    that differ in the last, within each distinct basket.
    """
    heads = usable.groupBy("times", "hits", "cover0", "cover1").agg(F.min("token").alias("token"))
    whole = each.join(heads.select("token"), "token").groupBy("row", "bad").agg(F.array_sort(F.collect_list("token")).alias("basket"))
    whole = shared.table(whole.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")), "distinct")
    level = heads.select(F.array("token").alias("items"), "times", "hits")
    found, size = level, 1
    # a set that is in bad baskets only is not grown
    level = shared.table(level.where("hits < times"), "level")
    held = whole.select("basket", "n", "bad", F.explode("basket").alias("token")).select("basket", "n", "bad", F.array("token").alias("items")).join(level.select("items"), "items", "left_semi")
    held = shared.table(held, "held")
    while not level.isEmpty():
        head, last = F.slice("items", 1, size - 1), F.element_at("items", -1)
        left, right = held.select("basket", "n", "bad", head.alias("head"), last.alias("x")), held.select("basket", head.alias("head"), last.alias("y"))
        pairs = left.join(right, ["basket", "head"]).where("x < y").select("basket", "n", "bad", F.concat("head", F.array("x", "y")).alias("items"))
        sets = shared.table(pairs.groupBy("items").agg(F.sum("n").alias("times"), F.sum("bad").alias("hits")).where(F.col("hits") >= need), "counted")
        parts = sets.select("items", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
        below = parts.join(level.select(F.col("items").alias("part"), F.col("times").alias("wider")), "part").groupBy("items").agg(F.count(F.lit(1)).alias("parts"), F.min("wider").alias("wider"))
        size += 1
        sets = shared.table(sets.join(below, "items").where((F.col("parts") == size) & (F.col("wider") > F.col("times"))).select("items", "times", "hits"), "level")
        found, level = found.unionByName(sets), sets.where("hits < times")
        held = shared.replace(held, pairs.join(level.select("items"), "items", "left_semi").select(*held.columns), "held")
    return found.select(_key(F.col("items")).alias("rule"), "items", "times", "hits")


def _spelled(rules: DataFrame, usable: DataFrame) -> DataFrame:
    """Rules of tokens that stand for others, with each of those in their place."""
    same = usable.groupBy("times", "hits", "cover0", "cover1").agg(F.min("token").alias("token"), F.collect_list("token").alias("same"))
    each = rules.select("rule", "confidence", F.explode("items").alias("token")).join(same.select("token", "same"), "token")
    each = each.groupBy("rule", "confidence").agg(F.collect_list("same").alias("choices"))
    one = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda acc, x: F.flatten(F.transform(acc, lambda a: F.transform(x, lambda t: F.array_append(a, t)))))
    items = each.select("confidence", F.explode(one).alias("items")).select("confidence", F.array_sort("items").alias("items"))
    return items.select(_key(F.col("items")).alias("rule"), "items", "confidence")


def prune(rules: DataFrame) -> DataFrame:
    """Rules that no rule with fewer of the same tokens and as much confidence implies."""
    other = rules.select(F.col("rule").alias("shorter"), F.col("items").alias("part"), F.col("confidence").alias("as_much"), "anchor")
    implied = rules.select("rule", "items", "confidence", F.explode("items").alias("anchor")).join(other, "anchor")
    implied = implied.where((F.size("part") < F.size("items")) & (F.col("as_much") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
    return rules.join(implied.select("rule").distinct(), "rule", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``tokens`` of ``urls`` that hold all items of a rule."""
    each = urls.select("tokens").distinct().select("tokens", F.explode("tokens").alias("anchor"))
    return each.join(rules.select("items", "anchor"), "anchor").where(F.size(F.array_except("items", "tokens")) == 0).select("tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, mined: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined)`` for each row of ``pages``.

    The longest explicit rule that fits decides; else a URL that a mined rule
    matches is blocked and every other is allowed, null and empty ones too.
    ``mined`` tells whether a mined rule matches. Repeated rows give a row each;
    other columns are not read.
    """
    if mined is None:
        mined = mine(pages, labels)
    out = pages.select("page_id", F.col("url"), tokens(F.col("url")).alias("tokens"))
    # rows of one URL are dealt over many keys
    hit = matched(out, mined).select("tokens", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit(True).alias("mined"))
    out = out.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    out = out.join(hit, ["tokens", "salt"], "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    out = out.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined")
    out = out.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("mined"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "mined")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path in plain Python, for tests."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
