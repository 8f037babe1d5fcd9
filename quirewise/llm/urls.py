"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

All of it is column expressions. The regression is learned from a small labelled table in its dual form: one number per
labelled URL, moved by accelerated gradient steps inside a single expression over the matrix of their similarities. The weights of
the hashed n-grams follow from these numbers; there are ``SLOTS`` of them whatever the input, so the scored table carries
them as a constant and needs no join.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions.expr import let
from quirewise.llm.words import run_hashes

SLOTS = 1 << 16
SIZES = (3, 4, 5)
#: Steps of the learning, and the weight of the penalty on large weights.
STEPS, DECAY = 400, 0.1
#: Chance from which a URL is blocked; over a half, as a wanted page lost costs more than an unwanted one kept.
BLOCK_FROM = 0.65
#: Labelled URLs at most: the matrix of similarities has the square of it.
MOST_LABELLED = 1000

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_UNWANTED = (
    "casino poker slots jackpot bets betting gamble lotto adult xxx porn sex nude escort cams hookup pills viagra "
    "pharma meds cheap replica discount payday loans spam farm linkfarm backlinks ads adserver track tracker clicks "
    "popup banner clickbait tracking free win winner prize giveaway crack warez keygen torrent"
).split()
_WANTED = (
    "news daily herald library archive museum history science physics biology garden kitchen recipes travel city "
    "weather music theatre art gallery journal review books reader school college university research health clinic "
    "hospital forum community parish council sports cycling hiking photo film nature ocean river mountain forest "
    "home family craft design paper letter open data code math teacher student people world local green old new "
    "other there this station nation motion that where then thread either weather rather mention ration thought thorn throne python marathon month tenth thistle author southern "
    "northern answer render tender member bannerman handle candle senator painter printer error terror oration"
).split()


def labelled(spark: SparkSession) -> DataFrame:
    """A small labelled table ``(url, unwanted)`` made of two word lists and the same frames for both."""
    frames = (
        "https://www.{}.example.com/en/{}",
        "http://{}.example.org/de/{}.html",
        "https://blog.{}.example.net/fr/{}/",
        "http://{}.example.com/es/{}",
        "https://m.{}.example.org/en/{}",
    )
    rows, pick = [], random.Random(5)
    for words, unwanted in ((_UNWANTED, 1), (_WANTED, 0)):
        for i, word in enumerate(words):
            near, far = words[(7 * i + 3) % len(words)], words[(11 * i + 5) % len(words)]
            names = [f"{word}-{near}", f"{far}-{word}", word, f"{word}{far}"] if unwanted else [word, f"{word}-{near}"]
            for name in names:
                rows.append(f"('{pick.choice(frames).format(name, pick.randrange(1000))}', {unwanted})")
    return spark.sql("select * from values " + ",".join(rows) + " as labelled(url, unwanted)")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty for null and for a URL without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def slots(host: Column, path: Column) -> Column:
    """Hashed n-grams of both parts, with a mark at either end. Digits are all alike."""

    def grams(part: Column, kind: int) -> Column:
        def of_size(chars: Column, n: int) -> Column:
            return F.transform(run_hashes(chars, n), lambda h: F.pmod(F.xxhash64(h, F.lit(10 * kind + n)), F.lit(SLOTS)).cast("int"))

        plain = F.concat(F.lit("^"), F.regexp_replace(part, "[0-9]", "0"), F.lit("$"))
        return let(F.split(plain, ""), lambda chars: F.concat(*[of_size(chars, n) for n in SIZES]))

    return F.concat(grams(host, 1), grams(path, 2))


def weights(labels: DataFrame) -> list[float]:
    """Weights of the slots and, last, the constant. Null labels and repeated URLs are left out.

    Without rows of both kinds the weights are zero and nothing is blocked.
    """
    host, path = parsed(F.col("url"))
    rows = labels.where("url is not null and unwanted is not null").groupBy("url").agg(F.max("unwanted").alias("y"))
    n, kinds = rows.agg(F.count(F.lit(1)), F.countDistinct("y")).first()
    if kinds < 2:
        return [0.0] * (SLOTS + 1)
    if n > MOST_LABELLED:
        raise ValueError(f"{n} labelled URLs; at most {MOST_LABELLED} are taken")
    rows = rows.select("url", F.col("y").cast("double").alias("y"), slots(host, path).alias("s"))
    parts = rows.select("url", "y", F.size("s").alias("n"), F.explode("s").alias("slot"))
    parts = parts.groupBy("url", "y", "n", "slot").agg((F.count(F.lit(1)) / F.sqrt("n")).alias("x"))
    other = parts.select(F.col("url").alias("other"), "slot", F.col("x").alias("other_x"))
    like = parts.join(other, "slot").groupBy("url", "y", "other").agg(F.sum(F.col("x") * F.col("other_x")).alias("k"))
    urls = parts.select("url", "y").distinct()
    # Every pair of the bounded table; pairs without a common n-gram are alike by the constant alone.
    every = urls.withColumn("one", F.lit(1)).join(urls.select(F.col("url").alias("other"), F.lit(1).alias("one")), "one")
    full = every.join(like.select("url", "other", "k"), ["url", "other"], "left")
    lines = full.groupBy("url", "y").agg(
        F.sort_array(F.collect_list(F.struct("other", (F.coalesce("k", F.lit(0.0)) + 1.0).alias("k")))).alias("line")
    )
    matrix = lines.select("url", "y", F.col("line.k").alias("k")).groupBy().agg(
        F.sort_array(F.collect_list(F.struct("url", "y", "k"))).alias("m"),
        # The curve is nowhere steeper than a quarter of the largest row sum.
        (F.max(F.aggregate("k", F.lit(0.0), lambda s, x: s + x)) / 4 + DECAY).alias("steep"),
    )

    def step(state: Column, turn: Column) -> Column:
        def moved(row: Column, i: Column) -> Column:
            products = F.zip_with(row["k"], state["ahead"], lambda a, b: a * b)
            margin = F.aggregate(products, F.lit(0.0), lambda s, p: s + p)
            own = F.get(state["ahead"], i)
            return own - (1 / (1 + F.exp(-margin)) - row["y"] + DECAY * own) / F.col("steep")

        def onward(alpha: Column) -> Column:
            reach = (turn - 1) / (turn + 2)
            ahead = F.zip_with(alpha, state["alpha"], lambda new, old: new + reach * (new - old))
            return F.struct(alpha.alias("alpha"), ahead.alias("ahead"))

        return let(F.transform(F.col("m"), moved), onward)

    zeros = F.transform(F.col("m"), lambda row: F.lit(0.0))
    start = F.struct(zeros.alias("alpha"), zeros.alias("ahead"))
    learned = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda state: state["alpha"])
    alphas = matrix.select("m.url", learned.alias("alpha")).select(F.inline(F.arrays_zip("url", "alpha")))
    of_slot = parts.join(alphas, "url").groupBy("slot").agg(F.sum(F.col("alpha") * F.col("x")).alias("w"))
    constant = alphas.agg(F.sum("alpha").alias("w")).select(F.lit(SLOTS).alias("slot"), "w")
    out = [0.0] * (SLOTS + 1)
    for slot, w in of_slot.union(constant).collect():
        out[slot] = w
    return out


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        name = F.when(fits, F.lit(at + under)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, unwanted`` for every row of ``pages``; only its id and url are looked at.

    ``unwanted`` is what the regression says, from 0 to 1, and a URL that no rule decides is blocked from ``BLOCK_FROM`` on. A null
    url, or one without ``://``, has an empty host and path. Repeated rows are judged each; an empty table gives none.
    """
    spark = pages.sparkSession
    learned = weights(labelled(spark) if labels is None else labels)
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in learned[:-1])), ",").cast("array<double>")
    host, path = parsed(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))

    def margin(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda sum_, slot: sum_ + F.get(table, slot))
        return total / F.sqrt(F.greatest(F.size(s), F.lit(1))) + learned[-1]

    scored = split.withColumn("unwanted", 1 / (1 + F.exp(-let(slots(F.col("host"), F.col("path")), margin))))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("unwanted") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "unwanted")
