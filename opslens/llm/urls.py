"""Verdicts on URLs: host rules first, then naive Bayes over the words of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import LOWER, UPPER, looked_up, query, stored, table

#: Rules as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Words that make a host an example of what is unwanted. The classifier learns from them what other words such URLs have.
SEEDS = ["adult", "ads", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "xxx"]
#: A seed counts as a known word even if no text has it: as one word in so many.
SEED_SHARE = 10_000
#: Letters of a word, and the longest run of letters that is split: a label of a host has 63 characters at most.
WORD, RUN = (2, 20), 63
#: Counts of tokens are kept by hash; what is added to each count.
BUCKETS, SMOOTHING = 1 << 18, 0.1
#: Kinds of tokens, each a multinomial of its own.
KINDS = ("host", "path")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    u = F.coalesce(url, F.lit(""))
    form = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, form, 1), UPPER, LOWER), F.regexp_extract(u, form, 2)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null if none fits. Of rules of one length the one with the longer
    host wins, of two verdicts on the same `block`."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1], r[2], r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """word, n: how often each run of 2 to 20 letters occurs, lower-cased, where words stand apart: in visible texts (not in scripts, styles, comments and
    tags), behind the host in URLs, and in host names with hyphens. A name without hyphens is what is to be split, and no witness."""
    visible = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")
    hyphened = F.array_join(F.filter(F.split(parsed(F.col(url))[0], "\\."), lambda x: x.contains("-")), " ")
    behind = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)://[^/?#]*(.*)", 1)
    words = pages.select(F.explode(F.split(F.lower(F.concat_ws(" ", visible, hyphened, behind)), "[^\\p{L}]+")).alias("word"))
    return words.where(F.char_length("word").between(*WORD)).groupBy("word").agg(F.count("*").alias("n"))


def with_seeds(counts: DataFrame, seeds: list[str]) -> DataFrame:
    """The counts, and each seed with one word in SEED_SHARE at least."""
    if not seeds:
        return counts
    n = (counts.agg(F.sum("n")).first()[0] or 0) // SEED_SHARE
    added = counts.sparkSession.createDataFrame([(s, max(n, 1)) for s in seeds], "word string, n bigint")
    return counts.unionByName(added).groupBy("word").agg(F.max("n").alias("n"))


def best_split(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most likely words that make up `run`, by their shares of `total`; ties to fewer words, then to longer first ones.

    `known` has the count of each known word by (start, length). A stretch that is no known word may stand as one, ten times less likely for each
    further letter.
    """
    n = len(run)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (n + 1)  # from the end: score, words, length of the first
    for i in range(n - 1, -1, -1):
        options = []
        for length in range(1, n - i + 1):
            count = known.get((i, length))
            score = log(count / total) if count else log(1 / max(total, 1)) - (length - 1) * log(10)
            after = best[i + length]
            options.append((round(score + after[0], 9), -(after[1] + 1), length))
        score, words, length = max(options)
        best[i] = score, -words, length
    out, i = [], 0
    while i < n:
        out.append(run[i : i + best[i][2]])
        i += best[i][2]
    return out


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: each distinct host as its words, in order.

    Runs of letters between other characters are split by Viterbi over unigram counts; other characters give no words. All distinct runs are cut
    into stretches of 2 to 20 letters, which meet the counts in a join, so no dictionary is held anywhere; what a run needs comes to
    at most some 1,200 counts. Runs over 63 letters, which no valid host has, stay whole.
    """
    runs = hosts.select("host", F.posexplode(F.split("host", "[^\\p{L}]+")).alias("place", "run")).where("run != ''")
    short = runs.select("run").distinct().where(F.char_length("run") <= RUN)
    least, most = WORD
    cuts = F.expr(
        f"flatten(transform(sequence(1, length(run)), i -> transform(filter(sequence({least}, {most}), n -> i + n - 1 <= length(run)), "
        "n -> struct(i - 1 AS start, n AS length, substring(run, i, n) AS word))))"
    )
    stretches = short.select("run", F.explode(cuts).alias("cut")).select("run", "cut.start", "cut.length", "cut.word")
    known = looked_up(stretches, counts, "word", F.xxhash64("run")).where("n IS NOT NULL").select("run", F.struct("start", "length", "n").alias("known"))
    total = counts.agg(F.sum("n")).first()[0] or 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_split(r, {(k["start"], k["length"]): k["n"] for k in ks}, total) for r, ks in zip(*(batch.column(c).to_pylist() for c in ("run", "known")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(found, pa.list_(pa.string()))], names=["run", "split"])

    # every run once with nothing known, so that those of unknown letters only stay
    alone = short.select("run", F.lit(None).cast(known.schema["known"].dataType).alias("known"))
    splits = known.unionByName(alone).groupBy("run").agg(F.collect_list("known").alias("known")).mapInArrow(split, "run string, split array<string>")
    of_host = looked_up(runs, splits, "run", F.xxhash64("host", "place")).withColumn("split", F.coalesce("split", F.array("run")))
    return of_host.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "split"))), lambda x: x["split"])).alias("words"))


def path_tokens(path: Column) -> Column:
    """Runs of letters of a path, lower-cased, with `/` in front, and `/#` for each number."""
    pieces = F.filter(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.concat(F.lit("/"), F.when(x.rlike("^\\p{N}+$"), "#").otherwise(x)))


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def weights(block: np.ndarray, allow: np.ndarray) -> np.ndarray:
    """Log odds of `block` against `allow` by bucket, from the counts of one kind of tokens in both classes. Unseen buckets are like a token seen never."""
    size = max(int(((block + allow) > 0).sum()), 1)
    log_share = [np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * size)) for c in (block, allow)]
    return np.where(block + allow > 0, log_share[0] - log_share[1], 0.0)


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEEDS, key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict, score, words: a verdict on every row's URL.

    The longest rule that fits the host (it or a subdomain) and the start of the path decides. Without one, multinomial naive Bayes does, over the words of the
    segmented host and the tokens of the path: `score` is the log odds of `block`, above 0 blocks. It learns from all URLs of the table: hosts whose words hold
    a seed are examples of `block`, others of `allow`; each distinct host counts once, each path with its page. Counts by hash of the
    token are at most 2 ** 18 per class and kind, whatever the input; all other statistics stay in tables.

    A URL that is null or has no `://` has an empty host and path, no words, and the verdict of no evidence, as has any URL without words. Null and repeated ids are
    kept as they are. Without examples of either class nothing is blocked by score but by rules only. An empty table gives an empty table.
    Other columns are not read, whatever their names. A null `html` is no text.
    """
    spark = pages.sparkSession
    host, path = parsed(F.col(url))
    read = stored(pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    counts = stored(with_seeds(stored(word_counts(pages, url, html), "url-counts"), seeds), "url-words")
    has_seed = F.exists("words", lambda w: w.isin(seeds)) if seeds else F.lit(False)
    hosts = stored(segmented(read.select("host").distinct(), counts).withColumn("label", F.when(has_seed, "block").otherwise("allow")), "url-hosts")
    known = stored(looked_up(read, hosts, "host", F.xxhash64("page_id", "path")).withColumn("tokens", path_tokens(F.col("path"))), "urls-split")
    tokens = hosts.select("label", F.lit("host").alias("kind"), F.explode("words").alias("token")).unionByName(
        known.where("label IS NOT NULL").select("label", F.lit("path").alias("kind"), F.explode("tokens").alias("token"))
    )
    counted = {(label, kind): np.zeros(BUCKETS) for label in ("block", "allow") for kind in KINDS}
    # two classes and two kinds of at most BUCKETS counts each
    for r in tokens.groupBy("label", "kind", F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int").alias("at")).agg(F.count("*").alias("n")).collect():
        counted[r["label"], r["kind"]][r["at"]] = r["n"]
    examples = {r["label"]: r["n"] for r in hosts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = log((examples.get("block", 0) + SMOOTHING) / (examples.get("allow", 0) + SMOOTHING)) if len(examples) == 2 else -1.0
    of_kind = [weights(counted["block", k], counted["allow", k]) if len(examples) == 2 else np.zeros(BUCKETS) for k in KINDS]
    shared = spark.sparkContext.broadcast([w.astype(np.float32) for w in of_kind])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_host, of_path = shared.value
        for batch in batches:
            pairs = zip(batch.column("words").to_pylist(), batch.column("tokens").to_pylist(), strict=True)
            found = [prior + float(sum(of_host[bucket(t)] for t in words)) + float(sum(of_path[bucket(t)] for t in tokens)) for words, tokens in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "words")), pa.array(found, pa.float64())], names=["page_id", "host", "path", "words", "score"])

    asked = known.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    key_type = known.schema["page_id"].dataType.simpleString()
    done = asked.mapInArrow(scored, f"page_id {key_type}, host string, path string, words array<string>, score double")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    by_score = F.when(F.col("score") > 0, "block").otherwise("allow")
    return done.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_score).alias("verdict"), "score", "words")


@query("op13_url_filter")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all `pages`."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
