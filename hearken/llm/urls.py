"""Allow or block urls: by rules, else by the words of host and path.

Host names run words together, so each label of a host is split by a unigram model: the
split of greatest probability, found by Viterbi's method. The model's words and counts are
those of the pages' own visible text. Only substrings of labels are looked up, by a join, so
the vocabulary is neither cut nor gathered anywhere.

A multinomial naive Bayes model then scores the words of the host and the tokens of the
path. It learns from the urls that a rule decides and judges the others. Tokens fall into
``BUCKETS`` buckets by hash, so the model has a fixed size.

Labels and hosts are handled once each, not once a page; pages meet their host's words by
a join that cuts hosts of many pages into slices.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import in_arrow, lower_ascii, query, stored, table
from hearken.operators.skew import sliced_join

ALLOW, BLOCK = "allow", "block"
#: Host, path, verdict. A rule holds for the host and its subdomains, where the path
#: begins with the rule's.
RULES = [
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
]
#: Longest word of a split, in characters.
WORD_CHARS = 20
BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Rows of one host in one slice of the join.
HOST_ROWS = 100_000

_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;"
_DOTTED = r"[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"


# -- urls ---------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(
        lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit("")
    )


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``rule, verdict`` of the longest rule that fits, or null. Equally long ones go in order."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    # the first of the list wins, so the longest is wrapped around the others last
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        own = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, own).otherwise(chosen)
    return chosen


def path_tokens(path: Column) -> Column:
    """Lower-cased runs of letters, and ``0`` for each run of digits."""
    runs = F.regexp_extract_all(lower_ascii(path), F.lit(r"([\p{L}\p{M}]+|\p{N}+)"), F.lit(1))
    return F.transform(runs, lambda t: F.regexp_replace(t, r"\A\p{N}+\z", "0"))


# -- words --------------------------------------------------------------------------------


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n``: lower-cased words of up to ``WORD_CHARS`` letters in the pages' visible text.

    Dotted names are left out; pages name hosts there, which are what is to be split.
    """
    seen = F.regexp_replace(F.coalesce("html", F.lit("")), _HIDDEN, " ")
    seen = F.regexp_replace(seen, _DOTTED, " ")
    runs = F.regexp_extract_all(F.lower(seen), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))
    return (
        pages.select(F.explode(runs).alias("word"))
        .where(F.length("word") <= WORD_CHARS)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def best_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of ``label``; of equal splits the one whose last word is longest.

    A word that was seen n times has probability n / ``total``. A word of k characters
    that was not has 1 / (``total`` * 10**k), so unknown text stays together.
    """
    n = len(label)
    score, cut = [0.0] + [-math.inf] * n, [0] * (n + 1)
    base = math.log(max(total, 1))
    for end in range(1, n + 1):
        for start in range(max(0, end - WORD_CHARS), end):
            word = label[start:end]
            seen = counts.get(word)
            p = math.log(seen) - base if seen else -base - math.log(10) * (end - start)
            if score[start] + p > score[end] + 1e-12:
                score[end], cut[end] = score[start] + p, start
    out, end = [], n
    while end:
        out.append(label[cut[end] : end])
        end = cut[end]
    return out[::-1]


def split_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """``label, words`` of distinct ``labels``, by the counts ``word, n`` of ``words``.

    Parts of a label that are not letters stand as words of their own and are not split;
    digits become ``0``.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    starts = F.sequence(F.lit(1), F.length("label"))
    sizes = F.sequence(F.lit(1), F.lit(WORD_CHARS))
    parts = (
        labels.where(F.length("label") > 0)
        .select("label", F.explode(starts).alias("at"))
        .select("label", F.explode(F.transform(sizes, lambda k: F.substr("label", "at", k))).alias("word"))
        .distinct()
    )
    # single letters stand in nearly all labels
    known = (
        sliced_join(parts, words, ["word"], ["label"], rows_per_slice=HOST_ROWS)
        .groupBy("label")
        .agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                counts = dict(zip(row["known"] or (), row["n"] or ()))
                own = []
                for run in re.findall(r"[^\W\d_]+|\d+|[^\w]|_", row["label"]):
                    own += best_split(run, counts, total) if run.isalpha() else ["0" if run.isdigit() else run]
                out.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(out, pa.list_(pa.string()))], names=["label", "words"]
            )

    return in_arrow(labels.join(known, "label", "left"), split, "label string, words array<string>")


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host, words`` of distinct ``hosts``: their labels' words in order."""
    each = hosts.select("host", F.posexplode(F.split("host", r"\.")).alias("at", "label"))
    splits = stored(split_labels(each.select("label").distinct(), words), "labels")
    # labels such as com stand in a large part of all hosts
    joined = sliced_join(each, splits, ["label"], ["host"], rows_per_slice=HOST_ROWS)
    return (
        joined.groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
        .select("host", F.flatten("parts.words").alias("words"))
    )


# -- naive Bayes --------------------------------------------------------------------------


def token_buckets(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


class BlockModel:
    """Log odds of block against allow, for a url and each token bucket."""

    def __init__(self, urls: dict[str, int], tokens: dict[str, np.ndarray]) -> None:
        held = [v for v in (ALLOW, BLOCK) if urls.get(v)]
        #: The verdict on everything, if not both classes were seen.
        self.only = held[0] if len(held) == 1 else None if held else ALLOW
        self.odds, self.prior = np.zeros(BUCKETS), 0.0
        if self.only is None:
            used = ((tokens[ALLOW] + tokens[BLOCK]) > 0).sum()
            log = {
                v: np.log(tokens[v] + SMOOTHING) - math.log(tokens[v].sum() + SMOOTHING * used)
                for v in (ALLOW, BLOCK)
            }
            self.odds = log[BLOCK] - log[ALLOW]
            self.odds[(tokens[ALLOW] + tokens[BLOCK]) == 0] = 0.0
            self.prior = math.log(urls[BLOCK]) - math.log(urls[ALLOW])

    def verdicts(self, offsets: np.ndarray, buckets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Of urls whose buckets are ``buckets[offsets[i]:offsets[i+1]]``, with the log odds."""
        sums = np.concatenate(([0.0], np.cumsum(self.odds[buckets])))
        score = self.prior + sums[offsets[1:]] - sums[offsets[:-1]]
        if self.only:
            return [self.only] * len(score), score
        return [BLOCK if s > 0 else ALLOW for s in np.round(score, 9)], score


def fit_verdicts(decided: DataFrame) -> BlockModel:
    """Learn from ``verdict, buckets``; two numbers a bucket reach the driver."""
    urls = {r["verdict"]: r["n"] for r in decided.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    tokens = {v: np.zeros(BUCKETS, np.int64) for v in (ALLOW, BLOCK)}
    counted = decided.select("verdict", F.explode("buckets").alias("b")).groupBy("verdict", "b")
    for row in counted.agg(F.count("*").alias("n")).collect():
        tokens[row["verdict"]][row["b"]] = row["n"]
    return BlockModel(urls, tokens)


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES
) -> DataFrame:
    """``page_id, host, path, rule, verdict, tokens, score`` of every row of ``pages``.

    ``verdict`` is the rule's, else the model's: block if ``score``, the log odds, is above
    0. ``score`` is null where a rule decides. If the rules decide nothing all is allowed,
    if they decide one way all else follows. Null urls and such without ``://`` have empty
    host and path and no tokens; null html has no words. Repeated rows are judged each, null
    ids stay null, other columns are ignored, an empty table gives an empty result.
    """
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    urls = stored(
        pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .withColumn("rule", rule),
        "urls",
    )
    words = stored(word_counts(pages), "words")
    hosts = stored(host_words(urls.select("host").distinct(), words), "hosts")
    tokens = F.concat(
        F.transform(F.filter("words", lambda w: w != "."), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(path_tokens(F.col("path")), lambda w: F.concat(F.lit("p:"), w)),
    )
    joined = sliced_join(urls, hosts, ["host"], ["page_id", "path"], rows_per_slice=HOST_ROWS)
    rows = stored(
        joined.select("page_id", "host", "path", "rule", tokens.alias("tokens")).withColumn(
            "buckets", token_buckets(F.col("tokens"))
        ),
        "tokens",
    )
    decided = rows.where("rule IS NOT NULL").select("rule.verdict", "buckets")
    model = pages.sparkSession.sparkContext.broadcast(fit_verdicts(decided))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            verdicts, score = model.value.verdicts(offsets, lists.flatten().to_numpy())
            ruled = batch.column("verdict").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "host", "path", "rule")),
                    pa.array([r or v for r, v in zip(ruled, verdicts)], pa.string()),
                    batch.column("tokens"),
                    pa.array([None if r else float(s) for r, s in zip(ruled, score)], pa.float64()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "tokens", "score"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    flat = rows.select(
        "page_id", "host", "path", F.col("rule.rule").alias("rule"),
        F.col("rule.verdict").alias("verdict"), "tokens", "buckets",
    )
    return in_arrow(
        flat,
        judge,
        f"page_id {kind}, host string, path string, rule string, verdict string, "
        "tokens array<string>, score double",
    )


@query()
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every row of ``pages``."""
    return judge_urls(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )
