"""URL filters: longest fitting rule, else naive Bayes over segmented host words and path tokens.

Words of a host are often run together, so every run of letters in a host is
split by a unigram model.  Its word counts come from the text of all pages (tags
removed, entities decoded), from the words of paths, from the seed words, and
from runs that hyphens set off within a host's label, once per host.  Other runs
of hosts are what is to be split, so they are no evidence for words: words of a
page's text or path that are a run of its own host are not counted.  The distinct
substrings of all runs are looked up in the counts by one join; the Viterbi path
over the words found gives the split, and stretches that are no word cost a
factor of ten per letter.  A label of a host has at most 63 letters, so longer
words are never looked up; a run of more than 253 letters, which no host name
can hold, stays one word.

The classifier is a multinomial naive Bayes over host words, hyphens of the host
and path tokens (digits read as #).  It learns from all hosts; a host is one
example with its distinct tokens, however many pages it has, of class block if
one of its words is one of ``SEEDS``, else of class allow.  The seed that alone
made a host an example is not among the example's features, so what is learned
are the other tokens that go with seeds; they count against hosts that have no
seed.  The seeds themselves speak for block beforehand (``SEED_ODDS``).  A host is no evidence for itself: its own example is taken out
of the token counts and the prior by which its pages are judged, and a token that
no other host has says nothing.  Counts are a table, one row per token, joined
with the distinct token lists; joins back to pages are salted.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged by the prior alone; ties between rules go to the longer rule text
and then to the first; repeated rows are judged alike; an empty table gives no
rows; very long urls and texts are read whole (a page's text is held by one task,
some ten times its size).  Only page_id, url and html are read, other columns
cannot clash.
"""

from __future__ import annotations

import html
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm._store import salted_join, stored, tidy

SEEDS = ("ads", "bets", "casino", "pills", "poker", "porn", "viagra", "xxx")
LONGEST_WORD = 63    # letters of a host label
LONGEST_RUN = 253    # letters of a host name
SEED_SHARE = 0.001   # of all words, on top of what the pages hold
SEED_ODDS = 1000     # prior knowledge: a seed in a host speaks so many to one for block, on top of what is learned
SMOOTHING = 0.1      # added to each count of a token


def _rest():
    """The url after ``://``, empty if there is none."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.coalesce(rest, F.lit(""))


def _host():
    return F.translate(F.regexp_extract(_rest(), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    return pages.select("page_id", "url", _host().alias("host"),
                        F.regexp_extract(_rest(), "^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_of(rules: list[tuple[str, str]]):
    """(rule, verdict) columns over host and path; a rule is (verdict, 'host/path')."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):       # later ones override: longest last
        rule_host, _, tail = rule.partition("/")
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith("/" + tail)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


#: A word as pages write it: letters and entities (the limit keeps the matcher's stack small).
_RAW_WORD = r"((?:\p{L}++|&#?[A-Za-z0-9]++;){1,64})"


def _decoded(counts: DataFrame) -> DataFrame:
    """(word, n) of counts of raw words, in which entities may still stand."""
    def run(batches):
        for batch in batches:
            has_entity = pc.match_substring(batch.column(0), "&")
            plain = batch.filter(pc.invert(has_entity))
            yield pa.RecordBatch.from_arrays(plain.columns, ["word", "n"])
            raw = batch.filter(has_entity)
            words, n = [], []
            for word, k in zip(raw.column(0).to_pylist(), raw.column(1).to_pylist()):
                found = re.findall(r"[^\W\d_]+", html.unescape(word))
                words += found
                n += [k] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return (counts.mapInArrow(run, "word string, n long")
            .groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")))


def word_counts(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, n): lower-case words of the text of ``pages`` (url, html), of ``paths`` (host, path) and of hyphenated hosts.

    A run of the row's own host is not counted in its text and path: a host would
    confirm itself, once per page.
    """
    text = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), "(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")

    def counted_words(rows, host, words, pattern):
        own = F.regexp_extract_all(host, F.lit("([a-z]+)"), F.lit(1))
        found = rows.select(own.alias("own"), F.explode(F.regexp_extract_all(words, F.lit(pattern), F.lit(1))).alias("word"))
        return found.where(~F.array_contains("own", F.lower("word"))).groupBy("word").agg(F.count("*").alias("n"))

    labels = paths.select("host").distinct().select(F.explode(F.split(F.regexp_replace("host", r"\.?[^.]*$", ""), r"\."))
                                                    .alias("label"), "host").where("label like '%-%'")
    set_off = (labels.select("host", F.explode(F.regexp_extract_all("label", F.lit("([a-z]+)"), F.lit(1))).alias("word"))
               .distinct().groupBy("word").agg(F.count("*").alias("n")))
    words = counted_words(pages, _host(), text, _RAW_WORD)
    parts = counted_words(paths, F.col("host"), F.lower("path"), "([a-z]+)")
    size = F.char_length("word")
    return (_decoded(words).union(parts).union(set_off).where((size >= 2) & (size <= LONGEST_WORD))
            .groupBy("word").agg(F.sum("n").alias("n")))


def with_seeds(counts: DataFrame) -> tuple[DataFrame, float]:
    """``counts`` plus the share ``SEED_SHARE`` of their total for each seed word, at any size; and the new total."""
    total = float(max(1, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    each = SEED_SHARE * total
    seeds = counts.sparkSession.createDataFrame([(s, each) for s in SEEDS], "word string, n double").coalesce(1)
    both = counts.select("word", F.col("n").cast("double")).union(seeds).groupBy("word").agg(F.sum("n").alias("n"))
    return both, total + len(SEEDS) * each


def viterbi(run: str, found: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Best split of a run of letters; ``found`` gives the log-probability of (start, length)."""
    by_end: dict[int, list] = {}
    for (start, size), score in found.items():
        by_end.setdefault(start + size, []).append((start, score))
    best = [0.0] + [-np.inf] * len(run)
    back = [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(end):                                  # an unknown stretch
            score = best[start] + unknown - (end - start) * np.log(10)
            if score > best[end]:
                best[end], back[end] = score, start
        for start, score in by_end.get(end, ()):
            if best[start] + score >= best[end]:
                best[end], back[end] = best[start] + score, start
    out, end = [], len(run)
    while end:
        out.append(run[back[end]: end])
        end = back[end]
    return out[::-1]


def segmented(runs: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """(run, words): the Viterbi split of each distinct run."""
    subs = runs.where(F.char_length("run") <= LONGEST_RUN).select("run", F.explode(F.expr(
        f"flatten(transform(sequence(1, char_length(run)), s -> transform(sequence(1, "
        f"least({LONGEST_WORD}, char_length(run) - s + 1)), n -> named_struct('start', s - 1, 'size', n, "
        "'word', substring(run, s, n)))))")).alias("s")).select("run", "s.*")
    found = subs.select("word").distinct().join(counts, "word")       # only words that occur go back to the runs
    known = (salted_join(subs, found, "word", ["run", "start"], "inner").groupBy("run")
             .agg(F.collect_list(F.struct("start", "size", "n")).alias("found")))
    unknown = float(np.log(10 / max(total, 1)))

    def split(batches):
        for batch in batches:
            words = []
            for run, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(run) > LONGEST_RUN:
                    words.append([run])
                    continue
                table = {(f["start"], f["size"]): float(np.log(f["n"] / total)) for f in found or ()}
                words.append(viterbi(run, table, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return runs.join(known, "run", "left").select("run", "found").mapInArrow(split, "run string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """(host, words): segmented words of each distinct host, the last label (the top domain) left out."""
    labels = F.regexp_replace("host", r"\.?[^.]*$", "")
    at = hosts.select("host", F.posexplode(F.regexp_extract_all(labels, F.lit("([a-z]+)"), F.lit(1))).alias("at", "run"))
    at = at.where("run != ''")
    splits = segmented(at.select("run").distinct(), counts, total)
    return (salted_join(at, splits, "run", ["host"], "inner").groupBy("host")
            .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"]))
                 .alias("words")))


def tokens(words, host, path):
    """Tokens of a page: host words, hyphens of the host, path words, marked by where they stand."""
    in_path = F.regexp_extract_all(F.regexp_replace(F.lower(path), "[0-9]+", "#"), F.lit(r"([\p{L}#]+)"), F.lit(1))
    return F.concat(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
                    F.transform(F.regexp_extract_all(host, F.lit("(-)"), F.lit(1)), lambda w: F.concat(F.lit("h:"), w)),
                    F.transform(in_path, lambda w: F.concat(F.lit("p:"), w)))


def _label(tokens: str):
    """The token of the only seed among the tokens, which makes its host an example; empty if there is none or more."""
    seeds = F.array_intersect(tokens, F.array(*[F.lit("h:" + s) for s in SEEDS]))
    return F.when(F.size(seeds) == 1, F.element_at(seeds, 1)).otherwise(F.lit(""))


def bayes(pages: DataFrame) -> tuple[DataFrame, dict[bool, float]]:
    """((token, of_all, as_block, as_allow), prior log ratio of either) from rows (host, tokens, seeds found).

    The three are the log of a token's block to allow probability: from all hosts,
    and for pages whose host is an example of a class, the host itself left out.
    """
    is_block = F.size("seeds") > 0
    found = pages.select("host", is_block.alias("block"),
                         F.explode(F.filter("tokens", lambda t: t != _label("tokens"))).alias("token"))
    counts = stored(found.distinct().groupBy("token").agg(F.count_if("block").alias("block"),
                                                          F.count_if(~F.col("block")).alias("allow")), "url-token-counts")
    n = pages.select("host", is_block.alias("block")).distinct().agg(
        F.count_if("block").alias("block"), F.count_if(~F.col("block")).alias("allow")).first()
    zero = F.lit(0)
    total = counts.agg(F.coalesce(F.sum("block"), zero).alias("block"), F.coalesce(F.sum("allow"), zero).alias("allow")).first()
    smooth = SMOOTHING * counts.count()
    shift = float(np.log(total["allow"] + smooth) - np.log(total["block"] + smooth)) if smooth else 0.0
    seeds = pages.sparkSession.createDataFrame([("h:" + s, 0, 0, float(np.log(SEED_ODDS))) for s in SEEDS],
                                               "token string, block long, allow long, before double").coalesce(1)
    counts = (counts.withColumn("before", F.lit(0.0)).union(seeds).groupBy("token")
              .agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.sum("before").alias("before")))

    def ratio(block, allow):
        log = F.log(block + SMOOTHING) - F.log(allow + SMOOTHING) + shift
        return F.col("before") + F.when(block + allow > 0, log).otherwise(0.0)

    block, allow = F.col("block"), F.col("allow")
    ratios = counts.select("token", ratio(block, allow).alias("of_all"), ratio(F.greatest(block - 1, zero), allow).alias("as_block"),
                           ratio(block, F.greatest(allow - 1, zero)).alias("as_allow"))
    return ratios, {True: float(np.log(max(1, n["block"])) - np.log(n["allow"] + 1)),
                    False: float(np.log(n["block"] + 1) - np.log(max(1, n["allow"])))}


def token_sums(lists: DataFrame, ratios: DataFrame) -> DataFrame:
    """(tokens, as_block, as_allow): sums of the tokens' ratios, added in their order, of each distinct list."""
    at = lists.select("tokens").distinct().select("tokens", F.posexplode("tokens").alias("at", "token"))
    joined = salted_join(at, ratios, "token", ["tokens", "at"], "inner").withColumn(
        "as_block", F.when(F.col("token") == _label("tokens"), F.col("of_all")).otherwise(F.col("as_block")))
    found = joined.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("at", "as_block", "as_allow"))).alias("found"))
    return found.select("tokens", *[F.aggregate(F.col("found")[c], F.lit(0.0), lambda s, x: s + x).alias(c)
                                    for c in ("as_block", "as_allow")])


@tidy
def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (log odds of block), words."""
    urls = stored(parsed(pages), "urls")
    hosts = urls.select("host").distinct()
    counts = stored(word_counts(pages.select("url", "html"), urls.select("host", "path").distinct()), "word-counts")
    counts, total = with_seeds(counts)
    words = stored(host_words(hosts, counts, total), "host-words")
    named = salted_join(urls, words, "host", ["page_id"]).withColumns({
        "tokens": tokens(F.col("words"), F.col("host"), F.col("path")),
        "seeds": F.coalesce(F.array_intersect("words", F.array(*[F.lit(s) for s in SEEDS])),
                            F.array().cast("array<string>"))})
    named = stored(named.select("page_id", "host", "path", "words", "tokens", "seeds"), "url-tokens")
    ratios, prior = bayes(named)
    sums = stored(token_sums(named, ratios), "url-scores")
    scored = salted_join(named, sums, "tokens", ["page_id"]).withColumn(
        "score", F.when(F.size("seeds") > 0, prior[True] + F.coalesce("as_block", F.lit(0.0)))
        .otherwise(prior[False] + F.coalesce("as_allow", F.lit(0.0))))
    rule, verdict = rule_of(rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
                         "score", "words")
