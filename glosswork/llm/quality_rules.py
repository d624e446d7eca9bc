"""Quality rules at the level of hosts, in DataFrame functions only.

Each document is measured by array and string functions inside its own row, without a shuffle. The
rules' failures are counted for each host (the `source` column by default). For each rule a beta prior is
fitted to the hosts' failure rates by moments, and a host's rate is shrunk towards all hosts' by it. The
verdict on a host follows from the lower bound of its posterior rate (two standard deviations under the
mean), held against the rate of all documents:

* over REJECT times that rate: the host is rejected with all its documents;
* over that rate itself: the host is watched, and its documents that fail this rule go.

Hosts that differ by no more than chance are neither. The shuffle carries one partial count for each host
and task. The verdicts, one row for each host, are joined back: only those of rejected or watched
hosts, broadcast if they are counted to be few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import small, written

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A host is rejected when its posterior rate of a rule's failures is surely over this many times the common rate.
REJECT = 4.0
#: Standard deviations of the posterior between its mean and its lower bound.
BOUND = 2.0
RULES = ("short", "repeats", "symbols", "lines")
#: A document fails a host-level rule when ... (percent of words, of word characters, of lines)
SYMBOL_PERCENT = 10
LINE_PERCENT = 30
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _less(text: Column, chars) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the five measures (long) to every row; what the columns of these names held is replaced.

    Defined cases: a null or empty text measures 0 throughout; very long texts take n log n time. Runs of three
    words that repeat are found by 64-bit hashes and compared as words, so chance adds none; it could hide
    one of n words in a text with a probability under n * n / 2^65.
    """
    keep = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a one-row generator keeps the split words as a column: inlined, each window would split again
    df = docs.select(*keep, F.explode(F.array(F.struct(words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.length(_less(x, BLANKS)) > 0).alias("lines")))).alias("__a"))
    df = df.select(*keep, F.col("__a.w").alias("__w"), F.col("__a.lines").alias("__lines"))
    hashed = F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))
    df = df.withColumn("__h", F.explode(F.array(F.slice(hashed, 1, F.greatest(F.size("__w") - 2, F.lit(0))))))
    df = df.withColumn("__some", F.size(F.array_distinct("__h")) < F.size("__h"))
    keyed = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.explode(F.array(F.when(F.col("__some"), keyed))))

    def same(x: Column, y: Column) -> Column:
        words_same = [F.get("__w", x["i"] + k) == F.get("__w", y["i"] + k) for k in range(3)]
        return F.coalesce((x["h"] == y["h"]) & words_same[0] & words_same[1] & words_same[2], F.lit(False))

    hits = F.filter("__s", lambda x, k: same(x, F.get("__s", k + 1)) | ((k > 0) & same(x, F.get("__s", F.greatest(k - 1, F.lit(0))))))
    place = lambda x: x["i"]
    df = df.withColumn("__p", F.explode(F.array(F.transform(hits, place))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__p", lambda p: F.array(p, p + 1, p + 2)))))
    return df.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(_less(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_less(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__some"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
    )


def failures(df: DataFrame) -> dict[str, Column]:
    """Each rule's failure of a measured row."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("__n_lines"),
    }


def hosts(measured_docs: DataFrame, host: Column, rules=RULES, reject: float = REJECT, bound: float = BOUND) -> DataFrame:
    """One row for each host: host, n, for each rule fails_, rate_ (shrunk), low_ (its lower bound) and watched_, and
    `host_kept`.

    The prior: with mean m and variance v of the hosts' rates, weighted by documents, and v0 the part
    of v that sampling alone explains, a + b = m (1 - m) / (v - v0) - 1. Hosts that differ by no more
    than chance get a prior of all documents' weight, so each takes the common rate.
    """
    failed = {r: c.cast("long") for r, c in failures(measured_docs).items() if r in rules}
    per = measured_docs.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"fails_{r}") for r, c in failed.items()])
    sums = [F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__k"), F.sum(F.col("n") * F.col("n")).alias("__nn")]
    sums += [x for r in failed for x in (F.sum(f"fails_{r}").alias(f"__f_{r}"), F.sum(F.col(f"fails_{r}") * F.col(f"fails_{r}") / F.col("n")).alias(f"__q_{r}"))]
    out = per.crossJoin(F.broadcast(per.agg(*sums)))  # one row of totals
    bad = F.lit(False)
    for r in failed:
        m = F.col(f"__f_{r}") / F.col("__n")
        within = m * (1 - m)
        # DerSimonian-Laird: between-host variance by moments
        between = F.try_divide(F.col(f"__q_{r}") - F.col("__n") * m * m - (F.col("__k") - 1) * within, F.col("__n") - F.col("__nn") / F.col("__n"))
        strength = F.when(F.coalesce(between, F.lit(0.0)) > 0, F.greatest(within / between - 1, F.lit(1.0))).otherwise(F.col("__n").cast("double"))
        rate = F.col(f"rate_{r}")
        out = out.withColumn(f"rate_{r}", (F.col(f"fails_{r}") + strength * m) / (F.col("n") + strength))
        out = out.withColumn(f"low_{r}", rate - bound * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1)))
        out = out.withColumn(f"watched_{r}", F.col(f"low_{r}") > m)
        bad = bad | (F.col(f"low_{r}") > reject * m)
    return out.select("host", "n", *[f"{x}_{r}" for r in failed for x in ("fails", "rate", "low", "watched")], (~bad).alias("host_kept"))


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", rules=RULES, reject: float = REJECT, bound: float = BOUND, keep_texts: bool = False) -> DataFrame:
    """Every row with the measures, `base_failed` and `kept`.

    Defined cases: null hosts are one host of their own; repeated rows are judged each; an empty table
    stays empty. Without keep_texts the text is dropped before the measures are written.
    """
    extra = ["base_failed", "kept", "__host"]
    df = measured(docs.drop(*extra), text_col)
    if not keep_texts:
        df = df.drop(text_col)
    df = df.withColumn("__host", F.coalesce(F.col(host_col).cast("string"), F.lit("\x00none")))
    df = written(df, "measures")  # measured once, for the hosts' counts and for the rows
    verdicts = hosts(df, F.col("__host"), rules, reject, bound)
    watched = F.array_compact(F.array(*[F.when(F.col(f"watched_{r}"), F.lit(r)) for r in rules]))
    verdicts = verdicts.select(F.col("host").alias("__host"), (~F.col("host_kept")).alias("__bad"), watched.alias("__watched"))
    marked = written(verdicts.where(F.col("__bad") | (F.size("__watched") > 0)), "hosts")
    failed = failures(df)
    df = df.withColumn("base_failed", failed["short"] | failed["repeats"])
    df = df.join(small(marked), "__host", "left")
    hit = F.lit(False)
    for r in rules:
        hit = hit | (F.coalesce(F.array_contains("__watched", r), F.lit(False)) & F.coalesce(failed[r], F.lit(False)))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("__bad", F.lit(False)) & ~hit).drop("__host", "__bad", "__watched", "__n_lines")


def kept(docs: DataFrame, host_col: str = "source", text_col: str = "text", rules=RULES, reject: float = REJECT, bound: float = BOUND) -> DataFrame:
    """The rows that pass, with the columns of the input."""
    own = (*MEASURES, "base_failed", "kept", "__host", "__bad", "__watched", "__n_lines", "__w", "__lines", "__h", "__s", "__p", "__a", "__some")
    named = {c: f"__in_{c}" for c in docs.columns if c in own}
    df = docs.withColumnsRenamed(named)
    out = judged(df, named.get(host_col, host_col), named.get(text_col, text_col), rules, reject, bound, keep_texts=True).where("kept")
    back = {v: k for k, v in named.items()}
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns])
