"""Queries of the sense-resolution operators; each has its SQL in `oracle`."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import alphabet as A
from glosswork.functions import text as X
from glosswork.operators import corpus as C
from glosswork.operators import lexicon as L
from glosswork.operators import morphology as M
from glosswork.operators import prompts as P
from glosswork.operators import resolve as R
from glosswork.operators import scoring as S
from glosswork.operators import tokens as T
from glosswork.operators import training as TR
from glosswork.operators import wordnet as N
from glosswork.plans.oracle import SQL
from glosswork.sources import readers, sinks, store
from glosswork.streaming import fold, generate
from glosswork.streaming import resolve as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
N_EVAL = 500


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query; its whole numbers are given as longs, as the SQL gives them."""

    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lex(spark: SparkSession, d: str) -> DataFrame:
    return L.derived(table(spark, d, "benchmark"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return T.tagged(T.base_tokens(docs(spark, d)), lex(spark, d))


def every_query(spark: SparkSession, d: str) -> DataFrame:
    """A look-up for each form under each of the four parts of speech that a token can have."""
    pos = F.explode(F.array(*[F.lit(p) for p in "nvar"])).alias("pos")
    rows = L.forms(lex(spark, d)).select("form", pos)
    return rows.withColumn("query_id", F.concat("form", F.lit("/"), "pos"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all look-ups with a logit made of their definition's length."""
    senses = L.definitions(every_query(spark, d), lex(spark, d))
    rows = senses.withColumn("logit", (F.length("definition") % 7).cast("double"))
    none = senses.select("query_id").distinct().select("query_id", F.lit("").alias("form"), F.lit("").alias("pos"), F.lit(A.REJECT).alias("ord"), F.lit("").alias("synset_id"), F.lit(P.NONE).alias("definition"), F.lit(3.0).alias("logit"))
    return rows.unionByName(none)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Examples with a prediction: the sense with the longest definition, and whether it is the gold."""
    lexicon = lex(spark, d)
    ex = C.examples(lexicon)
    asked = ex.select("form", "pos").distinct().withColumn("query_id", F.struct("form", "pos"))
    senses = L.definitions(asked, lexicon).withColumn("logit", F.length("definition").cast("double"))
    best = S.choose(senses, ["form", "pos"]).select("form", "pos", F.col("synset_id").alias("predicted"))
    rows = ex.join(best, ["form", "pos"]).withColumn("correct", F.col("predicted") == F.col("synset_id"))
    return rows.withColumn("key", F.concat("synset_id", F.lit("/"), "form"))


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """The first two words of each benchmark item's text, one id each."""
    words = F.regexp_extract_all("text", F.lit(X.WORD + "+"), F.lit(0))
    two = table(spark, d, "benchmark").select(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("label"), "item_id")
    one = table(spark, d, "benchmark").select(F.get(words, F.lit(0)).alias("label"), (F.col("item_id") + 1000000).alias("item_id"))
    rows = two.unionByName(one).where("label IS NOT NULL AND label <> ''")
    return rows.groupBy(F.lower("label").alias("label")).agg(F.min("item_id").alias("id"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.base_tokens(docs(spark, d)).withColumn("lemma", F.lower("word"))
    return R.entity_spans(tokens, gazetteer(spark, d))


@query
def disambiguate_documents(spark, d):
    return R.disambiguate(docs(spark, d), lex(spark, d)).withColumn("confidence", F.round("confidence", 6)).drop("synset_definition")


@query
def predictions(spark, d):
    return R.predicted(docs(spark, d), lex(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query
def lookup_definitions(spark, d):
    return L.lookup(every_query(spark, d), lex(spark, d))


@query
def lookup_adj_expansion(spark, d):
    return L.definitions(every_query(spark, d), lex(spark, d))


@query
def local_definition_map(spark, d):
    return L.local_map(every_query(spark, d), lex(spark, d))


@query
def lexicon_forms(spark, d):
    return L.forms(lex(spark, d))


@query
def sense_counts(spark, d):
    return L.sense_counts(lex(spark, d))


@query
def polysemous_forms(spark, d):
    return L.polysemous(lex(spark, d))


@query
def majority_pos(spark, d):
    return L.majority_pos(lex(spark, d))


@query
def base_tokens(spark, d):
    return T.base_tokens(docs(spark, d))


@query
def content_words(spark, d):
    return T.content(tagged(spark, d)).select("doc_id", "position", "lemma", "pos", "lex_pos")


@query
def word_queries(spark, d):
    return T.content(tagged(spark, d)).groupBy(F.col("lemma").alias("form"), F.col("lex_pos").alias("pos")).agg(F.count(F.lit(1)).alias("asked"))


def irregular(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions: the words of documents that begin with the letters of a form in reverse order stand for that form."""
    forms = lex(spark, d).groupBy("form").agg(F.min(F.when(F.col("pos") == "s", "a").otherwise(F.col("pos"))).alias("pos"))
    return forms.select(F.reverse("form").alias("form"), "pos", F.col("form").alias("lemma"))


def morphological(spark: SparkSession, d: str):
    return lambda tokens, lexicon: M.tagged(tokens, lexicon, irregular(spark, d))


@query
def lemmas(spark, d):
    """Base forms of the documents' distinct words."""
    words = T.base_tokens(docs(spark, d)).where(F.col("word").rlike(f"^{X.WORD}")).select(F.lower("word").alias("word")).distinct()
    return M.lemmas(words, lex(spark, d), irregular(spark, d))


@query
def lemmatised_tokens(spark, d):
    return morphological(spark, d)(T.base_tokens(docs(spark, d)), lex(spark, d)).select("doc_id", "position", "word", "lemma", "pos")


@query
def disambiguate_lemmatised(spark, d):
    """The whole flow with base forms."""
    tags = lambda texts, lexicon: M.tags(texts, lexicon, irregular(spark, d))
    out = R.disambiguate(docs(spark, d), lex(spark, d), tagger=morphological(spark, d), tags=tags)
    return out.withColumn("confidence", F.round("confidence", 6)).drop("synset_definition")


def synsets(spark: SparkSession, d: str) -> DataFrame:
    """A nested lexicon: an item is a synset, its words of four letters or more are its words, with a plural each; its pieces between
    full stops and its whole text are its examples, but every fourth item has none."""
    words = F.filter(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(X.WORD + "+"), F.lit(0)), F.lower)), lambda w: w.rlike("^[a-z]{4,}$"))
    sentences = F.concat(F.filter(F.split("text", r"\."), lambda x: x != ""), F.array("text"))
    pos = F.substring(F.lit(L.POS), (F.col("item_id") % 5 + 1).cast("int"), F.lit(1))
    nested = F.transform(words, lambda w: F.struct(w.alias("lemma"), F.array(w, F.concat(w, F.lit("s"))).alias("forms")))
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("nr"), F.concat(F.lit("syn-"), F.lpad(F.col("item_id").cast("string"), 8, "0"), F.lit("-"), pos).alias("synset_id"), pos.alias("pos"),
        F.col("text").alias("definition"), nested.alias("words"), F.when(F.col("item_id") % 4 == 3, F.array().cast("array<string>")).otherwise(sentences).alias("examples"),
    )


@query
def wordnet_examples(spark, d):
    return N.examples(synsets(spark, d))


@query
def wordnet_lexicon(spark, d):
    return N.lexicon(synsets(spark, d))


@query
def wordnet_training(spark, d):
    """How many training examples each lemma gets from its synsets' examples."""
    return TR.training_set(N.training_words(synsets(spark, d))).groupBy("word").agg(F.count(F.lit(1)).alias("examples"), F.countDistinct("sentence").alias("sentences"))


@query
def mark_by_index(spark, d):
    return R.marked(docs(spark, d), lex(spark, d))


@query
def mark_by_search(spark, d):
    lexicon = lex(spark, d)
    rows = lexicon.select("synset_id", "form", F.col("definition").alias("text"))
    return T.marked_by_search(rows, "text", "form").select("synset_id", "form", "marked")


@query
def option_letters(spark, d):
    return P.options(L.definitions(every_query(spark, d), lex(spark, d)), ["query_id"])


@query
def render_prompt(spark, d):
    rows = P.gathered(L.definitions(every_query(spark, d), lex(spark, d)), ["query_id", "form"])
    return rows.select("query_id", P.render(F.col("form"), F.concat(F.lit("Say *"), "form", F.lit("*.")), F.col("definitions")).alias("prompt"))


@query
def answer_alphabet(spark, d):
    """Each letter with the number of options that stand under it in all look-ups."""
    letters = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(A.alphabet())], "idx int, letter string")
    used = P.options(L.definitions(every_query(spark, d), lex(spark, d)), ["query_id"]).groupBy("letter").agg(F.count(F.lit(1)).alias("options"))
    return letters.join(used, "letter", "left").select("idx", "letter", F.coalesce("options", F.lit(0)).alias("options"))


@query
def entity_spans(spark, d):
    return spans(spark, d)


@query
def entity_coverage(spark, d):
    tokens = T.base_tokens(docs(spark, d))
    return R.covered_tokens(tokens, spans(spark, d), gazetteer(spark, d))


@query
def greedy_spans(spark, d):
    return R.greedy_spans(spans(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """A gazetteer of labels as real ones have them: of each benchmark item the whole text, its first three pieces between blanks, and
    each piece that has a mark in it."""
    pieces = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    marked = F.filter(pieces, lambda w: w.rlike(r"[^\p{L}\p{N}_]"))
    some = F.concat(F.array(F.col("text"), F.array_join(F.slice(pieces, 1, 3), " ")), marked)
    rows = table(spark, d, "benchmark").select(F.explode(some).alias("label"), "item_id")
    return rows.groupBy("label").agg(F.min("item_id").alias("id"))


@query
def gazetteer_spans(spark, d):
    """Labels with marks, and of whole texts."""
    return R.entity_spans(T.base_tokens(docs(spark, d)), labels(spark, d))


@query
def gazetteer_greedy(spark, d):
    return R.greedy_spans(R.entity_spans(T.base_tokens(docs(spark, d)), labels(spark, d)))


@query
def choice_softmax(spark, d):
    return S.softmax(scored(spark, d), ["query_id"]).select("query_id", "ord", F.round("p", 6).alias("p"))


@query
def choice_argmax(spark, d):
    return S.choose(scored(spark, d), ["query_id"]).withColumn("confidence", F.round("confidence", 6))


@query
def choice_array_form(spark, d):
    rows = scored(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "synset_id", "logit"))).alias("c"))
    p = S.array_softmax(F.transform("c", lambda x: x["logit"]))
    rows = rows.withColumn("x", S.array_choice(p))
    return rows.select("query_id", F.get("c", F.col("x.index").cast("int"))["synset_id"].alias("synset_id"), F.round("x.confidence", 6).alias("confidence"))


@query
def choice_slice(spark, d):
    full = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (i + F.col("item_id")) % 128 / F.lit(8128.0))
    rows = table(spark, d, "benchmark").select("item_id", full.alias("p"), (F.col("item_id") % 20 + 1).cast("int").alias("n"))
    return rows.select("item_id", F.array_join(F.transform(S.choice_slice(F.col("p"), F.col("n")), lambda x: F.format_number(x, 6)), " ").alias("slice"))


@query
def sentinels(spark, d):
    asked = every_query(spark, d)
    senses = L.definitions(asked, lex(spark, d)).withColumn("logit", F.length("definition").cast("double"))
    chosen = S.choose(senses, ["query_id"]).drop("rejected")
    return S.with_sentinels(asked.select("query_id"), chosen, ["query_id"]).withColumn("confidence", F.round("confidence", 6))


@query
def collect_examples(spark, d):
    return C.examples(lex(spark, d))


@query
def quota_split(spark, d):
    return C.split(C.examples(lex(spark, d)), N_EVAL).select("synset_id", "form", "part")


@query
def split_disjointness(spark, d):
    rows = C.split(C.examples(lex(spark, d)), N_EVAL)
    both = rows.where("part = 'eval'").select("synset_id").intersect(rows.where("part = 'bench'").select("synset_id"))
    return both.agg(F.count(F.lit(1)).alias("shared_synsets"))


@query
def accuracy(spark, d):
    return C.accuracy(judged(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query
def running_accuracy(spark, d):
    return C.running_accuracy(judged(spark, d), ["key"]).withColumn("accuracy", F.round("accuracy", 6))


@query
def mismatch_report(spark, d):
    return C.mismatches(judged(spark, d), ["key"]).select("idx", "key", "predicted")


@query
def batch_ids(spark, d):
    return C.batches(judged(spark, d).select("key"), ["key"])


@query
def length_buckets(spark, d):
    return C.length_buckets(table(spark, d, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("key"), "text"), "text", "key").drop("text")


@query
def bucket_padding(spark, d):
    rows = C.length_buckets(table(spark, d, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("key"), "text"), "text", "key")
    per = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest"), F.sum("len").alias("chars"))
    return per.select("bucket", "n", (F.col("n") * F.col("longest") - F.col("chars")).alias("padding"))


@query
def seeded_shuffle(spark, d):
    return C.seeded_order(table(spark, d, "benchmark").select("item_id"), "item_id", 42)


@query
def random_offsets(spark, d):
    n = L.sense_counts(lex(spark, d))
    k = X.key(42, F.col("form"), F.col("pos"))
    return n.select("form", "pos", X.number(k, 128 - F.col("senses")).alias("offset"))


@query
def eval_examples(spark, d):
    lexicon = lex(spark, d)
    held = C.split(C.examples(lexicon), N_EVAL).where("part = 'eval'").drop("part")
    rows = C.eval_examples(held, lexicon)
    return rows.select("synset_id", "form", "answer", F.md5("prompt").alias("prompt_md5"))


@query
def group_by_synset(spark, d):
    rows = C.examples(lex(spark, d))
    return rows.groupBy("synset_id").agg(F.array_join(F.array_sort(F.collect_list("form")), " ").alias("forms"), F.count(F.lit(1)).alias("n"))


@query
def sentence_rebuild(spark, d):
    """Each text put together of its pieces, inside its row: a row for each text, null and empty ones too."""
    return docs(spark, d).select("doc_id", F.md5(F.array_join(X.segments(F.col("text")), "")).alias("text_md5"))


@query
def prompt_masks(spark, d):
    """Whether all prompts of a form can be unmasked, and whether any has two masks."""
    lexicon = lex(spark, d)
    rows = C.eval_examples(C.examples(lexicon), lexicon).withColumn("masks", F.size(F.split("prompt", r"\[MASK\]")) - 1)
    return rows.groupBy("form").agg(F.count(F.lit(1)).alias("prompts"), F.bool_and(F.col("masks") > 0).alias("all_masked"), F.bool_or(F.col("masks") > 1).alias("any_twice"))


def words(spark, d):
    return TR.words_of(lex(spark, d))


@query
def train_examples(spark, d):
    return TR.sense_examples(words(spark, d)).select("word", "synset_id", "nr", "answer", F.md5("prompt").alias("prompt_md5"))


@query
def reject_examples(spark, d):
    return TR.reject_examples(words(spark, d)).select("word", "synset_id", "nr", "answer", F.md5("prompt").alias("prompt_md5"))


@query
def train_union(spark, d):
    rows = TR.training_set(words(spark, d))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("synset_id").endswith("_none")).alias("rejects"))


@query
def training_majority(spark, d):
    return TR.majority(words(spark, d))


def encoded(spark, d, most=TR.MAX_LENGTH):
    """Benchmark texts as the bytes of their UTF-8 (plus 2, as 0 is padding and 1 the mask) with a mask in the middle, and an answer letter;
    cut to `most` ids."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0)), lambda c: F.conv(c, 16, 10).cast("int") + 2)
    half = F.floor(F.size(codes) / 2).cast("int")
    ids = F.concat(F.slice(codes, F.lit(1), half), F.array(F.lit(1)), F.slice(codes, half + 1, F.size(codes)))
    rows = table(spark, d, "benchmark").select("item_id", ids.alias("ids"), P.letter(F.col("item_id") % 127).alias("answer"))
    return rows.select("item_id", "answer", *[c.alias(n) for n, c in TR.encoded(F.col("ids"), F.col("answer"), 1, most).items()])


def joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


@query
def label_encode(spark, d):
    return encoded(spark, d).where("kept").select("item_id", F.md5(joined("input_ids")).alias("ids_md5"), F.array_max("labels").alias("label"), F.array_position("labels", F.array_max("labels")).alias("at"))


@query
def truncation_filter(spark, d):
    return encoded(spark, d).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query
def pad_batch(spark, d):
    rows = encoded(spark, d).where("kept").withColumn("batch", F.floor(F.col("item_id") / 8))
    return TR.padded(rows).select("item_id", F.size("input_ids").alias("n"), F.md5(joined("input_ids")).alias("ids_md5"), F.md5(joined("attention_mask")).alias("mask_md5"), F.md5(joined("labels")).alias("labels_md5"))


def replies(spark, d):
    """Service replies made of the lexicon: batches of forms, every fifth failed, every seventh short."""
    per = lex(spark, d).where("pos = 'n'").groupBy("form").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("synset_id", "definition")))).alias("definitions"))
    rows = per.withColumn("batch_id", X.number(X.key(7, F.col("form")), 40))
    rows = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("form", F.map_entries("definitions").alias("e")))).alias("x"))
    data = F.transform("x", lambda x: F.struct(F.map_from_entries(x["e"]).alias("definitions")))
    status = F.when(F.col("batch_id") % 5 == 0, 500).otherwise(200)
    return rows.select("batch_id", status.alias("status"), F.to_json(F.struct(data.alias("data"))).alias("body"), (F.size("x") + F.when(F.col("batch_id") % 7 == 0, 1).otherwise(0)).alias("n_queries"))


@query
def batch_reply(spark, d):
    return readers.batch_reply(replies(spark, d)).select("batch_id", "query", "ord", "synset_id", "definition")


@query
def service_lexicon(spark, d):
    forms = lex(spark, d).where("pos = 'n'").select("form").distinct().withColumn("batch_id", X.number(X.key(7, F.col("form")), 40))
    asked = forms.groupBy("batch_id").agg(F.array_sort(F.collect_list("form")).alias("x")).select("batch_id", F.posexplode("x").alias("query", "form"))
    return readers.lexicon_of(asked.withColumn("pos", F.lit("n")), replies(spark, d))


@query
def synset_payload(spark, d):
    item = F.struct(F.lit("synset").alias("type"), F.col("synset_id").alias("id"), F.col("pos").alias("pos"), F.col("definition").alias("definition"), F.lit("x").alias("links"))
    other = F.struct(F.lit("sense").alias("type"), F.col("synset_id").alias("id"), F.col("pos").alias("pos"), F.lit("").alias("definition"), F.lit("x").alias("links"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(item, other).alias("included"))).alias("data")))
    return readers.synsets(lex(spark, d).select("form", body.alias("body")))


@query
def ndjson_fold(spark, d):
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), (F.col("turn") == 2).alias("done")))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("line_no"), line.alias("value"))
    return readers.folded(rows).select("stream_id", F.md5("content").alias("content_md5"))


@query
def skip_list(spark, d):
    path = store.place(spark, "skip")
    sinks.append_skipped(lex(spark, d).where("pos = 'v'").select(F.concat(F.lit("  "), "form").alias("form")), path)
    return readers.skip_list(spark, path)


@query
def pending_forms(spark, d):
    lexicon = lex(spark, d)
    return readers.pending(L.forms(lexicon), lexicon.where("pos = 'v'").select("form").distinct(), lexicon.where("pos = 'r'").select("form").distinct())


@query
def generate_gate(spark, d):
    more, one = readers.split_by_senses(lex(spark, d).select("form", "synset_id"))
    return more.withColumn("gate", F.lit("generate")).unionByName(one.withColumn("gate", F.lit("skip")))


@query
def llm_requests(spark, d):
    return sinks.requests(lex(spark, d), "any-model")


@query
def training_directory(spark, d):
    path = store.place(spark, "words")
    sinks.write_words(words(spark, d), path)
    return readers.training_words(spark, path).select("word", "ord", "id", "pos", F.md5("source_definition").alias("source_md5"), F.size("examples").alias("examples"))


@query
def lexicon_table(spark, d):
    path = store.place(spark, "lexicon")
    lex(spark, d).withColumn("comment", F.lit("other columns are left out")).write.parquet(path)
    return readers.lexicon(spark, path)


@query
def nested_result(spark, d):
    result = sinks.nested_rows(R.resolved_rows(docs(spark, d), lex(spark, d), R.greedy_spans(spans(spark, d)), digits=6))
    token, entity = "word string, lemma string, pos string, position bigint, start_char bigint, end_char bigint, synset_id string, synset_definition string, confidence double", ", ".join(f"{c} {t}" for c, t in sinks.ENTITY.items())
    read = result.select("doc_id", F.from_json("result", f"tokens array<struct<{token.replace(' ', ':').replace(',:', ',')}>>, entities array<struct<{entity.replace(' ', ':').replace(',:', ',')}>>").alias("r"))

    def lines(items, fields):
        part = lambda x, c: F.coalesce(F.when(x[c].isNotNull(), F.format_string("%.6f", x[c])) if c == "confidence" else x[c].cast("string"), F.lit("-"))
        return F.md5(F.array_join(F.transform(items, lambda x: F.concat_ws("|", *[part(x, c) for c in fields])), "\n"))

    return read.select("doc_id", F.size("r.tokens").alias("n_tokens"), lines("r.tokens", sinks.TOKEN).alias("tokens_md5"), F.size("r.entities").alias("n_entities"), lines("r.entities", list(sinks.ENTITY)).alias("entities_md5"))


@query
def html_result(spark, d):
    return sinks.html_rows(R.resolved_rows(docs(spark, d), lex(spark, d), R.greedy_spans(spans(spark, d)))).select("doc_id", F.md5("html").alias("html_md5"))


@query
def health(spark, d):
    """The answer of a service that has loaded the lexicon."""
    return sinks.health(lex(spark, d)).select("status", "senses", (F.abs(F.unix_timestamp() - F.unix_timestamp("timestamp")) < 3600).alias("now"))


@query
def letter_sidecar(spark, d):
    """The file beside a model's weights, and the letters that the lexicon's widest look-up needs."""
    most = L.definitions(every_query(spark, d), lex(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    return sinks.sidecar(spark).join(most).select(F.array_join("letters", "").alias("letters"), "num_letters", "most")


@query
def request_errors(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, "en").otherwise("").alias("lang"))
    return sinks.validated(rows).select("conv_id", "turn", "error")


@query
def resolve_array_form(spark, d):
    """The streaming flow on a batch."""
    return stream.resolved(docs(spark, d), lex(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query
def resolve_stream(spark, d):
    at = store.place(spark, "stream")
    docs(spark, d).repartition(3).write.parquet(f"{at}/in")
    stream.run(spark, f"{at}/in", "doc_id bigint, text string", lex(spark, d), f"{at}/out", f"{at}/checkpoint", maxFilesPerTrigger=2)
    return stream.results(spark, f"{at}/out").withColumn("confidence", F.round("confidence", 6))


@query
def ndjson_stream(spark, d):
    """Conversations as streamed responses, a few turns a micro-batch; a response ends with its third turn, and gives nothing before."""
    at = store.place(spark, "responses")
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), (F.col("turn") == 2).alias("done")))
    rows = store.written(table(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("line_no"), line.alias("value")), "lines")
    for turn in range(3):  # a file each, in this order
        rows.where(f"line_no = {turn}" if turn < 2 else "line_no >= 2").coalesce(1).write.mode("append").parquet(f"{at}/in")
    lines = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    fold.folded(lines).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream_id bigint, content string").parquet(f"{at}/out").select("stream_id", F.md5("content").alias("content_md5"))


def echoed(payload: str):
    """A made-up service: each synset that is asked for with its definition behind a tilde, in two lines and an end; no answer for
    forms of nine letters."""
    asked = json.loads(payload)
    if re.search(r"word form '[a-z]{9}'", asked["messages"][0]["content"]):
        raise OSError("no answer")
    senses = [{"id": x["id"], "pos": x["attributes"]["pos"], "source_definition": x["attributes"]["definition"], "alternative_definition": "~" + x["attributes"]["definition"], "examples": ["one", "two", "three"]} for x in json.loads(asked["messages"][1]["content"])]
    text = json.dumps(senses)
    for part in (text[: len(text) // 2], text[len(text) // 2 :]):
        yield json.dumps({"message": {"content": part}, "done": False})
    yield json.dumps({"done": True})


@query
def generation_run(spark, d):
    """Forms in three files, of which one comes twice, generated micro-batch by micro-batch: each form's outcome and its file's senses."""
    at = store.place(spark, "generation")
    lexicon = store.written(lex(spark, d), "lexicon")
    forms = L.forms(lexicon).unionByName(lexicon.select(F.concat(F.lit("un"), "form").alias("form")).distinct()).withColumn("n", F.length("form") % 3)
    for n in (0, 1, 2, 0):
        forms.where(f"n = {n}").select("form").coalesce(1).write.mode("append").text(f"{at}/in")
    log = generate.run(spark, f"{at}/in", lambda todo: todo.join(lexicon, "form"), echoed, "any-model", f"{at}/out", f"{at}/checkpoint", maxFilesPerTrigger=1)
    made = readers.training_words(spark, f"{at}/out/words").groupBy(F.col("word").alias("form")).agg(F.count(F.lit(1)).alias("senses"), F.max(F.md5("alternative_definition")).alias("greatest_md5"))
    return log.join(made, "form", "left")


def hashed_model():
    """A made-up model: each letter's logit is a hash of the whole prompt, shifted by the letter."""

    def score(prompts):
        start = [int(hashlib.md5(p.encode()).hexdigest()[:8], 16) for p in prompts]
        return [[(h + i * 7919) % 1000 / 100 for i in range(A.SIZE)] for h in start]

    return score


@query
def occurrence_choices(spark, d):
    """Every occurrence of a content word marked at its own place and scored by a model."""
    out = R.disambiguate(docs(spark, d), lex(spark, d), S.ModelScorer(hashed_model)).where("confidence IS NOT NULL")
    return out.select("doc_id", "position", "lemma", "synset_id", F.round("confidence", 6).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}
