"""Scorers, and the choice of a sense from its candidates' scores."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.alphabet import REJECT
from glosswork.operators import lexicon as L
from glosswork.operators import prompts as P
from glosswork.operators.prompts import NONE

MISSING = "No definitions found"
HELD_BYTES = 16 << 20  # of definitions that a task holds


class Scorer(ABC):
    """Adds `logit` to candidates (query columns, ord, synset_id, and definition if it is read)."""

    reads_definitions = True

    @abstractmethod
    def score(self, candidates: DataFrame) -> DataFrame: ...


class OverlapScorer(Scorer):
    """Simplified Lesk: the words that a definition shares with the context, times `weight`. Needs the
    column `overlap`."""

    reads_definitions = False

    def __init__(self, weight: float = 1.0):
        self.weight = weight

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("logit", F.col("overlap") * F.lit(self.weight))


class PrecomputedScorer(Scorer):
    """Logits from a table with the same keys."""

    def __init__(self, logits: DataFrame, keys: list[str]):
        self.logits, self.keys = logits, keys

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.join(self.logits.select(*self.keys, "logit"), self.keys, "left").fillna(0.0, ["logit"])


class EmbeddingScorer(Scorer):
    """Cosine of `context_vec` and `sense_vec`, times `weight`."""

    def __init__(self, weight: float = 10.0):
        self.weight = weight

    def score(self, candidates: DataFrame) -> DataFrame:
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        a, b = F.col("context_vec"), F.col("sense_vec")
        return candidates.withColumn("logit", F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0)) * self.weight)


Model = Callable[[list[str]], list[list[float]]]


def in_buckets(model: Model, prompts: Iterator[tuple], size: int, ahead: int, most_chars: int) -> Iterator[tuple]:
    """(key, prompt) to (key, prompt, logits, longest): prompts are held until there are `ahead` of them or they have `most_chars`
    characters, and go to the model in order of length, `size` at a time. longest: the length up to which the prompt was padded."""

    def flushed(held: list[tuple]) -> Iterator[tuple]:
        held.sort(key=lambda x: len(x[1]))
        for i in range(0, len(held), size):
            part = held[i : i + size]
            logits = model([p for _, p in part])
            if len(logits) != len(part):
                raise ValueError(f"{len(logits)} results for {len(part)} prompts")
            yield from ((k, p, z, len(part[-1][1])) for (k, p), z in zip(part, logits, strict=True))

    held, chars = [], 0
    for item in prompts:
        held.append(item)
        chars += len(item[1])
        if len(held) >= ahead or chars >= most_chars:
            yield from flushed(held)
            held, chars = [], 0
    yield from flushed(held)


class ModelScorer:
    """A masked language model's choice for every occurrence of a content word, each marked at its own place.

    load: runs once in each task and gives a function from a list of prompts to a list of logits for all letters each. A text and
    its words' places make one row, so a text isn't copied for each of its words: prompts are made in the task, one after
    the other, and scored in buckets of similar length (`size` prompts, chosen among `ahead`).
    """

    def __init__(self, load: Callable[[], Model], mask: str = P.MASK, size: int = 4, ahead: int = 256, most_chars: int = 16 << 20):
        self.load, self.mask, self.size, self.ahead, self.most_chars = load, mask, size, ahead, most_chars

    def scored(self, docs: DataFrame, content: DataFrame, senses: DataFrame) -> DataFrame:
        """docs: doc_id, text. content: doc_id, position, word, start_char, and form and pos of its senses. senses: form, pos, senses
        (array of ord, synset_id, definition in rank order, fewer than the letters). Gives doc_id, position, form, pos, logits (of the senses, then of
        the reject option), chars and longest (of the prompt, and of its bucket). Ids of documents are taken to be their own; rows of
        content without senses have no row."""
        load, mask, size, ahead, most = self.load, self.mask, self.size, self.ahead, self.most_chars
        texts, at = senses.select("form", "pos", F.transform("senses", lambda s: s["definition"]).alias("definitions")), ["position", "start_char", "word", "form", "pos"]
        held = None
        if L.bounded(texts, bytes_=HELD_BYTES) is not texts:  # each task looks them up, so they aren't dealt with every occurrence
            held = docs.sparkSession.sparkContext.broadcast({(r["form"], r["pos"]): r["definitions"] for r in texts.collect()})
            asked = content.join(F.broadcast(texts.select("form", "pos")), ["form", "pos"], "left_semi")
        else:
            asked, at = content.join(L.bounded(texts), ["form", "pos"]), [*at, "definitions"]
        rows = asked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*at))).alias("places")).join(docs.select("doc_id", "text"), "doc_id")
        kinds = dict(content.dtypes)
        out = f"doc_id {kinds['doc_id']}, position {kinds['position']}, form string, pos string, logits array<double>, chars int, longest int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()

            def prompts() -> Iterator[tuple]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        doc, text = batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py()
                        for x in batch.column("places")[i]:
                            x = x.as_py()
                            at, end = x["start_char"], x["start_char"] + len(x["word"])
                            definitions = x["definitions"] if held is None else held.value[x["form"], x["pos"]]
                            prompt = P.plain(x["word"], f"{text[:at]}*{text[at:end]}*{text[end:]}", definitions, mask)
                            yield (doc, x["position"], x["form"], x["pos"], len(definitions)), prompt

            done: list[tuple] = []
            for item in in_buckets(model, prompts(), size, ahead, most):
                done.append(item)
                if len(done) >= ahead:
                    yield batched(done)
                    done = []
            if done:
                yield batched(done)

        def batched(done: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*[k[:4] for k, *_ in done], strict=True)]
            logits = [[*z[: k[4]], z[REJECT]] for k, _, z, _ in done]
            return pa.RecordBatch.from_pydict(dict(zip(("doc_id", "position", "form", "pos"), columns, strict=True)) | {"logits": logits, "chars": pa.array([len(p) for _, p, _, _ in done], pa.int32()), "longest": pa.array([n for *_, n in done], pa.int32())})

        return rows.select("doc_id", "text", "places").mapInArrow(run, out)

    def chosen(self, docs: DataFrame, content: DataFrame, senses: DataFrame) -> DataFrame:
        """doc_id, position, synset_id, definition, confidence, rejected of each occurrence: the softmax's first greatest, in its own row."""
        rows = self.scored(docs, content, senses).withColumn("x", array_choice(array_softmax(F.col("logits")))).join(L.bounded(senses), ["form", "pos"])
        sense = F.get("senses", F.col("x.index").cast("int"))
        none = F.col("x.index") == F.size("senses")
        return rows.select("doc_id", "position", F.when(none, "").otherwise(sense["synset_id"]).alias("synset_id"), F.when(none, NONE).otherwise(sense["definition"]).alias("definition"), F.col("x.confidence").alias("confidence"), none.alias("rejected"))


def softmax(rows: DataFrame, by: list[str], logit: str = "logit") -> DataFrame:
    """Adds `p`, each candidate's share."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return rows.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def choose(rows: DataFrame, by: list[str]) -> DataFrame:
    """The best candidate (of equal ones the first) of each query with its confidence; the reject option, which brings no synset, is
    told by its rank, not by its text (so is a sense of that rank, as the SQL has it). One aggregate: the best so far and the scores, one for
    each sense, are gathered before rows are dealt; no query's rows are sorted."""
    best = F.max_by(F.struct("ord", "synset_id", "definition"), F.struct("logit", (-F.col("ord")).alias("first"), (F.col("synset_id") != "").alias("sense")))
    rows = rows.groupBy(*by).agg(best.alias("x"), F.array_sort(F.collect_list("logit")).alias("z"))  # in order, so that sums don't depend on it
    top = F.array_max("z")
    share = 1 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return rows.select(*by, F.col("x.synset_id").alias("synset_id"), F.col("x.definition").alias("definition"), share.alias("confidence"), (F.col("x.ord") == REJECT).alias("rejected"))


def array_softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def pruned(weights: Column, ids: Column) -> Column:
    """The rows of a decoder's weights (or the entries of its bias) at the letters' token ids, in the letters' order; an
    id without a row is an error."""
    return F.transform(ids, lambda i: F.element_at(weights, i.cast("int") + 1))


def letter_logits(hidden: Column, weights: Column, bias: Column) -> Column:
    """The letters' logits of a mask's hidden state: a dot product with each pruned row, plus its bias."""
    dot = lambda row: F.aggregate(F.zip_with(hidden, row, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(weights, bias, lambda row, b: dot(row) + b)


def choice_slice(p: Column, n: Column) -> Column:
    """The probabilities of the n options and of the reject option, out of all letters'."""
    return F.concat(F.slice(p, F.lit(1), n), F.array(F.get(p, F.lit(REJECT))))


def array_choice(p: Column) -> Column:
    """struct(index, confidence): the first greatest, and its share; 0 where the sum is not positive."""
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.struct((F.array_position(p, F.array_max(p)) - 1).alias("index"), F.when(total > 0, F.array_max(p) / total).otherwise(0.0).alias("confidence"))


def with_sentinels(queries: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Queries without candidates get the sentinel synset and confidence 0."""
    out = queries.join(chosen, by, "left")
    return out.withColumns({"synset_id": F.coalesce("synset_id", F.lit(MISSING)), "definition": F.coalesce("definition", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0))})
