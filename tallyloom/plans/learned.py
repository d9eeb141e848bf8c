"""Vocabularies, augmentation and models over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import augment as A
from tallyloom.operators import bpe as V
from tallyloom.operators import models as M
from tallyloom.operators.classification import confusion_counts
from tallyloom.operators.corpus import word_counts
from tallyloom.plans.registry import query
from tallyloom.plans.tables import Tables
from tallyloom.session import bounded_batches, scratch_dir

VOCAB, SMALL_VOCAB = 180, 140


_TRAINED: dict[tuple[str, ...], V.Vocabulary] = {}


def _vocab(t: Tables) -> V.Vocabulary:
    """Trained once per application and state of the table's files; several queries use it."""
    key = (t.spark.sparkContext.applicationId, t.state("documents"), str(VOCAB))
    if key not in _TRAINED:
        _TRAINED[key] = V.train_bpe(t.documents, VOCAB)
    return _TRAINED[key]


@query("train_bpe")
def _(t: Tables):
    vocab = V.train_bpe(t.documents, VOCAB)
    # the vocabulary itself is the result: bounded by its size
    rows = [(token, i) for token, i in vocab.tokens.items()]
    return t.spark.createDataFrame(rows, "token string, id int")


@query("encode")
def _(t: Tables):
    # the vocabulary is trained here, not taken from what another query has trained
    bounded_batches(t.spark)
    ids = t.documents.select("doc_id", V.encode(F.col("text"), V.train_bpe(t.documents, VOCAB)).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_ids"), F.array_min("ids").alias("low"), F.array_max("ids").alias("high"), "ids")


# decoding gives the text back apart from blanks
@query("decode", r"SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS letters FROM @documents")
def _(t: Tables):
    vocab = _vocab(t)
    back = t.documents.select("doc_id", V.decode(V.encode(F.col("text"), vocab), vocab).alias("back"))
    return back.select("doc_id", F.regexp_replace("back", r"\s+", "").alias("letters"))


# without merges each letter is a token, and decoding puts blanks between tokens: texts of letters one by one survive
@query("roundtrip_audit", r"""
WITH s AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM @documents),
b AS (SELECT text, rtrim(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '(.)', '\1 ', 'gs')) AS back FROM s)
SELECT 'letters' AS tokenizer, count(*) AS n, count(*) FILTER (back = text) AS n_same, count(*) AS n_same_letters,
  CASE WHEN bool_and(back = text) THEN 'OK' ELSE 'BROKEN' END AS verdict FROM b HAVING count(*) > 0""")
def _(t: Tables):
    vocab = _vocab(t)
    return V.roundtrip_audit(t.documents, {"letters": V.Vocabulary(vocab.tokens, [])})


# SQL can't follow the merges, so the trained vocabularies have no oracle; a test compares with a plain encoder
@query("roundtrip_audit_trained")
def _(t: Tables):
    vocab = _vocab(t)
    return V.roundtrip_audit(t.documents, {"small": vocab.first(SMALL_VOCAB), "large": vocab})


# symbols that carry their blanks, and bytes for unseen letters: merges or not, every text comes back
@query("roundtrip_audit_lossless", """
SELECT 'lossless' AS tokenizer, count(*) AS n, count(*) AS n_same, count(*) AS n_same_letters, 'OK' AS verdict FROM @documents WHERE text IS NOT NULL HAVING count(*) > 0""")
def _(t: Tables):
    vocab = V.train_bpe(t.documents, VOCAB + 256, lossless=True)
    return V.roundtrip_audit(t.documents.where("text IS NOT NULL"), {"lossless": vocab})


def _lexicon(t: Tables):
    """Tags and synonyms for the words of the corpus, by rule, standing in for a dictionary."""
    counts = word_counts(t.documents).filter("length(word) > 2 AND n > 1")
    tag = F.expr("CASE length(word) % 5 WHEN 0 THEN 'NN' WHEN 1 THEN 'JJ' WHEN 2 THEN 'NNP' WHEN 3 THEN 'VB' ELSE 'NNS' END")
    # read by several joins: the words are counted once, and their size is known
    to = scratch_dir(t.spark, "tags")
    counts.select("word", tag.alias("tag")).write.parquet(to)
    tags = t.spark.read.parquet(to)
    options = F.array(F.concat("word", F.lit("ish")), F.reverse("word"), F.concat("word", F.lit("_like")), F.col("word"))
    lexicon = tags.select("word", A.part_of_speech(F.col("tag")).alias("pos"), F.explode(options).alias("synonym")).filter("pos IS NOT NULL AND word NOT LIKE 'a%'")
    return tags, lexicon


WORDS = r"""pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS word FROM @documents),
pre AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) AS word FROM @documents),
tags AS (SELECT word, CASE length(word) % 5 WHEN 0 THEN 'NN' WHEN 1 THEN 'JJ' WHEN 2 THEN 'NNP' WHEN 3 THEN 'VB' ELSE 'NNS' END AS tag FROM pre GROUP BY word HAVING count(*) > 1 AND length(word) > 2),
fit AS (SELECT word, CASE WHEN tag LIKE 'J%' THEN 'a' ELSE 'n' END AS pos FROM tags WHERE tag LIKE 'J%' OR (tag LIKE 'N%' AND tag <> 'NNP'))"""


@query("replaceable_words", f"WITH {WORDS} SELECT doc_id, pos, count(*) AS n FROM pieces JOIN fit USING (word) WHERE length(word) > 2 AND regexp_matches(word, '^[\\p{{L}}\\p{{N}}_]') GROUP BY ALL")
def _(t: Tables):
    tags, _ = _lexicon(t)
    return A.replaceable_words(t.documents, tags, "doc_id").groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"))


# which words are drawn depends on the hash; the text around them may not change
@query("synonym_skeleton", r"SELECT doc_id, regexp_replace(text, '[\p{L}\p{N}_]+', 'w', 'g') AS skeleton FROM @documents")
def _(t: Tables):
    tags, lexicon = _lexicon(t)
    out = A.synonym_augment(t.documents.select("doc_id", "text"), tags, lexicon, "doc_id")
    return out.select("doc_id", F.regexp_replace("text", r"(?U)\w+", "w").alias("skeleton"))


@query("synonym_augment")
def _(t: Tables):
    tags, lexicon = _lexicon(t)
    return A.synonym_augment(t.documents.select("doc_id", "text"), tags, lexicon, "doc_id")


@query("augment_stats")
def _(t: Tables):
    tags, lexicon = _lexicon(t)
    out = A.augment_stats(A.synonym_augment(t.documents.select("doc_id", "text"), tags, lexicon, "doc_id"), "doc_id")
    return out.withColumn("avg_replaced", F.round("avg_replaced", 6))


def _linear():
    """A fixed linear scorer, in place of a model file."""
    import numpy as np

    def score(batch):
        import pandas as pd

        x = np.array(batch["embedding"].tolist(), dtype=np.float64)
        return pd.Series(np.round(x @ np.arange(1, x.shape[1] + 1), 5), index=batch.index)

    return score


@query("score_batches", """
SELECT vec_id, label, round(list_sum([CAST(x AS DOUBLE) * i for x, i in embedding]), 5) AS score FROM @embeddings""")
def _(t: Tables):
    return M.score_batches(t.embeddings, _linear, 128).select("vec_id", "label", "score")




@query("metric_callback", """
SELECT count(*) FILTER (label % 10 = CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS INT)) / count(*) AS metric FROM @embeddings""")
def _(t: Tables):
    pred = ((F.array_position("embedding", F.array_max("embedding")) - 1) % 10).cast("int")
    pairs = confusion_counts(t.embeddings.select("label", pred.alias("pred")), "label", "pred")

    def share(label, prediction, n):
        return float(n[label == prediction].sum()) / float(n.sum())

    import pandas as pd

    share.__annotations__.update({"label": pd.Series, "prediction": pd.Series, "n": pd.Series, "return": float})
    return M.metric_from_pairs(pairs, share)


@query("train_text_classifier")
def _(t: Tables):
    rows = t.view("sentiment").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5)))
    train, valid = rows.filter("split = 'train' AND fold > 0"), rows.filter("split = 'train' AND fold = 0")
    model, _ = M.train_text_classifier(train, valid)
    return M.report_on(model, rows.filter("split = 'test'"))


@query("param_search")
def _(t: Tables):
    rows = t.view("sentiment").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5)))
    train, valid = rows.filter("split = 'train' AND fold > 0"), rows.filter("split = 'train' AND fold = 0")

    def objective(params):
        model, history = M.train_text_classifier(train, valid, features=256 * params["rank"], rounds=(1 + params["alpha"] // params["rank"],), penalty=params["dropout"])
        return 1 - history[-1][1], {"accuracy": history[-1][1]}

    results = M.param_search(M.sample_trials(t.spark, 4, 11), objective)
    schema = "trial long, rank int, alpha int, dropout double, loss double, accuracy double"
    table = t.spark.createDataFrame([{**{"accuracy": None}, **r} for r in results], schema)
    return M.param_ranges(table, ["rank", "alpha", "dropout"])
