"""Queries of problem 9: abuse in documents, by document, sentence and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.abuse import SAMPLE_ABUSIVE, SAMPLE_CHARS, SAMPLE_OTHER, Model, sentences
from newsloom.sources import load


def fit(docs: DataFrame, labels: DataFrame, abusive: int = SAMPLE_ABUSIVE, other: int = SAMPLE_OTHER, chars: int = SAMPLE_CHARS) -> Model:
    """Model fitted on a bounded sample of the labelled documents.

    A document's label is the mean of its distinct judgements.  The sample is at
    most ``abusive`` documents of label 0.5 or more and ``other`` ones, in the
    order of a hash of their id and whole; one that would bring those of its kind
    above ``chars`` characters together is passed over.
    Each stands for its class's share of all labelled documents.  Lengths of the
    first ones and texts of the chosen ones are collected, nothing else.
    """
    judged = (
        labels.where("doc_id is not null and abusive is not null")
        .dropDuplicates(["doc_id", "rater", "abusive"])
        .groupBy("doc_id")
        .agg(F.avg("abusive").alias("label"))
    )
    known = docs.where("text is not null").select("doc_id", "text").join(judged, "doc_id")
    is_bad = F.col("label") >= 0.5
    sizes = known.select(is_bad.alias("bad")).groupBy("bad").agg(F.count("*").alias("n"))
    there = {r["bad"]: r["n"] for r in sizes.collect()}
    nth = F.row_number().over(Window.partitionBy("bad").orderBy("h", "doc_id"))
    first = known.select("doc_id", is_bad.alias("bad"), F.length("text").alias("chars"), F.xxhash64("doc_id").alias("h")).withColumn("nth", nth)
    listed = first.where(F.col("nth") <= F.when(F.col("bad"), abusive).otherwise(other)).where(F.col("nth") <= max(abusive, other)).toPandas().sort_values("nth")
    taken = []
    for _, kind in listed.groupby("bad"):
        room = chars
        for i, n in zip(kind["doc_id"], kind["chars"], strict=True):
            if n <= room:
                taken.append((int(i),))
                room -= n
    ids = docs.sparkSession.createDataFrame(taken, "doc_id bigint")
    texts = known.join(F.broadcast(ids), "doc_id").toPandas()
    order = {int(i): k for i, k in zip(listed["doc_id"], listed["nth"], strict=True)}
    texts = texts.iloc[texts["doc_id"].map(order).argsort(kind="stable")] if len(texts) else texts
    parts = [texts[texts["label"] >= 0.5], texts[texts["label"] < 0.5]]
    scale = [there.get(bad, 0) / max(1, len(p)) for bad, p in zip((True, False), parts, strict=True)]
    rows = pd.concat(parts, ignore_index=True)
    weights = np.concatenate([np.full(len(p), s / max(scale[0], 1e-9)) for s, p in zip(scale, parts, strict=True)])
    return Model.fit(rows["text"].tolist(), rows["label"].to_numpy(dtype=float), weights)


def scored(docs: DataFrame, model: Model, locate: bool = True) -> DataFrame:
    """``docs`` (``doc_id, text`` and others but the text) with ``score``, ``sentence_no`` and ``sentence``.

    A null text scores 0 and has no sentence.
    """
    keep = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double" + (", sentence_no int, sentence string" if locate else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            texts = pdf["text"].tolist()
            there = np.array([t is not None for t in texts], dtype=bool)
            given = [t for t in texts if t is not None]
            s, at, _ = model.score(given)
            score = np.zeros(len(texts))
            score[there] = s
            out["score"] = score
            if locate:
                number, words = np.full(len(texts), None, dtype=object), np.full(len(texts), None, dtype=object)
                number[there] = [int(x) for x in at]
                words[there] = [sentences(t)[k].strip() if x >= model.threshold else None for t, k, x in zip(given, at, s, strict=True)]
                out["sentence_no"], out["sentence"] = number, words
            yield out

    return docs.select(*keep, "text").mapInPandas(run, schema)


def _scores(spark: SparkSession, d: str, *columns: str, locate: bool = False) -> tuple[DataFrame, Model]:
    docs = load(spark, d, "documents")
    model = fit(docs, load(spark, d, "doc_labels"))
    return scored(docs.select("doc_id", *columns, "text"), model, locate), model


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose score reaches the model's threshold."""
    out, model = _scores(spark, d)
    return out.where(F.col("score") >= model.threshold).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document; for those found, the sentence that offends most."""
    out, _ = _scores(spark, d, locate=True)
    return out.select("doc_id", F.round("score", 6).alias("score"), "sentence_no", "sentence")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents found, per source."""
    out, model = _scores(spark, d, "source")
    found = F.col("score") >= model.threshold
    return out.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(found).alias("n_found"), F.round(F.count_if(found) / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
