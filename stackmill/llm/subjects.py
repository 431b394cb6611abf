"""Subjects of documents, from the proportions of distributed latent Dirichlet topics.

Topics are fitted with Spark's online variational LDA over all documents. Each topic is mapped to a subject through its
top terms: a labelled sample of documents and the subjects' own descriptions say how much each term speaks for each
subject, and a topic whose top terms speak clearly for one subject belongs to it; the others are general talk. A
document gets the subjects whose topics together make up a large enough share of it.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.words import told_words
from stackmill.session import spread as over_tasks

NONE = "none"
#: Least share that is kept while the share that counts is not set yet.
LEAST = 0.05


def term_votes(tokens: DataFrame, told: DataFrame, known: DataFrame) -> DataFrame:
    """group, term, subject and how many labelled documents of the subject have the term, each document weighing one."""
    weight = told.groupBy("doc").agg(F.count("*").alias("n"))
    said = tokens.join(F.broadcast(told.join(weight, "doc")), "doc").select("group", "subject", (1 / F.col("n")).alias("w"), F.explode(F.array_distinct("terms")).alias("term"))
    return said.groupBy("group", "term", "subject").agg(F.sum("w").alias("votes")).join(known, ["group", "term"], "left_semi")


class Spread:
    """How the terms of a group of documents are spread over the subjects and 'none' in its labelled documents."""

    def __init__(self, terms: list[str], votes: dict[str, dict[str, float]], size: dict[str, float], described: dict[str, str]) -> None:
        self.subjects = sorted(described)
        at = {t: i for i, t in enumerate(terms)}
        column = {s: k for k, s in enumerate(self.subjects)}
        counts, sizes = np.zeros((len(terms), len(self.subjects) + 1)), np.zeros(len(self.subjects) + 1)
        for s, n in size.items():
            sizes[column.get(s, -1)] += n
        for t, by in votes.items():
            for s, n in by.items():
                counts[at[t], column.get(s, -1)] += n
        for k, s in enumerate(self.subjects):  # a description is one more document, of many words in one
            sizes[k] += 1
            for t in set(str(described[s] or "").lower().replace(".", " ").replace(",", " ").replace(":", " ").split()):
                for form in (t, t + "s"):
                    if form in at:
                        counts[at[form], k] += 3
        counts /= np.maximum(sizes, 1)
        self.known = counts.sum(axis=1) > 0
        self.spoken = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)

    def of_topics(self, beta: np.ndarray, top_terms: int, clear: float) -> dict[str, list[int]]:
        """The topics of each subject: those whose top terms speak for it by the share `clear` or more."""
        found: dict[str, list[int]] = {}
        for t, b in enumerate(beta / beta.sum(axis=1, keepdims=True)):
            top = [i for i in np.argsort(-b)[: 4 * top_terms] if self.known[i]][:top_terms]
            score = b[top] @ self.spoken[top] / max(b[top].sum(), 1e-12) if top else np.zeros(len(self.subjects) + 1)
            if score[(k := int(score[:-1].argmax()))] >= clear:
                found.setdefault(self.subjects[k], []).append(t)
        return found


def _shares(counted: DataFrame, total: int, spread: Spread, topics: int, iterations: int, batch: float, top_terms: int, clear: float, seed: int) -> DataFrame:
    """Document, subject and share, by one topic model over the documents of a group, of which `counted` holds the term counts."""
    model = LDA(k=max(2, min(topics, total)), maxIter=iterations, optimizer="online", subsamplingRate=batch, learningOffset=8.0, learningDecay=0.6, docConcentration=[0.05],
                topicConcentration=0.02, optimizeDocConcentration=False, featuresCol="counts", topicDistributionCol="theta", seed=seed).fit(counted)
    of_subject = spread.of_topics(model.topicsMatrix().toArray().T, top_terms, clear)
    theta = model.transform(counted).select("doc", vector_to_array("theta").alias("theta"))
    shares = [F.struct(F.lit(s).alias("subject"), sum((F.col("theta")[t] for t in ts), F.lit(0.0)).alias("share")) for s, ts in sorted(of_subject.items())]
    shares = shares or [F.struct(F.lit("").alias("subject"), F.lit(0.0).alias("share"))]
    return theta.select("doc", F.explode(F.array(*shares)).alias("s")).select("doc", "s.subject", "s.share").where(F.col("share") >= LEAST)


def assign(documents: DataFrame, subjects: DataFrame, labels: DataFrame, topics: int = 28, rare: float = 1e-3, frequent: float = 0.2, iterations: int = 20,
           batch: float = 0.15, sample: int = 5000, top_terms: int = 12, clear: float = 0.4, share: float | None = None, seed: int = 11,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, subject and `share` of each subject that a document is about; documents of none have no row.

    One model is fitted for each language with at least 2 * `topics` documents, and a shared one on the documents of all
    other languages and of none, so that every document gets its topic proportions. Each of the `iterations` steps sees
    the part `batch` of the documents, so that all steps together see each document several times, at every size; the
    shared group, which is small, is read whole in each.
    Terms must stand in the part `rare` of a group's documents (in the shared group, in one), which bounds their number
    by that of the terms in a document; terms in more than the part `frequent` are left out unless the labelled documents
    say that they speak for one subject. At most `sample` labelled documents (those with the smallest keys' hashes) are
    read to map topics and, unless `share` is given, to set the least share. Null and empty texts get no subject; a key
    that occurs more than once gets the subjects of each of its texts. An empty table gives an empty table. Extra columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length(F.trim(text)) > 0))
    told_by = over_tasks(docs, "doc").select("doc", told_words("text").alias("said"))
    tokens = told_by.select("doc", F.col("said.lang").alias("lang"), F.filter(F.split("said.words", " "), lambda w: w != "").alias("terms")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["lang"]: (r["docs"], r["terms"]) for r in tokens.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size("terms")).alias("terms")).collect()}
    small = [lang for lang, (n, _) in sizes.items() if lang is None or n < 2 * topics]
    totals = {lang: n for lang, (n, _) in sizes.items() if lang not in small}
    if any(sizes[lang][1] for lang in small):
        totals[""] = sum(sizes[lang][0] for lang in small)
    empty = spark.createDataFrame([], documents.select(F.col(key), F.lit("").alias("subject"), F.lit(0.0).alias("share")).schema)
    if not totals:
        return empty
    tokens = tokens.withColumn("group", F.when(F.col("lang").isin([x for x in totals if x]), F.col("lang")).otherwise("")).drop("lang")

    least = F.coalesce(*[F.when(F.col("group") == g, 1.0 if not g else max(2.0, n * rare)) for g, n in totals.items()])
    seen = tokens.select("group", F.explode(F.array_distinct("terms")).alias("term")).groupBy("group", "term").count().where(F.col("count") >= least).persist(StorageLevel.MEMORY_AND_DISK)
    told = labels.select(F.col(key).alias("doc"), "subject").where(F.col("subject").isNotNull()).distinct()
    few = told.select("doc").distinct().orderBy(F.xxhash64("doc"), "doc").limit(sample)
    told = told.join(F.broadcast(few), "doc").persist(StorageLevel.MEMORY_AND_DISK)  # at most `sample` documents, here and in every join with `told`
    described = {r["subject"]: r["description"] for r in subjects.select("subject", "description").distinct().collect() if r["subject"]}
    votes: dict[str, dict[str, dict[str, float]]] = {g: {} for g in totals}
    for r in term_votes(tokens, told, seen).collect():  # at most the terms of `sample` documents
        votes[r["group"]].setdefault(r["term"], {})[r["subject"]] = r["votes"]
    size: dict[str, dict[str, float]] = {g: {} for g in totals}
    weight = told.groupBy("doc").agg(F.count("*").alias("n"))
    for r in tokens.select("doc", "group").join(F.broadcast(told.join(weight, "doc")), "doc").groupBy("group", "subject").agg(F.sum(1 / F.col("n")).alias("n")).collect():
        size[r["group"]][r["subject"]] = r["n"]
    counts: dict[str, list[tuple[str, int]]] = {g: [] for g in totals}
    for r in seen.orderBy(F.desc("count"), "term").collect():  # at most (terms in a document) / `rare` for each language
        counts[r["group"]].append((r["term"], r["count"]))

    def prepared(g: str) -> tuple[DataFrame, Spread] | None:
        terms = [t for t, _ in counts[g]]
        if not terms:
            return None
        spread = Spread(terms, votes[g], size[g], described)
        if g:
            kept = [i for i, (_, n) in enumerate(counts[g]) if n <= frequent * totals[g] or spread.spoken[i, :-1].max(initial=0) >= clear]
            terms = [terms[i] for i in kept]
            spread.known, spread.spoken = spread.known[kept], spread.spoken[kept]
        model = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="counts")
        return model.transform(tokens.where(F.col("group") == g)).select("doc", "counts").persist(StorageLevel.MEMORY_AND_DISK), spread

    ready = {g: p for g in totals if (p := prepared(g))}
    if not ready:
        return empty
    with ThreadPoolExecutor(2) as pool:  # the steps of one model leave cores idle
        parts = [*pool.map(lambda g: _shares(ready[g][0], totals[g], ready[g][1], topics, iterations, batch if g else 1.0, top_terms, clear, seed), ready)]
    spread = reduce(DataFrame.unionByName, parts).persist(StorageLevel.MEMORY_AND_DISK)
    if share is None:
        share = least_share(spread, told)
    else:
        spread.count()
    for df in (*(c for c, _ in ready.values()), seen, told, tokens):
        df.unpersist()
    return spread.where(F.col("share") >= share).groupBy(F.col("doc").alias(key), "subject").agg(F.max("share").alias("share"))


def least_share(spread: DataFrame, told: DataFrame) -> float:
    """The share from which on a subject best agrees with the labelled documents (F1 over steps of 0.02)."""
    rows = spread.join(F.broadcast(told.select("doc").distinct()), "doc").join(F.broadcast(told.withColumn("yes", F.lit(1))), ["doc", "subject"], "left").select("share", "yes").toPandas()
    positives = told.where(F.col("subject") != NONE).count()
    best, at = -1.0, 0.25
    for cut in np.arange(0.06, 0.61, 0.02):
        got = rows[rows["share"] >= cut]
        hit = got["yes"].notna().sum()
        f1 = 2 * hit / max(1, len(got) + positives)
        if f1 > best:
            best, at = f1, float(cut)
    return at
