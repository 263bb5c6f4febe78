"""Weighted multinomial logistic regression over TF-IDF terms, trained and applied at scale."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.functions.labels import clip
from posttide.ml import features as ft
from posttide.ml.ranks import with_position
from posttide.operators import corpus as co
from posttide.session import lookup_side, working_folder, written
from posttide.sinks import paths

ARTIFACT_VERSION = 2
FOLD_SEED = 42
MAX_FOLDS = 5
MIN_ROWS_FOR_FOLDS = 6
PARALLEL_FITS = 10

# Solver tolerance, of the folds' models and the final one alike.
TOLERANCE = 1e-4

# Terms that a model may have: each has coefficients of its own, which the solver keeps on the
# driver. Beyond it training is refused; fewer labelled rows bring fewer terms.
MAX_FEATURES = 1 << 24


@dataclass(frozen=True)
class Candidate:
    """One feature set and its regularization."""

    name: str
    blocks: tuple[str, ...]
    c: float
    max_iter: int


# The two feature sets tried, in order of preference on equal scores.
CANDIDATES = (
    Candidate("word_bigram_logreg", (ft.WORD_BLOCK,), 2.0, 2000),
    Candidate("word_char_logreg", (ft.WORD_BLOCK, ft.CHAR_BLOCK), 4.0, 2500),
)
DEFAULT_CANDIDATE = "word_char_logreg"


_METRICS = "candidate string, folds int, macro_f1 double, accuracy double"


# Metrics


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def fold_metrics(
    rows: DataFrame, truth: str = "label", predicted: str = "predicted", by: list[str] | None = None
) -> DataFrame:
    """``macro_f1`` and ``accuracy`` per group; unweighted rows.

    Labels are those seen in truth or prediction. All but the first step works on
    a handful of confusion counts.
    """
    by = by or []
    counts = confusion(rows, truth, predicted, by)
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), hit.alias("tp"), (F.col("n") * 1).alias("size")),
        F.struct(F.col("predicted").alias("label"), none.alias("tp"), (F.col("n") * 1).alias("size")),
    )
    per_label = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("size").alias("size"))
    )
    # 2*tp / (true + predicted); every label seen has a non-zero denominator.
    return per_label.groupBy(*by).agg(
        F.avg(2.0 * F.col("tp") / F.col("size")).alias("macro_f1"),
        (F.sum("tp") * 2.0 / F.sum("size")).alias("accuracy"),
    )


def stratified_folds(
    rows: DataFrame, label: str, spread: list[str], folds: int, n_labels: int
) -> DataFrame:
    """Add ``fold``: within each label, fold sizes differ by at most one."""
    order = [F.xxhash64(F.lit(FOLD_SEED), *spread), *[F.col(c) for c in spread]]
    placed = with_position(rows, [label], order, spread, "_position", n_labels)
    return placed.withColumn("fold", (F.col("_position") % folds).cast("int")).drop("_position")


def candidate_metrics(predictions: DataFrame) -> DataFrame:
    """Mean scores over folds: ``candidate, folds, macro_f1, accuracy``.

    ``predictions`` has ``candidate, fold, label, predicted``, one row for each text of each fold
    that a candidate was tried on. Beyond the first count there are a few rows a fold.
    """
    per_fold = fold_metrics(predictions, by=["candidate", "fold"])
    return per_fold.groupBy("candidate").agg(
        F.count(F.lit(1)).cast("int").alias("folds"),
        F.avg("macro_f1").alias("macro_f1"),
        F.avg("accuracy").alias("accuracy"),
    )


def ranked_candidates(metrics: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Candidates with their ``rank``: highest macro F1, then accuracy, then the order given.

    One without scores ranks behind those that have some.
    """
    names = [c.name for c in CANDIDATES] if order is None else order
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("candidate"))
    by = W.orderBy(F.desc_nulls_last("macro_f1"), F.desc_nulls_last("accuracy"), place, "candidate")
    return metrics.withColumn("rank", F.row_number().over(by))  # a handful of rows


def selected_candidate(metrics: DataFrame, order: list[str] | None = None) -> str:
    """The first of the ranked candidates; without scores the default."""
    best = ranked_candidates(metrics.filter("macro_f1 IS NOT NULL"), order).filter("rank = 1").first()
    return best["candidate"] if best else DEFAULT_CANDIDATE


# Fitting

# The training set that holds every text, next to those that leave one fold out.
ALL_TEXTS = -1


def _length(block: str) -> Column:
    w = F.when(F.col("block") == block, F.col("w"))
    return F.sqrt(F.sum(w * w))


def _set_vectors(place: int, size: int) -> list[Column]:
    """The stored sparse vectors of each candidate under the idfs at ``place``, made in the row.

    ``_entries`` are (index, block, tf, idfs); each block is divided by its own length.
    """
    kept = F.filter("_entries", lambda e: F.get(e["idfs"], F.lit(place)).isNotNull())
    weighted = F.transform(
        kept,
        lambda e: F.struct(
            e["index"].alias("index"),
            e["block"].alias("block"),
            (ft.damped(e["tf"]) * F.get(e["idfs"], F.lit(place))).alias("w"),
        ),
    )

    def length(entries: Column, block: str) -> Column:
        squares = F.transform(F.filter(entries, lambda e: e["block"] == block), lambda e: e["w"] * e["w"])
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))

    def vector(entries: Column, blocks: tuple[str, ...]) -> Column:
        mine = F.filter(entries, lambda e: e["block"].isin(*blocks))
        return F.struct(
            F.lit(0).cast("byte").alias("type"),
            F.lit(size).alias("size"),
            F.transform(mine, lambda e: e["index"]).alias("indices"),
            F.transform(mine, lambda e: e["w"]).alias("values"),
        )

    # Divided once and shared by the candidates.
    lengths = {b: length(weighted, b) for b in (ft.WORD_BLOCK, ft.CHAR_BLOCK)}
    unit = F.transform(
        weighted,
        lambda e: F.struct(
            e["index"].alias("index"),
            e["block"].alias("block"),
            (e["w"] / F.when(e["block"] == ft.WORD_BLOCK, lengths[ft.WORD_BLOCK]).otherwise(lengths[ft.CHAR_BLOCK])).alias("w"),
        ),
    )
    return [vector(unit, c.blocks).alias(c.name) for c in CANDIDATES]


@dataclass(frozen=True)
class TrainingSets:
    """Sizes per (left-out fold, label), from which weights and penalties follow."""

    labels: list[str]
    folds: list[int]
    sizes: dict[tuple[int, str], tuple[int, float]]

    def without(self, fold: int, label: str) -> tuple[int, float]:
        kept = [v for (f, x), v in self.sizes.items() if f != fold and x == label]
        return sum(n for n, _ in kept), sum(w for _, w in kept)

    def rows(self, fold: int) -> int:
        return sum(self.without(fold, label)[0] for label in self.labels)

    def balance(self, fold: int, label: str) -> float:
        """Class weight that makes all labels count the same."""
        n, _ = self.without(fold, label)
        return self.rows(fold) / (len(self.labels) * n) if n else 0.0

    def total_weight(self, fold: int) -> float:
        return sum(self.balance(fold, x) * self.without(fold, x)[1] for x in self.labels)


def _weight_in(sets: TrainingSets) -> Column:
    """Row weight in the training set of column ``left_out``."""
    factor = F.lit(0.0)
    for fold in sets.folds:
        for label in sets.labels:
            here = (F.col("left_out") == fold) & (F.col("label") == label)
            factor = F.when(here, F.lit(sets.balance(fold, label))).otherwise(factor)
    return F.col("weight") * factor


def write_vectors(
    counts: DataFrame, terms: DataFrame, size: int, n_terms: int, sets: TrainingSets
) -> str:
    """Vectors of all texts under the vocabulary of every training set, in one job.

    Folder ``left_out=<f>`` holds all texts with the weights learned without fold ``f``. A term
    carries its idf in each training set as an array; the terms of a text are gathered once, and all
    its vectors are made from them in the row. The structs are read back as ML vectors, so no
    feature work is repeated by solver iterations and vectors never pass through Python.
    """
    weights = []
    for fold in sets.folds:
        n = sets.rows(fold)
        df = F.col("df") if fold == ALL_TEXTS else F.col("df") - F.col(f"_df_{fold}")
        weights.append(F.when(ft.kept_term(F.col("block"), df, n), ft.idf(df, n)))
    known = terms.select("block", "term", "df", "index", F.array(*weights).alias("idfs"))
    keys = ["doc_key", "label", "fold", "weight"]
    entry = F.struct("index", "block", "tf", "idfs")
    found = ft.with_terms(counts, known, n_terms, counts.count()).select(*keys, entry.alias("_entry"))
    # The row without a term keeps texts that have none.
    marked = counts.filter(F.col("term").isNull()).select(*keys, F.lit(None).cast(found.schema["_entry"].dataType).alias("_entry"))
    texts = found.unionByName(marked).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_entry"), lambda a, b: a["index"] - b["index"]).alias("_entries")
    )
    ways = [
        F.struct(F.lit(fold).alias("left_out"), *_set_vectors(i, size)) for i, fold in enumerate(sets.folds)
    ]
    vectors = texts.select(
        *keys, F.inline(F.array(*ways)),
    ).select(
        "left_out",
        (F.col("fold") == F.col("left_out")).alias("held_out"),
        "label",
        (F.array_position(F.array(*[F.lit(x) for x in sets.labels]), F.col("label")) - 1)
        .cast("double")
        .alias("target"),
        _weight_in(sets).alias("weight"),
        *[c.name for c in CANDIDATES],
    )
    path = working_folder(counts.sparkSession, "vectors")
    vectors.write.partitionBy("left_out").parquet(path)
    return path


def _read_vectors(spark: SparkSession, path: str, fold: int, cand: Candidate) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("held_out", T.BooleanType()),
            T.StructField("label", T.StringType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField(cand.name, VectorUDT()),
        ]
    )
    return spark.read.schema(schema).parquet(f"{path}/left_out={fold}")


def _fit(spark: SparkSession, path: str, fold: int, cand: Candidate, sets: TrainingSets):
    """Minimize ``C * sum(weight * loss) + |coefficients|^2 / 2`` on one training set."""
    rows = _read_vectors(spark, path, fold, cand).filter(~F.col("held_out"))
    return LogisticRegression(
        featuresCol=cand.name,
        labelCol="target",
        weightCol="weight",
        regParam=1.0 / (cand.c * sets.total_weight(fold)),
        standardization=False,
        maxIter=cand.max_iter,
        tol=TOLERANCE,
        family="multinomial" if len(sets.labels) > 2 else "binomial",
    ).fit(rows)


@dataclass
class Fitted:
    """Coefficients per term (``block, term, idf, coefficients``) and per-label intercepts."""

    terms: DataFrame
    labels: list[str]
    intercepts: list[float]


def _fitted(spark: SparkSession, model, terms: DataFrame, sets: TrainingSets, size: int) -> Fitted:
    """Put the solver's numbers next to the terms and write them to the shared folder."""
    labels = sets.labels
    if len(labels) > 2:
        rows_of = model.coefficientMatrix.toArray()
        intercepts = [float(x) for x in model.interceptVector.toArray()]
    else:
        one = model.coefficients.toArray()
        rows_of = [one * 0.0, one]
        intercepts = [0.0, float(model.intercept)]
    # One row per coefficient column; the solver holds the same numbers on the driver.
    table = pd.DataFrame({f"c{i}": values for i, values in enumerate(rows_of)})
    table["index"] = range(len(table))
    coefficients = spark.createDataFrame(table).select(
        F.col("index").cast("int"),
        F.array(*[f"c{i}" for i in range(len(labels))]).alias("coefficients"),
    )
    n = sets.rows(ALL_TEXTS)
    used = terms.filter(ft.kept_term(F.col("block"), F.col("df"), n)).select(
        "block", "term", "index", "df", ft.idf(F.col("df"), n).alias("idf")
    )
    path = working_folder(spark, "model")
    used.join(lookup_side(coefficients, size), "index").write.parquet(path)
    return Fitted(spark.read.parquet(path), labels, intercepts)


def score_counts(counts: DataFrame, fitted: Fitted, keys: list[str]) -> DataFrame:
    """Label probabilities of every text: ``keys, probabilities`` in label order.

    The scores are sums over terms, so they come out of one aggregate per text;
    no vectors are built. Terms the model does not know add nothing.
    """
    model = fitted.terms.select("block", "term", "idf", "coefficients")
    joined = counts.join(lookup_side(model), ["block", "term"], "left")
    joined = joined.withColumn("w", ft.raw_weight())
    blocks = (ft.WORD_BLOCK, ft.CHAR_BLOCK)
    sums = joined.groupBy(*keys).agg(
        *[_length(block).alias(f"_length_{block}") for block in blocks],
        *[
            F.sum(
                F.when(F.col("block") == block, F.col("w") * F.get("coefficients", F.lit(i)))
            ).alias(f"_{block}_{i}")
            for block in blocks
            for i in range(len(fitted.labels))
        ],
    )

    def margin(i: int) -> Column:
        parts = [
            F.coalesce(F.try_divide(F.col(f"_{b}_{i}"), F.col(f"_length_{b}")), F.lit(0.0))
            for b in blocks
        ]
        return sum(parts, F.lit(fitted.intercepts[i]))

    scored = sums.select(
        *keys, F.array(*[margin(i) for i in range(len(fitted.labels))]).alias("_margins")
    )
    top = F.array_max("_margins")
    powers = scored.select(*keys, F.transform("_margins", lambda m: F.exp(m - top)).alias("_powers"))
    total = F.aggregate("_powers", F.lit(0.0), lambda a, x: a + x)
    return powers.select(*keys, F.transform("_powers", lambda p: p / total).alias("probabilities"))


def predicted_label(probabilities: Column, labels: list[str]) -> Column:
    """Most probable label; the first one wins a tie."""
    place = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(label) for label in labels]), place)


def signed_score(probabilities: Column, labels: list[str]) -> Column:
    """P(positive) - P(negative), within [-1, 1]."""

    def of(label: str) -> Column:
        return F.get(probabilities, F.lit(labels.index(label))) if label in labels else F.lit(0.0)

    return clip(of("positive") - of("negative"), -1.0, 1.0)


@dataclass
class SentimentClassifier:
    """A trained model and what is known about its training."""

    fitted: Fitted
    metadata: dict = field(default_factory=dict)
    sources: DataFrame | None = None

    def predict(self, texts: DataFrame, keys: list[str], text: str = "cleaned_text") -> DataFrame:
        """``keys, label, score, confidence, probabilities`` of every text.

        ``keys[0]`` identifies a text.
        """
        labels = self.fitted.labels
        marked = texts.withColumn("_empty", F.coalesce(F.col(text) == "", F.lit(True)))
        carried = [*keys, "_empty"]
        counts = ft.term_counts(marked, carried, text)
        scored = score_counts(counts, self.fitted, carried)
        p = F.col("probabilities")
        empty = F.col("_empty")
        return scored.select(
            *keys,
            F.when(empty, F.lit("neutral")).otherwise(predicted_label(p, labels)).alias("label"),
            F.when(empty, F.lit(0.0)).otherwise(signed_score(p, labels)).alias("score"),
            F.when(empty, F.lit(1.0)).otherwise(F.array_max(p)).alias("confidence"),
            F.when(
                ~empty, F.map_from_arrays(F.array(*[F.lit(label) for label in labels]), p)
            ).alias("probabilities"),
        )

    def prediction_metadata(self) -> Column:
        """Probabilities and model facts as JSON; an empty object for empty text."""
        known = {
            k: str(self.metadata[k]) if k != "training_examples" else self.metadata[k]
            for k in ("selected_model", "trained_at", "training_examples")
            if k in self.metadata
        }
        parts = [F.col("probabilities")]
        if known:
            parts.append(F.struct(*[F.lit(v).alias(k) for k, v in known.items()]).alias("model"))
        return F.coalesce(
            F.when(F.col("probabilities").isNotNull(), F.to_json(F.struct(*parts))), F.lit("{}")
        )

    def save(self, path: str) -> str:
        """Write terms, intercepts, metadata and the relation of sources below ``path``."""
        spark = self.fitted.terms.sparkSession
        self.fitted.terms.write.mode("overwrite").parquet(f"{path}/terms")
        head = [(self.fitted.labels, self.fitted.intercepts)]
        spark.createDataFrame(head, "labels array<string>, intercepts array<double>").coalesce(
            1
        ).write.mode("overwrite").json(f"{path}/head")
        text = json.dumps(self.metadata, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/metadata")
        if self.sources is not None:
            self.sources.write.mode("overwrite").parquet(f"{path}/sources")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SentimentClassifier:
        """Read a saved model; one without metadata gets an empty one."""
        head = spark.read.schema("labels array<string>, intercepts array<double>").json(
            f"{path}/head"
        ).first()
        terms = spark.read.parquet(f"{path}/terms")
        metadata = load_metadata(spark, path)
        known = paths.exists(spark, f"{path}/sources")
        sources = spark.read.parquet(f"{path}/sources") if known else None
        return cls(Fitted(terms, list(head["labels"]), list(head["intercepts"])), metadata, sources)


def load_metadata(spark: SparkSession, path: str) -> dict:
    if not paths.exists(spark, f"{path}/metadata"):
        return {}
    row = spark.read.text(f"{path}/metadata").first()
    return json.loads(row["value"]) if row else {}


def candidate_scores(metadata: dict, spark: SparkSession) -> DataFrame:
    """Validation scores of the candidates a model was chosen from."""
    rows = [
        (m["candidate"], m["folds"], m["macro_f1"], m["accuracy"])
        for m in metadata.get("candidate_metrics", {}).values()
    ]
    return spark.createDataFrame(rows, _METRICS)


# Training


def _indexed_terms(counts: DataFrame, folds: int) -> tuple[DataFrame, int, int]:
    """``block, term, df, _df_<fold>.., index``, the number of terms and the vector size."""
    spark = counts.sparkSession
    base = working_folder(spark, "terms")
    per_fold = [F.count(F.when(F.col("fold") == f, 1)).alias(f"_df_{f}") for f in range(folds)]
    frequencies = (
        counts.filter(F.col("term").isNotNull())
        .groupBy("block", "term")
        .agg(F.count(F.lit(1)).alias("df"), *per_fold)
    )
    frequencies.write.parquet(f"{base}/counted")
    frequencies = spark.read.parquet(f"{base}/counted")
    n_terms = frequencies.count()
    if n_terms > MAX_FEATURES:
        raise ValueError(f"{n_terms} terms are more than the {MAX_FEATURES} a model may have")
    order = [F.col("block"), F.col("term")]
    placed = with_position(frequencies, [], order, ["block", "term"], "_position", 1)
    placed.withColumn("index", F.col("_position").cast("int")).drop("_position").write.parquet(
        f"{base}/indexed"
    )
    return spark.read.parquet(f"{base}/indexed"), n_terms, n_terms


def cross_validate(
    spark: SparkSession, path: str, sets: TrainingSets, folds: int
) -> DataFrame:
    """Mean scores per candidate. The fits are Spark jobs, of which a few run side by side; the
    predictions of all folds are one relation, scored by one query."""
    if folds < 2:
        rows = [(c.name, 0, None, None) for c in CANDIDATES]
        return spark.createDataFrame(rows, _METRICS)
    tasks = [(c, f) for c in CANDIDATES for f in range(folds)]

    def run(task):
        cand, fold = task
        model = _fit(spark, path, fold, cand, sets)
        held = _read_vectors(spark, path, fold, cand).filter("held_out")
        return model.transform(held).select(
            F.lit(cand.name).alias("candidate"), F.lit(fold).alias("fold"),
            F.col("target").alias("label"), F.col("prediction").alias("predicted"),
        )

    with ThreadPool(PARALLEL_FITS) as pool:
        predictions = pool.map(inheritable_thread_target(spark)(run), tasks)
    return written(candidate_metrics(reduce(DataFrame.unionByName, predictions)))


def _keyed(corpus: DataFrame) -> DataFrame:
    """Usable rows with a ``doc_key``; the caller writes them, which fixes the keys."""
    weight = F.col("sample_weight").try_cast("double")
    return corpus.dropna(subset=["text", "label", "sample_weight"]).select(
        F.monotonically_increasing_id().alias("doc_key"),
        F.col("text").cast("string"),
        F.col("label").cast("string"),
        F.coalesce(F.nanvl(weight, F.lit(None).cast("double")), F.lit(1.0)).alias("weight"),
    )


def train(corpus: DataFrame, extra_metadata: dict | None = None) -> SentimentClassifier:
    """Choose a candidate by cross-validation and refit it on all rows.

    ``corpus`` has ``text, label, sample_weight``; rows lacking one are dropped, an
    unreadable weight counts 1. More than ``MAX_FEATURES`` terms are an error.
    """
    spark = corpus.sparkSession
    base = working_folder(spark, "corpus")
    _keyed(corpus).write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    counted = {r["label"]: r["n"] for r in co.label_counts(rows).collect()}
    if len(counted) < 2:
        raise ValueError("at least two distinct labels are required for training")
    total, smallest = sum(counted.values()), min(counted.values())
    folds = min(MAX_FOLDS, smallest)
    if total < MIN_ROWS_FOR_FOLDS or smallest < 2:
        folds = 0
    if folds:
        placed = stratified_folds(rows, "label", ["doc_key"], folds, len(counted))
    else:
        placed = rows.withColumn("fold", F.lit(0))
    placed.write.parquet(f"{base}/placed")
    docs = spark.read.parquet(f"{base}/placed")
    sizes = docs.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")
    )
    sets = TrainingSets(
        sorted(counted),
        [ALL_TEXTS, *range(folds)],
        {(r["fold"], r["label"]): (r["n"], r["w"]) for r in sizes.collect()},
    )
    counts = ft.term_counts(docs, ["doc_key", "label", "fold", "weight"], "text").persist()
    terms, n_terms, size = _indexed_terms(counts, folds)
    vectors = write_vectors(counts, terms, size, n_terms, sets)
    counts.unpersist()
    metrics = cross_validate(spark, vectors, sets, folds)
    chosen = selected_candidate(metrics)
    cand = next(c for c in CANDIDATES if c.name == chosen)
    fitted = _fitted(spark, _fit(spark, vectors, ALL_TEXTS, cand, sets), terms, sets, size)
    weights = co.weight_summary(docs.withColumnRenamed("weight", "sample_weight")).first()
    metadata = {
        "artifact_version": ARTIFACT_VERSION,
        "trained_at": datetime.now(timezone.utc).isoformat(),
        "selected_model": chosen,
        "training_examples": total,
        "label_distribution": counted,
        "weight_summary": weights.asDict(),
        "candidate_metrics": {r["candidate"]: r.asDict() for r in metrics.collect()},
        **(extra_metadata or {}),
    }
    return SentimentClassifier(fitted, metadata)


def train_from_frame(corpus: DataFrame) -> SentimentClassifier:
    """Train on a merged corpus and record where its rows came from."""
    needed = {"text", "label", "sample_weight"}
    if not needed <= set(corpus.columns):
        raise ValueError(f"a training frame needs the columns {sorted(needed)}")
    complete = corpus.dropna(subset=sorted(needed))
    found = written(co.sources(complete))
    totals = co.provenance(complete, found).first()
    kinds = found.filter("what = 'source_kind'").select("name").collect()  # two at most
    model = train(
        corpus,
        {
            "deduplicated_examples": totals["deduplicated_examples"],
            "support_sum": totals["support_sum"],
            "source_path_count": totals["source_paths"],
            "source_kinds": sorted(r["name"] for r in kinds),
        },
    )
    model.sources = found
    return model
