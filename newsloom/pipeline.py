"""A run from raw tables to packages.

``preprocess``: validate, build articles, entities, events, masters and the
later assignment, and export the train and validation packages.  ``sequences``:
once the semantic codes of the articles are there, build the user sequences and
export their package.  ``compare``: two runs side by side.

Each table is written to ``<output>/tables`` and read from there by what follows;
intermediate tables are removed at the end of a stage.  Broken masters, codes,
keys and sequences stop a run with an error before anything is exported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import catalog as C
from newsloom.operators import compare as X
from newsloom.operators import entities as E
from newsloom.operators import events as V
from newsloom.operators import export
from newsloom.operators import quality as Q
from newsloom.operators import sequences as S
from newsloom.operators.vectors import require_vectors
from newsloom.runtime import Scratch
from newsloom.sources import load
from newsloom.sources.records import PipelineConfig, write_report, write_text

#: Columns that the raw tables must have.
REQUIRED = {
    "articles": ["article_id", "title", "subtitle", "ner_clusters", "entity_groups", "published_time", "category", "category_str"],
    "behaviors": ["impression_id", "user_id", "impression_time", "article_id", "article_ids_clicked", "article_ids_inview"],
    "history": ["user_id", "impression_time_fixed", "article_id_fixed", "scroll_percentage_fixed", "read_time_fixed"],
}


class Stopped(RuntimeError):
    """The raw tables can't be used."""


class Run:
    """Raw tables of a run, its splits, and where its tables stand."""

    def __init__(self, spark: SparkSession, config: PipelineConfig):
        self.spark, self.config = spark, config
        self.raw = {t: Q.ensure_columns(load(spark, config.data, t), config.required.get(t, cols), t) for t, cols in REQUIRED.items()}

    def behaviors(self, split: str) -> DataFrame:
        late = F.coalesce(F.col("impression_time") >= F.lit(self.config.split_time).cast("timestamp_ntz"), F.lit(False))
        return self.raw["behaviors"].where(late if split == "validation" else ~late)

    def path(self, name: str) -> str:
        return f"{self.config.output}/tables/{name}.parquet"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def validation_report(run: Run) -> dict:
    """Status and counts of every check of the raw tables; FAIL if one fails, else WARNING if one warns."""
    parts: dict[str, dict] = {"articles": Q.article_validation(run.raw["articles"]).first().asDict()}
    h = Q.history_validation(run.raw["history"])
    parts["history"] = h.withColumn("status", Q.status(F.col("usable_rows") == 0, F.col("excluded_rows") + F.col("null_element_rows") + F.col("reorder_rows") > 0)).first().asDict()
    known = run.raw["articles"]
    for split in ("train", "validation"):
        b = run.behaviors(split)
        checked = Q.behavior_validation(b, split).withColumn("status", Q.status(F.col("usable_rows") == 0, F.col("excluded_rows") > 0))
        parts[f"behaviors_{split}"] = checked.first().asDict()
        lost = {r["kind"]: r.asDict() for r in Q.missing_references(Q.references(b, run.raw["history"]), known).collect()}
        parts[f"references_{split}"] = {"status": "WARNING" if lost else "PASS", **lost}
    states = [p["status"] for p in parts.values()]
    overall = "FAIL" if "FAIL" in states else "WARNING" if "WARNING" in states else "PASS"
    return {"overall_status": overall, **parts}


def summary_text(report: dict) -> str:
    """A report as text, one check a paragraph."""
    out = [f"overall status: {report['overall_status']}"]
    for name, part in report.items():
        if isinstance(part, dict):
            out += ["", f"{name}: {part.get('status', '')}", *(f"  {k}: {v}" for k, v in part.items() if k != "status")]
    return "\n".join(out) + "\n"


def validate(spark: SparkSession, config: PipelineConfig) -> dict:
    """The report, as JSON and text under ``<output>/reports``; ``Stopped`` if it fails and the run is to stop then."""
    run = Run(spark, config)
    report = validation_report(run)
    write_report(spark, report, f"{config.output}/reports/raw_validation_report.json")
    write_text(spark, summary_text(report), f"{config.output}/reports/raw_validation_report.txt")
    if report["overall_status"] == "FAIL" and config.stop_on_fail:
        raise Stopped("the raw tables fail their checks; see reports/raw_validation_report.txt")
    return report


def build_articles(run: Run, s: Scratch) -> None:
    """Valid articles, the ids each split uses, categories and the texts to embed."""
    va = run.write("valid_articles", C.valid_articles(run.raw["articles"]))
    ids = va.select("article_id")
    used = run.write("train_used_ids", C.used_ids(run.behaviors("train"), run.raw["history"], False).join(ids, "article_id", "left_semi").orderBy("article_id"))
    later = run.write("validation_used_ids", C.used_ids(run.behaviors("validation"), run.raw["history"], True).join(ids, "article_id", "left_semi").orderBy("article_id"))
    run.write("validation_only_ids", later.join(used, "article_id", "left_anti").orderBy("article_id"))
    mapping = run.write("category_mapping", C.category_mapping(va.join(used, "article_id", "left_semi")))
    run.write("articles_with_category", C.with_category(va, mapping))
    run.write("embedding_input", C.embedding_input(va, s))


def build_entities(run: Run, s: Scratch) -> None:
    m = s.keep(E.mentions(run.read("valid_articles"), run.read("train_used_ids")))
    run.write("article_entities", E.article_entities(m, run.config.entity_mode, run.config.entity_version))


def build_events(run: Run, s: Scratch) -> None:
    """Train events, the assignment of later articles, and both masters."""
    c, va = run.config, run.read("valid_articles").select("article_id", "published_time")
    train = s.keep(va.join(run.read("train_used_ids"), "article_id", "left_semi"))
    sets = s.keep(E.entity_sets(run.read("article_entities")))
    out = V.cluster_events(train, sets, s, c.similarity, c.window_hours, c.high_df_ratio)
    idf, events = run.write("entity_idf", out["idf"]), run.write("article_events", out["article_events"])
    master = run.write("event_master", out["event_master"])
    late = s.keep(va.join(run.read("validation_only_ids"), "article_id", "left_semi"))
    assigned = run.write("validation_assignment", V.assign_events(late, sets, idf, master, train.count(), s, c.similarity, c.window_hours))
    run.write("validation_article_events", assigned.select("article_id", "event_id", F.lit("validation").alias("assignment_split"), "published_time"))
    run.write("events_with_validation", V.extended_master(master, assigned))
    categorised, rows = run.read("articles_with_category"), run.read("embedding_input").select("article_id", "embedding_row")
    n = rows.count()
    for name, ids, of in (("article_master", train, events), ("validation_article_master", late, assigned)):
        run.write(name, C.require_master(s.keep(C.article_master(ids.select("article_id"), categorised, rows, of)), n, name))


def preprocess(spark: SparkSession, config: PipelineConfig) -> dict:
    """Everything up to the packages that the codes of articles are learned from."""
    status = validate(spark, config)["overall_status"]
    run = Run(spark, config)
    with Scratch(spark, "preprocess") as s:
        build_articles(run, s)
        build_entities(run, s)
        build_events(run, s)
    return {"status": status, "packages": {name: export_one(run, name) for name in ("train", "validation")}}


PACKAGES: dict[str, list[str]] = {
    "train": ["article_master", "category_mapping", "article_events", "event_master", "embedding_input"],
    "validation": ["validation_article_master", "validation_article_events", "events_with_validation"],
    "transformer": ["train_sequences", "validation_sequences"],
}
KEYS = {
    "article_master": "article_id", "validation_article_master": "article_id", "category_mapping": "category_str", "article_events": "article_id", "validation_article_events": "article_id",
    "event_master": "event_id", "events_with_validation": "event_id", "embedding_input": "article_id", "train_sequences": "impression_id", "validation_sequences": "impression_id",
}


def check_package(name: str, t: dict[str, DataFrame]) -> None:
    """What the tables of a package must agree on; ``ValueError`` if they don't."""
    if name == "transformer":
        for split in ("train", "validation"):
            S.require_integrity(t[f"{split}_sequences"], split == "validation")
        return
    master, events, of = ("article_master", "event_master", "article_events") if name == "train" else ("validation_article_master", "events_with_validation", "validation_article_events")
    for child, key, parent in ((master, "event_id", events), (of, "event_id", events), (of, "article_id", master)):
        lost = export.dangling(t[child], key, t[parent], key).count()
        if lost:
            raise ValueError(f"{lost} rows of {child}.{key} aren't in {parent}")


def export_one(run: Run, name: str) -> list[dict]:
    """Checks a package and writes it to ``<output>/packages/<name>`` with its manifest."""
    tables = {t: run.read(t) for t in PACKAGES[name]}
    if name == "train" and run.config.embeddings:  # one vector for each row of the embedding input, made elsewhere
        vectors = run.spark.read.parquet(run.config.embeddings)
        tables["embeddings"] = require_vectors(vectors, "embedding_row", "embedding", run.config.embedding_width, tables["embedding_input"].count())
    check_package(name, tables)
    manifest = export.export_package(tables, f"{run.config.output}/packages/{name}", {t: KEYS[t] for t in tables if t in KEYS})
    return [r.asDict() for r in manifest.orderBy("table_name").collect()]  # one row a table


def sequences(spark: SparkSession, config: PipelineConfig) -> dict:
    """User sequences of both splits from the codes in ``semantic_ids``, their counters, and their package."""
    run = Run(spark, config)
    sid = S.semantic_ids(spark.read.parquet(config.semantic_ids or f"{config.data}/article_semantic_ids.parquet"))
    counters = {}
    with Scratch(spark, "sequences") as s:
        for split in ("train", "validation"):
            late = split == "validation"
            run.write(f"{split}_sequences", S.sequences(run.behaviors(split), run.raw["history"], sid, late))
            rows = S.sequence_counters(run.behaviors(split), run.raw["history"], sid, s, late).collect()  # one row a counter
            counters[split] = {r["counter"]: r["value"] for r in rows}
    write_report(spark, counters, f"{config.output}/reports/sequence_counters.json")
    return {"counters": counters, "packages": {"transformer": export_one(run, "transformer")}}


def everything(spark: SparkSession, config: PipelineConfig) -> dict:
    first, then = preprocess(spark, config), sequences(spark, config)
    return {"status": first["status"], "counters": then["counters"], "packages": first["packages"] | then["packages"]}


def compare(spark: SparkSession, left: str, right: str, to: str) -> dict:
    """Two runs' clusterings: vocabulary, pairs, merged and split events as tables under ``to``, and the metrics as a report."""
    at = lambda folder, name: spark.read.parquet(f"{folder}/tables/{name}.parquet")
    l, r = at(left, "article_events"), at(right, "article_events")
    X.require_same_articles(l, r)
    tables = {"idf_diff": X.idf_diff(at(left, "entity_idf"), at(right, "entity_idf")), "pair_diff": X.pair_diff(l, r), "merges_and_splits": X.merges_and_splits(l, r), "metrics": X.metric_table(X.size_summary(l), X.size_summary(r))}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/{name}.parquet")
    metrics = {m["metric"]: {"left": m["left_value"], "right": m["right_value"], "delta": m["delta"]} for m in spark.read.parquet(f"{to}/metrics.parquet").collect()}  # one row a metric
    pairs = X.pair_counts(l, r).first().asDict()
    write_report(spark, {"metrics": metrics, "pairs": pairs}, f"{to}/summary.json")
    write_text(spark, "\n".join([*(f"{k}: {v['left']:g} -> {v['right']:g} ({v['delta']:+g})" for k, v in sorted(metrics.items())), *(f"{k}: {v}" for k, v in pairs.items())]) + "\n", f"{to}/summary.txt")
    return {"metrics": metrics, "pairs": pairs}


STAGES: dict[str, Callable[[SparkSession, PipelineConfig], dict]] = {"validate": validate, "preprocess": preprocess, "sequences": sequences, "all": everything}
