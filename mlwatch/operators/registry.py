"""Model and experiment registry: keyed upserts, constraints, versions, lifecycle stages and their history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.functions.columns import backfill
from mlwatch.functions.json import metric
from mlwatch.operators.frames import attach, grouped, key_of, settled
from mlwatch.operators.order import DEPTH, sliced_scan

# Lifecycle stages and event notes.
STAGES = ("development", "staging", "production", "archived")
NOTE_INITIAL = "initial registration"
NOTE_MANUAL = "manual stage update"
NOTE_DEMOTED = "auto-demoted while promoting "

# The columns of a lineage listing.
LINEAGE_COLUMNS = (
    "model_id",
    "run_id",
    "dataset",
    "dataset_name",
    "model_type",
    "task",
    "stage",
    "version",
    "artifact_path",
    "params",
    "metrics",
    "experiment_id",
    "parent_model_id",
    "created_at",
)


# ---------------------------------------------------------------------------------------------------------------
# Keyed tables


def newest_first(df: DataFrame, order: Sequence[str], n: int, where: Column | None = None) -> DataFrame:
    """The ``n`` newest rows by the order columns, filtered before the limit is taken."""
    rows = df if where is None else df.where(where)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def check_limit(n: int, top: int = 1000) -> int:
    if not 1 <= n <= top:
        raise ValueError(f"limit must be between 1 and {top}")
    return n


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` newest rows of every group. Each task drops all but its own ``n`` rows per group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def upsert(
    current: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep_cols: Sequence[str] = (),
) -> DataFrame:
    """Insert rows with new keys and replace rows with known ones by their latest change.

    ``order`` decides between several changes of one key. ``keep_cols`` hold on to the value already in the table, unless
    that is null. The changes are reduced to one per key first and stored rows only meet their keys, so that a few changes,
    which Spark then broadcasts, leave the stored table where it is. Null keys are equal.
    """
    names = list(current.columns)
    fresh = top_per_group(changes, keys, order, 1).select(*names)
    touched = fresh.select(key_of(keys).alias("_key"))
    old = current.withColumn("_key", key_of(keys))
    if keep_cols:
        stored = old.join(touched, "_key", "left_semi").groupBy("_key").agg(*[F.first(c, True).alias(f"_keep_{c}") for c in keep_cols])
        fresh = fresh.withColumn("_key", key_of(keys)).join(stored, "_key", "left")
        fresh = fresh.withColumns({c: F.coalesce(f"_keep_{c}", c) for c in keep_cols}).select(*names)
    return old.join(touched, "_key", "left_anti").drop("_key").unionByName(fresh)


def insert_new(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the changes whose keys are not in the table yet, for each key the newest by ``order``. Null keys are equal."""
    first = top_per_group(changes, keys, order, 1).withColumn("_key", key_of(keys))
    known = current.select(key_of(keys).alias("_key"))
    return current.unionByName(first.join(known, "_key", "left_anti").select(*current.columns))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once. A key with a null part never conflicts."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole).groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose reference points nowhere; a null reference is not an orphan."""
    known = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(known, F.col(fk) == F.col("_pk"), "left_anti")


def fill_registry_gaps(models: DataFrame) -> DataFrame:
    """Nulls that have a known stand-in: dataset_name, created_at and experiment_id."""
    return backfill(
        models, {"dataset_name": ["dataset"], "created_at": ["registered_at"], "experiment_id": ["run_id"]}
    )


# ---------------------------------------------------------------------------------------------------------------
# Models


def register(
    models: DataFrame,
    new: DataFrame,
    order: Sequence[str] = ("created_at", "model_id"),
    depth: int = DEPTH,
) -> DataFrame:
    """``new`` with version and parent: each model follows the one registered before it for the same data set.

    The first new model of a data set follows its highest stored version. Values already given are kept. Stage is
    development, the note of a first registration.
    """
    stored = settled(
        models.groupBy("dataset").agg(
            F.max("version").alias("top"), F.max_by("model_id", F.struct("version", "created_at")).alias("top_id")
        )
    )
    seq = sliced_scan(
        new.drop("stage"),
        ["dataset"],
        list(order),
        last={"_prev": F.col("model_id")},
        rank="_nth",
        depth=depth,
    )
    seq = attach(seq, stored, ["dataset"])
    version = (F.coalesce(F.col("_s.top"), F.lit(0)) + F.col("_nth")).cast("int")
    parent = F.coalesce(F.col("_prev"), F.col("_s.top_id"))
    given = set(new.columns)
    return seq.withColumns(
        {
            "version": F.coalesce("version", version) if "version" in given else version,
            "parent_model_id": F.coalesce("parent_model_id", parent) if "parent_model_id" in given else parent,
            "stage": F.lit("development"),
        }
    ).drop("_s", "_prev", "_nth")


def save_models(models: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert registered models; a model that is already stored keeps its stage."""
    return upsert(models, new, ["model_id"], ["created_at"], keep_cols=["stage"])


def list_models(models: DataFrame, dataset: str | None = None, n: int = 100) -> DataFrame:
    where = None if dataset is None else F.col("dataset") == dataset
    return newest_first(models, ["created_at", "version", "model_id"], check_limit(n), where)


def latest_production(models: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """The newest production model of each data set, or over all of them with ``by=()``."""
    prod = models.where(F.col("stage") == "production")
    order = ["created_at", "version", "model_id"]
    return top_per_group(prod, by, order, 1) if by else newest_first(prod, order, 1)


def recent_production(models: DataFrame, n: int = 2, dataset: str | None = None) -> DataFrame:
    """The ``n`` newest production models per data set."""
    prod = models.where(F.col("stage") == "production")
    if dataset is not None:
        prod = prod.where(F.col("dataset") == dataset)
    return top_per_group(prod, ["dataset"], ["created_at", "version", "model_id"], n)


def model_lineage(models: DataFrame, dataset: str | None = None, n: int = 200) -> DataFrame:
    where = None if dataset is None else F.col("dataset") == dataset
    rows = newest_first(models, ["created_at", "version", "model_id"], check_limit(n), where)
    return rows.select(*[c for c in LINEAGE_COLUMNS if c in models.columns])


# ---------------------------------------------------------------------------------------------------------------
# Stages


def initial_events(models: DataFrame, events: DataFrame) -> DataFrame:
    """The registration event of every model that has no event yet."""
    new = models.join(events.select("model_id").distinct(), "model_id", "left_anti")
    return new.select(
        "model_id",
        "dataset",
        F.lit(None).cast("string").alias("from_stage"),
        F.lit("development").alias("to_stage"),
        F.col("created_at").alias("changed_at"),
        F.lit(NOTE_INITIAL).alias("note"),
    )


def apply_transitions(
    requests: DataFrame, order: Sequence[str] = ("changed_at", "event_id"), depth: int = DEPTH
) -> DataFrame:
    """The stage event log that a sequence of requests (dataset, model_id, to_stage) produces.

    Every model starts in development. A request for the stage a model already has changes nothing. Promoting a
    model to production moves the data set's production model, if it is another one, to staging. The log has ``ord``
    0 for such a demotion and 1 for the requested change itself.

    A promotion takes production away from the model promoted before it, unless that is the same model or it asked
    for another stage in between. So it is enough to know, for each promotion, the data set's next one, and for each
    request its model's previous and next: two scans, in which a data set of more than ``depth`` requests is cut at
    splitters of their order and is not one task, not even if all are of one second.
    """
    at = F.struct(*order)
    valid = requests.where(F.col("to_stage").isin(*STAGES)).select("dataset", "model_id", "to_stage", *order)
    promotion = F.col("to_stage") == "production"
    taker = F.struct(F.col("model_id").alias("model"), at.alias("at"))
    promoted = sliced_scan(valid.where(promotion), ["dataset"], order, following={"_next": taker}, depth=depth)
    rows = promoted.unionByName(valid.where(~promotion), allowMissingColumns=True)
    own = sliced_scan(
        rows,
        ["dataset", "model_id"],
        order,
        last={"_prev": F.struct("to_stage", "_next")},
        following={"_own": at},
        depth=depth,
    )
    other = F.col("_next.model") != F.col("model_id")
    loses = other & (F.col("_own").isNull() | (F.col("_next.at") < F.col("_own")))
    lost = (F.col("_prev._next.model") != F.col("model_id")) & (F.col("_prev._next.at") < at)
    old = F.when(F.col("_prev").isNull(), "development").when(lost, "staging").otherwise(F.col("_prev.to_stage"))

    def event(before: Column, after: Column, when: Column, ord_: int, note: Column) -> Column:
        times = [when.getField(c).alias(c) for c in order]
        return F.struct(
            before.alias("from_stage"), after.alias("to_stage"), *times, F.lit(ord_).alias("ord"), note.alias("note")
        )

    asked = event(old, F.col("to_stage"), at, 1, F.lit(NOTE_MANUAL))
    demoted = event(
        F.lit("production"),
        F.lit("staging"),
        F.col("_next.at"),
        0,
        F.concat(F.lit(NOTE_DEMOTED), F.col("_next.model").cast("string")),
    )
    events = F.array_compact(F.array(F.when(old != F.col("to_stage"), asked), F.when(loses, demoted)))
    return own.select("dataset", "model_id", F.inline(events))


def current_stage(log: DataFrame, order: Sequence[str] = ("changed_at", "event_id", "ord")) -> DataFrame:
    """The stage each model of the event log is in now."""
    return log.groupBy("dataset", "model_id").agg(F.max_by("to_stage", F.struct(*order)).alias("stage"))


def rollback_hint(log: DataFrame, order: Sequence[str] = ("changed_at", "event_id", "ord")) -> DataFrame:
    """Per data set: the production model now, and the one that held production before it.

    The history decides, because promotion leaves no more than one model in production at a time.
    """
    at = F.struct(*order)
    per_model = log.groupBy("dataset", "model_id").agg(
        F.max(F.when(F.col("to_stage") == "production", at)).alias("promoted"),
        F.max_by("to_stage", at).alias("stage"),
    )
    # Two rows per data set are enough: the models promoted last and before that.
    two = top_per_group(per_model.where(F.col("promoted").isNotNull()), ["dataset"], ["promoted"], 2)
    holds = F.col("stage") == "production"
    hint = two.groupBy("dataset").agg(
        F.max(F.when(holds, F.col("model_id"))).alias("current_production"),
        F.max_by(F.when(~holds, F.col("model_id")), F.when(~holds, F.col("promoted"))).alias("previous_production"),
    )
    return hint


def revert(log: DataFrame, dataset: str) -> DataFrame:
    """The request that promotes a data set's previous production model again; an error if there is none."""
    row = rollback_hint(log.where(F.col("dataset") == dataset)).select("previous_production").first()
    if row is None or row[0] is None:
        raise ValueError(f"nothing held production in {dataset!r} before its present model")
    spark = log.sparkSession
    return spark.range(1).select(
        F.lit(dataset).alias("dataset"), F.lit(row[0]).alias("model_id"), F.lit("production").alias("to_stage")
    )


def stage_timeline(
    events: DataFrame, model_id: str | None = None, n: int = 50, order: Sequence[str] = ("changed_at", "event_id")
) -> DataFrame:
    """The newest ``n`` stage events of a model, or of every model, newest first.

    Where the origin of a change was not recorded it is the target of the change before; one older row than asked
    for is read so that the last row shown has it too.
    """
    check_limit(n, 500)
    rows = events if model_id is None else events.where(F.col("model_id") == model_id)
    w = W.partitionBy("model_id").orderBy(*[F.desc(c) for c in order])
    near = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n + 1)
    older = F.lead("to_stage").over(w)
    known = F.col("from_stage") if "from_stage" in events.columns else F.lit(None).cast("string")
    out = near.withColumn("from_stage", F.coalesce(known, older)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", "position").orderBy("model_id", "position")


def audit_trail(models: DataFrame, events: DataFrame) -> DataFrame:
    """Every stage change with the name, version and data set of its model."""
    m = models.select("model_id", "name", "version", F.col("dataset").alias("_dataset"))
    joined = events.drop("dataset").join(m, "model_id")
    return joined.select(
        F.col("name").alias("model"),
        "version",
        F.col("_dataset").alias("dataset"),
        "from_stage",
        "to_stage",
        "changed_at",
        "note",
    )


def compliance(models: DataFrame, min_accuracy: float = 0.80, min_f1: float = 0.75) -> DataFrame:
    """Production models with accuracy, F1 and whether both reach their minimum; an absent metric counts as 0."""
    acc = F.coalesce(metric(F.col("metrics"), "accuracy"), F.lit(0.0))
    f1 = F.coalesce(metric(F.col("metrics"), "f1_score"), F.lit(0.0))
    ok = (F.col("accuracy") >= min_accuracy) & (F.col("f1_score") >= min_f1)
    return (
        models.where(F.col("stage") == "production")
        .select("model_id", "name", "version", "dataset", acc.alias("accuracy"), f1.alias("f1_score"))
        .withColumn("status", F.when(ok, "compliant").otherwise("non_compliant"))
    )


# ---------------------------------------------------------------------------------------------------------------
# Experiments


def save_experiments(experiments: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(experiments, new, ["run_id"], ["created_at"])


def list_experiments(experiments: DataFrame, n: int = 100) -> DataFrame:
    return newest_first(experiments, ["created_at", "run_id"], n)


def get_experiment(experiments: DataFrame, run_id: str) -> DataFrame:
    return experiments.where(F.col("run_id") == run_id)


def experiment_grid(experiments: DataFrame) -> DataFrame:
    """Flat view of the runs: named metrics out of JSON, rounded duration, default status."""
    return experiments.select(
        "run_id",
        "dataset",
        F.col("model_type").alias("algorithm"),
        metric(F.col("metrics"), "accuracy").alias("accuracy"),
        metric(F.col("metrics"), "f1_score").alias("f1_score"),
        F.round(F.coalesce(F.col("duration_seconds"), F.lit(0.0)), 2).alias("duration"),
        "created_at",
        F.coalesce("status", F.lit("completed")).alias("status"),
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Newest value of some columns per key, combined on the map side."""
    at = F.struct(*order)
    return grouped(df, keys).agg(*[F.max_by(src, at).alias(out) for out, src in values.items()])
