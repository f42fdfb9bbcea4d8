"""Scores and selection on rule-based predictions over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.operators import evaluate

BY = ("tag", "classifier", "split")
CLASSES = range(5)

# Truth: rank of the event type. Predictions: two rules. Tag and split: from ids.
PREDICTIONS = """ranks as (select event_type, row_number() over (order by event_type) - 1 as y
                  from (select distinct event_type from events)),
    truth as (select event_id, 'tag_' || (user_id % 4) as tag,
                     case when user_id % 3 = 0 then 'val' else 'test' end as split, y::int as y_true, user_id
              from events join ranks using (event_type)),
    predictions as (
      select tag, 'folded' as classifier, 1 as train_order, split, event_id, y_true,
             case when event_id % 7 > 4 then y_true else (event_id % 7)::int end as y_pred from truth
      union all
      select tag, 'by_user', 2, split, event_id, y_true, (user_id % 4)::int from truth)"""

SCORES = f"""{PREDICTIONS},
    cells as (select tag, classifier, split, y_true, y_pred, count(*) as n from predictions group by all),
    per_class as (
      select tag, classifier, split, class, sum(tp) as tp, sum(support) as support, sum(predicted) as predicted from (
        select tag, classifier, split, y_true as class, case when y_true = y_pred then n else 0 end as tp,
               n as support, 0 as predicted from cells
        union all
        select tag, classifier, split, y_pred, 0, 0, n from cells) group by all),
    scores as (select tag, classifier, split, class, tp, support,
                 case when predicted > 0 then tp / predicted else 0 end as precision,
                 case when support > 0 then tp / support else 0 end as recall,
                 2 * tp / (support + predicted) as f1 from per_class)"""

METRICS = f"""with {SCORES}
    select tag, classifier, split, round(sum(tp) / sum(support), 9) as accuracy,
           round(sum(f1 * support) / sum(support), 9) as f1_weighted, round(avg(f1), 9) as f1_macro,
           sum(support)::bigint as n_rows
    from scores group by tag, classifier, split"""

REPORT = f"""with {SCORES},
    sums as (select tag, classifier, split, sum(support) as support, sum(tp) / sum(support) as acc,
               avg(precision) as mp, avg(recall) as mr, avg(f1) as mf,
               sum(precision * support) / sum(support) as wp, sum(recall * support) / sum(support) as wr,
               sum(f1 * support) / sum(support) as wf from scores group by tag, classifier, split),
    lines as (
      select tag, classifier, split, class::varchar as row, precision, recall, f1, support from scores
      union all select tag, classifier, split, 'accuracy', acc, acc, acc, support from sums
      union all select tag, classifier, split, 'macro avg', mp, mr, mf, support from sums
      union all select tag, classifier, split, 'weighted avg', wp, wr, wf, support from sums)
    select tag, classifier, split, row, round(precision, 9) as precision, round(recall, 9) as recall,
           round(f1, 9) as f1, support::bigint as support from lines"""


def truth(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())  # five types
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")) - 1
    return events.select(
        "event_id",
        "user_id",
        F.concat(F.lit("tag_"), F.col("user_id") % 4).alias("tag"),
        F.when(F.col("user_id") % 3 == 0, "val").otherwise("test").alias("split"),
        rank.cast("int").alias("y_true"),
    )


def predictions(spark, sf_dir):
    rules = """inline(array(
        struct('folded' as classifier, 1 as train_order, if(event_id % 7 > 4, y_true, cast(event_id % 7 as int)) as y_pred),
        struct('by_user' as classifier, 2 as train_order, cast(user_id % 4 as int) as y_pred)))"""
    return truth(spark, sf_dir).select("tag", "split", "event_id", "y_true", F.expr(rules))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(
    "score_join",
    f"with {PREDICTIONS} select event_id, classifier, y_true, y_pred from predictions",
)
def score_join(spark, sf_dir):
    scored = predictions(spark, sf_dir).select("event_id", "classifier", "y_pred")
    pairs = evaluate.score_join(truth(spark, sf_dir).select("event_id", "y_true"), scored, "event_id")
    return pairs.select("event_id", "classifier", "y_true", "y_pred")


@query(
    "accuracy",
    f"""with {PREDICTIONS} select tag, classifier, split, round(avg((y_true = y_pred)::int), 9) as accuracy
    from predictions group by tag, classifier, split""",
)
def accuracy(spark, sf_dir):
    return _rounded(evaluate.accuracy(predictions(spark, sf_dir)), "accuracy")


@query(
    "f1_scores",
    """with p as (select quality as y_true, (n_chars > 500)::int as y_pred from labels join documents using (doc_id)),
    k as (select y_true as class from p union select y_pred from p),
    s as (select class, count(*) filter (y_true = class and y_pred = class) as tp, count(*) filter (y_true = class) as support,
                 count(*) filter (y_pred = class) as predicted from p cross join k group by class)
    select 'quality' as tag, round(avg(2 * tp / (support + predicted)), 9) as f1_macro,
           round(sum(2 * tp / (support + predicted) * support) / sum(support), 9) as f1_weighted from s""",
)
def f1_scores(spark, sf_dir):
    """Two unbalanced classes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("y_pred"))
    marks = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"), F.lit("quality").alias("tag"))
    return _rounded(evaluate.f1_scores(evaluate.score_join(marks, docs, "doc_id"), ("tag",)), "f1_macro", "f1_weighted")


@query(
    "confusion_matrix",
    f"""with {SCORES},
    pairs as (select a.tag, a.classifier, a.split, a.class as y_true, b.class as y_pred from per_class a
              join per_class b on a.tag = b.tag and a.classifier = b.classifier and a.split = b.split)
    select tag, classifier, split, y_true, y_pred, coalesce(n, 0) as n
    from pairs left join cells using (tag, classifier, split, y_true, y_pred)""",
)
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir))


@query(
    "confusion_pivot",
    f"with {PREDICTIONS} select tag, classifier, split, y_true, "
    + ", ".join(f"count(*) filter (y_pred = {c}) as pred_{c}" for c in CLASSES)
    + " from predictions group by tag, classifier, split, y_true",
)
def confusion_pivot(spark, sf_dir):
    return evaluate.confusion_pivot(predictions(spark, sf_dir), CLASSES)


@query("classification_report", REPORT)
def classification_report(spark, sf_dir):
    return _rounded(evaluate.classification_report(predictions(spark, sf_dir)), "precision", "recall", "f1")


@query(
    "log_loss",
    f"""with {PREDICTIONS},
    w as (select tag, split, y_true, list_transform(range(5), lambda c: 1 + (event_id * (c + 3)) % 11) as w from truth)
    select tag, split, round(avg(-ln(greatest(w[y_true + 1] / list_sum(w), 1e-15))), 9) as log_loss, count(*) as n_rows
    from w group by tag, split""",
)
def log_loss(spark, sf_dir):
    weights = F.expr("transform(sequence(0, 4), c -> cast(1 + (event_id * (c + 3)) % 11 as double))")
    rows = truth(spark, sf_dir).withColumn("w", weights)
    rows = rows.withColumn("probability", F.expr("transform(w, x -> x / aggregate(w, 0D, (a, y) -> a + y))"))
    return _rounded(evaluate.log_loss(rows, ("tag", "split")), "log_loss")


@query("evaluate_splits", METRICS)
def evaluate_splits(spark, sf_dir):
    return _rounded(evaluate.evaluate_splits(predictions(spark, sf_dir)), "accuracy", "f1_weighted", "f1_macro")


@query(
    "best_model",
    f"""with m as ({METRICS}), o as (select * from (values ('folded', 1), ('by_user', 2)) v(classifier, train_order)),
    r as (select *, row_number() over (partition by tag order by f1_weighted desc, train_order) as place
          from m join o using (classifier) where split = 'test')
    select tag, classifier, train_order, accuracy, f1_weighted, f1_macro from r where place = 1""",
)
def best_model(spark, sf_dir):
    metrics = evaluate.evaluate_splits(predictions(spark, sf_dir), (*BY, "train_order"))
    metrics = _rounded(metrics, "accuracy", "f1_weighted", "f1_macro")
    return evaluate.best_model(metrics).select("tag", "classifier", "train_order", "accuracy", "f1_weighted", "f1_macro")


@query(
    "summary_table",
    f"""with m as ({METRICS})
    select tag, classifier, split, accuracy, f1_weighted, f1_macro, 'classical' as track, null::bigint as n_rows
    from m where classifier = 'folded'
    union all select tag, classifier, split, accuracy, f1_weighted, f1_macro, 'nn_streaming', n_rows
    from m where classifier = 'by_user'""",
)
def summary_table(spark, sf_dir):
    """Two tracks, one of them without the row count."""
    metrics = _rounded(evaluate.evaluate_splits(predictions(spark, sf_dir)), "accuracy", "f1_weighted", "f1_macro")
    first = metrics.where("classifier = 'folded'").drop("n_rows").withColumn("track", F.lit("classical"))
    second = metrics.where("classifier = 'by_user'").withColumn("track", F.lit("nn_streaming"))
    return evaluate.summary_table(first, second)


@query(
    "best_epoch",
    """with recursive log as (
      select event_type as classifier, date_part('day', ts)::bigint as epoch, round(avg(value), 6) as val_loss
      from events group by 1, 2),
    numbered as (select *, row_number() over (partition by classifier order by epoch) as n from log),
    run as (
      select classifier, 0::bigint as n, 'infinity'::double as best, null::bigint as best_epoch, 0 as wait,
             null::bigint as stop, 'infinity'::double as mark, 0 as flat, 0.001::double as rate
      from (select distinct classifier from log)
      union all
      select r.classifier, x.n,
             case when x.val_loss < r.best then x.val_loss else r.best end,
             case when x.val_loss < r.best then x.epoch else r.best_epoch end,
             case when x.val_loss < r.best then 0 else r.wait + 1 end,
             case when not x.val_loss < r.best and r.wait + 1 >= 8 then x.epoch end,
             case when x.val_loss < r.mark * 0.9999::double then x.val_loss else r.mark end,
             case when x.val_loss < r.mark * 0.9999::double or r.flat + 1 > 3 then 0 else r.flat + 1 end,
             case when not x.val_loss < r.mark * 0.9999::double and r.flat + 1 > 3 then r.rate * 0.5::double else r.rate end
      from run r join numbered x on x.classifier = r.classifier and x.n = r.n + 1 where r.stop is null)
    select classifier, best_epoch, best as best_loss, stop as stop_epoch, rate as final_rate from (
      select *, row_number() over (partition by classifier order by n desc) as back from run) where back = 1""",
)
def best_epoch(spark, sf_dir):
    """Mean value per event type and day read as a validation loss per epoch."""
    log = (
        load(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("classifier"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 6).alias("val_loss"))
    )
    return evaluate.best_epoch(log)
