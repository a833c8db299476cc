"""Queries: filters, samples, time and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import sampling as sm
from ..operators import temporal as tm
from ..operators.ranking import latest
from .common import PRED, TOK, predictions, query, rounded, table


@query("recent_n_posts", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 5""")
def recent_n_posts(spark, sf):
    return sm.recent_posts(table(spark, sf, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id")


@query("recent_then_range", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 20 AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-27'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5""")  # fmt: skip
def recent_then_range(spark, sf):
    """The cap counts posts that the date range then removes."""
    capped = sm.recent_posts(table(spark, sf, "events"), "user_id", "ts", "event_id", 20)
    return sm.recent_posts(tm.closed_range(capped, "ts", "2024-01-10", "2024-01-27"), "user_id", "ts", "event_id", 5).select("user_id", "event_id")


@query("date_range_closed", """SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL""")
def date_range_closed(spark, sf):
    return tm.closed_range(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-20").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("date_range_half_open", "SELECT user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-20' GROUP BY ALL")
def date_range_half_open(spark, sf):
    return tm.half_open_dates(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-20").groupBy("user_id").agg(F.count("*").alias("n"))


@query("pattern_filter", "SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'diagnosed') OR contains(lower(text), 'password') OR contains(lower(text), 'thand'))")
def pattern_filter(spark, sf):
    return table(spark, sf, "documents").where(~tx.contains_any(F.col("text"), ["diagnosed", "password", "thand"])).select("doc_id")


@query("category_antijoin", "SELECT event_id, event_type FROM events WHERE lower(event_type) NOT IN (SELECT lower(event_type) FROM events GROUP BY event_type ORDER BY event_type LIMIT 2)")
def category_antijoin(spark, sf):
    e = table(spark, sf, "events")
    out = e.select(F.lower("event_type").alias("k")).distinct().orderBy("k").limit(2)
    return e.withColumn("k", F.lower("event_type")).join(F.broadcast(out), "k", "left_anti").select("event_id", "event_type")


@query("label_resolution", "SELECT user_id, max(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) AS y FROM events GROUP BY user_id")
def label_resolution(spark, sf):
    e = table(spark, sf, "events")
    return sm.resolve_label(e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("t")))).withColumn("hit", F.when(F.col("event_type") == F.col("t"), "y")), "user_id", "hit", "y")


@query("matched_pairs", """WITH t AS (SELECT c_custkey AS k, [c_custkey + 1, c_custkey + 2] AS m FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT k AS c_custkey, 'target' AS role FROM t UNION ALL SELECT c_custkey, 'control' FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey IN (SELECT unnest(m) FROM t)""")  # fmt: skip
def matched_pairs(spark, sf):
    c = table(spark, sf, "customer")
    t = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.array(F.col("c_custkey") + 1, F.col("c_custkey") + 2).alias("m"))
    return sm.matched_pairs(t, c.where("c_mktsegment <> 'BUILDING'"), "m", "c_custkey")


ORDERED = "row_number() OVER (PARTITION BY toxic ORDER BY md5('42_' || doc_id), doc_id)"


@query("rebalance", f"""WITH z AS (SELECT count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic = 0) AS c FROM labels)
SELECT doc_id, toxic FROM (SELECT doc_id, toxic, {ORDERED} AS p FROM labels WHERE toxic IN (0, 1)), z
WHERE p <= CASE WHEN toxic = 1 THEN CASE WHEN t * 2 <= c THEN t ELSE c // 2 END ELSE CASE WHEN t * 2 <= c THEN t * 2 ELSE c END END""")  # fmt: skip
def rebalance(spark, sf):
    return sm.rebalance(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id", (1, 2))


@query("downsample", "SELECT doc_id FROM labels ORDER BY md5('42_' || doc_id), doc_id LIMIT 100")
def downsample(spark, sf):
    return sm.downsample(table(spark, sf, "labels").select("doc_id"), 100, "doc_id")


@query("kfold_stratified", f"SELECT doc_id, toxic, (({ORDERED} - 1) % 5 + 1)::INTEGER AS fold FROM labels")
def kfold_stratified(spark, sf):
    return sm.stratified_folds(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 5)


@query("held_out_split", f"SELECT doc_id, CASE WHEN {ORDERED} <= floor(count(*) OVER (PARTITION BY toxic) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS role FROM labels")
def held_out_split(spark, sf):
    return sm.held_out_split(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 0.2).select("doc_id", "role")


@query("random_posts", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42_' || event_id), event_id) AS p, floor(count(*) OVER (PARTITION BY user_id) * 0.1::DOUBLE) AS n FROM events) WHERE p <= n""")
def random_posts(spark, sf):
    return sm.random_posts(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 0.1)


@query("age_matched_sample", """WITH b AS (SELECT c_custkey, c_mktsegment, least(greatest(floor((c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE * 100), 0), 99) AS bin FROM customer),
w AS (SELECT bin, count(*)::DOUBLE AS w FROM b WHERE c_mktsegment = 'BUILDING' GROUP BY bin)
SELECT c_custkey FROM b JOIN w ON b.bin = w.bin WHERE c_mktsegment <> 'BUILDING'
ORDER BY -ln(greatest(('0x' || substr(md5('42_' || c_custkey), 1, 8))::UBIGINT / 4294967296.0::DOUBLE, 1e-12::DOUBLE)) / w, c_custkey LIMIT 50""")  # fmt: skip
def age_matched_sample(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return sm.histogram_matched(c.where("c_mktsegment <> 'BUILDING'"), c.where("c_mktsegment = 'BUILDING'"), "c_acctbal", "c_custkey", 50, -1000.0, 10000.0, 100).select("c_custkey")


@query("label_overlay", """SELECT doc_id AS source, CASE WHEN q.quality = 0 THEN 'low' ELSE CASE WHEN toxic = 1 THEN 'toxic' ELSE 'control' END END AS label FROM labels q""")
def label_overlay(spark, sf):
    lab = table(spark, sf, "labels")
    base = lab.select(F.col("doc_id").alias("source"), F.when(F.col("toxic") == 1, "toxic").otherwise("control").alias("label"))
    return sm.overlay(base, lab.where("quality = 0").select(F.col("doc_id").alias("source"), F.lit("low").alias("label")))


BINS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]
BIN_SQL = "CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN 3 WHEN ts >= TIMESTAMP '2024-01-15' THEN 2 WHEN ts >= TIMESTAMP '2024-01-08' THEN 1 WHEN ts >= TIMESTAMP '2024-01-01' THEN 0 END"
BINNED = f"b AS (SELECT user_id, {BIN_SQL} AS bin, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY ALL)"


@query("time_bins", f"WITH {BINNED} SELECT * FROM b")
def time_bins(spark, sf):
    return tm.time_bins(table(spark, sf, "events"), "user_id", "ts", BINS)


@query("monthly_histogram", "SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY ALL")
def monthly_histogram(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.trunc("ts", "month").alias("month")).agg(F.count("*").alias("n"))


@query("user_time_bounds", "SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS n_days FROM events GROUP BY user_id")
def user_time_bounds(spark, sf):
    return tm.user_bounds(table(spark, sf, "events"), "user_id", "ts")


@query("posts_per_period_stats", f"""WITH {BINNED}, g AS (SELECT p.bin, u.user_id, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2, 3])::INTEGER AS bin) p CROSS JOIN (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON b.bin = p.bin AND b.user_id = u.user_id)
SELECT bin, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, count(*) FILTER (n > 0) AS above_0, count(*) FILTER (n > 10) AS above_10, count(*) FILTER (n > 20) AS above_20 FROM g GROUP BY bin""")  # fmt: skip
def posts_per_period_stats(spark, sf):
    e = table(spark, sf, "events")
    periods = spark.range(4).select(F.col("id").cast("int").alias("bin"))
    return rounded(tm.period_stats(tm.time_bins(e, "user_id", "ts", BINS), e, periods, "user_id", [0, 10, 20]), "mean")


@query("valid_periods", f"""WITH {BINNED}, l AS (SELECT user_id, (user_id % 2)::INTEGER AS y FROM events GROUP BY ALL), p AS (SELECT bin, y, count(*) AS users FROM b JOIN l ON b.user_id = l.user_id WHERE n >= 10 GROUP BY ALL)
SELECT bin, min(users) AS users FROM p GROUP BY bin HAVING count(*) = 2 AND min(users) >= 5""")  # fmt: skip
def valid_periods(spark, sf):
    e = table(spark, sf, "events")
    labels = e.select("user_id", (F.col("user_id") % 2).cast("int").alias("y")).distinct()
    return tm.valid_bins(tm.time_bins(e, "user_id", "ts", BINS), labels, "user_id", 10, 5)


@query("period_cross", f"""WITH {BINNED}, p AS (SELECT bin, count(*) AS users, sum(n)::BIGINT AS posts FROM b GROUP BY bin) SELECT x.bin AS target_bin, y.bin AS control_bin, x.users AS target_users, y.users AS control_users, x.posts + y.posts AS posts FROM p x, p y""")
def period_cross(spark, sf):
    """Every pair of periods, of which there are a handful."""
    p = tm.time_bins(table(spark, sf, "events"), "user_id", "ts", BINS).groupBy("bin").agg(F.count("*").alias("users"), F.sum("n").alias("posts"))
    y = F.broadcast(p.select(F.col("bin").alias("control_bin"), F.col("users").alias("control_users"), F.col("posts").alias("cp")))
    return p.crossJoin(y).select(F.col("bin").alias("target_bin"), "control_bin", F.col("users").alias("target_users"), "control_users", (F.col("posts") + F.col("cp")).alias("posts"))


@query("period_join", "SELECT p.name, e.event_type, count(*) AS n, round(sum(value), 4) AS total FROM events e JOIN (VALUES ('early', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-12'), ('middle', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20'), ('late', TIMESTAMP '2024-01-20', NULL)) p(name, lo, hi) ON e.ts >= lo AND (hi IS NULL OR e.ts < hi) GROUP BY ALL")
def period_join(spark, sf):
    periods = spark.sql("SELECT * FROM VALUES ('early', timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-12'), ('middle', timestamp_ntz'2024-01-10', timestamp_ntz'2024-01-20'), ('late', timestamp_ntz'2024-01-20', null) AS p(name, lo, hi)")
    return rounded(tm.join_periods(table(spark, sf, "events"), periods, "ts").groupBy("name", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


SCORES = "c AS (SELECT grp, count(*) FILTER (y_pred > 0.5::DOUBLE AND y_true = 1) AS tp, count(*) FILTER (y_pred > 0.5::DOUBLE AND y_true <> 1) AS fp, count(*) FILTER (y_pred <= 0.5::DOUBLE AND y_true = 1) AS fn, count(*) FILTER (y_pred <= 0.5::DOUBLE AND y_true <> 1) AS tn FROM pred GROUP BY grp)"
SCORED = "round(CASE WHEN tp + fp = 0 OR fn + tn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(CASE WHEN tp + fp = 0 OR fn + tn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy"


@query("prf_scores", f"WITH {PRED}, {SCORES} SELECT grp, tp, fp, fn, tn, {SCORED} FROM c")
def prf_scores(spark, sf):
    return rounded(ev.scores(predictions(spark, sf), ["grp"]), "precision", "recall", "f1", "accuracy")


@query("auc", f"""WITH {PRED}, r AS (SELECT grp, y_true, rank() OVER (PARTITION BY grp ORDER BY y_pred) + (count(*) OVER (PARTITION BY grp, y_pred) - 1) / 2.0::DOUBLE AS r FROM pred)
SELECT grp, round((sum(r) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y_true = 1) * count(*) FILTER (y_true <> 1), 0), 6) AS auc FROM r GROUP BY grp""")  # fmt: skip
def auc(spark, sf):
    return rounded(ev.auc(predictions(spark, sf), ["grp"]), "auc")


@query("roc_curve", f"""WITH {PRED}, d AS (SELECT grp, y_pred AS threshold, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true <> 1) AS n FROM pred GROUP BY ALL)
SELECT grp, threshold, round(sum(p) OVER (PARTITION BY grp ORDER BY threshold DESC)::DOUBLE / sum(p) OVER (PARTITION BY grp), 6) AS tpr, round(sum(n) OVER (PARTITION BY grp ORDER BY threshold DESC)::DOUBLE / sum(n) OVER (PARTITION BY grp), 6) AS fpr FROM d""")  # fmt: skip
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(predictions(spark, sf), ["grp"]), "tpr", "fpr")


@query("pr_max_f1", f"""WITH {PRED}, d AS (SELECT grp, round(y_pred, 2) AS threshold, count(*) FILTER (y_true = 1) AS p, count(*) AS m FROM pred GROUP BY ALL),
f AS (SELECT grp, threshold, round(2.0::DOUBLE * sum(p) OVER w / (sum(m) OVER w + sum(p) OVER (PARTITION BY grp)), 9) AS f1 FROM d WINDOW w AS (PARTITION BY grp ORDER BY threshold DESC))
SELECT grp, threshold, f1 FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, threshold) = 1""")  # fmt: skip
def pr_max_f1(spark, sf):
    return ev.best_f1(predictions(spark, sf), ["grp"])


@query("confusion_matrix", f"WITH {PRED} SELECT y_true, (y_pred >= 0.5::DOUBLE)::INTEGER AS predicted, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY y_true), 6) AS share FROM pred GROUP BY y_true, (y_pred >= 0.5::DOUBLE)::INTEGER")
def confusion_matrix(spark, sf):
    return rounded(ev.confusion(predictions(spark, sf)), "share")


@query("prob_histogram", f"""WITH {PRED} SELECT y_true, least(floor(y_pred / 1.0::DOUBLE * 20), 19)::BIGINT AS bin, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY y_true) / 0.05::DOUBLE, 6) AS density FROM pred WHERE y_pred BETWEEN 0 AND 1 GROUP BY y_true, least(floor(y_pred / 1.0::DOUBLE * 20), 19)::BIGINT""")
def prob_histogram(spark, sf):
    return rounded(ev.histogram(predictions(spark, sf), F.col("y_pred"), ["y_true"], 0.0, 1.0, 20), "density")


@query("mean_standard_error", f"WITH {PRED} SELECT grp, round(avg(y_pred), 6) AS mean, round(stddev_samp(y_pred), 6) AS std, round(stddev_samp(y_pred) / sqrt(nullif(count(*) - 1, 0)), 6) AS stderr FROM pred GROUP BY grp")
def mean_standard_error(spark, sf):
    return rounded(ev.mean_error(predictions(spark, sf), ["grp"], "y_pred", population=False), "mean", "std", "stderr")


@query("baseline_difference", """WITH s AS (SELECT event_type, (user_id % 3)::INTEGER AS dataset, round(avg(value), 6) AS score FROM events GROUP BY ALL)
SELECT a.event_type, a.dataset, round(a.score - b.score, 5) AS difference, round(100.0::DOUBLE * (a.score - b.score) / b.score, 4) AS percent FROM s a JOIN s b ON a.event_type = b.event_type AND b.dataset = 0""")  # fmt: skip
def baseline_difference(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).cast("int").alias("dataset")).agg(F.round(F.avg("value"), 6).alias("score"))
    out = ev.against_baseline(s, ["event_type"], F.col("dataset") == 0, "score")
    return out.select("event_type", "dataset", F.round("difference", 5).alias("difference"), F.round("percent", 4).alias("percent"))


@query("seen_unseen_scores", f"""WITH {PRED}, e AS (SELECT subset, y_true, y_pred FROM pred, (VALUES ('overall'), ('seen'), ('unseen')) s(subset) WHERE subset = 'overall' OR (subset = 'seen') = (doc_id % 3 = 0))
SELECT subset, round(count(*) FILTER (y_pred > 0.5::DOUBLE AND y_true = 1)::DOUBLE / count(*) FILTER (y_true = 1), 6) AS recall, count(*) AS support FROM e GROUP BY subset""")  # fmt: skip
def seen_unseen_scores(spark, sf):
    p = ev.with_subsets(predictions(spark, sf).withColumn("seen", F.col("doc_id") % 3 == 0), "seen")
    out = ev.scores(p, ["subset"])
    return rounded(out, "recall").select("subset", "recall", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("support"))


@query("comorbidity", """WITH l AS (SELECT doc_id, 'toxic' AS c FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'low' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'fine' FROM labels WHERE quality = 1)
SELECT a.c AS a, b.c AS b, count(*) AS n FROM l a JOIN l b ON a.doc_id = b.doc_id GROUP BY ALL""")  # fmt: skip
def comorbidity(spark, sf):
    """Each row's own few labels meet; rows need no join."""
    marks = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low"), F.when(F.col("quality") == 1, "fine")))
    l1 = table(spark, sf, "labels").select(marks.alias("m"))
    return l1.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("spearman", """WITH r AS (SELECT c_mktsegment AS grp, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE AS x,
rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0::DOUBLE AS y FROM customer)
SELECT grp, round(corr(x, y), 6) AS spearman FROM r GROUP BY grp""")  # fmt: skip
def spearman(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "grp")
    return rounded(ev.spearman(c, "c_acctbal", "c_nationkey", ["grp"]), "spearman")


@query("latest_per_user", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_per_user(spark, sf):
    return latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 1).select("user_id", "event_id")


@query("label_distribution", "SELECT d.lang, toxic, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY d.lang), 6) AS share FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang, toxic")
def label_distribution(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "toxic").agg(F.count("*").alias("n"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))), "share")


@query("words_per_post", f"WITH {TOK} SELECT source, count(*) AS posts, round(avg(len(tokens)), 6) AS mean_words, median(len(tokens))::DOUBLE AS median_words FROM tok GROUP BY source")
def words_per_post(spark, sf):
    n = table(spark, sf, "documents").select("source", F.size(tx.words(F.col("text"))).alias("n"))
    return rounded(n.groupBy("source").agg(F.count("*").alias("posts"), F.avg("n").alias("mean_words"), F.percentile("n", F.lit(0.5)).alias("median_words")), "mean_words")


@query("row_max_normalised_pivot", """WITH c AS (SELECT event_type, (user_id % 4)::INTEGER AS g, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, g, round(n::DOUBLE / max(n) OVER (PARTITION BY event_type), 6) AS share FROM c""")
def row_max_normalised_pivot(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).cast("int").alias("g")).agg(F.count("*").alias("n"))
    return c.select("event_type", "g", F.round(F.col("n") / F.max("n").over(Window.partitionBy("event_type")), 6).alias("share"))


@query("truth_prediction_align", """SELECT coalesce(l.doc_id, p.doc_id) AS source, l.toxic AS y_true, coalesce(p.y, 0.5::DOUBLE) AS y_pred FROM labels l FULL JOIN (SELECT doc_id, quality::DOUBLE AS y FROM labels WHERE quality = 1) p ON l.doc_id = p.doc_id""")
def truth_prediction_align(spark, sf):
    lab = table(spark, sf, "labels")
    return ev.align(lab.select(F.col("doc_id").alias("source"), F.col("toxic").alias("y_true")), lab.where("quality = 1").select(F.col("doc_id").alias("source"), F.col("quality").cast("double").alias("y_pred")))
