"""Queries: splits, controls, selection and experiment tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import STOPWORDS
from ..operators import analysis as an
from ..operators import evaluation as ev
from ..operators import features as fe
from ..operators import fold_models as fm
from ..operators import scoring as sr
from ..operators import selection as fs
from ..operators import splits as sp
from ..operators import transfer as tr
from ..operators import vocabulary as vo
from ..operators.loader import PostLoader
from ..operators.temporal import bin_of
from ..operators.text_model import TextModel
from ..sources.scratch import root_of, stash
from .features import LEX
from .common import DTM, PRED, TOK, corpus, predictions, query, rounded, table, toxic_labels

HASHED = "md5('42_' || doc_id), doc_id"
#: Test documents by hash, then three folds of the others, classes to the ratio 1 : 2.
SPLITS = f"""held AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {HASHED}) <= floor(count(*) OVER (PARTITION BY toxic) * 0.2::DOUBLE) AS test FROM labels WHERE toxic IS NOT NULL),
z AS (SELECT count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic = 0) AS c FROM held WHERE NOT test),
cut AS (SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {HASHED}) AS p FROM held WHERE NOT test), z
  WHERE p <= CASE WHEN toxic = 1 THEN CASE WHEN t * 2 <= c THEN t ELSE c // 2 END ELSE CASE WHEN t * 2 <= c THEN t * 2 ELSE c END END),
f AS (SELECT doc_id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY {HASHED}) - 1) % 3 + 1 AS fold FROM cut),
splits AS (SELECT 'train' AS part, k::INTEGER AS fold, CASE WHEN fold = k THEN 'dev' ELSE 'train' END AS role, doc_id AS source, toxic AS label FROM f, range(1, 4) r(k)
  UNION ALL SELECT 'test', 1, 'test', doc_id, toxic FROM held WHERE test)"""
CONFIG = sp.SplitConfig(kfolds=3, class_ratio=(1, 2))


def _labels(spark, sf):
    return toxic_labels(spark, sf).select("source", F.col("y").alias("label"))


def _splits(spark, sf):
    return sp.split_data(_labels(spark, sf), CONFIG)


@query("split_data", f"WITH {SPLITS} SELECT part, fold, role, source, label FROM splits")
def split_data(spark, sf):
    return _splits(spark, sf)


@query("recombined_folds", f"WITH {SPLITS} SELECT DISTINCT CASE WHEN role = 'dev' THEN 'train' ELSE role END AS role, source, label FROM splits WHERE role <> 'train'")
def recombined_folds(spark, sf):
    return sp.recombine(_splits(spark, sf))


@query("split_sizes", f"""WITH {SPLITS} SELECT part, label, role, count(*) FILTER (fold = 1) AS "1", count(*) FILTER (fold = 2) AS "2", count(*) FILTER (fold = 3) AS "3" FROM splits GROUP BY ALL""")
def split_sizes(spark, sf):
    return sp.split_sizes(_splits(spark, sf), ["part", "label"], [1, 2, 3])


@query("paired_domains", f"""WITH {SPLITS}, q AS (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL), o AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY {HASHED}) - 1) % 3 + 1 AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {HASHED}) <= floor(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) AS test FROM q) WHERE NOT test),
t AS (SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {HASHED}) <= floor(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) AS test FROM q) WHERE test)
SELECT part, fold, role, source, label FROM splits WHERE role = 'train' UNION ALL SELECT 'train', fold::INTEGER, 'dev', doc_id, quality FROM o UNION ALL SELECT 'test', 1, 'test', doc_id, quality FROM t""")  # fmt: skip
def paired_domains(spark, sf):
    """Training sets of the toxicity labels, tried on the sets of the quality labels."""
    quality = table(spark, sf, "labels").where("quality is not null").select(F.col("doc_id").alias("source"), F.col("quality").alias("label"))
    return sp.pair_across(_splits(spark, sf), sp.split_data(quality, sp.SplitConfig(kfolds=3)))


@query("controls_not_relaxed", "SELECT doc_id AS source, CASE WHEN toxic = 1 THEN 'target' ELSE 'control' END AS label FROM labels WHERE toxic IS NOT NULL AND doc_id % 3 <> 0")
def controls_not_relaxed(spark, sf):
    meta = table(spark, sf, "labels").select(F.col("doc_id").alias("source"), F.expr("case toxic when 1 then 'target' when 0 then 'control' end").alias("label"), F.expr("if(doc_id % 3 = 0, 'relaxed', 'train')").alias("split"))
    return sp.isolate_controls(meta, "smhd", 0).select("source", "label")


@query("controls_paired", """WITH m AS (SELECT doc_id, toxic, CASE WHEN toxic = 1 THEN [doc_id + 1, doc_id + 2, doc_id + 7] ELSE [] END AS matches FROM labels WHERE toxic IS NOT NULL)
SELECT doc_id AS source, CASE WHEN toxic = 1 THEN 'target' ELSE 'control' END AS label FROM m WHERE toxic = 1 OR doc_id IN (SELECT unnest(matches) FROM m WHERE toxic = 1)""")  # fmt: skip
def controls_paired(spark, sf):
    meta = table(spark, sf, "labels").select(F.col("doc_id").alias("source"), F.expr("case toxic when 1 then 'target' when 0 then 'control' end").alias("label"), F.expr("if(toxic = 1, array(doc_id + 1, doc_id + 2, doc_id + 7), array())").alias("matches"))
    return sp.isolate_controls(meta, "multitask", 0).select("source", "label")


@query("one_hot_conditions", """WITH c AS (SELECT user_id, list_distinct(list(event_type)) AS t FROM events WHERE event_id % 7 = user_id % 7 GROUP BY user_id)
SELECT user_id, list_contains(t, 'click')::INTEGER AS act, (list_contains(t, 'view') OR list_contains(t, 'error'))::INTEGER AS see FROM c""")  # fmt: skip
def one_hot_conditions(spark, sf):
    c = table(spark, sf, "events").where("event_id % 7 = user_id % 7").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))  # a user's few types
    return sp.one_hot(c, "t", {"click": "act", "view": "see", "error": "see"}).drop("t")


@query("anomalies_excluded", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 ELSE doc_id - 1 END AS match, quality, toxic FROM labels WHERE doc_id % 11 <> 0),
a AS (SELECT * FROM p WHERE match IN (SELECT doc_id FROM p) AND greatest(coalesce(quality, 0), coalesce(toxic, 0)) > 0) SELECT doc_id FROM a WHERE match IN (SELECT doc_id FROM a)""")  # fmt: skip
def anomalies_excluded(spark, sf):
    p = table(spark, sf, "labels").select("doc_id", F.expr("if(doc_id % 2 = 0, doc_id + 1, doc_id - 1)").alias("match"), F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return sp.without_anomalies(p, "doc_id", "match", p.where("doc_id % 11 = 0"), ["quality", "toxic"]).select("doc_id")


@query("overlap_flags", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS in_labels, doc_id IN (SELECT conv_id FROM conversations) AS in_conversations FROM documents")
def overlap_flags(spark, sf):
    conversations = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"))
    return sp.overlap_flags(table(spark, sf, "documents").select("doc_id"), "doc_id", labels=table(spark, sf, "labels"), conversations=conversations)


REPORT = "c AS (SELECT grp, count(*) FILTER (y_pred > 0.5::DOUBLE AND y_true = 1)::DOUBLE AS tp, count(*) FILTER (y_pred > 0.5::DOUBLE AND y_true <> 1)::DOUBLE AS fp, count(*) FILTER (y_pred <= 0.5::DOUBLE AND y_true = 1)::DOUBLE AS fn, count(*) FILTER (y_pred <= 0.5::DOUBLE AND y_true <> 1)::DOUBLE AS tn FROM pred GROUP BY grp)"


@query("classification_report", f"""WITH {PRED}, {REPORT}, s AS (SELECT grp, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp + fn AS n1, tn + fp AS n0,
  coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0 FROM c)
SELECT grp, round(accuracy, 6) AS accuracy, round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1, 6) AS f1, round((n1 * p1 + n0 * p0) / (n1 + n0), 6) AS weighted_precision,
  round((n1 * r1 + n0 * r0) / (n1 + n0), 6) AS weighted_recall, round((n1 * f1 + n0 * f0) / (n1 + n0), 6) AS weighted_f1 FROM s""")  # fmt: skip
def classification_report(spark, sf):
    r = ev.report(predictions(spark, sf), ["grp"])
    return rounded(r, *(c for c in r.columns if c != "grp"))


@query("category_counts", "SELECT user_id, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL")
def category_counts(spark, sf):
    return an.category_counts(table(spark, sf, "events"), "user_id", "event_type", "ts", "2024-01-05", "2024-01-20")


class _Words:
    """The plain words of a text, where a tokeniser is asked for."""

    def __call__(self, text):
        from ..functions.text import words

        return words(text)


@query("filtered_language_counts", f"""WITH {TOK}, k AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang <> 'es' AND NOT contains(lower(text), 'thand') AND doc_id * 86400 BETWEEN 86400 * 50 AND 86400 * 800)
SELECT w.source, term, count(*) AS n FROM w JOIN k ON w.doc_id = k.doc_id GROUP BY ALL""")  # fmt: skip
def filtered_language_counts(spark, sf):
    """Posts of other categories, without a term, from a range of days; then words are made and counted."""
    d = table(spark, sf, "documents").select(F.col("source").alias("user"), (F.col("doc_id") * 86400).alias("created_utc"), "text", F.col("lang").alias("subreddit"), F.col("doc_id").alias("ordinal"))
    loader = PostLoader(ignore_subreddits=("ES",), ignore_terms=("thand",))
    return an.language_counts(d, loader, _Words(), vo.Vocabulary(), "1970-02-20", "1972-03-11")


@query("category_filter", "SELECT event_id, event_type FROM events WHERE lower(event_type) NOT IN ('click', 'error')")
def category_filter(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("event_type").alias("subreddit"), F.array(F.lit("x")).alias("tokens"))
    return PostLoader(ignore_subreddits=("Click", "ERROR")).filter(e).select("event_id", "event_type")


@query("fold_frequent_terms", f"""WITH {DTM}, {SPLITS} SELECT fold, term FROM dtm JOIN splits s ON dtm.source = s.source WHERE s.role = 'train' GROUP BY ALL HAVING count(*) >= 10""")
def fold_frequent_terms(spark, sf):
    folds = _splits(spark, sf).where("role = 'train'").select("source", "fold")
    return an.frequent_in_fold(vo.Vocabulary().counts(corpus(spark, sf, "doc_id")), folds, 10)


@query("mean_coefficients", "WITH c AS (SELECT event_type AS name, event_id % 5 AS fold, avg(value) AS coef FROM events GROUP BY ALL) SELECT name, round(avg(coef), 6) AS coef, round(stddev_pop(coef), 6) AS std, count(*) AS folds FROM c GROUP BY name")
def mean_coefficients(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), (F.col("event_id") % 5).alias("fold")).agg(F.avg("value").alias("coef"))
    return rounded(an.mean_coefficients(c, ["name"]), "coef", "std")


PMI = f"""{DTM}, c AS (SELECT term, y, count(*) AS n FROM dtm JOIN lab ON dtm.source = lab.source GROUP BY ALL),
g AS (SELECT t.term, k.y, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT term FROM c) t CROSS JOIN (SELECT DISTINCT y FROM lab) k LEFT JOIN c ON c.term = t.term AND c.y = k.y),
s AS (SELECT count(DISTINCT term)::DOUBLE AS v, sum(n)::DOUBLE AS total FROM g),
p AS (SELECT term, n, log2(((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY g.y) + v)) / ((sum(n) OVER (PARTITION BY term) + 1.0::DOUBLE) / (total + v))) AS pmi FROM g, s),
best AS (SELECT term FROM p GROUP BY term HAVING sum(n) >= 5 ORDER BY round(max(pmi), 9) DESC, term LIMIT 200)"""
#: Selected terms: the best that are no stopwords, and protected ones.
KEPT = PMI + """, allterms AS MATERIALIZED (SELECT term, count(*) AS n FROM dtm GROUP BY term HAVING count(*) >= 3),
kept AS MATERIALIZED (SELECT term, n, row_number() OVER (ORDER BY term) - 1 AS idx FROM allterms WHERE (term IN (SELECT term FROM best) AND term NOT IN (""" + ", ".join(sorted(f"'{w}'" for w in fs.expanded(list(STOPWORDS)) if "'" not in w)) + """)) OR term IN ('und', 'la'))"""


def _selected(spark, sf):
    v = vo.Vocabulary(min_freq=3)
    counts = stash(v.counts(corpus(spark, sf, "doc_id")), "counts")
    terms = stash(v.fit_counts(counts), "terms")
    labels = toxic_labels(spark, sf)
    dtm = counts.join(labels.select("source"), "source", "left_semi")
    selector = fs.Selector("pmi", top_k=200, min_support=5, smoothing=1.0, protected=("und", "la"), filter_stopwords=True)
    return counts, terms, stash(selector.fit(dtm, labels, terms), "selected")


@query("selected_vocabulary", f"WITH {KEPT} SELECT term, n, idx FROM kept")
def selected_vocabulary(spark, sf):
    return _selected(spark, sf)[2].select("term", "n", "idx")


@query("reduced_columns", f"WITH {KEPT} SELECT source, idx, dtm.n FROM dtm JOIN kept ON dtm.term = kept.term")
def reduced_columns(spark, sf):
    counts, terms, kept = _selected(spark, sf)
    return fs.reduce_columns(vo.vectorize(counts, terms), terms, kept)


@query("protected_terms", f"""WITH {TOK}, v AS (SELECT term, count(DISTINCT source) AS n FROM w GROUP BY term HAVING count(DISTINCT source) >= 15),
x AS (SELECT DISTINCT lower(event_type) AS term FROM events), u AS (SELECT * FROM v UNION ALL SELECT term, 1 FROM x WHERE term NOT IN (SELECT term FROM v))
SELECT term, n, row_number() OVER (ORDER BY term) - 1 AS idx FROM u""")  # fmt: skip
def protected_terms(spark, sf):
    words = table(spark, sf, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"))
    return vo.protect(vo.Vocabulary(min_freq=15).fit(corpus(spark, sf)), vo.external_terms(words))


@query("lexicon_vocabulary", f"""WITH {TOK}, v AS (SELECT term FROM w GROUP BY term HAVING count(*) >= 20) SELECT term FROM v WHERE term = 'the' OR starts_with(term, 'un') OR starts_with(term, 'qu')""")
def lexicon_vocabulary(spark, sf):
    lexicon = spark.createDataFrame([("the", False, "a"), ("un", True, "b"), ("qu", True, "c")], "entry string, is_prefix boolean, dim string")
    words = corpus(spark, sf).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return vo.external_terms(words, lexicon, 20)


#: Users' splits by week: a seed for each week with enough users.
WEEKS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
TEMPORAL = f"""b AS (SELECT user_id AS source, CASE {" ".join(f"WHEN ts >= TIMESTAMP '{w}' THEN {i}" for i, w in reversed([*enumerate(WEEKS)]))} END AS bin, count(*) AS n FROM events GROUP BY ALL),
act AS (SELECT source, bin, (source % 2)::INTEGER AS label FROM b WHERE n >= 2 AND bin < 4),
ok AS (SELECT bin, row_number() OVER (ORDER BY bin) - 1 AS k FROM (SELECT bin, label, count(*) AS users FROM act GROUP BY ALL) GROUP BY bin HAVING count(*) = 2 AND min(users) >= 5),
pl AS (SELECT act.bin, source, label, row_number() OVER (PARTITION BY act.bin, label ORDER BY md5((42 + k) || '_' || source), source) AS p, floor(count(*) FILTER (label = 1) OVER (PARTITION BY act.bin) * 0.25::DOUBLE + 0.5::DOUBLE) AS m FROM act JOIN ok ON act.bin = ok.bin),
tf AS (SELECT bin, source, label, (row_number() OVER (PARTITION BY bin, label ORDER BY md5('42_' || source), source) - 1) % 2 + 1 AS fold FROM pl WHERE p > m),
ts AS (SELECT bin::INTEGER AS bin, 'train' AS part, j::INTEGER AS fold, CASE WHEN fold = j THEN 'dev' ELSE 'train' END AS role, source, label FROM tf, range(1, 3) r(j) UNION ALL SELECT bin::INTEGER, 'test', 1, 'test', source, label FROM pl WHERE p <= m)"""


def _temporal(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"))
    labels = e.select("source", (F.col("source") % 2).cast("int").alias("y")).distinct()
    return sp.temporal_splits(e, labels, WEEKS, sp.SplitConfig(kfolds=2, test_size=0.25), min_posts=2, min_users=5)


@query("temporal_splits", f"WITH {TEMPORAL} SELECT bin, part, fold, role, source, label FROM ts")
def temporal_splits(spark, sf):
    return _temporal(spark, sf)


ASSEMBLED = f"""{TEMPORAL}, pr AS (SELECT x.bin AS train_bin, y.bin AS test_bin, j::INTEGER AS fold, source FROM (SELECT DISTINCT bin FROM ts) x, (SELECT DISTINCT bin, source FROM ts) y, range(1, 3) r(j)),
asm AS (SELECT train_bin, test_bin, pr.fold, pr.source, t.role AS "group", t.label AS y_true, EXISTS (SELECT 1 FROM ts s WHERE s.role = 'train' AND s.bin = train_bin AND s.fold = pr.fold AND s.source = pr.source) AS user_in_training
  FROM pr JOIN ts t ON t.bin = test_bin AND t.source = pr.source AND t.role <> 'train' AND (t.role = 'test' OR t.fold = pr.fold))"""


def _assembled(spark, sf):
    splits = stash(_temporal(spark, sf), "splits")
    bins = splits.select("bin").distinct()
    folds = F.explode(F.array(F.lit(1), F.lit(2))).alias("fold")
    pred = splits.select(F.col("bin").alias("test_bin"), "source").distinct().join(F.broadcast(bins.select(F.col("bin").alias("train_bin"))), how="cross").select("train_bin", "test_bin", folds, "source", F.lit(0.5).alias("y_pred"))  # a few periods
    periods = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(WEEKS, WEEKS[1:], strict=False))], "bin int, lo string, hi string")
    return sp.assemble_predictions(pred, splits, periods)


@query("temporal_predictions", f"""WITH {ASSEMBLED}, d AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{lo}', '{hi}')" for i, (lo, hi) in enumerate(zip(WEEKS, WEEKS[1:], strict=False)))}) v(bin, lo, hi))
SELECT train_bin, test_bin, fold, source, "group", y_true, user_in_training, a.lo AS train_min_date, a.hi AS train_max_date, b.lo AS test_min_date, b.hi AS test_max_date FROM asm JOIN d a ON a.bin = train_bin JOIN d b ON b.bin = test_bin""")  # fmt: skip
def temporal_predictions(spark, sf):
    return _assembled(spark, sf).drop("y_pred")


def event_posts(spark, sf):
    """(bin, source, tokens): an event's type, its value in tens and its property are its words."""
    words = F.array(F.col("event_type"), F.concat(F.lit("v"), F.floor(F.col("value") / 10).cast("string")), F.concat(F.lit("k"), F.from_json("props", "k long")["k"].cast("string")))
    e = table(spark, sf, "events").select(bin_of(F.col("ts"), WEEKS).alias("bin"), F.col("user_id").alias("source"), words.alias("tokens"))
    return e.where("bin < 4")


#: Multinomial naive Bayes written out for every training week and fold.
TEMPORAL_MODELS = f"""{TEMPORAL},
ev AS (SELECT user_id AS source, CASE {" ".join(f"WHEN ts >= TIMESTAMP '{w}' THEN {i}" for i, w in reversed([*enumerate(WEEKS)]))} END::INTEGER AS bin,
  unnest([event_type, 'v' || floor(value / 10)::BIGINT, 'k' || regexp_extract(props, '"k": *(-?[0-9]+)', 1)]) AS term FROM events),
cnt AS (SELECT bin, source, term, count(*) AS n FROM ev WHERE term IS NOT NULL GROUP BY ALL),
tr AS (SELECT DISTINCT bin AS train_bin, fold, source, label FROM ts WHERE role = 'train'),
th AS (SELECT train_bin, fold, term, sum(n) FILTER (label = 1) AS n1, sum(n) FILTER (label = 0) AS n0 FROM tr JOIN cnt ON cnt.bin = train_bin AND cnt.source = tr.source GROUP BY ALL),
lp AS (SELECT train_bin, fold, term, ln((coalesce(n1, 0) + 1) / (sum(n1) OVER w + count(*) OVER w)) - ln((coalesce(n0, 0) + 1) / (sum(n0) OVER w + count(*) OVER w)) AS d FROM th WINDOW w AS (PARTITION BY train_bin, fold)),
pri AS (SELECT train_bin, fold, ln((count(*) FILTER (label = 1) + 1.0::DOUBLE) / (count(*) FILTER (label = 0) + 1.0::DOUBLE)) AS p FROM tr GROUP BY ALL),
who AS (SELECT DISTINCT ts.bin, ts.source, ts.fold, role, label FROM ts JOIN cnt ON ts.bin = cnt.bin AND ts.source = cnt.source WHERE role <> 'train'),
sc AS (
  SELECT pri.train_bin, pri.fold, who.bin AS test_bin, who.source, role, label, any_value(pri.p) + coalesce(sum(cnt.n * lp.d), 0) AS odds
  FROM pri JOIN who ON role = 'test' OR who.fold = pri.fold JOIN cnt ON cnt.bin = who.bin AND cnt.source = who.source LEFT JOIN lp ON lp.train_bin = pri.train_bin AND lp.fold = pri.fold AND lp.term = cnt.term
  GROUP BY ALL),
pm AS (SELECT train_bin, fold, test_bin, source, role, label, 0.5::DOUBLE * (1 + tanh(odds / 2)) AS y_pred,
  EXISTS (SELECT 1 FROM tr WHERE tr.train_bin = sc.train_bin AND tr.fold = sc.fold AND tr.source = sc.source) AS user_in_training FROM sc)"""


def _scored(spark, sf):
    """Predictions of a model for each week and fold, in a folder of the run's own."""
    splits = stash(_temporal(spark, sf), "splits")
    options = TextModel(model="naive_bayes")
    root = f"{root_of(spark)}/experiment-{uuid.uuid4().hex}"
    return splits, sr.score_periods(event_posts(spark, sf), splits, options, root)


@query("temporal_model_scores", f"WITH {TEMPORAL_MODELS} SELECT train_bin, train_bin AS control_bin, fold, test_bin, source, round(y_pred, 6) AS y_pred FROM pm")
def temporal_model_scores(spark, sf):
    return rounded(_scored(spark, sf)[1], "y_pred")


@query("combination_sizes", f"""WITH {ASSEMBLED}, g AS (SELECT * FROM (SELECT DISTINCT "group" FROM asm), (SELECT DISTINCT train_bin FROM asm), (SELECT DISTINCT test_bin FROM asm), (SELECT DISTINCT fold FROM asm), (SELECT DISTINCT y_true FROM asm)),
n AS (SELECT "group", train_bin, test_bin, fold, y_true, count(*) AS n, count(*) FILTER (NOT user_in_training) AS n_unseen FROM asm GROUP BY ALL)
SELECT g.*, coalesce(n, 0) AS n, coalesce(n_unseen, 0) AS n_unseen FROM g LEFT JOIN n USING ("group", train_bin, test_bin, fold, y_true)""")  # fmt: skip
def combination_sizes(spark, sf):
    return sp.combination_sizes(_assembled(spark, sf))


#: Hashed scores with a hint of the label; targets of a test week against controls of each.
COMBOS = f"""{ASSEMBLED},
hp AS (SELECT *, round(0.7::DOUBLE * (('0x' || substr(md5('5_' || train_bin || '_' || test_bin || '_' || fold || '_' || source), 1, 8))::UBIGINT / 4294967296.0::DOUBLE) + 0.3::DOUBLE * y_true, 2) AS s FROM asm),
bn AS (SELECT DISTINCT test_bin AS o FROM hp),
mx AS (SELECT "group", train_bin, fold, y_true, s, user_in_training, CASE WHEN y_true = 1 THEN test_bin ELSE o END AS target_test, CASE WHEN y_true = 1 THEN o ELSE test_bin END AS control_test FROM hp, bn),
sb AS (SELECT * EXCLUDE user_in_training, unnest(['overall', CASE WHEN user_in_training THEN 'seen' ELSE 'unseen' END]) AS subset FROM mx),
pt AS (SELECT "group", train_bin, target_test, control_test, fold, subset, s, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM sb GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER a AS np, sum(n) OVER a AS nn, lead(p) OVER w AS p1, lead(n) OVER w AS n1, row_number() OVER w AS i
  FROM pt WINDOW w AS (PARTITION BY "group", train_bin, target_test, control_test, fold, subset ORDER BY s DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY "group", train_bin, target_test, control_test, fold, subset)),
rc AS (
  SELECT "group", train_bin, target_test, control_test, fold, subset, max(np)::BIGINT AS n_target, max(nn)::BIGINT AS n_control,
    '0,' || string_agg(round(fp / nn * 1000000)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (i = 1 OR p1 IS NULL OR p1 <> p OR n1 <> n) AS fpr, '0,' || string_agg(round(tp / np * 1000000)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (i = 1 OR p1 IS NULL OR p1 <> p OR n1 <> n) AS tpr,
    round(sum(n * (tp - p / 2)) / (max(np) * max(nn)), 6) AS auc, coalesce(sum(p) FILTER (s > 0.5), 0) AS h1, coalesce(sum(n) FILTER (s > 0.5), 0) AS h0
  FROM cu WHERE np > 0 AND nn > 0 GROUP BY ALL)"""


@query("combination_scores", f"""WITH {COMBOS} SELECT "group", train_bin, train_bin AS control_bin, target_test, control_test, fold, subset, n_target, n_control, n_target + n_control AS support, fpr, tpr, auc,
  round(coalesce(h1::DOUBLE / nullif(h1 + h0, 0), 0), 6) AS precision, round(h1::DOUBLE / n_target, 6) AS recall, round(2 * h1::DOUBLE / (h1 + h0 + n_target), 6) AS f1, round((h1 + n_control - h0)::DOUBLE / (n_target + n_control), 6) AS accuracy FROM rc""")  # fmt: skip
def combination_scores(spark, sf):
    asm = _assembled(spark, sf)
    key = F.concat_ws("_", "train_bin", "test_bin", "fold", "source")
    score = F.round(F.lit(0.7) * tx.uniform(key, 5) + F.lit(0.3) * F.col("y_true"), 2)
    found = ev.combination_scores(asm.withColumn("control_bin", F.col("train_bin")).withColumn("y_pred", score), mixed=True)
    digits = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return rounded(found.withColumns({c: digits(c) for c in ("fpr", "tpr")}).drop("thresholds"), "auc", "precision", "recall", "f1", "accuracy")


#: Customers by region and segment, every fifth one a target, matched by their balances.
AGES = """m AS (SELECT c_custkey AS source, c_custkey % 5 = 0 AS target, c_nationkey % 2 AS split, c_mktsegment AS gender, c_acctbal::DOUBLE AS age FROM customer),
st AS (SELECT split, gender, count(*) AS n, min(age) - CASE WHEN min(age) = max(age) THEN 0.5 ELSE 0 END AS lo, max(age) + CASE WHEN min(age) = max(age) THEN 0.5 ELSE 0 END AS hi FROM m WHERE target GROUP BY ALL),
bn AS (SELECT m.*, st.n, lo, hi, least(greatest(floor((age - lo) / (hi - lo) * 100), 0), 99) AS bin FROM m JOIN st ON m.split = st.split AND m.gender = st.gender),
wt AS (SELECT split, gender, bin, count(*)::DOUBLE AS w FROM bn WHERE target GROUP BY ALL),
dr AS (SELECT bn.source, bn.n, row_number() OVER (PARTITION BY bn.split, bn.gender ORDER BY -ln(greatest(('0x' || substr(md5('42_' || bn.source), 1, 8))::UBIGINT / 4294967296.0::DOUBLE, 1e-12::DOUBLE)) / w, bn.source) AS p
  FROM bn JOIN wt ON bn.split = wt.split AND bn.gender = wt.gender AND bn.bin = wt.bin WHERE NOT target AND age >= lo AND age < hi)"""


@query("controls_by_age", f"WITH {AGES} SELECT source, 'target' AS label FROM m WHERE target UNION ALL SELECT source, 'control' FROM dr WHERE p <= n")
def controls_by_age(spark, sf):
    """As many controls of a split and segment as it has targets, drawn by the targets' balances in a hundred bins."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), F.expr("if(c_custkey % 5 = 0, 'target', 'control')").alias("label"), (F.col("c_nationkey") % 2).alias("split"), F.col("c_mktsegment").alias("gender"), F.col("c_acctbal").cast("double").alias("age"))
    return sp.isolate_controls(c, "clpsych").select("source", "label")


def _both(zero: str, one: str) -> str:
    """A value for each class that is true or predicted somewhere."""
    return f"concat_ws(',', CASE WHEN tn + fn + fp > 0 THEN {zero} END, CASE WHEN tp + fn + fp > 0 THEN {one} END)"


@query("domain_summary", f"""WITH {PRED}, k AS (SELECT grp, count(*) FILTER (y_pred > 0.5::DOUBLE AND y_true = 1)::DOUBLE AS tp, count(*) FILTER (y_pred > 0.5::DOUBLE AND y_true <> 1)::DOUBLE AS fp,
  count(*) FILTER (y_pred <= 0.5::DOUBLE AND y_true = 1)::DOUBLE AS fn, count(*) FILTER (y_pred <= 0.5::DOUBLE AND y_true <> 1)::DOUBLE AS tn, count(DISTINCT y_pred) AS several FROM pred GROUP BY grp),
pt AS (SELECT grp, y_pred AS s, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM pred GROUP BY ALL),
cu AS (SELECT grp, s, p, n, sum(p) OVER (PARTITION BY grp ORDER BY s DESC) AS tp, sum(p) OVER (PARTITION BY grp) AS np, sum(n) OVER (PARTITION BY grp) AS nn FROM pt),
au AS (SELECT grp, round(sum(n * (tp - p / 2)) / (max(np) * max(nn)), 6) AS auc FROM cu WHERE np > 0 AND nn > 0 GROUP BY grp)
SELECT k.grp, CASE WHEN several > 2 THEN auc END AS auc, {_both("round(coalesce(tn / nullif(tn + fn, 0), 0), 6)", "round(coalesce(tp / nullif(tp + fp, 0), 0), 6)")} AS precision, {_both("round(coalesce(tn / nullif(tn + fp, 0), 0), 6)", "round(coalesce(tp / nullif(tp + fn, 0), 0), 6)")} AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS binary_fscore, {_both("(tn + fp)::BIGINT", "(tp + fn)::BIGINT")} AS class_size, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM k LEFT JOIN au ON au.grp = k.grp""")  # fmt: skip
def domain_summary(spark, sf):
    s = ev.domain_summary(predictions(spark, sf), ["grp"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 6).cast("string")), ",").alias(c)
    return rounded(s.select("grp", "auc", text("precision"), text("recall"), "binary_fscore", F.array_join("class_size", ",").alias("class_size"), "accuracy"), "auc", "binary_fscore", "accuracy")


def _by_language(spark, sf):
    """(domain, source, term, n) of documents by language, and (domain, source, y) of the labelled ones."""
    d = table(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("domain"), F.col("doc_id").alias("source"), tx.words(F.col("text")).alias("tokens"))
    counts = d.select("domain", "source", F.explode("tokens").alias("term")).groupBy("domain", "source", "term").agg(F.count("*").alias("n"))
    return counts, d.select("domain", "source").join(toxic_labels(spark, sf), "source")


LEXICON = "entry string, is_prefix boolean, dim string"


@query("transfer_features", f"""WITH {TOK}, lex(entry, is_prefix, dim) AS (VALUES {", ".join(f"('{e}', {str(p).lower()}, '{d}')" for e, p, d in LEX)}),
c AS (SELECT lang AS domain, doc_id AS source, term, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY ALL), v AS (SELECT domain AS vocabulary, term FROM c GROUP BY ALL HAVING count(*) >= 3), t AS (SELECT DISTINCT term FROM v),
m AS (SELECT term, dim FROM t JOIN lex ON NOT is_prefix AND term = entry UNION
  SELECT term, arg_max(dim, length(entry)) FROM t JOIN lex ON is_prefix AND starts_with(term, entry) WHERE term NOT IN (SELECT entry FROM lex WHERE NOT is_prefix) GROUP BY term),
s AS (SELECT vocabulary, domain, source, dim AS name, sum(n)::DOUBLE AS value FROM c JOIN v ON c.term = v.term JOIN m ON m.term = c.term GROUP BY ALL)
SELECT vocabulary, domain, source, name, round(value / sum(value) OVER (PARTITION BY vocabulary, domain, source), 6) AS value FROM s""")  # fmt: skip
def transfer_features(spark, sf):
    """Shares of lexicon words in each document under the vocabulary of every language."""
    counts, _ = _by_language(spark, sf)
    counts = stash(counts, "counts")
    return rounded(tr.transfer_features(counts, stash(tr.domain_vocabularies(counts, 3), "vocabularies"), spark.createDataFrame(LEX, LEXICON), "matched"), "value")


@query("transfer_scores")
def transfer_scores(spark, sf):
    """Toxicity by lexicon words: the model of each language on every language, under both vocabularies and scalings."""
    counts, labels = _by_language(spark, sf)
    counts = stash(counts, "counts")
    found = tr.transfer_predictions(counts, labels, stash(tr.domain_vocabularies(counts, 3), "vocabularies"), spark.createDataFrame(LEX, LEXICON), "matched")
    scores = tr.transfer_scores(found)
    return rounded(scores, *(c for c in scores.columns if c not in tr.SETTING))


FOLD_MODELS = fm.FoldModels(least=10, excluded=("the", "und"))


def _fold_tables(spark, sf):
    folds = _splits(spark, sf).where("role = 'dev'").select("source", F.col("label").alias("y"), "fold")
    return vo.Vocabulary().counts(corpus(spark, sf, "doc_id")), folds


@query("fold_null_users", f"""WITH {DTM}, {SPLITS}, kt AS (SELECT source, term FROM dtm WHERE term NOT IN ('the', 'und')),
sd AS (SELECT k::INTEGER AS fold, doc_id AS source, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS "group" FROM f, range(1, 4) r(k)),
vc AS (SELECT sd.fold, term FROM kt JOIN sd ON kt.source = sd.source WHERE "group" = 'train' GROUP BY ALL HAVING count(*) >= 10),
kn AS (SELECT DISTINCT sd.fold, kt.source FROM kt JOIN sd ON kt.source = sd.source JOIN vc ON vc.fold = sd.fold AND vc.term = kt.term)
SELECT sd.fold, "group", count(*) AS users, count(*) FILTER (kn.source IS NULL) AS null_users FROM sd LEFT JOIN kn ON kn.fold = sd.fold AND kn.source = sd.source GROUP BY ALL""")  # fmt: skip
def fold_null_users(spark, sf):
    counts, folds = _fold_tables(spark, sf)
    return FOLD_MODELS.sizes(counts, folds)


@query("fold_model_scores")
def fold_model_scores(spark, sf):
    """TF-IDF and logistic regression of the documents' words, in three folds."""
    scores, _ = FOLD_MODELS.run(*_fold_tables(spark, sf))
    return rounded(scores, "precision", "recall", "fscore", "accuracy")


@query("concatenated", "SELECT doc_id, lang, NULL::INTEGER AS toxic FROM documents UNION ALL SELECT doc_id, NULL, toxic FROM labels")
def concatenated(spark, sf):
    return an.concat(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "toxic"))


@query("token_chunks", f"WITH {TOK} SELECT doc_id, i::INTEGER AS place, array_to_string(tokens[i * 50 + 1:i * 50 + 50], ' ') AS words FROM (SELECT doc_id, tokens, unnest(range((len(tokens) + 49) // 50)) AS i FROM tok)")
def token_chunks(spark, sf):
    rows = corpus(spark, sf, "doc_id").select(F.col("source").alias("doc_id"), F.posexplode(an.chunks(F.col("tokens"), 50)).alias("place", "chunk"))
    return rows.where(F.size("chunk") > 0).select("doc_id", "place", F.array_join("chunk", " ").alias("words"))


@query("group_means", f"WITH {DTM}, z AS (SELECT y AS grp, count(*) AS n FROM lab GROUP BY y) SELECT term AS name, grp, round(sum(dtm.n)::DOUBLE / z.n, 6) AS mean, z.n FROM dtm JOIN lab ON dtm.source = lab.source JOIN z ON z.grp = lab.y GROUP BY term, grp, z.n")
def group_means(spark, sf):
    values = vo.Vocabulary().counts(corpus(spark, sf, "doc_id")).select("source", F.col("term").alias("name"), F.col("n").alias("value"))
    return rounded(an.group_means(values, toxic_labels(spark, sf).withColumnRenamed("y", "grp")), "mean")


@query("unit_rows", f"WITH {DTM} SELECT source, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY source)), 6) AS value FROM dtm")
def unit_rows(spark, sf):
    rows = vo.Vocabulary().counts(corpus(spark, sf, "doc_id")).select("source", "term", F.col("n").alias("value"))
    return rounded(fe.l2_rows(rows, "value", "term"), "value")
