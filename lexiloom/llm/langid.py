"""Language identification in two steps: the family first, then the language within it.

Texts are lower-cased, all but letters become spaces, and byte n-grams (one to three) are hashed
into ``DIMS`` counts, square-rooted and normalised.  A linear softmax picks the family; linear
support vector machines, one for each pair of languages of a family, vote within it.  Both are
trained in numpy on a bounded sample (about ``SAMPLE_ROWS`` rows, dealt evenly to the languages, at
least ``SAMPLE_LEAST`` of each, in the order of a hash).  Training and identification read whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text when
there is no training row; rows with a null language teach nothing; a language outside the family
table is a family of its own; of languages with equal votes the one with the larger sum of the
machines' certainties, then the first by code; repeated rows get the same result and count once in
training; very long texts are read in segments; other columns are ignored, and kept ones named
``lang_pred`` or ``score`` give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .caches import give_back, hold
from .common import segments

DIMS = 1 << 13
SAMPLE_ROWS, SAMPLE_LEAST = 2_000, 40
#: A language with a larger part of the rows than one in so many is frequent.
FREQUENT = 10_000
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "indic": "hi ur bn pa mr gu ne",
    "turkic": "tr az kk uz ky",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
UNDETERMINED = "und"


def features(text: str) -> np.ndarray:
    total = np.zeros(DIMS)
    for segment in segments(text.lower().encode()):
        raw = np.frombuffer(b" " + b" ".join(segment.translate(_SPACES).split()) + b" ", np.uint8).astype(np.uint32)
        two = raw[:-1] << 8 | raw[1:]
        three = two[:-1] << 8 | raw[2:]
        for salt, grams in ((0x9E3779B1, raw), (0x85EBCA77, two), (0xC2B2AE3D, three)):
            total += np.bincount(grams * np.uint32(salt) >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    total = np.sqrt(total)
    return total / max(np.linalg.norm(total), 1e-12)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes), x.dtype), np.zeros(classes, x.dtype)
    once = np.eye(classes, dtype=x.dtype)[y]
    weight = ((1 / np.maximum(1, np.bincount(y, minlength=classes)))[y][:, None] / classes).astype(x.dtype)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - once) * weight
        gw = x.T @ g + np.float32(1e-6) * w
        m += 0.1 * (gw - m)
        v += 0.01 * (gw * gw - v)
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * g.sum(0)
    return w, b


def svm_fit(x: np.ndarray, sign: np.ndarray, passes: int = 10, c: float = 10.0, seed: int = 3) -> np.ndarray:
    """Linear SVM by dual coordinate ascent; the last weight is the bias."""
    w, bias, alpha, norm = np.zeros(x.shape[1], x.dtype), 0.0, np.zeros(len(x)), np.einsum("ij,ij->i", x, x).astype(float) + 1
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(x)).tolist():
            new = min(max(alpha[i] + (1 - sign[i] * (float(x[i] @ w) + bias)) / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w += x.dtype.type(step) * x[i]
                bias += step
                alpha[i] = new
    return np.r_[w, bias]


class Model:
    """One matrix of all linear functions: families, then pairs."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.langs = sorted(set(y))
        family = {lang: FAMILY.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(family.values()))
        self.within = [[i for i, lang in enumerate(self.langs) if family[lang] == f] for f in self.families]
        code = np.array([self.langs.index(lang) for lang in y])
        fam = np.array([self.families.index(family[lang]) for lang in y])
        w, b = softmax_fit(x, fam, len(self.families))
        self.pairs = [p for group in self.within for p in combinations(group, 2)]
        rows, bias = [w.T], [b]
        for i, j in self.pairs:
            one = (code == i) | (code == j)
            s = svm_fit(x[one], np.where(code[one] == i, 1.0, -1.0))
            rows.append(s[None, :-1])
            bias.append(s[-1:])
        self.weights, self.bias = np.concatenate(rows).T.astype(np.float32), np.concatenate(bias)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        z = x @ self.weights + self.bias
        f = z[:, : len(self.families)]
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        family = p.argmax(1)
        sure = 1 / (1 + np.exp(-4 * np.clip(z[:, len(self.families) :], -50, 50)))
        langs, scores = [], p[np.arange(len(x)), family]
        votes = np.zeros((len(x), len(self.langs)))
        chance = np.zeros((len(x), len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += sure[:, k] >= 0.5
            votes[:, j] += sure[:, k] < 0.5
            chance[:, i] += sure[:, k]
            chance[:, j] += 1 - sure[:, k]
        for r, fam in enumerate(family.tolist()):
            group = self.within[fam]
            best = max(group, key=lambda i: (votes[r, i], chance[r, i], -i))
            langs.append(self.langs[best])
            if len(group) > 1:
                scores[r] *= chance[r, best] / (len(group) - 1)
        return langs, np.clip(scores, 0.0, 1.0)


def fit(docs: DataFrame) -> Model | None:
    """Train on a bounded sample of ``docs(doc_id, text, lang)``; None if there is none."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", F.length("text")))
    stats = rows.groupBy("lang").agg(F.approx_count_distinct("k").alias("found"))
    sizes = stats.agg(F.count("*").alias("langs"), F.sum("found").alias("rows")).first()
    langs = sizes["langs"]
    if not langs:
        return None
    each = max(SAMPLE_LEAST, SAMPLE_ROWS // langs)
    # Of frequent languages, rows whose hash lies below a share of its range, about four times those
    # wanted, before any is ranked.  There are at most ``FREQUENT`` such languages.
    frequent = stats.where(F.col("found") > max(4 * each, sizes["rows"] // FREQUENT)).select("lang", (F.lit(4.0 * each) / F.col("found")).alias("share"))
    few = rows.join(F.broadcast(frequent), "lang", "left").where((F.col("k") / 2.0**64 + 0.5) <= F.coalesce("share", F.lit(1.0))).select("doc_id", "lang", "k").distinct()
    ids = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k", "doc_id"))).where(F.col("r") <= each).select("k", "lang")
    sample = rows.join(F.broadcast(ids.distinct()), ["k", "lang"]).groupBy("k", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).astype(np.float16).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["k", "lang", "x"])

    got = sample.select("k", "lang", "text").mapInArrow(run, "k long, lang string, x binary").toArrow().sort_by([("k", "ascending"), ("lang", "ascending")])
    if not got.num_rows:
        return None
    x = np.empty((got.num_rows, DIMS), np.float32)
    for i, raw in enumerate(got["x"]):
        x[i] = np.frombuffer(raw.as_buffer(), np.float16)
    langs = got["lang"].to_pylist()
    del got
    model = Model(x, langs)
    del x
    give_back()
    return model


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` of each whole text."""
    keep = tuple(k for k in keep if k not in ("lang_pred", "score"))
    src = docs.select(*keep, docs[text_col].alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid", lambda: None)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts = some.column(some.num_columns - 1).to_pylist()
                known = [i for i, t in enumerate(texts) if sent.value and has_letter(t)]
                langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if known:
                    x = np.stack([features(texts[i]) for i in known])
                    for i, lang, s in zip(known, *sent.value.predict(x), strict=True):
                        langs[i], scores[i] = lang, float(s)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
