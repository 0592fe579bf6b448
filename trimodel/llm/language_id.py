"""Language identification by hierarchical discrimination.

A linear support vector machine first predicts the language family; within a family, one-versus-one linear support
vector machines separate its languages by votes. Features are hashed byte trigrams of the whole lower-cased text with
everything but letters as blanks, as square roots of relative frequencies.

The model is fitted on the driver on a bounded sample of labelled rows: `train_rows` in all, the same number for each
language, the smallest text hashes first (so equal texts count once). The sample's features, not its texts, reach the
driver. Everything else covers all rows: each text is read whole.

Ties: of languages with equal votes the one with the larger margins in all, then the first by name, is predicted.

Defined results: `und` and score 0 for a null text, one without a letter, or where no labelled row exists; equal texts
get equal predictions; a very long text is read in stretches; empty tables give empty results; further columns aren't
read. Rows with a null language are predicted, never learnt from.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import free, map_batches, prepare, texts, written

#: Families of language codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "tr", "uz"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIM = 4096
BLANKS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(raw: list[bytes]) -> np.ndarray:
    """A row for each text: root of the relative frequency of each hashed trigram."""
    out = np.zeros((len(raw), DIM), dtype=np.float32)
    for k, t in enumerate(raw):
        b = np.frombuffer(b" " + t.decode("utf-8", "replace").lower().encode().translate(BLANKS) + b" ", dtype=np.uint8)
        total = np.zeros(DIM)
        for s in range(0, len(b) - 2, 1 << 20):  # bounded memory for very long texts
            x = b[s : s + (1 << 20) + 2].astype(np.uint32)
            code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
            code = code[(x[1:-1] != 32) | (x[:-2] != 32) & (x[2:] != 32)]
            total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
        if n := total.sum():
            out[k] = np.sqrt(total / n)
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge, each class weighing the same), y in -1, 1.

    Accelerated gradient steps on the rows' coefficients: with the rows' products at hand, a step costs rows squared."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c).astype(np.float32)
    products = x @ x.T
    w, v = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
    rate = np.float32(1 / (1 + 4 * c))  # rows have norm at most root 2, with the bias
    for k in range(steps):
        new = v - rate * (v - 2 * weight * y * np.maximum(0, 1 - y * (products @ v)))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    out = w @ x
    return out[:-1], float(out[-1])


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        y = np.array(langs)
        self.langs = sorted(set(langs))
        family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
        self.families = {f: sorted(set(y[family == f])) for f in sorted(set(family))}
        self.between = self._pairs(x, family, list(self.families))
        self.within = {f: self._pairs(x[family == f], y[family == f], names) for f, names in self.families.items()}

    @staticmethod
    def _pairs(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        pairs, ws, bs = list(combinations(range(len(names)), 2)), [], []
        for a, b in pairs:
            rows = (y == names[a]) | (y == names[b])
            w, bias = svm(x[rows], np.where(y[rows] == names[a], 1.0, -1.0))
            ws.append(w)
            bs.append(bias)
        return pairs, np.array(ws).reshape(len(pairs), DIM), np.array(bs)

    @staticmethod
    def _vote(model, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index with the most votes (then the largest margins), and its logistic confidence."""
        pairs, w, bias = model
        votes, least = np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        if pairs:
            margin = x @ w.T + bias
            for k, (a, b) in enumerate(pairs):
                m = margin[:, k]
                squashed = np.tanh(m)
                votes[:, a] += (m >= 0) + squashed * 1e-3
                votes[:, b] += (m < 0) - squashed * 1e-3
                least[:, a] = np.minimum(least[:, a], m)
                least[:, b] = np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(len(x)), best], -50, 50)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        family, score = self._vote(self.between, x, len(names))
        out = np.empty(len(x), dtype=object)
        for k, f in enumerate(names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, s = self._vote(self.within[f], x[rows], len(self.families[f]))
                out[rows] = np.array(self.families[f], dtype=object)[best]
                score[rows] = score[rows] * s
        return out.tolist(), score


def fold(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _smallest(hashes: DataFrame, each: int, bits: int = 10, few: int = 4096) -> dict[str, int]:
    """For each language the `each`-th smallest hash (or its largest, if there are fewer). hashes: lang, h, distinct.

    Ranges of hashes are counted, and the one that holds the place looked for is cut again until it holds `few` hashes at
    most, which are looked at: the counts are partial aggregates of at most 2 ** bits rows a language, so that no task
    gathers a language."""
    hashes = written(hashes)
    size = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    low, left = dict.fromkeys(size, 0), {lang: min(each, n) for lang, n in size.items()}
    shift = 64
    while True:
        start = F.create_map(*[F.lit(x) for pair in low.items() for x in pair])[F.col("lang")]
        inside = hashes if shift == 64 else hashes.where(F.shiftright("h", shift) == start)
        if shift == 0 or max(size.values()) <= few:
            found: dict[str, list[int]] = {lang: [] for lang in size}
            for r in inside.collect():
                found[r["lang"]].append(r["h"])
            return {lang: sorted(h)[left[lang] - 1] for lang, h in found.items()}
        shift = max(0, shift - bits)
        done: set[str] = set()
        for r in sorted(inside.groupBy("lang", F.shiftright("h", shift).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if r["lang"] not in done and left[r["lang"]] <= r["n"]:
                low[r["lang"]], size[r["lang"]] = r["part"], r["n"]
                done.add(r["lang"])
            elif r["lang"] not in done:
                left[r["lang"]] -= r["n"]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 1600) -> Model | None:
    """A model of the rows outside fold 0; None without labelled text. train_rows bounds the sample, whatever the input."""
    prepare(docs.sparkSession)
    rows = docs.where((fold(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    langs = rows.select("lang").distinct().limit(train_rows).count()
    if not langs:
        return None
    last = _smallest(rows.select("lang", "h").distinct(), max(1, train_rows // langs))
    bound = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    sample = rows.where(F.col("h") <= bound[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(texts(batch, "text"))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "x"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("x", T.BinaryType())])
    found = sorted(map_batches(sample, take, schema).collect(), key=lambda r: (r["lang"], r["h"]))
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in found]), [r["lang"] for r in found])


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and the score, 0 to 1."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # some MB: its size depends on the number of languages only
    letter = docs.select("*", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(*free(docs, "tm_letter")))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    names = schema.names

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
        langs, scores = ["und"] * len(known), np.zeros(len(known))
        at = np.flatnonzero(known) if shared.value is not None else []
        raw = texts(batch, text_col)
        for s in range(0, len(at), 256):
            part = at[s : s + 256]
            found, score = shared.value.predict(features([raw[k] for k in part]))
            for k, lang in zip(part, found, strict=True):
                langs[k] = lang
            scores[part] = score
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return map_batches(letter, judge, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 1600) -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    model = fit(docs, id_col, text_col, lang_col, train_rows)
    rows = docs.select(F.col(id_col), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("tm_text"))
    return predicted(rows, model, "tm_text").drop("tm_text")
