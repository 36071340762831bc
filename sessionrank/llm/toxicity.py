"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.llm.common import forget_words, fresh, labelled, stage, tally, utf8

ROWS, TERMS = 10_000, 1_000
MIN_TEXTS, MIN_SHARE, MIN_ODDS = 4, 0.02, 4.0
STEMS = (4, 5, 6)
NEAR = 40
TREES, DEPTH, STEP = 20, 3, 0.3
#: Words that address the reader, in four languages.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes"
    " vous votre vos tú ti tus usted ustedes vosotros"
).split()
#: Digits and signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi", "*_-.")

_B = np.arange(256)
LOWER, UPPER, DIGIT = (_B >= 97) & (_B <= 122), (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57)
SPACE = (_B == 32) | ((_B >= 9) & (_B <= 13))
PRINT = (_B > 32) & (_B < 127) & ~LOWER & ~UPPER & ~DIGIT
MARK = np.isin(_B, list(b".,;:!?'\"()-"))
HIDING = np.isin(_B, list(b"013457@$!*_-."))
LETTER = LOWER | UPPER | (_B >= 128)
#: Lower-case text with a blank for everything but letters.
BLANKED = bytes(c if LETTER[c] else 32 for c in range(256))


def blanked(text: str) -> str:
    return " " + text.lower().encode().translate(BLANKED).decode() + " "


def terms(text: str) -> set[str]:
    """Words as `` word `` and stems as `` stem`` of a blanked text."""
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 1} | {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}


def lexicon(sample: DataFrame, size: int = TERMS) -> list[tuple[str, float]]:
    """The terms whose presence speaks for the label, at most ``size``, with their log odds.

    From (text, label). A term is in ``MIN_TEXTS`` texts of label 1 and in ``MIN_SHARE`` of
    them at least, and the lower end of the 90 % interval of its odds ratio is above ``MIN_ODDS``.
    """

    def counted(batches):
        found: Counter = Counter()
        texts = [0, 0]

        def rows():
            keys = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())],
                ["term", "label", "n"],
            )

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((t, label) for t in terms(blanked(text)))
                texts[label] += 1
                if len(found) > 500_000:
                    yield rows()
                    found.clear()
        found["", 0] += texts[0]
        found["", 1] += texts[1]
        yield rows()

    sums = stage(
        sample.select("text", "label").mapInArrow(counted, "term string, label int, n long")
        .groupBy("term")
        .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))
    )
    all_ = sums.where("term = ''").first()
    if all_ is None or not all_["pos"] or not all_["neg"]:
        return []
    pos, neg = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(pos / (all_["pos"] + 1 - pos)) - F.log(neg / (all_["neg"] + 1 - neg))
    sure = odds - 1.64 * F.sqrt(1 / pos + 1 / neg)
    least = max(MIN_TEXTS, int(np.ceil(MIN_SHARE * all_["pos"])))
    top = sums.where((F.col("term") != "") & (F.col("pos") >= least)).select("term", odds.alias("odds"), sure.alias("sure"))
    return [(r["term"], r["odds"]) for r in top.where(F.col("sure") > float(np.log(MIN_ODDS))).orderBy(F.desc("sure"), "term").limit(size).collect()]


class Featurizer:
    """Densities of lexicon terms, address, capitals, punctuation and disguise of whole texts."""

    def __init__(self, words: list[tuple[str, float]]):
        self.words = words
        self.automaton = None

    def _find(self, text: str) -> tuple[list, list]:
        """(end, term number, odds) of terms, and ends of second-person words."""
        if self.automaton is None:  # one in each process
            self.automaton = ahocorasick.Automaton()
            own = {t: (i, o) for i, (t, o) in enumerate(self.words)}
            for w in SECOND_PERSON:
                own.setdefault(f" {w} ", None)
            for t, v in own.items():
                self.automaton.add_word(t, v)
            self.automaton.make_automaton()
        hits, you = [], []
        for end, v in self.automaton.iter(text):
            if v is None:
                you.append(end)
            else:
                hits.append((end, v[0], v[1]))
        return hits, you

    def __getstate__(self):
        return {"words": self.words, "automaton": None}

    def features(self, texts: pa.Array) -> np.ndarray:
        data, cut = utf8(texts)
        n = len(cut) - 1
        size = np.maximum(1, np.diff(cut)).astype(np.float64)
        up, letter, hide = UPPER[data], LETTER[data], HIDING[data]
        pair, hidden = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if len(data) > 2:
            pair[1:] = up[1:] & up[:-1]
            hidden[1:-1] = hide[1:-1] & letter[:-2] & letter[2:]
            # characters of another text of the batch are no neighbours
            first, last = cut[:-1][np.diff(cut) > 0], cut[1:][np.diff(cut) > 0] - 1
            pair[first] = hidden[first] = hidden[last] = False
        words = np.maximum(1, tally(SPACE[data], cut) + 1)
        hidden = tally(hidden, cut)
        out = np.zeros((n, 16))
        for k, x in enumerate((tally(up, cut) / size, tally(pair, cut) / size, tally(MARK[data], cut) / size, tally(data == 33, cut) / size, tally(PRINT[data], cut) / size, tally(DIGIT[data], cut) / size)):
            out[:, k] = x
        out[:, 6], out[:, 7] = hidden / words, np.log1p(words)
        flat = data.tobytes()
        for i in range(n):
            text = flat[cut[i] : cut[i + 1]].decode("utf-8", "replace")
            hits, you = self._find(blanked(text))
            if hits:
                ends = np.array([h[0] for h in hits])
                near = 0
                if you:
                    y = np.array(you)
                    at = np.searchsorted(y, ends)
                    gap = np.minimum(np.abs(ends - y[np.maximum(at - 1, 0)]), np.abs(ends - y[np.minimum(at, len(y) - 1)]))
                    near = int((gap <= NEAR).sum())
                odds = [h[2] for h in hits]
                out[i, 8:14] = len(hits) / words[i], np.log1p(len(hits)), np.log1p(len({h[1] for h in hits})), max(odds), sum(odds) / words[i], np.log1p(near)
            if hidden[i]:
                more = len(self._find(blanked(text.translate(LOOKALIKE)))[0]) - len(hits)
                out[i, 14:16] = np.log1p(max(0, more)), max(0, more) / words[i]
        return out


def featured(featurizer):
    """Column function: ``features`` of texts, in slices of bounded size."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_words()
        for texts in batches:
            parts = []
            for a in range(0, len(texts), 256):
                x = featurizer.features(texts.slice(a, 256))
                parts.append(pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return arrow_udf(run, "array<double>")


def scored(docs: DataFrame, train: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int = TERMS, name: str = "toxicity") -> DataFrame:
    """Adds a score from 0 to 1, higher for texts that are likelier to have ``toxic`` = 1.

    Learned from ``labels`` (doc_id, toxic) and the texts that ``train`` has for them, on a
    bounded sample of ``rows`` labelled rows: the lexicon, the trees (three quarters) and the
    isotonic map from their margin to a probability (one quarter). Every text is scored whole.

    Null and empty texts have the score of a text without any feature. Where the sample has
    one class only, the score is the smoothed share of label 1; without labels 0. Repeated rows
    and columns of any name pass through; ``name`` gets underscores where the table has it; no
    rows give no rows.
    """
    name = fresh(docs, name)
    sample = stage(labelled(train, labels, "toxic", rows))
    n, pos = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not pos or pos == n:
        return docs.withColumn(name, F.lit((pos + 1) / (n + 2) if n else 0.0))
    run = featured(Featurizer(lexicon(sample, terms)))
    known = stage(sample.select("label", F.pmod("h", F.lit(4)).alias("fold"), run("text").alias("x")).coalesce(4))
    known = known.select(F.col("label").cast("double"), "fold", array_to_vector("x").alias("features"))
    held = known.where("fold = 0")
    fit = known.where("fold <> 0")
    if held.select("label").distinct().count() < 2 or fit.select("label").distinct().count() < 2:
        held = fit = known
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(fit)
    margin = vector_to_array("rawPrediction")[1]
    curve = IsotonicRegression(featuresCol="margin").fit(trees.transform(held).select("label", margin.alias("margin")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), array_to_vector(run("text")).alias("features"))
    out = curve.transform(trees.transform(packed).select("row", margin.alias("margin")))
    return out.select("row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias(name))


def mild(docs: DataFrame, train: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The documents whose score is below ``limit``, with their own columns."""
    found = scored(docs, train, labels, **options)
    name = found.columns[-1]
    return found.where(F.col(name) < limit).drop(name)
