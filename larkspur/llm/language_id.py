"""Hierarchical language identification with linear support vector machines.

A text's hashed character n-grams (1 to 3) give square-rooted, unit-length
features. The first level separates language families, the second the languages
of the chosen family; both are one-versus-one linear SVMs, trained by dual
coordinate descent on the driver. Which languages exist is learned from the
labels; which family a language is of comes from a fixed table.

Every label is learned. The training sample is about ``SAMPLE`` documents over all
languages, or ``LEAST`` a label where that is more, drawn by hash, equally for each
label; its features are made on the executors, so the driver holds that many rows of
DIMENSIONS numbers. With more pairs of classes than rows, the machines are kept as
coefficients of the rows (one for each row and other class) instead of DIMENSIONS
weights for each pair: the same machines, so memory grows with the labels, not with
their pairs; the time to train does grow with the pairs. Either travels to the
executors with the function.
Prediction reads whole texts in Arrow batches: no shuffle.

Margins only compare the labels with each other, so the best of them never scores
under 0.25, whatever the text. A text is therefore held against the n-grams of the
label it gets: its mean code length under them, in nats an n-gram, may exceed what is
usual for that label's rows (each coded by the others) by ``SLACK``, and by more if
the text is short. Texts beyond that, as random letters and scripts never seen, keep
their label with score 0.

Defined cases: null texts and texts without a letter get ``und`` with score 0;
with no labelled text everything is ``und``; with one language that one is
predicted; repeated rows count as often as they occur; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Bounds of the training sample and of the model: documents, documents of a label that a
#: sample over many labels still holds, labels (the most frequent ones; None learns every
#: label), feature dimensions.
SAMPLE = 3000
LEAST = 20
LANGUAGES: int | None = None
DIMENSIONS = 1 << 13
EPOCHS = 12
COST = 4.0
#: Steepness of the squashed margins in the score.
STEEPNESS = 3.0
#: Nats an n-gram by which a text may be longer to code than its label's rows are; and what a
#: text of one n-gram may add to that, falling with the root of the effective number of n-grams.
SLACK = 1.5
SHORT = 4.0
#: Documents of a lower score are rejected by ``keep_known``: texts without a letter and those
#: beyond the slack, which score 0. Any other scores at least this, half sure of its family
#: and half sure of its language.
MIN_SCORE = 0.25
UNKNOWN = "und"
#: Code points hashed at a time.
CHUNK = 1 << 20

# Families of ISO 639-1 languages; any other language is its own family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "malayic": "id jv ms su tl",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family_of(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


@cache
def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Unit-length feature vector of the whole text; None without a letter."""
    if not text:
        return None
    counts = np.zeros(dimensions)
    shift = np.uint32(33 - dimensions.bit_length())
    lower = text.lower()
    some = False
    for at in range(0, len(lower), CHUNK):
        piece = lower[max(0, at - 2) : at + CHUNK]
        points = letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        some = some or bool((points != 32).any())
        points = np.r_[np.uint32(32), points, np.uint32(32)]
        points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
        h = points * np.uint32(0x9E3779B1)
        counts += np.bincount((h * np.uint32(0x85EBCA6B)) >> shift, minlength=dimensions)
        h = h[:-1] ^ (points[1:] * np.uint32(0xC2B2AE35))
        counts += np.bincount((h * np.uint32(0x27D4EB2F)) >> shift, minlength=dimensions)
        h = (h[:-1] * np.uint32(31)) ^ (points[2:] * np.uint32(0x165667B1))
        counts += np.bincount((h * np.uint32(0x9E3779B1)) >> shift, minlength=dimensions)
    return np.sqrt(counts / counts.sum()).astype(np.float32) if some else None


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def train(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of an SVM with squared hinge loss over some rows of x; y is +1 or -1.

    The last column of x is constant, its weight the bias. Dual coordinate descent; each
    class weighs the same whatever its size. Rows are read in place, none is copied.
    """
    return ascend(x, rows, y, epochs, cost)[0].astype(np.float32)


def ascend(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and the coefficient of each row in them."""
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    diagonal = share / (cost * len(y))
    norm = np.array([x[r] @ x[r] for r in rows], dtype=np.float64) + diagonal
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            gradient = y[i] * (x[rows[i]] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[rows[i]]
                alpha[i] = new
    return w, alpha * y


def coefficients(x: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """For each row of x, of class ``of``, its coefficient against every other class.

    The rows of a pair are replaced by as many coordinates with the same inner products,
    in which the machine is the same.
    """
    out = np.zeros((len(x), classes), np.float32)
    members = [np.flatnonzero(of == c) for c in range(classes)]
    for a, b in combinations(range(classes), 2):
        rows = np.r_[members[a], members[b]]
        pair = x[rows].astype(np.float64)
        values, vectors = np.linalg.eigh(pair @ pair.T)
        small = vectors * np.sqrt(np.maximum(values, 0))
        _, found = ascend(small, np.arange(len(rows)), np.where(of[rows] == a, 1.0, -1.0))
        out[members[a], b], out[members[b], a] = found[: len(members[a])], found[len(members[a]) :]
    return out


def squash(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-STEEPNESS * np.clip(margins, -20, 20)))


class OneVersusOne:
    """A linear SVM for each pair of classes; the summed squashed margins decide."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.coefficients = None
        if len(self.pairs) > len(rows):
            nth = {c: i for i, c in enumerate(self.classes)}
            self.of = np.array([nth[label] for label in labels])
            by = np.argsort(self.of, kind="stable")
            self.of, self.x = self.of[by], x[rows[by]]
            self.coefficients = coefficients(self.x, self.of, len(self.classes))
            return
        weights = []
        for a, b in self.pairs:
            mine = np.isin(labels, [self.classes[a], self.classes[b]])
            weights.append(train(x, rows[mine], np.where(labels[mine] == self.classes[a], 1.0, -1.0)))
        self.weights = np.stack(weights) if weights else np.zeros((0, x.shape[1]), np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The class of each row, and the mean squashed margin against the others."""
        if self.coefficients is not None:
            votes = self.votes_by_rows(x)
        else:
            votes = np.zeros((len(x), len(self.classes)))
            squashed = squash(x @ self.weights[:, :-1].T + self.weights[:, -1])
            for k, (a, b) in enumerate(self.pairs):
                votes[:, a] += squashed[:, k]
                votes[:, b] += 1 - squashed[:, k]
        best = votes.argmax(axis=1)
        others = max(1, len(self.classes) - 1)
        score = votes[np.arange(len(x)), best] / others if self.pairs else np.ones(len(x))
        return [self.classes[i] for i in best], score

    def votes_by_rows(self, x: np.ndarray) -> np.ndarray:
        """The votes where rows with coefficients stand for the weights."""
        near = x @ self.x[:, :-1].T + 1  # the last column, the bias, is 1 for every text
        firsts = np.searchsorted(self.of, np.arange(len(self.classes)))
        first_of_pair = np.triu(np.full((len(self.classes),) * 2, 2.0), 1) - 1  # else its margins turn round
        votes = np.zeros((len(x), len(self.classes)))
        for k in range(len(x)):
            parts = np.add.reduceat(self.coefficients * near[k][:, None], firsts, axis=0)
            won = squash((parts + parts.T) * first_of_pair)
            votes[k] = won.sum(axis=1) - won.diagonal()
        return votes


class Familiarity:
    """How usual a text's n-grams are among the rows of one label."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        total = np.full(x.shape[1] - 1, 1 / (x.shape[1] - 1))
        for r in rows:
            total += x[r, :-1] ** 2
        lengths = []
        for r in rows:  # each coded by the others; a label of one row by even odds
            at = np.flatnonzero(x[r, :-1])
            share = x[r, at].astype(np.float64) ** 2
            lengths.append(-share @ np.log(np.maximum(total[at] - share, 1 / len(total)) / len(rows)))
        self.usual = float(np.median(lengths))
        self.bits = (-np.log(total / (len(rows) + 1))).astype(np.float32)

    def known(self, x: np.ndarray) -> np.ndarray:
        """Whether each row of square-rooted shares is as usual as the slack asks."""
        shares = x**2
        return shares @ self.bits - self.usual <= SLACK + SHORT * np.linalg.norm(shares, axis=1)


class Model:
    """Families first, then the languages of the family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families, every = np.array([family_of(lang) for lang in langs], dtype=object), np.arange(len(langs))
        self.first = OneVersusOne(x, every, families) if len(x) else None
        self.second = {f: OneVersusOne(x, every[families == f], langs[families == f]) for f in set(families)}
        self.familiar = {lang: Familiarity(x, every[langs == lang]) for lang in set(langs)}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        vectors = [features(t) for t in texts]
        known = [i for i, v in enumerate(vectors) if v is not None]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not known or self.first is None:
            return langs, scores
        x = np.stack([vectors[i] for i in known])
        families, sure = self.first.predict(x)
        for family in set(families):
            mine = [k for k, f in enumerate(families) if f == family]
            found, score = self.second[family].predict(x[mine])
            for k, lang, s in zip(mine, found, score):
                langs[known[k]], scores[known[k]] = lang, float(min(1.0, max(0.0, sure[k] * s)))
        for lang in set(langs) - {UNKNOWN}:
            mine = [k for k, i in enumerate(known) if langs[i] == lang]
            for k in np.flatnonzero(~self.familiar[lang].known(x[mine])):
                scores[known[mine[k]]] = 0.0
        return langs, scores


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def sample_features(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, indices, values) of about ``sample`` labelled documents, evenly by language."""
    # Rows differ in id or text or are the same row: equal rows draw the same number and are one of the sample.
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(1 << 53)) / float(1 << 53)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("lang"), F.col("text").cast("string").alias("text"), draw.alias("draw"))
    learned = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min("draw").alias("least"))
    if LANGUAGES is not None:
        learned = learned.orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: (r["count"], r["least"]) for r in learned.collect()}
    quota = max(LEAST, sample // max(1, len(sizes)))
    bars = [(lang, max(least, min(1.0, quota / n))) for lang, (n, least) in sizes.items()]  # a label of equal rows is learned too
    shares = docs.sparkSession.createDataFrame(bars, "lang string, share double")
    # One row per language learned.
    drawn = labelled.join(F.broadcast(shares), "lang").where("draw <= share").groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (v := features(text)) is not None:
                    at = np.flatnonzero(v)
                    out.append((lang, at.astype("<u4").tobytes(), v[at].astype("<f4").tobytes()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()))], names=["lang", "indices", "values"])

    return drawn.mapInArrow(run, "lang string, indices binary, values binary")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the rows of ``docs`` that are labelled and not held out."""
    rows = sorted(sample_features(docs, sample).collect())
    x = np.zeros((len(rows), DIMENSIONS + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["indices"], "<u4")] = np.frombuffer(r["values"], "<f4")
    return Model(x, np.array([r["lang"] for r in rows], dtype=object))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred and score, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score."""
    return predict(docs, fit(docs, sample)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs``, all columns, without documents of no language or none that was learned."""

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(batches):
            yield pa.array([lang != UNKNOWN and score >= min_score for lang, score in zip(*model.predict(texts))], pa.bool_())

    return docs.where(known(F.col("text").cast("string")))
