"""Quality classifier: heuristic labellers, EM over their votes, and a hashed linear scorer trained on the posteriors."""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed import hashed_ngrams
from .shared import binary_column

#: log2 of the scorer's weights, n-gram lengths over character classes, and the most rows (about) that train the scorer.
BITS, SIZES, TRAIN_ROWS = 12, (1, 2, 3), 5000
#: Characters at which the n-grams of a text, and what is left to say without any sign, have half their weight.
SHORT = 60
#: Probability of being good under which a document is rejected.
THRESHOLD = 0.25
BAD, GOOD, ABSTAIN = 0, 1, 2

#: Very common words of the languages in the corpus.
COMMON = frozenset(
    "the of and to in a is that for it was on are be with as by at this from or an not but his they have el la de que y en un una los del las por con para se no es lo su al como mas der die und das den von zu "
    "mit ist im nicht ein eine des dem sich auf für als auch an le les et à il est du dans qui ce ne sur pas plus par je avec".encode().split()
)

_SYMBOLS = b"#*$%&|<>{}[]~^=_\\@+`"
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_PLAIN = bytes(c for c in range(256) if c <= 32 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)

#: Classes of bytes: lower-case and non-ASCII letters, capitals, digits, white space; other ASCII characters stand for themselves.
_CLASSES = bytes(1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b" \t" else 5 if c in b"\r\n\x0b\x0c" else max(c, 6) for c in range(256))


def statistics(text: bytes) -> dict[str, float]:
    """Measures of a text on which the labellers vote."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = len(text.translate(None, _NOT_LETTER))
    distinct = set(words)
    return {
        "words": len(words),
        "symbols": len(text.translate(None, _NOT_SYMBOL)) / max(1, len(text)),
        "capitals": len(text.translate(None, _NOT_UPPER)) / max(1, letters),
        "shouts": text.count(b"!!") / n,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)) if len(lines) > 3 else 0.0,
        "variety": len(distinct) / n**0.5,  # grows slowly with length in prose
        "repeats": sum(map(operator.eq, words, words[1:])) / n,
        "letters": letters / max(1, letters + len(text.translate(None, _PLAIN))),
        "digits": len(text.translate(None, _NOT_DIGIT)) / max(1, len(text)),
        "pipes": text.count(b"|") / n,
        "mean": letters / n,
        "common": sum(w in COMMON for w in text.lower().split()) / n,
        "pairs": len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 1.0,
    }


#: The labellers: a measure, the least words for which it tells anything, and the values beyond which it votes BAD and up to which it votes GOOD.
#: A BAD limit below the GOOD one is a lower limit. Values between the two abstain.
BANDS = [
    ("symbols", 3, 0.03, 0.005), ("capitals", 5, 0.12, 0.06), ("shouts", 3, 0.05, 0.0), ("repeated_lines", 20, 0.25, 0.05), ("variety", 50, 3.5, 6.0), ("letters", 5, 0.91, 0.95),
    ("digits", 3, 0.25, 0.05), ("repeats", 10, 0.06, 0.03), ("pipes", 3, 0.05, 0.0), ("mean", 5, 8.0, 6.5), ("mean", 5, 3.5, 4.0), ("common", 20, 0.06, 0.15), ("pairs", 20, 0.7, 0.9),
]
LABELLERS = len(BANDS)
LEAST = {name: least for name, least, *_ in BANDS}


def votes(s: dict[str, float]) -> list[int]:
    """One vote of each labeller. A text too short for a measure shows no sign of what it looks for, which is a vote for GOOD."""
    out = []
    for name, least, bad, good in BANDS:
        x = s[name]
        if s["words"] < least:
            out.append(GOOD)
        elif bad > good:
            out.append(BAD if x > bad else GOOD if x <= good else ABSTAIN)
        else:
            out.append(BAD if x < bad else GOOD if x >= good else ABSTAIN)
    return out


def code(v: list[int]) -> int:
    """A pattern of votes as a number below 3 ** LABELLERS."""
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def pattern(c: int) -> list[int]:
    out = []
    for _ in range(LABELLERS):
        c, x = divmod(c, 3)
        out.append(x)
    return out[::-1]


@dataclass(frozen=True)
class LabelModel:
    prior: float  # of good
    vote: np.ndarray  # (2 classes, labellers, 3 votes)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        at = np.arange(patterns.shape[1])
        logs = np.log(self.vote)[:, at, patterns].sum(axis=2)  # class, row
        odds = np.log(self.prior) - np.log(1 - self.prior) + logs[GOOD] - logs[BAD]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, false_alarms: float = 1.0, recall: float = 0.0) -> LabelModel:
    """Class prior and vote probabilities of each labeller from the counts of vote patterns, without any true label.

    Starts from the share of BAD votes among those cast, which makes class BAD the one that they point to, and alternates posteriors and
    (smoothed) re-estimates until they stay. Limits may be set to what is known of the labellers: the largest share of good texts that get a
    BAD vote, and the least share of bad ones; by default nothing is.
    """
    bad, cast = (patterns == BAD).sum(axis=1), (patterns != ABSTAIN).sum(axis=1)
    good = np.where(bad == 0, 0.95, 0.3 * (1 - bad / np.maximum(cast, 1)) + 0.02)
    model = None
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])  # class, row
        vote = np.empty((2, patterns.shape[1], 3))
        for c in (BAD, GOOD):
            for v in (BAD, GOOD, ABSTAIN):
                vote[c, :, v] = (weight[c][:, None] * (patterns == v)).sum(axis=0) + 1.0 / 3
            vote[c] /= vote[c].sum(axis=1, keepdims=True)
        for c, held in ((BAD, np.maximum(vote[BAD, :, BAD], recall)), (GOOD, np.minimum(vote[GOOD, :, BAD], false_alarms))):
            rest = vote[c, :, GOOD] + vote[c, :, ABSTAIN]
            vote[c, :, [GOOD, ABSTAIN]] *= (1 - held) / rest
            vote[c, :, BAD] = held
        prior = float(np.clip(weight[GOOD].sum() / max(1e-9, weight.sum()), 0.02, 0.98))
        model = LabelModel(prior, vote)
        new = model.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-6:
            break
        good = new
    return model


def weight(text: bytes) -> float:
    """How much a text has to tell by its length, from 0 to 1."""
    return len(text) / (len(text) + SHORT)


def features(text: bytes, s: dict[str, float]) -> np.ndarray:
    """Hashed vector of a text: shares of n-grams over character classes, and its statistics in steps, both of which count for less in a short text."""
    codes = np.frombuffer(text.translate(_CLASSES), dtype=np.uint8)
    x = np.sqrt(hashed_ngrams(codes, SIZES, BITS).astype(np.float32) / max(1, len(codes)) * weight(text))
    for k, (name, v) in enumerate(sorted((n, v) for n, v in s.items() if n != "words")):  # length is no sign of quality
        step = int(min(15, np.log2(1 + v))) if v > 1 else int(min(10, 10 * v))
        x[(k * 2654435761 + step * 40503 + 17) % (1 << BITS)] += 0.5 * min(1.0, s["words"] / (2 * LEAST[name]))
    return x


def train_scorer(rows: np.ndarray, lengths: np.ndarray, prior: float, target: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by gradient descent with momentum; classes weigh alike.

    The bias counts by the weights of the texts' lengths, what is missing there by the prior's log-odds: a text that tells nothing is as good as any.
    """
    w, b = np.zeros(rows.shape[1], np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    good = float(np.clip(target.mean(), 0.02, 0.98)) if len(target) else 0.5
    balance = (target / good + (1 - target) / (1 - good)) / 2
    missing = (1 - lengths) * log_odds(prior)
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(rows @ w + b * lengths + missing, -30, 30)))
        g = balance * (p - target) / len(rows)
        vw = 0.9 * vw + (rows.T @ g + decay * w)
        vb = 0.9 * vb + (g * lengths).sum()
        w, b = (w - rate * vw).astype(np.float32), b - rate * vb
    return w, float(b)


def log_odds(p: float) -> float:
    return float(np.log(p) - np.log(1 - p))


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> tuple[float, float]:
        """(posterior of the labellers, probability of good by the scorer); texts without words have 0."""
        s = statistics(text)
        if not s["words"]:
            return 0.0, 0.0
        label = float(self.labels.posterior(np.array([votes(s)]))[0])
        full = weight(text)
        margin = float(features(text, s) @ self.weights) + self.bias * full + (1 - full) * log_odds(self.labels.prior)
        return label, float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit to docs without any labels.

    Vote patterns are counted over all rows; those that occur, a few hundred of the 3 ** LABELLERS that there are, reach the driver. The scorer
    trains on about `rows` rows, drawn by a hash of id and text over all of docs, of which half are shared out to patterns with a BAD
    vote; they come as vectors of fixed size, those of rows that repeat id and text once.
    """
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    draw = F.xxhash64(F.coalesce("id", F.lit("")), F.coalesce("text", F.lit("")), F.lit("quality sample"))

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            stats = (statistics(x.as_py()) for x in binary_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array([code(votes(s)) if s["words"] else None for s in stats], pa.int32())], ["code"])

    seen = source.mapInArrow(vote, "code int").where("code is not null").groupBy("code").count().collect()
    seen = sorted((r["code"], r["count"]) for r in seen)
    patterns = np.array([pattern(c) for c, _ in seen], dtype=int).reshape(-1, LABELLERS)
    counts = np.array([n for _, n in seen], dtype=float)
    labels = expectation_maximisation(patterns, counts) if seen else LabelModel(0.5, np.full((2, LABELLERS, 3), 1 / 3))
    flagged = {c: BAD in pattern(c) for c, _ in seen}
    totals = {flag: sum(n for c, n in seen if flagged[c] == flag) for flag in (False, True)}
    share = {flag: min(1.0, rows / 2 / max(1, n)) for flag, n in totals.items()}
    top = max(share.values())

    def sample(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for h, x in zip(batch.column("h").to_pylist(), binary_column(batch, "text"), strict=True):
                text = x.as_py()
                s = statistics(text)
                if not s["words"]:
                    continue
                v = votes(s)
                if (h % (1 << 40)) / (1 << 40) < share[BAD in v]:
                    row = features(text, s)
                    at = np.flatnonzero(row)
                    out.append({"h": h, "code": code(v), "length": weight(text), "slots": at.astype(np.int32).tolist(), "values": row[at].tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("h", pa.int64()), ("code", pa.int32()), ("length", pa.float64()), ("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))]))

    drawn = source.withColumn("h", draw).where(F.pmod("h", F.lit(1 << 40)) < F.lit(int(top * (1 << 40)) + 1)).select("h", "text")
    vectors = drawn.mapInArrow(sample, "h long, code int, length double, slots array<int>, values array<float>")
    # rows that repeat id and text are drawn together and count once
    found = sorted(vectors.dropDuplicates(["h"]).collect(), key=lambda r: (r["h"], r["code"]))
    matrix = np.zeros((len(found), 1 << BITS), np.float32)
    for i, r in enumerate(found):
        matrix[i, r["slots"]] = r["values"]
    target = labels.posterior(np.array([pattern(r["code"]) for r in found], dtype=int).reshape(-1, LABELLERS)).astype(np.float32)
    lengths = np.array([r["length"] for r in found], dtype=np.float32)
    weights, bias = train_scorer(matrix, lengths, labels.prior, target)
    return QualityModel(labels, weights, bias)


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD, result_col: str = "quality") -> DataFrame:
    """docs with one more column: struct(label, score, keep), the labellers' posterior, the scorer's probability of good, and whether it reaches the threshold.

    A null text and one without words have label and score 0 and aren't kept. Only the text decides; repeated rows get equal
    results, an empty table gives an empty one. result_col must not be a column of docs. Nothing is shuffled; the broadcast model has a fixed size.
    """
    if result_col in docs.columns:
        raise ValueError(f"docs already has a column {result_col}")
    kind = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for batch in batches:
            found = [shared.value.score(x.as_py()) for x in binary_column(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([{"label": a, "score": b, "keep": b >= threshold} for a, b in found], arrow)], [*batch.schema.names, result_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(result_col, kind)]))
