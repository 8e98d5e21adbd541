"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document (good, bad or nothing); human labels are one more labeller that
covers some of them. Expectation-maximisation over the counts of vote patterns in the whole corpus estimates how each
labeller votes on truly good and truly bad documents, and the posteriors label a bounded sample, on which a linear scorer
over hashed features is trained. Two such models decide: one for quality, one for toxicity.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import alnum_words, map_texts, packed, stored, unpacked
from modelwatch.llm.quality_rules import statistics_of

BUCKETS = 2**20
#: Documents from which the scorer's weights are fitted, labelled ones first.
MOST_TRAIN_ROWS = 8_000
NOTHING, GOOD, BAD = 0, 1, 2
#: Share of right votes that human labellers are taken to give.
HUMAN_ACCURACY = 0.98
QUALITY_LABELLERS = ["repeats", "symbols", "capitals", "marks", "tables", "sentences"]
TOXIC_LABELLERS = ["insults", "learned"]

#: Everyday insults; one labeller's list, not the definition of toxicity.
INSULTS = re.compile(
    rb"\b(?:idiots?|morons?|stupid|losers?|clowns?|trash|worthless|pathetic|disgusting|scum|dumb|fools?|imbeciles?|"
    rb"jerks?|bastards?|freaks?|creeps?|vermin|filthy|shut up|hate you)\b"
)


def ratios(raw: bytes, s: tuple[int, ...]) -> dict[str, float]:
    words = max(s[0], 1)
    return {
        "pairs": s[13] / words, "again": s[4] / words, "symbols": s[2] / words, "capitals": s[8] / max(s[8] + s[9], 1),
        "marks": s[11] / words, "bars": raw.count(b"|") / words, "sentences": s[12] / words, "lines": s[3] / max(s[6], 1),
        "length": s[1] / words / 16,
    }


def quality_votes(s: tuple[int, ...], r: dict[str, float]) -> list[int]:
    """One vote per quality labeller; texts that are too short for a labeller get nothing from it."""
    words = s[0]

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else NOTHING

    return [
        vote(r["pairs"] > 0.2 or (words >= 20 and r["again"] > 0.5), words >= 5 and r["pairs"] < 0.02 and r["again"] < 0.2),
        vote(r["symbols"] > 0.15, r["symbols"] < 0.02),
        vote(words >= 5 and r["capitals"] > 0.5, r["capitals"] < 0.2),
        vote(r["marks"] > 0.25, r["marks"] < 0.1),
        vote(r["bars"] > 0.2, r["bars"] == 0),
        vote(words >= 30 and s[12] == 0, words >= 5 and 0.01 < r["sentences"] < 0.4),
    ]


class WordFeatures(dict):
    """Hashed features of a word: itself and its beginnings of four to six bytes. Remembered up to a number of words.

    With ``wanted`` (a mask over the buckets) only features in it are given.
    """

    def __init__(self, wanted: np.ndarray | None = None, most: int = 300_000) -> None:
        super().__init__()
        self.wanted, self.most = wanted, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        names = [word, *[b"^" + word[:k] for k in (4, 5, 6) if len(word) > k]]
        found = [xxhash.xxh3_64_intdigest(n) % BUCKETS for n in names]
        value = self[word] = tuple(f for f in found if self.wanted is None or self.wanted[f])
        return value


def features(raw: bytes, r: dict[str, float], words: WordFeatures) -> set[int]:
    """Distinct hashed features of a text: those of its words, and its ratios in steps."""
    steps = (xxhash.xxh3_64_intdigest(b"#%s:%d" % (k.encode(), min(int(v * 16), 16))) % BUCKETS for k, v in r.items())
    return set(steps).union(*map(words.__getitem__, set(alnum_words(raw))))


@dataclass
class VoteModel:
    """Shares of the kinds of documents, and per labeller and kind the chances of its votes.

    Kind 0 is good; every heuristic labeller has one kind of bad documents, those with the fault it looks for. Labellers
    for different faults would contradict each other about a single kind of bad.
    """

    shares: np.ndarray  # kind
    chances: np.ndarray  # labeller, kind, vote

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.shares)[None, :].repeat(len(votes), axis=0)
        for j in range(self.chances.shape[0]):
            logs += np.log(self.chances[j][:, votes[:, j]]).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of bad, for rows of votes."""
        return 1 - self.kinds(votes)[:, 0]


def fit_votes(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 50, smooth: float = 0.5, human_accuracy: float = HUMAN_ACCURACY
) -> VoteModel:
    """Expectation-maximisation over vote patterns with their counts. The last labeller is human: its accuracy is given and
    anchors the others'. It starts from documents being of the kinds whose labellers call them bad."""
    heuristics = votes.shape[1] - 1
    human = np.tile([human_accuracy, 1 - human_accuracy], (heuristics + 1, 1))
    human[1:] = human[1:, ::-1]
    flags = (votes[:, :-1] == BAD).astype(float)
    kinds = np.column_stack([np.where(flags.any(axis=1), 0.1, np.where(votes[:, -1] == BAD, 0.1, 10.0)), flags + 0.02])
    kinds /= kinds.sum(axis=1, keepdims=True)
    model = VoteModel(np.full(heuristics + 1, 1 / (heuristics + 1)), np.full((heuristics + 1, heuristics + 1, 3), 1 / 3))
    for _ in range(rounds if counts.sum() else 0):
        weight = (kinds * counts[:, None]).T
        chances = np.empty((heuristics + 1, heuristics + 1, 3))
        for j in range(heuristics + 1):
            for v in (NOTHING, GOOD, BAD):
                chances[j, :, v] = weight[:, votes[:, j] == v].sum(axis=1) + smooth
        chances /= chances.sum(axis=2, keepdims=True)
        # Silence tells nothing about the kind: what a labeller says when it speaks is what counts.
        spoken = chances[:, :, 1:] / chances[:, :, 1:].sum(axis=2, keepdims=True)
        spoken[-1] = human
        chances[:, :, 1:] = spoken * 0.5
        chances[:, :, NOTHING] = 0.5
        shares = weight.sum(axis=1) + smooth
        model = VoteModel(shares / shares.sum(), chances)
        kinds = model.kinds(votes)
    return model


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def probability(self, rows: Sequence[set[int]]) -> np.ndarray:
        margins = [self.bias + float(self.weights[list(r)].sum()) for r in rows]
        return 1 / (1 + np.exp(-np.array(margins, float)))


@dataclass
class Sample:
    """Feature numbers of the sampled documents, one after the other, and how many each has."""

    column: np.ndarray
    lengths: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def any(self, mask: np.ndarray) -> np.ndarray:
        """Whether each document has a feature of ``mask``."""
        return np.bincount(self.rows()[mask[self.column]], minlength=len(self.lengths)) > 0


def fit_linear(sample: Sample, target: np.ndarray, penalty: float = 1e-3, rounds: int = 200, least: int = 3) -> Linear:
    """Sparse logistic regression on soft labels: features that tell the classes apart, weighted by accelerated proximal steps."""
    weights = np.zeros(BUCKETS, np.float32)
    n = len(sample.lengths)
    rate = float(np.clip(target.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(rate / (1 - rate)))
    if not n:
        return Linear(weights, bias)
    column, row = sample.column, sample.rows()
    often = np.bincount(column, minlength=BUCKETS)
    mass = np.bincount(column, target[row], BUCKETS)
    z = (mass - often * rate) / np.sqrt(np.maximum(often * rate * (1 - rate), 1e-9))
    chosen = (np.abs(z) > 4) & (often >= least)
    use = chosen[column]
    index = np.cumsum(chosen) - 1
    column, row = index[column[use]], row[use]
    k = int(chosen.sum())
    if not k:
        return Linear(weights, bias)
    scale = np.sqrt(n / often[chosen])  # rare features learn as fast as common ones
    value = scale[column]

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[column] * value, n)

    def backward(e: np.ndarray) -> np.ndarray:
        return np.bincount(column, e[row] * value, k) / n

    probe = np.ones(k)
    for _ in range(15):  # largest eigenvalue of the second moments, which bounds the step
        probe = backward(forward(probe / np.linalg.norm(probe)))
    step = 3.5 / (np.linalg.norm(probe) + 1)
    w, ahead, t, bias_ahead = np.zeros(k), np.zeros(k), 1.0, bias
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(bias_ahead + forward(ahead), -30, 30))) - target
        moved = ahead - step * backward(error)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_bias = bias_ahead - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / nt * (new - w), new_bias + (t - 1) / nt * (new_bias - bias)
        w, bias, t = new, new_bias, nt
    weights[np.flatnonzero(chosen)] = w * scale
    return Linear(weights, float(bias))


def learned_words(
    sample: Sample, labels: np.ndarray, least: int = 3, least_share: float = 0.02, lift: float = 40.0
) -> np.ndarray:
    """Features that human-labelled bad documents have far more often than good ones, as a mask over the buckets. Rarer
    ones than ``least`` documents or ``least_share`` of the bad ones may come from copies of one text."""
    n_bad, n_good = int((labels == 1).sum()), int((labels == 0).sum())
    if not n_bad:
        return np.zeros(BUCKETS, bool)
    label = labels[sample.rows()]
    in_bad = np.bincount(sample.column[label == 1], minlength=BUCKETS)
    in_good = np.bincount(sample.column[label == 0], minlength=BUCKETS)
    return (in_bad >= max(least, least_share * n_bad)) & ((in_bad / n_bad) / ((in_good + 0.5) / max(n_good, 1)) >= lift)


def fit_scorers(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    most_train_rows: int = MOST_TRAIN_ROWS,
) -> list[Linear]:
    """Scorers of bad quality and of toxicity.

    Weights are fitted on at most ``most_train_rows`` documents, labelled ones first, the same on every run; the counts of
    vote patterns, from which the labellers' accuracies come, cover all documents.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    human = labels.groupBy(F.col(id_col).alias("of_id")).agg(
        F.max(quality_col).cast("int").alias("quality"), F.max(toxic_col).cast("int").alias("toxic")
    )
    ids = own.select("id").where("id is not null").distinct().join(human, F.col("id") == F.col("of_id"), "left")
    sample_ids = ids.orderBy(F.coalesce("quality", "toxic").isNull(), F.xxhash64("id"), "id").limit(most_train_rows)
    # At most most_train_rows ids: small by construction.
    sample_ids = F.broadcast(stored(sample_ids.select(F.col("id").alias("sample_id"), "quality", "toxic"), "classifier-sample"))

    def featured(texts):
        words = WordFeatures()
        votes, insults, found = [], [], []
        for raw in texts:
            raw = raw or b""
            s = statistics_of(raw)
            r = ratios(raw, s)
            votes.append(quality_votes(s, r))
            insults.append(BAD if INSULTS.search(raw.lower()) else NOTHING)
            found.append(sorted(features(raw, r, words)))
        return [votes, insults, found]

    # One row of each id, whatever repeats it: the text of the smallest hash (and of those that share it, the smallest).
    one = F.min(F.struct(F.xxhash64("body").alias("hash"), "body"))
    picked = own.join(sample_ids, F.col("id") == F.col("sample_id")).groupBy("id").agg(one.alias("one"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    picked = picked.select("id", "quality", "toxic", F.col("one.body").alias("body")).orderBy("id")
    made = map_texts(picked, ["id", "quality", "toxic"], "body", featured, "votes array<int>, insults int, found array<int>").toArrow()
    whole = lambda name: np.array([-1 if v is None else v for v in made.column(name).to_pylist()], int)
    lists = made.column("found").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sample = Sample(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64))
    quality, toxic, insults = whole("quality"), whole("toxic"), whole("insults")
    lexicon = learned_words(sample, toxic)

    remembered: list[WordFeatures] = []  # one per task

    def voted(texts):
        if not remembered:
            remembered.append(WordFeatures(lexicon))
        out = []
        for raw in texts:
            raw = raw or b""
            s = statistics_of(raw)
            insult = BAD if INSULTS.search(raw.lower()) else NOTHING
            learned = BAD if any(map(remembered[0].__getitem__, set(alnum_words(raw)))) else GOOD
            out.append([*quality_votes(s, ratios(raw, s)), insult, learned])
        return [out]

    n_quality = len(QUALITY_LABELLERS)
    votes = stored(map_texts(own, ["id"], "body", voted, "votes array<int>"), "classifier-votes")
    as_vote = lambda c, bad: F.when(c.isNull(), NOTHING).when(c == bad, BAD).otherwise(GOOD)
    voted_all = votes.join(human, F.col("id") == F.col("of_id"), "left").select(
        F.array(*[F.col("votes")[j] for j in range(n_quality)], as_vote(F.col("quality"), 0)).alias("q"),
        F.array(*[F.col("votes")[n_quality + j] for j in range(len(TOXIC_LABELLERS))], as_vote(F.col("toxic"), 1)).alias("t"),
    )
    models = {}
    for name in ("q", "t"):
        patterns = voted_all.groupBy(name).count().toPandas()  # at most 3 to the power of the labellers
        width = n_quality + 1 if name == "q" else len(TOXIC_LABELLERS) + 1
        table_ = np.array(patterns[name].tolist(), int).reshape(-1, width)
        models[name] = fit_votes(table_, patterns["count"].to_numpy(float))

    def human_votes(values: np.ndarray, bad: int) -> np.ndarray:
        return np.where(values < 0, NOTHING, np.where(values == bad, BAD, GOOD))

    given = np.array(made.column("votes").to_pylist(), int).reshape(-1, n_quality)
    q_votes = np.column_stack([given, human_votes(quality, 0)])
    t_votes = np.column_stack([insults, np.where(sample.any(lexicon), BAD, GOOD), human_votes(toxic, 1)])
    return [fit_linear(sample, models[name].posterior(v)) for name, v in (("q", q_votes), ("t", t_votes))]


def score(docs: DataFrame, scorers: list[Linear], keep: list[str], text_col: str, threshold: float) -> DataFrame:
    used = np.any([s.weights != 0 for s in scorers], axis=0)
    remembered: list[WordFeatures] = []  # one per task

    def fn(texts):
        if not remembered:
            remembered.append(WordFeatures(used))
        found = [features(raw or b"", ratios(raw or b"", statistics_of(raw)), remembered[0]) for raw in texts]
        bad, toxic = (s.probability(found) for s in scorers)
        return [bad, toxic, (bad < threshold) & (toxic < threshold)]

    return map_texts(docs, keep, text_col, fn, "__bad double, __toxic double, __kept boolean")


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options
) -> DataFrame:
    """One row per row of ``docs``: probabilities of bad quality and of toxicity, and ``kept`` (both below ``threshold``).

    ``labels`` has 1 for good quality and 1 for toxic; nulls and missing rows are no votes, of repeated ids the larger
    value counts. Null and empty texts have no features but their ratios, all zero. Repeated rows are scored each; other
    columns do not matter; an empty table gives none.
    """
    scorers = fit_scorers(docs, labels, id_col, text_col, **options)
    scored = score(docs, scorers, [id_col], text_col, threshold)
    return scored.select(
        F.col(f"`{id_col}`"), F.col("__bad").alias("p_bad"), F.col("__toxic").alias("p_toxic"), F.col("__kept").alias("kept")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options
) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    scorers = fit_scorers(docs, labels, id_col, text_col, **options)
    scored = score(packed(docs, body=F.col(f"`{text_col}`")), scorers, ["row"], "body", threshold)
    return scored.where("__kept").select(*unpacked("row", docs.columns))
