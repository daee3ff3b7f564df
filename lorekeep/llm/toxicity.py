"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Text is folded to a stream of codes: letters by lower case, everything between two letters one gap code.
A stretch is ``WIDTH`` codes in a row, over the borders of words, so that an insult may be spelled out
(``i d i o t``; letters that stand alone fold to a word), cut (``id-iot``) or have characters put in (``idxiot``).  The kernel of two
stretches counts the subsequences of four codes that they share, each weighed ``DECAY`` to the power of the
codes it spans, up to ``MAX_SPAN`` (longer ones weigh next to nothing).  A sentence, and a text, is as
toxic as its strongest stretch.

Landmarks are words of labelled documents: those whose share of toxic documents differs most from that of
clean ones, and the most frequent clean ones.  With K the kernel among landmarks, the Nystroem map of a stretch is its kernel with
each landmark times K^-1/2; a linear machine is trained on it.  As the decision is linear in the
kernel, it folds back into one table of weights by subsequence, and whole texts are scored by a table look-up for
each start and gap pattern, with running sums: time linear in the text, memory bounded by ``SLICE`` codes.

Training looks at labelled sentences only: stretches are mined from the documents of a bounded sample (``TOXIC_DOCS`` and ``CLEAN_DOCS`` documents of
smallest hash that are labelled and whose ``crc32(doc_id as text) mod 5`` is not 0) on the executors.  In each of ``ROUNDS`` rounds a toxic
document gives its strongest stretch and those of its ``HARDEST`` strongest that
are stronger than nearly all clean documents (which of its sentences are toxic is latent), and a clean one its ``HARDEST`` strongest, so the driver sees
``ROUNDS`` * ``HARDEST`` * (``TOXIC_DOCS`` + ``CLEAN_DOCS``) stretches of ``WIDTH`` bytes at most (and makes virtual examples of them: their longest words with a gap or a
character put in).  The scale of the score comes from documents scored by machines that were trained without them.

Defined results: null and empty texts are scored as one long gap; a null doc_id is never held out and never trains; null labels and those of
doc_ids with both labels train nothing; repeated rows are scored alike; without a toxic and a clean training document every score is the
share of toxic ones (0 without any); an empty table gives no rows; columns of other names are ignored; letters beyond U+FFFF count as gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, table

TOXIC_DOCS, CLEAN_DOCS = 1500, 2500
WIDTH = 10
ORDER = 4
MAX_SPAN = 7
DECAY = 0.5
LANDMARKS = 256
ROUNDS = 4
HARDEST = 3
#: A stretch of a toxic document is believed to be toxic if it is stronger than this share of clean documents.
SURE = 0.99
FOLDS = 4
PENALTY = 100.0
#: What a virtual example weighs.
VIRTUAL = 0.2
#: Places at which a toxic stretch is cut for them.
CUTS = 3
RIDGE = 0.1
SLICE = 1 << 20
BITS = 5
#: Offsets of a subsequence's codes from its first.
PATTERNS = [(0, *c) for c in combinations(range(1, MAX_SPAN), ORDER - 1)]


def _codes() -> np.ndarray:
    """Code of each character up to U+FFFF: 1-26 for a-z, 27-31 for other letters, 0 for what is no letter; the last entry is for all others."""
    out = np.zeros(0x10001, dtype=np.uint8)
    for c in range(0x10000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 5
    return out


CODES = _codes()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def folded(text: str | None) -> np.ndarray:
    """Codes of a text; gaps of any length are one code, and letters that stand alone one after the other are one word."""
    parts = [np.zeros(0, np.uint8)]
    for i in range(0, len(text or ""), SLICE):
        points = np.frombuffer(text[i : i + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(CODES[np.minimum(points, 0x10000)])
    codes = np.concatenate(parts)
    codes = codes[(codes != 0) | np.concatenate([[False], codes[:-1] != 0])[: len(codes)]]
    gap = np.concatenate([[True, True], codes == 0, [True, True]])
    alone = gap[1:-3] & ~gap[2:-2] & gap[3:-1]
    return codes[~(gap[2:-2] & np.concatenate([[False], alone[:-1]])[: len(codes)] & np.concatenate([alone[1:], [False]])[: len(codes)])]


def stretch_scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted subsequences of every stretch of ``codes``."""
    n = len(codes) - WIDTH + 1
    at = codes.astype(np.int32)
    pairs = {b: (at[: len(at) - b] << BITS) + at[b:] for b in range(1, MAX_SPAN - 2)}
    heads = {b: p << (2 * BITS) for b, p in pairs.items()}
    total = np.zeros(n)
    for span in range(ORDER, MAX_SPAN + 1):
        size = len(at) - span + 1
        found = np.zeros(size, dtype=np.float32)
        for _, b, c, d in PATTERNS:
            if d == span - 1:
                found += weights[heads[b][:size] + pairs[d - c][c : c + size]]
        run = np.concatenate([[0.0], np.cumsum(found, dtype=np.float64)])
        total += DECAY**span * (run[WIDTH - span + 1 :][:n] - run[:n])
    return total


def texts_scores(texts: list[str | None], weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, codes, scores of its stretches), in slices; each text stands between gaps as long as a stretch."""
    edge = np.zeros(WIDTH, np.uint8)
    for i, text in enumerate(texts):
        codes = np.concatenate([edge, folded(text), edge])
        for a in range(0, len(codes) - WIDTH + 1, SLICE):
            piece = codes[a : a + SLICE + WIDTH - 1]
            yield i, piece, stretch_scores(piece, weights)


def strongest(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The score of each text.  Short texts are worked on together, with gaps between them."""
    out, held, at, size = np.full(len(texts), -np.inf), [], [], 0
    edge = np.zeros(WIDTH, np.uint8)

    def flush() -> None:
        if held:
            scores = stretch_scores(np.concatenate([*held, edge]), weights)
            begins = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            out[at] = np.maximum.reduceat(scores, begins)
            held.clear()
            at.clear()

    for i, text in enumerate(texts):
        if len(text or "") > SLICE // 4:
            for _, _, scores in texts_scores([text], weights):
                out[i] = max(out[i], scores.max())
            continue
        codes = np.concatenate([edge, folded(text)])
        held.append(codes)
        at.append(i)
        size += len(codes)
        if size > SLICE // 4:
            flush()
            size = 0
    flush()
    return out


def subsequences(stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From rows of codes the numbers of their subsequences and their weights, row by row."""
    numbers, weights, at = [], [], stretches.astype(np.int32)
    for offsets in PATTERNS:
        for i in range(stretches.shape[1] - offsets[-1]):
            number = np.zeros(len(at), np.int32)
            for o in offsets:
                number = (number << BITS) + at[:, i + o]
            numbers.append(number)
            weights.append(DECAY ** (offsets[-1] + 1))
    return np.stack(numbers, axis=1), np.array(weights)


class Kernel:
    """The landmarks' subsequences, by the number of the subsequence."""

    def __init__(self, landmarks: np.ndarray) -> None:
        numbers, weights = subsequences(landmarks)
        self.used = np.unique(numbers)
        self.used = self.used[self.used != 0]  # gaps only
        self.place = np.full(1 << (BITS * ORDER), len(self.used), dtype=np.int32)
        self.place[self.used] = np.arange(len(self.used))
        self.table = np.zeros((len(self.used) + 1, len(landmarks)))
        for row, n in enumerate(numbers):
            np.add.at(self.table[:, row], self.place[n], weights)
        self.table[-1] = 0
        values, vectors = np.linalg.eigh(self.table.T @ self.table)
        fine = values > 1e-6 * values.max()
        self.root = vectors[:, fine] / np.sqrt(values[fine])

    def map(self, stretches: np.ndarray) -> np.ndarray:
        """The Nystroem map of rows of codes."""
        out = np.zeros((len(stretches), self.table.shape[1]))
        for a in range(0, len(stretches), 2048):
            numbers, weights = subsequences(stretches[a : a + 2048])
            for n, w in zip(self.place[numbers].T, weights, strict=True):
                out[a : a + 2048] += w * self.table[n]
        return out @ self.root

    def weights(self, direction: np.ndarray) -> np.ndarray:
        """A linear decision on the map as one weight for each subsequence."""
        out = np.zeros(len(self.place), dtype=np.float32)
        out[self.used] = (self.table @ (self.root @ direction))[:-1]
        return out


def separate(points: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Direction (the last entry is the offset) of a linear machine with squared hinge loss, by Newton's method; both classes weigh alike."""
    x = np.concatenate([points, np.ones((len(points), 1))], axis=1)
    y = np.where(toxic, 1.0, -1.0)
    cost = PENALTY * share * len(y) / 2 / np.where(toxic, max(1, toxic.sum()), max(1, (~toxic).sum()))

    def loss(w: np.ndarray) -> float:
        return float(w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    w, now = np.zeros(x.shape[1]), np.inf
    now = loss(w)
    for _ in range(50):
        inside = y * (x @ w) < 1  # the support vectors
        weighed = x[inside] * (2 * cost[inside])[:, None]
        step = np.linalg.solve(np.eye(len(w)) + weighed.T @ x[inside], weighed.T @ y[inside]) - w
        size = 1.0
        while size > 1e-6 and (then := loss(w + size * step)) >= now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-9 * now:
            break
        w, now = w + size * step, then
    return w


def disguised(stretches: np.ndarray, places: int) -> np.ndarray:
    """Virtual examples: the longest word of each stretch with a gap, and with a character, at ``places`` places inside it."""
    out = np.zeros((2 * places * len(stretches), WIDTH), np.uint8)
    at = 0
    for row in stretches.tolist():
        word = max(bytes(row).split(b"\0"), key=len)
        for place in range(places):
            cut = 1 + (len(word) - 1) * (place + 1) // (places + 1) if places > 1 else (1 + sum(row) % max(1, len(word) - 1))
            for inside in (0, 1 + (sum(row) + place) % 26):
                codes = [0, *word[:cut], inside, *word[cut:], 0][:WIDTH]
                out[at, : len(codes)] = codes
                at += 1
    return out


@dataclass
class Model:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (decisions + self.offset) + self.shift, -700, 700)
        return 1 / (1 + np.exp(-z))


def platt(decisions: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the decisions, by Newton's method, with the targets drawn in for small samples."""
    up, down = toxic.sum(), (~toxic).sum()
    goal = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    spread = decisions.std() or 1.0
    d = decisions / spread
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        gradient = np.array([(d * (p - goal)).sum(), (p - goal).sum()])
        hesse = np.array([[(d * d * s).sum() + 1e-3, (d * s).sum()], [(d * s).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hesse, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / spread, b


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (id, toxic, fold, text) of the training sample; equal texts of a doc_id count once."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    clear = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    key = F.xxhash64("doc_id")
    limits = ((1, TOXIC_DOCS), (0, CLEAN_DOCS))
    chosen = [clear.where(F.col("toxic") == value).orderBy(key, "doc_id").limit(most) for value, most in limits]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # TOXIC_DOCS + CLEAN_DOCS rows
    # Of a doc_id with many texts the least is taken.
    rows = docs.select("doc_id", "text").where("text is not null and doc_id is not null").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select(F.col("doc_id").alias("id"), "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def landmarks(sample: DataFrame, toxic: int, clean: int, most: int = LANDMARKS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes, and how much each leans to toxic."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kinds = [], []
            for text, kind in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = {w[: WIDTH - 2] for w in folded(text).tobytes().split(b"\0")} - {b""}
                found += own
                kinds += [kind] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(kinds, pa.int32())], names=["word", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(words, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    share = (F.col("t") + F.col("c")) / F.lit(toxic + clean)
    lean = (F.col("t") / toxic - F.col("c") / clean) / F.sqrt(share * (1.000001 - share))
    leaning = counts.select("word", lean.alias("lean"), "c")
    far = leaning.orderBy(F.desc("lean"), "word").limit(most // 2).collect()
    usual = leaning.orderBy(F.desc("c"), "word").limit(most // 2).collect()
    rows = {bytes(r.word): r.lean for r in [*usual, *far]}
    out = np.zeros((len(rows), WIDTH), np.uint8)
    for i, w in enumerate(rows):
        out[i, 1 : 1 + len(w)] = np.frombuffer(w, np.uint8)
    return out, np.array(list(rows.values()))


def mined(sample: DataFrame, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The strongest stretches of each document of the sample that do not overlap: id, toxic, fold, codes."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            kinds, ids, folds = (b.column(c).to_pylist() for c in ("toxic", "id", "fold"))
            best: dict[int, list[tuple[float, bytes]]] = {}
            for i, codes, scores in texts_scores(b.column("text").to_pylist(), shared.value):
                scores = scores.copy()
                for _ in range(HARDEST):
                    k = int(scores.argmax())
                    best.setdefault(i, []).append((float(scores[k]), codes[k : k + WIDTH].tobytes()))
                    scores[max(0, k - WIDTH + 1) : k + WIDTH] = -np.inf
            for i, found in best.items():
                top = sorted((f for f in found if f[0] > -np.inf), reverse=True)[:HARDEST]
                rows += [(ids[i], kinds[i], folds[i], s, score, place) for place, (score, s) in enumerate(top)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds_of = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=["id", "toxic", "fold", "codes", "score", "place"])

    found = sample.select(F.col("id").cast("long").alias("id"), "toxic", "fold", "text").mapInArrow(run, "id long, toxic int, fold int, codes binary, score double, place int")
    got = found.orderBy("id", "place").toArrow()
    codes = np.frombuffer(b"".join(got["codes"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    return {"codes": codes, "toxic": got["toxic"].to_numpy().astype(bool)} | {c: got[c].to_numpy() for c in ("fold", "score", "place")}


def believed(found: dict[str, np.ndarray]) -> np.ndarray:
    """Which stretches are examples: all clean ones, the first of each toxic document, and its others if few clean documents have one as strong."""
    first, toxic = found["place"] == 0, found["toxic"]
    bar = np.quantile(found["score"][first & ~toxic], SURE)
    return ~toxic | first | (found["score"] > bar)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = stored(sampled(docs, labels), "toxic-sample")
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    nothing = np.zeros(1 << (BITS * ORDER), np.float32)
    if not (toxic and clean):
        discard(sample)
        return Model(nothing, 0.0, 0.0, 700.0 if toxic else -700.0)
    marks, lean = landmarks(sample, toxic, clean)
    kernel = Kernel(marks)
    own = kernel.map(marks)
    weights = kernel.weights(np.linalg.solve(own.T @ own + RIDGE * np.eye(own.shape[1]), own.T @ lean))  # a first guess: the leaning of words
    rows = np.zeros((0, WIDTH + 2), np.int64)  # codes, label, fold
    for _ in range(ROUNDS):
        found = mined(sample, weights)
        # What seemed toxic earlier may have been a wrong guess; hard clean stretches stay.
        fresh = np.concatenate([found["codes"].astype(np.int64), found["toxic"][:, None], found["fold"][:, None]], axis=1)[believed(found)]
        rows = np.unique(np.concatenate([rows[rows[:, WIDTH] == 0], fresh]), axis=0)
        codes = rows[:, :WIDTH].astype(np.uint8)
        y, fold = rows[:, WIDTH] == 1, rows[:, WIDTH + 1]
        points = kernel.map(np.concatenate([codes, disguised(codes[y], CUTS), disguised(codes[~y], 1)]))
        share = np.where(np.arange(len(points)) < len(rows), 1.0, VIRTUAL)
        y, fold = (np.concatenate([c, np.repeat(c[y], 2 * CUTS), np.repeat(c[~y], 2)]) for c in (y, fold))
        direction = separate(points, y, share)
        weights = kernel.weights(direction[:-1])
    apart = [separate(points[fold != f], y[fold != f], share[fold != f]) for f in range(FOLDS)]
    tables, offsets = np.stack([kernel.weights(w[:-1]) for w in apart]), np.array([w[-1] for w in apart])
    shared = sample.sparkSession.sparkContext.broadcast(tables)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, texts = b.column("fold").to_numpy(), b.column("text").to_pylist()
            got = np.zeros(len(of))
            for f in set(of.tolist()):
                at = np.flatnonzero(of == f)
                got[at] = strongest([texts[i] for i in at], shared.value[f])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("fold"), pa.array(got)], names=["toxic", "fold", "score"])

    got = sample.select("toxic", "fold", "text").mapInArrow(unseen, "toxic int, fold int, score double").toArrow()
    discard(sample)
    slope, shift = platt(got["score"].to_numpy() + offsets[got["fold"].to_numpy()], got["toxic"].to_numpy().astype(bool))
    return Model(weights, float(direction[-1]), slope, shift)


def judge(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with score and predicted, which replace columns of the same name."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("score", "predicted")]
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "score double", "predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            score = own.probability(strongest(b.column("text").to_pylist(), own.weights))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id", "held_out"])
