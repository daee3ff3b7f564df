"""Quality rules: base counts of a text and a line-labelling verdict.

The verdict comes from a linear-chain conditional random field over the lines of a document.  Each
line that has a word is a position; its features are shares of character classes, length, closing
punctuation and repetition; Viterbi decoding marks every line as content or boilerplate, and the
document is retained when at least ``min_content_share`` of its words stand in content lines.

The field is trained by maximum likelihood (forward-backward, gradient ascent with momentum) on a
bounded sample of labelled documents: at most ``MAX_TRAINING_DOCS`` rows of ``labels`` with a
non-null quality, those of smallest ``xxhash64(doc_id)``, with their whole texts (of a doc_id that has
several, the least).  Long texts are cut into chains of ``CHAIN`` lines, and every document weighs alike in its class.

Defined results: a null or empty text has no words, all counts are 0 and it is rejected by the base
rule; a null doc_id is passed through; rows that repeat are judged alike; an empty table gives no
rows; without any labelled row of either class the method keeps whatever passes the base rule;
columns of other names are ignored (``judge`` keeps all columns of its input, and its own columns
replace those of the same name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import table

MAX_TRAINING_DOCS = 1000
CHAIN = 24
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_CONTENT_SHARE = 0.5


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[[ord(c) for c in chars]] = True
    return m


SYMBOL = _mask("#*$%&|<>")
LOUD = _mask("!?") | SYMBOL
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
CLOSING = _mask(".!?:;\"')")
TAIL = np.zeros(256, dtype=bool)  # UTF-8 continuation bytes
TAIL[128:192] = True
N_FEATURES = 13


def _counts(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[b] - total[a]


def _repeated(word: np.ndarray, ptr: np.ndarray, window: int) -> np.ndarray:
    """Marks the words that stand in a window found twice or more in their row."""
    marked = np.zeros(len(word) + 1, dtype=np.int32)
    every = K.runs(word, window)
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a > window:
            own = every[a : b - window + 1]
            ordered = np.sort(own)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                at = a + np.flatnonzero(np.isin(own, twice))
                np.add.at(marked, at, 1)
                np.add.at(marked, at + window, -1)
    return np.cumsum(marked[:-1]) > 0


def analyse(column: pa.Array) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of rows: the base counts; features, number of words and row pointers of the lines that have a word."""
    data_all, off_all = K.utf8(column)
    for lo, hi in K.blocks(off_all):
        data, off = data_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
        word, ws, we, ptr = K.words(data, off)
        repeated = _repeated(word, ptr, WINDOW)
        rep_total = np.concatenate([[0], np.cumsum(repeated)])
        cut = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([off[:-1], cut + 1]))
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        if len(starts) == 0:
            starts = ends = np.zeros(0, dtype=np.int64)
        w_from, w_to = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
        has = w_to > w_from
        starts, ends, w_from, w_to = starts[has], ends[has], w_from[has], w_to[has]
        body_end = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10) if len(data) else 0)
        line_ptr = np.searchsorted(starts, off)
        line_ptr[-1] = len(starts)
        line_hash = np.zeros(0, K.U64)
        if len(starts):
            line_hash = K.span_hasher(data)(starts, body_end)
        earlier = np.zeros(len(starts), dtype=bool)
        for a, b in zip(line_ptr[:-1].tolist(), line_ptr[1:].tolist(), strict=True):
            if b - a > 1:
                _, first = np.unique(line_hash[a:b], return_index=True)
                if len(first) < b - a:
                    earlier[a:b] = True
                    earlier[a + first] = False
        n_words = (w_to - w_from).astype(np.float64)
        chars = _counts(~(K.SPACE | TAIL)[data], starts, ends)
        size = np.maximum(chars, 1).astype(np.float64)
        last = data[we[w_to - 1] - 1] if len(starts) else data[:0]
        loud, letters = _counts(LOUD[data], starts, ends) / size, np.maximum(_counts((LETTER & ~TAIL)[data], starts, ends), 1)
        loud_words = np.zeros(len(ws) + 1, dtype=np.int64)
        if len(ws):
            np.cumsum(LOUD[data[we - 1]], out=loud_words[1:])
        features = np.zeros((len(starts), N_FEATURES))
        for k, f in enumerate((
            1.0, np.minimum(loud * 5, 2), (loud_words[w_to] - loud_words[w_from]) / np.maximum(n_words, 1), _counts(UPPER[data], starts, ends) / letters,
            _counts(DIGIT[data], starts, ends) / size, (rep_total[w_to] - rep_total[w_from]) / np.maximum(n_words, 1), CLOSING[last].astype(float), n_words < 4, n_words >= 12,
            np.minimum(chars / np.maximum(n_words, 1) / 10, 2), earlier, _counts((data == 124), starts, ends) / np.maximum(n_words, 1), (last == 124),
        )):
            features[:, k] = f
        row = {
            "n_words": np.diff(ptr), "word_chars": _counts(~(K.SPACE | TAIL)[data], off[:-1], off[1:]), "n_symbols": _counts(SYMBOL[data], off[:-1], off[1:]),
            "n_dup_lines": _counts(earlier, line_ptr[:-1], line_ptr[1:]), "n_repeat_words": rep_total[ptr[1:]] - rep_total[ptr[:-1]],
        }
        yield row, features, n_words, line_ptr


class LineField:
    """A two-label linear-chain conditional random field; label 1 is content."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None) -> None:
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def fit(self, features: list[np.ndarray], labels: list[int], steps: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> LineField:
        """Every line of a document bears the document's label; both classes weigh alike."""
        known = [(x, y) for x, y in zip(features, labels, strict=True) if len(x)]
        in_class = {k: sum(y == k for _, y in known) for k in (0, 1)}
        if not all(in_class.values()):
            return self
        chains = [(f[at : at + CHAIN], y, 0.5 / in_class[y] / len(f)) for f, y in known for at in range(0, len(f), CHAIN)]
        n, length = len(chains), max(len(f) for f, _, _ in chains)
        x, on, y, share = np.zeros((length, n, N_FEATURES)), np.zeros((length, n), dtype=bool), np.array([y for _, y, _ in chains]), np.array([w for _, _, w in chains])
        for i, (f, _, _) in enumerate(chains):
            x[: len(f), i], on[: len(f), i] = f, True
        gold = np.stack([(y == 0), (y == 1)], 1).astype(float)
        speed_e, speed_m = np.zeros_like(self.emit), np.zeros_like(self.move)
        for _ in range(steps):
            score = np.where(on[..., None], x @ self.emit, 0.0)
            ahead, back = np.zeros((length, n, 2)), np.zeros((length, n, 2))
            ahead[0] = score[0]
            for t in range(1, length):
                step = np.logaddexp(ahead[t - 1][:, :1] + self.move[0], ahead[t - 1][:, 1:] + self.move[1]) + score[t]
                ahead[t] = np.where(on[t][:, None], step, ahead[t - 1])
            whole = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
            for t in range(length - 2, -1, -1):
                nxt = back[t + 1] + score[t + 1]
                step = np.logaddexp(self.move[:, 0] + nxt[:, :1], self.move[:, 1] + nxt[:, 1:])
                back[t] = np.where(on[t + 1][:, None], step, 0.0)
            belief = np.exp(ahead + back - whole[:, None]) * on[..., None]
            diff = (gold * on[..., None] - belief) * share[:, None]
            grad_e = np.einsum("tnf,tnk->fk", x, diff) - ridge * self.emit
            pair = ahead[:-1][..., :, None] + self.move + (score[1:] + back[1:])[..., None, :] - whole[:, None, None]
            both = (np.exp(np.minimum(pair, 0)) * on[1:][..., None, None] * share[:, None, None]).sum((0, 1))
            seen = np.zeros((2, 2))
            for k in (0, 1):
                seen[k, k] = (on[1:][:, y == k] * share[y == k]).sum()
            speed_e, speed_m = 0.9 * speed_e + rate * grad_e, 0.9 * speed_m + rate * (seen - both - ridge * self.move)
            self.emit, self.move = self.emit + speed_e, self.move + speed_m
        return self

    def decode(self, features: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest label of every line, row by row."""
        score = features @ self.emit
        gain = score.tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        out = np.zeros(len(features), dtype=bool)
        for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
            if a == b:
                continue
            s0, s1 = gain[a]
            came = []
            for g0, g1 in gain[a + 1 : b]:
                c0, c1 = s1 + m10 > s0 + m00, s1 + m11 >= s0 + m01
                came.append((c0, c1))
                s0, s1 = (s1 + m10 if c0 else s0 + m00) + g0, (s1 + m11 if c1 else s0 + m01) + g1
            state = s1 >= s0
            for i in range(b - 1, a - 1, -1):
                out[i] = state
                if i > a:
                    state = came[i - a - 1][state]
        return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> LineField:
    """Fit on the bounded sample described above."""
    sample = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).toArrow()
    order = np.lexsort((rows["quality"].to_numpy(zero_copy_only=False), rows["doc_id"].to_numpy(zero_copy_only=False))) if len(rows) else np.zeros(0, int)
    rows = rows.take(pa.array(order))
    features: list[np.ndarray] = []
    for _, f, _, ptr in analyse(rows["text"].combine_chunks().cast(pa.large_string()) if len(rows) else pa.array([], pa.large_string())):
        features += [f[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return LineField().fit(features, [int(q) for q in rows["quality"].to_pylist()])


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "content_share": "double", "kept": "boolean"}


def measure(column: pa.Array, field: LineField, min_share: float = MIN_CONTENT_SHARE) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [] for k in COLUMNS}
    for row, features, n_words, ptr in analyse(column):
        content = np.concatenate([[0], np.cumsum(np.where(field.decode(features, ptr), n_words, 0))])
        total = np.maximum(row["n_words"], 1)
        row["content_share"] = (content[ptr[1:]] - content[ptr[:-1]]) / total
        row["base_failed"] = (row["n_words"] < MIN_WORDS) | (100 * row["n_repeat_words"] > MAX_REPEAT_PERCENT * row["n_words"])
        row["kept"] = ~row["base_failed"] & (row["content_share"] >= min_share)
        for k, v in row.items():
            parts[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}


def judge(docs: DataFrame, field: LineField, min_share: float = MIN_CONTENT_SHARE, keep_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with the base counts, the content share and the verdict; ``keep_text=False`` leaves the text out."""
    own = [c for c in docs.columns if c not in COLUMNS]
    shown = [c for c in own if keep_text or c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in shown] + [f"{k} {v}" for k, v in COLUMNS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure(b.column("text"), field, min_share)
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([b.column(c) for c in shown] + [pa.array(got[k], type=kinds[v]) for k, v in COLUMNS.items()], names=[*shown, *COLUMNS])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")), keep_text=False)


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; all others stay as they are, with all their columns.

    A null or empty text has no words, so it goes; rows that repeat are judged alike; a null doc_id changes nothing; an empty table stays empty.  The field is trained on
    the whole ``documents`` table, not on what the stage is given."""
    field = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    aside = {c: f"own {c}" for c in docs.columns if c in COLUMNS}
    kept = judge(docs.withColumnsRenamed(aside), field).where("kept")
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
