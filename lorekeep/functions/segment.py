"""Word segmentation of scripts that are written without spaces (survey P14).

A run of such a script is cut by a unigram lattice: every known word that stands at a place is an edge with the logarithm of its share, a
single character is always one, and the best path (Viterbi) gives the words.  Counts are learned from the table itself: the character n-grams of
its runs, cut anew with what was learned before, for a few rounds (hard expectation-maximisation); n-grams that are hardly more frequent than
their parts would make them, are no words.  The vocabulary is bounded (``most``), so it can be broadcast; index and query use the same one.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import STOP_WORDS, UNSPACED, WORD

_RUN = regex.compile(UNSPACED.replace("Is", "") + "+")
_WORD = regex.compile(WORD)
LONGEST = 4
#: Logarithm of the share of a character that was never seen.
UNKNOWN = -18.0


@dataclass
class Segmenter:
    shares: dict[str, float]  # logarithms

    def cut(self, run: str) -> list[str]:
        """The words of a run on the best path; of equally good ones that with the longer last word."""
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for begin in range(max(0, end - LONGEST), end):
                word = run[begin:end]
                share = self.shares.get(word, UNKNOWN if end - begin == 1 else None)
                if share is not None and best[begin] + share > best[end]:
                    best[end], back[end] = best[begin] + share, begin
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, text: str | None) -> list[str]:
        """As ``text.tfidf_tokens``, but with words in place of single characters."""
        low = unicodedata.normalize("NFC", text or "").lower()
        spaced = _RUN.sub(lambda m: " " + " ".join(self.cut(m[0])) + " ", low)
        return [t for t in _WORD.findall(spaced) if (2 <= len(t) <= 40 or _RUN.fullmatch(t)) and t not in STOP_WORDS]

    @staticmethod
    def learn(docs: DataFrame, body: str = "body", most: int = 50_000, rounds: int = 3, least: int = 3) -> Segmenter:
        """Counts of candidate words over all rows; only the ``most`` frequent candidates reach the driver."""
        runs = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(f"({UNSPACED}+)"), F.lit(1))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))

        def counted(words) -> dict[str, int]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    found: Counter[str] = Counter()
                    for text, n in zip(b.column("run").to_pylist(), b.column("n").to_pylist(), strict=True):
                        for w in words(text):
                            found[w] += n
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

            rows = runs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))
            return {r.word: r.n for r in rows.orderBy(F.desc("n"), "word").limit(most).collect()}

        counts = counted(lambda t: [t[i : i + k] for k in range(1, LONGEST + 1) for i in range(len(t) - k + 1)])
        single = sum(n for w, n in counts.items() if len(w) == 1)
        share = {w: n / single for w, n in counts.items()}
        # A word is more frequent than chance makes its two parts stand together.
        known = {w: n for w, n in counts.items() if len(w) == 1 or all(share[w] > 4 * share.get(w[:i], 1) * share.get(w[i:], 1) for i in range(1, len(w)))}
        for _ in range(rounds):
            own = Segmenter._of(known)
            known = counted(own.cut)
        return Segmenter._of(known)

    @staticmethod
    def _of(counts: dict[str, int]) -> Segmenter:
        total = sum(counts.values())
        return Segmenter({w: math.log(n / total) for w, n in counts.items()})


def term_counts(docs: DataFrame, segmenter: Segmenter, key: str = "path", body: str = "body") -> DataFrame:
    """(doc, term, tf) for a cosine index, cut with the segmenter."""
    shared = docs.sparkSession.sparkContext.broadcast(segmenter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, terms = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                own = shared.value.tokens(text)
                rows += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string())], names=["doc", "term"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, body).mapInArrow(run, f"doc {kind}, term string").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
