"""Many words at once (survey A19, R1) and substrings by trigrams (R3).

``AhoCorasick`` counts every occurrence of hundreds of words, overlapping ones too, in one pass over each text, whatever the words have in
common.  The automaton is built on the driver from the words (its size is bounded by their letters) and broadcast.

The trigram index has, for every three letters in a row, the keys of the texts that hold them.  A substring search intersects the
keys of the query's trigrams and looks for the substring in the texts that are left.  Queries of fewer than three letters are answered by a
scan.  Texts are lower-cased; null and empty texts and words are in no result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import text_blocks


class AhoCorasick:
    def __init__(self, words: list[str]) -> None:
        self.words = list(dict.fromkeys(w.lower() for w in words if w))
        #: Transitions, and the words that end at each state: its own and those of the states it falls back to.
        self.step: list[dict[str, int]] = [{}]
        own: list[list[int]] = [[]]
        for number, word in enumerate(self.words):
            s = 0
            for c in word:
                if c not in self.step[s]:
                    self.step[s][c] = len(self.step)
                    self.step.append({})
                    own.append([])
                s = self.step[s][c]
            own[s].append(number)
        self.fall = [0] * len(self.step)
        self.ends: list[tuple[int, ...]] = [()] * len(self.step)
        waiting = deque(self.step[0].values())
        while waiting:
            s = waiting.popleft()
            self.ends[s] = (*own[s], *self.ends[self.fall[s]])
            for c, t in self.step[s].items():
                f = self.fall[s]
                while f and c not in self.step[f]:
                    f = self.fall[f]
                self.fall[t] = self.step[f].get(c, 0)
                waiting.append(t)

    def counts(self, text: str) -> dict[int, int]:
        """Occurrences by the number of the word."""
        out: dict[int, int] = {}
        s, step, fall, ends = 0, self.step, self.fall, self.ends
        for c in text.lower():
            while s and c not in step[s]:
                s = fall[s]
            s = step[s].get(c, 0)
            for number in ends[s]:
                out[number] = out.get(number, 0) + 1
        return out


def word_counts(docs: DataFrame, words: list[str], key: str = "path", body: str = "body") -> DataFrame:
    """(key, word, count) of the words that stand in each text, overlapping occurrences counted."""
    shared = docs.sparkSession.sparkContext.broadcast(AhoCorasick(words))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, word string, count long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            rows, names, counts = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for number, n in machine.counts(text or "").items():
                    rows.append(i)
                    names.append(machine.words[number])
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=[key, "word", "count"])

    return docs.select(key, body).mapInArrow(run, schema)


def search_words(docs: DataFrame, queries: DataFrame, mode: str = "all", limit: int = 25, key: str = "path", body: str = "body") -> DataFrame:
    """(query_id, key, score, rank): the substring search of each of a table of queries (query_id, query) in one pass over the texts.

    The score sums the occurrences of the query's words, a word that the query repeats counting again; ``all`` needs every word, ``any`` one."""
    from pyspark.sql import Window

    words = queries.select("query_id", F.explode(F.split(F.lower("query"), r"\s+")).alias("word")).where("word <> ''").groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("times"))
    distinct = [r.word for r in words.select("word").distinct().orderBy("word").collect()]  # of the queries, not of the texts
    found = word_counts(docs, distinct, key, body).join(words, "word").groupBy("query_id", key).agg(F.sum(F.col("count") * F.col("times")).alias("score"), F.count(F.lit(1)).alias("had"))
    if mode == "all":
        needed = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
        found = found.join(needed, "query_id").where("had = needed")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", key, "score", "rank")


# ---- trigrams -------------------------------------------------------------------------------------------


def trigram_index(docs: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(gram, keys): the keys of the texts that hold a gram, one row a gram and slice of texts; to be stored as it comes, sorted by gram in each slice."""
    return text_blocks.grams(docs, key, body)


def trigram_search(index: DataFrame, docs: DataFrame, query: str, key: str = "path", body: str = "body", most_sent: int = 1_000_000) -> DataFrame:
    """(key, places) of all texts that hold ``query``, ignoring case; a row for each text, whatever keys they share.

    Grams that overlap by two letters say the same twice, so every third one and the last are taken.  Texts that have all of them are looked through;
    up to ``most_sent`` of their keys are sent to where the texts are, more are joined as any table."""
    low = query.lower()
    if not low:
        return docs.limit(0).select(key, F.array().cast("array<int>").alias("places"))
    if len(low) < 3:
        return text_blocks.places(docs, low, key, body)
    grams = sorted({low[o : o + 3] for o in (*range(0, len(low) - 2, 3), len(low) - 3)})
    held = index.where(F.col("gram").isin(grams)).select("gram", F.explode("keys").alias("held"))
    found = stored(held.groupBy("held").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("held"), "trigram-found")
    few = F.broadcast(found) if found.count() <= most_sent else found
    kept = docs.select(key, body).join(few, F.col(key).eqNullSafe(F.col("held")), "left_semi")
    return text_blocks.places(kept, low, key, body)
