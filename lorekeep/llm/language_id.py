"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of lower-cased training text.  A text is
encoded, block by block, against every dictionary; the language whose dictionary leaves the fewest
bytes is chosen, and the choice is marked ``rejected`` when its margin over the next is narrow.
Equal sizes go to the language with more training rows, then to the first by name.

Training looks only at ``text`` and ``lang``: the rows that may be used are those whose
``crc32(doc_id as text) mod 4`` is not 2 and whose lang is not null.  The fit is on a bounded sample:
``SAMPLE_ROWS`` rows a language (in each of that many hash buckets of doc_id, the row of smallest
hash; of a doc_id that has several texts the least), of each ``SAMPLE_CHARS`` code points in ``PIECES`` pieces spread evenly from the
beginning of the text to its end, ``DICTIONARY_BYTES`` in all.  The dictionaries travel as
one broadcast, bounded by languages x DICTIONARY_BYTES.  Prediction takes whole texts.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and for every text if
there is no training row; a null doc_id is never held out and never trains; repeated rows are judged
alike; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

SAMPLE_ROWS = 128
SAMPLE_CHARS = 1200
PIECES = 4
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
BLOCK_BYTES = 4096
MIN_MARGIN = 0.01
#: Bits of difference count by this much in the score.
SHARPNESS = 0.5
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> list[tuple[str, int, bytes]]:
    """(language, training rows, dictionary content), in the order in which ties are decided."""
    own = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    key = F.xxhash64("doc_id")
    picked = own.groupBy("lang", F.pmod(key, F.lit(rows)).alias("bucket")).agg(F.min_by("doc_id", key).alias("doc_id"), F.count("*").alias("n")).toArrow().to_pydict()
    counts: dict[str, int] = {}
    for lang, n in zip(picked["lang"], picked["n"], strict=True):
        counts[lang] = counts.get(lang, 0) + n
    texts: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counts}
    ids = sorted(set(picked["doc_id"]))
    if ids:
        size_of_piece, length = chars // PIECES, F.length("text")
        spread = [F.substring(F.col("text"), (1 + (length - size_of_piece) * k / (PIECES - 1)).cast("int"), F.lit(size_of_piece)) for k in range(PIECES)]
        pieces = F.when(length <= chars, F.col("text")).otherwise(F.concat_ws("\n", *spread))
        sampled = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", pieces.alias("text")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
        for r in sampled.collect():
            if r.lang in texts:
                texts[r.lang].append((r.doc_id, r.text))
    out = []
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        share = max(1, size // max(1, len(texts[lang])))
        parts = [_spread(t.lower().encode(), max(share, 200)) for _, t in sorted(texts[lang])]
        out.append((lang, counts[lang], b"\n".join(parts)[:size]))
    return [x for x in out if len(x[2]) >= 8]


def _spread(data: bytes, size: int) -> bytes:
    """At most ``size`` bytes, in pieces from the beginning to the end."""
    if len(data) <= size:
        return data
    piece = size // PIECES
    return b"".join([data[(len(data) - piece) * k // (PIECES - 1) :][:piece] for k in range(PIECES)])


class Identifier:
    def __init__(self, model: list[tuple[str, int, bytes]], level: int = LEVEL) -> None:
        self.coders = []
        for lang, _, content in model:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))

    def sizes(self, text: str) -> list[int]:
        data = f" {text.lower()} ".encode()
        if len(data) <= BLOCK_BYTES:
            return [len(c(data)) for _, c in self.coders]
        parts = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum([len(c(p)) for p in parts]) for _, c in self.coders]

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        if not text or not self.coders or not _LETTER.search(text):
            return "und", 0.0, 0.0, True
        sizes = self.sizes(text)
        best = min(sizes)
        k = sizes.index(best)
        score = 1.0 / sum([2.0 ** max(-1000.0, -8 * SHARPNESS * (s - best)) for s in sizes])
        rest = [s for i, s in enumerate(sizes) if i != k]
        margin = (min(rest) - best) / best if rest else 1.0
        return self.coders[k][0], score, margin, margin < min_margin


def identify(docs: DataFrame, model: list[tuple[str, int, bytes]], keep: list[str], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, margin and rejected, which replace columns of the same name."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("lang_pred", "score", "margin", "rejected")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double, margin double, rejected boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for b in batches:
            got = [identifier.predict(t, min_margin) for t in b.column("text").to_pylist()]
            columns = list(zip(*got, strict=True)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]], names=[*keep, "lang_pred", "score", "margin", "rejected"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs), ["doc_id", "held_out"])
