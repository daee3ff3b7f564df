"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of texts go into a trie over byte symbols.  A depth-first walk gives
each node one *last-token state*: the token that ends the encoding of the prefix which the node
stands for.  A byte-pair encoding is a sequence whose neighbouring tokens are all compatible (their
concatenation encodes to the two of them), and it is unique, so the state of a node follows from the
states of its ancestors: it is the one token that is a suffix of the prefix and is compatible with
the state of the node where that suffix begins.  Encodings of shared prefixes are thus computed
once, and a word's tokens are read off by walking back from its last node.

The tokenizer file (its path is a parameter) must hold a BPE model with an end-of-word suffix, byte
level symbols, a split pattern and the normalizers NFC, white space and lower case, such as
``word_bpe_49k.json``; special tokens in a text become their ids, as the tokenizers library does.
The file is read on the driver and its content travels to the executors as a broadcast (bounded by
the vocabulary).  Decoding joins the tokens with one space, special tokens included, which is what a
file without a decoder asks for.

Defined results: a null or empty text has no tokens and decodes to the empty string; a null doc_id
is passed through; texts of any length are processed whole; repeated rows give equal results; an
empty table gives no rows; columns of other names are kept, and columns named ``token_ids``,
``decoded`` or ``n_tokens`` are replaced.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Words kept between blocks in each Python worker, and their bytes.
CACHE = 500_000
CACHE_BYTES = 64 << 20
END = "</w>"
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_WHITE_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Stands for the end of a word in the automaton.
LAST = "\uffff"
BLOCK_CHARS = 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@dataclass
class Characters:
    """Where the tokenizers library and Python know different versions of Unicode, the library's is taken."""

    #: A letter, digit or sign that both see alike stands for each character: its place in ``STAND_INS``.
    kinds: bytes
    #: Lower case of characters that Python leaves as they are.
    lower: dict[int, str]
    #: A class of all characters that are not alike.
    odd: str


STAND_INS = "\u00b6\u00e9\u00b2"


@functools.cache
def library_characters() -> Characters:
    kinds, lower, runs = bytearray(0x110000), {}, []
    small = tokenizers.normalizers.Lowercase()
    patterns = [(kind, tokenizers.pre_tokenizers.Split(tokenizers.Regex(p), "removed", invert=True), regex.compile(p)) for kind, p in ((1, r"\p{L}+"), (2, r"\p{N}+"))]
    for start in range(0, 0x110000, 0x1000):  # a block at a time, as the driver has little memory to spare
        points = [c for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000]
        every, here = "".join(map(chr, points)), {}
        for kind, split, pattern in patterns:
            for piece, _ in split.pre_tokenize_str(every):
                for c in piece:
                    kinds[ord(c)] = kind
            for m in pattern.finditer(every):
                here |= dict.fromkeys(map(ord, m[0]), kind)
        lower |= {c: x for c in points if not (c < 128 or unicodedata.category(chr(c)) in ("Lo", "Mn")) and (x := small.normalize_str(chr(c))) != chr(c).lower()}
        for c in points:
            if here.get(c, 0) != kinds[c] or chr(c).isalpha() != (kinds[c] == 1) or c in lower:
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
    return Characters(bytes(kinds), lower, "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class TrieCodec:
    """Encoder and decoder for one tokenizer file, given as its text."""

    def __init__(self, spec: str, characters: Characters | None = None) -> None:
        self.characters = characters or library_characters()
        self.odd = re.compile(self.characters.odd if len(self.characters.odd) > 2 else r"(?!)")
        #: Whether any text so far had such a character: until then no piece is searched for one.
        self.some_odd = False
        d = json.loads(spec)
        model = d["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == END and d.get("decoder") is None, "unsupported tokenizer file"
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole, ia, ib = self.vocab[a + b], self.vocab[a], self.vocab[b]
            self.rank[ia, ib] = r
            self.parts.setdefault(whole, (ia, ib))
        #: The rank of the merge that makes a token; single symbols come before all.
        self.made = {t: self.rank[p] for t, p in self.parts.items()}
        self._automaton()
        self.fits: dict[int, bool] = {}
        #: Two generations of known words: ids and decoded text.
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.held = 0

    def _automaton(self) -> None:
        """Suffix automaton of the vocabulary: ``ends[s]`` has the tokens that are suffixes of what led to s, longest first."""
        step: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for name, token in self.vocab.items():
            s, name = 0, (name[: -len(END)] + LAST if name.endswith(END) else name)
            for c in name:
                nxt = step[s].get(c)
                if nxt is None:
                    nxt = step[s][c] = len(step)
                    step.append({})
                    own.append(None)
                s = nxt
            own[s] = (token, len(name))
        fail, ends = [0] * len(step), [()] * len(step)
        queue = list(step[0].values())
        for s in queue:
            ends[s] = ((own[s],) if own[s] else ()) + ends[fail[s]]
            for c, nxt in step[s].items():
                f = fail[s]
                while f and c not in step[f]:
                    f = fail[f]
                fail[nxt] = step[f].get(c, 0)
                queue.append(nxt)
        self.step, self.fail, self.ends = step, fail, ends
        self.more: list[dict[str, int]] = [{} for _ in step]

    def _go(self, s: int, c: str) -> int:
        """Transition outside the vocabulary's own trie; kept once found."""
        f = self.fail[s]
        while f and c not in self.step[f]:
            f = self.fail[f]
        got = self.more[s][c] = self.step[f].get(c, 0)
        return got

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens side by side stay as they are.

        Undo, latest merge first, the merges next to the seam.  The seam would have been closed if two parts
        that touch there at some moment have a merge that goes before the merges that take them away."""
        up_a = up_b = 1 << 60
        a, b = left, right
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < up_a and r <= up_b:  # of two equal merges the left one goes first
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a >= made_b:
                up_a, a = made_a, self.parts[a][1]
            else:
                up_b, b = made_b, self.parts[b][0]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Encodings of distinct words of byte symbols, by one walk of their trie.

        Sorted order is the depth-first order of the trie, so the stack of states is cut back to the
        prefix that a word shares with the one before it and grown by the nodes that are new."""
        out: dict[str, list[int]] = {}
        step, more, ends, fits, compatible = self.step, self.more, self.ends, self.fits, self.compatible
        if len(fits) > 3_000_000:
            fits.clear()
        at, token, length = [0], [-1], [0]  # automaton state, last token, its length: of each prefix on the path
        before = ""
        for word in sorted(words):
            w = word + LAST
            d = 0
            for x, y in zip(before, w):  # noqa: B905
                if x != y:
                    break
                d += 1
            del at[d + 1 :], token[d + 1 :], length[d + 1 :]
            s = at[d]
            for c in w[d:]:
                d += 1
                nxt = step[s].get(c)
                if nxt is None:
                    nxt = more[s].get(c)
                    if nxt is None:
                        nxt = self._go(s, c)
                s = nxt
                for t, size in ends[s]:
                    if size == d:
                        break
                    key = token[d - size] << 32 | t
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = compatible(key >> 32, t)
                    if fit:
                        break
                at.append(s)
                token.append(t)
                length.append(size)
            found = []
            while d:
                found.append(token[d])
                d -= length[d]
            found.reverse()
            out[word] = found
            before = w
        return out

    def chunks(self, text: str) -> list[str]:
        """Normalized pieces between white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case letter by letter, whatever stands around it
                text = text.replace("Σ", "σ")
        text = text.lower()
        self.some_odd = self.some_odd or not text.isascii() and self.odd.search(text) is not None
        return [x for x in _WHITE_SPACE.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def split(self, piece: str) -> list[str]:
        if self.some_odd and not piece.isascii() and self.odd.search(piece):
            piece = piece.translate(self.characters.lower)
            kinds = self.characters.kinds
            alike = "".join([c if c < "\x80" else STAND_INS[kinds[ord(c)]] for c in piece])
            return [piece[m.start() : m.end()] for m in self.pattern.finditer(alike)]
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".,!?;:" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def learn(self, pieces: set[str]) -> None:
        ids, text = self.ids, self.text
        fresh = [p for p in pieces if p not in ids]
        if not fresh:
            return
        if len(ids) + len(fresh) > CACHE or self.held > CACHE_BYTES:  # keep what this block needs
            self.ids, self.text = {p: ids[p] for p in pieces if p in ids}, {p: text[p] for p in pieces if p in text}
            ids, text = self.ids, self.text
            self.held = sum([len(p) + len(ids[p]) + len(text[p]) for p in ids])
        symbols = self.symbols
        parts = {p: [w if w.isascii() and w.isprintable() else "".join([symbols[b] for b in w.encode()]) for w in self.split(p)] for p in fresh}
        got = self.encode_words({w for ws in parts.values() for w in ws})
        names = self.tokens
        for p, ws in parts.items():
            found = got[ws[0]] if len(ws) == 1 else [i for w in ws for i in got[w]]
            ids[p] = struct.pack(f"<{len(found)}I", *found)
            text[p] = " ".join([names[i] for i in found])
            self.held += len(p) + len(ids[p]) + len(text[p])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text, block by block."""
        block: list[list[list[str] | int]] = []
        size = 0
        for text in texts:
            text = text or ""
            if self.split_special and "<|" in text and any(s in text for s in self.special):
                block.append([self.special[x] if x in self.special else self.chunks(x) for x in self.split_special.split(text)])
            else:
                block.append([self.chunks(text)])
            size += len(text)
            if size > BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[list[str] | int]]) -> Iterator[tuple[bytes, str]]:
        self.learn({p for doc in block for part in doc if not isinstance(part, int) for p in part})
        ids, text = self.ids.__getitem__, self.text.__getitem__
        for doc in block:
            if len(doc) == 1:
                yield b"".join(map(ids, doc[0])), " ".join(map(text, doc[0]))
            else:
                some = [x for x in doc if x != []]
                yield (
                    b"".join([x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(ids, x)) for x in some]),
                    " ".join([self.tokens[x] if isinstance(x, int) else " ".join(map(text, x)) for x in some]),
                )


_codecs: dict[int, TrieCodec] = {}


def encode(docs: DataFrame, tokenizer_path: str, column: str = "text") -> DataFrame:
    """Adds ``token_ids`` (binary, little-endian unsigned 32-bit), ``decoded`` and ``n_tokens``; keeps all other columns."""
    own = [c for c in docs.columns if c not in ("token_ids", "decoded", "n_tokens")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + ["token_ids binary, decoded string, n_tokens long"])
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), library_characters()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, characters = spec.value
        key = hash(text)
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = TrieCodec(text, characters)
        codec = _codecs[key]
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                got = list(codec.encode(b.column(column).to_pylist()))
                ids, decoded = [x[0] for x in got], [x[1] for x in got]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[*own, "token_ids", "decoded", "n_tokens"])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, default_tokenizer()).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document with its token ids, decoded text and number of tokens, which replace columns of these names.

    A null or empty text has no tokens; rows that repeat and null doc_ids are passed through; an empty table stays empty."""
    return encode(docs, default_tokenizer())
