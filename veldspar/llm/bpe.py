r"""BPE encoding and decoding; long unsplit text is encoded as a tree of halves.

A text is cut at ASCII white space, which the tokenizer drops and nothing reaches across, and each distinct word
is encoded once, by the library's own normalizer, pre-tokenizer and merges, and kept in a cache of bounded bytes.
A word over ``leaf`` characters is halved until its parts fit.  The leaves of all long words of a slice are encoded
in one parallel batch, each as if it were a text; then neighbours are joined level by level.  Around a join the
last ``k`` tokens on the left and the first ``k`` on the right are encoded again as one string, with ``k`` growing
until the outer two tokens on each side are, in id and place, the ones that stood there before, or a side is used
up.  Leaves and windows begin at letters and signs that no normalization joins to what stands before them (``FREE``).  BPE is exact if each pair of neighbours is, and a token tells whether a piece of the pre-tokenizer ends with
it, so nothing further away can change.

Defined results for odd input: a null or empty text, and one of white space only, has no tokens (SHA-256 of
nothing); bytes that are not UTF-8 count as U+FFFD; repeated rows are encoded one by one and alike; columns
besides those named are not read.  One row in, one row out: no shuffle; a task holds one slice of texts of
about 1 MB, or one text, and caches of at most ``cache`` bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, texts

TOKENIZER = "word_bpe_49k.json"
LEAF = 32
CACHE = 48 << 20
#: Characters that compose with nothing before them and are never put in another order. Fixed values.
FREE = re.compile("[!-~à-ÿΑ-ωА-яא-תء-يぁ-ゖァ-ヺ一-鿿가-힣]")
COST = 200  # bytes that an entry of a cache has besides its contents


class Stretch(NamedTuple):
    """Tokens of text[begin:end], and the characters where each begins and ends."""

    ids: list[int]
    at: list[tuple[int, int]]
    begin: int
    end: int


class Bpe:
    """One tokenizer file: ``encode`` and ``decode`` of whole texts."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.name = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        special = {str(t.content): i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special, self.literal = special, re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else re.compile("(?!)")
        self.leaf, self.most = leaf, cache // 2
        self.words: dict[bytes, tuple[bytes, bytes]] = {}  # ids and decoded text, each token after a space
        self.old: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0
        self.joins = 0

    # -- words ---------------------------------------------------------------------------------------------

    def learn(self, words: set[bytes]) -> None:
        """Make the cache know these words. What a full one held is kept once more, and moves back when used."""
        new = words - self.words.keys()
        if self.held > self.most:
            self.old, self.words, self.held = self.words, {}, 0
            new = words
        old = self.old
        known = [w for w in new if w in old]
        for w in known:
            self._keep(w, old[w])
        new.difference_update(known)
        short = [w for w in new if len(w) <= self.leaf]
        for w, e in zip(short, self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in short], add_special_tokens=False), strict=True):
            self._keep(w, self._entry(e.ids))
        long = [w for w in new if len(w) > self.leaf]
        for w, ids in zip(long, self.trees([w.decode("utf-8", "replace") for w in long]), strict=True):
            self._keep(w, self._entry(ids))

    def _keep(self, word: bytes, entry: tuple[bytes, bytes]) -> None:
        self.words[word] = entry
        self.held += len(word) + len(entry[0]) + len(entry[1]) + COST

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        return pack(f"<{len(ids)}I", *ids), "".join([" " + self.name[i] for i in ids]).encode()

    # -- trees ---------------------------------------------------------------------------------------------

    def _tokens(self, parts: list[str], begins: list[int]) -> Iterator[Stretch]:
        for e, part, at in zip(self.library.encode_batch(parts, add_special_tokens=False), parts, begins, strict=True):
            yield Stretch(e.ids, [(at + x, at + y) for x, y in e.offsets], at, at + len(part))

    def _cuts(self, text: str) -> Iterator[int]:
        at = 0
        while True:
            yield at
            m = FREE.search(text, at + self.leaf)
            if not m:
                return
            at = m.start()

    def trees(self, long: list[str]) -> list[list[int]]:
        """Ids of unsplit texts, each from leaves of at most ``leaf`` characters; special tokens stand for themselves."""
        between = [self.literal.split(t) for t in long]
        whole = iter(self._grown([x for xs in between for x in xs if x and x not in self.special]))
        return [[i for x in xs if x for i in ([self.special[x]] if x in self.special else next(whole))] for xs in between]

    def _grown(self, long: list[str]) -> list[list[int]]:
        begins = [list(self._cuts(t)) for t in long]
        parts = [t[i:j] for t, at in zip(long, begins, strict=True) for i, j in zip(at, [*at[1:], len(t)], strict=True)]
        leaves = self._tokens(parts, [i for at in begins for i in at])
        out = []
        for t, at in zip(long, begins, strict=True):
            level = [next(leaves) for _ in at]
            while len(level) > 1:
                pairs = [self.join(t, level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
                level = pairs + level[len(pairs) * 2 :]
            out.append(level[0].ids)
        return out

    def join(self, text: str, left: Stretch, right: Stretch) -> Stretch:
        """Tokens of two neighbouring stretches of ``text`` as one."""
        self.joins += 1
        n, m, k = len(left.ids), len(right.ids), 4
        while True:
            a, b = max(0, n - k), min(k, m)
            while a and not FREE.match(text, left.at[a][0]):
                a -= 1
            while b < m and not FREE.match(text, right.at[b][0]):
                b += 1
            begin, end = (left.at[a][0] if a else left.begin), (right.at[b][0] if b < m else right.end)
            got = next(self._tokens([text[begin:end]], [begin]))
            same = lambda i, x, j: got.ids[i : i + 2] == x.ids[j : j + 2] and got.at[i : i + 2] == x.at[j : j + 2]
            outer = len(got.ids) - 2
            if (not a or outer >= 0 and same(0, left, a)) and (b == m or outer >= 0 and same(outer, right, b - 2)):
                return Stretch(left.ids[:a] + got.ids + right.ids[b:], left.at[:a] + got.at + right.at[b:], left.begin, right.end)
            k *= 2

    # -- texts ---------------------------------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers and the decoded text."""
        got = [self.words[w] for w in words]
        return b"".join([g[0] for g in got]), b"".join([g[1] for g in got])[1:]

    def encode(self, text: str) -> list[int]:
        words = text.encode().split()
        self.learn(set(words))
        ids = self.encode_words(words)[0]
        return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.name[i] for i in ids)


@lru_cache(maxsize=2)
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(path: str | None, full: bool):
    def run(batches):
        bpe = _bpe(path or tokenizer_path())
        for batch in batches:
            for part in slices(batch):
                lists = [t.split() for t in texts(part)]
                bpe.learn({w for ws in lists for w in ws})
                got = [bpe.encode_words(ws) for ws in lists]
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in got],
                    "decoded_sha256": [hashlib.sha256(s).hexdigest() for _, s in got],
                }
                if full:
                    import numpy as np

                    out["ids"] = pa.array([np.frombuffer(i, "<i4") for i, _ in got], pa.list_(pa.int32()))
                    out["decoded"] = pa.array([s.decode() for _, s in got], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return run


def encoded(docs: DataFrame, path: str | None = None, full: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 by row; ``full``: also ``ids`` and ``decoded``.

    ``path``: the tokenizer file, at the same place on every machine (default: the installed vocabulary).
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(_rows(path, full), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
