"""BPE encoding and decoding; long unsplit text by tree concatenation.

Texts are cut at spaces and line feeds, which the pre-tokenizer drops and no rule looks across, and each word's ids are
found once and remembered. A word whose pre-token is longer than ``LEAF`` characters is cut in halves again and again,
the leaves are encoded in parallel, and neighbours are joined: a window of tokens around the join is encoded
again and grows until its first and last tokens are those that both sides had there. Adjacent tokens of
a BPE encoding depend only on each other, so agreement on both sides makes the joined run the exact encoding.
Only the last leaf has the word's end mark; the others go through the same merges without it.

Nulls: a null text is empty, with no ids. A null doc_id is kept as null, repeated rows stay repeated,
an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import WordIds

LEAF, WINDOW, THREADS = 1024, 8, 2


class Codec:
    """One tokenizers file of BPE with word ends."""

    def __init__(self, path: str | None = None, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.path, self.leaf = path, leaf
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        size = self.model.get_vocab_size()
        self.tokens = [self.model.id_to_token(i) or "" for i in range(size)]
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()) + ")")
        self.words = WordIds(self.learn)
        self._inner = None

    def _pieces(self, text: str, end: bool) -> list[tuple[int, int]]:
        """(id, characters) of a run of byte-level letters, with or without the word's end mark."""
        if end:
            found, mark = self.model.model.tokenize(text), self.model.model.end_of_word_suffix or ""
            cut = len(mark) if mark else 0
            return [(t.id, len(t.value) - (cut if cut and k == len(found) - 1 and t.value.endswith(mark) else 0)) for k, t in enumerate(found)]
        if self._inner is None:
            from tokenizers.models import BPE

            with open(self.path, encoding="utf-8") as f:
                own = json.load(f)["model"]
            self._inner = BPE(own["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in own["merges"]])
        return [(t.id, len(t.value)) for t in self._inner.tokenize(text)]

    def _join(self, text: str, mid: int, left: list, right: list, end: bool) -> list:
        """Tokens of text from those of text[:mid] and text[mid:]."""
        k = WINDOW
        while True:
            i, j = min(k, len(left)), min(k, len(right))
            whole_left, whole_right = i == len(left), j == len(right)
            a, b = mid - sum(n for _, n in left[len(left) - i :]), mid + sum(n for _, n in right[:j])
            mine = self._pieces(text[a:b], end and whole_right)
            if (whole_left or mine[0] == left[-i]) and (whole_right or mine[-1] == right[j - 1]):
                return left[: len(left) - i] + mine + right[j:]
            k *= 2

    def tree(self, text: str) -> list[int]:
        """ids of one pre-token, given in byte-level letters, by tree concatenation."""
        n = max(1, -(-len(text) // self.leaf))
        n = 1 << (n - 1).bit_length()
        edges = [len(text) * k // n for k in range(n + 1)]
        with ThreadPoolExecutor(THREADS) as pool:
            runs = list(pool.map(lambda k: self._pieces(text[edges[k] : edges[k + 1]], k == n - 1), range(n)))
            while len(runs) > 1:
                pairs = len(runs) // 2
                step = n // len(runs)
                at = [edges[k * step] for k in range(len(runs))] + [len(text)]
                runs = list(pool.map(lambda k: self._join(text[at[2 * k] : at[2 * k + 2]], at[2 * k + 1] - at[2 * k], runs[2 * k], runs[2 * k + 1], k == pairs - 1), range(pairs)))  # noqa: B023
        return [i for i, _ in runs[0]]

    def long(self, text: str) -> list[int]:
        """ids of a long word: special tokens first, then pre-tokens, each by the tree if it is long."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.model.token_to_id(part))
            elif part:
                for piece, _ in self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(part)):
                    out += self.tree(piece) if len(piece) > self.leaf else [t.id for t in self.model.model.tokenize(piece)]
        return out

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        plain = iter(self.model.encode_batch_fast([t for t in texts if len(t) <= self.leaf], add_special_tokens=False))
        ids = [next(plain).ids if len(t) <= self.leaf else self.long(t) for t in texts]
        cnt = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(cnt.sum())), cnt

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b"".join(texts)
        buf = np.frombuffer(data, np.uint8)
        docs = np.concatenate(([0], np.cumsum(size)))
        ink = (buf != 32) & (buf != 10)
        before = np.zeros(len(buf), bool)
        before[1:] = ink[:-1]
        before[docs[:-1][size > 0]] = False
        starts = np.flatnonzero(ink & ~before)
        after = np.zeros(len(buf), bool)
        after[:-1] = ink[1:] & before[1:]
        ends = np.flatnonzero(ink & ~after) + 1
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        ids, cnt = self.words.ids(data, starts, ends - starts)
        upto = np.concatenate(([0], np.cumsum(cnt)))
        cuts = upto[np.searchsorted(starts, docs)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library does for a file without a decoder: tokens with spaces between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS: dict = {}


def codec(path: str | None) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text)."""
    return _each(docs, tokenizer, "doc_id long, ids array<int>", lambda c, ids: (pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded (doc_id, ids)."""
    ship(encoded.sparkSession)

    def each(batches):
        c = codec(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(each, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass over docs (doc_id, text)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _each(docs, tokenizer, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda c, ids: (pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()), pa.array([sha(c.decode(x).encode()) for x in ids], pa.string())))


def _each(docs: DataFrame, tokenizer: str | None, schema: str, make) -> DataFrame:
    ship(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches):
        c = codec(tokenizer)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = c.encode([t or b"" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *make(c, ids)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(each, schema)
