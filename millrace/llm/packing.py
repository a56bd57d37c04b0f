"""Order-preserving packing: window cuts by dynamic programming.

A partition's documents, in their order, are one run of tokens (each document's ids, then ``end_id``). The run is cut
into windows of at most ``length`` tokens. A window costs its padding (``length`` less its tokens, nothing
where the tokens number a power of two, as such a sequence isn't padded) and its cut costs what it truncates:
nothing at a document's end, ``SENTENCE_COST`` at a sentence's end (the first in each ``STEP`` tokens is offered), ``WORD_COST`` elsewhere (offered only in
sentences longer than ``RUN`` tokens). With f the least cost up to a cut,
f(c) = cost(c) + length - c + min over cuts b in [c - length, c) of f(b) + b: a sliding minimum that a monotone
queue moves along in constant time a cut, beside one look-up for each power of two. Costs are settled block
by block (``BLOCK`` tokens); an open tail is carried on, so memory is bounded.

Windows never join two partitions; sequence_id is the partition's number times 2**33 plus the window's.

Nulls: a null text is empty, which gives one piece, the end id. A null doc_id is kept as null. Repeated rows
are packed as often as they come. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import LONGEST, WordIds

LENGTH, END_ID = 2048, 1
SENTENCE_COST, WORD_COST, STEP, RUN, BLOCK = 3, 24, 16, 256, 1 << 17
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and number the others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


BYTE_OF = _bytes_of_letters()


class Encoder:
    """ids of the byte-level vocabulary, as the tokenizers library gives them; words are looked up once.

    The pre-tokenizer never joins a character to a space or line feed after it, so pieces cut there encode
    alike alone; a text with other white space, or with a special token, is encoded whole. Pieces not seen before go
    through a faster encoder of the same vocabulary, whose ranks are its ids.
    """

    ODD = re.compile(rb"[\x00-\x09\x0b-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|endoftext\|>")
    LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"<|endoftext|>")
    ENDS = re.compile(r"[.!?\n][\"')\]]*\s*\Z")
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str | None = None):
        import tiktoken
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        vocab = self.model.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        ranks = {bytes(map(BYTE_OF.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.core = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(self.model.get_vocab_size() + 1, bool)
        self.spaced = np.zeros_like(self.ends)
        for t, i in ranks.items():
            self.spaced[i] = t[:1] == b" "
            self.ends[i] = bool(self.ENDS.search(t.decode("utf-8", "replace")))
        probe = "Tokens of a probe: 12 naïve cafés, don't!\n  And 東京."
        if list(self.core.encode_ordinary(probe)) != self.model.encode(probe, add_special_tokens=False).ids:
            raise ValueError("this tokenizer's ids aren't the ranks of its merges")
        #: Many pieces in one call, where the library has it.
        self.many = getattr(self.core._core_bpe, "encode_to_tiktoken_buffer", None)
        self.words = WordIds(self.learn)

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one leading space and no other white space go in one call: each has one token that begins with the space."""
        joint = [self.many is not None and p[:1] == b" " and p[1:2] not in (b" ", b"\n", b"") and len(p) <= LONGEST for p in pieces]
        run = np.frombuffer(self.many(b"".join([p for p, j in zip(pieces, joint, strict=True) if j]).decode(), set()), np.uint32) if any(joint) else np.zeros(0, np.uint32)
        first = np.append(np.flatnonzero(self.spaced[run]), len(run))
        own = [np.array(self.core.encode_ordinary(p.decode()), np.uint32) for p, j in zip(pieces, joint, strict=True) if not j]
        cnt = np.zeros(len(pieces), np.int64)
        joint = np.array(joint, bool)
        cnt[joint], cnt[~joint] = np.diff(first), [len(x) for x in own]
        if not own:
            return run, cnt
        out, at = np.zeros(int(cnt.sum()), np.uint32), np.repeat(joint, cnt)
        out[at], out[~at] = run, np.concatenate(own)
        return out, cnt

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids of UTF-8 texts."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b"".join(texts)
        buf = np.frombuffer(data, np.uint8)
        if len(data) and (((buf < 32) & (buf != 10)).any() or any(x in data for x in self.LEADS)):
            odd = {k for k, t in enumerate(texts) if self.ODD.search(t)}
            if odd:
                rest = self.encode([b"" if k in odd else t for k, t in enumerate(texts)])
                return [self.whole(t.decode()) if k in odd else rest[k] for k, t in enumerate(texts)]
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        space = (buf == 32) | (buf == 10)
        starts = np.zeros(len(buf), bool)
        starts[1:] = space[1:] & ~space[:-1]
        docs = np.cumsum(size) - size
        starts[docs[size > 0]] = True
        starts = np.flatnonzero(starts)
        ids, cnt = self.words.ids(data, starts, np.diff(starts, append=len(buf)))
        upto = np.concatenate(([0], np.cumsum(cnt)))
        cuts = upto[np.searchsorted(starts, np.concatenate((docs, [len(buf)])))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_ENCODERS: dict = {}


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def choose(cuts: np.ndarray, cost: np.ndarray, length: int = LENGTH, last: bool = True) -> list[int]:
    """Numbers of the chosen cuts: cuts are places in a run that begins at 0, ascending, at most length apart.

    last: the run ends at its last cut; else it goes on, and only windows before the last are settled.
    """
    places, costs = [0, *cuts.tolist()], [0, *cost.tolist()]
    best, back = [0.0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    at = {0: 0}
    powers = [1 << k for k in range(length.bit_length()) if 64 <= 1 << k <= length]
    for i in range(1, len(places)):
        c = places[i]
        while places[queue[0]] < c - length:
            queue.popleft()
        b = queue[0]
        least, chosen = best[b] + places[b] + length - c, b
        for p in powers:
            j = at.get(c - p)
            if j is not None and best[j] < least:
                least, chosen = best[j], j
        best[i], back[i] = least + costs[i], chosen
        key = best[i] + c
        while queue and best[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
        at[c] = i
    i, found = len(places) - 1, []
    while i:
        found.append(i - 1)
        i = back[i]
    found.reverse()
    return found if last else found[:-1]


def candidates(sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, cost): document ends, sentence ends, and places in long sentences. ends: whether each token ends a sentence."""
    total = int(sizes.sum())
    kind = np.full(total + 1, 255, np.uint8)
    sentences = np.flatnonzero(ends) + 1
    kind[sentences[np.diff(sentences // STEP, prepend=-1) > 0]] = SENTENCE_COST
    kind[np.cumsum(sizes)] = 0
    cuts = np.flatnonzero(kind != 255)
    cuts = cuts[cuts > 0]
    gaps = np.diff(cuts, prepend=0)
    long = np.flatnonzero(gaps > RUN)
    if len(long):
        more = np.concatenate([np.arange(cuts[i] - gaps[i] + RUN, cuts[i], RUN) for i in long])
        kind[more] = WORD_COST
        cuts = np.flatnonzero(kind != 255)
        cuts = cuts[cuts > 0]
    return cuts, kind[cuts].astype(np.int64)




def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of docs (doc_id, text)."""
    ship(docs.sparkSession)

    def each(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        seq = (task.partitionId() if task else 0) << 33
        enc = encoder(tokenizer)
        held: list[list] = []  # doc_id, its ids, tokens of it already packed
        n = 0

        def windows(last: bool):
            nonlocal held, n, seq
            sizes = np.array([len(ids) - done for _, ids, done in held], np.int64)
            run = np.concatenate([ids[done:] for _, ids, done in held])
            cuts, cost = candidates(sizes, np.where(run < len(enc.ends), enc.ends[np.minimum(run, len(enc.ends) - 1)], False))
            out, at, k = [], 0, 0
            for i in choose(cuts, cost, length, last):
                end, offset = int(cuts[i]), 0
                while at < end:
                    doc, ids, done = held[k]
                    take = min(len(ids) - done, end - at)
                    out.append((doc, done, take, zlib.crc32(ids[done : done + take].tobytes()), len(ids), seq, offset))
                    held[k][2] += take
                    at, offset = at + take, offset + take
                    if held[k][2] == len(ids):
                        k += 1
                seq += 1
            held, n = held[k:], n - at
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    held.append([doc, np.append(ids, np.uint32(end_id)), 0])
                    n += len(ids) + 1
                    if n >= BLOCK:
                        yield windows(False)
        if held:
            yield windows(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(each, SCHEMA)
