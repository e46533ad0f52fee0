"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Documents are taken in blocks of a few MB. Each block is split into pre-tokens once and keeps, for every position,
the number of its pre-token, and nothing else of the text. A pre-token that is itself an entry of the rank table needs
no merging; of the others each block sends every distinct one to the bucket of its hash. A bucket gathers what all
blocks ask for, encodes each distinct word once, and answers each block. The answers are joined back to the blocks'
positions, which puts the ids together. Decoding joins ids with the token-byte table (fixed size, known to every
task). So a hot word costs one request per block, not one per place, no group grows with a word's
frequency, and positions are shuffled once, compressed.

Defined edge cases: a null text is empty (no ids, no bytes); a null doc_id stays null; a text of white space only, a
single very long word or a very long text (a block of its own) is encoded like any other; repeated rows each give a row;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from functools import cached_property
from itertools import chain, count, filterfalse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answered, assembled, bucket_count, bundle, cells, nullable, numbers, unbundle
from .common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Joins the words of a request; no UTF-8 text has this byte.
_BREAK = b"\xff"


class Tokenizer:
    """Pre-tokens of a text, and the ids of one pre-token."""

    def __init__(self, table: bytes, pattern: str):
        import regex

        self.pattern = pattern
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
        self.split = regex.compile(pattern).findall
        self.whole = {}
        for token, i in self.ranks.items():
            try:
                self.whole[token.decode()] = i
            except UnicodeDecodeError:
                pass

    @cached_property
    def byte_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens' bytes in a row, where each starts, and how many it has, by id."""
        by_id = {i: token for token, i in self.ranks.items()}
        sizes = np.array([len(by_id.get(i, b"")) for i in range(max(by_id, default=-1) + 1)], np.int64)
        return np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8), np.cumsum(sizes) - sizes, sizes

    @cached_property
    def encode(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[start:start + size] of the given numbers one after another, and where each ends."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)], ends


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the token ids of each whole text, and the bytes that the ids decode to."""
    buckets = bucket_count(docs)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # the rank file, of a fixed size
    known: dict = {}  # one tokenizer per task

    def tokenizer() -> Tokenizer:
        return known.get(0) or known.setdefault(0, Tokenizer(*shared.value))

    def cut(ids, texts):
        tokens = tokenizer()
        rows = [tokens.split(t) for t in texts]
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        number = dict.fromkeys(chain.from_iterable(rows))
        asked: dict[int, list[bytes]] = {}
        for w in filterfalse(tokens.whole.__contains__, number):
            raw = w.encode()
            asked.setdefault(zlib.crc32(raw) % buckets, []).append(raw)
        # words are numbered by bucket, those that need no merging after them
        asked = dict(sorted(asked.items()))
        number.update(zip((w.decode() for words in asked.values() for w in words), count()))
        whole = [w for w, i in number.items() if i is None]
        number.update(zip(whole, count(len(number) - len(whole))))
        places = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.uint32, ends[-1])
        return bundle(*numbers(ids), ends, np.array([tokens.whole[w] for w in whole], np.uint32), places), {b: _BREAK.join(words) for b, words in asked.items()}

    def answer(requests):
        tokens = tokenizer()
        ids: dict[bytes, list[int]] = {}
        out = []
        for words in requests:
            words = words.split(_BREAK)
            for w in words:
                if w not in ids:
                    ids[w] = tokens.encode(w.decode())
            found = [ids[w] for w in words]
            out.append(bundle(np.fromiter(map(len, found), np.uint32, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)))
        return out

    def assemble(kept, answers):
        import pyarrow as pa

        doc, null, ends, whole, places = unbundle(kept)
        parts = [unbundle(answers[b]) for b in sorted(answers)]
        sizes = np.concatenate([*(n for n, _ in parts), np.ones(len(whole), np.uint32)]).astype(np.int64)
        ids, word_ends = gather(np.concatenate([*(i for _, i in parts), whole]).astype(np.int32), np.cumsum(sizes) - sizes, sizes, places)
        id_ends = np.append(0, np.append(0, word_ends)[ends])
        raw, token_ends = gather(*tokenizer().byte_table, ids)
        byte_ends = np.append(0, token_ends)[id_ends]
        decoded = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(byte_ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        return pa.table({"doc_id": nullable(doc, null), "ids": pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(ids, pa.int32())), "decoded": decoded})

    blocks = cells(docs, cut)
    return assembled(blocks, answered(blocks, answer), assemble, "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; the tokenizer's file is read once, by the driver."""
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        encoded = encode(docs, f.read(), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
