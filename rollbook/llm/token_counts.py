"""Token counts from distinct pre-tokens, without making any ids of documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bpe import Numbering, load
from rollbook.llm.shared import shuffle_parts

#: Documents whose pre-tokens are packed together.
BLOCK_DOCS = 4_000
#: Pre-tokens whose counts a task remembers before it starts anew.
REMEMBERED = 500_000
#: Stands for a null id inside the packed rows.
NO_ID = np.iinfo(np.int64).min


def _bucket(word: str, buckets: int) -> int:
    """The same for a word in every process (Python's own hash is not)."""
    return zlib.crc32(word.encode("utf-8", "surrogateescape")) % buckets


def heads_of(path: str) -> dict[str, int]:
    """Pre-tokens that are vocabulary entries, with their counts: a table as large as the vocabulary, never larger."""
    bpe, words = load(path), []
    for token in bpe.vocab:
        try:
            words.append(bytes(bpe.byte_of[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    words = [w for w in words if w]
    return dict(zip(words, map(len, bpe.merge([w.encode() for w in words]))))


class Frequencies(Numbering):
    """How often each document of a block has each pre-token; ``heads`` has the counts of some."""

    def __init__(self, path: str, heads: dict[str, int], buckets: int):
        self.heads, self.buckets = heads, buckets
        super().__init__(path, REMEMBERED)

    def _forget(self) -> None:
        self.words, self.count, self.bucket = [], np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Count (-1: to be joined) and bucket of new pre-tokens. A special token counts one; no plain word has its text."""
        self.words += words
        self.count = np.concatenate((self.count, [1 if w in self.bpe.specials else self.heads.get(w, -1) for w in words]))
        self.bucket = np.concatenate((self.bucket, np.array([_bucket(w, self.buckets) for w in words], np.int32)))

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-token number, place of the text and frequency, sorted by number."""
        self.known.fresh()
        pairs, times = [], []
        for a, b, numbers, counts in self.numbered(texts, fresh=False):
            pair, n = np.unique(numbers.astype(np.int64) << 16 | np.repeat(np.arange(a, b), counts), return_counts=True)
            pairs.append(pair)
            times.append(n)
        pair, n = np.concatenate((*pairs, np.zeros(0, np.int64))), np.concatenate((*times, np.zeros(0, np.int64)))
        order = np.argsort(pair)
        return pair[order] >> 16, pair[order] & 0xFFFF, n[order]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, buckets: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), as the tokenizers library
    counts with the file ``path``.

    1. Each text is cut to pre-tokens and their frequencies in it are taken. Those of pre-tokens that are vocabulary
       entries are joined where they are with a broadcast table of the vocabulary's counts (bounded by the vocabulary
       file, each counted once); so the very frequent ones go no further.
    2. The other frequencies, (row, n) by pre-token, are packed by block of rows and bucket of pre-tokens and shuffled by
       bucket: there every distinct pre-token is merged once, and its count joins all the rows that hold it.
    3. The partial sums, still packed, are added up by block, which names its rows.

    Special strings in a text count one each. Null and empty texts: 0. Repeated rows and rows without id are rows of
    their own. A very long text is cut whole, as a chunk of its own. Other columns of ``docs``, whatever their names, play no
    part. ``doc_id`` is integral. An empty table gives an empty one. A lost task is run again on the same rows if the
    partitions of ``docs`` are reproducible, as those of files are.
    """
    spark = docs.sparkSession
    buckets = buckets or shuffle_parts(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    heads = spark.sparkContext.broadcast(heads_of(path))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part, nth = Frequencies(path, heads.value, buckets), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK_DOCS):
                few = batch.iloc[at : at + BLOCK_DOCS]
                ids = few["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
                texts = few["text"].tolist()
                size = np.array([len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else 0 for t in texts], np.int64)
                number, local, n = own.of(texts)
                count = own.count[number]
                near = np.bincount(local, np.maximum(count, 0) * n, len(ids)).astype(np.int64)
                key = hashlib.blake2b(np.array([part, nth]).tobytes() + ids.tobytes() + near.tobytes(), digest_size=16).digest()
                nth += 1
                out = [(-1, key, None, None, None, None, ids.tobytes(), near.tobytes(), size.tobytes())]
                far = np.flatnonzero(count < 0)
                far = far[np.argsort(own.bucket[number[far]], kind="stable")]
                number, local, n = number[far], local[far], n[far]
                bucket, first = np.unique(own.bucket[number], return_index=True)
                for b, i, j in zip(bucket.tolist(), first, [*first[1:], len(far)]):
                    words, times = np.unique(number[i:j], return_counts=True)
                    packed = times.astype(np.int32), local[i:j].astype(np.int16), n[i:j].astype(np.int32)
                    out.append((b, key, [own.words[w] for w in words.tolist()], *(x.tobytes() for x in packed), None, None, None))
                yield pd.DataFrame(out, columns=_PACKED)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, seen = load(path), {}
        for batch in batches:
            rows = []
            for _, key, words, times, local, n, ids, near, size in zip(*(batch[c] for c in _PACKED)):
                if words is None:
                    rows.append((key, None, None, ids, near, size))
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                new = [w for w in words if w not in seen]
                seen.update(zip(new, map(len, bpe.merge([w.encode("utf-8", "surrogateescape") for w in new]))))
                each = np.repeat(np.array([seen[w] for w in words]), np.frombuffer(times, np.int32)) * np.frombuffer(n, np.int32)
                sums = np.bincount(np.frombuffer(local, np.int16), each)
                held = np.flatnonzero(sums)
                rows.append((key, held.astype(np.int16).tobytes(), sums[held].astype(np.int64).tobytes(), None, None, None))
            yield pd.DataFrame(rows, columns=["block", "local", "sums", "ids", "near", "size"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["ids"].notna()].iloc[0]
        ids, near, size = (np.frombuffer(head[c], np.int64) for c in ("ids", "near", "size"))
        tokens = near.copy()
        for local, sums in zip(group["local"], group["sums"]):
            if sums is not None:
                tokens[np.frombuffer(local, np.int16)] += np.frombuffer(sums, np.int64)
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").mask(ids == NO_ID), "n_bytes": size, "n_tokens": tokens})

    packed = rows.mapInPandas(pack, "bucket int, block binary, words array<string>, times binary, local binary, n binary, ids binary, near binary, size binary")
    # bucket -1 holds what needs no join; it is dealt out by its own block
    dealt = packed.repartition(buckets, "bucket", F.when(F.col("bucket") == -1, F.col("block")))
    counted = dealt.mapInPandas(join, "block binary, local binary, sums binary, ids binary, near binary, size binary")
    # a block has at most BLOCK_DOCS documents, so its parts fit a task
    return counted.groupBy("block").applyInPandas(add, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


_PACKED = ["bucket", "block", "words", "times", "local", "n", "ids", "near", "size"]


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
