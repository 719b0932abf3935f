"""Token ids in files: an adaptive context-mixing range coder over blocks that start anew and carry checksums.

A block holds whole or partial documents, at most BLOCK ids. Its bytes:

    4s magic, then unsigned little-endian 32-bit: version, ids, documents, words, crc32 of all that follows
    per document: id (signed 64-bit; the least stands for null), ids before this block (64-bit), ids in it (32-bit)
    words of 16 bits: the range coder's output

Each id is coded in up to three decisions. Order 2 predicts the id that followed the last two ids before, order 1
the one that followed the last id; whether a prediction holds is one bit, its probability a logistic mixture of what
the confidence of order 2, that of order 1 and the outcomes of the last decisions (order 0) say. Where both predict
one id, the second bit is known and not coded. What neither predicts is coded by its high byte, with order-0 counts of
the block that take effect every REFRESH ids, and its low byte as eight plain bits. All arithmetic is on integers, so that any machine reads what
another wrote.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.bpe import build_lexicon, encoder
from rollbook.llm.shared import shared_folder, shuffle_parts

MAGIC, VERSION = b"RTOK", 2
#: Ids of a block, and blocks that are coded side by side.
BLOCK, LANES = 2048, 4096
#: Bits of a place in the tables of order 2 and order 1.
BITS_2, BITS_1 = 11, 10
#: Steps between two updates of the byte counts in use, and what an occurrence adds to a count that starts at 1. A
#: block's counts stay below 2 ** 16.
REFRESH, ADDS = 64, 12
#: Shifts that set how fast probabilities and mixing weights (16-bit fractions) follow.
RATE, LEARN = 4, 7
NO_ID = np.iinfo(np.int64).min
_HEAD, _DOC = struct.Struct("<4s5I"), np.dtype([("doc_id", "<i8"), ("before", "<i8"), ("n", "<u4")])


def _squash_table() -> np.ndarray:
    """4096 / (1 + exp(-x / 256)) for x from -2048 to 2047: exp by its series in whole numbers of 2 ** 40, the same everywhere."""
    one = 1 << 40
    root, term, k = one, one, 1  # exp(1 / 256)
    while term:
        term = term // 256 // k
        root, k = root + term, k + 1
    out, power = [2048], one
    for _ in range(2048):
        power = power * root // one
        out.append(4096 * power // (power + one))
    return np.array([4096 - p for p in out[:0:-1]] + out[:-1], np.int32).clip(1, 4095)


SQUASH = _squash_table()
STRETCH = (np.searchsorted(SQUASH, np.arange(4096)).clip(0, 4095) - 2048).astype(np.int32)


class _Coder:
    """Range coders of many lanes in step. ``words`` is None to encode; carries stay in the output until ``packed``."""

    def __init__(self, lanes: int, words: np.ndarray | None, room: int = 0):
        self.range = np.full(lanes, 0xFFFFFFFF, np.int64)
        self.encodes = words is None
        if words is None:
            self.room = room
            self.low, self.out = np.zeros(lanes, np.int64), np.zeros(lanes * room, np.int32)
        else:
            self.room = words.shape[1]
            self.code, self.words = words[:, 0].astype(np.int64) << 16 | words[:, 1], words.reshape(-1)
        self.first = np.arange(lanes) * self.room
        self.at = self.first + (0 if words is None else 2)

    def narrow(self, lane, new: np.ndarray) -> None:
        """The lanes' new ranges; those that are short take in or give out 16 bits."""
        small = np.flatnonzero(new < 65536)
        if len(small):
            who = small if lane is None else lane[small]
            new[small] <<= 16
            at = self.at[who]
            if self.encodes:
                low = self.low[who]
                self.out[at] = low >> 16
                self.low[who] = (low & 0xFFFF) << 16
            else:
                self.code[who] = self.code[who] << 16 | self.words[at]
            self.at[who] = at + 1
        if lane is None:
            self.range[: len(new)] = new
        else:
            self.range[lane] = new

    def packed(self) -> list[bytes]:
        for shift in (16, 0):
            self.out[self.at] = self.low >> shift if shift else self.low & 0xFFFF
            self.at += 1
        out, size = self.out.reshape(len(self.at), self.room), self.at - self.first
        for k in range(int(size.max()) - 1, 0, -1):
            out[:, k - 1] += out[:, k] >> 16
        out = out.astype(np.uint16)
        return [row[:n].astype("<u2").tobytes() for row, n in zip(out, size.tolist())]


class _Bits:
    """Mixed bit predictions of all lanes: a probability per context and input, and the mixing weights."""

    def __init__(self, lanes: int, contexts: tuple[int, ...]):
        starts = np.cumsum([0, *contexts]) * lanes
        self.p = np.full(starts[-1], 32768, np.int32)
        self.base = np.stack([np.arange(lanes) * n + a for n, a in zip(contexts, starts)])
        self.weight = np.full((len(contexts), lanes), 65536 * 5 // 12, np.int32)

    def code(self, coder: _Coder, lane: np.ndarray | None, n: int, contexts: list[np.ndarray], bit: np.ndarray | None) -> np.ndarray:
        """Code one bit of the first n lanes, or of the lanes ``lane``."""
        of = (lambda x: x[..., :n]) if lane is None else (lambda x: x.take(lane, axis=-1))
        places = of(self.base) + contexts
        given = self.p.take(places)
        said = STRETCH.take(given >> 4)
        weights = of(self.weight)
        mixed = SQUASH.take(((weights * said).sum(axis=0, dtype=np.int32) >> 16) + 2048, mode="clip")  # of 4096, for a 1
        whole = of(coder.range)
        part = (whole >> 12) * mixed
        if bit is None:
            bit = of(coder.code) < part
        missed, new = part * ~bit, whole - part
        np.copyto(new, part, where=bit)
        if lane is not None:
            _moved(coder, lane, missed, new)
        else:
            if coder.encodes:
                coder.low[:n] += missed
            else:
                coder.code[:n] -= missed
            coder.narrow(None, new)
        error = (bit << np.int32(12)) - mixed
        self.p[places] = given + ((bit * np.int32(65535) - given) >> RATE)
        weights = weights + ((said * error) >> LEARN)
        if lane is None:
            self.weight[:, :n] = weights
        else:
            self.weight[:, lane] = weights
        return bit


class _High:
    """The high bytes of all lanes' ids, by order-0 counts that are brought up to date from time to time."""

    def __init__(self, lanes: int):
        self.counts, self.base = np.ones(lanes * 256, np.int32), np.arange(lanes) * 256
        self.refresh()

    def refresh(self) -> None:
        self.own = self.counts.copy()
        self.ends = np.cumsum(self.own.reshape(-1, 256), axis=1, dtype=np.int32).reshape(-1)
        self.sixteen, self.coarse = self.ends.reshape(-1, 16), np.ascontiguousarray(self.ends.reshape(-1, 16, 16)[:, :, 15])

    def code(self, coder: _Coder, lane: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        base = self.base.take(lane)
        total = self.ends.take(base + 255)
        unit = coder.range.take(lane) // total
        if value is None:
            goal = np.minimum(coder.code.take(lane) // unit, total - 1)[:, None]
            row = lane * 16 + (self.coarse.take(lane, axis=0) <= goal).sum(axis=1)
            at = row * 16 + (self.sixteen.take(row, axis=0) <= goal).sum(axis=1)
        else:
            at = base + value
        own = self.own.take(at)
        _moved(coder, lane, unit * (self.ends.take(at) - own), unit * own)
        self.counts[at] += ADDS
        return at - base


def _moved(coder: _Coder, lane: np.ndarray, before: np.ndarray, new: np.ndarray) -> None:
    if coder.encodes:
        coder.low[lane] += before
    else:
        coder.code[lane] -= before
    coder.narrow(lane, new)


def _low_byte(coder: _Coder, lane: np.ndarray, value: np.ndarray | None) -> np.ndarray:
    """Eight bits, each value as likely as the next."""
    unit = coder.range.take(lane) >> 8
    if value is None:
        value = np.minimum(coder.code.take(lane) // unit, 255)
    _moved(coder, lane, unit * value, unit)
    return value


def _code(lengths: np.ndarray, ids: np.ndarray | None, words: np.ndarray | None) -> list[bytes] | np.ndarray:
    """Encode ``ids`` (longest, lanes) or decode ``words`` (lanes, room); ``lengths`` falls from lane to lane."""
    lanes, longest = len(lengths), int(lengths[0])
    encode = ids is not None
    coder = _Coder(lanes, words, 3 * longest // 2 * 2 + 8)
    out = ids if encode else np.zeros((longest, lanes), np.int32)
    # an entry is an id and its confidence, below 8
    table_2, table_1 = np.zeros(lanes << BITS_2, np.int32), np.zeros(lanes << BITS_1, np.int32)
    lane_2, lane_1 = np.arange(lanes) << BITS_2, np.arange(lanes) << BITS_1
    is_2, is_1, high = _Bits(lanes, (8, 16, 16)), _Bits(lanes, (8, 8, 16)), _High(lanes)
    last, earlier = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    hashed, past = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # lanes longer than t
    n = lanes
    for t in range(longest):
        if active[t] < n:
            n = int(active[t])
            last, earlier, hashed, past = last[:n], earlier[:n], hashed[:n], past[:n]
        if t % REFRESH == 0:
            high.refresh()
        own = last * 40503
        at_1 = lane_1[:n] + ((own >> 3) & ((1 << BITS_1) - 1))
        at_2 = lane_2[:n] + (((own + hashed) >> 3) & ((1 << BITS_2) - 1))
        entry_1, entry_2 = table_1.take(at_1), table_2.take(at_2)
        guess_1, guess_2 = entry_1 >> 3, entry_2 >> 3
        c1, c2 = entry_1 & 7, entry_2 & 7
        same = guess_1 == guess_2
        if encode:
            now = out[t, :n]
            right_2 = now == guess_2
            is_2.code(coder, None, n, [c2, c1 + 8 * same, past], right_2)
        else:
            right_2 = is_2.code(coder, None, n, [c2, c1 + 8 * same, past], None)
            now = np.where(right_2, guess_2, guess_1)
        past = (past << 1 | right_2) & 15
        rest = np.flatnonzero(~right_2)
        more = rest[~same.take(rest)]
        if len(more):
            right = is_1.code(coder, more, len(more), [c1.take(more), c2.take(more), past.take(more)], now.take(more) == guess_1.take(more) if encode else None)
            hit = np.zeros(n, bool)
            hit[more[right]] = True
            rest = rest[~hit.take(rest)]
        if len(rest):
            value = now.take(rest) if encode else None
            top = high.code(coder, rest, value >> 8 if encode else None)
            end = _low_byte(coder, rest, value & 255 if encode else None)
            if not encode:
                now[rest] = top << 8 | end
        if not encode:
            out[t, :n] = now
        for table, at, entry, guess, c, right in ((table_2, at_2, entry_2, guess_2, c2, right_2), (table_1, at_1, entry_1, guess_1, c1, guess_1 == now)):
            table[at] = np.where(right, entry + (c < 7), np.where(c > 1, guess, now) << 3 | c >> 1)
        hashed, last = last * 60493, now
    return coder.packed() if encode else out


def write_blocks(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """Blocks from (document table, ids), each of 1 to BLOCK ids below 65536."""
    out: list = [None] * len(blocks)
    for a in range(0, len(blocks), LANES):
        order = sorted(range(a, min(a + LANES, len(blocks))), key=lambda i: -len(blocks[i][1]))
        lengths = np.array([len(blocks[i][1]) for i in order])
        ids = np.zeros((len(order), lengths[0]), np.int32)
        for lane, i in enumerate(order):
            ids[lane, : lengths[lane]] = blocks[i][1]
        for i, words in zip(order, _code(lengths, np.ascontiguousarray(ids.T), None)):
            body = blocks[i][0].tobytes() + words
            out[i] = _HEAD.pack(MAGIC, VERSION, len(blocks[i][1]), len(blocks[i][0]), len(words) // 2, zlib.crc32(body)) + body
    return out


def read_blocks(blocks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document table, ids) of each block. A block of another kind, or one whose checksum doesn't fit, is an error."""
    parts = []
    for block in blocks:
        magic, version, n_ids, n_docs, n_words, crc = _HEAD.unpack_from(block)
        body = block[_HEAD.size :]
        if magic != MAGIC or version != VERSION or zlib.crc32(body) != crc:
            raise ValueError("not a block of token ids, or a damaged one")
        parts.append((np.frombuffer(body, _DOC, n_docs), np.frombuffer(body, "<u2", n_words, n_docs * _DOC.itemsize), n_ids))
    out: list = [None] * len(blocks)
    for a in range(0, len(blocks), LANES):
        order = sorted(range(a, min(a + LANES, len(blocks))), key=lambda i: -parts[i][2])
        lengths = np.array([parts[i][2] for i in order])
        words = np.zeros((len(order), max(len(parts[i][1]) for i in order) + 4), np.int32)
        for lane, i in enumerate(order):
            words[lane, : len(parts[i][1])] = parts[i][1]
        for lane, (i, ids) in enumerate(zip(order, _code(lengths, None, words).T.astype("<u4"))):
            out[i] = (parts[i][0], ids[: lengths[lane]])
    return out


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """Ids that part the rows into about equal ranges: one number less than ``parts``. An id of very many rows is several of them."""
    shares = [k / parts for k in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 20 * parts)).first()[0] if shares else None
    return found or []


def _encoded(docs: DataFrame, path: str, doc_id: str, text: str, end_id: int) -> DataFrame:
    """part, nth, n_ids, block: the blocks of each range of ids in the order of the ids.

    Texts become 16-bit ids where they are read, and only these are shuffled. Rows of an id that spans several ranges,
    null among them, are dealt over these by a checksum of their ids.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    lexicon = spark.sparkContext.broadcast(build_lexicon(docs, text, path).pack())
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    bounds = np.array(_bounds(rows.select("doc_id"), parts), np.int64)
    end = np.uint16(end_id).tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, lexicon.value)
        for batch in batches:
            keys = batch["doc_id"].to_numpy(np.int64)
            for a, b, numbers, counts in own.numbered(batch["text"].tolist()):
                flat, total = own.ids_of(numbers).astype("<u2"), np.concatenate(([0], np.cumsum(own.n_ids(numbers))))
                ends = total[np.cumsum(counts)]
                ids = [flat[i:j].tobytes() + end for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
                low, high = np.searchsorted(bounds, keys[a:b], "left"), np.searchsorted(bounds, keys[a:b], "right")
                part = low + np.array([zlib.crc32(x) for x in ids], np.int64) % (high - low + 1)
                yield pd.DataFrame({"part": part.astype(np.int32), "doc_id": keys[a:b], "ids": ids})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth, part, blocks, docs_of, ids_of, room = 0, 0, [], [], [], BLOCK

        def close() -> None:
            nonlocal docs_of, ids_of, room
            if ids_of:
                blocks.append((np.array(docs_of, _DOC), np.concatenate(ids_of)))
            docs_of, ids_of, room = [], [], BLOCK

        def flush() -> pd.DataFrame:
            nonlocal nth, blocks
            out = pd.DataFrame({"part": part, "nth": range(nth, nth + len(blocks)), "n_ids": [len(ids) for _, ids in blocks], "block": write_blocks(blocks)})
            nth, blocks = nth + len(blocks), []
            return out

        for batch in batches:
            for part, key, packed in zip(batch["part"].tolist(), batch["doc_id"].tolist(), batch["ids"]):
                ids = np.frombuffer(packed, "<u2")
                for at in range(0, len(ids), BLOCK):
                    piece = ids[at : at + BLOCK]
                    if len(piece) > room:
                        close()
                    docs_of.append((key, at, len(piece)))
                    ids_of.append(piece)
                    room -= len(piece)
                if len(blocks) >= LANES:
                    yield flush()
        close()
        if blocks:
            yield flush()

    dealt = rows.mapInPandas(encode, "part int, doc_id long, ids binary").repartitionById(parts, "part").sortWithinPartitions("doc_id", "ids")
    return dealt.mapInPandas(pack, "part int, nth long, n_ids long, block binary")


def write_tokens(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending order of ``doc_id`` (null first).

    ``folder`` gets one file per range of ids: a table of part, nth (of the block in its part), n_ids, block. Null and
    empty texts have the end id alone. Repeated rows are written each, as neighbours. A text longer than a block lies
    in several. Other columns of ``docs``, whatever their names, play no part. An empty table gives a table without rows.
    """
    _encoded(docs, path, doc_id, text, end_id).write.option("compression", "none").parquet(folder)


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document from the files of ``write_tokens``.

    start: ids of all documents before it. Sums by part, then by block, place each block; no task sees them all.
    A document's pieces in several blocks are put together by their positions.
    """
    files = spark.read.parquet(folder)
    earlier = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_start", F.coalesce(F.sum("n").over(earlier("part")), F.lit(0))).select("part", "part_start")
    starts = files.select("part", "nth", "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(earlier("nth", "part")), F.lit(0)))
    starts = starts.join(parts, "part").select("part", "nth", (F.col("part_start") + F.col("in_part")).alias("block_start"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for few in _together(batches, LANES):
            rows = []
            for part, nth, (docs, ids) in zip(few["part"], few["nth"], read_blocks(few["block"].tolist())):
                at = 0
                for key, before, n in docs.tolist():
                    own = ids[at : at + n].tobytes()
                    rows.append((part, nth, None if key == NO_ID else key, at - before, before, n, zlib.crc32(own), own if with_ids or before or n == BLOCK else None))
                    at += n
            out = pd.DataFrame(rows, columns=_PIECE)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    piece = files.select("part", "nth", "block").mapInPandas(each, "part int, nth long, doc_id long, shift long, before long, n long, crc long, ids binary")
    # a row for each piece; only documents of several pieces bring their ids along
    placed = piece.join(starts, ["part", "nth"]).withColumn("start", F.col("block_start") + F.col("shift"))
    whole = placed.groupBy("start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("pieces"), F.first("crc").alias("crc"), F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("before", "ids")))).alias("all"))
    joined = F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    more = [joined.alias("ids")] if with_ids else []
    return whole.select("doc_id", "start", "n_tokens", F.when(F.col("pieces") == 1, F.col("crc")).otherwise(F.crc32(joined)).alias("ids_crc32"), *more)


def _together(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """The rows of all batches, n at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= n:
            rows = pd.concat(held)
            whole = size - size % n
            yield from (rows.iloc[a : a + n] for a in range(0, whole, n))
            held, size = [rows.iloc[whole:]], size - whole
    if size:
        yield pd.concat(held)


_PIECE = ["part", "nth", "doc_id", "shift", "before", "n", "crc", "ids"]


def op5_token_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder)
