import hashlib
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rollbook.llm import bpe, token_codec, token_counts
from rollbook.llm.pretokens import BEYOND, Cut, Known

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = ["Hello WORLD's it'll x\x85y  ", "<|endoftext|> a<|startoftext|>b", "naïve ÀÉ² ½ 12 ---", "日本語 é ΣΑΣ", "a\x1cb\x1fc", "x" * 300 + " " + "ab!" * 100, "", " \n\n a \t", "İstanbul ſ K", "😀😀 ok’s “q” …", "'S 'LL don'T", "a  b   c \n "]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


library = lru_cache(Tokenizer.from_file)  # reading a file takes a second


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_merges_equal_the_library(path):
    own = bpe.load(path)
    for text in TEXTS:
        got = []
        for part, special in own.segments(text):
            got += [own.specials[part]] if special else [i for ids in own.merge([w.encode("utf-8", "surrogateescape") for w in own.cut(part)]) for i in ids]
        assert got == ids_of(path, text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cutting_side_by_side_equals_cutting_one_by_one(path):
    own = bpe.load(path)
    low = [t.lower() if own.lower else t for t in TEXTS]
    plain = [t for t in low if "<|" not in t and not BEYOND.search(t)]
    cut = Cut(plain, bool(own.suffix))
    words = cut.words(np.arange(len(cut.start)))
    assert words == [w for t in plain for w in own.cut(t)] and cut.counts.tolist() == [len(own.cut(t)) for t in plain]
    met: list[str] = []
    known = Known(met.extend, met.clear, 1000)
    for _ in range(2):
        assert [met[k] for k in known.of_cut(cut)] == words


def test_heap_and_side_by_side_agree():
    own = bpe.load(BYTE)
    words = [b"internationalization", b"aaaaaaaaaaaa", "größenordnung".encode(), b"=" * 40, b"q"]
    assert own.merge(words) == [own._with_heap(w) for w in words]


def test_lexicon():
    own = bpe.load(WORD)
    words = [b"nation", b"national", b"station", b"stations", b"a", "été".encode()]
    made = dict(zip(words, own.merge(words)))
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build(made).pack())
    number = lexicon.find([*words, b"nat", b"zebra", b"stationss", b"x" * 300])
    assert sorted(number[:6]) == list(range(6)) and (number[6:] == -1).all()
    assert all(lexicon.ids[lexicon.start[k] : lexicon.start[k + 1]].tolist() == made[w] for w, k in zip(words, number))
    assert len(bpe.Lexicon.build({w: [1] for w in (b"tested", b"rested", b"nested")}).keys) == 8, "the endings are shared"
    assert (bpe.Lexicon.build({}).find([b"a"]) == -1).all()


def check_encoding(rows, got):
    assert len(got) == len(rows)
    want = {}
    for i, text in rows:
        ids = ids_of(WORD, text)
        want.setdefault(i, (len(ids), sha(" ".join(map(str, ids))), sha(library(WORD).decode(ids, skip_special_tokens=False))))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)


def test_encode_decode(spark, small, odd, odd_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_encoding([(r.doc_id, r.text) for r in docs.collect()], bpe.op8_bpe(spark, small).collect())
    check_encoding([(r[0], r[1]) for r in odd_rows], bpe.encode_decode(odd, WORD).collect())
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = bpe.encode_decode(texts, WORD, with_ids=True).collect()
    check_encoding(list(enumerate(TEXTS)), got)
    assert all(list(r.ids) == ids_of(WORD, TEXTS[r.doc_id]) for r in got)


def test_counts(spark, small, odd, odd_rows, empty):
    def check(rows, df):
        count = lambda t: (len((t or "").encode()), len(ids_of(BYTE, t)))
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()) == Counter((i, *count(t), count(t)[1] > 512) for i, t in rows)

    docs = spark.read.parquet(f"{small}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], token_counts.op6_token_counts(spark, small))
    check([(r[0], r[1]) for r in odd_rows], token_counts.count_tokens(odd, BYTE))
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(list(enumerate(TEXTS)), token_counts.count_tokens(texts, BYTE))
    assert token_counts.count_tokens(empty, BYTE).collect() == [] and bpe.encode_decode(empty, WORD).collect() == []


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    table = lambda n: np.array([(5, 0, n)], token_codec._DOC)
    streams = [rng.zipf(1.3, 700) % 49408, rng.integers(0, 65536, 300), np.full(500, 7), np.arange(1), np.tile(np.arange(20), 60)]
    blocks = [(table(len(s)), s.astype(np.uint16)) for s in streams]
    packed = token_codec.write_blocks(blocks)
    for (docs, ids), (docs_2, ids_2) in zip(blocks, token_codec.read_blocks(packed)):
        assert (docs == docs_2).all() and (ids == ids_2).all()
    assert len(packed[2]) < 120 and len(packed[4]) < 600
    with pytest.raises(ValueError):
        token_codec.read_blocks([packed[0][:-1] + bytes([packed[0][-1] ^ 1])])


def check_files(rows, got):
    start = 0
    for (i, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), sorted(got, key=lambda r: r.start)):
        ids = np.array([*ids_of(WORD, text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(got)


def test_token_files(spark, odd, odd_rows, empty, tmp_path):
    token_codec.write_tokens(odd, WORD, f"file://{tmp_path}/a")
    check_files([(r[0], r[1]) for r in odd_rows], token_codec.read_tokens(spark, f"file://{tmp_path}/a").collect())
    token_codec.write_tokens(empty, WORD, f"file://{tmp_path}/b")
    assert token_codec.read_tokens(spark, f"file://{tmp_path}/b").collect() == []


def test_token_files_of_the_whole_table_and_the_encoder_that_both_queries_share(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_files(rows, token_codec.op5_token_codec(spark, small).collect())
    check_encoding(rows, bpe.op8_bpe(spark, small).collect())
    check_files(rows, token_codec.op5_token_codec(spark, small).collect())


def test_one_id_of_most_rows_is_dealt_over_several_files(spark, tmp_path):
    rows = [(7, f"text number {k} " * (k % 5)) for k in range(200)] + [(None, f"row {k}") for k in range(100)] + [(9, "end"), (2, None)]
    token_codec.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORD, f"file://{tmp_path}/a")
    assert spark.read.parquet(f"file://{tmp_path}/a").select("part").distinct().count() >= 3
    got = token_codec.read_tokens(spark, f"file://{tmp_path}/a", with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 100 + [2] + [7] * 200 + [9]
    want = sorted((i is not None, i or 0, np.array([*ids_of(WORD, t), 2], "<u4").tobytes()) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_a_long_text_lies_in_several_blocks(spark, tmp_path):
    text = " ".join(f"word{k % 977}" for k in range(3 * token_codec.BLOCK))
    token_codec.write_tokens(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), WORD, f"file://{tmp_path}/a")
    check_files([(1, text), (2, "x")], token_codec.read_tokens(spark, f"file://{tmp_path}/a").collect())


def test_blocks_of_several_batches_are_decoded_together():
    frames = [pd.DataFrame({"n": range(a, b)}) for a, b in ((0, 3), (3, 4), (4, 4), (4, 17), (17, 19))]
    got = [x["n"].tolist() for x in token_codec._together(iter(frames), 5)]
    assert [len(x) for x in got] == [5, 5, 5, 4] and sum(got, []) == list(range(19))
    assert list(token_codec._together(iter([]), 5)) == []
