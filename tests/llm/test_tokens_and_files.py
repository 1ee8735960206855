import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from solvara.llm import packing, token_files, tokens
from solvara.llm.tokens import Encoder
from solvara.storage import shared_dir
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_call(texts, plain_specials=False):
    """Ids of each text by the library's plain call."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain_specials
    return [np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def library():
    return plain_call


def encoded(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    return [ids[at[k] : at[k + 1]].tobytes() for k in range(len(texts))]


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85", "a", "Word", "é", "×", "÷", "ñandú", "don't", "'s", "'", "'re", "12", "3a4", "²", "½", "_", "<|endoftext|>", "日本", "😀", "e\u0301", "--", "x" * 60, "ª", "\x00", "µ", "\u200b", "“", "s", "ll"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(n)] + [None, "", " ", "<|endoftext|>", "a <|endoftext|> b"]


@pytest.mark.parametrize("plain_specials", [False, True])
def test_encoder_equals_library_on_odd_texts(plain_specials):
    texts = odd_texts(3, 3000)
    want = plain_call(texts, plain_specials)
    encoder = Encoder(PATH, plain_specials)
    assert encoded(encoder, texts) == want
    assert encoded(encoder, texts) == want  # from the cache
    assert (want[-2] == np.array([50256], "<u4").tobytes()) != plain_specials


def test_encoder_equals_library_in_small_slices_and_with_few_pieces_kept(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 50)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 3 << 20)
    dropped = []
    bounded = tokens.Pieces.bounded
    monkeypatch.setattr(tokens.Pieces, "bounded", lambda self, most: (dropped.append(self.n), bounded(self, most), dropped.append(self.n)))
    encoder, rng = Encoder(PATH), random.Random(4)
    for seed in range(3):
        texts = odd_texts(seed, 100) + [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 20))) for _ in range(20_000))]
        assert encoded(encoder, texts) == plain_call(texts)
    assert any(b < a for a, b in zip(dropped[::2], dropped[1::2]))


def test_another_pre_tokenizer_is_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    texts = odd_texts(5, 200)
    encoder = Encoder(str(tmp_path / "other.json"))
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert not encoder.by_pieces and encoded(encoder, texts) == want and want != plain_call(texts)


def test_file_round_trip_and_random_access(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 5)
    docs = [(7, np.arange(12, dtype="<u4").tobytes()), (None, b""), (9, np.arange(5, dtype="<u4").tobytes())]
    stream = io.BytesIO()
    writer = token_files.FileWriter(stream)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    data = stream.getvalue()
    reader = token_files.FileReader(io.BytesIO(data), len(data))
    assert reader.doc_ids == [7, None, 9] and list(reader.sizes) == [12, 0, 5]
    assert [reader.ids(k) for k in (2, 0, 1)] == [docs[2][1], docs[0][1], docs[1][1]]
    broken = bytearray(data)
    broken[20] ^= 0xFF
    with pytest.raises(Exception):
        token_files.FileReader(io.BytesIO(bytes(broken)), len(data)).ids(0)


def test_files_hold_all_documents_in_order(spark, library):
    rows = cases.rows()
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(5)
    folder = shared_dir(spark)
    files = token_files.write_token_files(df, folder, PATH, partitions=3)
    got = {r.doc_id: r for r in token_files.read_token_files(files, folder).collect()}
    start = 0
    for (d, text), ids in zip(sorted((r[0], r[1]) for r in rows), library([t for _, t in sorted((r[0], r[1]) for r in rows)])):
        want = ids + (2).to_bytes(4, "little")
        assert (got[d].start, bytes(got[d].ids)) == (start, want)
        start += len(want) // 4
    some = token_files.read_token_files(files, folder, wanted=[rows[4][0]]).collect()
    assert [bytes(r.ids) for r in some] == [bytes(got[rows[4][0]].ids)]


def test_files_of_odd_and_empty_tables(spark):
    df = spark.createDataFrame(cases.odd_rows(), cases.SCHEMA)
    folder = shared_dir(spark)
    assert token_files.read_token_files(token_files.write_token_files(df, folder, PATH), folder).count() == len(cases.odd_rows())
    folder = shared_dir(spark)
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), folder, PATH), folder).count() == 0


def brute_best_fit(lengths, size):
    left, count = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(left) if c >= n]
        if fits:
            i = min(fits, key=lambda i: left[i])
            left[i] -= n
        else:
            left.append(size - n)
            count += 1
    return sorted(left)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_equals_search(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(200)]
    placed = packing.best_fit_decreasing(lengths, 64)
    windows: dict[int, list] = {}
    for (w, offset), n in zip(placed, lengths):
        windows.setdefault(w, []).append((offset, n))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(64 - sum(n for _, n in p) for p in windows.values()) == brute_best_fit(lengths, 64)


@pytest.mark.parametrize("odd", [False, True])
def test_packing_keeps_every_id_once(spark, library, odd):
    rows = cases.odd_rows() if odd else cases.rows()
    got = packing.pack_documents(spark.createDataFrame(rows, cases.SCHEMA).repartition(3), PATH, size=64).collect()
    want: dict = {}
    for r, ids in zip(rows, library([r[1] for r in rows])):
        want.setdefault(r[0], []).append(ids + (1).to_bytes(4, "little"))
    pieces: dict = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 64 and r.offset + r.length <= 64
        pieces.setdefault(r.doc_id, []).append(r)
    for d, texts in want.items():
        assert sorted((p.start, zlib.crc32(p.ids)) for p in pieces[d]) == sorted((s, zlib.crc32(t[4 * s : 4 * (s + 64)])) for t in texts for s in range(0, len(t) // 4, 64))
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert packing.pack_documents(spark.createDataFrame([], cases.SCHEMA), PATH).count() == 0


def test_queries_digest_what_the_library_gives(spark, tmp_path):
    rows = cases.rows()
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    texts = sorted((r[0], r[1]) for r in rows)
    ids = dict(zip([d for d, _ in texts], plain_call([t for _, t in texts])))
    end, start = lambda x: x.to_bytes(4, "little"), 0
    files = {r.doc_id: r for r in token_files.op1_token_files(spark, str(tmp_path)).collect()}
    assert len(files) == len(rows)
    for d, _ in texts:
        whole = ids[d] + end(2)
        assert (files[d].start, files[d].n_tokens, files[d].ids_crc32) == (start, len(whole) // 4, zlib.crc32(whole))
        start += len(whole) // 4
    pieces: dict = {}
    packed = packing.op10_packing(spark, str(tmp_path))
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for p in packed.collect():
        pieces.setdefault(p.doc_id, []).append(p)
    for d, _ in texts:
        whole, at = ids[d] + end(1), 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            part = whole[4 * p.start : 4 * (p.start + p.length)]
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(part), len(whole) // 4) and p.offset + p.length <= 2048
            at += p.length
        assert 4 * at == len(whole)
