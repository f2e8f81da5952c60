"""Operators 1, 3 and 5 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lifecurve.llm import bpe, planes, tokencount
from lifecurve.llm.common import put_file, work_path

ODD = ["a", " ", "  ", "\n", "'", "'s", "'RE", "12", "!", "é", "中文", "Hello", " world", "\t", "\xa0", "　", "<|endoftext|>", "İ", "…", "\x1c", "don't", "\r\n", "Σ", "²"]


def texts(n, seed):
    rnd = random.Random(seed)
    for k in range(n):
        yield "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 90)))
        yield "".join(rnd.choice("abcdefghinorstuyé'1 ") for _ in range(k * 3 % 700))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def test_encoding_and_joins_equal_the_library(library):
    codec = bpe.Codec(bpe.default_path())
    for text in texts(400, 1):
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == want
        got = []
        for k, part in enumerate(codec.sections(text)):
            got += [codec.specials[part]] if k % 2 else codec.tree([np.frombuffer(codec.section(p), codec.kind) for p in bpe.halves(part, 37)])[0].tolist()
        assert got == want
        assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_counts_equal_the_library():
    library, counter = Tokenizer.from_file(tokencount.default_path()), tokencount.Counter(tokencount.default_path())
    for text in [*texts(400, 2), "<|startoftext|>a<|endoftext|>", "w" * 5000]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_merges_pop_the_lowest_rank_first():
    ranks = {1 << tokencount.SYMBOL | 2: 5 << tokencount.SYMBOL | 9, 2 << tokencount.SYMBOL | 1: 3 << tokencount.SYMBOL | 8}
    assert tokencount.merged_count([1, 2, 1, 2], ranks) == 3  # (2, 1) goes first and leaves no (1, 2)
    assert tokencount.merged_count([1, 2, 3, 1, 2], ranks) == 3
    assert tokencount.merged_count([7], ranks) == 1


def test_round_trip_rows(docs, none, rows, library):
    got = sorted(map(tuple, bpe.round_trip(docs, piece_chars=1000).drop("n_pieces", "tokens_again").collect()), key=repr)
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(none).count() == 0


def test_token_count_rows(docs, none, rows):
    library = Tokenizer.from_file(tokencount.default_path())
    got = sorted(map(tuple, tokencount.token_counts(docs, limit=100).collect()), key=repr)
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    assert got == sorted([(r[0], len((r[1] or "").encode()), k, k > 100) for r, k in zip(rows, n, strict=True)], key=repr)
    assert tokencount.token_counts(none).count() == 0


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_plane_files(spark, unit):
    parts = [np.random.default_rng(k).integers(0, 1 << 20, k * 7 % 900).astype("<u4") for k in range(40)]
    folder = work_path(spark, "planes")
    put_file(folder, "x.planes", planes.shard_bytes(iter(parts), unit, 512, 3))
    reader, whole = planes.ShardReader(folder, "x.planes"), np.concatenate(parts)
    assert [b[0] for b in reader.blocks] == [512] * (whole.size // 512) + [whole.size % 512] * (whole.size % 512 > 0)
    for first, n in [(0, whole.size), (5, 0), (511, 3), (1000, 3000), (whole.size - 1, 1)]:
        assert (reader.read(first, n) == whole[first : first + n]).all()
    assert (planes.from_planes(planes.to_planes(whole, unit), whole.size, unit) == whole).all()


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_plane_table(docs, none, rows, library, unit, monkeypatch):
    monkeypatch.setattr(planes, "LEAST_ROWS", 16)  # several shards
    ids = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    start, want = 0, []
    for doc, x in ids:
        want.append((doc, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = planes.ids_table(docs, unit=unit, block_ids=256)
    assert sorted(map(tuple, got.drop("shard", "first").collect()), key=lambda r: r[1]) == want
    assert got.select("shard").distinct().count() > 2
    assert planes.ids_table(none).count() == 0
