import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from asofkit.llm import packing, token_store
from asofkit.llm.tokens import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a", "a  b", "a \n b", "x\n\n y z ", "don't stop 's 5 %% é..! b c", "日本 語 text", "A" * 500 + " b", "<|endoftext|> a", "a<|endoftext|>", "a <|endoftext|><|endoftext|>b c<|endoftext", "<|endoftext|>", "word<|endoftext|> next one", "a\t b", "\x1c a \x1cb", "ÿ×÷ aº ª b²", "one.\nTwo it's", "a  b", "　 x", " lead", "a b"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_ids_are_the_tokenizers_own(plain, monkeypatch):
    from asofkit.llm import tokens

    r = random.Random(1)
    words = ["".join(r.choice("abcdeé .,\n'") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = ODD + [" ".join(r.choice(words) for _ in range(r.randint(0, 200))) for _ in range(60)] + ["word " * 5000, "x" * 3000]
    monkeypatch.setattr(tokens, "RUN_BYTES", 700)
    monkeypatch.setattr(tokens, "TABLE_WORDS", 150)
    e = TextEncoder(PATH)
    for _ in range(2):  # the second time with a filled table
        for text, ids in zip(texts, e.raw(texts)):
            assert ids == plain(text).tobytes(), repr(text)[:80]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    r = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        ids = r.integers(0, 1 << 32, n, dtype=np.uint32)
        planes = token_store.shuffle_planes(ids, kind)
        assert len(planes) == token_store.PLANES[kind]
        assert (token_store.join_planes(planes, n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_round_trip(spark, tmp_path, plain, kind):
    docs = [(i, f"text {i} " * (i % 7)) for i in range(40)] + [(None, "no key"), (7, "again"), (7, "again"), (50, None), (51, ""), (2**60 + 1, "far\nline\r\n")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    path = str(tmp_path / kind)
    token_store.write_tokens(df, path, PATH, kind=kind, block_ids=64, files=5)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    got = token_store.read_tokens(spark, path).orderBy("file", "place").collect()
    assert [r["doc_id"] for r in got] == [k for k, _ in order]
    assert [bytes(r["ids"]) for r in got] == [plain(t).tobytes() + b"\0\0\0\0" for _, t in order]
    index = token_store.token_index(spark, path).orderBy("start").collect()
    assert [r["start"] for r in index] == np.cumsum([0] + [len(plain(t)) + 1 for _, t in order])[:-1].tolist()
    data = max((f.read_bytes() for f in (tmp_path / kind).glob("part-*")), key=len)
    reader = token_store.PlaneReader(data)
    whole = b"".join(ids for _, ids in reader.documents())
    assert reader.block(1).tobytes() == whole[256:512]
    with pytest.raises(ValueError):
        token_store.PlaneReader(data[:60] + b"zzzz" + data[64:]).block(0)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string, length string")
    assert packing.pack(none, PATH).count() == 0
    token_store.write_tokens(none, str(tmp_path / "none"), PATH)
    assert token_store.token_index(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plans_fill_bins(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    counts = {n: r.choice([0, 0, 1, 2, 5, 40]) for n in range(1, capacity + 1)}
    slots, bins = packing.plan_bins(counts, capacity)
    inside = {}
    for n, first, number, base, offset in slots:
        for i in range(number):
            inside.setdefault(base + i, []).append((offset, n))
    assert sum(x[2] for x in slots) == sum(counts.values())
    for n, c in counts.items():  # ordinals are covered once
        assert sorted(o for m, f, k, _, _ in slots if m == n for o in range(f, f + k)) == list(range(c))
    for items in inside.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    gaps = []  # first fit, descending
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= n), None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps[at] -= n
    assert len(inside) == bins <= len(gaps) * 1.03 + 1


def test_pieces(spark, plain):
    docs = [(1, "a b c"), (2, None), (3, "word " * 300), (3, "word " * 300), (None, "x"), (5, "")] + [(10 + i, "some text here " * i) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = packing.pack(df, PATH, capacity=64).collect()
    want = []
    for k, t in docs:
        ids = np.append(plain(t), 0).astype("<u4")
        at, end = 0, len(ids) % 64 or 64
        piece = 0
        while at < len(ids):
            want.append((k, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, end, piece = end, end + 64, piece + 1
    assert sorted(((r[0], *r[1:5]) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 64
