import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenlit.llm.bpe import Bpe, bpe_decode, bpe_encode, read_ranks
from lumenlit.llm.pieces import PieceTable
from lumenlit.llm.store import shared_dir
from lumenlit.llm.token_store import DacFile, _table, dac_bytes, token_store, write_token_store

TEXTS = ["", " ", "  two  spaces ", "a\n b\n\n  c\t d", "it's O'Neil's--really", "naïve café 北京 🙂🙂", "x" * 5000, "<|endoftext|>", "end <|endoftext|> mid", "tab\t \t mix \r\n", "\x00\x1c \x85 \xa0 z", "1,234.50 #### ***", " lead", "trail "]
PATH = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def libs():
    ranks = read_ranks(RANKS)
    return Tokenizer.from_file(PATH), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Bpe(ranks, P.PATTERN)


def _split(flat, n):
    ends = np.concatenate(([0], np.cumsum(n)))
    return [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_pieces_equal_whole_texts(libs):
    whole, tik, own = libs
    assert _split(*_table(PATH, 2).encode(TEXTS)) == [whole.encode(t, add_special_tokens=False).ids + [2] for t in TEXTS]
    assert _split(*own.encode(TEXTS)) == [tik.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t'sab1é,#<|>endoftx ̀"), max_size=30), max_size=4))
def test_pieces_on_any_text(libs, texts):
    whole, tik, own = libs
    assert _split(*_table(PATH, 2).encode(texts)) == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    flat, n = own.encode(texts)
    assert _split(flat, n) == [tik.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in _split(flat, n)] == [t.encode() for t in texts]


def test_table_that_starts_anew(libs):
    whole = libs[0]
    t = PieceTable(lambda m: [whole.encode(x, add_special_tokens=False).ids for x in m], max_chars=10)
    for _ in range(3):
        assert _split(*t.encode(TEXTS)) == [whole.encode(x, add_special_tokens=False).ids for x in TEXTS]


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**31])
def test_codes_give_every_token_back(tmp_path, top):
    ids = np.random.default_rng(top).integers(0, top, 3001).astype(np.uint32)
    ids[::7] = 0
    path = tmp_path / "x.dac"
    path.write_bytes(dac_bytes([5, None], np.array([1000, 2001]), ids))
    f = DacFile(str(path))
    assert f.slice(0, 3001).tolist() == ids.tolist()
    assert f.slice(513, 1400).tolist() == ids[513:1400].tolist()
    assert [f.token(i) for i in range(0, 3001, 13)] == ids[::13].tolist()
    assert f.documents()[0] == [5, None]
    with pytest.raises(IndexError):
        f.token(3001)


def test_token_store(spark, libs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (99, None)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, start string")
    got = token_store(spark, df, shared_dir(spark, "t"), PATH, tokens_per_file=50).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = libs[0].encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert not token_store(spark, df.limit(0), shared_dir(spark, "t"), PATH).collect()
    files = write_token_store(df, shared_dir(spark, "t"), PATH).collect()
    assert sum(f.n_tokens for f in files) == at


def test_bpe_query_and_decoding(spark, libs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (1, " ")], "doc_id long, text string")
    got = bpe_encode(df, RANKS, P.PATTERN)
    for r, back in ((r, r.decoded) for r in bpe_decode(got, RANKS, P.PATTERN).collect()):
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "").encode()
        assert bytes(back) == text and r.decoded_sha256 == hashlib.sha256(text).hexdigest()
        ids = libs[1].encode_ordinary(text.decode())
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert not bpe_encode(df.limit(0), RANKS, P.PATTERN).collect()


def test_a_second_attempt_leaves_one_whole_file(tmp_path):
    from lumenlit.llm.store import AtomicFile

    class Strict:  # as file systems that don't move over a file
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, a, b):
            if (tmp_path / "x" / "f").exists():
                raise OSError("it is there")
            self.fs.move(a, b)

    uri = f"file://{tmp_path}/x/f"
    for _ in range(2):
        f = AtomicFile(uri)
        f.fs = Strict(f.fs)
        with f as out:
            out.write(b"same")
    with pytest.raises(ZeroDivisionError):
        with AtomicFile(uri) as out:
            out.write(b"half")
            1 / 0
    assert (tmp_path / "x" / "f").read_bytes() == b"same" and len(list((tmp_path / "x").iterdir())) == 1


def test_files_are_read_a_bounded_number_of_tokens_at_once(tmp_path, monkeypatch):
    import zlib

    from lumenlit.llm import token_store

    counts, rng = np.array([3, 1_200_000, 400_000, 1, 90_000, 70_000]), np.random.default_rng(3)
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint32)
    (tmp_path / "x.dac").write_bytes(token_store.dac_bytes([5, 6, None, 8, 9, 10], counts, ids))
    own, sizes = token_store.DacFile(str(tmp_path / "x.dac")), []
    slice_of = token_store.DacFile.slice
    monkeypatch.setattr(token_store.DacFile, "slice", lambda self, a, b: (sizes.append(b - a), slice_of(self, a, b))[1])
    got = [row for part in token_store.stored(own) for row in zip(*part)]
    ends = np.cumsum(counts)
    assert got == [(d, e - n, e, zlib.crc32(ids[e - n : e].tobytes())) for d, n, e in zip([5, 6, None, 8, 9, 10], counts, ends)]
    assert max(sizes) <= 500_000 and sum(sizes) == counts.sum()


def test_texts_that_go_whole_to_the_library_go_in_small_lots():
    asked: list[int] = []

    def codes(many):
        asked.append(sum(map(len, many)))
        return [list(map(ord, x)) for x in many]

    texts = ["a  b" + str(i) * 3000 for i in range(400)] + ["one two"]
    ids, counts = PieceTable(codes, end=7).encode(texts)
    assert ids.tolist() == [x for t in texts for x in (*map(ord, t), 7)] and counts.tolist() == [len(t) + 1 for t in texts]
    assert sum(asked) > 2_000_000 and max(asked) < 300_000
