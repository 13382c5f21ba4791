"""Packed files and packed sequences against the tokenizer itself."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from moundworks.llm import packed_ids, packing
from moundworks.llm.queries import tokenizer_path
from moundworks.llm.tokens import ChunkEncoder, encoded

pytest.importorskip("tokenizers")
ODD = ["", " ", "  a", " a b", "a  b", "a \n b", "x  y", "don't 's q's\n", "a <|endoftext|> b", "<|endoftext|>x y", "\x1c a \x1cb", "a b ", "x, y. Z!? 'll, é. a1. 1,", "naïve  space", "word " * 3000, None]


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(tokenizer_path(), limit=500)


def reference(encoder, text, end=(2,)):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_chunks_give_the_library_ids(encoder):
    for text in ODD:
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == reference(encoder, text, ())


def test_any_mixture_of_white_space_and_signs_gives_the_library_ids(encoder):
    parts = ["word", "Über", "ñ", "12", " ", " ", "\n", "\n\n", "\n\n\n", "\r\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "'s", "'", "...", "$$$", "_", "<|endoftext|>", "<|", "|>", "\u4e2d\u6587", "\U0001f600", "e\u0301", "\x00"]
    pick = np.random.default_rng(7)
    texts = ["".join(pick.choice(parts, pick.integers(0, 12))) for _ in range(3000)] + ["\n".join(["word, Über$$$ x"] * 9), "a\n\nb\nc\n\nd e", "a\r\nb\n\n\nc d"]
    got = encoder.encode_array(pa.array(texts))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [reference(encoder, t, ()) for t in texts]
    assert [encoder.encode(t) for t in texts[:200]] == got[:200]


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    """Lines and signs make no new chunks: the library gets a word once for each way it starts."""

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.n = tokenizer, 0

        def encode(self, text, **more):
            self.n += len(text)
            return self.tokenizer.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            self.n += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **more)

    by = ChunkEncoder(tokenizer_path())
    words = ["".join(chr(97 + i * k % 26) for k in range(1, 9)) for i in range(1, 26)]
    lines = [f"{a}{sign}\n{b} {a}" for a in words for b in words for sign in ("", ".", "$$$", "%%%")]
    want = [struct.pack(f"<{len(ids)}I", *ids) for ids in (by.tokenizer.encode(t, add_special_tokens=False).ids for t in lines)]
    by.tokenizer = Counting(by.tokenizer)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], names=["doc_id", "text"])
    assert list(encoded(by, batch)) == list(enumerate(want))
    assert by.tokenizer.n <= 2 * 9 * len(words) + 100


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, np.uint64).astype(np.uint32)
    assert len(packed_ids.pack(ids, bits)) == -(-len(ids) * bits // 8)
    f = packed_ids.IdFile(packed_ids.to_file([3, None], [10_000, 1], ids, bits, block=64))
    assert f.range(0, f.n_ids).tolist() == ids.tolist()
    assert f.range(777, 1234).tolist() == ids[777:1234].tolist()
    assert f.document(1).tolist() == ids[10_000:].tolist()
    assert f.range(5, 5).tolist() == []
    assert f.is_null.tolist() == [False, True]


def test_files_give_documents_in_order(docs, encoder, tmp_path):
    rows = [(i * 37 % 101, ODD[i % len(ODD)]) for i in range(50)]
    folder = f"file://{tmp_path}/ids"
    manifest = packed_ids.write(docs(rows).repartition(4), folder, tokenizer_path(), shard_ids=50)
    assert manifest.count() > 4
    got = sorted(map(tuple, packed_ids.read(manifest, folder).collect()))
    at, want = 0, []
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = reference(encoder, text)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    names = [p.name for p in (tmp_path / "ids").iterdir() if not p.name.startswith(".")]
    assert len(names) == manifest.count()


def test_no_documents(docs):
    assert packed_ids.encode_and_read(docs([]), tokenizer_path()).count() == 0
    assert packing.pack(docs([]), tokenizer_path()).count() == 0


def test_sequences_are_full_and_gapless(docs, encoder):
    rows = [(i, " ".join(f"word{j}" for j in range(i * 53 % 400))) for i in range(120)] + [(500, "again"), (None, None), (500, "again")]
    got = packing.pack(docs(rows).repartition(3), tokenizer_path(), capacity=64, open_bins=32, group_pieces=200).collect()
    ids = [reference(encoder, t) for _, t in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64
    assert len(filled) <= 1.03 * sum(filled.values()) / 64 + 2
    of = {}
    for r in got:
        of.setdefault((r.doc_id, r.row), []).append(r)
    assert len(of) == len(rows)
    by_id = {d: x for (d, _), x in zip(rows, ids, strict=True)}
    for (d, _), pieces in of.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == 64 for p in pieces[1:])
        assert [crc(by_id[d][p.start : p.start + p.length]) for p in pieces] == [p.ids_crc32 for p in pieces]


def test_the_fullest_bin_takes_and_the_fullest_closes():
    b = packing.BestFit(10, 2)
    assert [b.place(x) for x in (4, 7, 3, 6, 5)] == [(0, 0), (1, 0), (1, 7), (0, 4), (2, 0)]
    b = packing.BestFit(10, 2)
    assert [b.place(x) for x in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_tasks_are_bounded(spark):
    """100 TB make no more tasks than a shuffle can have, whatever a task's share is."""
    from moundworks.llm import shared

    assert shared.parts(spark, 100 * 10**12, 8 << 20) == shared.MOST_PARTS == 20_000
    assert shared.parts(spark, 100 * 10**12, 2 << 20, 1 << 15) == 1 << 15
    assert shared.parts(spark, 100 * 10**12, 4 << 20, most=None) == -(-100 * 10**12 // (4 << 20))
    assert shared.parts(spark, 0, 8 << 20) == int(spark.conf.get("spark.sql.shuffle.partitions"))
