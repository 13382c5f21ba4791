"""Byte-level BPE encoding by the ``tokenizers`` library, one call for each distinct chunk of text.

A byte-level BPE tokenizer first splits a text by a pattern and then merges inside the pieces, so
ids of a text are the ids of its pieces one after another. A single space or line end between two
characters that are no white space always starts a piece, and two line ends there are a piece each.
Texts are therefore cut there, each distinct chunk is encoded once by the library, and the ids are
joined as little-endian unsigned 32-bit integers. Arrow cuts the texts and finds a batch's distinct chunks. Texts with other white space around a cut go to the library whole.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
STOPS = ".,;:!?\"#$%&()*+-/<=>@[\\]^_`{|}~"  # no apostrophe: with letters behind it, it may be a piece of another kind
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores


class ChunkEncoder:
    """``encode(text)`` gives the ids as bytes, four to an id. Memory is bounded: about ``limit``
    chunks are remembered beside those of a batch."""

    def __init__(self, path: str, limit: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = str(self.tokenizer.pre_tokenizer)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.by_chunk = (
            self.tokenizer.normalizer is None
            and pre.startswith("ByteLevel(")
            and "add_prefix_space=False" in pre
            and "use_regex=True" in pre
            and not any(t.lstrip or t.rstrip or any(map(str.isspace, t.content)) for t in added)
            and not any(t.content[-1:] in STOPS and t.content.rstrip(STOPS).isalpha() for t in added)
            and len(self.whole("\n")) == 4
        )
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # chunks are remembered here; each is asked for once
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.begins_chunk = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins_chunk[i] = token.startswith(("\u0120", "\u010a"))  # a space and a line end, as byte-level tokens write them

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks are without the space before them, but with the line ends.

        Many chunks go to the library as one text: in its ids, those whose token begins with a space
        or a line end begin a chunk. A chunk with more white space goes alone.
        """
        names, texts = [], []
        for c in chunks:
            text = c if c[0] == "\n" else " " + c
            if c.isalpha() or not any(map(str.isspace, text[1:])):
                names.append(c)
                texts.append(text)
            else:
                yield c, self.whole(text)
        for at in range(0, len(names), 2000):  # of one call, so that few encodings are held
            starts = range(at, min(at + 2000, len(names)), 50)
            for i, e in zip(starts, self.tokenizer.encode_batch_fast(["".join(texts[i : i + 50]) for i in starts], add_special_tokens=False), strict=True):
                run, ids = names[i : i + 50], np.array(e.ids, "<u4")
                begins = np.flatnonzero(self.begins_chunk[ids])
                if len(begins) != len(run):
                    raise ValueError("chunks and ids do not agree")
                raw, cut = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
                for c, k, end in zip(run, cut, cut[1:], strict=False):
                    yield c, raw[k:end]

    def recall(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. What a second batch asks for again is kept longer than what only one had."""
        if len(self.known) > self.limit * 7 // 10:
            self.fresh, self.known = self.known, {}
        room = self.limit - len(self.known)
        if len(self.fresh) > room:
            self.fresh = dict(islice(self.fresh.items(), len(self.fresh) - room * 3 // 4, None))  # the newest
        known, fresh = self.known, self.fresh
        got = list(map(known.get, chunks))
        missing = [c for c, ids in zip(chunks, got, strict=True) if ids is None]
        if missing:
            now, new = {}, []
            for c in missing:
                ids = fresh.pop(c, None)
                if ids is None:
                    new.append(c)
                else:
                    known[c] = now[c] = ids
            for c, ids in self.learn(new):
                fresh[c] = now[c] = ids
            got = [now[c] if ids is None else ids for c, ids in zip(chunks, got, strict=True)]
        return got

    def tail(self, text: str) -> bytes:
        if text not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[text] = self.whole(text)
        return self.tails[text]

    def distinct(self, chunks: pa.Array) -> np.ndarray:
        """Ids of a batch's distinct chunks; none marks those where a cut is not safe.

        Punctuation after letters is a piece of its own, so it is split off before chunks are looked up.
        """
        bases = pc.utf8_rtrim(chunks, characters=STOPS)
        plain = pc.utf8_is_alpha(pc.utf8_ltrim(bases, characters="\n"))
        others, full, bases = strings(chunks.filter(pc.invert(plain))), chunks.filter(plain), bases.filter(plain)
        safe = [c for c in others if c and not c[-1].isspace() and not c.lstrip("\n")[0].isspace()]
        short = bases.dictionary_encode()
        names = strings(short.dictionary)
        ids = self.recall(names + safe)
        by_name = np.array([*ids[: len(names)], None], object)[:-1]
        whole = by_name[short.indices.to_numpy()]
        n_tail = pc.subtract(pc.binary_length(full), pc.binary_length(bases)).to_numpy()
        tailed = np.flatnonzero(n_tail)
        tails = [self.tail(c[-n:]) for c, n in zip(strings(full.take(pa.array(tailed))), n_tail[tailed].tolist(), strict=True)]
        whole[tailed] += np.array([*tails, None], object)[:-1]
        by_safe = dict(zip(safe, ids[len(names) :], strict=True))
        is_plain = plain.to_numpy(zero_copy_only=False)
        out = np.empty(len(chunks), object)
        out[is_plain], out[~is_plain] = whole, [by_safe.get(c, b"") for c in others]
        return out

    def encode_array(self, texts: pa.Array, runs: bool = False) -> list[bytes]:
        """Ids of each text. With ``runs`` line ends stay inside a chunk where there are more than two
        together or other white space is beside them; that is slower, and only for texts that need it."""
        if not self.by_chunk or not len(texts):
            return [self.whole(t) for t in texts.to_pylist()]
        texts = texts.cast(pa.large_string())
        if runs:
            cut = pc.replace_substring_regex(texts, r"(\S)(\n\n?)(\S)", r"\1 \2\3")
        else:  # white space beside a line end leaves a chunk that is empty or ends in white space
            cut = pc.replace_substring(pc.replace_substring(texts, "\n", " \n"), " \n \n", " \n\n")
        empty, end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        cut = pc.split_pattern(pc.binary_join_element_wise(empty, cut, end), " ")  # a line end before each text, left out below
        bounds, chunks = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        each, k = self.distinct(chunks.dictionary), chunks.indices.to_numpy()
        none = np.fromiter((not ids for ids in each), bool, len(each))
        unsafe = np.logical_or.reduceat(none[k], bounds[:-1])
        if runs:
            unsafe |= pc.match_substring_regex(texts, r"\A\s| \n").to_numpy(zero_copy_only=False)
        words, bounds = each[k].tolist(), bounds.tolist()
        out = [words[i][4:] + b"".join(words[i + 1 : j]) for i, j in zip(bounds, bounds[1:], strict=False)]
        if unsafe.any():
            at = np.flatnonzero(unsafe)
            rest = texts.take(pa.array(at))
            for i, ids in zip(at.tolist(), [self.whole(t) for t in rest.to_pylist()] if runs else self.encode_array(rest, runs=True), strict=True):
                out[i] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_array(pa.array([text]))[0]


def strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker: Spark gives a worker task after task, and chunks stay known."""
    return ChunkEncoder(path)


def encoded(by: ChunkEncoder, batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[tuple[int | None, bytes]]:
    """First column and the ids of the second, some MB of text at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
    i = 0
    while i < len(ends):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size)) + 1
        yield from zip(batch.column(0)[i:j].to_pylist(), by.encode_array(batch.column(1)[i:j]), strict=True)
        i = j
