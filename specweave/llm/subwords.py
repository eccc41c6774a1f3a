"""Ids of whole texts by a public byte-level BPE tokenizer, with the ids of repeated words remembered.

The pre-tokenizer of byte-level BPE never joins characters across a single space between two other
characters (the space belongs to what follows) nor across a single line end between them, so a text is cut
there and a piece that comes again is not encoded again. What is remembered is bounded; the ids are those of
encoding the whole text with the tokenizer file, add_special_tokens=False. Texts that hold a special token of the
file are encoded by it; all others by the rank file of the same vocabulary, at twice the speed. Tests hold the ids
against the tokenizer file.

encode_all() takes a whole column: pieces are told apart by 64-bit hashes of their bytes, so its ids are exact but for
collisions of these, and what is not remembered is encoded as one text for many pieces.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from specweave.llm import wordhash

TOKENIZER_FILE, RANK_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces remembered in each of two generations per worker.
REMEMBERED = 300_000
#: Places for pieces that encode_all() remembers per worker, one for the pieces of one beginning of a hash, and the ids
#: that a place holds; a piece of more is encoded each time.
PLACE_BITS, PLACE_IDS = 20, 16
#: An unsigned type of four bytes; of a short list it makes bytes sooner than numpy does.
_FOUR_BYTES = next(k for k in "IL" if array(k).itemsize == 4)
_LITTLE = sys.byteorder == "little"
_BESIDE_SPACE = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


class Subwords:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        import tokenizers

        self._whole = tokenizers.Tokenizer.from_file(path)
        self._special = [x.content for x in self._whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(RANK_FILE), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._ids = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._n_bytes[list(ranks.values())] = [len(x) for x in ranks]
        self._place_bits, n = PLACE_BITS, 1 << PLACE_BITS
        self._hash, self._size, self._place = np.zeros(n, np.uint64), np.zeros(n, np.uint8), np.zeros((n, PLACE_IDS), "<u2")

    def _encode(self, text: str) -> bytes:
        return array(_FOUR_BYTES, self._ids(text)).tobytes() if _LITTLE else np.array(self._ids(text), "<u4").tobytes()

    def _look_up(self, piece: str) -> bytes:
        """A piece that the newer generation lacks. Pieces lack the space before them, unless a line end leads."""
        ids = self._old.get(piece)
        if ids is None:
            ids = self._encode(piece if piece[:1] == "\n" else " " + piece)
        if len(self._new) >= REMEMBERED:
            self._old, self._new = self._new, {}
        self._new[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(x in text for x in self._special):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _BESIDE_SPACE.search(text) or text[0] in " \n":
            first, *rest = _SINGLE_SPACE.split(text)
            if any(p[:1] == "\n" for p in rest):  # told apart below by their first character
                return self._encode(text)
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
        found = list(map(self._new.get, rest))
        if None in found:
            found = [self._look_up(p) if ids is None else ids for p, ids in zip(rest, found, strict=True)]
        return self._encode(first) + b"".join(found)

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls) as little-endian unsigned 16-bit numbers."""
        texts = column.to_pylist()
        apart = [not x or x[0] in " \n" or any(y in x for y in self._special) or _BESIDE_SPACE.search(x) is not None for x in texts]
        cut = column.filter(pa.array([not x for x in apart], pa.bool_())) if any(apart) else column
        found = (ids for _, part in wordhash.parts(cut) for ids in self._encode_cut(part))
        return [np.frombuffer(self.encode(x), "<u4").astype("<u2").tobytes() if alone else next(found) for x, alone in zip(texts, apart, strict=True)]

    def _encode_cut(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that may be cut before each space and line end."""
        data, offsets = wordhash.raw(texts)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (data == 32) | (data == 10)
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        h = wordhash.hashes(data, starts, ends, lower=False)
        at = (h >> np.uint64(64 - self._place_bits)).astype(np.int64)
        rows, size = self._place.take(at, 0), self._size.take(at).astype(np.int64)
        new = np.flatnonzero((self._hash.take(at) != h) | (size == 0))
        ids = first = of = np.zeros(0, np.int64)
        if len(new):
            _, one, of = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            ids, n = self._encode_pieces(data, starts[one], ends[one])
            first, fit = np.cumsum(n) - n, n <= PLACE_IDS
            own = np.zeros((len(n), PLACE_IDS), "<u2")
            own[np.arange(PLACE_IDS) < (n * fit)[:, None]] = ids[np.repeat(fit, n)]
            rows[new], size[new] = own.take(of, 0), n.take(of)
            places, kept = np.unique(at[one[fit]], return_index=True)  # a place holds one piece
            kept = np.flatnonzero(fit)[kept]
            self._hash[places], self._size[places], self._place[places] = h[one[kept]], n[kept], own[kept]
        short = size <= PLACE_IDS
        flat = rows[np.arange(PLACE_IDS) < (size * short)[:, None]]
        if not short.all():
            short, some = np.repeat(short, size), flat
            flat = np.empty(len(short), "<u2")
            flat[short] = some
            flat[~short] = np.concatenate([ids[first[u] : first[u] + n[u]] for u in of[size[new] > PLACE_IDS]])
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)] * 2
        whole = flat.tobytes()
        return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces data[starts:ends], one after the other, and how many each has."""
        whole, starts, ends = data.tobytes(), starts.tolist(), ends.tolist()
        pieces = [whole[a:b] for a, b in zip(starts, ends, strict=True)]
        # A line end is put before the first piece of a text, which has none, and taken off again.
        bare = np.array([x[:1] not in (b" ", b"\n") for x in pieces], bool)
        joined = b"".join([b"\n" + x if y else x for x, y in zip(pieces, bare.tolist(), strict=True)]).decode()
        if _BESIDE_SPACE.search(joined):  # a piece ends in white space
            each = [np.array(self._ids(x.decode()), "<u2") for x in pieces]
            return np.concatenate(each), np.array([len(x) for x in each])
        ids = np.frombuffer(array(_FOUR_BYTES, self._ids(joined)), f"u{array(_FOUR_BYTES).itemsize}").astype("<u2")
        sizes = np.array([len(x) for x in pieces]) + bare
        n = np.diff(np.searchsorted(np.cumsum(self._n_bytes.take(ids)), np.cumsum(sizes)) + 1, prepend=0)
        there = np.ones(len(ids), bool)
        there[(np.cumsum(n) - n)[bare]] = False
        return ids[there], n - bare


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    """One per worker process and file."""
    return Subwords(path)
