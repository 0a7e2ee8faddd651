"""Fast exact encoding of many texts with the public BPE tokenizers.

The library spends most of its time on pre-tokens that it has met before.  Here
pre-tokens are found with NumPy on the UTF-8 bytes, a fixed-size direct-mapped
cache keeps the ids that the library gave for a pre-token, and only new ones go
to the library's BPE model, in bulk.  Both tokenizers encode each pre-token by
itself, so the ids are the library's own.

A text that holds anything whose class is not plain here (characters beyond
U+00FF, control characters, other number signs, the opening of a special token)
is encoded whole by the library.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa

from tidepool.llm import bytetext as bt

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
_CLASS[0x41:0x5B] = LETTER
_CLASS[0x61:0x7B] = LETTER
_CLASS[0x30:0x3A] = NUMBER
#: Bytes that send a text to the library: controls, DEL, and the leads of characters beyond U+00FF.
_ODD = np.zeros(256, dtype=bool)
_ODD[:0x20] = True
_ODD[[0x09, 0x0A, 0x0D]] = False
_ODD[0x7F] = True
_ODD[0xC4:] = True
#: After the lead byte C2: C1 controls, no-break space, and the number signs.
_ODD_C2 = np.zeros(256, dtype=bool)
_ODD_C2[0x80:0xA1] = True
_ODD_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True

_SLOTS_BITS = 19
_POOL_MOST, _TEXT_MOST = 1 << 22, 1 << 23
_GROUP = 200


class Encoder:
    """Encodes with one tokenizers file; ``style`` is its pre-tokenization.

    word: lower case, runs of letters, single digits, runs of others; white space is dropped.
    byte: runs of letters, numbers or others with one leading space; runs of white space.
    """

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if style not in ("word", "byte"):
            raise ValueError(f"unknown pre-tokenization: {style}")
        self.style, self.path, self._library = style, path, None
        self.model = Tokenizer.from_file(path)
        cut = pre_tokenizers.WhitespaceSplit() if style == "word" else pre_tokenizers.Split("\x00", "removed")
        self.model.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if style == "word":
            self.model.normalizer = normalizers.Sequence([])
        size = self.model.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        tokens = [self.model.id_to_token(i) or "" for i in range(size)]
        #: Whether an id ends a pre-token (word), and how many bytes an id stands for (byte).
        self.ends = np.array([x.endswith("</w>") for x in tokens])
        self.width = np.array([len(x) for x in tokens], dtype=np.int64)
        for k, x in self.model.get_added_tokens_decoder().items():
            self.width[k] = len(x.content.encode())
        self._clear()

    @property
    def library(self):
        """The tokenizer as it is, for odd texts; loaded when the first one comes."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _clear(self) -> None:
        self.key = np.zeros(1 << _SLOTS_BITS, dtype=np.uint64)
        self.at = np.zeros(1 << _SLOTS_BITS, dtype=np.int64)
        self.n = np.zeros(1 << _SLOTS_BITS, dtype=np.int32)
        self.pool = np.zeros(_POOL_MOST + (1 << 20), dtype=np.uint16)
        self.used = 0
        #: The bytes of the pre-tokens in the cache, and where those of each slot are.
        self.text, self.text_used = np.zeros(_TEXT_MOST + (1 << 20), dtype=np.uint8), 0
        self.text_at = np.zeros(1 << _SLOTS_BITS, dtype=np.int32)
        self.text_len = np.full(1 << _SLOTS_BITS, -1, dtype=np.int32)

    # -- the plain path -------------------------------------------------

    def odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which rows the library has to encode whole."""
        odd = _ODD[data]
        if len(data) > 1:
            odd[1:] |= (data[:-1] == 0xC2) & _ODD_C2[data[1:]]
            odd[1:] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        rows = np.zeros(len(offsets) - 1, dtype=bool)
        if odd.any():
            rows[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        return rows

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes as encoded, starts, lengths) of the pre-tokens of rows that are not odd."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return data, z, z
        cls = _CLASS[data]
        if self.style == "word":
            data = bt.LOWER_ASCII[data]
        high = np.flatnonzero(data >= 0xC2)
        if len(high):
            lead, low = data[high], data[high + 1]
            letter = np.where(lead == 0xC3, (low != 0x97) & (low != 0xB7), (low == 0xAA) | (low == 0xB5) | (low == 0xBA))
            cls[high] = cls[high + 1] = np.where(letter, LETTER, OTHER)
            if self.style == "word":
                data[high + 1] += np.where((lead == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), 0x20, 0).astype(np.uint8)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        start = edge[:n].copy()
        start[1:] |= cls[1:] != cls[:-1]
        if self.style == "word":
            start |= cls == NUMBER
        else:
            b = np.flatnonzero(start[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~edge[1:n]) + 1
            start[b - 1] = True
            start[b[data[b - 1] == 0x20]] = False
        self._contractions(data, cls, edge, start)
        at = np.flatnonzero(start)
        ends = np.append(at[1:], n)
        if self.style == "word":
            keep = cls[at] != SPACE
            at, ends = at[keep], ends[keep]
        return data, at, ends - at

    @staticmethod
    def _contractions(data: np.ndarray, cls: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are pre-tokens of their own where the apostrophe begins one."""
        p = np.flatnonzero((data == 0x27) & start)
        p = p[p + 1 < len(data)]
        p = p[~edge[p + 1] & (cls[p + 1] == LETTER)]
        if not len(p):
            return
        one = np.isin(data[p + 1], np.frombuffer(b"stmd", np.uint8))
        q = p[~one]
        q = q[q + 2 < len(data)]
        q = q[~edge[q + 2]]
        a, b = data[q + 1], data[q + 2]
        q = q[((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C))]
        for at, width in ((p[one], 2), (q, 3)):
            start[at + 1] = False
            rest = at + width
            rest = rest[rest < len(data)]
            start[rest[cls[rest] == LETTER]] = True

    def _new(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens from the library: where they begin in the pool, and how many."""
        raw = data.tobytes()
        words = [raw[s : s + n].decode() for s, n in zip(starts.tolist(), lengths.tolist())]
        sep = " " if self.style == "word" else "\x00"
        groups = [sep.join(words[k : k + _GROUP]) for k in range(0, len(words), _GROUP)]
        ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in self.model.encode_batch_fast(groups, add_special_tokens=False)])
        if self.style == "word":
            ends = np.flatnonzero(self.ends[ids]) + 1
        else:
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(lengths)) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            raise AssertionError("the library cut a pre-token otherwise")
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = np.concatenate([[0], ends[:-1]])
        at = begin + self.used
        self.used += len(ids)
        return at, ends - begin

    def _keep(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, slots: np.ndarray) -> None:
        """Hold the bytes of the pre-tokens that the slots now have."""
        ends = np.cumsum(lengths)
        while self.text_used + ends[-1] + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + ends[-1]] = data[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]
        self.text_at[slots], self.text_len[slots] = self.text_used + ends - lengths, lengths
        self.text_used += int(ends[-1])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain rows, and their bounds."""
        if self.used > _POOL_MOST or self.text_used > _TEXT_MOST:
            self._clear()
        data, starts, lengths = self.pretokens(data, offsets)
        h = bt.span_hashes(data, starts, lengths) | np.uint64(1)
        slot = (h >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)
        at, n = self.at[slot], self.n[slot].astype(np.int64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        hit = np.flatnonzero((self.key[slot] == h) & (self.text_len[slot] == lengths))
        hit = hit[bt.matching(padded, starts[hit], self.text, self.text_at[slot[hit]], lengths[hit])]  # a hash alone proves nothing
        missed = np.ones(len(h), dtype=bool)
        missed[hit] = False
        miss = np.flatnonzero(missed)
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if not bt.equal_spans(data, starts[miss], lengths[miss], first[back]):
                first, back = np.arange(len(miss)), np.arange(len(miss))
            new = miss[first]
            a, c = self._new(data, starts[new], lengths[new])
            at[miss], n[miss] = a[back], c[back]
            # of two new pre-tokens in one slot the same one must win in all arrays
            one, pick = np.unique(slot[new], return_index=True)
            self.key[one], self.at[one], self.n[one] = h[new][pick], a[pick], c[pick]
            self._keep(data, starts[new][pick], lengths[new][pick], one)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    # -- whole columns ----------------------------------------------------

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of about one step, and their bounds of len(rows)+1."""
        odd = self.odd_rows(data, offsets)
        if not odd.any():
            return self._plain(data, offsets)
        plain = ~odd
        size = np.diff(offsets)
        kept = np.concatenate([[0], np.cumsum(size[plain])])
        ids, bounds = self._plain(data[np.repeat(plain, size)], kept)
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)]
        slow = [np.array(e.ids, dtype=np.uint16) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.zeros(len(offsets) - 1, dtype=np.int64)
        n[plain] = np.diff(bounds)
        n[odd] = [len(x) for x in slow]
        out = np.concatenate([[0], np.cumsum(n)])
        flat = np.empty(out[-1], dtype=np.uint16)
        flat[np.repeat(plain, n)] = ids
        for i, x in zip(np.flatnonzero(odd), slow):
            flat[out[i] : out[i + 1]] = x
        return flat, out

    def cuts(self, data: np.ndarray, limit: int) -> np.ndarray:
        """Bounds of pieces of one text of about ``limit`` bytes that are encoded apart with the same result.

        A pre-token never crosses from a non-space character into an ASCII space
        (see ``stable_cuts``), so any such place will do.
        """
        if len(data) <= limit:
            return np.array([0, len(data)])
        places, out, at = stable_cuts(data), [0], 0
        while len(data) - at > limit:
            k = np.searchsorted(places, at + limit, side="right") - 1
            if k < 0 or places[k] <= at:
                k += 1
            if k >= len(places):
                break
            at = int(places[k])
            out.append(at)
        return np.array([*out, len(data)])

    def encode_column(self, column: pa.Array):
        """Yields (first row, ids, bounds) for runs of rows of a string column; a null is empty."""
        data, offsets = bt.buffers(column)
        for a, b in bt.steps(offsets):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if b == a + 1 and len(part) > bt.STEP_BYTES:
                c = self.cuts(part, bt.STEP_BYTES)
                pieces = [self.encode_rows(part[x:y], np.array([0, y - x]))[0] for x, y in zip(c[:-1], c[1:])]
                ids = np.concatenate(pieces)
                yield a, ids, np.array([0, len(ids)])
            else:
                yield (a, *self.encode_rows(part, off))


def stable_cuts(data: np.ndarray) -> np.ndarray:
    """Positions p such that encoding text[:p] and text[p:] apart gives the ids of the whole text.

    The byte before p is not white space and p holds a tab, line feed or space.
    No pre-token holds a non-space followed by a white-space character: white
    space is a token of its own, dropped, or leads its token.  A pre-token that
    ends at p does not look beyond p, and one that begins at p does not look
    back.  No special token or normalisation crosses white space.  The byte
    before must be ASCII, so that no wide white-space character stands there.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    space = (data == 0x20) | (data == 0x0A) | (data == 0x09)
    solid = (data > 0x20) & (data < 0x7F)
    return np.flatnonzero(solid[:-1] & space[1:]) + 1


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, style: str) -> Encoder:
    """The process's encoder for a tokenizers file: a path, or a name that public_tokenizers knows."""
    if (name, style) not in _ENCODERS:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        _ENCODERS[name, style] = Encoder(path, style)
    return _ENCODERS[name, style]
