"""N-best SentencePiece segmentation, and decoding.

The text is normalised by the model's own rules.  Its pieces form a lattice, which
falls into parts wherever no piece holds the two characters that meet.  Within a
part, forward Viterbi scores are the exact cost to come of every node, so a
backward A* search with them as heuristic pops segmentations in order of score:
from a node, the arc of its forward score costs nothing more, and every other arc
opens a branch at the price of what it loses.  Scores are integers, so no rounding
breaks that order.  The n best of a text are combined from its parts: with the
n - 1 parts of the smallest first loss, all of the n best are found.

Parts that were met before are kept in a table of bounded size, found by hash and
compared by bytes; whole steps of texts are put together from it with NumPy.  Of
every part the table has the best segmentation and what the second loses; the
search runs for the parts that are turned in a text.

A piece's score is ``-log(rank + 10)`` for its rank in the model (earlier merges
are likelier), and a byte piece's is ``BYTE_SCORE``; byte pieces stand for
characters that the model lacks.

Null and empty texts have one segmentation, without pieces and with score 0.
Fewer than n segmentations: all of them.  Ties are ordered by the search, the
same way every time.  Time and memory grow in proportion to the text, however long
its words.  Repeated rows are segmented each.  An empty table gives an empty
result.  Other columns than the ids and the text are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm.tables import per_batch, small_batches

MARK, BYTE_SCORE = "▁", -20.0
#: Scores are held as multiples of this; a loss that no segmentation has.
UNIT, NEVER = 2.0**-24, 1 << 60
#: Parts and ids that a worker's table holds before it is begun anew.
TABLE_PARTS, TABLE_IDS = 400_000, 8_000_000
#: Bytes of text that are encoded at a time (one row at least); the result is several times as large.
STEP_BYTES = 1 << 20


class Lattice:
    """A SentencePiece model's pieces, scored for search."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.byte_score = [0] * 256, round(BYTE_SCORE / UNIT)
        self.size, plain = m.vocab_size(), []
        for i in range(self.size):
            if m.is_byte(i):
                self.bytes[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                plain.append((-m.get_score(i), i, m.id_to_piece(i)))
        #: Every piece with (score, id), and every beginning of one with an empty tuple.
        self.arcs: dict[str, tuple[int, int] | tuple[()]] = {}
        for rank, (_, i, piece) in enumerate(sorted(plain)):
            for k in range(1, len(piece)):
                self.arcs.setdefault(piece[:k], ())
            self.arcs[piece] = (round(-float(np.log(rank + 10)) / UNIT), i)
        pairs = {ord(a) << 21 | ord(b) for _, _, p in plain for a, b in zip(p, p[1:])}
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.low_pairs = np.zeros((128, 128), dtype=bool)
        for p in pairs:
            if p >> 21 < 128 and p & 0x1FFFFF < 128:
                self.low_pairs[p >> 21, p & 0x1FFFFF] = True

    def first(self, part: str) -> tuple[int, int, list[int]]:
        """A part's forward Viterbi: (score in units, loss of the second segmentation, ids of the first)."""
        end, get = len(part), self.arcs.get
        score, second, came, by = [0] + [-NEVER] * end, [-NEVER] * (end + 1), [0] * (end + 1), [-1] * (end + 1)
        for a in range(end):
            base = score[a]
            for b in range(a + 1, end + 1):
                hit = get(part[a:b])
                if hit is None:
                    break
                if hit:
                    s = base + hit[0]
                    if s >= score[b]:
                        second[b], score[b], came[b], by[b] = score[b], s, a, hit[1]
                    elif s > second[b]:
                        second[b] = s
            if not get(part[a]):
                s = base + self.byte_score * len(part[a].encode())
                if s >= score[a + 1]:
                    second[a + 1], score[a + 1], came[a + 1], by[a + 1] = score[a + 1], s, a, -1
                elif s > second[a + 1]:
                    second[a + 1] = s
        ids, loss, b = [], NEVER, end
        while b:
            if score[b] - second[b] < loss:
                loss = score[b] - second[b]
            if by[b] >= 0:
                ids.append(by[b])
            else:
                ids += [self.bytes[x] for x in reversed(part[b - 1].encode())]
            b = came[b]
        ids.reverse()
        return score[end], min(loss, NEVER), ids

    def best(self, part: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a part: (score in units, ids), best first."""
        end, get = len(part), self.arcs.get
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(end + 1)]  # arcs (forward score, from, id), -1 for byte pieces
        base = 0
        for a in range(end):
            if a:
                into[a].sort(reverse=True)
                del into[a][n:]
                base = into[a][0][0]
            for b in range(a + 1, end + 1):
                hit = get(part[a:b])
                if hit is None:
                    break
                if hit:
                    into[b].append((base + hit[0], a, hit[1]))
            if not get(part[a]):
                into[a + 1].append((base + self.byte_score * len(part[a].encode()), a, -1))
        into[end].sort(reverse=True)
        total = into[end][0][0]
        # branches (loss, order, node, ids behind it as a linked list); none is kept that n better ones make useless
        out, queue, order = [], [(0, 0, end, None)], 0
        while queue and len(out) < n:
            loss, _, node, behind = queue.pop(0)
            left = n - len(out) - 1
            while node:
                arcs = into[node]
                for score, a, i in arcs[1:]:
                    more = loss + arcs[0][0] - score
                    if len(queue) >= left and not (queue and more < queue[-1][0]):
                        break
                    order += 1
                    insort(queue, (more, order, a, (i, a, behind)))
                    del queue[left:]
                _, a, i = arcs[0]
                behind = (i, a, behind)
                node = a
            ids = []
            while behind:
                i, a, behind = behind
                if i >= 0:
                    ids.append(i)
                else:
                    ids += [self.bytes[x] for x in part[a].encode()]
            out.append((total - loss, ids))
        return out

    def parts(self, text: str) -> np.ndarray:
        """Whether a part begins at each character of a text (or of several, joined)."""
        x = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        first = np.ones(len(x), dtype=bool)
        a, b = x[:-1], x[1:]
        low = (a < 128) & (b < 128)
        first[1:][low] = ~self.low_pairs[a[low], b[low]]
        rest = np.flatnonzero(~low)
        pair = a[rest] << 21 | b[rest]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        first[1:][rest] = self.pairs[at] != pair
        return first

    def decoding(self) -> tuple[pa.Array, np.ndarray]:
        """The bytes of every id and of one that is no id, and which ids begin with a word mark."""
        m, out = self.model, []
        for i in range(self.size):
            out.append(b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else m.id_to_piece(i).replace(MARK, " ").encode())
        for b, i in enumerate(self.bytes):
            if m.is_byte(i):
                out[i] = bytes([b])
        marked = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) and m.id_to_piece(i).startswith(MARK) for i in range(self.size)]
        return pa.array([*out, " ⁇ ".encode()], pa.large_binary()), np.array([*marked, False])


class Table:
    """Segmentations of parts, as arrays by the number of the part, and the n best of those that were turned."""

    def __init__(self, lat: Lattice, n: int):
        self.lat, self.n = lat, n
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.turned: dict[int, int] = {}
        self.ids = array("i")
        self.score, self.loss, self.start, self.length = (array("q") for _ in range(4))
        self.alt_loss, self.alt_start, self.alt_length = (array("q") for _ in range(3))

    def add(self, part: bytes) -> int:
        """The number of a new part."""
        at = self.known[part] = len(self.known)
        score, loss, ids = self.lat.first(part.decode())
        self.score.append(score), self.loss.append(loss), self.start.append(len(self.ids)), self.length.append(len(ids))
        self.ids.extend(ids)
        return at

    def turn(self, number: int, part: bytes) -> int:
        """The place of a part's n best segmentations."""
        if (at := self.turned.get(number)) is None:
            at = self.turned[number] = len(self.turned)
            found = self.lat.best(part.decode(), self.n)
            for score, ids in found:
                self.alt_loss.append(found[0][0] - score), self.alt_start.append(len(self.ids)), self.alt_length.append(len(ids))
                self.ids.extend(ids)
            for _ in range(self.n - len(found)):
                self.alt_loss.append(NEVER), self.alt_start.append(0), self.alt_length.append(0)
        return at

    def numbers(self, data: np.ndarray, whole: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of spans of bytes."""
        if len(self.known) > TABLE_PARTS or len(self.ids) > TABLE_IDS:
            self.clear()
        h = bt.span_hashes(data, starts, ends - starts)
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        if not bt.equal_spans(data, starts, ends - starts, first[same]):
            first, same = np.arange(len(h)), np.arange(len(h))  # two parts of one hash: every span by itself
        parts = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        known = list(map(self.known.get, parts))
        for k, at in enumerate(known):
            if at is None:
                at = self.known.get(parts[k])
                known[k] = self.add(parts[k]) if at is None else at
        return np.array(known, np.int64)[same]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The n best segmentations of normalised texts: row, rank, score, bounds of len+1, ids."""
        n, rows = self.n, len(texts)
        if not any(texts):
            none = np.zeros(0, np.int32)
            return np.arange(rows), np.ones(rows, np.int64), np.zeros(rows), np.zeros(rows + 1, np.int64), none
        joined = "".join(texts)
        whole = joined.encode()
        data = np.frombuffer(whole, dtype=np.uint8)
        head = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        chars = np.cumsum([0, *map(len, texts)])
        begins = self.lat.parts(joined)
        begins[chars[:-1][chars[:-1] < len(head)]] = True
        at = np.flatnonzero(begins)
        starts = head[at]
        of = np.searchsorted(chars, at, side="right") - 1  # the text of each part
        stops = np.append(starts[1:], len(data))
        part = self.numbers(data, whole, starts, stops)
        score, loss, start, length = (np.frombuffer(x, np.int64) for x in (self.score, self.loss, self.start, self.length))
        bounds = np.searchsorted(of, np.arange(rows + 1))
        some = np.flatnonzero(np.diff(bounds))
        total = np.zeros(rows, np.int64)
        total[some] = np.add.reduceat(score[part], bounds[some])

        # options: the n smallest sums of losses over the turned parts, as (loss, alternative of each turned part)
        losses = np.full((rows, n), NEVER)
        losses[:, 0] = 0
        turned, place = np.zeros((rows, n), np.int64), np.zeros((rows, n), np.int64)
        taken = np.zeros((rows, n, n), np.int64)
        price = loss[part]
        for k in range(n - 1):
            least = np.full(rows, NEVER)
            least[some] = np.minimum.reduceat(price, bounds[some])
            hit = np.flatnonzero((price == least[of]) & (price < NEVER))
            row, where = np.unique(of[hit], return_index=True)
            if not len(row):
                break
            pick = hit[where]
            turned[row, k], price[pick] = pick, NEVER
            place[row, k] = [self.turn(x, whole[a:b]) for x, a, b in zip(part[pick].tolist(), starts[pick].tolist(), stops[pick].tolist())]
            alternatives = np.frombuffer(self.alt_loss, np.int64).reshape(-1, n)[place[row, k]]
            sums = np.minimum(losses[row][:, :, None] + alternatives[:, None, :], NEVER).reshape(len(row), n * n)
            best = np.argsort(sums, axis=1, kind="stable")[:, :n]
            losses[row] = np.take_along_axis(sums, best, axis=1)
            taken[row] = np.take_along_axis(taken[row], (best // n)[:, :, None], axis=1)
            taken[row, :, k] = best % n
        row, rank = np.nonzero(losses < NEVER)

        # the parts of every option: the best alternative, but for the turned parts
        count = np.diff(bounds)[row]
        ends = np.cumsum(count)
        which = np.arange(ends[-1]) - np.repeat(ends - count - bounds[row], count)
        number = part[which]
        begin, size = start[number], length[number]
        for k in range(n - 1):
            chosen = taken[row, rank, k]
            held = np.flatnonzero(chosen)
            if len(held):
                spot = ends[held] - count[held] + turned[row[held], k] - bounds[row[held]]
                at = place[row[held], k] * n + chosen[held]
                begin[spot], size[spot] = np.frombuffer(self.alt_start, np.int64)[at], np.frombuffer(self.alt_length, np.int64)[at]
        cut = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(self.ids, np.int32)[np.arange(cut[-1]) + np.repeat(begin - cut[:-1], size)]
        return row, rank + 1, (total[row] - losses[row, rank]) * UNIT, cut[np.concatenate([[0], ends])], flat


_LATTICES: dict[str, Lattice] = {}
_TABLES: dict[tuple[str, int], Table] = {}


def lattice(name: str) -> Lattice:
    """The process's lattice for a model: a path, or a name that public_tokenizers knows."""
    if name not in _LATTICES:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        _LATTICES[name] = Lattice(path)
    return _LATTICES[name]


def table(name: str, n: int) -> Table:
    """The process's table for a model and n."""
    if (name, n) not in _TABLES:
        _TABLES[name, n] = Table(lattice(name), n)
    return _TABLES[name, n]


def encode_nbest(df: DataFrame, model: str = "piece_bpe_32k.model", *, n: int = 4, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row and segmentation: the id columns, rank (from 1), score, ids, text_crc32 (of the text that the ids decode to)."""
    small_batches(df.sparkSession)
    id_cols = list(id_cols)
    if n < 1:
        raise ValueError("n is 1 at least")

    def run(batch: pa.RecordBatch):
        known = table(model, n)
        _, offsets = bt.buffers(batch.column(len(id_cols)))
        for a, b in bt.steps(offsets, STEP_BYTES):
            part = batch.slice(a, b - a)
            texts = [known.lat.model.normalize(t) if t else "" for t in part.column(len(id_cols)).to_pylist()]
            sums = np.array([zlib.crc32(plain(t).encode()) for t in texts], np.int64)
            row, rank, score, ends, ids = known.encode(texts)
            keys = [part.column(k).take(pa.array(row)) for k in range(len(id_cols))]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(rank.astype(np.int32)), pa.array(score), lists, pa.array(sums[row])], names=[*id_cols, "rank", "score", "ids", "text_crc32"])

    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*id_cols).schema]
    return df.select(*id_cols, F.col(text_col)).mapInArrow(per_batch(run), ", ".join([*keys, "rank int, score double, ids array<int>, text_crc32 long"]))


def plain(normalized: str) -> str:
    """A normalised text as it decodes: spaces for word marks, but for the one at the beginning."""
    return normalized.replace(MARK, " ").removeprefix(" ")


def decode_pieces(df: DataFrame, model: str = "piece_bpe_32k.model", *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its piece ids; null ids give null.

    Word marks become spaces, but for the one at the beginning; control ids have no
    text; an unknown id, and one that the model does not have or that is null, is
    `` ⁇ ``; bytes that are no UTF-8 become U+FFFD.  A column that has the name of the
    result is replaced by it.
    """
    small_batches(df.sparkSession)
    df = df.drop(out_col) if out_col != ids_col else df
    where = df.columns.index(ids_col)

    def run(batch: pa.RecordBatch):
        if model not in _DECODING:
            _DECODING[model] = lattice(model).decoding()
        pieces, marked = _DECODING[model]
        lists = batch.column(where)
        ids = lists.flatten().fill_null(-1).to_numpy()
        ids = np.where((ids < 0) | (ids >= len(pieces) - 1), len(pieces) - 1, ids)
        size = lists.value_lengths().fill_null(0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])
        bits = pieces.take(pa.array(ids))
        at = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset :] if len(bits) else np.zeros(1, np.int64)
        # the first id of a row that has a text
        told = np.flatnonzero(at[1:] > at[:-1]) if len(bits) else np.zeros(0, np.int64)
        first = np.searchsorted(told, ends[:-1])
        held = first < len(told)
        begins = np.zeros(len(size), dtype=bool)
        spot = told[first[held]]
        begins[held] = (spot < ends[1:][held]) & marked[ids[spot]]
        cut, data = at[ends].tolist(), memoryview(bits.buffers()[2] or b"")
        out = [str(data[a + skip : b], "utf-8", "replace") if known else None for a, b, skip, known in zip(cut, cut[1:], begins.tolist(), lists.is_valid().to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(per_batch(run), ", ".join([*keys, f"`{out_col}` string"]))


_DECODING: dict[str, tuple[pa.Array, np.ndarray]] = {}
