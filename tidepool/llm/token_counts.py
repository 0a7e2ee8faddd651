"""Token counts of whole texts, huge ones by overlapping windows that are spliced.

A text longer than ``window`` bytes is encoded in windows that overlap.  Two
windows are joined at a byte where (1) both encodings have a token boundary,
(2) the boundary is proven stable by the text itself (``encoding.stable_cuts``:
the tokens on either side do not depend on the other side).  Where an overlap
has no such byte, it is doubled, up to the rest of the text, and encoded again.

Null text: counted as empty (0 bytes, 0 tokens).  Empty text: 0 tokens.  Rows
are independent, so ties, repeats and empty tables need no rule.  Columns of the
input other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import bytetext as bt
from tidepool.llm.encoding import Encoder, encoder, stable_cuts
from tidepool.llm.tables import per_batch, small_batches

WINDOW, OVERLAP, LIMIT = 1 << 15, 1 << 9, 512


def _char_start(data: np.ndarray, at: int) -> int:
    """The first byte of the character at ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def plan_windows(data: np.ndarray, window: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [a, b) over a text: each begins ``overlap`` bytes before the last one ends."""
    n, out, a = len(data), [], 0
    while True:
        b = _char_start(data, min(n, a + window + overlap))
        out.append((a, b))
        if b >= n:
            return out
        nxt = _char_start(data, b - overlap)
        a = nxt if nxt > a else b


def splice(enc: Encoder, data: np.ndarray, spans: list[tuple[int, int]], ids: list[np.ndarray], overlap: int) -> tuple[np.ndarray, int]:
    """The ids of the whole text from those of its windows, and how often an overlap was widened."""
    stable = stable_cuts(data)
    out, widened, begin, k = [], 0, 0, 0
    (a, b), now = spans[0], ids[0]
    while True:
        edges = a + np.cumsum(enc.width[now])  # where each token ends
        if b >= len(data):
            out.append(now[np.searchsorted(edges, begin, side="right") :])
            return np.concatenate(out), widened
        c, d = spans[k + 1]
        following = ids[k + 1]
        other = c + np.concatenate([[0], np.cumsum(enc.width[following])])
        lo, hi = np.searchsorted(stable, [max(c, begin) + 1, b])  # strictly inside the overlap
        both = np.intersect1d(np.intersect1d(stable[lo:hi], edges, assume_unique=False), other)
        if len(both):
            p = int(both[len(both) // 2])
            out.append(now[np.searchsorted(edges, begin, side="right") : np.searchsorted(edges, p, side="right")])
            begin, k = p, k + 1
            (a, b), now = (c, d), following
            continue
        widened += 1
        overlap *= 2
        b = _char_start(data, min(len(data), b + overlap))
        while k + 2 < len(spans) and spans[k + 1][1] <= b:  # windows inside the wider one are not needed
            k += 1
        part = data[a:b]
        now = enc.encode_rows(part, np.array([0, len(part)]))[0]


def count_column(enc: Encoder, column: pa.Array, window: int, overlap: int):
    """Yields (first row, token counts, windows, widenings) for runs of rows."""
    data, offsets = bt.buffers(column)
    for x, y in bt.steps(offsets):
        part, off = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
        size = np.diff(off)
        long = np.flatnonzero(size > window + overlap)
        n, windows, widened = np.zeros(y - x, np.int64), np.ones(y - x, np.int64), np.zeros(y - x, np.int64)
        if len(long) < y - x:
            short = size <= window + overlap
            kept = np.concatenate([[0], np.cumsum(size[short])])
            n[short] = np.diff(enc.encode_rows(part if short.all() else part[np.repeat(short, size)], kept)[1])
        for i in long:
            text = part[off[i] : off[i + 1]]
            spans = plan_windows(text, window, overlap)
            ids = []
            for g in range(0, len(spans), 32):
                group = spans[g : g + 32]
                bounds = np.concatenate([[0], np.cumsum([q - p for p, q in group])])
                flat, cut = enc.encode_rows(np.concatenate([text[p:q] for p, q in group]), bounds)
                ids += [flat[cut[j] : cut[j + 1]] for j in range(len(group))]
            whole, widened[i] = splice(enc, text, spans, ids, overlap)
            n[i], windows[i] = len(whole), len(spans)
        yield x, n, windows, widened


def count_tokens(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_windows, n_widened.

    One pass over the id and the text; no shuffle.
    """
    small_batches(df.sparkSession)

    def run(batch: pa.RecordBatch):
        enc = encoder(tokenizer, "byte")
        size = np.diff(bt.buffers(batch.column(1))[1])
        for a, n, windows, widened in count_column(enc, batch.column(1), window, overlap):
            b = a + len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, len(n)), pa.array(size[a:b]), pa.array(n), pa.array(n > limit), pa.array(windows), pa.array(widened)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_windows", "n_widened"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(per_batch(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_windows long, n_widened long")
