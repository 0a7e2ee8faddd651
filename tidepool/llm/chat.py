"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

Each line is in one of six states, a role (system, user, assistant) by whether
the line begins a turn.  Observed are the line's speaker marker, whether it is the
first of its row, and features of its text.  Viterbi finds the likeliest states,
so a turn without a marker gets the role that its neighbours and its own lines
suggest.  Rendering puts ``<|im_start|>role`` before each turn and ``<|im_end|>``
behind it, and takes recognised markers out.

The model's probabilities are set by hand, not estimated.

A conversation of any length is cut into chunks of ``CHUNK`` rows, or as many as
reach ``CHUNK_BYTES``, so a task holds no more than that and one text.  A chunk of an
open conversation first gives its 6 x 6 matrix of best scores from the state
before it to its last; a conversation's matrices give each chunk the scores at its
entry and the state at its exit; then chunks are decoded apart, exactly.

Rows are ordered by conversation, order column and text hash: repeated rows and
ties stay, in that order.  A null or empty text is one empty line.  Rows without a
conversation id are one conversation, whose id stays null.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tables import per_batch, small_batches, staged

ROLES = ("system", "user", "assistant")
CHUNK, CHUNK_BYTES = 512, 4 << 20

#: Words that mark a speaker.
SPEAKERS = {
    **dict.fromkeys(("system", "instruction", "instructions", "context"), 0),
    **dict.fromkeys(("user", "human", "customer", "prompter", "question", "q", "me"), 1),
    **dict.fromkeys(("assistant", "ai", "bot", "model", "agent", "gpt", "answer", "a"), 2),
}
_MARKER = re.compile(r"\s*(?:<\|im_start\|>\s*(\w+)|<\|(\w+)\|>|#{2,4}\s*(\w+)\s*:?|\[(\w+)\]\s*:?|\*{0,2}(\w+)\*{0,2}\s*:\*{0,2})[ \t]*")
_ORDER = re.compile(r"\b(?:you are|your task|always|never|follow these|respond)\b", re.I)
_LAYOUT = re.compile(r"\s*(?:[-*] |\d+[.)] |```|    )")

_log = np.log
#: P(state at the start), by role, for a line that begins a turn.
_START = _log(np.array([0.25, 1e-9, 0.6, 1e-9, 0.15, 1e-9]))


def _transitions() -> np.ndarray:
    """A line stays in its turn (0.75) or another turn begins, mostly the other side's."""
    following = np.array([[0.05, 0.85, 0.10], [0.02, 0.06, 0.92], [0.02, 0.92, 0.06]])
    out = np.full((6, 6), 1e-9)
    for r in range(3):
        for inside in (0, 1):
            out[2 * r + inside, 2 * r + 1] = 0.75
            out[2 * r + inside, 0::2] = 0.25 * following[r]
    return _log(out)


_STEP = _transitions()
#: P(marker none, system, user, assistant | state); P(first line of a row | state).
_MARK = _log(np.array([x for r in range(3) for x in ([0.19] + [0.80 if k == r else 0.005 for k in range(3)], [0.97, 0.01, 0.01, 0.01])]))
_FIRST = _log(np.array([[0.1, 0.9], [0.9, 0.1]] * 3))
#: By role: P(question), P(instruction words), P(list or code), P(length under 40, under 200, more).
_ASKS = _log(np.array([[0.98, 0.02], [0.70, 0.30], [0.92, 0.08]]))
_ORDERS = _log(np.array([[0.70, 0.30], [0.97, 0.03], [0.95, 0.05]]))
_LISTS = _log(np.array([[0.95, 0.05], [0.96, 0.04], [0.85, 0.15]]))
_LONG = _log(np.array([[0.30, 0.50, 0.20], [0.35, 0.45, 0.20], [0.20, 0.35, 0.45]]))


def read_line(line: str, first: bool) -> tuple[str, tuple[int, ...]]:
    """The line without its marker, and what is observed of it."""
    mark = 0
    m = _MARKER.match(line)
    if m:
        who = SPEAKERS.get(next(g for g in m.groups() if g).lower())
        if who is not None:
            mark, line = who + 1, line[m.end() :]
    size = len(line)
    return line, (mark, int(first), int(line.rstrip().endswith("?")), int(bool(_ORDER.search(line))), int(bool(_LAYOUT.match(line))), 0 if size < 40 else 1 if size < 200 else 2)


def emissions(seen: list[tuple[int, ...]]) -> np.ndarray:
    """Log probabilities of lines (rows) by state."""
    o = np.array(seen, dtype=np.int64).reshape(-1, 6)
    role = np.repeat(np.arange(3), 2)
    return _MARK[:, o[:, 0]].T + _FIRST[:, o[:, 1]].T + _ASKS[role][:, o[:, 2]].T + _ORDERS[role][:, o[:, 3]].T + _LISTS[role][:, o[:, 4]].T + _LONG[role][:, o[:, 5]].T


def transfer(em: np.ndarray) -> np.ndarray:
    """Best scores from each state before the lines to each state at their end."""
    m = _STEP + em[0]
    for e in em[1:]:
        m = (m[:, :, None] + _STEP[None]).max(axis=1) + e
    return m


def viterbi(em: np.ndarray, entry: np.ndarray | None = None, final: int = -1) -> list[int]:
    """The likeliest states; ``entry``: scores of the states before the first line (a start where None); ``final``: the last state, if known."""
    v = (_START if entry is None else (entry[:, None] + _STEP).max(axis=0)) + em[0]
    back = np.zeros(em.shape, dtype=np.int8)
    for t in range(1, len(em)):
        s = v[:, None] + _STEP
        back[t] = s.argmax(axis=0)
        v = s.max(axis=0) + em[t]
    out = [int(v.argmax()) if final < 0 else final]
    for t in range(len(em) - 1, 0, -1):
        out.append(int(back[t][out[-1]]))
    return out[::-1]


def through_chunks(matrices: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
    """For each chunk after the first scores: (scores at its entry, state at its exit).  The first matrix holds the start already."""
    scores = [matrices[0].max(axis=0)]
    for m in matrices[1:]:
        scores.append((scores[-1][:, None] + m).max(axis=0))
    exits = [int(scores[-1].argmax())]
    for k in range(len(matrices) - 1, 0, -1):
        exits.append(int((scores[k - 1] + matrices[k][:, exits[-1]]).argmax()))
    exits.reverse()
    return [(scores[k - 1] if k else scores[0], exits[k]) for k in range(len(matrices))]


def _lines(texts: list[str | None]) -> tuple[list[str], list[tuple[int, ...]], list[int]]:
    """Lines without markers, what is observed of them, and how many each row has."""
    lines, seen, count = [], [], []
    for text in texts:
        own = (text or "").split("\n")
        for k, line in enumerate(own):
            plain, what = read_line(line, k == 0)
            lines.append(plain), seen.append(what)
        count.append(len(own))
    return lines, seen, count


_CHUNKS = "conv long, chunk long, open boolean, turns array<long>, texts array<string>, matrix array<double>, start_matrix array<double>"


def _cut(batches):
    """Sorted rows as chunks.  A conversation that may go on beyond its chunk or task is open and carries its matrices."""
    from pyspark import TaskContext

    base, number = TaskContext.get().partitionId() << 32, 0
    held, size, conv, chunk_of, first_conv = [], 0, None, 0, True

    def emit(last_of_task: bool, more: bool):
        nonlocal number, held, size
        turns, texts = zip(*held)
        is_open = first_conv or last_of_task or more or chunk_of > 0
        matrix = start = None
        if is_open:
            em = emissions(_lines(list(texts))[1])
            matrix, s = transfer(em), _START + em[0]
            for e in em[1:]:
                s = (s[:, None] + _STEP).max(axis=0) + e
            start = s.tolist()
            matrix = matrix.ravel().tolist()
        row = {"conv": conv, "chunk": base + number, "open": is_open, "turns": list(turns), "texts": list(texts), "matrix": matrix, "start_matrix": start}
        number, held, size = number + 1, [], 0
        return pa.RecordBatch.from_pylist([row], schema=_arrow_chunks())

    begun = False
    for batch in batches:
        for c, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if begun and c != conv:
                yield emit(False, False)
                chunk_of, first_conv = 0, False
            elif len(held) >= CHUNK or size >= CHUNK_BYTES:
                yield emit(False, True)
                chunk_of += 1
            begun, conv = True, c
            held.append((t, x))
            size += len(x or "")
    if held:
        yield emit(True, False)


def _arrow_chunks() -> pa.Schema:
    doubles = pa.list_(pa.float64())
    return pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("open", pa.bool_()), ("turns", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("matrix", doubles), ("start_matrix", doubles)])


def _plan(table: pa.Table) -> pa.Table:
    """A conversation's chunks: whether first and last, the scores at the entry and the state at the exit."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    matrices = [np.array(rows[0]["start_matrix"])[None]] + [np.array(r["matrix"]).reshape(6, 6) for r in rows[1:]]
    out = through_chunks(matrices)
    n = len(rows)
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
        "first": pa.array([k == 0 for k in range(n)]),
        "last": pa.array([k == n - 1 for k in range(n)]),
        "entry": pa.array([None if k == 0 else out[k][0].tolist() for k in range(n)], pa.list_(pa.float64())),
        "final": pa.array([out[k][1] for k in range(n)], pa.int32()),
    })


def _decode(batch: pa.RecordBatch):
    conv_, turns_, texts_, first_, last_, entry_, final_ = (batch.column(k) for k in range(7))
    for k in range(batch.num_rows):
        turns, texts = turns_[k].as_py(), texts_[k].as_py()
        first, last, final = (c[k].as_py() for c in (first_, last_, final_))
        lines, seen, count = _lines(texts)
        whole = first is None
        states = viterbi(emissions(seen), None if whole or first else np.array(entry_[k].as_py()), -1 if whole else final)
        opened = not (whole or first)  # whether a turn is open before the chunk
        role, begun, rendered, at = [], [], [], 0
        for n in count:
            parts, starts = [], 0
            for line, s in zip(lines[at : at + n], states[at : at + n]):
                if s % 2 == 0:
                    starts += 1
                    parts.append(("<|im_end|>\n" if opened else "") + f"<|im_start|>{ROLES[s // 2]}\n" + line + "\n")
                    opened = True
                else:
                    parts.append(line + "\n")
            role.append(ROLES[states[at] // 2])
            begun.append(starts)
            rendered.append("".join(parts))
            at += n
        if whole or last:
            rendered[-1] += "<|im_end|>\n"
        m = len(turns)
        yield pa.RecordBatch.from_arrays([pa.array([conv_[k].as_py()] * m, pa.int64()), pa.array(turns, pa.int64()), pa.array(role), pa.array(count, pa.int64()), pa.array(begun, pa.int64()), pa.array(rendered)], names=["conv", "turn", "role", "n_lines", "n_begun", "rendered"])


def format_transcripts(df: DataFrame, *, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Per row: conv, turn, role (of its first line), n_lines, n_begun (turns that begin in it), rendered.

    ``rendered``, in order, is the conversation in canonical form.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(order_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    order = ["conv", "turn", F.xxhash64("text"), "text"]
    chunks = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, _CHUNKS), "chunks")
    plan = chunks.where("open").select("conv", "chunk", "matrix", "start_matrix").groupBy("conv").applyInArrow(_plan, "chunk long, first boolean, last boolean, entry array<double>, final int")
    ready = chunks.select("conv", "chunk", "turns", "texts").join(plan, "chunk", "left").select("conv", "turns", "texts", "first", "last", "entry", "final")
    return ready.mapInArrow(per_batch(_decode), "conv long, turn long, role string, n_lines long, n_begun long, rendered string")
