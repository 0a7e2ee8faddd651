"""The pipeline's rows against a plain version of every stage, on a small corpus."""

import random
import sys
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))

from test_jaccard import groups  # noqa: E402
from test_models import toxic_corpus  # noqa: E402
from test_quality_pii import CARD, EMAIL, IP, PHONE, base_spans, measured  # noqa: E402, F401
from test_tokens import packed_fully  # noqa: E402

from tidepool.llm import bytetext as bt  # noqa: E402
from tidepool.llm.quality import RULES  # noqa: E402
from tidepool.llm.toxicity import train  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    docs, labels = toxic_corpus(500, 4)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    rnd = random.Random(9)
    for k in range(40):  # near copies, and personal data
        words = rows[k][1].split()
        words[rnd.randrange(len(words))] = "changed"
        rows.append((2000 + k, " ".join(words), "en", "hot", 0))
    for k, said in enumerate(["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.zz 1.2.3.4@b.cd"]):
        rows.append((3000 + k, f"note {said} here, " + rows[100 + k][1][::-1], "en", "s", 7))
    rows += [rows[3], rows[3], (3, rows[4][1] + " another text of the same id", "en", "s", 0)]  # repeated rows, an id with two texts
    rows += [(None, rows[5][1], "en", "s", 0), (None, rows[5][1], "en", "s", 0), (4000, None, "en", "s", 0), (4001, "", "en", "s", 0), (4002, "short", "en", "s", 5)]
    rows += [(5000, " ".join(f"long{i % 977}x{i}" for i in range(20_000)), "en", "s", 0), (5001, "buy now " * 40, "en", "s", 0)]
    return rows, labels


def kept_by_rules(text):
    m = {k: np.array([v]) for k, v in measured(text or "").items()}
    return not any(r.rejects(m)[0] for r in RULES)


def plain_redact(text):
    spans = [s.split(":") for s in base_spans(text).split(",") if s]
    at, out = 0, []
    for kind, a, b in spans:
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind.upper()}>"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def test_rows_are_those_of_a_plain_version(spark, tmp_path):
    import corpus_pipeline as P

    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    good = [r for r in rows if kept_by_rules(r[1])]
    docs = spark.createDataFrame(good, SCHEMA)
    model = train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = model.scores(*bt.buffers(pa.array([r[1] for r in good])))
    calm = [r for r, s in zip(good, scores) if s < 0.5]
    assert 0 < len(calm) < len(good) < len(rows)

    component = {i: c for i, _, c in groups([(r[0], r[1]) for r in calm if r[0] is not None])}
    left, seen = [r for r in calm if r[0] is None], set()
    for r in calm:
        if r[0] is not None and component[r[0]] == r[0]:
            left.append(r)
            seen.add(r[0])
    single = [r for r in left if sum(x[0] == r[0] for x in left) == 1 or r[0] is None]
    several = {r[0]: [x[1] for x in left if x[0] == r[0]] for r in left if r not in single}  # one of these texts stays
    assert len(seen) < len({r[0] for r in calm if r[0] is not None}) and several

    got = [r.asDict() for r in P.run(spark, str(tmp_path)).collect()]
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(got[0])
    ids = {r["doc_id"] for r in got}
    assert ids == seen | {None}
    clean = [(r[0], plain_redact(r[1])) for r in single]
    pieces = run_with_ids(spark, P, str(tmp_path))
    assert sorted((str(p.doc_id), p.start, p.length, zlib.crc32(p.ids)) for p in pieces) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in got)
    chosen = []
    for i, texts in several.items():
        size = next(r["doc_tokens"] for r in got if r["doc_id"] == i)
        held = [plain_redact(t) for t in texts if len(tokens(plain_redact(t))) == size]
        chosen.append((i, held[0]))
    packed_fully([SimpleRow(p) for p in pieces], clean + chosen, 2048)


def tokens(text):
    from test_tokens import ids_of

    return ids_of(text)


class SimpleRow(dict):
    def __init__(self, p):
        super().__init__(vars(p))


def run_with_ids(spark, P, path):
    """The pieces of the same run with their ids, which the last stage only has a crc32 of."""
    from tidepool.llm.packing import pack_documents

    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, path).write.parquet(f"{path}/stage{k}")
        now = spark.read.parquet(f"{path}/stage{k}")
        assert now.columns == docs.columns, name
        docs = now
    return [SimpleNamespace(**{**r.asDict(), "ids": bytes(r["ids"])}) for r in pack_documents(docs).collect()]


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
