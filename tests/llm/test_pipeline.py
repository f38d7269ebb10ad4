"""Each stage of the pipeline on its own input against the plain versions of the operators' tests."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline as C
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_recall import all_pairs as lines
from wearcast.llm import byte_bpe


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """What each stage reads and, last, the result, each written and read again."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF_SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(inputs):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]
    assert all(df.columns == inputs[0].columns for df in inputs[:-1])
    assert inputs[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_toxicity_keeps_rows_whole(inputs):
    before, after = texts(inputs[0]), texts(inputs[1])
    assert 0 < len(before) - len(after) < 0.3 * len(before) and all(before[i] == t for i, t in after.items())


def test_line_dedup(inputs):
    """Against all pairs of lines by edit similarity alone: nothing else goes, and nearly all of it goes (the search for
    pairs is not complete, see the README)."""
    docs = sorted(texts(inputs[1]).items())
    got, want = texts(inputs[2]), dict(zip((i for i, _ in docs), lines(docs, 0.8)))

    def left(t):
        return [] if t is None else t.split("\n")

    more = sum(len(left(got[i])) - len(left(want[i])) for i, _ in docs)
    removed = sum(len(left(t)) - len(left(want[i])) for i, t in docs)
    assert all(set(left(want[i])) <= set(left(got[i])) for i, _ in docs) and 0 <= more <= 0.02 * removed and removed > 20
    assert all(r["n_chars"] == len(r["text"]) for r in inputs[2].collect())


def test_one_document_of_each_group(inputs):
    docs = texts(inputs[2])
    want = groups(list(docs), list(docs.values()), 5, 80)  # the stage's rule
    assert set(texts(inputs[3])) == {i for i, n, c in want if i == c or not n}


def test_decontamination(spark, inputs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    docs = texts(inputs[3])
    assert set(texts(inputs[4])) == {i for i, t in docs.items() if not hits(t, items, 10)[4]}


def test_tokens(inputs):
    docs = texts(inputs[4])
    codec = byte_bpe.Codec(byte_bpe.read_ranks(C.RANKS), public_tokenizers.PATTERN)
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in inputs[5].collect()}
    assert got == {i: (len(codec.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}
