"""Benchmark decontamination with one Aho-Corasick automaton.

The test items are lower-cased (A-Z) and cut into words; every run of
``window`` consecutive item words is a phrase (an item of fewer words, but not
none, is one phrase). One automaton over all phrases reads each document once,
in normal form (its words joined by single spaces); hits are mapped back to
word numbers and to character offsets of the original text.

Scale: the documents are scanned where they lie, without a shuffle. Only the
item table travels: its normalised text must stay under ``max_item_bytes``, or
the call fails with a clear error instead of broadcasting without bound (split
the items into several tables then; hits of item tables simply add up).

Defined cases: null or empty text has no words and no hits; an item without
words gives no phrase; rows that repeat an item_id act as one item (a phrase
belongs to the id); rows with a null item_id are left out, or, with ``unnamed``
(as in the registered query and in ``remove_contaminated``), hit like any other
and together count as one item that the digest of ids does not name; repeated
documents are answered one by one; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.packs import join_text, split_text
from wearcast.llm.words import slices

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
MAX_ITEM_BYTES = 64 << 20

HIT = "start_word int, end_word int, start_char int, end_char int, item_ids array<string>"


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words; UTF-8 bytes above 0x7F belong to words, as their code points do."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def phrases(items: list[tuple[str | None, str | None]], window: int) -> dict[bytes, set[str | None]]:
    """Phrase (words joined and framed by single spaces) -> ids of the items that hold it."""
    out: dict[bytes, set[str | None]] = {}
    for item_id, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(b" " + b" ".join(words[i:i + window]) + b" ", set()).add(item_id)
    return out


def _automaton(table: dict[bytes, set[str]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase, ids in table.items():
        machine.add_word(phrase.decode("latin-1"), (phrase.count(b" ") - 1, ids))  # one character a byte
    if table:
        machine.make_automaton()
    return machine


def find_hits(machine, text: str | None) -> tuple[int, list[tuple[int, int, set[str]]]]:
    """(number of words, hits as (first word, end word, item ids)) of one text."""
    words = normal_words(text)
    if not words or not len(machine):
        return len(words), []
    line = b" " + b" ".join(words) + b" "
    hits, at, seen = [], 0, 0
    for end, (size, ids) in machine.iter(line.decode("latin-1")):  # in order of ends
        seen += line.count(b" ", at, end)  # spaces before the closing one: words up to here
        at = end
        hits.append((seen - size, seen, ids))
    return len(words), hits


def _listed(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, max_item_bytes: int, unnamed: bool):
    """The items as a broadcast list, if they are small enough."""
    own = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    own = own if unnamed else own.filter("i is not null")
    size = own.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 64)).first()[0] or 0
    if size > max_item_bytes:
        raise ValueError(f"items hold {size} bytes, more than max_item_bytes={max_item_bytes}; scan them in several tables")
    return docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in own.collect()])


def scan(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES, unnamed: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (word and original character offsets, item ids).

    A hit's ``start_char``/``end_char`` are code-point offsets into the text as given.
    """
    listed = _listed(docs, items, item_id, item_text, max_item_bytes, unnamed)
    types = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(phrases(listed.value, window))
        for b in batches:
            words, hit, spans = [], [], []
            for t in b.column(1).to_pylist():
                n, hits = find_hits(machine, t)
                covered, end, out = 0, 0, []
                for a, z, _ in sorted(hits, key=lambda h: h[:2]):
                    covered += max(0, z - max(a, end))
                    end = max(end, z)
                if hits:
                    at = [m.span() for m in _WORD.finditer(t.translate(_UPPER))]
                    out = [{"start_word": a, "end_word": z, "start_char": at[a][0], "end_char": at[z - 1][1],
                            "item_ids": sorted(ids, key=lambda i: (i is None, i or ""))} for a, z, ids in hits]
                words.append(n)
                hit.append(covered)
                spans.append(out)
            kind = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("start_char", pa.int32()),
                                       ("end_char", pa.int32()), ("item_ids", pa.list_(pa.string()))]))
            yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, kind)],
                                  ["doc_id", "n_words", "n_hit", "hits"])

    kind = types.schema["doc_id"].dataType.simpleString()
    return types.mapInArrow(read, f"doc_id {kind}, n_words long, n_hit long, hits array<struct<{_struct(HIT)}>>")


def _struct(ddl: str) -> str:
    return re.sub(r"(\w+) ([\w<>]+)(, |$)", r"\1: \2\3", ddl)


def report(scanned: DataFrame) -> DataFrame:
    """Digest of ``scan``: n_items, items_sha256 and contaminated beside the word counts."""
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["item_ids"]))))
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without those that hold a phrase of an item; all columns and clean rows stay.

    The verdict is computed beside each row, not joined back on doc_id, so repeated or null ids are judged one by one.
    """
    listed = _listed(docs, items, "item_id", "text", MAX_ITEM_BYTES, True)
    rows = split_text(docs).select("row", "text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(phrases(listed.value, window))
        for b in batches:
            for part in slices(b, "text"):
                yield part.filter(pa.array([not find_hits(machine, t)[1] for t in part.column("text").to_pylist()], pa.bool_()))

    return join_text(rows.mapInArrow(clean, rows.schema), docs)
