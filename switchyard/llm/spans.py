"""Spans found in texts: their text form, digests and the shared query shape."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from switchyard.llm.common import arrow_pass, narrow

Span = tuple[int, int, int]  # start, index of the kind, end (code points, end exclusive)


def written(spans: list[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join([f"{kinds[k]}:{start}:{end}" for start, k, end in sorted(spans)])


def find_spans(
    docs: DataFrame, finder: Callable[[str], list[Span]], kinds: Sequence[str], base: int,
    doc_id: str = "doc_id", text: str = "text", detail: bool = False,
) -> DataFrame:
    """doc_id, n_<kind> of the first ``base`` kinds, base_sha256, spans; with ``detail`` an array of structs too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [finder(t) if t else [] for t in batch.column("text").to_pylist()]
            counts = [[sum(1 for s in f if s[1] == k) for f in found] for k in range(base)]
            digests = [hashlib.sha256(written([s for s in f if s[1] < base], kinds).encode()).hexdigest() for f in found]
            columns = [
                batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                pa.array(digests, pa.string()), pa.array([written(f, kinds) for f in found], pa.string()),
            ]
            names = ["doc_id", *[f"n_{k}" for k in kinds[:base]], "base_sha256", "spans"]
            if detail:
                texts = batch.column("text").to_pylist()
                items = [
                    [{"kind": kinds[k], "start": a, "end": b, "value": t[a:b]} for a, k, b in sorted(f)]
                    for t, f in zip(texts, found)
                ]
                kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
                columns.append(pa.array(items, pa.list_(kind)))
                names.append("found")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in kinds[:base]) + "base_sha256 string, spans string"
    if detail:
        schema += ", found array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    return arrow_pass(narrow(docs, doc_id, text), work, schema)
