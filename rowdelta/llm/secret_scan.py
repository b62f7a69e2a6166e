"""Secrets in texts, found by one combined automaton in one pass over the bytes.

The base kinds are assignments, access keys and long hex runs; further kinds add well-known key formats and take
nothing from the base ones. Spans are code points, end exclusive.

Cases: a null or empty text has no spans; null ids and repeated rows are kept; an empty table gives no rows; other
columns are ignored, whatever their names. A worker holds a few megabytes of text at a time, or one longer text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import arrow
from rowdelta.llm.automaton import Automaton

BASE = ("assign", "access", "hex")
#: (kind, regex, least bytes of a match). A least length of a common run stands in the regex, where it costs states but
#: saves looking at every short run; of a rare one it is measured afterwards, as is an assignment's value.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 0),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]{16,}", 16),
    ("github", r"gh[opusr]_[A-Za-z0-9]+", 40),
    ("payment", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    ("pem", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", 0),
)
#: Least length of an assigned value.
VALUE = 12

SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


@functools.lru_cache(maxsize=2)
def automaton(rules: tuple = RULES) -> Automaton:
    return Automaton([r[:2] for r in rules])


def _value_length(match: bytes) -> int:
    """Of an assignment: what follows the first sign, blanks and a quote."""
    sign = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[sign + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def find(text: bytes, rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    least = {r[0]: r[2] for r in rules}
    hits = [(k, a, b) for k, a, b in automaton(rules).scan(text) if b - a >= least[k] and (k != "assign" or _value_length(text[a:b]) >= VALUE)]
    if hits and not text.isascii():
        hits = [(k, len(text[:a].decode()), len(text[:b].decode())) for k, a, b in hits]
    order = {r[0]: i for i, r in enumerate(rules)}
    return sorted(hits, key=lambda h: (h[1], order[h[0]]))


def scan(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, spans array<struct<kind, start, end>>."""
    automaton(rules)  # a faulty rule fails here, not on the executors
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrow.slices(batches):
            found = [[dict(zip(("kind", "start", "end"), h)) for h in find(t, rules)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, spans)], ["doc", "spans"])

    return source.mapInArrow(run, f"doc {kind}, spans {SPANS}").withColumnRenamed("doc", id_col)
