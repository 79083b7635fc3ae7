"""Line dedup: drop lines that many documents share.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; lines over
the threshold go, and the rest is joined again in order. Both readings of the lines are the same
byte functions, so a key has one definition.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import BLANKS, map_batches, materialize

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_BLANKS = BLANKS.encode()


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """MD5 of a line without white space at its ends and with A-Z in lower case; None if it is too short."""
    key = line.strip(_BLANKS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.md5(key.translate(_TO_LOWER)).digest()


def _explode(min_chars: int):
    """Batch of (id, text as bytes) to rows (id, hash), distinct inside a text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, hashes = [], []
        for row, text in enumerate(batch.column(1)):
            body = text.as_py()
            if body:
                found = {key_hash(line, min_chars) for line in body.split(b"\n")}
                found.discard(None)
                hashes.extend(found)
                rows.extend([row] * len(found))
        ids = batch.column(0).take(pa.array(rows, pa.int32()))
        return pa.RecordBatch.from_arrays([ids, pa.array(hashes, pa.binary())], ["id", "hash"])

    return work


def _cut(min_chars: int):
    """Reassemble the lines of each text, without those whose key hash is listed."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_lines, n_dropped, kept_text = [], [], []
        for text, drop in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            body, gone = text.as_py() or b"", drop.as_py()
            dropped = 0
            if gone:
                lines, gone = body.split(b"\n"), set(gone)
                kept = [line for line in lines if key_hash(line, min_chars) not in gone]
                dropped, body = len(lines) - len(kept), b"\n".join(kept)
            n_lines.append(body.count(b"\n") + 1 if not dropped else len(lines))
            n_dropped.append(dropped)
            kept_text.append(body)
        made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept_text, pa.binary())]
        names = [*batch.schema.names[:-2], "n_lines", "n_dropped", "kept"]
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names)

    return work


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, hash): the distinct key hashes of each row's lines, short keys left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(rows, lambda: _explode(min_chars), f"id {kind}, hash binary")


def lines_to_drop(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, hashes): per document the hashes of the lines it loses.

    The distinct count is partial on (hash, id), so a line of every document meets no single task. Shared
    hashes are written, so that the join back is of two plain shuffles, which adaptive execution can split
    where a hash is hot.
    """
    rows = line_hashes(docs, id_col, text_col, min_chars)
    counted = rows.groupBy("hash").agg(
        F.count_distinct("id").alias("ids"),
        F.max("id").alias("keep"),
        F.max(F.col("id").isNull().cast("int")).alias("without_id"),
    )
    shared = counted.where(F.col("ids") + F.col("without_id") >= min_docs).select("hash", "keep")
    shared = materialize(shared, "shared-lines")
    lost = rows.join(shared, "hash").where(~F.col("id").eqNullSafe(F.col("keep")))
    return lost.groupBy("id").agg(F.collect_set("hash").alias("hashes"))


def _with_drops(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Rows (row_id, ...) with the list of hashes their document loses, or null."""
    drops = lines_to_drop(docs, id_col, text_col, min_chars, min_docs).withColumnRenamed("id", "lost_id")
    return rows.join(drops, F.col("row_id").eqNullSafe(F.col("lost_id")), "left")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text): one row per input row.

    Keys shorter than ``min_chars`` code points never go. Of the others, those in ``min_docs`` or more
    documents stay only in the largest id that holds them. Null or empty text: one empty line. Rows that
    repeat an id are one document when counted, and each keeps or loses its own lines. A null id is one
    more document, smaller than any id. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    joined = _with_drops(rows, docs, id_col, text_col, min_chars, min_docs)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_lines bigint, n_dropped bigint, kept binary"
    out = map_batches(joined.select(F.col("row_id").alias("id"), "text", "hashes"), lambda: _cut(min_chars), schema)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept_text"))


def documents_without_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """The documents with the kept text in place of the text; all rows and columns stay.

    ``n_chars``, where there is such a column, is counted anew. A null text stays null.
    """
    # Own names inside, as the input may use any.
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    rows = docs.toDF(*names).select(
        *[c for i, c in enumerate(names) if i != place],
        F.col(names[docs.columns.index(id_col)]).alias("row_id"),
        F.col(names[place]).isNull().alias("was_null"),
        F.col(names[place]).cast("string").cast("binary").alias("text"),
    )
    joined = _with_drops(rows, docs, id_col, text_col, min_chars, min_docs)
    kept_names = [c for i, c in enumerate(names) if i != place]
    kinds = [f"{c} {docs.schema[docs.columns[int(c[1:])]].dataType.simpleString()}" for c in kept_names]
    schema = ", ".join([*kinds, "was_null boolean", "n_lines bigint", "n_dropped bigint", "kept binary"])
    cut = map_batches(joined.select(*kept_names, "was_null", "text", "hashes"), lambda: _cut(min_chars), schema)
    text = F.when(~F.col("was_null"), F.col("kept").cast("string"))
    out = []
    for name, own in zip(docs.columns, names):
        value = text if name == text_col else F.col(own)
        if name == "n_chars":
            value = F.when(F.col("was_null"), value).otherwise(F.char_length(text)).cast(docs.schema[name].dataType)
        out.append(value.alias(name))
    return cut.select(*out)
