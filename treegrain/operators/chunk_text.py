"""Plain text into a root and paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from treegrain.operators.chunks import with_paths
from treegrain.session import runs, ship_code, spread, tidy

MIN_CHARS, MAX_CHARS = 40, 1200
#: Bytes of text that are cut at once.
SLICE_BYTES = 1 << 20
_BLANK, _SENTENCE = re.compile(r"\n\s*\n+"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def pieces(text: str | None, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> list[str]:
    """Paragraphs (parts between blank lines). Short ones are joined with what follows until they reach min_chars, what is left over joins the last one; those
    over max_chars are cut after sentences and packed greedily; a single sentence is never cut. Time grows with the text's length only."""
    done: list[list[str]] = []
    held, size = [], 0
    for p in _BLANK.split(text or ""):
        p = p.strip()
        if not p:
            continue
        size += len(p) + 2 * bool(held)
        held.append(p)
        if size >= min_chars:
            done.append(held)
            held, size = [], 0
    if held:
        done[-1:] = [done[-1] + held] if done else [held]
    out = []
    for parts in done:
        paragraph = "\n\n".join(parts)
        if len(paragraph) <= max_chars:
            out.append(paragraph)
            continue
        run, size = [], 0
        for sentence in _SENTENCE.split(paragraph):
            if run and size + len(sentence) + 1 > max_chars:
                out.append(" ".join(run))
                run, size = [], 0
            size += len(sentence) + bool(run)
            run.append(sentence)
        out.append(" ".join(run))
    return out


def chunk_text(docs: DataFrame, *, key: str = "doc_id", text: str = "text", title: str | None = None, root: str = "doc", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(key, local_id, text, depth, node_path, parent_path, name, source_file, start_line, end_line): a root per document and its paragraphs.

    Narrow: documents neither meet nor move, and a megabyte of text at a time is cut and handed on. Null text has a root only.
    """
    ship_code(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in runs(whole, pc.binary_length(whole.column(1)).fill_null(0).to_numpy(), SLICE_BYTES):
                parts = [["", *pieces(t, min_chars, max_chars)] for t in b.column(1).to_pylist()]
                row = pa.array(np.repeat(np.arange(b.num_rows), [len(p) for p in parts]))
                local = np.concatenate([np.arange(len(p)) for p in parts])
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in carried), pa.array(local, pa.int32()), pa.array([x for p in parts for x in p], pa.string())], names=names)

    needed = docs.select(F.col(key), F.col(text).cast("string").alias("__text"), *([F.col(title).cast("string").alias("__title")] if title else []))
    carried = (0, 2) if title else (0,)
    shape = StructType([needed.schema[i] for i in carried]).add("local_id", IntegerType()).add("__part", StringType())
    names = shape.names
    rows = spread(needed).mapInArrow(tidy(each), shape).withColumn("__title", F.coalesce(F.col("__title"), F.lit("Document")) if title else F.lit("Document"))
    path = F.when(F.col("local_id") == 0, root).otherwise(F.concat(F.lit(f"{root}.p"), F.col("local_id").cast("string")))
    rows = rows.withColumn("node_path", path)
    body = F.concat("node_path", F.lit("\n"), "__title", F.lit(" (paragraph "), F.col("local_id").cast("string"), F.lit(")\n\n"), "__part")
    rows = rows.withColumn("text", F.when(F.col("local_id") == 0, F.concat("node_path", F.lit("\n"), "__title")).otherwise(body))
    return with_paths(rows.withColumn("depth", F.when(F.col("local_id") == 0, 0).otherwise(1))).select(key, "local_id", "text", "depth", "node_path", "parent_path", "name", F.lit("<text>").alias("source_file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
