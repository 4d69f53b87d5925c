"""Language identification by compression.

Every language has a zstandard raw-content dictionary of labelled text. A text belongs to the
language whose dictionary encodes it in the fewest bytes; where the runner-up needs hardly more,
the text is rejected.

Texts are encoded whole, in blocks of fixed size that each start from the dictionary alone. In one piece, a long text's own repetitions
would replace the dictionary, all languages would come out nearly equal, and clean long texts would be rejected for
their narrow margin; in blocks the margin means the same at any length.

Defined results: empty, null and blank texts are rejected with language null; ties go to the
first language by name and have margin 0, so they are rejected too; a repeated row is judged
alike each time; no labelled text at all rejects everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import identified, slices

#: Bytes in each language's dictionary, and how many labelled documents are considered for it.
DICTIONARY_BYTES, DOCS_PER_LANGUAGE = 1 << 16, 200
BLOCK, LEVEL, MIN_MARGIN = 4096, 6, 0.005


def chosen(sizes: list[tuple[int, int, int]], dictionary_bytes: int) -> list[int]:
    """(hash, id, bytes) of a language's candidates -> the ids of those whose whole texts fill its dictionary, in order of the hash; one that doesn't fit in
    what is left is passed over. If none fits, the shortest alone."""
    out, left = [], dictionary_bytes
    for _, i, n in sorted(sizes):
        if n + bool(out) <= left:
            out.append(i)
            left -= n + bool(len(out) > 1)
    return out or [i for _, i in sorted((n, i) for _, i, n in sizes)[:1]]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionaries of whole texts from a bounded sample of labelled rows: of the `docs_per_language` with the lowest hash of the id, those that fit.
    They are chosen by ids and lengths; the driver gets only the texts that are used."""
    rank = F.xxhash64(F.col(id_col).cast("long"))
    live = docs.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    ids = live.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"), rank.alias("h"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("size")).distinct()
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id", "size"))).where(F.col("r") <= docs_per_language)
    candidates: dict[str, list[tuple[int, int, int]]] = {}
    for row in ids.collect():  # bounded by docs_per_language
        if row["size"]:
            candidates.setdefault(row["label"], []).append((row["h"], row["doc_id"], row["size"]))
    order = {(label, i): k for label, rows in candidates.items() for k, i in enumerate(chosen(rows, dictionary_bytes))}
    if not order:
        return {}
    wanted = docs.sparkSession.createDataFrame([(i, label) for label, i in order], "of long, label string")
    texts = identified(docs, id_col, text_col).join(F.broadcast(wanted), F.col("doc_id") == F.col("of"))  # bounded by the dictionaries' sizes
    found: dict[str, list[tuple[int, str]]] = {}
    for row in texts.toLocalIterator():
        found.setdefault(row["label"], []).append((order[row["label"], row["doc_id"]], row["text"]))
    out = {}
    for label, rows in sorted(found.items()):
        raw = "\n".join(dict.fromkeys(t.lower() for _, t in sorted(rows))).encode()
        if len(raw) >= 8:
            out[label] = raw
    return out


def compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries.values():
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))
    return out


def encoded_sizes(text: str, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    raw = text.lower().encode("utf-8", "surrogatepass")
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in coders]


def judge(text: str | None, names: list[str], coders: list[zstandard.ZstdCompressor], min_margin: float) -> tuple[str | None, float, bool]:
    """Language, margin, whether the text is rejected."""
    if not coders or not text or not text.strip():
        return None, 0.0, True
    sizes = encoded_sizes(text, coders)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    if len(order) == 1:
        return names[0], 1.0, False
    best, second = sizes[order[0]], sizes[order[1]]
    margin = (second - best) / second
    return names[order[0]], margin, margin <= min_margin


def _judged(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes], text_col: str, min_margin: float) -> Iterator[tuple[pa.RecordBatch, list]]:
    names, coders = list(dictionaries), compressors(dictionaries)
    for batch in slices(batches, text_col):
        yield batch, [judge(t.as_py(), names, coders, min_margin) for t in batch.column(text_col)]


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, language, margin, rejected: a row for each document. One scan, no shuffle."""
    dictionaries = fit(docs, id_col, text_col, label_col) if dictionaries is None else dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _judged(batches, dictionaries, "text", min_margin):
            language, margin, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(language, pa.string()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "language", "margin", "rejected"])

    return identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, language string, margin double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents that aren't rejected, all columns unchanged; rows with a null id go."""
    dictionaries = fit(docs, id_col, text_col, label_col) if dictionaries is None else dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _judged(batches, dictionaries, text_col, min_margin):
            keep = np.array([not rejected for *_, rejected in found], bool)
            yield batch.filter(pa.array(keep))

    return docs.where(F.col(id_col).isNotNull()).mapInArrow(run, docs.schema)
