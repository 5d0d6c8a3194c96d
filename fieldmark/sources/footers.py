"""Parquet footers and dictionary pages as a table: what a file already states about its columns.

Footers are read by the executors, one task a group of files, through the distributed file listing
of the binaryFile source without its content column. Nulls and extrema of a chunk count only where
the writer stored them in a form that is exact: text extrema may be shortened by a writer and those
of floating point ignore NaN, so neither is taken. A chunk's distinct values, and with them its exact
extrema, are those of its dictionary page if every data page refers to the dictionary. A chunk of
which neither tells enough is scanned, on its own: the column's other chunks are not.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, row_group int, column string, type string, rows long, nulls long, lo long, hi long, lo_real double, hi_real double, lo_text string, hi_text string, bytes long, scanned boolean, hashes array<long>"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_WIDTHS = {"INT32": np.dtype("<i4"), "INT64": np.dtype("<i8"), "FLOAT": np.dtype("<f4"), "DOUBLE": np.dtype("<f8")}
_CODECS = {"SNAPPY": "snappy", "ZSTD": "zstd", "GZIP": "gzip", "BROTLI": "brotli", "LZ4_RAW": "lz4_raw"}


class _Compact:
    """Reader of the Thrift compact protocol, as far as page headers need it."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n, of = (head >> 4, head & 15) if head >> 4 != 15 else (self.varint(), head & 15)
            return [self.value(of) for _ in range(n)]
        if kind == 12:
            return self.fields()
        raise ValueError(f"field kind {kind}")

    def fields(self) -> dict[int, object]:
        out: dict[int, object] = {}
        last = 0
        while (head := self.data[self.at]) != 0:
            self.at += 1
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            out[last] = self.value(head & 15)
        self.at += 1
        return out


def dictionary_values(f, chunk) -> np.ndarray | list[bytes] | None:
    """The values of a column chunk's dictionary; None unless every data page refers to it.

    ``f`` is a random access file, ``chunk`` its pyarrow column metadata. Only page headers and the
    dictionary page are read.
    """
    if not chunk.has_dictionary_page or chunk.physical_type not in (*_WIDTHS, "BYTE_ARRAY"):
        return None
    codec = _CODECS.get(chunk.compression)
    if chunk.compression != "UNCOMPRESSED" and codec is None:
        return None
    at, end = chunk.dictionary_page_offset, chunk.dictionary_page_offset + chunk.total_compressed_size
    seen, values = 0, None
    while seen < chunk.num_values and at < end:
        f.seek(at)
        reader = _Compact(f.read(min(512, end - at)))
        try:
            page = reader.fields()
        except IndexError:  # a header with long page statistics
            f.seek(at)
            reader = _Compact(f.read(min(1 << 20, end - at)))
            page = reader.fields()
        body, size = at + reader.at, page[3]
        if page[1] == 2:
            n = page[7][1]
            f.seek(body)
            raw = f.read(size)
            raw = raw if codec is None else pa.Codec(codec).decompress(raw, decompressed_size=page[2]).to_pybytes()
            if chunk.physical_type in _WIDTHS:
                values = np.frombuffer(raw, dtype=_WIDTHS[chunk.physical_type], count=n)
            else:
                values, k = [], 0
                for _ in range(n):
                    length = int.from_bytes(raw[k : k + 4], "little")
                    values.append(raw[k + 4 : k + 4 + length])
                    k += 4 + length
        else:
            header = page.get(5) or page.get(8)
            # encodings 2 and 8 refer to the dictionary; the version 2 header has its encoding at field 4
            if header is None or header[2 if 5 in page else 4] not in (2, 8):
                return None
            seen += header[1]
        at = body + size
    return values


def scanned_values(file: pq.ParquetFile, group: int, column: str) -> tuple[np.ndarray | list[bytes], int]:
    """(distinct values in their stored form, nulls) of a chunk, read whole."""
    data = file.read_row_group(group, columns=[column]).column(0)
    nulls, distinct = data.null_count, data.unique().drop_null()
    kind = distinct.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return distinct.cast(pa.binary()).to_pylist(), nulls
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return distinct.to_pylist(), nulls
    if pa.types.is_floating(kind) or pa.types.is_integer(kind):
        # smaller integers are stored as 32 bits
        width = kind.to_pandas_dtype() if kind.bit_width in (32, 64) else np.int32
        return distinct.to_numpy().astype(width), nulls
    if pa.types.is_temporal(kind):
        return distinct.cast(pa.int64() if kind.bit_width == 64 else pa.int32()).to_numpy(), nulls
    return [str(x).encode() for x in distinct.to_pylist()], nulls


def _hashes(values: np.ndarray | list[bytes]) -> list[int]:
    import xxhash

    raw = values if isinstance(values, list) else [x.tobytes() for x in values]
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in set(raw)]


def _extrema(values: np.ndarray | list[bytes]) -> dict[str, object]:
    """The least and greatest of a chunk's values, by kind. NaN, the greatest number in Spark, is given
    as text: as a number it would arrive as null."""
    if not len(values):
        return {}
    if isinstance(values, list):
        low, high = min(values).decode(errors="replace"), max(values).decode(errors="replace")
        return {"lo_text": low, "hi_text": high}
    if values.dtype.kind == "f":
        real = values[~np.isnan(values)]
        out = {"lo_real": float(real.min()), "hi_real": float(real.max())} if len(real) else {"lo_text": "NaN"}
        return out if len(real) == len(values) else out | {"hi_text": "NaN"}
    return {"lo": int(values.min()), "hi": int(values.max())}


def _footer_rows(path: str, columns: set[str] | None, values: bool) -> Iterator[dict]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    with system.open_input_file(inner) as f:
        file = pq.ParquetFile(f)
        meta = file.metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                chunk = group.column(c)
                name = chunk.path_in_schema
                if columns is not None and name not in columns:
                    continue
                s = chunk.statistics if chunk.is_stats_set else None
                row = dict.fromkeys(NAMES) | {"file": path, "row_group": g, "column": name, "type": chunk.physical_type, "rows": group.num_rows, "bytes": chunk.total_compressed_size, "scanned": False}
                row["nulls"] = s.null_count if s is not None and s.has_null_count else None
                if s is not None and s.has_min_max and isinstance(s.min_raw, int) and not isinstance(s.min_raw, bool):
                    row["lo"], row["hi"] = s.min_raw, s.max_raw
                nested = "." in name
                if values and not nested:
                    found = dictionary_values(f, chunk)
                    if found is None or row["nulls"] is None:
                        row["scanned"] = True
                        found, row["nulls"] = scanned_values(file, g, name)
                    row["hashes"] = _hashes(found)
                    row |= _extrema(found)
                elif (row["nulls"] is None or (row["lo"] is None and row["nulls"] != group.num_rows)) and not nested and chunk.physical_type in _WIDTHS:
                    # the footer says too little even for extrema
                    row["scanned"] = True
                    found, row["nulls"] = scanned_values(file, g, name)
                    row |= _extrema(found)
                yield row


def footers(spark: SparkSession, path: str, columns: set[str] | None = None, values: bool = True) -> DataFrame:
    """One row for each file, row group and column (all, or those named) of the Parquet data at ``path``.
    With ``values``, hashes of its distinct values and extrema of any type; without, nulls and extrema
    of numbers only, mostly from the footer alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"]:
                rows = list(_footer_rows(p, columns, values))
                if rows:
                    yield pd.DataFrame([tuple(r.values()) for r in rows], columns=NAMES, dtype=object).astype({"nulls": "Int64", "lo": "Int64", "hi": "Int64", "lo_real": "float64", "hi_real": "float64"})

    return spark.read.format("binaryFile").load(path).select("path").repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, SCHEMA)
