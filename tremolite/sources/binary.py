"""Binary files: one file per task, rows out. The byte reader is a plug-in; subsetting, scaling and reduction are DataFrame work."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

c, lit = F.col, F.lit


def npy_reader(content: bytes):
    """2-D .npy array; row and column numbers stand in for coordinates."""
    return np.load(io.BytesIO(content), allow_pickle=False)


def decode_grid(spark: SparkSession, path: str, reader: Callable[[bytes], np.ndarray] = npy_reader, lat0=0.0, lon0=0.0, dlat=1.0, dlon=1.0,
                fill: float | None = None, scale: float = 1.0, offset: float = 0.0, bbox: tuple | None = None, stride: int = 1) -> DataFrame:
    """(path, lat, lon, value) rows of gridded files; the box is applied inside the task before rows are made."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                grid = np.asarray(reader(content), dtype="float64")
                lat, lon = lat0 + dlat * np.arange(grid.shape[0]), lon0 + dlon * np.arange(grid.shape[1])
                keep_i, keep_j = np.arange(0, len(lat), stride), np.arange(0, len(lon), stride)
                if bbox:
                    keep_i = keep_i[(lat[keep_i] >= bbox[0]) & (lat[keep_i] <= bbox[1])]
                    keep_j = keep_j[(lon[keep_j] >= bbox[2]) & (lon[keep_j] <= bbox[3])]
                # a band of rows at a time, so a large grid never becomes one large batch
                for lo in range(0, len(keep_i), 512):
                    ii, jj = np.meshgrid(keep_i[lo:lo + 512], keep_j, indexing="ij")
                    v = grid[ii, jj].ravel()
                    ok = np.isfinite(v) if fill is None else np.isfinite(v) & (v != fill)
                    n = int(ok.sum())
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array(lat[ii.ravel()][ok]), pa.array(lon[jj.ravel()][ok]), pa.array(v[ok] * scale + offset)],
                                                         names=["path", "lat", "lon", "value"])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "path string, lat double, lon double, value double")


def daily_max(grid: DataFrame, date_pattern: str = r"(\d{4})-?(\d{2})-?(\d{2})") -> DataFrame:
    """Daily maximum of decoded files, the date taken from the file name."""
    d = F.concat_ws("-", *[F.regexp_extract("path", date_pattern, i) for i in (1, 2, 3)])
    return grid.groupBy(d.alias("date")).agg(F.max("value").alias("value_max"), F.count(lit(1)).alias("n"))


# Fixed values of the sample format: a header of 632 bytes; 4-byte floats, then integers from byte 280 on; float 0 is the sampling
# interval, floats 31 and 32 the station's latitude and longitude; integer 6 is the header version (6, 7; 0 in bare headers),
# integer 9 the number of samples. Files without an interval count as 100 Hz.
_HEADER, _DELTA, _LAT, _LON, _VERSION, _COUNT, _KNOWN, _RATE = 632, 0, 31, 32, 280 + 4 * 6, 280 + 4 * 9, (0, 6, 7), 100.0


def sac_samples(content: bytes):
    """(sampling rate, lat, lon, samples) of one seismic sample file, or None unless version and length agree in one byte order."""
    for kind in ("<", ">"):
        word = lambda at, kind=kind: struct.unpack_from(f"{kind}i", content, at)[0]
        if len(content) >= _HEADER and word(_VERSION) in _KNOWN and word(_COUNT) > 0 and len(content) >= _HEADER + 4 * word(_COUNT):
            field = lambda number, kind=kind: struct.unpack_from(f"{kind}f", content, 4 * number)[0]
            samples = np.frombuffer(content, f"{kind}f4", word(_COUNT), _HEADER).astype(np.float64)
            return 1 / field(_DELTA) if field(_DELTA) > 0 else _RATE, field(_LAT), field(_LON), samples
    return None


def read_waveforms(spark: SparkSession, path: str) -> DataFrame:
    """(path, fs, lat, lon, samples ARRAY<DOUBLE>) rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                got = sac_samples(content)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([got[0]]), pa.array([got[1]]), pa.array([got[2]]), pa.ListArray.from_arrays([0, len(got[3])], pa.array(got[3]))],
                                                     names=["path", "fs", "lat", "lon", "samples"])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "path string, fs double, lat double, lon double, samples array<double>")


def npy_bytes(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values)
    return out.getvalue()


def sac_bytes(samples: np.ndarray, rate: float, lat: float, lon: float) -> bytes:
    """A sample file with the fields that `sac_samples` reads; all others hold the format's mark for undefined."""
    head = bytearray(struct.pack("<70f", *[-12345.0] * 70) + struct.pack("<40i", *[-12345] * 40) + b" " * 192)
    for field, value in ((_DELTA, 1 / rate), (_LAT, lat), (_LON, lon)):
        struct.pack_into("<f", head, 4 * field, value)
    struct.pack_into("<i", head, _VERSION, 6)
    struct.pack_into("<i", head, _COUNT, len(samples))
    return bytes(head) + np.asarray(samples, "<f4").tobytes()


def write_files(groups: DataFrame, root: str, encode: Callable[[dict], bytes]) -> int:
    """One file per row below `root` (a folder all executors share), named by the column `name`; the number of files written.

    A file appears under its name only when it is whole, so a retried task overwrites it with the same bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base)
        for batch in batches:
            for row in batch.to_pylist():
                temporary = f"{base}/_{uuid.uuid4().hex}"
                with store.open_output_stream(temporary, compression=None) as out:
                    out.write(encode(row))
                store.move(temporary, f"{base}/{row['name']}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})
    return groups.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
