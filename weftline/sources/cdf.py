"""A Spark data source for classic CDF files (versions 1 and 2), read and written with numpy.

``spark.read.format("cdf").option("path", folder_or_file).option("var", name).load()`` gives a row for each index of the variable's
first dimension: ``path, var, idx, shape, value``, its cells as an array of doubles, fill values and NaN as null. A file that can't be
read is tried ``trials`` times (5), ``backoff`` seconds (3) times the number of trials apart, and then fails the job; with ``mode``
``failfast`` at once.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.model import LOCAL_ELEMENTS
from weftline.sources.handling import HandlingError, tried

#: Type codes of the format: numpy type and size.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


class Header:
    """Dimensions, attributes and variables of a file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2):
                raise ValueError(f"{path} is no classic CDF file")
            self._f, self._wide = f, magic[3] == 2
            self.records = self._int()
            self.dimensions = [(self._name(), self._int()) for _ in range(self._list(_DIMENSIONS))]
            self.attributes = self._attributes()
            self.variables = {}
            for _ in range(self._list(_VARIABLES)):
                name = self._name()
                dims = [self._int() for _ in range(self._int())]
                attributes, kind, size = self._attributes(), self._int(), self._int()
                begin = struct.unpack(">q", f.read(8))[0] if self._wide else self._int()
                self.variables[name] = {"dims": dims, "attributes": attributes, "type": kind, "size": size, "begin": begin}
            del self._f
        record = [v for v in self.variables.values() if v["dims"] and self.dimensions[v["dims"][0]][1] == 0]
        one = len(record) == 1
        self.stride = sum(self._row(v) if one else -(-self._row(v) // 4) * 4 for v in record)

    def _row(self, v: dict) -> int:
        return int(np.prod([self.dimensions[d][1] for d in v["dims"][1:]], dtype=np.int64)) * np.dtype(TYPES[v["type"]]).itemsize

    def _int(self) -> int:
        return struct.unpack(">i", self._f.read(4))[0]

    def _name(self) -> str:
        size = self._int()
        return self._f.read(-(-size // 4) * 4)[:size].decode()

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if found not in (0, tag):
            raise ValueError(f"{self.path}: damaged header")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(_ATTRIBUTES)):
            name, kind, n = self._name(), self._int(), self._int()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = self._f.read(-(-size // 4) * 4)[:size]
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out

    def shape(self, var: str) -> list[int]:
        return [self.dimensions[d][1] or self.records for d in self.variables[var]["dims"]]

    def rows(self, var: str, start: int, stop: int) -> np.ndarray:
        """Rows of the first dimension as doubles, missing values as NaN."""
        v, kind = self.variables[var], np.dtype(TYPES[self.variables[var]["type"]])
        row, is_record = self._row(v), bool(v["dims"]) and self.dimensions[v["dims"][0]][1] == 0
        with open(self.path, "rb") as f:
            if is_record:
                raw = b"".join(f.read(row) for k in range(start, stop) if f.seek(v["begin"] + k * self.stride) >= 0)
            else:
                f.seek(v["begin"] + start * row)
                raw = f.read((stop - start) * row)
        cells = np.frombuffer(raw, kind).reshape(stop - start, -1).astype(float) if kind.kind != "S" else np.full((stop - start, 1), np.nan)
        for name in ("_FillValue", "missing_value"):
            for fill in v["attributes"].get(name, []) if not isinstance(v["attributes"].get(name, []), str) else []:
                cells[cells == float(np.array(fill, kind.newbyteorder("=")))] = np.nan
        cells[~np.isfinite(cells)] = np.nan
        return cells


def write(path: str, dimensions: dict[str, int | None], variables: dict[str, tuple[list[str], np.ndarray, dict]], attributes: dict | None = None, record_count: int = 0) -> None:
    """Write a file; a dimension of length None is the record dimension. Variables: (dimensions, doubles, attributes)."""
    names = list(dimensions)

    def text(x: str) -> bytes:
        raw = x.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attrs(values: dict | None) -> bytes:
        if not values:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", _ATTRIBUTES, len(values))
        for k, v in values.items():
            raw = v.encode() if isinstance(v, str) else np.atleast_1d(np.asarray(v, ">f8")).tobytes()
            out += text(k) + struct.pack(">ii", 2 if isinstance(v, str) else 6, len(raw) if isinstance(v, str) else len(raw) // 8) + raw + b"\0" * (-len(raw) % 4)
        return out

    def head(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", record_count)
        out += struct.pack(">ii", _DIMENSIONS, len(names)) if names else struct.pack(">ii", 0, 0)
        out += b"".join(text(k) + struct.pack(">i", dimensions[k] or 0) for k in names) + attrs(attributes)
        out += struct.pack(">ii", _VARIABLES, len(variables)) if variables else struct.pack(">ii", 0, 0)
        for name, (dims, _, own) in variables.items():
            row = 8 * int(np.prod([dimensions[d] or 1 for d in dims], dtype=np.int64))
            out += text(name) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", names.index(d)) for d in dims) + attrs(own) + struct.pack(">iiq", 6, row, begins[name])
        return out

    is_record = {n: bool(v[0]) and dimensions[v[0][0]] is None for n, v in variables.items()}
    at, begins = len(head(dict.fromkeys(variables, 0))), {}
    for n in sorted(variables, key=lambda n: is_record[n]):
        begins[n] = at
        at += 8 * int(np.prod([dimensions[d] or 1 for d in variables[n][0]], dtype=np.int64))
    with open(path, "wb") as f:
        f.write(head(begins))
        for n, (_, data, _) in variables.items():
            if not is_record[n]:
                f.write(np.asarray(data, ">f8").tobytes())
        for k in range(record_count):
            for n, (_, data, _) in variables.items():
                if is_record[n]:
                    f.write(np.asarray(data[k], ">f8").tobytes())


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Files are only listed here; headers are read in the tasks, ``filespertask`` files each."""

    def __init__(self, options: dict):
        self.path, self.var = options["path"], options["var"]
        self.limit = int(options.get("maxelements", LOCAL_ELEMENTS // 64))
        self.files = int(options.get("filespertask", 1))
        self.trials = 1 if options.get("mode", "retry").lower() == "failfast" else int(options.get("trials", 5))
        self.backoff = float(options.get("backoff", 3.0))

    def partitions(self) -> list[_Files]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.endswith(".nc"))
        return [_Files(files[i : i + self.files]) for i in range(0, len(files), self.files)]

    def _tried(self, function, path: str):
        result, _, error = tried(function, path, self.trials, self.backoff)
        if error:
            raise HandlingError(f"{path}: {error}")
        return result

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        """Runs of rows below the request limit, of every file that has the variable, as Arrow batches."""
        for path in part.paths:
            header = self._tried(Header, path)
            if self.var not in header.variables:
                continue
            shape = header.shape(self.var) or [1]
            width = int(np.prod(shape[1:], dtype=np.int64))
            step = max(1, self.limit // max(1, width))
            for start in range(0, shape[0], step):
                n = min(start + step, shape[0]) - start
                cells = self._tried(lambda _, a=start, b=start + n: header.rows(self.var, a, b), path)
                flat = cells.ravel()
                offsets = pa.array(np.arange(0, len(flat) + 1, cells.shape[1], dtype=np.int32))
                values = pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))
                rows = [pa.array([path] * n), pa.array([self.var] * n), pa.array(np.arange(start, start + n)), pa.array([shape[1:]] * n, pa.list_(pa.int32())), values]
                yield pa.RecordBatch.from_arrays(rows, names=["path", "var", "idx", "shape", "value"])


class CdfDataSource(DataSource):
    """Register with ``spark.dataSource.register(CdfDataSource)``."""

    @classmethod
    def name(cls) -> str:
        return "cdf"

    def schema(self) -> str:
        return "path string, var string, idx bigint, shape array<int>, value array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
