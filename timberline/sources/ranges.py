"""Files read by byte ranges inside data sources, and what their readers share."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

import pyarrow.fs as pafs
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a file that one task reads, about.
SPLIT = 64 << 20
#: The session's setting that lets Spark hand filters to a source; a source that takes them fails without it.
PUSH = "spark.sql.python.filterPushdown.enabled"
Box = tuple[float, float, float, float]


class Ranges:
    """A file on any filesystem that Arrow knows; ``taken`` counts the bytes that were asked of it."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.path, self.taken, self._file = path, 0, fs.open_input_file(inner)

    def read(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        out = self._file.read(length)
        self.taken += len(out)
        return out

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()


class Part(InputPartition):
    """Part ``k`` of ``n`` of a file, as bytes from ``start`` to before ``stop``."""

    def __init__(self, path: str, start: int, stop: int, k: int, n: int):
        self.path, self.start, self.stop, self.k, self.n = path, start, stop, k, n


def listed(paths: list[str], endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files with their sizes: those named, and those with one of the endings in the folders named."""
    out = []
    for path in paths:
        fs, inner = pafs.FileSystem.from_uri(path)
        info = fs.get_file_info(inner)
        lead = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        if info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
            out += sorted((lead + f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(endings))
        elif info.is_file:
            out.append((path, info.size))
        else:
            raise FileNotFoundError(path)
    return out


def parts(paths: list[str], endings: tuple[str, ...], split: int) -> list[Part]:
    """The files cut into parts of ``split`` bytes at most; nothing is read for it."""
    out = []
    for path, size in listed(paths, endings):
        n = max(1, -(-size // split))
        out += [Part(path, k * split, min(size, (k + 1) * split) if k + 1 < n else size, k, n) for k in range(n)]
    return out


def options(given: dict) -> tuple[list[str], int, Box | None]:
    """Paths, bytes of a part and rectangle of a source's options."""
    paths = json.loads(given["paths"]) if "paths" in given else [given["path"]] if "path" in given else []
    if not paths or not all(paths):
        raise ValueError("at least one path is needed, and none may be empty")
    box = tuple(float(v) for v in given["box"].split(",")) if given.get("box") else None
    return paths, int(given.get("split", SPLIT)), box


def narrowed(box: Box | None, filters: Iterable[Filter]) -> Box | None:
    """The rectangle that ranges on ``x`` and ``y`` leave of a rectangle."""
    low, high = ([-math.inf, -math.inf], [math.inf, math.inf]) if box is None else (list(box[:2]), list(box[2:]))
    for f in filters:
        axis = {("x",): 0, ("y",): 1}.get(getattr(f, "attribute", None))
        if axis is None or not isinstance(getattr(f, "value", None), (int, float)):
            continue
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            low[axis] = max(low[axis], float(f.value))
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            high[axis] = min(high[axis], float(f.value))
    found = (*low, *high)
    return found if any(map(math.isfinite, found)) else None


class Pushed:
    """A reader with a ``box`` that filters may narrow; Spark applies all filters as well."""

    def pushFilters(self, filters):  # noqa: N802
        filters = list(filters)
        self.box = narrowed(self.box, filters)
        yield from filters
