"""Arrays in files of a folder that all executors see, memory-mapped where they are read."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from . import blobs
from .elias_fano import Monotone

#: Maps that a worker keeps open for one model.
OPEN = 1024


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder below the one that the session names for checkpoints, which every executor must have mounted.

    It goes when the driver's process ends.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        blobs.cut(df.limit(0))
    url = urlparse(context.getCheckpointDir())
    if url.scheme not in ("", "file"):
        raise ValueError(f"a memory-mapped model needs a mounted folder; spark.checkpoint.dir is {url.scheme}://")
    path = os.path.join(url.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def press(columns: list[np.ndarray]) -> bytes:
    """Sorted columns, by planes of bytes, compressed."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns)
    return np.int64(len(columns[0])).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpress(blob: bytes, dtypes: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 0, []
    planes = zstandard.ZstdDecompressor().decompress(blob[8:])
    for d in dtypes:
        size = n * np.dtype(d).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, size, at).reshape(-1, n).T).view(d).ravel())
        at += size
    return out


@dataclass
class Stored:
    """A model in a folder: tasks get its path and open what they need."""

    path: str
    held: OrderedDict = field(default_factory=OrderedDict, init=False, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"held": OrderedDict()}

    def remove(self) -> None:
        self.held.clear()
        shutil.rmtree(self.path, ignore_errors=True)

    def file(self, level: int, shard: int) -> str:
        return f"{self.path}/{level}-{shard:06d}"

    def arrays(self, name: str) -> dict[str, np.ndarray | Monotone]:
        """A file's arrays; none if there is no such file."""
        if name not in self.held:
            if len(self.held) >= OPEN:
                self.held.popitem(last=False)
            self.held[name] = load(name) if os.path.exists(name) else {}
        self.held.move_to_end(name)
        return self.held[name]

    @staticmethod
    def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places) of an array of shards."""
        order = np.argsort(shard, kind="stable")
        s = shard[order]
        cuts = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)) if len(s) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(s[a]), order[a:b]


def save(path: str, arrays: dict[str, np.ndarray | Monotone]) -> None:
    """One file: a header of names, types and lengths, and the arrays. It appears whole or not at all."""
    flat: list[tuple[str, np.ndarray]] = []
    for name, a in arrays.items():
        flat += [(f"{name}.{i}", p) for i, p in enumerate(a.parts())] if isinstance(a, Monotone) else [(name, np.asarray(a))]
    head = json.dumps([(n, a.dtype.str, len(a)) for n, a in flat]).encode()
    own = f"{path}.{os.getpid()}.tmp"
    with open(own, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
        for _, a in flat:
            data = np.ascontiguousarray(a).tobytes()
            f.write(data + b"\0" * (-len(data) % 8))
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray | Monotone]:
    """The arrays of a file, memory-mapped."""
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    at = 8 + size + -size % 8
    out: dict = {}
    for name, dtype, n in json.loads(whole[8 : 8 + size].tobytes()):
        bytes_ = n * np.dtype(dtype).itemsize
        a = whole[at : at + bytes_].view(dtype).view(np.ndarray)
        at += bytes_ + -bytes_ % 8
        base, _, i = name.partition(".")
        if i:
            out.setdefault(base, []).append(a)
        else:
            out[name] = a
    return {k: Monotone.from_parts(v) if isinstance(v, list) else v for k, v in out.items()}
