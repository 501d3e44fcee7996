"""An encoder in a process of its own, so that its crash is not the worker's.

A worker starts one child for all its batches. The child reads a line of JSON,
``{"texts": [...]}``, and answers a line with as many vectors. It is sent 128
texts a call; if it dies in one, another is started and the call is made once more.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of one call.
CALL = 128


class EncoderDied(RuntimeError):
    """The child ended, or answered something else, in two calls of the same texts."""


class Host:
    """The child of a worker, started when it is needed."""

    def __init__(self, command: Sequence[str], dim: int):
        self.command, self.dim, self.child = list(command), dim, None

    def _ask(self, texts: list[str]) -> np.ndarray:
        if self.child is None:
            self.child = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.child.stdin.write(json.dumps({"texts": texts}).encode() + b"\n")
        self.child.stdin.flush()
        answer = self.child.stdout.readline()
        if not answer:
            raise EOFError("no answer")
        vectors = np.asarray(json.loads(answer), np.float32)
        if vectors.shape != (len(texts), self.dim):
            raise ValueError(f"{vectors.shape} for {len(texts)} texts of {self.dim}")
        return vectors

    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of ``texts``, none for none; a vector of no length stays."""
        out = [np.zeros((0, self.dim), np.float32)]
        for k in range(0, len(texts), CALL):
            call = texts[k : k + CALL]
            try:
                found = self._ask(call)
            except (OSError, EOFError, ValueError):
                self.close()
                try:
                    found = self._ask(call)
                except (OSError, EOFError, ValueError) as e:
                    self.close()
                    raise EncoderDied(f"the encoder failed twice in a call: {e}") from e
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            out.append(found / np.where(norm > 0, norm, 1))
        return np.concatenate(out)

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.wait()
            for pipe in (self.child.stdin, self.child.stdout):
                try:
                    pipe.close()
                except OSError:  # what was still to be sent to a dead child
                    pass
            self.child = None


def encoder(command: Sequence[str], dim: int = 384) -> Callable[[Column], Column]:
    """An ``embed`` for searches and indexing by the program ``command``; null texts are empty."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        host = Host(command, dim)
        try:
            for texts in batches:
                yield pd.Series(list(host.encode([t or "" for t in texts])), dtype=object)
        finally:
            host.close()

    return lambda text: embed(text)
