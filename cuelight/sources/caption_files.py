"""Caption files, one a clip, written in two phases.

Tasks write their files into a folder of the attempt, under ``_staging``; when all
are done the driver moves those of the attempts that count, and nothing of an
attempt that failed or was made twice is left. A clip without anything to draw
has no file. File systems are those that Arrow reaches by URI, or local paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"
#: Moves at a time.
MOVES = 32


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str = ""
    names: list[str] = field(default_factory=list)


class CaptionWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = _at(self.path)
        done = Written(f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}")
        store.create_dir(done.folder, recursive=True)
        for name, text in iterator:
            if text is None:
                continue
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"{name!r} can't be the name of a file")
            with store.open_output_stream(f"{done.folder}/{name}.ass") as f:
                f.write(text.encode("utf-8"))
            done.names.append(f"{name}.ass")
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _at(self.path)
        moves = [(f"{m.folder}/{n}", f"{root}/{n}") for m in messages if m for n in m.names]
        seen = [to for _, to in moves]
        if len(set(seen)) < len(seen):
            self.abort(messages)
            raise ValueError("two clips have one name")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _at(self.path)
        if store.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")


class CaptionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "caption_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> CaptionWriter:
        return CaptionWriter(self.options["path"])


def write_captions(captions: DataFrame, path: str) -> None:
    """``captions(name, text)`` as files ``<name>.ass`` in the folder ``path``; rows with a null text have none, known names are replaced."""
    captions.sparkSession.dataSource.register(CaptionFiles)
    captions.select("name", "text").write.format("caption_files").option("path", path).mode("append").save()
