"""Image metadata as a data source: spark.read.format("codestream_meta").load(path)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources import codestream


class CodestreamMeta(DataSource):
    """One row of metadata per file. Paths are opened by Arrow's file systems; for other stores use read_files and read_metadata."""

    @classmethod
    def name(cls) -> str:
        return "codestream_meta"

    def schema(self) -> str:
        return f"path string, {codestream.META}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options.get("filesPerTask", 64))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(root)
        files = [root] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)
        return [InputPartition(files[i : i + self.batch]) for i in range(0, len(files), self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for path in partition.value:
            with system.open_input_file(path) as f:
                yield (path, *codestream.metadata(f.read()))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
