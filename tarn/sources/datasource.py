"""spark.read.format("tarn") and df.write.format("tarn"): a facade over the same tables, as a Python data source.

Reads through it go through Arrow, file by file; Table.scan() uses Spark's own Parquet reader and is faster.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import Unsupported
from ..operators.append import PLAIN, arrow_schema, statistics
from .storage import data_path, open_uri


@dataclass
class FilePart(InputPartition):
    path: str


class TableReader(DataSourceReader):
    def __init__(self, files: list[str], schema: bytes):
        self.files, self.table_schema = files, schema

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p) for p in self.files]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        schema = pickle.loads(self.table_schema)
        fs, path = open_uri(partition.path)
        source = pq.ParquetFile(path, filesystem=fs)
        by_id = {(f.metadata or {}).get(b"PARQUET:field_id"): i for i, f in enumerate(source.schema_arrow)}
        by_name = {f.name: i for i, f in enumerate(source.schema_arrow)} if set(by_id) <= {None} else {}
        for batch in source.iter_batches(8192):
            columns = []
            for f in arrow_schema(schema):
                i = by_name.get(f.name) if by_name else by_id.get(f.metadata[b"PARQUET:field_id"])
                columns.append(pa.nulls(batch.num_rows, f.type) if i is None else batch.column(i).cast(f.type))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple]


class TableWriter(DataSourceArrowWriter):
    def __init__(self, url: str, location: str, schema: bytes, overwrite: bool):
        self.url, self.location, self.table_schema, self.overwrite = url, location, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        schema = pickle.loads(self.table_schema)
        target = arrow_schema(schema)
        name = f"{uuid.uuid4()}.parquet"
        uri, out = f"{self.location}/{data_path(name, '')}", None
        fs, path = open_uri(uri)
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = pq.ParquetWriter(path, target, filesystem=fs, **PLAIN)
                out.write_batch(pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in target], schema=target))
        if out is None:
            return Written([])
        out.close()
        meta = pq.read_metadata(path, filesystem=fs)
        return Written([(uri, meta.num_rows, fs.get_file_info(path).size, statistics(meta, schema))])

    def commit(self, messages: list[Written | None]) -> None:
        from ..model.manifests import DataFile
        files = [
            DataFile(u, n, size, column_sizes=s["sizes"], value_counts=s["counts"], null_value_counts=s["nulls"], lower_bounds=s["low"], upper_bounds=s["high"])
            for m in messages if m for u, n, size, s in m.files
        ]
        table = _local_table(self.url)
        tx = table.new_transaction()
        (tx.overwrite_files(add=files, delete_all=True) if self.overwrite else tx.append_files(files)).commit()

    def abort(self, messages: list[Written | None]) -> None:
        """Files that were written stay, as nothing refers to them."""


class TarnDataSource(DataSource):
    """Option path: the table's location. Writing needs an existing, unpartitioned table."""

    @classmethod
    def name(cls) -> str:
        return "tarn"

    def schema(self) -> StructType:
        return _local_table(self.options["path"]).current_schema().to_spark()

    def reader(self, schema: StructType) -> DataSourceReader:
        table = _local_table(self.options["path"])
        if table.live_deletes():
            raise Unsupported("tables with delete files are read with Table.scan()")
        if odd := {f.file_format for f, _ in table.live_files()} - {"PARQUET", "parquet"}:
            raise Unsupported(f"files of these formats are read with Table.scan(): {sorted(odd)}")
        return TableReader([f.file_path for f, _ in table.live_files()], pickle.dumps(table.current_schema()))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        table = _local_table(self.options["path"])
        if not table.current_partition_spec().is_empty():
            raise Unsupported("partitioned tables are written with Table.append()")
        return TableWriter(self.options["path"], table.location, pickle.dumps(table.current_schema()), overwrite)


def _local_table(url: str):
    """The table, loaded in a planning process without a session; local locations only."""
    from .table import Table

    table = Table(None, url)
    table.refresh()
    return table


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarnDataSource)
