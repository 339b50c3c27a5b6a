"""Errors, one class for each kind of failure that a caller may want to tell apart."""


class TarnError(Exception):
    """Any error of this engine."""


class CustomError(TarnError):
    """Raised by an operation that a caller supplies."""


class Unsupported(TarnError):
    """A feature of the format that is not supported."""


class MetadataNotFound(TarnError):
    """No table at the location."""


class InvalidTableLocation(TarnError):
    """A location that no storage serves."""


class TableAlreadyExists(TarnError):
    """A table was to be created where there is one."""


class TableNotInitialized(TarnError):
    """A table without metadata was asked for some."""


class SchemaError(TarnError):
    """A schema, or a change of one, breaks a rule."""


class BadValue(TarnError):
    """A value does not fit its type."""


class ManifestError(TarnError):
    """A manifest or manifest list can't be read or written."""


class PartitionError(TarnError):
    """A partition spec or tuple breaks a rule."""


class InvalidMetadata(TarnError):
    """A metadata file is not what it should be."""


class SerializeMetadataJson(TarnError):
    """Table metadata can't be written as JSON."""


class SerializeSchemaJson(TarnError):
    """A schema can't be written as JSON."""


class SerializeJson(TarnError):
    """A value can't be written as JSON."""


class AvroError(TarnError):
    """An Avro file can't be read or written."""


class InvalidPath(TarnError):
    """A path outside the table's location."""


class ObjectStore(TarnError):
    """The storage failed."""


class ParquetError(TarnError):
    """A data file can't be read or written."""


class IoError(TarnError):
    """Input or output failed."""


class ArrowError(TarnError):
    """Rows don't fit the table's schema."""


class CommitConflict(TarnError):
    """Other commits came first, as often as the table's properties allow retries."""
