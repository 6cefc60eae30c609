"""One exception class per error of the array API."""


class ChunkframeError(Exception):
    """Base of all errors; ``identifier`` is the short name that users match on."""

    @property
    def identifier(self) -> str:
        return type(self).__name__


class NodeNotFound(ChunkframeError): ...
class NodeExists(ChunkframeError): ...
class Indexing(ChunkframeError, IndexError): ...
class ShapeMismatch(ChunkframeError, ValueError): ...
class InvalidChunkShape(ChunkframeError, ValueError): ...
class InvalidCodecs(ChunkframeError, ValueError): ...
class InvalidMetadata(ChunkframeError, ValueError): ...
class InvalidFillValue(ChunkframeError, ValueError): ...
class InvalidPath(ChunkframeError, ValueError): ...
class InvalidStore(ChunkframeError, ValueError): ...
class UnsupportedFeature(ChunkframeError): ...
class UnsupportedDataType(ChunkframeError, TypeError): ...
class UnsupportedCodec(ChunkframeError): ...
class UnsupportedValue(ChunkframeError, ValueError): ...
class CellValueError(ChunkframeError, ValueError):
    identifier = "ValueError"
class TypeMismatch(ChunkframeError, TypeError): ...
class CodecError(ChunkframeError): ...
class ChecksumError(CodecError): ...
class MissingCodecLibrary(ChunkframeError, ImportError): ...
class StoreError(ChunkframeError, OSError): ...
class InternalError(ChunkframeError): ...


class ShapeFlattened(UserWarning):
    """A value with several long dimensions was flattened into a rank-1 array."""
