"""chunkframe: chunked N-dimensional array stores as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers can't import a package that the driver reaches through sys.path
# alone, so its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .catalog import Group, consolidate_metadata, create, create_group, delete_node, open  # noqa: A004, E402
from .operators.array import Array  # noqa: E402
from .sources.cells import install  # noqa: E402
from .stores import ArrowStore, HttpStore, LocalStore, ManifestStore, MemoryStore, Store, ZipStore  # noqa: E402

__all__ = ["Array", "ArrowStore", "Group", "HttpStore", "LocalStore", "ManifestStore", "MemoryStore", "Store", "ZipStore", "consolidate_metadata", "create", "create_group", "delete_node", "install", "open"]
