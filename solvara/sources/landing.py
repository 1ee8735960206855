"""Landing files: which dataset a file belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of file names and the dataset that they mean; the first that occurs decides.
ROUTES = {"training": "training", "test": "scoring"}


def dataset_of(file_name: Column) -> Column:
    """The dataset of a file name, null if no route fits; on a scan, use it with ``_metadata.file_name``."""
    name, out = F.lower(file_name), None
    for part, dataset in ROUTES.items():
        out = F.when(name.contains(part), dataset) if out is None else out.when(name.contains(part), dataset)
    return out
