"""Files read by ranges from tasks: whatever file system Arrow knows by its scheme, local paths included."""

from __future__ import annotations

from typing import NamedTuple

from pyarrow import ArrowInvalid, NativeFile, fs
from pyspark.sql import SparkSession

#: Bytes that a partition of a file covers, unless an option says otherwise.
PART_BYTES = 32 << 20


class Place(NamedTuple):
    """A file: the folder or file it was found by, whose scheme names the file system, and its path there."""

    root: str
    path: str
    size: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


def known(path: str) -> bool:
    """Whether tasks can read ``path`` by ranges; other schemes are left to Spark's own readers."""
    try:
        fs.FileSystem.from_uri(path)
    except ArrowInvalid:
        return False
    return True


def files(path: str, suffix: str = "") -> list[Place]:
    """The files of a folder whose names end so, by path; or the one file.  Hidden files are passed over."""
    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [Place(path, inner, info.size)]
    found = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.endswith(suffix) and i.base_name[0] not in "._"]
    return [Place(path, i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


def reading(place: Place) -> NativeFile:
    return fs.FileSystem.from_uri(place.root)[0].open_input_file(place.path)


def writing(root: str, name: str) -> tuple[NativeFile, str]:
    """A new file in a folder, which is made if need be, and its path."""
    system, inner = fs.FileSystem.from_uri(root)
    system.create_dir(inner, recursive=True)
    path = f"{inner.rstrip('/')}/{name}"
    return system.open_output_stream(path), path


def remove(root: str, path: str) -> None:
    system, _ = fs.FileSystem.from_uri(root)
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)


def register(spark: SparkSession) -> None:
    """Makes the sources of this package known to a session, and lets filters reach them unless the session says otherwise."""
    from tessera.sources import array_files, bigwig, motif_files, sequences

    for source in (array_files.ArrayFiles, array_files.ArraySizes, bigwig.BigWig, motif_files.MotifFiles, sequences.FastaPieces):
        spark.dataSource.register(source)
    key = "spark.sql.python.filterPushdown.enabled"
    if spark.conf.get(key, "false") == "false" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, "true")
