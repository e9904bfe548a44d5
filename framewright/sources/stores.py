"""Files of a store as tasks reach them: Spark's file system finds and resolves paths, pyarrow reads and writes ranges."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Names that Spark's file systems give to stores that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its scheme, through mount tables and default stores, as any task can open it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(p):
        return system.resolvePath(p).toString()
    parent = p.getParent()
    return p.makeQualified(system.getUri(), system.getWorkingDirectory()).toString() if parent is None else f"{resolved(spark, parent.toString()).rstrip('/')}/{p.getName()}"


def found(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of every file that the paths or patterns name, in the order of their names; a folder stands for its files.

    Spark's file system matches the patterns, and its answer crosses to Python as one text; each folder is resolved once, and its
    sizes come from one listing."""
    jvm, out, listed = spark._jvm, {}, {}
    for pattern in [path] if isinstance(path, str) else path:
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        matches = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if not matches:
            raise FileNotFoundError(pattern)
        job = jvm.org.apache.hadoop.mapred.JobConf(spark._jsc.hadoopConfiguration())
        jvm.org.apache.hadoop.mapred.FileInputFormat.setInputPaths(job, jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(matches))  # commas and backslashes escaped
        for name in re.findall(r"(?:[^\\,]|\\.)+", job.getRaw("mapreduce.input.fileinputformat.inputdir"), re.DOTALL):
            name = re.sub(r"\\(.)", r"\1", name, flags=re.DOTALL)
            folder, _, own = name.rpartition("/")
            if folder not in listed:
                try:
                    listed[folder] = listing(resolved(spark, folder + "/"))
                except (OSError, ValueError, NotImplementedError):  # a folder of a mount table, which pyarrow doesn't know
                    listed[folder] = {}
            uri, size = listed[folder].get(own, (None, None))
            if size is not None:
                out[uri] = size
            else:
                out |= {u: n for own, (u, n) in listing(resolved(spark, name)).items() if n is not None and own[0] not in "._"}
    return sorted(out.items())


def listing(uri: str) -> dict[str, tuple[str, int | None]]:
    """name: (path, bytes) of what a resolved folder holds, without bytes for folders; of a file, the file itself."""
    from pyarrow import fs

    system, path = opened(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        return {uri.rpartition("/")[2]: (uri, system.get_file_info(path).size)}
    return {i.base_name: (f"{uri.rstrip('/')}/{i.base_name}", i.size if i.type == fs.FileType.File else None) for i in system.get_file_info(fs.FileSelector(path))}


def opened(uri: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + ":" + rest)
