"""Contents in the shared store, written by the tasks that read them, and chained hashes of files of any length.

Contents do not move between tasks: a task puts them under their digest, and digests alone are shuffled; of
long files each task reads ranges and gives their digests, which are chained in order for each file. Files are
listed and read by tasks: Spark's own reader of whole files keeps all names in the driver.

Defined results: a null content is not stored; an empty one is a file of no bytes, whose chained hash is '';
contents that repeat, tasks that run twice and digests that are there already leave one file and do not touch
it; no contents give no digests; a folder without files gives no hashes; other columns are not carried along.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.sources.scratch import written

#: Bytes of a link of the chain; one is held in memory at a time.
CHUNK = 4 << 20
#: Links that a task reads, on average.
LINKS = 64
#: Bytes of whole files that a task reads, on average, and holds at once, with the last of them.
READ, HELD = 64 << 20, 8 << 20


def located(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    scheme, host, rest = re.fullmatch(r"(?:([a-zA-Z0-9+.-]+):)?(?://([^/]*))?(/.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), rest
    system, root = fs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
    return system, root.rstrip("/") + rest


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modified (microseconds) of the files below a folder, empty ones too; each of its folders is listed by a task.

    Names that start with a dot or an underscore are hidden, and so is what is below such a folder.
    """
    from pyarrow import fs

    path = path.rstrip("/")
    system, root = located(path)
    below = [i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name[0] not in "._"]
    folders = spark.createDataFrame([("", False), *[(f"/{name}", True) for name in below]], "folder string, deep boolean")

    def found(batches: Iterator):
        import pyarrow as pa

        system, root = located(path)
        for batch in batches:
            for folder, deep in zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist(), strict=True):
                infos = system.get_file_info(fs.FileSelector(root + folder, allow_not_found=True, recursive=deep))
                shown = [i for i in infos if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, glob) and not re.search("/[._]", i.path[len(root) :])]
                names = pa.array([path + i.path[len(root) :] for i in shown], pa.string())
                sizes, times = (pa.array(x, pa.int64()) for x in ([i.size for i in shown], [(i.mtime_ns or 0) // 1000 for i in shown]))
                yield pa.RecordBatch.from_arrays([names, sizes, times], ["path", "length", "modified"])

    return folders.repartition(min(len(below) + 1, 256)).mapInArrow(found, "path string, length long, modified long")


def put_contents(contents: DataFrame, path: str) -> DataFrame:
    """hash, size of the distinct contents(content), all of which are files `path`/<two digits>/<hash> once it is computed.

    A new file gets its name when it is whole. Write or count the result once; it is cheap to read, not to compute.
    """
    from pyarrow import fs

    def put(batches: Iterator):
        system, root = located(path)
        for batch in batches:
            for digest, content in zip(batch.column("hash").to_pylist(), batch.column("content"), strict=True):
                folder = f"{root}/{digest[:2]}"
                if system.get_file_info(f"{folder}/{digest}").type != fs.FileType.File:
                    system.create_dir(folder, recursive=True)
                    part = f"{folder}/.{digest}-{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(content.as_buffer())
                    try:
                        system.move(part, f"{folder}/{digest}")
                    except OSError:  # another task was first, where names are not replaced
                        if system.get_file_info(f"{folder}/{digest}").type != fs.FileType.File:
                            raise
                        system.delete_file(part)
            yield batch.select(["hash", "size"])

    rows = contents.filter("content IS NOT NULL").select(F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"), "content")
    return rows.mapInArrow(put, "hash string, size long").groupBy("hash").agg(F.max("size").alias("size"))


def read_contents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files below a folder, empty ones too.

    Names are listed by tasks into a table, dealt out and read by tasks; the driver knows their number and bytes alone.
    """
    import pyarrow as pa

    files = written(list_files(spark, path, glob), "listing")
    total = files.agg(F.sum("length")).first()[0] or 0

    def read(batches: Iterator):
        names = ["path", "modified", "length", "content"]
        for batch in batches:
            rows, held = [], 0
            for name, modified, length in zip(*(batch.column(c).to_pylist() for c in names[:3]), strict=True):
                system, at = located(name)
                with system.open_input_file(at) as stream:
                    rows.append((name, modified, length, stream.read()))
                held += length
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    dealt = files.repartition(max(spark.sparkContext.defaultParallelism, total // READ))
    whole = dealt.mapInArrow(read, "path string, modified long, length long, content binary")
    return whole.select("path", F.timestamp_micros("modified").alias("modificationTime"), "length", "content")


def chained_files(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """path, length, chained of every file below a folder: the chained hash of its links of `chunk` bytes."""
    import pyarrow as pa

    files = list_files(spark, path, glob).select("path", "length")

    def digests(batches: Iterator):
        for batch in batches:
            found, last, stream = [], None, None
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                if name != last:
                    if stream:
                        stream.close()
                    system, at = located(name)
                    last, stream = name, system.open_input_file(at)
                stream.seek(start)
                found.append(hashlib.sha256(stream.read(chunk)).digest())
            if stream:
                stream.close()
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(found, pa.binary())], ["path", "start", "digest"])

    links = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start"))
    # neighbouring links of a file go to one task, a long file to many
    dealt = links.withColumn("deal", F.expr(f"start div {chunk * LINKS}")).repartition("path", "deal").sortWithinPartitions("path", "start").select("path", "start")
    each = dealt.mapInArrow(digests, "path string, start long, digest binary")
    chain = F.aggregate(F.sort_array(F.collect_list(F.struct("start", "digest"))), F.lit(b""), lambda h, x: F.unhex(F.sha2(F.concat(h, x["digest"]), 256)))
    whole = each.groupBy("path").agg(F.lower(F.hex(chain)).alias("chained"))
    return files.join(whole, "path", "left").select("path", "length", F.coalesce("chained", F.lit("")).alias("chained"))
