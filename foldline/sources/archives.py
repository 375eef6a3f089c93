"""Tar archives as tables: an index of members, their contents by ranges of members, and structure files in them.

An archive's headers are read by one task, which skips the contents; the contents of a plain archive are then read by many
tasks at the members' places. A compressed archive has no such places and is one task's stream, in batches of bounded bytes.
"""

from __future__ import annotations

import io
import re
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions.hierarchy import sid_of_path
from foldline.sources.opened import opened, place
from foldline.sources.readers import looks_like_domain

#: Bytes of members that a task is given, and of contents in one batch.
RANGE, BATCH = 128 << 20, 16 << 20
#: Archives whose names end so are streams.
COMPRESSED = r"(?i)\.(gz|tgz|bz2|xz)$"

_INDEX = "archive string, member string, kind string, start long, size long"
_MEMBERS = "archive string, member string, size long, content binary"


def leaves_folder(member: str | Column) -> Column:
    """Whether a member's path would land outside the folder that the archive is unpacked in."""
    name = F.col(member) if isinstance(member, str) else member
    step = lambda part: F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walked = F.aggregate(F.split(name, "/"), start, lambda s, p: F.struct((s.depth + step(p)).alias("depth"), F.least(s.least, s.depth + step(p)).alias("least")))
    return name.startswith("/") | (walked.least < 0)


def _safe(rows: DataFrame) -> DataFrame:
    """rows, whose reading fails at a member that is neither a file nor a folder or that leaves the folder."""
    odd = ~F.col("kind").isin("file", "folder")
    return rows.where(F.when(odd | leaves_folder("member"), F.raise_error(F.concat("archive", F.lit(": "), "member", F.lit(" leaves its folder or is a link or device"))).cast("boolean")).otherwise(F.lit(True)))


def _kind(m: tarfile.TarInfo) -> str:
    return "file" if m.isreg() else "folder" if m.isdir() else "other"


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, length of every archive at path: a file, a folder or a pattern. Contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tar,tar.gz,tgz,tar.bz2,tar.xz}").load(path).select(F.col("path").alias("archive"), "length")


def index(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, kind (file, folder, other), start, size: the archives' headers; start is the content's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with opened(archive) as f, tarfile.open(fileobj=f, mode="r:*") as tar:
                    rows = []
                    while (m := tar.next()) is not None:
                        tar.members.clear()  # it would keep every header
                        rows.append((archive, m.name, _kind(m), m.offset_data, m.size))
                        if len(rows) == 10_000:
                            yield _batch(rows, ("archive", "member", "kind", "start", "size"))
                            rows = []
                    if rows:
                        yield _batch(rows, ("archive", "member", "kind", "start", "size"))

    return _archives(spark, path).mapInArrow(run, _INDEX)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    types = {"start": pa.int64(), "size": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows))], list(names))


def _bounded(rows: Iterator[tuple], names: tuple[str, ...], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose column at place size sums to no more than BATCH, or that hold one row."""
    held, total = [], 0
    for r in rows:
        if held and total + r[size] > BATCH:
            yield _batch(held, names)
            held, total = [], 0
        held.append(r)
        total += r[size]
    if held:
        yield _batch(held, names)


def _at_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of members by archive, member, start, size; an archive stays open over its members in a row."""

    def rows() -> Iterator[tuple]:
        last, f = None, None
        for batch in batches:
            for archive, member, start, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if archive != last:
                    if f is not None:
                        f.close()
                    last, f = archive, opened(archive)
                f.seek(start)
                if len(content := f.read(size)) != size:
                    raise ValueError(f"{archive} ends within {member}")
                yield archive, member, size, content
        if f is not None:
            f.close()

    yield from _bounded(rows(), ("archive", "member", "size", "content"), 2)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of whole archives, one after the other."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with opened(archive) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    while (m := tar.next()) is not None:
                        tar.members.clear()
                        yield archive, m.name, _kind(m), m.size, tar.extractfile(m).read() if m.isreg() else None

    yield from _bounded(rows(), ("archive", "member", "kind", "size", "content"), 3)


def members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, size, content of every regular file in the archives at path.

    A member that would leave the folder it is unpacked in, a link or a device is an error when the rows are read. Members of one
    name in an archive are all returned. A folder without archives, or an archive without members, gives no rows. A member is one
    value and so below 2 GiB.
    """
    found = _archives(spark, path)
    streams = found.where(F.col("archive").rlike(COMPRESSED)).mapInArrow(_streamed, "archive string, member string, kind string, size long, content binary")
    ranges = max(1, -(-(found.where(~F.col("archive").rlike(COMPRESSED)).agg(F.sum("length")).first()[0] or 0) // RANGE))
    places = _safe(index(spark, path).where(~F.col("archive").rlike(COMPRESSED))).where("kind = 'file'").select("archive", "member", "start", "size")
    placed = places.repartitionByRange(ranges, "archive", "start").sortWithinPartitions("archive", "start").mapInArrow(_at_places, _MEMBERS)
    return placed.unionByName(_safe(streams).where("kind = 'file'").drop("kind"))


def structures(spark: SparkSession, path: str) -> DataFrame:
    """sid, path, content, length of the archives' members that look like structure files, as readers.structure_files gives them.

    An id twice, or no such file at all, is an error; for that the archives' headers are read once more.
    """
    names = _safe(index(spark, path)).where(F.col("kind") == "file").where(looks_like_domain("member")).groupBy(sid_of_path("member").alias("sid")).count()
    facts = names.agg(F.count("*").alias("n"), F.count_if(F.col("count") > 1).alias("twice")).first()
    if facts["twice"]:
        raise ValueError(f"more than one file for {', '.join(r['sid'] for r in names.where('count > 1').orderBy('sid').limit(10).collect())}")
    if not facts["n"]:
        raise ValueError(f"no structure files in the archives at {path}")
    return members(spark, path).where(looks_like_domain("member")).select(sid_of_path("member").alias("sid"), F.concat("archive", F.lit("!"), "member").alias("path"), "content", F.col("size").alias("length"))


def write_archives(rows: DataFrame, folder: str, compressed: bool = False) -> int:
    """Writes member (path) and content (binary) of rows to one archive in folder for each partition; returns the number of members.

    A task writes under a name of its own and renames at its end, so one that runs again replaces its archive. Null contents are empty
    files; a null member is an error. An empty partition writes no archive.
    """
    system, root = place(folder)
    system.create_dir(root, recursive=True)
    ending = ".tar.gz" if compressed else ".tar"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        part = f"{root}/.{uuid.uuid4().hex}"
        n, tar, out = 0, None, None
        for batch in batches:
            for member, content in zip(batch.column(0), batch.column(1)):
                if tar is None:
                    out = system.open_output_stream(part, compression=None)
                    tar = tarfile.open(fileobj=out, mode="w|gz" if compressed else "w|")
                content = content.as_py() or b""
                head = tarfile.TarInfo(re.sub(r"^\./", "", member.as_py()))
                head.size = len(content)
                tar.addfile(head, io.BytesIO(content))
                tar.members.clear()
                n += 1
        if tar is not None:
            tar.close()
            out.close()
            system.move(part, f"{root}/part-{TaskContext.get().partitionId():06d}{ending}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    made = rows.select(F.col("member").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
