"""Archive source (S6): base64 gzip tar payloads -> member rows, parallel over archives.

Each archive is decoded inside the task that holds its row (``mapInArrow``), member by
member; members that could escape an extraction folder (absolute
paths, ``..`` components, links, devices, FIFOs) are skipped, as a
``filter="data"`` extraction would refuse them.  Nothing is written to disk.
"""

from __future__ import annotations

import base64
import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, small_batches

MEMBER_SCHEMA = "archive_id long, member string, size long, content binary"
REPORT_SCHEMA = MEMBER_SCHEMA + ", status string"
_REPORT = pa.schema([("archive_id", pa.int64()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("status", pa.string())])
OUT_BYTES, OUT_ROWS = 1_000_000, 1_000
OK, EMPTY, BROKEN = "ok", "empty", "broken"
_BROKEN_PAYLOAD = (tarfile.TarError, EOFError, OSError, ValueError, zlib.error)


def _safe(m: tarfile.TarInfo) -> bool:
    name = m.name
    if not m.isfile() and not m.isdir():
        return False  # links, devices, fifos
    if name.startswith("/") or name.startswith("\\"):
        return False
    return ".." not in name.replace("\\", "/").split("/")


class _Out:
    """Rows (archive_id, member, size, content, status) that leave the task in batches of about OUT_BYTES of content."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, aid, member: str | None, data: bytes | None, status: str) -> bool:
        """Whether the batch is full."""
        self.rows.append((aid, member, None if data is None else len(data), data, status))
        self.bytes += len(data or b"")
        return self.bytes >= OUT_BYTES or len(self.rows) >= OUT_ROWS

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), _REPORT)]
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, schema=_REPORT)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task holds one archive and some members, OUT_BYTES of them and one more at most, at a time."""
    out = _Out()
    for rows in batches:
        for aid, payload in zip(rows.column(0), rows.column(1)):
            aid = aid.as_py()
            if not payload.is_valid:
                if out.add(aid, None, None, EMPTY):
                    yield out.batch()
                continue
            try:
                # "r|gz" walks the stream once and keeps no list of contents
                with tarfile.open(fileobj=io.BytesIO(base64.b64decode(payload.as_py())), mode="r|gz") as tar:
                    for m in tar:
                        if _safe(m) and not m.isdir() and out.add(aid, m.name, tar.extractfile(m).read(), OK):
                            yield out.batch()
                        tar.members = []
            except _BROKEN_PAYLOAD:
                if out.add(aid, None, None, BROKEN):
                    yield out.batch()
    if out.rows:
        yield out.batch()


def archive_report(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(archive_id, member, size, content, status): every safe regular-file member, and one row without a member for each
    payload that is null (``empty``) or cannot be read to its end (``broken``; the members before the fault are kept)."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("archive_id"), F.col(payload_col).alias("payload_b64"))
    return src.mapInArrow(_members, REPORT_SCHEMA)


def archive_members(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(archive_id, member, size, content) for every safe regular-file member of the payloads that can be read."""
    return archive_report(df, id_col, payload_col).where(F.col("status") == OK).drop("status")


def _packed(name: str | None, text: str | None) -> str:
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        data = (text or "").encode("utf-8")
        info = tarfile.TarInfo(name=name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
        # an unsafe member that extraction must skip
        bad = tarfile.TarInfo(name="../outside.txt")
        bad.size = 1
        tar.addfile(bad, io.BytesIO(b"x"))
        link = tarfile.TarInfo(name="link")
        link.type = tarfile.SYMTYPE
        link.linkname = "/etc/passwd"
        tar.addfile(link)
    return base64.b64encode(buf.getvalue()).decode("ascii")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        payloads = [_packed(name.as_py(), text.as_py()) for name, text in zip(rows.column(1), rows.column(2))]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(payloads, pa.string())], ["archive_id", "payload_b64"])


def pack_texts(df: DataFrame, id_col: str, name_col: str, text_col: str) -> DataFrame:
    """Test input for S6: one base64 tar.gz per row holding the text as a member (plus unsafe members)."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("archive_id"), F.col(name_col).alias("name"), F.col(text_col).alias("text"))
    return src.mapInArrow(_pack, "archive_id long, payload_b64 string")
