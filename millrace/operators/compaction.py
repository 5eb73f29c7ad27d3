"""Many tiny files joined into few well-sized ones, byte by byte.

Contents are never parsed: newline-delimited files are joined at line boundaries, with the header of
all but the first left out, and complete zstandard frames are joined as they are.  Files that lie in
a table become such frames first, where their lines are; what moves to a container are the frames.
Every container is read again, and checked by its lengths, line count and checksums against what
went into it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

SMALL_BYTES = 2048
TARGET_BYTES = 128 << 20
_CHUNK = 4 << 20
#: A file's lines become frames of about so many bytes: a batch of frames stays small enough for a worker.
_FRAME = 64 << 10
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_MANIFEST = "container string, path string, n_files bigint, n_lines bigint, n_bytes bigint, stored_bytes bigint, line_crc_sum bigint, content_crc bigint"
_FRAMES = "container string, file_id bigint, seq bigint, header_line string, n_lines bigint, body bigint, line_crc_sum bigint, frame binary"
#: A row a file of a container, before the container's own row.
_PARTS = _MANIFEST + ", stored bigint, file_id bigint, file_lines bigint, file_body bigint, file_head bigint"


def _bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def measure(files: DataFrame, lines: DataFrame, checksums: bool = True) -> DataFrame:
    """``files`` with the true ``n_lines`` and ``true_bytes``, and ``line_crc_sum``, from their contents.

    true_bytes is the UTF-8 length of the header and of each line, and one byte more for each; a null
    header isn't there, a null line is empty.  Files without lines count too; lines without a file
    are left out.  Lines are added up within input splits before they move.
    """
    sums = [F.count(F.lit(1)).alias("n_lines"), F.sum(_bytes("line_text") + 1).alias("_body")]
    if checksums:
        sums.append(F.sum(_crc("line_text")).alias("line_crc_sum"))
    body = lines.groupBy("file_id").agg(*sums)
    zero = F.lit(0).cast("long")
    head = F.when(F.col("header_line").isNull(), zero).otherwise(_bytes("header_line") + 1)
    out = files.join(body, "file_id", "left").withColumn("true_bytes", head + F.coalesce("_body", zero)).withColumn("n_lines", F.coalesce("n_lines", zero))
    if checksums:
        out = out.withColumn("line_crc_sum", F.coalesce("line_crc_sum", zero))
    return out.drop("_body")


def small_files(measured: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Of ``measure``'s files, those under ``limit`` bytes."""
    return measured.where(F.col("true_bytes") < limit)


def plan_containers(measured: DataFrame, by: Sequence[str], target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``measured`` with ``container``: files that may share one have equal ``by``, header and separator.

    A group gets as many containers as its bytes need, and its files are dealt to them by a hash of
    file_id: no order within a group has to be made, so a group of any size plans in parallel.  A
    file that alone reaches the target is cut into ``pieces`` containers of its own, by line number.
    A null in ``by`` is a value.
    """
    keys = [*by, "header_line", "delim"]
    large = F.col("true_bytes") >= target_bytes
    totals = measured.where(~large).groupBy(*keys).agg(F.sum("true_bytes").alias("_sum"))
    renamed = totals.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_sum")
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = measured.join(renamed, cond, "left").drop(*[f"_{i}" for i in range(len(keys))])
    pieces = F.greatest(F.ceil(F.col("_sum") / F.lit(float(target_bytes))), F.lit(1))
    group = F.hex(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]))
    piece = F.pmod(F.xxhash64("file_id"), pieces)
    name = F.when(large, F.concat(F.lit("whole-"), F.col("file_id").cast("string"))).otherwise(F.concat_ws("-", group, piece.cast("string")))
    cuts = F.when(large, F.ceil(F.col("true_bytes") / F.lit(float(target_bytes)))).otherwise(F.lit(1))
    return joined.withColumn("container", name).withColumn("pieces", cuts.cast("long")).drop("_sum")


def _stored(filesystem: pafs.FileSystem, path: str, pieces: Sequence[tuple[int, int]]) -> bool:
    """Whether a stored file, read again, consists of pieces of these lengths and checksums."""
    with filesystem.open_input_stream(path, compression=None) as source:
        for length, crc in pieces:
            got = 0
            while length:
                data = source.read(min(length, _CHUNK))
                if not data:
                    return False
                got = zlib.crc32(data, got)
                length -= len(data)
            if got != crc:
                return False
        return not source.read(1)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)], names=[c for c, _ in columns])


def _framer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of container, file and number as complete zstandard frames, none over two files; a file without lines is a row without a frame."""
    now = None
    lines: list[bytes] = []
    size = seq = held = 0
    rows: list[tuple] = []

    def close() -> None:
        nonlocal size, seq, held
        data = b"".join(lines)
        frame = pa.compress(data, codec="zstd", asbytes=True) if lines else None
        rows.append((now[0], now[1], seq, now[2], len(lines), size, sum(zlib.crc32(memoryview(x)[:-1]) for x in lines), frame))
        held += len(frame or b"")
        lines.clear()
        size, seq = 0, seq + 1

    for batch in batches:
        for container, file_id, line_no, header, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or (container, file_id) != now[:2]:
                if now is not None and (lines or seq == 0):
                    close()
                now, seq = (container, file_id, header), 0
            if line_no is not None or line is not None:
                lines.append((line or "").encode() + b"\n")
                size += len(lines[-1])
                if size >= _FRAME:
                    close()
        if len(rows) > 10_000 or held > 4 * _CHUNK:
            yield _batch(rows, _FRAMES)
            rows, held = [], 0
    if now is not None and (lines or seq == 0):
        close()
    yield _batch(rows, _FRAMES)


def _writer(out_dir: str, write: bool):
    """Joins frames, which come in the order of container, file and number; a row a file and then one for the container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = pafs.FileSystem.from_uri(out_dir) if write else (None, "")
        now: dict = {}
        parts: list[list] = []

        def put(data: bytes) -> None:
            now["crc"] = zlib.crc32(data, now["crc"])
            now["length"] += len(data)
            if write:
                now["sink"].write(data)

        def close() -> pa.RecordBatch:
            stored = None
            if write:
                now["sink"].close()
                stored = int(_stored(target, now["temp"], [(now["length"], now["crc"])]))
                target.move(now["temp"], now["path"])  # a repeated task replaces the file by an equal one
            row = [now["container"], now["path"], now["files"], now["lines"], now["bytes"], now["length"], now["sum"], now["crc"], stored, None, None, None, None]
            return _batch([*parts, row], _PARTS)

        for batch in batches:
            for container, file_id, _, header, n_lines, body, crc_sum, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = b"" if header is None else header.encode() + b"\n"
                if container != now.get("container"):
                    if now:
                        yield close()
                        parts = []
                    now = {"container": container, "path": None, "files": 0, "last": None, "lines": 0, "bytes": len(head), "length": 0, "sum": 0, "crc": 0}
                    if write:
                        now["path"] = f"{root}/{container}.csv.zst"
                        # attempts at one container, at the same time or one after another, never share a name
                        now["temp"] = f"{root}/.{container}.{uuid.uuid4().hex}.tmp"
                        target.create_dir(root, recursive=True)
                        now["sink"] = target.open_output_stream(now["temp"], compression=None)
                    if head:
                        put(pa.compress(head, codec="zstd", asbytes=True))
                if file_id != now["last"] or not parts:
                    if file_id != now["last"]:
                        now["last"], now["files"] = file_id, now["files"] + 1
                    if len(parts) >= 10_000:
                        yield _batch(parts, _PARTS)
                        parts = []
                    parts.append([container, *[None] * 8, file_id, 0, 0, len(head)])
                now["lines"] += n_lines
                now["bytes"] += body
                now["sum"] += crc_sum
                parts[-1][10] += n_lines
                parts[-1][11] += body
                if frame is not None:
                    put(frame)
        if now:
            yield close()

    return run


def compact_lines(planned: DataFrame, lines: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Joins the planned files' lines into their containers and returns one checked manifest row each.

    Columns: ``container, path, n_files, n_lines, n_bytes, line_crc_sum`` of what was joined,
    ``stored_bytes, content_crc`` of the frames, ``want_lines, want_bytes, want_crc_sum`` as planned
    (for a cut file: of all its pieces), and ``valid``, whether what was joined and what was planned
    agree, and what is stored, read again, has the length and checksum of the frames.  With
    ``out_dir`` the containers are written there (any file system pyarrow knows) when this is called,
    each under a temporary name until it is whole.  Within a container files come in the order of
    file_id, lines in that of line_no; each line is written exactly as often as it occurs.  A file
    without lines adds none.
    """
    made = _joined(planned, lines, out_dir)
    # written once, whatever is done with the manifest
    return _checked(planned, (cut_lineage(made) if out_dir is not None else made).where("file_id is null"))


def compact_measured(planned: DataFrame, lines: DataFrame, out_dir: str | None = None, keep: bool = True) -> DataFrame:
    """``compact_lines``, but a row a file: ``file_id, n_lines, true_bytes`` as they were counted while it was joined.

    true_bytes is as in ``measure``.  A container that isn't valid is an error, so that no file is
    left out.  Without ``keep`` the containers are removed once they are checked.
    """
    made = cut_lineage(_joined(planned, lines, out_dir))  # a row a file and container: joined once
    bad = _checked(planned, made.where("file_id is null")).where(~F.col("valid")).select("container").limit(5).collect()
    if bad:
        raise ValueError(f"containers that don't hold what was planned: {', '.join(r.container for r in bad)}")
    if out_dir is not None and not keep:
        filesystem, root = pafs.FileSystem.from_uri(out_dir)
        if filesystem.get_file_info(root).type == pafs.FileType.Directory:
            filesystem.delete_dir(root)
    bytes_ = (F.sum("file_body") + F.max("file_head")).alias("true_bytes")
    return made.where("file_id is not null").groupBy("file_id").agg(F.sum("file_lines").alias("n_lines"), bytes_)


def frames(planned: DataFrame, lines: DataFrame) -> DataFrame:
    """``_FRAMES``: the planned files' lines as complete zstandard frames, made where a join by file brings the lines together."""
    part = planned.select("container", "file_id", "header_line", "pieces", "n_lines")
    text = lines.select("file_id", "line_no", "line_text")
    columns = ["container", "file_id", "line_no", "header_line", "line_text"]
    whole = part.where("pieces = 1").join(text, "file_id", "left").select(*columns)
    # a file that alone fills containers is dealt to tasks by its pieces
    cut = part.where("pieces > 1").join(text, "file_id", "left")
    piece = F.floor((F.coalesce("line_no", F.lit(1)) - 1) * F.col("pieces") / F.greatest("n_lines", F.lit(1)))
    cut = cut.withColumn("container", F.concat("container", F.lit("-"), F.pmod(piece, F.col("pieces")).cast("string"))).select(*columns).repartition("container")
    order = ["container", "file_id", "line_no"]
    return whole.sortWithinPartitions(*order).mapInArrow(_framer, _FRAMES).unionByName(cut.sortWithinPartitions(*order).mapInArrow(_framer, _FRAMES))


def _joined(planned: DataFrame, lines: DataFrame, out_dir: str | None) -> DataFrame:
    """``_PARTS`` of the containers as they are joined; the files' rows have no path."""
    n = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = frames(planned, lines).repartition(n, "container").sortWithinPartitions("container", "file_id", "seq")
    return placed.mapInArrow(_writer(out_dir or "", out_dir is not None), _PARTS)


def stored_sums(manifest: DataFrame) -> DataFrame:
    """``container, n_lines, n_bytes, line_sum`` of the stored containers, read again and unpacked.

    Lines end at line breaks, a container's header (``has_header``) doesn't count; line_sum adds up
    the first 32 bits of the lines' MD5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for container, path, has_header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = size = total = 0
                rest, first = b"", has_header
                filesystem, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with filesystem.open_input_stream(at, compression="zstd") as source:
                    while data := source.read(_CHUNK):
                        *lines, rest = (rest + data).split(b"\n")
                        if first and lines:
                            lines, first = lines[1:], False
                        n += len(lines)
                        size += sum(map(len, lines)) + len(lines)
                        total += sum(int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in lines)
                rows.append((container, n, size, total))
            yield _batch(rows, "container string, n_lines bigint, n_bytes bigint, line_sum bigint")

    return manifest.select("container", "path", "has_header").mapInArrow(run, "container string, n_lines bigint, n_bytes bigint, line_sum bigint")


def _checked(planned: DataFrame, made: DataFrame) -> DataFrame:
    # what a plan's container holds is compared with what all its pieces hold; each piece repeats the header
    base = F.regexp_replace("container", r"^(whole-[^-]*)-[0-9]+$", "$1")
    made = made.withColumn("_c", base)
    per = Window.partitionBy("_c")
    got = {"got_files": F.max("n_files"), "got_lines": F.sum("n_lines"), "got_bytes": F.sum("n_bytes"), "got_sum": F.sum("line_crc_sum"), "got_pieces": F.count(F.lit(1)), "got_stored": F.min(F.coalesce("stored", F.lit(1)))}
    made = made.withColumns({k: v.over(per) for k, v in got.items()})
    one = F.when(F.col("header_line").isNull(), F.lit(0)).otherwise(F.octet_length("header_line") + 1)
    want = planned.groupBy(F.col("container").alias("_c")).agg(
        F.count(F.lit(1)).alias("want_files"), F.sum("n_lines").alias("want_lines"), F.sum(F.col("true_bytes") - one).alias("_body"), F.max(one).alias("_head"), F.sum("line_crc_sum").alias("want_crc_sum")
    )
    checked = want.join(made, "_c", "left").withColumn("want_bytes", F.col("_body") + F.col("_head") * F.col("got_pieces"))
    same = F.col("got_stored") == 1
    for a, b in (("got_files", "want_files"), ("got_lines", "want_lines"), ("got_bytes", "want_bytes"), ("got_sum", "want_crc_sum")):
        same = same & (F.col(a) == F.col(b))
    names = ["path", "n_files", "n_lines", "n_bytes", "stored_bytes", "line_crc_sum", "content_crc", "want_lines", "want_bytes", "want_crc_sum"]
    return checked.select(F.coalesce("container", "_c").alias("container"), *names, F.coalesce(same, F.lit(False)).alias("valid"))


def _is_zstd(path: str) -> bool:
    return path.endswith((".zst", ".zstd"))


def _check_frames(filesystem: pafs.FileSystem, path: str) -> None:
    """Walks the frame and block headers of a zstandard file to its end; an incomplete frame is an error."""
    with filesystem.open_input_file(path) as source:
        size, at = source.size(), 0

        def take(n: int) -> bytes:
            nonlocal at
            if at + n > size:
                raise ValueError(f"{path} ends within a zstandard frame")
            source.seek(at)
            at += n
            return source.read(n)

        def skip(n: int) -> None:
            nonlocal at
            if at + n > size:
                raise ValueError(f"{path} ends within a zstandard frame")
            at += n

        while at < size:
            magic = take(4)
            if magic[1:] == b"\x2a\x4d\x18" and magic[0] >> 4 == 5:
                skip(int.from_bytes(take(4), "little"))
                continue
            if magic != _ZSTD_MAGIC:
                raise ValueError(f"{path} has something else than a zstandard frame at byte {at - 4}")
            flags = take(1)[0]
            single = flags >> 5 & 1
            skip((1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6])
            last = False
            while not last:
                block = int.from_bytes(take(3), "little")
                last, kind = bool(block & 1), block >> 1 & 3
                if kind == 3:
                    raise ValueError(f"{path} has a broken zstandard block at byte {at - 3}")
                skip(1 if kind == 1 else block >> 3)
            skip(4 * (flags >> 2 & 1))


def _join_files(filesystem: pafs.FileSystem, paths: Sequence[str], out: str, header_lines: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Joins files into ``out`` chunk by chunk; returns bytes read, bytes written, bytes left out or put in, and the length and checksum of each piece."""
    framed = _is_zstd(paths[0])
    read = written = adjusted = 0
    head = b""
    pieces: list[tuple[int, int]] = []
    with filesystem.open_output_stream(out, compression=None) as sink:
        last = b"\n"
        for k, path in enumerate(paths):
            if framed:
                _check_frames(filesystem, path)
            length = crc = 0
            with filesystem.open_input_stream(path, compression=None) as source:
                data = source.read(_CHUNK)
                if not framed and header_lines and data:
                    end = 0
                    for _ in range(header_lines):
                        cut = data.find(b"\n", end)
                        end = len(data) if cut < 0 else cut + 1
                    if k == 0:
                        head = data[:end].rstrip(b"\r\n")
                    elif data[:end].rstrip(b"\r\n") != head:
                        raise ValueError(f"{path} has another header than {paths[0]}")
                    else:
                        read += end
                        adjusted -= end
                        data = data[end:]
                        if not data:
                            data = source.read(_CHUNK)
                if not framed and data and last != b"\n":
                    sink.write(b"\n")
                    pieces.append((1, zlib.crc32(b"\n")))
                    written += 1
                    adjusted += 1
                while data:
                    read += len(data)
                    written += len(data)
                    sink.write(data)
                    length, crc = length + len(data), zlib.crc32(data, crc)
                    last = data[-1:]
                    data = source.read(_CHUNK)
            pieces.append((length, crc))
    return read, written, adjusted, pieces


def compact_paths(spark: SparkSession, paths: Sequence[str] | str, out_dir: str, target_bytes: int = TARGET_BYTES, header_lines: int = 0) -> DataFrame:
    """Joins stored files (a list, or a directory or pattern) into containers under ``out_dir``; a manifest row each.

    Files of one directory and ending share containers.  Newline-delimited files get a line end where
    the last line has none and lose all headers but the first (they must be equal); files of complete
    zstandard frames (.zst) are joined as they are, headers included.  Returns ``container, n_files,
    bytes_in, bytes_out, bytes_adjusted, valid``; valid means that the container's stored length is
    bytes_in + bytes_adjusted and that its bytes, read again, have the checksum of each input.  A file
    that ends within a zstandard frame is an error.  Empty files add nothing; no files give no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths) if not isinstance(paths, str) else paths).select("path", "length")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    ending = F.regexp_extract("path", r"(\.[^./]+(?:\.zstd?)?)$", 1)
    group = listed.withColumn("_g", F.hex(F.xxhash64(folder, ending))).withColumn("_e", ending)
    totals = group.groupBy("_g").agg(F.greatest(F.ceil(F.sum("length") / F.lit(float(target_bytes))), F.lit(1)).alias("_n"))
    dealt = group.join(totals, "_g").withColumn("container", F.concat("_g", F.lit("-"), F.pmod(F.xxhash64("path"), F.col("_n")).cast("string"), "_e"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # names and lengths only: a container's files, not their contents, meet here
        filesystem, root = pafs.FileSystem.from_uri(out_dir)
        source = [pafs.FileSystem.from_uri(p if "://" in p else p.replace("file:", "file://", 1))[1] for p in sorted(pdf["path"])]
        filesystem.create_dir(root, recursive=True)
        final = f"{root}/{key[0]}"
        temp = f"{root}/.{key[0]}.{uuid.uuid4().hex}.tmp"
        read, written, adjusted, pieces = _join_files(filesystem, source, temp, header_lines)
        filesystem.move(temp, final)
        stored = filesystem.get_file_info(final).size
        valid = stored == written == read + adjusted and read == int(pdf["length"].sum()) and _stored(filesystem, final, pieces)
        return pd.DataFrame([(key[0], len(pdf), read, stored, adjusted, valid)], columns=["container", "n_files", "bytes_in", "bytes_out", "bytes_adjusted", "valid"])

    return dealt.select("container", "path", "length").groupBy("container").applyInPandas(
        run, "container string, n_files bigint, bytes_in bigint, bytes_out bigint, bytes_adjusted bigint, valid boolean"
    )
