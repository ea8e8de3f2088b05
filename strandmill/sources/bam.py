"""BAM as a data source: rows of SAM text, read in splits of the compressed file.

A file is a series of BGZF blocks of up to 64 KB.  A split owns the records that start in blocks which begin inside
its bytes.  It finds its first block by the header of a block that another one follows, and its first record by the
first place from which a chain of plausible records leads on; it reads on into blocks behind its end where its last
record goes on there.  Files are read through pyarrow's file systems, so they may be local or remote, and a task
holds a few blocks at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed by the format: the start of a block's header, operations of CIGAR, and letters of packed bases, by number.
MAGIC, OPS, BASES = b"\x1f\x8b\x08\x04", "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Tags of one number: type letter, its struct format; SAM shows all integers as i.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
SPLIT, MOST, CHAIN = 64 << 20, 1 << 16, 8
#: No record is as large; bounds the search for a record's start.
RECORD = 1 << 24


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, path = fs.FileSystem.from_uri(path)
    else:
        system = fs.LocalFileSystem()
    return system, path


def block_size(head: bytes) -> int:
    """Bytes of the block that starts with ``head``; 0 if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return 0


def blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from ``at`` on."""
    while at < size:
        f.seek(at)
        raw = f.read(MOST)
        n = block_size(raw)
        if not n or n > len(raw):
            raise ValueError(f"no whole BGZF block at byte {at}")
        skip = 12 + struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[skip : n - 8], -15)
        at += n


def first_block(f, at: int, size: int) -> int:
    """The first block that begins at or behind ``at``, or the file's end."""
    f.seek(at)
    data, k = f.read(2 * MOST + 18), -1
    while (k := data.find(MAGIC, k + 1)) >= 0:
        n = block_size(data[k : k + 64])
        if n and (at + k + n == size or block_size(data[k + n : k + n + 64])):
            return at + k
    return size


class Stream:
    """Bytes of successive blocks; ``place`` tells in which block the next byte is."""

    def __init__(self, of: Iterator[tuple[int, bytes]]):
        self.of, self.data, self.at, self.starts = of, b"", 0, []

    def more(self) -> bool:
        for place, content in self.of:
            if content:
                self.data, self.starts = self.data[self.at :] + content, [(k - self.at, p) for k, p in self.starts]
                self.at = 0
                self.starts = [s for i, s in enumerate(self.starts) if i + 1 == len(self.starts) or self.starts[i + 1][0] > 0]
                self.starts.append((len(self.data) - len(content), place))
                return True
        return False

    def need(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("the file ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def place(self) -> int | None:
        return max((s for s in self.starts if s[0] <= self.at), default=(0, None))[1] if self.need(1) else None


def header(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    """Text of the header; names and lengths of the references."""
    if stream.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    text = stream.take(number()).rstrip(b"\0").decode()
    return text, [(stream.take(number())[:-1].decode(), number()) for _ in range(number())]


def _plausible(data: bytes, at: int, refs: list[tuple[str, int]]) -> int:
    """Where the record that may start at ``at`` would end; 0 if none can start there, -1 if ``data`` is too short to tell."""
    if len(data) < at + 36:
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    least = 32 + l_name + 4 * n_cigar + (max(l_seq, 0) + 1) // 2 + max(l_seq, 0)
    if not (l_name > 0 and l_seq >= 0 and least <= size <= RECORD):
        return 0
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not (-1 <= r < len(refs) and -1 <= p and (r < 0 or p <= refs[r][1])):
            return 0
    if len(data) < at + 36 + l_name + 4 * n_cigar:
        return -1
    name = data[at + 36 : at + 36 + l_name]
    if name[-1] or any(c < 33 or c > 126 for c in name[:-1]):
        return 0
    if any(x & 15 >= len(OPS) for x in struct.unpack_from(f"<{n_cigar}I", data, at + 36 + l_name)):
        return 0
    return at + 4 + size


def first_record(stream: Stream, refs: list[tuple[str, int]]) -> bool:
    """Advance to the first place from which ``CHAIN`` records follow one another, or all to the end of the file."""
    k = 0
    while stream.need(k + 1):
        at, n = stream.at + k, 0
        while n < CHAIN:
            end = _plausible(stream.data, at, refs)
            if end == 0:
                break
            if end < 0 or end > len(stream.data):
                base = stream.at
                if stream.more():
                    at -= base  # the stream drops what lies before its place
                    continue
                n = CHAIN if n and at == len(stream.data) or end == len(stream.data) else -1
                break
            at, n = end, n + 1
        if n >= CHAIN:
            stream.at += k
            return True
        k += 1
    return False


def _tags(data: bytes) -> list[str]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind in NUMBERS:
            x = struct.unpack_from(f"<{NUMBERS[kind]}", data, at)[0]
            out.append(f"{name}:f:{x:g}" if kind == "f" else f"{name}:i:{x}")
            at += struct.calcsize(NUMBERS[kind])
        elif kind in "ZH":
            end = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            xs = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
            out.append(f"{name}:B:" + ",".join([of, *(f"{x:g}" if of == "f" else str(x) for x in xs)]))
            at += 5 + n * struct.calcsize(NUMBERS[of])
        else:
            raise ValueError(f"unknown type of a tag: {kind}")
    return out


def as_line(b: bytes, refs: list[tuple[str, int]]) -> str:
    """A record, without its size, as a line of SAM."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
    at = 32 + l_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", b, at)) or "*"
    at += 4 * n_cigar
    half = (l_seq + 1) // 2
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in b[at : at + half])[:l_seq] or "*"
    at += half
    qual = b[at : at + l_seq]
    shown = "*" if not l_seq or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    chrom = refs[ref][0] if ref >= 0 else "*"
    mate = "*" if next_ref < 0 else "=" if next_ref == ref else refs[next_ref][0]
    return "\t".join([b[32 : 31 + l_name].decode() or "*", str(flag), chrom, str(pos + 1), str(mapq), cigar, mate, str(next_pos + 1), str(tlen), seq, shown, *_tags(b[at + l_seq :])])


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        system, at = _open(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.base_name.endswith(".bam")]
        elif info.is_file:
            found = [info]
        else:
            raise FileNotFoundError(self.path)
        prefix = self.path[: -len(at)] if self.path.endswith(at) else ""
        return [Split(prefix + f.path, k, min(k + self.split, f.size), f.size) for f in sorted(found, key=lambda f: f.path) for k in range(0, f.size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, path = _open(partition.path)
        with system.open_input_file(path) as f:
            stream = Stream(blocks(f, 0, partition.size))
            _, refs = header(stream)
            if partition.start:
                start = first_block(f, partition.start, partition.size)
                # The header may reach into this split: the first record is behind it in any case.
                behind = stream.place()
                if behind is not None and behind < start:
                    stream = Stream(blocks(f, start, partition.size))
                    if start >= partition.stop or not first_record(stream, refs):
                        return
            lines: list[str] = []
            while (place := stream.place()) is not None and place < partition.stop:
                lines.append(as_line(stream.take(struct.unpack("<i", stream.take(4))[0]), refs))
                if len(lines) == 1024:
                    yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
                    lines = []
            if lines:
                yield pa.record_batch([pa.array(lines, pa.string())], ["value"])


class BamSource(DataSource):
    """``spark.read.format("bam")``: value, a line of SAM for each record; option ``split``: compressed bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT)))
