"""Nucleotide files in binary packets: a tag of one byte, a length of four (most significant first), then that many bytes.

The first packet is the cookie. Packet 0 is the sequence: a byte of flags, the lowest of them set
for a circular molecule, then its letters. Other packets hold annotations and are passed over by
their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# fixed values of the format
COOKIE_TAG = 9
COOKIE = b"SnapGene"
SEQUENCE_TAG = 0
HEADER = 5
LETTERS = b"ACGTURYSWKMBDHVN"
SCHEMA = "path string, dna string, circular boolean, problem string"


def is_container(content: bytes) -> bool:
    return content[:1] == bytes([COOKIE_TAG]) and content[HEADER : HEADER + len(COOKIE)] == COOKIE


def packets(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, payload) of each packet; an error where the bytes end too soon."""
    at = 0
    while at < len(content):
        size = int.from_bytes(content[at + 1 : at + HEADER], "big")
        end = at + HEADER + size
        if len(content) < at + HEADER or len(content) < end:
            raise ValueError(f"packet {content[at]} at byte {at} is cut off")
        yield content[at], content[at + HEADER : end]
        at = end


def sequence(content: bytes) -> tuple[str, bool]:
    """(letters in upper case, whether circular) of a container."""
    if not is_container(content):
        raise ValueError("no cookie")
    found = [payload for tag, payload in packets(content) if tag == SEQUENCE_TAG]
    if len(found) != 1 or not found[0]:
        raise ValueError(f"{len(found)} sequence packets" if len(found) != 1 else "empty sequence packet")
    letters = found[0][1:].upper()
    if odd := sorted({chr(x) for x in letters} - set(LETTERS.decode())):
        raise ValueError(f"letters that are no nucleotides: {''.join(odd[:8])}")
    return letters.decode("ascii"), bool(found[0][0] & 1)


def packet_files(spark: SparkSession, folder: str, pattern: str = "*.dna") -> DataFrame:
    """(path, dna, circular, problem) of the containers of a folder, read in tasks of many files each.

    A file that is damaged has a null sequence and says why; the others are read all the same.
    An empty file has no row: Spark's scan passes over it.
    """

    def rows(batches):
        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    out.append((path, *sequence(content), None))
                except ValueError as e:
                    out.append((path, None, None, str(e)))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["path", "dna", "circular", "problem"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(rows, SCHEMA)
