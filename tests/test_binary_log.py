"""Hashes, and files of the binary log format with faults in them."""

from __future__ import annotations

import random

import pytest

from ledgerflow.functions.hashes import blake3, blake3_column, crc32c, crc32c_column, crc32c_rows
from ledgerflow.sources import binary_log


def test_known_digests():
    assert crc32c(b"123456789") == 0xE3069283
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    pattern = bytes(i % 251 for i in range(102400))  # the public test vectors' input
    assert blake3(pattern[:1024]).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3(pattern[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    rows = [bytes(random.Random(i).randbytes(20)) for i in range(9)]
    assert crc32c_rows(rows).tolist() == [crc32c(r) for r in rows]


def test_hash_columns(spark):
    row = spark.createDataFrame([(b"abc",), (None,)], "x binary").select(blake3_column("x"), crc32c_column("x")).collect()
    assert bytes(row[0][0]) == blake3(b"abc") and row[0][1] == crc32c(b"abc") and row[1][0] is None and row[1][1] is None


def file_of(n: int, base: int = 0, end: bool = True, views=None) -> tuple[bytearray, list[int]]:
    prev, data, at = b"\0" * 16, bytearray(binary_log.metadata(base, b"\0" * 16)), []
    for i in range(base, base + n):
        at.append(len(data))
        frame, prev = binary_log.encode(i, f"payload {i}".encode(), prev, view_id=(views or {}).get(i, 0))
        data += frame
    return data + (binary_log.end_mark(base + n - 1) if end else b""), at


def verdict(spark, tmp_path, data) -> tuple:
    (tmp_path / "log.bin").write_bytes(bytes(data))
    r = binary_log.outcomes(binary_log.read_log(spark, str(tmp_path))).first()
    return (r.entries, r.last_valid, r.outcome) if r else None


CASES = {}


def case(expected):
    return lambda f: CASES.setdefault(f.__name__, (f, expected)) and f


@case((5, 4, "Clean"))
def clean():
    return file_of(5)[0]


@case((3, 52, "Clean"))
def compacted():
    return file_of(3, base=50)[0]


@case((5, 4, "Truncated"))
def torn_tail():
    data, at = file_of(6, end=False)
    return data[: at[5] + 40]


@case((5, 4, "MidLogCorruption"))
def checksum_in_the_middle():
    data, at = file_of(10)
    data[at[5]] ^= 255
    return data


@case((5, 4, "ZeroHole"))
def hole():
    data, at = file_of(10)
    data[at[5] : at[5] + 80] = b"\0" * 80
    return data


@case((5, 4, "Clean"))
def zero_tail():
    return file_of(5, end=False)[0] + b"\0" * 400


@case((4, 3, "Truncated"))
def payload_of_the_last():
    data, at = file_of(5, end=False)
    data[at[4] + 81] ^= 1
    return data


@case((5, 4, "EndMarkMismatch"))
def wrong_end():
    return file_of(5, end=False)[0] + binary_log.end_mark(9)


@case((3, 2, "ViewRegression"))
def older_view():
    return file_of(5, views={0: 1, 1: 1, 2: 2, 3: 1})[0]


@case((3, 2, "BrokenChain"))
def broken_chain():
    data, at = file_of(3, end=False)
    return data + binary_log.encode(3, b"x", b"\1" * 16)[0]


@case((3, 2, "MonotonicityViolation"))
def skipped_index():
    rows, _ = file_of(3, end=False)
    last = list(binary_log.parse(bytes(rows)))[-1][10]
    return rows + binary_log.encode(4, b"x", last)[0]


@pytest.mark.parametrize("name", CASES)
def test_file(spark, tmp_path, name):
    make, expected = CASES[name]
    assert verdict(spark, tmp_path, make()) == expected
