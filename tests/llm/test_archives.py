import hashlib
import base64
import io
import zipfile
import zlib

import pytest

from mintweave.llm import archives as A

SCHEMA = "page_id long, url string, html string, digest string, bytes int"


def plain(rows, min_bytes):
    """The round trip's result by groups of equal payloads."""
    best = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if key is not None and len(data) >= min_bytes:
            best[data] = max(best.get(data, key), key)
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        refers = best[data] if key is not None and len(data) >= min_bytes and best[data] != key else None
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers, None))
    return sorted(out, key=repr)


def made():
    hot = [(i, f"http://h/{i}", "<p>hot</p>") for i in range(100, 160)]
    return hot + [(1, "http://a/1", "<p>é\r\n\r\nx</p>"), (2, None, None), (3, "u\r\nX: y", ""), (-4, "http://b", None), (5, "http://c", "one"), (5, "http://c", "two"),
                  (6, "http://d", "two"), (6, "http://d", "two"), (None, "http://n", "<p>hot</p>"), (None, None, None), (7, "", "z" * 300_000), (8, "q", "two")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("min_bytes", "package_bytes"), [(0, 1 << 20), (4, 700)])
def test_round_trip(spark, tmp_path, min_bytes, package_bytes):
    assert result(A.round_trip(frame(spark, made()), f"file://{tmp_path}/x", min_bytes, package_bytes)) == plain(made(), min_bytes)


def test_empty_table(spark, tmp_path):
    assert result(A.round_trip(frame(spark, []), str(tmp_path / "x"))) == []


def written(spark, tmp_path, rows=None):
    pages = spark.createDataFrame(rows or [(i, f"http://x/{i}", bytes([65 + i]) * (2000 + i)) for i in range(20)], "id long, url string, payload binary").coalesce(1)
    folder = str(tmp_path / "packages")
    A.made(folder)
    return [r.package for r in A.write(pages, folder).collect()]


def read(spark, paths, **more):
    return A.read(spark.createDataFrame([(p,) for p in paths], "package string"), **more).collect()


def test_payloads_and_places_come_back(spark, tmp_path):
    (path,) = written(spark, tmp_path)
    got = {A.page_of(r.record_id): r for r in read(spark, [path])}
    assert {k: bytes(r.payload) for k, r in got.items()} == {i: bytes([65 + i]) * (2000 + i) for i in range(20)}
    with open(path, "rb") as file:
        for r in got.values():
            file.seek(r.start)
            assert zlib.decompressobj(31).decompress(file.read(5000)).split(b"\r\n\r\n", 2)[2].removesuffix(b"\r\n\r\n") == bytes(r.payload)
    assert all(r.problem is None and r.record_type == "response" for r in got.values())


def test_zip64_prefix_and_comment(spark, tmp_path, monkeypatch):
    (path,) = written(spark, tmp_path)
    want = sorted((r.record_id, bytes(r.payload)) for r in read(spark, [path]))
    with zipfile.ZipFile(path) as file:
        parts = [(n, file.read(n)) for n in file.namelist()]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    for k, prefix in enumerate((b"", b"#!/bin/sh\n" * 7)):
        wide = tmp_path / f"wide{k}.wacz"
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_STORED) as file:
            for name, data in parts:
                file.writestr(name, data)
            file.comment = b"PK\x05\x06 not the end record"
        assert b"PK\x06\x06" in body.getvalue()
        wide.write_bytes(prefix + body.getvalue())
        assert sorted((r.record_id, bytes(r.payload)) for r in read(spark, [str(wide)])) == want


def repacked(path, target, keep, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(target, "w", method) as new:
        for name in old.namelist():
            data = keep(name, old.read(name))
            if data is not None:
                new.writestr(name, data)
    return str(target)


def test_without_a_sound_index_members_are_split(spark, tmp_path):
    (path,) = written(spark, tmp_path)
    want = sorted(r.record_id for r in read(spark, [path]))
    bare = repacked(path, tmp_path / "bare.wacz", lambda n, d: None if n.startswith("indexes") else d)
    short = repacked(path, tmp_path / "short.wacz", lambda n, d: d.splitlines(True)[0] if n.startswith("indexes") else d)
    for other in (bare, short):
        got = read(spark, [other], payloads=False)
        assert sorted(r.record_id for r in got) == want and all(r.problem is None and r.payload is None for r in got)


def test_damage_is_a_row_with_a_problem(spark, tmp_path):
    (path,) = written(spark, tmp_path)
    data = open(path, "rb").read()
    files = {"cut": data[:-30], "none": b"", "text": b"hello" * 100, "flip": data[:3000].replace(b"\x1f\x8b", b"\x1f\x00") + data[3000:]}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    packed = repacked(path, tmp_path / "deflated", lambda n, d: d, zipfile.ZIP_DEFLATED)
    ends = repacked(path, tmp_path / "ends", lambda n, d: d[:-7] if n.startswith("archive") else d)
    for other in [str(tmp_path / n) for n in files] + [packed, ends, str(tmp_path / "missing")]:
        got = read(spark, [other])
        assert got and any(r.problem for r in got), other
    assert len(read(spark, [path, str(tmp_path / "cut")])) == 21


def test_a_record_with_a_wrong_digest_is_told():
    data = A.record(1, "http://x", b"abc", 3, "WRONG", None)
    assert A.parse(data)[-1] == "the payload differs from its digest"
    assert A.parse(b"junk")[-1] == "no record head"
    assert A.parse(data[:-6])[-1] == "the record is cut off"
