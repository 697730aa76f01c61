"""WARC archives against a direct computation, and reads through selections of the index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from qaloom.llm import warc
from qaloom.llm.warc import parsed, ranges, read_records, record, round_trip, write_archives

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """Rows of the report where no page id occurs twice."""
    top = {}
    for page, _, html in rows:
        top[html or ""] = max(top.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        size = len((html or "").encode())
        revisit = size >= least and top[html or ""] != page
        out.append((page, size, digest(html), "revisit" if revisit else "response", top[html or ""] if revisit else None))
    return sorted(out)


def report(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(n=400):
    draw = random.Random(5)
    bodies = ["", None, "x", "ünï \r\n\r\n WARC/1.1\r\n", "<html>" + "long " * 50_000, *(f"<p>{i}</p>" for i in range(60))]
    # A third of all rows holds one payload.
    return [(i, f"http://h{i % 7}.example/{i}?q=a b%20ü", "hot" if i % 3 == 0 else draw.choice(bodies)) for i in range(n)]


def test_round_trip_equals_a_direct_computation(spark, tmp_path):
    rows = sample()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert report(round_trip(pages, folder=str(tmp_path / "a"))) == sorted(expected(rows), key=repr)
    assert report(round_trip(pages, least=4, folder=str(tmp_path / "b"))) == sorted(expected(rows, 4), key=repr)


def test_wide_groups_join_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("qaloom.lineage.BROADCAST_ROWS", 0)
    rows = sample(150)
    assert report(round_trip(spark.createDataFrame(rows, SCHEMA), folder=str(tmp_path))) == sorted(expected(rows), key=repr)


def test_archives_are_plain_warc_files(spark, tmp_path):
    rows = sample(60)
    index = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), file_bytes=2000)
    files = sorted(Path(tmp_path / "archives").glob("*.warc.gz"))
    assert len(files) > 3
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == 60
    ids = [line for line in raw.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    named = {line.removeprefix(b"WARC-Refers-To: ") for line in raw.split(b"\r\n") if line.startswith(b"WARC-Refers-To: ")}
    assert len(set(ids)) == 60 and named <= {line.removeprefix(b"WARC-Record-ID: ") for line in ids}
    # Members lie end to end: the index covers every byte of every file once.
    for file in files:
        places = sorted((r.offset, r.length) for r in index.where(F.col("file").endswith(file.name)).collect())
        assert [o for o, _ in places] == [0, *(o + n for o, n in places)][:-1]
        assert sum(n for _, n in places) == file.stat().st_size


def test_selected_records_only(spark, tmp_path):
    rows = sample(90)
    index = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path))
    chosen = index.where("record_type = 'response' and url like 'http://h3.%'")
    got = {int(r.page): (r.url, bytes(r.payload).decode()) for r in read_records(chosen).collect()}
    kinds = {page: kind for page, _, _, kind, _ in expected(rows)}
    assert got == {p: (u, h or "") for p, u, h in rows if u.startswith("http://h3.") and kinds[p] == "response"}
    assert read_records(index.where("false")).count() == 0


def test_ranges_join_neighbours_and_skip_gaps():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 500, 1), ("b", 501, 9), ("b", 510, 90), ("b", 600, 1)]
    got = list(ranges(places, gap=30, range_bytes=90))
    assert got == [("a", 0, 45, [0, 1, 2]), ("a", 500, 501, [3]), ("b", 501, 600, [4, 5]), ("b", 600, 601, [6])]
    assert list(ranges([])) == []


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = [
        (7, "u", "same"), (7, "u", "same"), (7, "u", "same"), (3, "z", "same"),  # equal rows tie
        (8, "a", "tie"), (8, "b", "tie"), (8, None, "tie"),  # the greatest URL
        (None, None, None), (None, None, None), (None, "n", ""), (None, "only", "null key"),
        (9, "a\r\nX: y", "header"),
    ]
    pages = spark.createDataFrame([(*r, r[0], "c") for r in rows], SCHEMA + ", sha long, top_page string").repartition(3)
    got = Counter(tuple(r) for r in round_trip(pages, folder=str(tmp_path)).collect())
    row = lambda page, html, kind, of: (page, len(html), digest(html), kind, of)
    assert got == Counter({
        row(7, "same", "response", None): 1, row(7, "same", "revisit", 7): 2, row(3, "same", "revisit", 7): 1,
        row(8, "tie", "response", None): 1, row(8, "tie", "revisit", 8): 2,
        row(None, "", "response", None): 1, row(None, "", "revisit", None): 2,
        row(None, "null key", "response", None): 1, row(9, "header", "response", None): 1,
    })


def test_empty_table_and_other_key_types(spark, tmp_path):
    assert round_trip(spark.createDataFrame([], SCHEMA), folder=str(tmp_path / "a")).count() == 0
    pages = spark.createDataFrame([("ä%41\n", "u", "x"), ("b", "u", "x")], "id string, link string, body string")
    got = report(round_trip(pages, "id", "link", "body", folder=str(tmp_path / "b")))
    assert got == [("b", 1, digest("x"), "revisit", "ä%41\n"), ("ä%41\n", 1, digest("x"), "response", None)]


def test_a_damaged_record_is_refused():
    raw = record("1", "u", b"payload", 7, digest("payload"), 0, None)
    assert parsed(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parsed(raw.replace(b"payload\r\n", b"paxload\r\n"))
    with pytest.raises(ValueError):
        parsed(raw[:-1])
    with pytest.raises(ValueError):
        parsed(raw[1:])


def test_rows_of_an_attempt_that_failed_are_not_read(spark, tmp_path):
    """A file that no index row names changes nothing."""
    rows = sample(30)
    index = write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    orphan = warc.Archive(f"file://{tmp_path}/archives", 1 << 20)
    orphan.append(record("99", "u", b"lost", 4, digest("lost"), 0, None))
    orphan.close()
    assert read_records(index).count() == 30
