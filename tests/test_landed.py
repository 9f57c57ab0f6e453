"""The data source for landed files: torn files, blocks of any size, each row once over restarts."""

import csv
import io

import pytest

from leadloom.sources import landed

ROWS = [("Shop, One", 'say "hi"', "p1"), ("two\nlines", "", "p2"), ("é日\r\nx", "w", "p3"), ("", "a,b", "p4"), ("last", "\n\n\"", "p5")]


def as_csv(rows, header=True):
    out = io.StringIO(newline="")
    w = csv.writer(out)
    if header:
        w.writerow(["title", "extra", "website", "place_id"])
    w.writerows([(t, "x", v, p) for t, v, p in rows])
    return out.getvalue().encode()


def read_bytes(tmp_path, data, start=0, final=False, block=8 << 20):
    f = tmp_path / "x.csv"
    f.write_bytes(data)
    return [(r["title"], r["website"], r["place_id"], r["row_end"]) for b in landed.read_range(str(f), landed.Range(str(f), start, len(data)), final, block) for r in b.to_pylist()]


def whole(data):
    """(row, end) of each row whose line end is there, from the bytes one by one."""
    out, begin, inside = [], 0, False
    for i, c in enumerate(data):
        inside ^= c == 34
        if c == 10 and not inside:
            out.append((next(csv.reader(io.StringIO(data[begin : i + 1].decode(), newline=""))), i + 1))
            begin = i + 1
    return [(r[0] or None, r[2] or None, r[3], e) for r, e in out[1:]]


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_torn_anywhere(tmp_path, block):
    data = as_csv(ROWS)
    assert [r[2] for r in whole(data)] == ["p1", "p2", "p3", "p4", "p5"]
    for cut in range(0, len(data) + 1, 1 if block > 7 else 5):
        assert read_bytes(tmp_path, data[:cut], block=block) == whole(data[:cut])


def test_ranges_give_each_row_once(tmp_path):
    data = as_csv(ROWS)
    for a in range(0, len(data), 3):
        for b in range(a, len(data), 11):
            parts = read_bytes(tmp_path, data[:a]) + read_bytes(tmp_path, data[:b], start=a) + read_bytes(tmp_path, data, start=b)
            assert parts == whole(data)


def test_final_row_without_line_end(tmp_path):
    data = as_csv(ROWS[:2]).rstrip()
    assert [r[2] for r in read_bytes(tmp_path, data)] == ["p1"] and [r[2] for r in read_bytes(tmp_path, data, final=True)] == ["p1", "p2"]
    assert [r[2] for r in read_bytes(tmp_path, b"\xef\xbb\xbf" + data + b'\r\n"open', final=True)] == ["p1", "p2"]
    assert read_bytes(tmp_path, b"", final=True) == [] and read_bytes(tmp_path, b"title,place_id", final=True) == []


def test_batches(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(as_csv(ROWS))
    (tmp_path / "b.csv").write_bytes(as_csv(ROWS)[:-4])
    (tmp_path / "_c.csv").write_bytes(as_csv(ROWS))
    got = landed.read_landed(spark, str(tmp_path)).collect()
    assert len(got) == 9 and {r["file"].rpartition("/")[2] for r in got} == {"a.csv", "b.csv"} and {r["phone"] for r in got} == {None}
    assert landed.read_landed(spark, str(tmp_path / "a.csv")).count() == 5
    assert landed.read_landed(spark, str(tmp_path / "none")).count() == 0


def test_stream_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    data = as_csv(ROWS)

    def run():
        q = landed.stream_landed(spark, str(folder)).select("title", "place_id", "file").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    for cut in (5, 40, 41, len(data) - 1, len(data)):
        (folder / "a.csv").write_bytes(data[:cut])
        if cut == 41:
            (folder / "b.csv").write_bytes(data)
        run()
    got = sorted((r["file"].rpartition("/")[2], r["place_id"], r["title"]) for r in spark.read.parquet(str(out)).collect())
    assert got == sorted((f, p, t or None) for f in ("a.csv", "b.csv") for t, _, p in ROWS)
