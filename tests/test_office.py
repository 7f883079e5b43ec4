"""MAT files and workbooks, read back by readers written from the formats alone."""

import struct
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest

from sulcus.sources import office, readers


def elements(raw):
    at = 0
    while at < len(raw):
        kind, size = struct.unpack_from("<II", raw, at)
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + -size % 8


def matrix(raw):
    """(name, value) of a MATRIX element's contents."""
    parts = list(elements(raw))
    kind = struct.unpack("<II", parts[0][1])[0] & 0xFF
    shape = struct.unpack(f"<{len(parts[1][1]) // 4}i", parts[1][1])
    name = parts[2][1].decode()
    if kind == 1:
        return name, [matrix(c)[1] for _, c in parts[3:]]
    if kind == 4:
        return name, parts[3][1].decode("utf-16-le")
    return name, np.frombuffer(parts[3][1], "<f8").reshape(shape, order="F")


def mat_file(path):
    raw = path.read_bytes()
    assert raw[:10] == b"MATLAB 5.0" and raw[124:128] == b"\x00\x01IM" and len(raw) % 8 == 0
    return dict(matrix(body) for kind, body in elements(raw[128:]) if kind == 14)


def test_mat_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 3, 50))
    rows = [(f"s{s}", "run-01", c, f"É{c}", x[s, c].tolist()) for s in range(2) for c in (2, 0, 1)]
    wide = spark.createDataFrame(rows, "subject string, run string, channel long, name string, samples array<double>").repartition(3)
    for _ in range(2):  # a rerun leaves the same files
        office.mat_signals(wide, f"{tmp_path}/m")
    assert sorted(p.name for p in (tmp_path / "m/s1").iterdir()) == ["run-01.mat"]
    got = mat_file(tmp_path / "m/s1/run-01.mat")
    assert np.array_equal(got["data"], x[1]) and got["ch_names"] == ["É0", "É1", "É2"]
    assert spark.read.json(f"{tmp_path}/m/files").count() == 2
    lists = spark.createDataFrame([("s0", [1, 2], ["b", "c"], [], [])], "subject string, soz_channels array<long>, soz_names array<string>, resected_channels array<long>, resected_names array<string>")
    office.mat_labels(lists, f"file://{tmp_path}/m")
    assert mat_file(tmp_path / "m/s0/soz_info.mat")["soz_channel_names"] == ["b", "c"] and mat_file(tmp_path / "m/s0/soz_info.mat")["soz_channel_indices"].tolist() == [[1.0, 2.0]]
    assert mat_file(tmp_path / "m/s0/resect_info.mat")["resect_channel_names"] == []


def test_workbook(spark, tmp_path):
    a = spark.createDataFrame([("x <&> \"y\"", 1, 1.5, True), ("\x01 ü\n", None, float("nan"), None), (None, -7, float("inf"), False)], "name string, n long, v double, ok boolean")
    many = spark.range(100).selectExpr(*[f"id + {k} as c{k}" for k in range(30)])
    at = f"{tmp_path}/out/book.xlsx"
    for _ in range(2):
        office.workbook({"first": a, "second": many, "none": a.limit(0)}, at)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["book.xlsx"]
    with zipfile.ZipFile(at) as z:
        assert z.testzip() is None
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
    first = readers.spreadsheet(spark, at)
    assert first.columns == ["name", "n", "v", "ok"]
    assert [tuple(r) for r in first.collect()] == [('x <&> "y"', "1", "1.5", "1"), ("_x0001_ ü\n", None, None, None), (None, "-7", "inf", "0")]
    second = office.spreadsheet(spark, at, "second")
    assert second.count() == 100 and second.columns[26:28] == ["c26", "c27"] and sorted(int(r.c29) for r in second.collect()) == list(range(29, 129))
    assert office.spreadsheet(spark, at, "none").count() == 0
    with pytest.raises(ValueError, match="same"):
        office.workbook({"a" * 31 + "x": a, "A" * 31 + "y": a}, at)
    with pytest.raises(ValueError, match="characters"):
        office.workbook({"a": spark.createDataFrame([("x" * 40000,)], "t string")}, at)
    with pytest.raises(Exception, match="no sheet"):
        office.spreadsheet(spark, at, "other").count()


def test_registry(spark, tmp_path):
    """The same registry as CSV and as a workbook, in which texts may be shared."""
    rows = [("P1", 20, 1), ("P2", 30, 0), ("P3", 40, 1)]
    pd.DataFrame(rows, columns=["participant_id", "all_nodes", "adopt"]).to_csv(tmp_path / "p.csv", index=False)
    office.workbook({"Sheet1": spark.createDataFrame(rows, "participant_id string, all_nodes long, adopt long")}, f"{tmp_path}/p.xlsx")
    for name in ("p.csv", "p.xlsx"):
        got = readers.participants(spark, f"{tmp_path}/{name}").collect()
        assert [(r.participant_id, r.all_nodes) for r in got] == [("P1", "20"), ("P3", "40")]
    shared = tmp_path / "shared.xlsx"
    with zipfile.ZipFile(tmp_path / "p.xlsx") as z, zipfile.ZipFile(shared, "w") as out:
        for n in z.namelist():
            raw = z.read(n).replace(b't="inlineStr"><is><t xml:space="preserve">P3</t></is>', b't="s"><v>1</v>')
            out.writestr(n, raw)
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{office.MAIN}"><si><t>no</t></si><si><r><t>P</t></r><r><t>9</t></r></si></sst>')
    assert [r.participant_id for r in readers.participants(spark, str(shared)).collect()] == ["P1", "P9"]


def test_long_registry_in_several_workbooks(spark, tmp_path):
    people = spark.range(250).selectExpr("concat('P', id) as participant_id", "id % 25 as all_nodes", "cast(id % 2 as int) as adopt")
    office.workbooks(people, at := f"{tmp_path}/registry", "participants", rows=40)
    assert len(list(tmp_path.glob("registry/*.xlsx"))) >= 7
    got = readers.participants(spark, at).select("participant_id", "all_nodes").collect()
    assert sorted(map(tuple, got)) == sorted((f"P{k}", str(k % 25)) for k in range(1, 250, 2))
    rows = office.sheet_rows(next(tmp_path.glob("registry/*.xlsx")).read_bytes())
    assert next(rows) == ["participant_id", "all_nodes", "adopt"] and not isinstance(rows, list)  # the whole sheet before
    office.workbooks(people.where("adopt > 1"), at := f"{tmp_path}/none", "participants")
    assert readers.participants(spark, at).columns == people.columns and readers.participants(spark, at).count() == 0
