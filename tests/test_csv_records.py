"""CSV uploads split at any place against Python's own reader of whole files."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.operators import mapping
from marketlens.sources import csv_records, sheets


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())


def cells_of(text, sep=","):
    """Records of a file by the csv module; blank lines are none."""
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
    return [[c.replace("\r\n", "\n") for c in r] for r in rows if r and not (len(r) == 1 and not r[0].strip())]


def read(spark, folder, sep=","):
    rows, headers = csv_records.read_records(spark, str(folder), sep)
    got = {}
    for r in rows.orderBy("report_id", "line_no").collect():
        got.setdefault(r.report_id, []).append([c or "" for c in r.cells])
    return got, headers


PIECES = ["plain", "", 'say "hi"', "a,b", "line\nbreak", "two\n\nbreaks, and \"more\"", "x" * 150, '"', '""', "ends\n", "\nstarts", ",", "é漢🙂"]


def sheet_text(seed, rows, sep=",", end="\n"):
    rng = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=sep, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerow(["id", "some, note", "more", "last"])
    for n in range(rows):
        writer.writerow([n, *(rng.choice(PIECES) for _ in range(3))])
    return out.getvalue()


def test_files_cut_anywhere(spark, tmp_path, small_blocks):
    texts = {f"r{n}.csv": sheet_text(n, 20 + 60 * n, end="\r\n" if n % 2 else "\n") for n in range(5)}
    for name, text in texts.items():
        write(tmp_path / "in", name, text)
    got, headers = read(spark, tmp_path / "in")
    for name, text in texts.items():
        assert got[name] == cells_of(text)[1:], name
    assert {r.header for r in headers.collect()} == {"id", "some, note", "more", "last"}


def test_blocks_that_start_inside_a_cell(spark, tmp_path, small_blocks):
    """Cells longer than several blocks: whole blocks lie inside quotes, where quotes look the other way round."""
    inner = "\n".join(f'row {n}, "quoted" and, "again"' for n in range(200))
    rows = [["a", inner, "1"], ["b", "short", "2"], ["c", inner + "\n", "3"], ["d", "", "4"]]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["k", "text", "n"], *rows])
    write(tmp_path / "in", "r.csv", out.getvalue())
    lines = csv_records.land_lines(spark, str(tmp_path / "in"), str(tmp_path / "landed"))
    starts = csv_records.block_starts(lines)
    assert starts.filter("inside").count() > 5 < starts.filter("not inside").count() + 5
    assert read(spark, tmp_path / "in")[0]["r.csv"] == rows


def test_quotes_that_open_nothing(spark, tmp_path, small_blocks):
    text = "size,name\n" + "".join(f'{n}" pipe,plain {n}\n' for n in range(100)) + '"a ""b"" c",d\n'
    write(tmp_path / "in", "r.csv", text)
    got = read(spark, tmp_path / "in")[0]["r.csv"]
    assert got[:2] == [['0" pipe', "plain 0"], ['1" pipe', "plain 1"]] and got[-1] == ['a "b" c', "d"] and len(got) == 101


def test_commas_in_cells_cost_no_columns(spark, tmp_path):
    write(tmp_path / "in", "r.csv", 'a,b\n1,"' + "x," * 3000 + '"\n2\n3,y,too,many\n')
    rows, _ = csv_records.read_records(spark, str(tmp_path / "in"))
    assert sorted(len(r.cells) for r in rows.collect()) == [2, 2, 2]
    assert read(spark, tmp_path / "in")[0]["r.csv"] == [["1", "x," * 3000], ["2", ""], ["3", "y"]]


def test_uploads_of_one_name_and_of_different_layout(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "\ufeffx;y\n1;2\n")
    write(tmp_path / "in", "a.txt", "y;x;z\n\n \n3;4;5\n")
    write(tmp_path / "in", "empty.csv", "")
    write(tmp_path / "in", "names.csv", " x ;;x;w\n")
    got, headers = read(spark, tmp_path / "in", ";")
    assert got == {"a.csv": [["1", "2", "", ""]], "a.txt": [["3", "4", "5", ""]]}
    listed = {(r.report_id, r.header_pos, r.header) for r in headers.collect()}
    assert listed == {
        ("a.csv", 0, "x"), ("a.csv", 1, "y"), ("a.txt", 0, "y"), ("a.txt", 1, "x"), ("a.txt", 2, "z"), ("names.csv", 0, "x"), ("names.csv", 3, "w"),
    }


def test_uploads_are_scanned_once(spark, tmp_path):
    """Everything after the landing reads the landed lines."""
    write(tmp_path / "in", "r.csv", sheet_text(1, 50))
    rows, headers = sheets.read_sheets(spark, str(tmp_path / "in"), "csv")
    for df in (rows, mapping.header_listing(headers)):
        assert not any(str(tmp_path / "in") in f for f in df.inputFiles())
    assert rows.select(F.size("cells").alias("n")).distinct().collect()[0].n == 4


def test_records_are_put_together_once(spark, tmp_path):
    """Rows and headers come from whole records, not each time from the lines."""
    write(tmp_path / "in", "r.csv", sheet_text(1, 50))
    rows, _ = sheets.read_sheets(spark, str(tmp_path / "in"), "csv")
    assert not any("/lines/" in f for f in rows.inputFiles())


def line_batches(rng, sep):
    """Lines of some blocks in file order, cut into batches at any place; and what a walk over them finds."""
    pieces = [sep, '"', '"', '""', "a", "é", " ", sep + '"', '"' + sep]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 40))]
    places = sorted((rng.choice("ab"), rng.randrange(3)) for _ in lines)
    want, block, state = [], None, None
    for place, line in zip(places, lines, strict=True):
        if place != block:
            block, state = place, (False, True)
        after = tuple(csv_records.stays_open(line, inside, sep) for inside in state)
        want.append((*state, *after))
        state = after
    ids, blocks = zip(*places, strict=True)
    table = [pa.array(ids), pa.array(blocks, pa.int64()), pa.array(range(len(lines)), pa.int64()), pa.array(lines)]
    whole = pa.RecordBatch.from_arrays(table, ["report_id", "block", "line_no", "value"])
    cuts = sorted({0, len(lines), *(rng.randrange(len(lines)) for _ in range(3))})
    return [whole.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)], want


@pytest.mark.parametrize("sep", [",", ";", "|", "\t", "^", "]", "-", "\\", ".", "||"])
def test_states_by_running_sums_are_those_of_a_walk(sep):
    rng = random.Random(sep)
    for _ in range(100):
        batches, want = line_batches(rng, sep)
        found = pa.Table.from_batches(list(csv_records._with_states(sep)(iter(batches))))
        assert list(zip(*[c.to_pylist() for c in found.columns[4:]], strict=True)) == want


def test_no_line_is_walked_over_for_its_state(monkeypatch):
    batches, want = line_batches(random.Random(1), ",")
    monkeypatch.setattr(csv_records, "stays_open", None)
    found = pa.Table.from_batches(list(csv_records._with_states(",")(iter(batches))))
    assert list(zip(*[c.to_pylist() for c in found.columns[4:]], strict=True)) == want
