import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablegrist.sources import folder as F


def inside_by_characters(line, inside):
    """The state behind a line, character by character."""
    state = "quoted" if inside else "start"
    for c in line:
        if state == "quoted":
            state = "quote" if c == '"' else "quoted"
        elif state == "quote":
            state = "quoted" if c == '"' else "start" if c == "," else "plain"
        elif c == ",":
            state = "start"
        elif state == "start":
            state = "quoted" if c == '"' else "plain"
    return state == "quoted"


@settings(max_examples=500, deadline=None)
@given(st.text('ab,"', max_size=14), st.booleans())
def test_states_of_lines(line, inside):
    assert F.ends_inside(line, inside) == inside_by_characters(line, inside)


def expected_records(text):
    """Records of a file in the order of its lines."""
    out, open_, inside = [], [], False
    for line in text.splitlines():
        was, inside = inside, inside_by_characters(line, inside)
        if was or inside:
            open_.append(line)
            if not inside:
                out.append("\n".join(open_))
                open_ = []
        elif line:
            out.append(line)
    return [line for line in text.splitlines() if line] if open_ else out


@pytest.fixture
def tiny_splits(spark):
    """Blocks of a few dozen bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("most", [100_000, 0])
def test_records_over_blocks(spark, tmp_path, tiny_splits, monkeypatch, most):
    monkeypatch.setattr(F, "BROADCAST_BLOCKS", most)
    rng = random.Random(4)
    texts = {}
    for k in range(6):
        out = io.StringIO()
        rows = csv.writer(out, lineterminator="\n")
        for i in range(40):
            rows.writerow([i, rng.choice(["plain", 'with "quotes"', "two\nlines", "long\n\n" + "x\n" * rng.randrange(60), "a,b"]), 5])
        texts[f"f{k}.csv"] = out.getvalue()
    texts["open.csv"] = 'a,b\n1,"never closed\n2,x\n3,y\n' + "4,z\n" * 30
    texts["empty.csv"] = ""
    texts["inch.csv"] = 'size,n\n5" pipe,1\n6" pipe,2\n"7"" pipe",3\n'
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    lines = F.text_lines(spark.read.text(str(tmp_path)))
    assert lines.select("file", "block").distinct().count() > 60
    got = {}
    for r in F.csv_records(lines).collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["ordinal"], r["value"]))
    for name, text in texts.items():
        assert sorted(got.get(name, [])) == list(enumerate(expected_records(text))), name


def test_scan(spark, tmp_path):
    """Title rows, one header in several files, types by file, line breaks."""
    (tmp_path / "a.csv").write_text('Report,,\n,,\nname,n,note\nx,1,"line one\nline ""two"""\ny,2,\n')
    (tmp_path / "b.csv").write_text("name,n,note\nz,3,c\n")
    (tmp_path / "c.csv").write_text("name,n,note\nz,three,c\nw,four,d\n,,\n")
    (tmp_path / "d.csv").write_text("k,v\n1,2.5\n2,$3\n")
    (tmp_path / "e.csv").write_text("k,v\n")
    (tmp_path / "f.csv").write_text("")
    scan = F.scan_tables(spark, str(tmp_path))
    files = {r["file"].rsplit("/", 1)[-1]: r for r in scan.files.collect()}
    assert set(files) == {"a.csv", "b.csv", "c.csv", "d.csv"} and len(scan.groups) == 3
    assert files["a.csv"]["group"] == files["b.csv"]["group"] != files["c.csv"]["group"]
    assert files["c.csv"]["rows_dropped"] == 1 and files["d.csv"]["numeric_coerced"] == "k, v"

    def rows(name):
        df = scan.groups[files[name]["group"]].df
        return [tuple(r)[1:] for r in df.filter(df[F.SOURCE].endswith(name)).orderBy(F.ORDINAL).collect()]

    assert rows("a.csv") == [("x", 1, 'line one\nline "two"', 0), ("y", 2, None, 1)]
    assert rows("b.csv") == [("z", 3, "c", 0)]
    assert rows("c.csv") == [("z", "three", "c", 0), ("w", "four", "d", 1)]
    assert rows("d.csv") == [(1, 2.5, 0), (2, 3.0, 1)]


def test_nothing_to_scan(spark, tmp_path):
    (tmp_path / "e.csv").write_text("k,v\n")
    assert F.scan_tables(spark, str(tmp_path)) is None
