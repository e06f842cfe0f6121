import pytest

from weftgraph.operators.badrows import bad_lines, load_lines

GOOD = [
    ("csv", "real", "1,2,3.5", (0, 1, 3.5)), ("csv", "real", ' "1" ,\t"002" , "-.5e1"\r', (0, 1, -5.0)), ("csv", "pattern", "7,2147483647", (6, 2147483646, 1.0)),
    ("mtx", "real", "  4 \t 5  +6. \r", (3, 4, 6.0)), ("mtx", "real", '"4" 5 "1E2"', (3, 4, 100.0)), ("mtx", "pattern", "1\t1", (0, 0, 1.0)), (None, None, "1 2 3", (0, 1, 3.0)),
]
BAD = [
    ("csv", "real", '1,2"3,4', "quoting"), ("csv", "real", '"1,2",3', "columns"), ("csv", "real", '"1,2",3,4', "value"), ("csv", "real", '""1"",2,3', "quoting"), ("csv", "real", '"1"x,2,3', "quoting"),
    ("csv", "real", '"1,2,3', "quoting"), ("mtx", "real", '1 "2"" 3', "quoting"), ("mtx", "real", '1 "2 3" 4', "value"), ("mtx", "real", '"1"2 3', "quoting"),
    ("csv", "real", "1,2", "columns"), ("csv", "real", "1,2,3,", "columns"), ("csv", "real", "1;2;3", "columns"), ("csv", "real", "1 2 3", "columns"), ("mtx", "real", "1,2,3", "columns"), ("mtx", "pattern", "1 2 3", "columns"),
    ("csv", "real", ",2,3", "value"), ("csv", "real", '"",2,3', "value"), ("csv", "real", "0,2,3", "value"), ("csv", "real", "2147483648,2,3", "value"), ("csv", "real", "1,99999999999999999999999,3", "value"),
    ("csv", "real", "-1,2,3", "value"), ("csv", "real", "1.0,2,3", "value"), ("csv", "real", "1,２,3", "value"), ("csv", "real", "1,2,NaN", "value"), ("csv", "real", "1,2,1e999", "value"), ("csv", "real", "1,2,.", "value"),
    ("csv", "real", "1,2,3d", "value"), ("csv", "real", "1,2,0x1F", "value"), ("mtx", "real", "1 2 3", "columns"), ("csv", "real", "1,2,−3", "value"), ("csv", "real", '1,2,"9,9"', "value"),
]
NO_DATA = [None, "", "  \t\r", "% note: \"x", "  %% 1 2 3"]


@pytest.fixture(scope="module")
def lines(make):
    all_ = [(f, k, x) for f, k, x, _ in GOOD] + [(f, k, x) for f, k, x, _ in BAD] + [("csv", "real", x) for x in NO_DATA]
    rows = [(i, 10 + i, f, k, x, "extra") for i, (f, k, x) in enumerate(all_)]
    return make(rows + rows[::2], "line_id long, matrix_id long, fmt string, kind string, line string, _f0 string")


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1}, {"broadcast_bytes": -1, "task_rows": 0}])
def test_bad_lines(lines, options):
    got = [(r.line_id, r.reason) for r in bad_lines(lines, **options).collect()]
    assert sorted(got) == [(len(GOOD) + i, x[3]) for i, x in enumerate(BAD)]


@pytest.mark.parametrize("task_rows", [0, 1_000_000])
def test_good_lines(lines, task_rows):
    got = {r.line_id: (r.row, r.col, r.value) for r in load_lines(lines, task_rows=task_rows).collect()}
    assert got == {i: x[3] for i, x in enumerate(GOOD)}


def test_faults_are_named(lines):
    got = {r.line_id: r.fault for r in bad_lines(lines).collect()}
    at = lambda text: next(i for i, x in enumerate(BAD) if x[2] == text) + len(GOOD)
    assert got[at("0,2,3")] == "row: out of range" and got[at("1,2,1e999")] == "value: not finite" and got[at("1,2")] is None


def test_long_lines_and_nothing(make):
    schema = "line_id long, matrix_id long, fmt string, kind string, line string"
    long = [(1, 1, "csv", "real", ",".join(["1"] * 200_000)), (2, 1, "mtx", "real", '"1" ' * 100_000), (3, 1, "csv", "real", '"' * 300_000), (4, 1, "csv", "real", " " * 300_000 + "1,2,3"),
            (5, 1, "csv", "real", "1" + " " * 300_000 + "x,2,3"), (6, 1, "mtx", "real", "1 2 3" + "\r" * 300_000 + "x")]
    assert {r.line_id: r.reason for r in bad_lines(make(long, schema)).collect()} == {1: "columns", 2: "columns", 3: "quoting", 5: "value", 6: "value"}
    assert bad_lines(make([], schema)).count() == load_lines(make([], schema)).count() == 0
