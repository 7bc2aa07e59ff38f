import duckdb
import pytest

from pagemill.llm.catalog import op6_line_dedup
from pagemill.llm.linededup import SQL, dedup_lines

from .conftest import ODD


def brute(rows):
    """The text left of each distinct row, by a plain scan in order of place."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[doc_id, text] = None
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(full) - 2):
            window = tuple(lines[i] for i in full[k : k + 3])
            if window in seen:
                gone |= set(range(full[k], full[k + 2] + 1))
            seen.add(window)
        out[doc_id, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("rows", [
    [(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\ny"), (3, "a\nb"), (None, "a\nb\nc"), (4, "b\nc\nd\na\nb\nc")],
    [(1, "z\nz\nz\nz\nz"), (1, "z\nz\nz\nz\nz"), (2, "z\nz\nz"), (3, "")],
    [(i, f"head {i}\np\nq\nr\ntail {i}") for i in range(300)] + [(999, "p\nq\nr\n" * 20_000)],
    [(i, t) for i, t in ODD if i != 4],
    [],
])
def test_against_plain_scan(make, rows):
    got = dedup_lines(make(rows)).select("row.doc_id", "row.text", "text").toDF("doc_id", "was", "now").collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), str(r.was), str(r.now)) for r in got) == sorted((str(i), str(t), str(want[i, t])) for i, t in rows)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(f"select doc_id, text, n_lines, n_removed from ({SQL}) order by doc_id").fetchall()
    assert [tuple(r) for r in op6_line_dedup(spark, sf).orderBy("doc_id").collect()] == want
    assert sum(r[3] for r in want) > 0


def test_tied_ids_have_a_defined_order(make):
    rows = [(4, "a\nb\nc"), (4, "a\nb\nc\nd")]
    now = sorted(r.text for r in dedup_lines(make(rows)).collect())
    assert now in (["", "a\nb\nc\nd"], ["a\nb\nc", "d"])


def test_no_python_on_the_main_path(spark, sf):
    plan = op6_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
