import hashlib
import re

from pyspark.sql import functions as F

from tablegrist.llm import exact_dedup as D
from tablegrist.llm.rows import located
from tablegrist.session import new_dir

SCHEMA = "doc_id long, text string, kept string, digest int"
ROWS = [
    (5, "a b", "x", 1), (3, "ab", None, 2), (9, "a\tb\n", None, 3), (1, "ab", None, 4), (7, None, None, 5), (8, "", None, 6),
    (6, "  ", None, 7), (2, "a\xa0b", None, 8), (4, "z" * 300_000, None, 9), (10, "z" * 300_000, None, 9),
    (None, "ab  \n\n", None, 1), (11, "q", None, 1), (11, "q", None, 1),
]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r)
    out = []
    for text, group in groups.items():
        keep = max(group, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))
        out += [(r[0], keep[0], len(group), hashlib.sha256(text.encode()).hexdigest()) for r in group]
    return sorted(out, key=str)


def result(df, **options):
    return D.grouped(located(df), **options).select(
        "id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("d"), "kept"
    ).collect()


def test_groups_against_brute_force(spark):
    got = result(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted((tuple(r)[:4] for r in got), key=str) == expected(ROWS)
    # One row of each group stays, also where an id repeats.
    assert sum(r.kept for r in got) == len({normal(r[1]) for r in ROWS})
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 2, "0"))
    got = result(spark.createDataFrame(ROWS, SCHEMA), digest=weak)
    want = [x[:3] for x in expected(ROWS)]
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=str) == sorted(want, key=str)


def test_rows_that_stay_have_all_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = D.deduplicated(df)
    assert out.columns == df.columns
    assert out.count() == len({normal(r[1]) for r in ROWS})


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_state_outlives_a_run(spark):
    log, state = new_dir(spark, "log"), new_dir(spark, "state")
    for part in (ROWS[:4], ROWS[4:]):
        D.append_log(located(spark.createDataFrame(part, SCHEMA)), log, "doc_id", "text", D.sha256)
        found = D.update_state(spark, log, state)
    sizes = {bytes(r.digest).hex(): r.group_size for r in found.collect()}
    assert sizes == {d: n for _, _, n, d in expected(ROWS)}
    # A run without new lines leaves the state as it is.
    assert {bytes(r.digest).hex(): r.group_size for r in D.update_state(spark, log, state).collect()} == sizes
