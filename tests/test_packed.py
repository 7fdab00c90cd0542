import pyarrow as pa
import pytest

from pagewright.operators.packed import split_packed, unpack_values

CASES = [
    ("freshly painted funicular, the beekeeper", ["freshly painted funicular", "the beekeeper"]),
    ("«cold, but the cook was kind»\tlost the rucksack\t“we waited; the postman did not”", ["cold, but the cook was kind", "lost the rucksack", "we waited; the postman did not"]),
    ('"a so-called ""mill""", \'pear | line\', „cheerful, but kind“', ['a so-called "mill"', "pear | line", "cheerful, but kind"]),
    ('6" of herring, the cook\'s hat,  , x', ['6" of herring', "the cook's hat", "x"]),
    ('["a so-called \\"bakery\\"", "b, c"]', ['a so-called "bakery"', "b, c"]),
    ("we waited\\; he did not; nettle pie\\, again", ["we waited; he did not", "nettle pie, again"]),
    ("the 'steep' hall\n \nhalf-day/full-day library|", ["the 'steep' hall", "half-day/full-day library"]),
    ("'the baker's hat, blue';b", ["the baker's hat, blue", "b"]),
    ("didn't see it | 'we waited; no'", ["didn't see it", "we waited; no"]),
    ('"open, never closed', ['"open', "never closed"]),
    ("", []),
    (None, []),
    (" \t ", []),
    ("a；b、c • d", ["a", "b", "c", "d"]),
]


@pytest.mark.parametrize("field, expected", CASES)
def test_values(field, expected):
    assert split_packed(pa.array([field], pa.string())).to_pylist() == [expected]


def test_batch_is_the_same_as_single_fields():
    fields = [f for f, _ in CASES] * 3
    assert split_packed(pa.array(fields, pa.string())).to_pylist() == [e for _, e in CASES] * 3


@pytest.mark.parametrize(
    "field, expected",
    [
        ('["2022-03-16", "a-2011#0002"]', ["2022-03-16", "a-2011#0002"]),
        ("2008-08-06 / b-2010#0007/0 or NONE", ["2008-08-06", "b-2010#0007/0", "NONE"]),
        ('"v-2017#r0001/2\t2022-05-06"', ["v-2017#r0001/2", "2022-05-06"]),
        ("[2016-04-09\n\"1999-05-03\",]", ["2016-04-09", "1999-05-03"]),
    ],
)
def test_tokens(field, expected):
    assert split_packed(pa.array([field]), tokens=True).to_pylist() == [expected]


def test_rows(spark):
    df = spark.createDataFrame([(1, "SAYS: a, b", "z"), (1, "SAYS: a, b", "z"), (2, None, "z"), (3, "x" * 50000, "z")], "id bigint, says string, value string")
    rows = sorted(map(tuple, unpack_values(df, "id", "says", opening="says").collect()))
    assert rows == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (3, 1, "x" * 50000)]
    assert unpack_values(df.limit(0), "id", "says").count() == 0


def test_code_points_of_the_buffer():
    import numpy as np
    import pyarrow as pa

    from pagewright.operators.packed import _code_points

    texts = ["", "aé", "山🦉", "Ω", "", "߿ࠀ￿\U00010000\U0010ffff"]
    want = [ord(c) for c in "".join(texts)]
    assert _code_points(pa.array(texts, pa.large_string())).tolist() == want
    assert _code_points(pa.array(["zz", *texts], pa.large_string()).slice(1)).tolist() == want
    assert not len(_code_points(pa.array([], pa.large_string()))) and np.array(want).max() == 0x10FFFF
