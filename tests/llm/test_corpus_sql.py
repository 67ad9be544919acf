"""The SQL twins of corpus queries on rows with nulls, copies, non-ASCII texts and few words."""

import random

import duckdb
import pandas as pd
import pytest

from hinode.llm.near_dedup import near_duplicates
from hinode.llm.oracles import NEAR_DUPLICATES, REPEATED_BYTES
from hinode.llm.suffixes import remove_repeats


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [f"wörd{rng.randrange(500)}" for _ in range(150)]
    near = base[:70] + ["changed"] + base[71:]
    far = base[:60] + [f"other{rng.randrange(500)}" for _ in range(90)]
    shared = " ".join(f"passage{i}é" for i in range(60))
    texts = [" ".join(base), " ".join(near), " ".join(far), " ".join(base).upper(), f"head {shared} tail", f"{shared} and {shared}", None, "", " \t\n", "three Words only", "three words\tonly", "x" * 900]
    return [*enumerate(texts), (None, "alone without an id here"), (None, " ".join(base)), (7, "repeated id with its own text")]


def ordered(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize(
    ("operator", "sql", "columns"),
    [(near_duplicates, NEAR_DUPLICATES, ["doc_id", "n_shingles", "component_id", "kept"]), (remove_repeats, REPEATED_BYTES, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])],
)
@pytest.mark.parametrize("empty", [False, True])
def test_results_are_those_of_the_sql(spark, rows, operator, sql, columns, empty):
    table = [] if empty else rows
    found = operator(spark.createDataFrame(table, "doc_id long, text string")).select(*columns).collect()
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"doc_id": pd.array([r[0] for r in table], dtype="Int64"), "text": pd.array([r[1] for r in table], dtype="string")}))
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM given")
    said = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert ordered(found) == ordered(said)
