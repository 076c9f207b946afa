import hashlib
import re

from itinera.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, keep_id long, _digest string"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    return {(d, min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows}


def test_equal_to_brute_force_with_a_hot_group(spark):
    rows = [(i, "hot  text") for i in range(300, 500)] + [(i, f"own {i}") for i in range(300)]
    rows += [(500, "hot\ttext"), (501, None), (502, ""), (503, " "), (504, "own \x0b7"), (505, "own\u00a07"), (506, "x" * 200_000)]
    got = exact_dedup(spark.createDataFrame([(*r, 1, "d") for r in rows], SCHEMA), support=0.01).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(rows)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a")] * 3 + [(None, "a"), (None, "b"), (2, "b")] + [(i, f"t{i}") for i in range(10, 30)]
    for support in (0.001, 0.05):
        got = exact_dedup(spark.createDataFrame([(*r, 1, "d") for r in rows], SCHEMA), support=support).collect()
        kept = [r.doc_id for r in got if r.kept]
        assert sorted(kept) == [1, 2, *range(10, 30)] and len(got) == len(rows)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
