import hashlib

import pytest

from odd_rows import ROWS, odd_documents
from switchyard.llm import common
from switchyard.llm import sharding as S


def brute(rows, limit):
    """Split one bucket after another, as a directory does."""
    seen, items = {}, []
    for doc_id, size in sorted(((r[0], len((r[1] or "").encode())) for r in rows), key=lambda x: (str(x[0]), x[1])):
        nth = seen[doc_id] = seen.get(doc_id, 0) + 1
        name = "null" if doc_id is None else str(doc_id)
        digest = hashlib.md5((name + (f"#{nth}" if nth > 1 else "")).encode()).hexdigest()
        items.append((doc_id, nth, size, f"{int(digest[:15], 16):060b}"))
    done, work = [], [("", items)] if items else []
    while work:
        prefix, held = work.pop()
        total = sum(i[2] for i in held)
        if total <= limit or len(prefix) == 60:
            done += [(i[0], i[1], i[2], prefix or "*", len(prefix), total, len(held), total > limit) for i in held]
        else:
            for bit in "01":
                part = [i for i in held if i[3][len(prefix)] == bit]
                if part:
                    work.append((prefix + bit, part))
    return sorted(done, key=str)


@pytest.mark.parametrize("limit", [40, 200, 300_000, 1 << 30])
def test_odd_rows_split_as_a_directory_does(odd, limit):
    got = sorted(map(tuple, S.assign_shards(odd, limit=limit).collect()), key=str)
    assert got == brute(ROWS, limit)


def test_one_id_for_many_rows(spark):
    rows = [(7, "x" * 50, *[None] * 7)] * 60 + [(i, "y" * 30, *[None] * 7) for i in range(40)]
    got = sorted(map(tuple, S.assign_shards(odd_documents(spark, rows), limit=300).collect()), key=str)
    assert got == brute(rows, 300) and all(r[5] <= 300 for r in got)


def test_more_copies_of_a_row_than_one_array_lists(spark, monkeypatch):
    monkeypatch.setattr(common, "STRIDE", 16)
    rows = [(None, "z" * 9, *[None] * 7)] * 50 + [(7, "x" * 50, *[None] * 7)] * 33
    got = sorted(map(tuple, S.assign_shards(odd_documents(spark, rows), limit=300).collect()), key=str)
    assert got == brute(rows, 300)


def test_empty_table(nothing):
    assert S.assign_shards(nothing).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = odd_documents(spark, [(i, "word " * (i % 40), "en", "a", i, None, "x", 1, "d") for i in range(300)])
    S.write_shards(docs, str(tmp_path / "shards"), limit=2000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(300)) and set(docs.columns) < set(back.columns)


def test_written_shards_hold_repeated_and_null_ids_once(spark, tmp_path):
    rows = [(7, "x" * (i % 3 * 20), *[None] * 7) for i in range(60)] + [(None, "z" * 9, *[None] * 7)] * 50
    rows += [(i, "y" * 30, *[None] * 7) for i in range(20)]
    docs = odd_documents(spark, rows).repartition(5)
    S.write_shards(docs, str(tmp_path / "shards"), limit=300)
    back = spark.read.schema(docs.schema.add("shard", "string")).parquet(str(tmp_path / "shards")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    got = sorted(((r.doc_id, len(r.text), r.shard) for r in back), key=str)
    assert got == sorted(((r[0], r[2], r[3]) for r in brute(rows, 300)), key=str)
