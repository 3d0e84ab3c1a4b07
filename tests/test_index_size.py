"""What an index and its searches move and hold."""

from itertools import groupby

import pyarrow as pa
import pyarrow.parquet as pq

from tarnfield.operators import lexical as L
from tests.test_lexical import corpus


def test_entries_are_written_where_they_are_made(spark, tmp_path):
    """A task's shards stand in a file of its own, one after another, each in order of field and term: no exchange, no sort."""
    _, chunks = corpus(spark, 60)
    L.build_index(chunks.repartition(3), f"{tmp_path}/ix", shard_chunks=7)
    files = [pq.read_table(f).to_pylist() for f in (tmp_path / "ix/entries").glob("*.parquet")]
    owners = [[shard for shard, _ in groupby(rows, lambda r: r["shard"])] for rows in files]
    assert len(files) == 3 and all(len(own) >= 3 for own in owners)
    assert len(flat := [x for own in owners for x in own]) == len(set(flat))
    for rows in files:
        for _, shard in groupby(rows, lambda r: r["shard"]):
            keys = [(r["field"], r["term"].encode()) for r in shard]
            assert keys == sorted(keys)


def test_what_waits_for_a_shard_keeps_no_batch():
    """Rows left of a batch are copied, so the batch can go while the next one comes."""
    batch = lambda k: pa.RecordBatch.from_pydict({"chunk_id": [f"{k}-{n}" for n in range(3000)], "body": ["x" * 1000] * 3000})
    pieces = list(L._pieces(iter([batch(0), batch(1)]), 2500))
    assert [p.num_rows for p in pieces] == [3000, 3000]
    pieces = list(L._pieces(iter([batch(0), batch(1)]), 2048))
    assert [p.num_rows for p in pieces] == [2048, 952 + 1024 + 1024, 952]
    left = pieces[1].slice(0, 952)
    assert left.column("chunk_id").to_pylist()[0] == "0-2048" and sum(b.size for b in left.column("body").chunk(0).buffers() if b) < 1_100_000
    assert sum(p.num_rows for p in L._pieces(iter([batch(0)] * 3), 1 << 20)) == 9000


def test_positions_are_asked_for_phrases_alone(spark, tmp_path, monkeypatch):
    """Terms that stand alone come without positions, by a filter and by a join."""
    _, chunks = corpus(spark)
    index = L.build_index(chunks, f"{tmp_path}/ix")
    phrases = {L.Phrase(("alpha",)), L.Phrase(("go",), prefix=True), L.Phrase(("foo", "bar"))}
    whole = {r["term"]: r["cf"] for r in index.terms.collect()}
    for most in (200, 0):
        monkeypatch.setattr(L, "PRUNED_TERMS", most)
        rows = L._asked(index, phrases).collect()
        size = {t: sum(len(r["data"]) - 12 * r["n"] for r in rows if r["term"] == t) for t in ("alpha", "foo", "bar")}
        assert {r["term"] for r in rows} == {"alpha", "foo", "bar", "go"}
        assert size == {"alpha": 0, "foo": 4 * whole["foo"], "bar": 4 * whole["bar"]}


def test_local_rows_need_no_python_workers(spark, tmp_path, monkeypatch):
    """Hits that were ranked on the driver and the ids of queries are local tables, not pickled ones."""
    _, chunks = corpus(spark)
    index = L.build_index(chunks, f"{tmp_path}/ix")
    asked = spark.range(1).selectExpr("id AS query_id", "'alpha' AS text")
    for few in (500, 0):
        monkeypatch.setattr(L, "NEAR_QUERIES", few)
        hits = L.search_index(asked, index, 3)
        assert "ExistingRDD" not in hits._jdf.queryExecution().toString()
        assert [r["rank"] for r in hits.orderBy("rank").collect()] == [1, 2, 3] and hits.schema["query_id"].dataType.simpleString() == "bigint"
    dates = spark.sql("SELECT DATE '2024-01-01' AS query_id, 'alpha' AS text")
    assert {str(r["query_id"]) for r in L.search_index(dates, index, 3).collect()} == {"2024-01-01"}
