"""The stored index and its query expressions against a version that scans texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import lexical as L
from tarnfield.operators import search

WORDS = ["alpha", "bravo", "c", "delta", "x-ray", "foo-bar", "C++", "go", "Élan", "don't", "a.b"]


def corpus(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = [(f"c{k:02d}", f"d{k % 13}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 14))), rng.sample(["alpha", "head"], rng.randrange(3))) for k in range(n)] + [("null", "dn", None, None)]
    return rows, spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, heading_path array<string>")


class Scan:
    """All of it by reading each text."""

    def __init__(self, rows, copies=2):
        self.copies = copies
        self.docs = {r[0]: {0: L.index_tokens(r[2] or ""), 1: L.index_tokens(" ".join(r[3] or []))} for r in rows}
        self.length = {c: copies * len(d[0]) + len(d[1]) for c, d in self.docs.items()}
        self.mean = sum(self.length.values()) / len(self.docs)

    def count(self, c, p):
        total = 0
        for f in p.fields:
            d, n = self.docs[c][f], len(p.tokens)
            same = lambda a, b, last: a.startswith(b) if last and p.prefix else a == b
            total += sum(all(same(d[i + j], p.tokens[j], j == n - 1) for j in range(n)) for i in range(len(d) - n + 1)) * (self.copies if f == 0 else 1)
        return total

    def holds(self, c, tree, phrases):
        if isinstance(tree, int):
            return self.count(c, phrases[tree]) > 0
        name, parts = tree
        got = [self.holds(c, p, phrases) for p in parts]
        return all(got) if name == "and" else any(got) if name == "or" else got[0] and not got[1]

    def raw(self, text):
        q = L.parse_query(text)
        out = {}
        for c in self.docs if q else ():
            if self.holds(c, q.tree, q.phrases):
                s = 0
                for p in q.phrases:
                    tf, df = self.count(c, p), sum(self.count(x, p) > 0 for x in self.docs)
                    x = math.log((len(self.docs) - df + 0.5) / (df + 0.5)) if df else 0
                    s += (x if x > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * self.length[c] / self.mean))
                out[c] = -s
        return out


QUERIES = [
    "alpha", "alpha bravo", "foo-bar", "x-ray go", "C++", "c", "a.b delta", "ÉLAN", "don't", "alpha alpha", "nowhere", "", "   ", "-- ++", "alpha -- bravo", "　alpha bravo", None, "'alpha'", "'heading_path : alpha'", "'text : alpha'", "'alpha AND bravo'",
    "'alpha OR delta'", "'alpha NOT bravo'", "'alpha NOT bravo OR go'", "'(alpha OR bravo) AND go'", "'\"foo bar\"'", "'al*'", "'\"foo b\" *'", "'heading_path : he* OR text : (go NOT alpha)'", "'foo + bar'", "'alpha bravo OR delta'", "''", "'\"\"'", "alpha 'bravo'",
]


@pytest.mark.parametrize("shard", [5, 1000])
def test_index_equals_scan(spark, tmp_path, shard, monkeypatch):
    rows, chunks = corpus(spark)
    index = L.build_index(chunks.repartition(3), f"{tmp_path}/ix", shard_chunks=shard)
    scan = Scan(rows)
    want = {(str(k), c): v for k, q in enumerate(QUERIES) for c, v in scan.raw(q).items()}
    asked = spark.createDataFrame([(str(k), q) for k, q in enumerate(QUERIES)], "query_id string, text string")
    got = {(r.query_id, r.chunk_id): r.raw for r in search.match_scores(asked, index).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = {(q, n): c for q in {q for q, _ in want} for n, (_, c) in enumerate(sorted((round(v, 10), c) for (p, c), v in want.items() if p == q)[:4], 1)}
    # in one pass with names, in one pass and a lookup, by shuffles, with queries block by block, with terms joined
    for changed in ({}, {"NAMED_CHUNKS": 0}, {"NAMED_HITS": 0}, {"BLOCK_QUERIES": 5}, {"NEAR_QUERIES": 3}, {"PRUNED_TERMS": 0}):
        with monkeypatch.context() as m:
            for name, value in changed.items():
                m.setattr(L, name, value)
            assert {(r.query_id, r["rank"]): r.chunk_id for r in search.lexical(asked, index, 4).collect()} == top, changed
            if "BLOCK_QUERIES" not in changed:
                assert [h["chunk_id"] for h in L.find("alpha bravo", index, 4)] == [top[k] for k in sorted(top) if k[0] == "1"]
    # filters come before ranks
    within = spark.createDataFrame([("d1",), ("d2",), ("d1",)], "doc_id string")
    kept = {r[0] for r in rows if r[1] in ("d1", "d2")}
    some = {(q, n): c for q in {q for q, _ in want} for n, (_, c) in enumerate(sorted((round(v, 10), c) for (p, c), v in want.items() if p == q and c in kept)[:4], 1)}
    for hits in (1000, 0):
        monkeypatch.setattr(L, "NAMED_HITS", hits)
        assert {(r.query_id, r["rank"]): r.chunk_id for r in search.lexical(asked, index, 4, within=within).collect()} == some
    df = {r.term: (r.df, r.cf) for r in index.terms.collect()}
    assert df == {t: (sum(t in d[0] for d in scan.docs.values()), sum(d[0].count(t) for d in scan.docs.values())) for t in {t for d in scan.docs.values() for t in d[0]}}


def test_updates_equal_a_new_index(spark, tmp_path):
    rows, chunks = corpus(spark, 60)
    index = L.build_index(chunks.where("doc_id <> 'd4'").repartition(4), f"{tmp_path}/a", shard_chunks=7)
    fresh = [(*r[:2], (r[2] or "") + " new words", r[3]) if r[1] == "d2" else r for r in rows if r[1] not in ("d7", "dn")]
    now = spark.createDataFrame(fresh, "chunk_id string, doc_id string, text string, heading_path array<string>")
    changed = spark.createDataFrame([("d2",), ("d4",), ("d7",), ("dn",)], "doc_id string")
    updated = L.update_index(index, now, changed, f"{tmp_path}/b", shard_chunks=7)
    anew = L.build_index(now, f"{tmp_path}/c")
    asked = spark.createDataFrame([(str(k), q) for k, q in enumerate(QUERIES + ["new words"])], "query_id string, text string")
    result = lambda i: {(r.query_id, r.chunk_id, r.doc_id): round(r.raw, 9) for r in search.match_scores(asked, i).collect()}
    assert result(updated) == result(anew) and updated.stats == anew.stats
    assert {tuple(r) for r in updated.terms.collect()} == {tuple(r) for r in anew.terms.collect()}
    assert updated.entries.select("shard").distinct().count() >= 3
    none = L.update_index(updated, now.where("false"), now.select("doc_id"), f"{tmp_path}/d")
    assert none.stats[0] == 0 and L.find("alpha", none) == []


def test_bad_expressions(spark):
    for text in ("'alpha AND'", "'(alpha'", "'alpha)'", "'other : alpha'", "'text :'", "'OR alpha'", "'alpha ^ b'", "'* alpha'"):
        with pytest.raises(L.BadQuery):
            L.parse_query(text)
    assert L.parse_query("'a' b") is not None and L.parse_query("'") is None


def test_words_are_phrases_of_their_tokens(spark):
    """foo-bar stands for the two words in turn, C++ and x-y are found, and a text in quotes alone reads headings."""
    rows = [("1", "1", "foo bar", None), ("2", "2", "foo then bar", None), ("3", "3", "we write C++ here", None), ("4", "4", "the x-y plane", None), ("5", "5", "nothing", ["foo bar"])]
    index = L.passing_index(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, heading_path array<string>"))
    found = lambda q: sorted(h["chunk_id"] for h in L.find(q, index))
    assert found("foo-bar") == ["1"] and found("foo bar") == ["1", "2"] and found("C++") == ["3"] and found("x-y") == ["4"] and found("c") == []
    assert found("'foo bar'") == ["1", "2", "5"] and found("'heading_path : foo'") == ["5"] and found("nothing foo") == []
    L.release(index)


def test_no_query_reads_texts(spark, tmp_path):
    """Entries are found by their terms: the scan gets the terms as filters, and no exchange carries more than entries."""
    rows, chunks = corpus(spark)
    index = L.build_index(chunks, f"{tmp_path}/ix")
    plan = L._asked(index, {L.Phrase(("alpha",)), L.Phrase(("foo", "bar"))})._jdf.queryExecution().toString()
    assert "EqualTo(term,alpha)" in plan and "Exchange" not in plan and "In(field" in plan or "EqualTo(field,0)" in plan
    assert index.entries.select(F.max("shard")).first()[0] is not None
