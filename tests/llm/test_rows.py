"""Mixing, tool calls, archives, the pipeline and the registered queries."""

import hashlib
import io
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, empty, lowered, odd_documents, words
from test_similar import kept

from rasterloom.llm import mixing as M
from rasterloom.llm import tool_calls as C
from rasterloom.llm import toxicity as T
from rasterloom.llm import warc as W
from rasterloom.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations".split()


# Mixing


def targets(sizes):
    """By rounds, as the rule is worded."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in free)
        share = {s: (total - sum(fixed.values())) * weight[s] / w for s in free} if w else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 0, None: 40}, {"x": 1}, {"a": 10, "b": 10, "c": 10, "d": 1000}, {"é": 3, "z": 900, None: 1, "A": 50}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(rows).collect()}
    want = targets(sizes)
    assert all(got[s] == pytest.approx(want[s], abs=1e-9) for s in sizes)


def test_mix_comes_near_its_targets(spark):
    docs = documents(spark, [(k, "w " * (k * 37 % 300)) for k in range(2000)], lambda k: f"s{min(k % 10, 5)}")
    rows = M.mix(docs).collect()
    per, goal = defaultdict(int), {}
    for r in rows:
        per[r.source] += r.taken
        goal[r.source] = r.target
        rate = r.target / r.source_size
        assert 0 <= r.copies <= 3 and math.floor(rate) <= r.copies <= math.ceil(rate) and r.taken == r.size * r.copies
    assert all(abs(per[s] - goal[s]) < 0.02 * goal[s] for s in goal)
    assert sorted(rows) == sorted(M.mix(docs.repartition(7)).collect())


def test_mix_odd_rows(spark):
    docs = odd_documents(spark)
    rows = M.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((d.doc_id, d.source, len(words(d.text))) for d in docs.collect())
    made = M.mixed_documents(docs)
    assert made.columns == docs.columns and made.count() == sum(r.copies for r in rows)
    assert M.mix(empty(spark)).count() == 0 and M.mixed_documents(empty(spark)).count() == 0


def test_rows_without_ids_are_dealt_to_cells(spark):
    docs = documents(spark, [(None, f"word {k}") for k in range(1000)])
    table = M._cells(docs.select("source", M.F.lit(2).cast("long").alias("size"), M.F.conv(M.F.substring(M.F.md5("text"), 1, 8), 16, 10).cast("long").alias("dealt")), 32)
    assert table.groupBy("block").count().agg(M.F.max("count")).first()[0] < 80
    rows = M.mix(docs).collect()
    assert len(rows) == 1000 and sum(r.taken for r in rows) == 2000


def test_many_sources(spark):
    sizes = {f"s{k}": (k * 7919) % 400 for k in range(3000)} | {None: 9}
    want = targets(sizes)
    got = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)).collect()
    assert all(r.target == pytest.approx(want[r.source], abs=1e-6) for r in got) and len(got) == 3001


# Tool calls

SCHEMAS = {"add": {"x": ("integer", True), "y": ("number", True)}, "go": {"to": ("array", True), "z": ("object", False)}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "add", '{"y": 2.50, "x":1}'), (1, 1, "b", "add", '{"x":"$a","y":2}'), (1, 2, "c", "go", '{"to":["$b","q"],"z":{"k":[1, 2],"a":null}}'), (1, 3, "d", "go", '{"to":"$e"}'),
            (1, 4, "e", "go", '{"to":"$d"}'), (1, 5, "f", "go", '{"to":["$d"]}'), (2, 0, "a", "nope", "{}"), (2, 1, "b", "add", "{bad"), (2, 2, None, "add", None), (2, 3, "g", "add", '{"x":1,"y":2,"w":3}'),
            (2, 4, "h", "add", '{"x":1.5,"y":2}'), (2, 5, "i", "add", "[1]"), (2, 6, "j", "go", '{"to":[],"z":null}'), (2, 7, "k", "go", '{"to":["$gone"]}'),
        ],
        "conv_id long, turn int, call_id string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, 6, "a", "r1"), (1, 5, "a", "r0"), (1, 7, "c", None), (3, 0, "x", "lost"), (None, 0, "a", "?")], "conv_id long, turn int, call_id string, content string")
    rows = C.link_tool_calls(calls, results, SCHEMAS).collect()
    got = {(r.conv_id, r.call_id): r for r in rows if r.kind == "call"}
    assert [got[1, k].level for k in "abcdef"] == [0, 1, 2, None, None, None]
    assert [got[1, k].valid for k in "abcf"] == [True, False, True, True]
    assert [got[2, k].valid for k in ("a", "b", None, "g", "h", "i", "j")] == [False] * 7
    assert got[2, "k"].level == 0 and got[1, "a"].linked and got[1, "a"].n_results == 2 and not got[1, "b"].linked
    assert got[1, "c"].record == '{"arguments":{"to":["$b","q"],"z":{"a":null,"k":[1,2]}},"call_id":"c","level":2,"name":"go","result":null}'
    assert got[1, "a"].record == '{"arguments":{"x":1,"y":2.5},"call_id":"a","level":0,"name":"add","result":"r0"}'
    assert Counter(r.conv_id for r in rows if r.kind == "orphan") == {3: 1, None: 1}
    assert C.link_tool_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_long_chain_of_calls(spark):
    calls = spark.createDataFrame([(1, k, f"c{k}", "go", f'{{"to":["$c{k - 1}"]}}') for k in range(6)], "conv_id long, turn int, call_id string, name string, arguments string")
    results = calls.selectExpr("conv_id", "turn", "call_id", "name as content")
    assert {r.call_id: r.level for r in C.link_tool_calls(calls, results, SCHEMAS).collect()} == {f"c{k}": k for k in range(6)}


def levels_of(spark, refs):
    rows = spark.createDataFrame([(c, k, r) for (c, k), r in refs.items()], "conv_id long, call_id string, refs array<string>")
    return {(r.conv_id, r.call_id): r.level for r in C.levels(rows).collect()}


def test_levels_against_brute_force(spark):
    rng = random.Random(5)
    refs = {(1, f"c{k}"): [f"c{k - 1}"] for k in range(500)}
    refs |= {(2, f"d{k}"): sorted({f"d{rng.randrange(max(1, k))}" for _ in range(rng.randrange(3))}) for k in range(60)}
    refs |= {(3, "a"): ["b"], (3, "b"): ["a"], (3, "c"): ["b"], (3, "d"): ["c", "e"], (3, "e"): ["gone"], (3, "f"): ["e", "e"], (3, "g"): ["g"], (3, "h"): ["f", "e", "gone"]}
    refs[2, "d0"] = []
    want = {}
    for _ in range(510):
        for (c, k), own in refs.items():
            up = [(c, x) for x in own if (c, x) in refs]
            if (c, k) not in want and all(x in want for x in up):
                want[c, k] = max((want[x] + 1 for x in up), default=0)
    assert levels_of(spark, refs) == want


def test_what_is_a_reference(spark):
    said = ['{"to":["$a"]}', '{"$a":1}', '{"to":"say \\"$a\\" now"}', '{"to":" $a"}', '{"z":{"k":{"l":"$a"}}}', '{"other":"$a"}']
    calls = spark.createDataFrame([(1, 9, "a", "go", "{}"), *((1, k, f"c{k}", "go", x) for k, x in enumerate(said))], "conv_id long, turn int, call_id string, name string, arguments string")
    results = calls.limit(0).selectExpr("conv_id", "turn", "call_id", "name as content")
    got = lambda names: {r.call_id: r.level for r in C.link_tool_calls(calls, results, SCHEMAS, names).collect()}
    assert got(None) == {"a": 0, "c0": 1, "c1": 0, "c2": 0, "c3": 0, "c4": 1, "c5": 1}
    assert got(["to"]) == {"a": 0, "c0": 1, "c1": 0, "c2": 0, "c3": 0, "c4": 0, "c5": 0}


def test_calls_with_clashing_columns(spark):
    calls = spark.createDataFrame([(1, 0, "a", "go", '{"to":[]}', "x", 7, True)], "conv_id long, turn int, call_id string, name string, arguments string, refs string, level int, valid boolean")
    results = spark.createDataFrame([(1, 1, "a", "r", "y", 3)], "conv_id long, turn int, call_id string, content string, answer string, n_results int")
    (row,) = C.link_tool_calls(calls, results, SCHEMAS).collect()
    assert (row.level, row.valid, row.n_results, row.linked) == (0, True, 1, True)


def test_conversations_with_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (2, 1, "assistant", "x"), (3, 2, None, "y"), (None, 0, "user", "z"), (4, None, "user", "q")], "conv_id long, turn long, role string, text string")
    got = C.link_tool_calls(*C.turns_as_calls(rows), C.TURN_SCHEMAS, ["after"]).collect()
    assert len([r for r in got if r.kind == "call"]) == 4 and len([r for r in got if r.kind == "orphan"]) == 1
    assert {r.conv_id: r.valid for r in got if r.kind == "call"} == {1: False, 3: False, None: True, 4: True}


# Archives


def member(content):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def read(data, step):
    return [x for s in range(0, len(data), step) for _, x in W.RangeReader(io.BytesIO(data), s, min(s + step, len(data)), len(data))]


@pytest.mark.parametrize("step", [1, 37, 1000, 1 << 20])
def test_every_range_reads_its_own_records(step):
    records = [W.record_bytes(k, f"http://a/{k}", bytes(range(256)) * (k % 5) + W.MAGIC * k, "00" * 20, "response", None) for k in range(25)]
    data = b"".join(map(member, records))
    assert read(data, step) == records


def test_false_members_and_damage():
    good = [member(b"WARC/1.1\r\n\r\n" + bytes([k]) * 900) for k in range(3)]
    data = W.MAGIC + b"junk" + good[0] + member(b"not a record") + good[1][:-20] + good[2] + W.MAGIC
    assert [x[-1] for x in read(data, 64)] == [0, 2]


def test_long_gzip_headers_and_members():
    content = W.record_bytes(1, "http://x", bytes(range(256)) * 9000, "00" * 20, "response", None)
    plain = member(content)
    named = plain[:3] + b"\x08" + plain[4:10] + b"n" * 40_000 + b"\0" + plain[10:]  # a file name of 40,000 bytes
    data = member(b"no record") + named + plain
    for step in (1000, 70_000, len(data)):
        assert read(data, step) == [content, content]


def test_round_trip(spark):
    big = "é" * 600
    rows = [(1, "u", big), (5, None, big), (3, "v", big + "x"), (4, "w", "small"), (6, "w", "small"), (7, "http://x y/\n", None), (8, "", ""), (None, "n", "q" * 2000), (9, "n", big), (9, "n", big), (None, "n", "q" * 2000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = W.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {r.page_id: r for r in got}
    assert {k: (by[k].record_type, by[k].refers_to) for k in (1, 5, 9, 3, 4, 6, 7, 8)} == {1: ("revisit", 9), 5: ("revisit", 9), 9: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None)}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        r = by[page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == payload
    assert W.round_trip(pages.limit(0)).count() == 0


# Pipeline and queries


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        before = {r.doc_id: r for r in docs.collect()}
        assert set(ids) <= set(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and all(before[r.doc_id].text == r.text for r in rows)
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in before.values():
                groups[lowered(r.text)].append(r.doc_id)
            assert sorted(ids) == sorted(max(g) for g in groups.values())
        if name == "toxicity":
            judged = T.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert sorted(ids) == sorted(r.doc_id for r in judged if not r.predicted)
        if name == "simhash_dedup":
            every = list(before.values())
            assert sorted(ids) == sorted(every[k].doc_id for k in kept([(r.doc_id, r.text) for r in every]))
        if name == "mixing":
            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            want = con.execute(f"SELECT doc_id, taken // size AS copies FROM ({SQL['op7_mixing']}) WHERE size > 0").fetchall()
            sized = {d for d, _ in want}
            assert Counter(d for d in ids if d in sized) == +Counter(dict(want))
        if name == "encoding":
            assert sorted(ids) == sorted(r.doc_id for r in docs.collect()) and all(r.decoded for r in rows)
        docs = spark.createDataFrame(rows, out.schema)


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_rejects_planted_toxic_documents(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, [(k, f"some plain words about matter {k % 37} " * 4 + ("with scumword in it" if k % 6 == 0 else "")) for k in range(400)])
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(0, 400, 2)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    assert left == {k for k in range(400) if k % 6}


def test_pipeline_odd_rows(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0


def canonical(df):
    df = df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), None)
    fix = lambda x: int(x) if isinstance(x, float) and x.is_integer() else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(map(fix, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["op6_tool_calls", "op7_mixing", "op8_exact_dedup"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Pandas", "PythonUDF", "CartesianProduct", "NestedLoop"))


