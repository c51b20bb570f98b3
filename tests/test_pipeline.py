"""Packed fields, nested records, drifting schemas and orphan references against brute force."""

import datetime as dt
import json
import random
from collections import defaultdict

import pytest

from findlake.operators import drift, nested, orphans, packed

T0 = dt.datetime(2025, 1, 1)


def day(k):
    return T0 + dt.timedelta(days=k)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


PACKED = [
    (None, []), ("", []), (" \n", []), ("[]", []), ("()", []), ("None", []), ("null", []), ("a", ["a"]), ("a,b", ["a", "b"]), ("a, ,b;", ["a", "b"]), ("a\r\nb\tc", ["a", "b", "c"]),
    ('"a","b","c, d:1"', ["a", "b", "c, d:1"]), ('["a", "the \\"x\\" y:1"]', ["a", 'the "x" y:1']), ("['a', \"r's k:1\"]", ["a", "r's k:1"]), ('"the ""but"" g:1";x', ['the "but" g:1', "x"]),
    ("('a',)", ["a"]), ("{a/b:1,c}", ["a/b:1", "c"]), ("a | b / c", ["a", "b", "c"]), ("x 'y z' w", ["x", "y z", "w"]), ("['say \"hi\" t:1', 'b']", ['say "hi" t:1', "b"]), ("'a''b c',d", ["a'b c", "d"]),
    ("o'neil:1,b", ["o'neil:1", "b"]), ('"open', ["open"]), (",".join(["v"] * 5000), ["v"] * 5000),
]


def test_packed_values(spark):
    df = spark.createDataFrame([(k, t, "clash", 0) for k, (t, _) in enumerate(PACKED)], "id int, packed string, value string, position int")
    got = defaultdict(list)
    for k, p, v in rows_of(packed.unpack(df, "id", "packed")):
        got[k].append((p, v))
    assert {k: v for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, (_, v) in enumerate(PACKED) if v}


def brute_children(osv_id, record):
    out = set()
    items = lambda v: list(enumerate(v)) if isinstance(v, list) else [] if v is None else [(0, v)]
    for f, kind, leaf in (("aliases", "alias", None), ("severity", "severity", "score"), ("references", "reference", "url"), ("credits", "credit", "name")):
        for i, x in items(record.get(f)):
            value = x.get(leaf) if isinstance(x, dict) else x
            if x is not None and value is not None:
                out.add((osv_id, kind, "$", f"{f}[{i}]", str(value)))
    for i, a in items(record.get("affected")):
        if a is None:
            continue
        p = f"affected[{i}]"
        out.add((osv_id, "affected", "$", p, a["package"]["name"]))
        for j, v in items(a.get("versions")):
            if v is not None:
                out.add((osv_id, "version", p, f"{p}.versions[{j}]", str(v)))
        for j, r in items(a.get("ranges")):
            if r is None:
                continue
            q = f"{p}.ranges[{j}]"
            out.add((osv_id, "range", p, q, r["type"]))
            for m, e in items(r.get("events")):
                for key, value in (e or {}).items():
                    out.add((osv_id, "event", q, f"{q}.events[{m}]", f"{key}:{value}"))
    return out


def random_record(rnd, osv_id):
    opt = lambda v: rnd.choice([v, v, v, None, []])
    bare = lambda v: rnd.choice([v, v, v[0] if v else None])
    event = lambda: rnd.choice([{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "1", "fixed": "2"}, None])
    ranges = [{"type": "GIT", "events": bare([event() for _ in range(rnd.randint(1, 3))])} for _ in range(rnd.randint(1, 2))] + [None]
    affected = [{"package": {"name": f"p{k}", "ecosystem": "npm"}, "versions": opt(bare(["1.0", 22, None, "2"])), "ranges": opt(bare(ranges)), "extra": {"deep": [1, {"x": [None]}]}} for k in range(rnd.randint(1, 3))]
    return {"id": osv_id, "aliases": opt(["A", None, "B"]), "severity": opt(bare([{"type": "V3", "score": "s1"}])), "references": opt([{"type": "WEB", "url": "u"}, "v"]), "credits": opt([{"name": "n", "contact": ["c"]}]), "affected": opt(bare([None, *affected]))}


def test_nested_children_match_brute_force(spark):
    rnd = random.Random(1)
    rows, want = [], set()
    for k in range(60):
        record = random_record(rnd, f"O{k}")
        text = json.dumps(record)
        for form in (text, "\n " + json.dumps(record, indent=1), f"[{text}]", json.dumps(text), json.dumps({"osv": record}), json.dumps({"data": {"advisory": record}})):
            if rnd.random() < 0.5:
                rows.append((f"O{k}", form, "clash"))
        rows.append((f"O{k}", text[: len(text) // 2], "clash"))
        if any(r[0] == f"O{k}" and nested.read_records(r[1], "id") for r in rows):
            want |= brute_children(f"O{k}", record)
    rows += [("N", None, "x"), ("N", "", "x"), ("N", "[]", "x"), ("N", "NaN", "x"), (None, "{}", "x")]
    df = spark.createDataFrame(rows, "osv_id string, json string, value string")
    got = rows_of(nested.advisory_children(nested.advisory_triples(df)))
    assert len(got) == len(set(got)) and set(got) == want and want
    assert rows_of(nested.advisory_children(nested.advisory_triples(df.limit(0)))) == []


def test_wrappers_of_any_kind(spark):
    text = json.dumps({"id": "A", "aliases": ["x"]})
    for _ in range(12):  # JSON in a JSON string in a one-key object, twelve times over
        text = json.dumps({"data": json.dumps(json.loads(text))})
    assert nested.read_records(text, "id") == [{"id": "A", "aliases": ["x"]}]
    two = json.dumps([{"id": "A", "n": 1.50}, None, {"meta": {"n": 1}, "one": {"id": "B"}, "more": [{"id": "C"}]}])
    assert [r["id"] for r in nested.read_records(two, "id")] == ["A", "B", "C"]
    assert nested.read_records('{"id": "A", "n": 1.50}', "id") == [{"id": "A", "n": "1.50"}]
    deep = '{"id": "D", "x": ' + "[" * 100_000 + '{"y": -1.5e3}' + "]" * 100_000 + ', "aliases": ["a"]}'
    got = list(nested.triples(nested.read_records(deep, "id")[0], frozenset(["aliases"])))
    assert {(x[3], x[5]) for x in got} == {("id", "D"), ("y", "-1.5e3"), ("", "a")}
    for bad in ("[1", "[1,]", "{,}", '{"a" 1}', "[}", "1 2", "", "[NaN]", "{1:2}", "]", '{"a":1,}', "01", '"a\nb"'):
        with pytest.raises(ValueError):
            nested.decode_deep(bad)
    for good in ("[]", "{}", "[[], {}]", '{"a": [true, false, null, -0.5e+3, "\\u00e9"], "b": {"c": {}}}', " 7 "):
        assert nested.decode_deep(good) == nested._DECODER.decode(good.strip())
    df = spark.createDataFrame([(1, two), (2, "[1"), (3, None), (4, "{}")], "k int, json string")
    assert sorted(r.k for r in nested.unreadable(df, "json", "id").collect()) == [2, 3, 4]


def test_nested_tables_keep_parents(spark):
    record = {"id": "A", "affected": [None, {"package": {"ecosystem": "npm", "name": "x"}, "ranges": [{"type": "GIT", "repo": "r", "events": [{"introduced": "0"}, {"fixed": "1"}]}]}]}
    df = spark.createDataFrame([("A", json.dumps(record))] * 2, "osv_id string, json string")
    tables = nested.advisory_tables(nested.advisory_triples(df))
    assert [(r.parent_path, r.item_path, r.package) for r in tables["affected"].collect()] == [("$", "affected[1]", "x")]
    assert [(r.parent_path, r.item_path, r.repo) for r in tables["range"].collect()] == [("affected[1]", "affected[1].ranges[0]", "r")]
    assert sorted((r.ordinal, r.introduced, r.fixed) for r in tables["event"].collect()) == [(0, "0", None), (1, None, "1")]


def test_drift_report(spark):
    def record(k, **fields):
        return json.dumps({"finding_id": f"F{k}", **fields})

    old = [record(k, file=f"a/{k}.c", line=10 + k, schema_version=1, in_kev=k % 2 == 0, run=[{"run_id": f"r{k}"}], gone=f"g{k}") for k in range(8)]
    new = [record(k, path=f"a/{k}.c", lineno=str(10 + k), version=2, known=int(k % 2 == 0), run={"items": [{"run_id": f"r{k}"}]}, fresh=f"h{k}", late=None) for k in range(4, 12)]
    rows = [("f", "one", T0, n, b) for n, b in enumerate(old + old[:2] + [old[0][:30], "", None, "[1]", "7"])]
    rows += [("f", "two", day(1), n, b) for n, b in enumerate(new)] + [("f", "three", day(2), n, b) for n, b in enumerate(new)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "feed string, file_name string, written_at timestamp_ntz, line_no int, body string, field string")
    got = rows_of(drift.drift_report(df))
    assert got == sorted(
        [("f", "two", "renamed", a, b) for a, b in (("file", "path"), ("line", "lineno"), ("schema_version", "version"), ("in_kev", "known"))]
        + [("f", "two", "retyped", x, x) for x in ("lineno", "known", "run")]
        + [("f", "two", "removed", "gone", "gone"), ("f", "two", "added", "fresh", "fresh"), ("f", "two", "added", "late", "late")]
    )
    table = [json.loads(r.fields) for r in drift.unified(df).where("file_name = 'three'").collect()]
    assert all({"file", "line", "schema_version", "in_kev"} <= set(t) for t in table) and len(table) == 8
    assert rows_of(drift.drift_report(df.limit(0))) == []


def test_unified_columns_of_names_that_come_again(spark):
    def record(k, **fields):
        return json.dumps({"finding_id": f"F{k}", **fields})

    def rename(n):  # a -> b, then a comes back with other values, then b -> c
        return [
            [record(k, a=f"v{k}", n=k, flag=k % 2 == 0, box={"q": [k]}) for k in range(12)],
            [record(k, b=f"v{k}", n=str(k), flag=int(k % 2 == 0), box=json.dumps({"q": [k]})) for k in range(12)],
            [record(k, b=f"v{k}", a=f"w{k * 7}", n=k if k else "no number", flag=k % 2 == 0, box={"q": [k]}) for k in range(12)],
            [record(k, c=f"v{k}", a=f"w{k * 7}", n=k, flag=k % 2 == 0, box={"q": [k]}) for k in range(12)],
        ][n]

    rows = [("f", f"file{n}", day(n), i, b, "clash") for n in range(4) for i, b in enumerate(rename(n) * 2)]
    df = spark.createDataFrame(rows + [("f", "file0", day(0), 0, rename(0)[3], "clash")], "feed string, file_name string, written_at timestamp_ntz, line_no int, body string, record string")
    got = drift.unified(df).collect()
    by = {(r.file_name, r.line_no, r.record): (json.loads(r.fields), r.written) for r in got}
    for n in range(4):
        for k in range(12):
            fields, lost = by[f"file{n}", k, f"F{k}"]
            assert fields["a"] == f"v{k}" and fields["flag"] is (k % 2 == 0) and fields["box"] == {"q": [k]}
            assert fields.get("a@file2") == (f"w{k * 7}" if n > 1 else None)
            assert (fields["n"], lost) == ((k, None) if (n, k) != (2, 0) else (None, '{"n":"no number"}'))
    columns = {r.column_name: r.type for r in drift.unified_columns(*lineage_of(df)).collect()}
    assert columns == {"a": "string", "a@file2": "string", "n": "number", "flag": "boolean", "box": "object"}
    table = drift.typed(drift.unified(df), drift.unified_columns(*lineage_of(df)), "f")
    assert dict(table.dtypes)["n"] == "double" and dict(table.dtypes)["flag"] == "boolean" and table.where("file_name = 'file1' and line_no = 5").first()["n"] == 5.0
    assert drift.unified(df.limit(0)).collect() == []


def lineage_of(df):
    kinds = drift.column_types(drift.fields(df))
    return kinds, drift.lineage(kinds, drift.drift_report(df))


def test_lineage_of_swaps_and_chains():
    import pandas as pd

    def run(*files):
        pdf = pd.DataFrame([{"feed": "f", "file_name": f"x{n}", "ord": n, "fields": p, "renames": [{"field_name": a, "new_name": b} for a, b in r] or None} for n, (p, r) in enumerate(files)])
        return {(r.file_name, r.field): r.column_name for r in drift._lineage(pdf).itertuples()}

    assert run((["a", "b"], []), (["a", "b"], [("a", "b"), ("b", "a")]))["x1", "a"] == "b"  # a swap
    chain = run((["a"], []), (["b"], [("a", "b")]), (["c"], [("b", "c")]), (["c", "b", "a"], []), (["d", "b"], [("c", "d")]))
    assert chain["x2", "c"] == "a" and chain["x3", "b"] == "b" and chain["x3", "a"] == "a@x3" and chain["x4", "d"] == "a" and chain["x4", "b"] == "b"
    back = run((["a"], []), (["z"], []), (["a", "z"], []))
    assert back["x2", "a"] == "a"  # a field that was left out of a file
    assert len(set(run((["a"], []), (["b"], [("a", "b")]), (["a", "b"], []), (["a", "c"], [("b", "c")])).values())) == 2


def test_matching_is_maximal():
    rnd = random.Random(2)
    from itertools import permutations

    for _ in range(200):
        n, m = rnd.randint(1, 4), rnd.randint(1, 4)
        w = [[rnd.choice([0, 0, rnd.random()]) for _ in range(m)] for _ in range(n)]
        size = max(n, m)
        full = [[w[i][j] if i < n and j < m else 0 for j in range(size)] for i in range(size)]
        best = max(sum(full[i][p[i]] for i in range(size)) for p in permutations(range(size)))
        pairs = drift.match(w)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert abs(sum(w[i][j] for i, j in pairs) - best) < 1e-9


@pytest.mark.parametrize("hot", [orphans.HOT, 3])
def test_orphans_match_brute_force(spark, hot):
    rnd = random.Random(3)
    pick = rnd.choice
    keys = ["HOT", "HOT", "HOT", "A", "B", "C", None, " ", f"Z{hot}"]
    parents = [(pick(keys), pick([None, day(rnd.randint(0, 20))]), pick([None, None, day(rnd.randint(0, 25))]), k) for k in range(120)]
    refs = [(k, pick(keys), pick([None, day(rnd.randint(0, 25)), day(rnd.randint(0, 25))]), "x") for k in range(200)]
    p = spark.createDataFrame(parents, "key string, came timestamp_ntz, gone timestamp_ntz, row long")
    r = spark.createDataFrame(refs, "row long, key string, at timestamp_ntz, n string")
    from pyspark.sql import functions as F

    events = orphans.parent_events(p, orphans.cve_key(F.col("key")), F.col("came"), F.col("gone"))
    probes = orphans.probes(r, F.col("row"), orphans.cve_key(F.col("key")), F.col("at"))
    want = []
    for row, key, at, _ in refs:
        if key is None or not key.strip() or at is None:
            continue
        own = [(c, g) for k, c, g, _ in parents if k == key and c is not None]
        if any(c <= at and (g is None or g > at) for c, g in own):
            continue
        want.append((row, at, "missing" if not own else "deleted" if any(c <= at for c, _ in own) else "late"))
    assert rows_of(orphans.orphans(events, probes, hot)) == sorted(want) and want
    assert rows_of(orphans.followed(events, probes, hot, 5)) == sorted(want) == rows_of(orphans.followed(events, probes, hot))
    assert rows_of(orphans.orphans(events.limit(0), probes.limit(0), hot)) == [] == rows_of(orphans.followed(events.limit(0), probes.limit(0), hot))
    last = orphans.snapshots(events, probes).orderBy("month").collect()[-1]
    alive = defaultdict(bool)
    for k, c, g, _ in parents:
        alive[k] |= c is not None and (g is None or g > day(60))
    valid = [(k, at) for _, k, at, _ in refs if k is not None and k.strip() and at is not None]
    assert last.open_orphans == sum(not alive[k] for k, _ in valid)


def test_hash_keys(spark):
    from pyspark.sql import functions as F

    forms = ["ABCDEF123456", " abcdef123456\n", "https://git.example.org/x/commit/abcdef123456", "ab-cd ef123456", None, "", "  "]
    df = spark.createDataFrame([(f,) for f in forms], "h string")
    got = [r.k for r in df.select(orphans.hash_key(F.col("h")).alias("k")).collect()]
    assert got == ["abcdef123456"] * 4 + [None] * 3


def test_orphans_by_batches_equal_the_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from findlake.streaming import references

    rnd = random.Random(9)
    keys = ["A", "B", "C", "D"]
    parents = [(rnd.choice(keys[:3]), day(rnd.randint(0, 20)), rnd.choice([None, day(rnd.randint(0, 25))])) for _ in range(40)]
    refs = [(k, rnd.choice(keys), day(rnd.randint(0, 25))) for k in range(80)]
    p = spark.createDataFrame(parents, "key string, came timestamp_ntz, gone timestamp_ntz")
    events = orphans.parent_events(p, F.col("key"), F.col("came"), F.col("gone"))
    probes = spark.createDataFrame(refs, "row long, key string, at timestamp_ntz")
    log = events.select("key", "at", "kind", "n", F.lit(None).cast("long").alias("row")).unionByName(probes.select("key", "at", F.lit(2).alias("kind"), F.lit(0).alias("n"), "row"))
    for k, (lo, hi) in enumerate(((0, 8), (8, 16), (16, 99))):
        part = log.where((F.col("at") >= F.lit(day(lo)).cast("timestamp_ntz")) & (F.col("at") < F.lit(day(hi)).cast("timestamp_ntz")))
        part.coalesce(1).write.parquet(str(tmp_path / "log" / f"{k}"))
    stream = spark.readStream.schema(references.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "*"))
    # files come in the order of their times; write times rise with k
    q = references.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    settled, still_open = references.report(spark, str(tmp_path / "out"), 2)
    assert rows_of(settled) == rows_of(orphans.orphans(events, probes)) and settled.count()
    assert still_open.first()[0] == orphans.snapshots(events, probes).orderBy(F.desc("month")).first().open_orphans
