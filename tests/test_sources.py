"""Readers, manifest parsers, sinks and streams on small fixtures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from findlake.sources import manifests, readers, sinks
from findlake.streaming import events


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(folder, **files):
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_text(content)
    return str(folder)


def test_json_readers(spark, tmp_path):
    d = write(tmp_path, a__json='[{"id": 1}]', b__json='{"findings": [{"id": 2}, {"id": 3}]}', c__json='{"results": [{"id": 4}]}', d__json='{"x": NaN}', e__json="{bad")
    got = readers.findings(spark, d).select(F.try_variant_get("finding", "$.id", "int").alias("id"))
    assert [r.id for r in got.orderBy("id").collect()] == [1, 2, 3, 4]
    (tmp_path / "l").mkdir()
    (tmp_path / "l/x.jsonl").write_text('{"a": 1}\n\nnot\n{"a": 2}\n{"a": ')
    assert rows_of(readers.jsonl(spark, str(tmp_path / "l"), "a int")) == [(1,), (2,)]
    df = spark.createDataFrame([('{"a": 1 /* one */ // two\n}',)], "t string")
    assert df.select(readers.jsonc(F.col("t"), "a int")["a"]).first()[0] == 1
    missing = readers.or_empty(lambda: readers.jsonl(spark, str(tmp_path / "none"), "a int"), "a int", spark)
    assert missing.count() == 0


def test_sarif_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("run", "r1", "error", "m", "a.c", 3), ("run", "r1", "note", 'q"\n', "b.c", None), ("run", "r2", "error", None, "a.c", 1)], "run string, rule string, level string, message string, uri string, line int")
    doc = sinks.sarif(rows, "run", "tool").first().document
    parsed = json.loads(doc)
    assert [r["id"] for r in parsed["runs"][0]["tool"]["driver"]["rules"]] == ["r1", "r2"]
    (tmp_path / "x.sarif").write_text(doc)
    back = readers.sarif_results(spark, str(tmp_path))
    assert sorted((r.rule, r.uri, r.start_line or 0) for r in back.collect()) == [("r1", "a.c", 3), ("r1", "b.c", 0), ("r2", "a.c", 1)]
    flow = {"runs": [{"results": [{"ruleId": "r", "codeFlows": [{"threadFlows": [{"locations": [{"location": {"physicalLocation": {"artifactLocation": {"uri": u}, "region": {"startLine": k}}}} for k, u in enumerate("abc")]}]}]}]}]}
    (tmp_path / "y.sarif").write_text(json.dumps(flow))
    (path,) = readers.dataflows(readers.sarif_results(spark, str(tmp_path / "y.sarif"))).collect()
    assert (path.source.uri, path.sink.uri, [b.uri for b in path.between]) == ("a", "c", ["b"])


def test_coverage_readers(spark, tmp_path):
    lcov = "TN:\nSF:a.c\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.c\nDA:7,1\n"
    gcov = "        -:    0:Source:a.c\n        1:    3:int x;\n    #####:    4:y\n       2*:    5:z\n"
    py = json.dumps({"files": {"m.py": {"executed_lines": [1, 2]}}})
    func = "Function 'f'\nLines executed:50.00% of 2\n\nFunction 'g'\nLines executed:0.00% of 3\n\nFile 'a.c'\nLines executed:20.00% of 5\n"
    for name, content in (("l", lcov), ("g", gcov), ("p", py), ("f", func)):
        (tmp_path / name).write_text(content)
    at = lambda n: str(tmp_path / n)
    assert rows_of(readers.lcov(spark, at("l"))) == [("a.c", 1), ("b.c", 7)] and rows_of(readers.gcov(spark, at("g"))) == [("a.c", 3), ("a.c", 5)]
    assert rows_of(readers.coverage_py(spark, at("p"))) == [("m.py", 1), ("m.py", 2)]
    assert rows_of(readers.gcov_functions(spark, at("f"))) == [("a.c", "f", True), ("a.c", "g", False)]
    df = spark.createDataFrame([(lcov,), (gcov,), (py,), ("x",)], "t string")
    assert [r[0] for r in df.select(readers.coverage_format(F.col("t"))).collect()] == ["lcov", "gcov", "coverage.py", None]


def test_package_and_table_readers(spark, tmp_path):
    (tmp_path / "s").write_text("Package: a\nStatus: install ok installed\nVersion: 1\nArchitecture: amd64\nDescription: x\n more\n\nPackage: b\nStatus: deinstall ok config-files\nVersion: 2\n\n")
    assert rows_of(readers.dpkg(spark, str(tmp_path / "s"))) == [("a", "1", "amd64")]
    (tmp_path / "k").write_text("C:Q1\nP:musl\nV:1.2\nA:x86\n\nP:zlib\nV:1.3\n\n")
    assert rows_of(readers.apk(spark, str(tmp_path / "k"))) == [("musl", "1.2", "x86"), ("zlib", "1.3", None)]
    (tmp_path / "e.csv").write_text("# test, category, real, cwe\nBench01,sqli,true,89\nBench02,xss,false,79\nOther,x,true,1\n")
    assert rows_of(readers.expected_results(spark, str(tmp_path / "e.csv"), "Bench")) == [("Bench01", "sqli", True, 89), ("Bench02", "xss", False, 79)]
    (tmp_path / "m.json").write_text(json.dumps({"layers": [{"digest": "d1", "size": 5}, {"digest": "d2", "size": 6}]}))
    assert [(r.ordinal, r.digest) for r in readers.image_layers(spark, str(tmp_path / "m.json")).collect()] == [(0, "d1"), (1, "d2")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.json", "{}")
        z.writestr("b.txt", "t")
    assert [(r.member, r.text) for r in readers.zip_members(spark, str(tmp_path / "z.zip"), ".json").collect()] == [("in/a.json", "{}")]


def test_text_table_functions(spark):
    patch = "--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,3 @@ int f(int a)\n+x\n@@ -9 +10 @@\n"
    docker = "# c\nFROM a:1 \\\n  AS b\nrun x\n"
    header = "#define MAX 3\nint f(int a);\nstatic char *g(void) {\n"
    df = spark.createDataFrame([(patch, docker, header)], "p string, d string, h string")
    row = df.select(readers.hunks(F.col("p")).alias("k"), readers.diff_functions(F.col("p")).alias("f"), readers.dockerfile(F.col("d")).alias("d"), readers.definitions(F.col("h")).alias("h")).first()
    assert [tuple(x) for x in row.k] == [(1, 2, 1, 3), (9, 1, 10, 1)] and row.f == ["f"] and row.h == ["MAX", "f", "g"]
    assert [(x.opcode, " ".join(x.args.split())) for x in row.d] == [("FROM", "a:1 AS b"), ("RUN", "x")]


MANIFESTS = {
    "package.json": ('{"dependencies": {"a": "^1.0"}, "devDependencies": {"@s/b": "2.0.0"}}', [("npm", "a", "^1.0", "range"), ("npm", "@s/b", "2.0.0", "exact")]),
    "package-lock.json": ('{"packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}', [("npm", "a", "1.0.0", "exact"), ("npm", "@s/b", "2.0.0", "exact")]),
    "v1/package-lock.json": ('{"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0"}}}}}', [("npm", "a", "1.0.0", "exact"), ("npm", "b", "2.0.0", "exact")]),
    "yarn.lock": ('# yarn\n\na@^1.0, a@^1.1:\n  version "1.2.0"\n\n"@s/b@npm:^2":\n  version: 2.0.0\n', [("npm", "a", "1.2.0", "exact"), ("npm", "@s/b", "2.0.0", "exact")]),
    "pnpm-lock.yaml": ("lockfileVersion: 9\n\npackages:\n\n  a@1.0.0:\n    resolution: {}\n  '@s/b@2.0.0(c@1)':\n    resolution: {}\n", [("npm", "a", "1.0.0", "exact"), ("npm", "@s/b", "2.0.0", "exact")]),
    "pnpm-workspace.yaml": ("packages:\n  - x\ncatalog:\n  react: ^18.0.0\n", [("npm", "react", "^18.0.0", "range")]),
    "requirements.txt": ("# c\n-r x\na==1.0\nb[x]>=2,<3\nc\n", [("PyPI", "a", "==1.0", "exact"), ("PyPI", "b", ">=2,<3", "range"), ("PyPI", "c", None, "none")]),
    "pyproject.toml": ('[build-system]\nrequires = ["hatch"]\n[project]\ndependencies = ["a>=1"]\n[tool.poetry.dependencies]\npython = "^3"\nb = {version = "1.2"}\n', [("PyPI", "a", ">=1", "range"), ("PyPI", "hatch", None, "none"), ("PyPI", "b", "1.2", "exact")]),
    "poetry.lock": ('[[package]]\nname = "a"\nversion = "1.0"\n', [("PyPI", "a", "1.0", "exact")]),
    "uv.lock": ('[[package]]\nname = "a"\nversion = "1.0"\n', [("PyPI", "a", "1.0", "exact")]),
    "Pipfile.lock": ('{"default": {"a": {"version": "==1.0"}}, "develop": {}}', [("PyPI", "a", "1.0", "exact")]),
    "Pipfile": ('[packages]\na = "*"\n', [("PyPI", "a", "*", "any")]),
    "Cargo.toml": ('[dependencies]\na = "1"\nb = {version = "2", package = "c"}\n[target.x.dev-dependencies]\nd = "3.0.0"\n', [("crates.io", "a", "1", "exact"), ("crates.io", "c", "2", "exact"), ("crates.io", "d", "3.0.0", "exact")]),
    "Cargo.lock": ('[[package]]\nname = "a"\nversion = "1.0.0"\n', [("crates.io", "a", "1.0.0", "exact")]),
    "go.mod": ("module m\nrequire (\n\ta.b/c v1.0.0 // indirect\n)\nrequire d.e/f v2.0.0\n", [("Go", "a.b/c", "v1.0.0", "exact"), ("Go", "d.e/f", "v2.0.0", "exact")]),
    "go.sum": ("a.b/c v1.0.0 h1:x\na.b/c v1.0.0/go.mod h1:y\n", [("Go", "a.b/c", "v1.0.0", "exact")]),
    "Gemfile": ("gem 'a', '~> 1.0'\ngem \"b\"\n", [("RubyGems", "a", "~> 1.0", "range"), ("RubyGems", "b", None, "none")]),
    "Gemfile.lock": ("GEM\n  specs:\n    a (1.0)\n      b (>= 1)\n", [("RubyGems", "a", "1.0", "exact")]),
    "composer.json": ('{"require": {"php": ">=8", "v/a": "^1"}}', [("Packagist", "v/a", "^1", "range")]),
    "composer.lock": ('{"packages": [{"name": "v/a", "version": "1.0"}]}', [("Packagist", "v/a", "1.0", "exact")]),
    "pom.xml": ('<project xmlns="http://maven"><properties><v>1.0</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>', [("Maven", "g:a", "1.0", "exact")]),
    "build.gradle": ("implementation 'g:a:1.0'\napi(\"g:b:${v}\")\n", [("Maven", "g:a", "1.0", "exact"), ("Maven", "g:b", "${v}", "range")]),
    "gradle.lockfile": ("# c\ng:a:1.0=compileClasspath\nempty=\n", [("Maven", "g:a", "1.0", "exact")]),
    "libs.versions.toml": ('[versions]\nx = "1.0"\n[libraries]\na = {module = "g:a", version.ref = "x"}\nb = "g:b:2.0"\n', [("Maven", "g:a", "1.0", "exact"), ("Maven", "g:b", "2.0", "exact")]),
    "packages.lock.json": ('{"dependencies": {"net8": {"A": {"resolved": "1.0"}}}}', [("NuGet", "A", "1.0", "exact")]),
    "x.csproj": ('<Project><ItemGroup><PackageReference Include="A" Version="1.0"/></ItemGroup></Project>', [("NuGet", "A", "1.0", "exact")]),
    "x.sln": ('Project("{F}") = "P", "src\\P\\P.csproj", "{G}"\n', [("project", "P", "src/P/P.csproj", "range")]),
    "conanfile.txt": ("[requires]\nzlib/1.2.11\n", [("ConanCenter", "zlib", "1.2.11", "exact")]),
    "conan.lock": ('{"requires": ["zlib/1.2.11#abc%1"]}', [("ConanCenter", "zlib", "1.2.11", "exact")]),
    "vcpkg.json": ('{"dependencies": ["a", {"name": "b", "version>=": "1.0"}]}', [("vcpkg", "a", None, "none"), ("vcpkg", "b", "1.0", "exact")]),
    "CMakeLists.txt": ("FetchContent_Declare(a GIT_REPOSITORY u GIT_TAG v1.0)\n", [("cmake", "a", "v1.0", "exact")]),
    ".gitmodules": ('[submodule "a"]\n\tpath = a\n\turl = https://h/a\n', [("git", "https://h/a", None, "none")]),
    "docker-compose.yml": ("services:\n  a:\n    image: nginx:1.0\n", [("docker", "nginx", "1.0", "exact")]),
    "k8s/x.yaml": ("    - image: h:5000/a@sha256:ab\n", [("docker", "h:5000/a", "sha256:ab", "range")]),
    ".gitlab-ci.yml": ("image: python:3.13\n", [("docker", "python", "3.13", "exact")]),
    ".pre-commit-config.yaml": ("repos:\n- repo: https://h/a\n  rev: v1.0\n", [("pre-commit", "https://h/a", "v1.0", "exact")]),
    "Chart.yaml": ("name: x\ndependencies:\n- name: a\n  version: ~1.0\n", [("helm", "a", "~1.0", "range")]),
    "Dockerfile": ("FROM a:1 AS b\nFROM b\nFROM scratch\nARG NODE_VERSION=20\n", [("docker", "a", "1", "exact"), ("generic", "node", "20", "exact")]),
    ".github/workflows/ci.yml": ("    - uses: actions/checkout@v4\n", [("actions", "actions/checkout", "v4", "exact")]),
}


@pytest.mark.parametrize("file", MANIFESTS)
def test_manifest_formats(file):
    content, want = MANIFESTS[file]
    assert [r[1:5] for r in manifests.parse(file, content)] == want


def test_manifest_table_function(spark):
    df = spark.createDataFrame([*[(f, t) for f, (t, _) in MANIFESTS.items()], ("package.json", "{bad"), ("pom.xml", "<x"), ("unknown.txt", "x"), (None, "x"), ("go.mod", None)], "file string, text string")
    assert manifests.dependencies(df).count() == sum(len(w) for _, w in MANIFESTS.values())
    assert manifests.dependencies(df.limit(0)).count() == 0


def test_bill_of_materials(spark):
    c = spark.createDataFrame([("t", "a", "1", "pkg:npm/a@1"), ("t", "a", "1", "pkg:npm/a@1"), ("t", "b", None, "pkg:npm/b")], "t string, name string, version string, purl string")
    doc = json.loads(sinks.cyclonedx(c, "t").first().document)
    assert [x["name"] for x in doc["components"]] == ["a", "b"] and doc["bomFormat"] == "CycloneDX"
    doc = json.loads(sinks.spdx(c, "t").first().document)
    assert len(doc["packages"]) == len(doc["relationships"]) == 2
    rec = spark.range(1).select(sinks.osv(F.lit("I"), F.lit("2025"), F.array(F.lit("C")), F.struct(F.lit("npm").alias("ecosystem"), F.lit("a").alias("name")), F.lit(None).cast("string"), F.lit("2"))).first()[0]
    assert json.loads(rec)["affected"][0]["ranges"][0]["events"] == [{"introduced": "0"}, {"fixed": "2"}]


def test_appends_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert [sinks.append_new(df, str(tmp_path / "t"), "k") for _ in range(2)] == [2, 0]
    assert "| k | v |" in sinks.markdown(df.orderBy("v")) and sinks.markdown(df.limit(0)).count("\n") == 1


def test_streams_match_batches(spark, tmp_path):
    lines = [{"event_id": k, "ts": f"2024-01-01T{k // 60:02d}:{k % 60:02d}:00Z", "user_id": k % 3, "event_type": "signup" if k in (0, 1, 2, 90) else "click", "value": float(k % 10), "props": ""} for k in range(120)]
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        part = lines[n * 40 : n * 40 + 40] + (lines[:5] if n == 1 else [])
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    stream = events.read_events(spark, str(src), files_per_batch=1)
    events.append_log(events.once_each(stream), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    log = spark.read.schema(events.EVENT).json(str(tmp_path / "log"))
    assert log.count() == 120
    q = events.running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.schema(events.EVENT).json(str(src))
    want = rows_of(batch.groupBy("event_type").agg(F.count("*"), F.count_if(F.col("value") >= 5), F.sum("value")))
    assert rows_of(spark.table("totals")) == want
    p = events.plateau_stream(stream, 3600).writeStream.format("memory").queryName("plateau").outputMode("append").trigger(availableNow=True).start()
    p.awaitTermination()
    assert sorted(r.user_id for r in spark.table("plateau").collect()) == [0, 1, 2]
    for _ in range(2):
        events.upsert_counts(stream, str(tmp_path / "u"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "u")).agg(F.sum("n")).first()[0] == 125


def test_archives_are_read_whole(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(10_050):
            z.writestr(f"d/{k}.json", str(k))
        z.writestr("other.txt", "x")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, body in (("one.json", b"1"), ("big.json", b"2" * 5000)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    rows = readers.archive_members(spark, str(tmp_path), ".json", max_bytes=4000).collect()
    by = {(r.archive.rsplit("/", 1)[1], r.member): (r.bytes, r.text) for r in rows}
    assert len(rows) == 10_053 and by["a.zip", "d/10049.json"] == (5, "10049") and by["b.tar.gz", "one.json"] == (1, "1")
    assert by["b.tar.gz", "big.json"] == (5000, None) and by["c.zip", None] == (None, None)
    assert readers.zip_members(spark, str(tmp_path), ".json").count() == 10_052


def test_sqlite_tables(spark, tmp_path):
    import sqlite3

    for n in range(2):
        con = sqlite3.connect(tmp_path / f"{n}.db")
        con.execute("CREATE TABLE fixes (cve_id TEXT, hash TEXT, n INTEGER)" if n == 0 else "CREATE TABLE fixes (cve_id TEXT, extra TEXT)")
        con.executemany("INSERT INTO fixes VALUES (?, ?, ?)" if n == 0 else "INSERT INTO fixes VALUES (?, ?)", [("CVE-1", "a", 1), ("CVE-2", None, None)] if n == 0 else [("CVE-3", "x")])
        con.commit()
        con.close()
    (tmp_path / "x.db").write_bytes(b"nothing")
    got = readers.sqlite_table(spark, str(tmp_path / "*.db"), "fixes", "cve_id string, hash string, n long")
    assert sorted((r.cve_id, r.hash, r.n) for r in got.collect()) == [("CVE-1", "a", 1), ("CVE-2", None, None), ("CVE-3", None, None)]
    assert readers.sqlite_table(spark, str(tmp_path / "*.db"), "absent", "a string").count() == 0


def test_plateaus_in_any_order(spark, tmp_path):
    """The same spells are told whatever order the files come in, once each, also of users who fall silent."""
    import itertools
    import os

    lines = [{"event_id": k, "ts": f"2024-01-01T{k // 60:02d}:{k % 60:02d}:00Z", "user_id": k % 3, "event_type": "signup" if k in (0, 1, 2, 90) else "click", "value": 1.0, "props": ""} for k in range(120)]
    for no, order in enumerate(itertools.permutations(range(3))):
        src = tmp_path / f"in{no}"
        src.mkdir()
        for place, n in enumerate(order):
            part = lines[n * 40 : n * 40 + 40] + (lines[:5] if n == 1 else [])
            (src / f"{place}.json").write_text("\n".join(map(json.dumps, part)))
            os.utime(src / f"{place}.json", (1_700_000_000 + place * 10,) * 2)
        q = events.plateau_stream(events.read_events(spark, str(src), files_per_batch=1), 3600).writeStream.format("memory").queryName(f"any{no}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = sorted((r.user_id, r.at.minute + 60 * r.at.hour) for r in spark.table(f"any{no}").collect())
        assert rows == [(0, 60), (1, 61), (2, 62)], (order, rows)
    src = tmp_path / "silent"
    src.mkdir()
    for n, (user, hour) in enumerate([(1, 0), (2, 9), (2, 10)]):
        (src / f"{n}.json").write_text(json.dumps({"event_id": n, "ts": f"2024-01-01T{hour:02d}:00:00Z", "user_id": user, "event_type": "signup", "value": 1.0, "props": ""}))
        os.utime(src / f"{n}.json", (1_700_000_000 + n * 10,) * 2)
    q = events.plateau_stream(events.read_events(spark, str(src), files_per_batch=1), 3600, late="1 minute").writeStream.format("memory").queryName("silent").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.at.hour) for r in spark.table("silent").collect()) == [(1, 1), (2, 10)]
