"""Imports, detectors and the query gate."""

import pytest
from pyspark.sql import functions as F

from findlake.functions import detectors
from findlake.session import validate_query
from findlake.sources import imports

FILES = [
    ("a/m.py", "import os, re\nfrom yaml_x import load\n  import requests.sessions\n# import no\n"), ("b.ts", "import x from '@s/pkg/deep'\nconst y = require(\"left-pad\")\nimport('lazy')\n"),
    ("c.go", 'import (\n\t"fmt"\n\tz "github.com/a/b/c"\n)\n'), ("D.java", "import static org.apache.x.Y;\nimport java.util.List;\n"), ("e.rb", "require 'nokogiri'\n"), ("f.php", "use Vendor\\Pkg\\Thing;\n"),
    ("g.rs", "use serde_json::Value;\nextern crate rand;\n"), ("h.cs", "using Newtonsoft.Json;\n"), ("x.txt", "import nothing\n"), (None, "x"), ("n.py", None),
]


def test_imports_and_reachability(spark):
    df = spark.createDataFrame(FILES, "file string, text string")
    rows = imports.import_rows(df)
    got = {(r.ecosystem, r.name) for r in rows.collect()}
    assert {("PyPI", "yaml_x"), ("PyPI", "requests"), ("npm", "@s/pkg"), ("npm", "left-pad"), ("npm", "lazy"), ("Go", "github.com/a/b/c"), ("RubyGems", "nokogiri"), ("crates.io", "serde_json"), ("crates.io", "rand"), ("NuGet", "Newtonsoft.Json")} <= got
    assert ("PyPI", "no") not in got and not any(n == "nothing" for _, n in got)
    deps = spark.createDataFrame([("PyPI", "yaml-x"), ("PyPI", "flask"), ("npm", "@s/pkg"), ("Go", "github.com/a/b"), ("NuGet", "Newtonsoft.Json"), ("Maven", "org.apache.x:lib"), ("Hex", "q")], "ecosystem string, name string")
    reach = {(r.ecosystem, r.name): r.reach for r in imports.reachability(deps, rows).collect()}
    assert reach == {("PyPI", "yaml-x"): "imported", ("PyPI", "flask"): "not_imported", ("npm", "@s/pkg"): "imported", ("Go", "github.com/a/b"): "imported", ("NuGet", "Newtonsoft.Json"): "imported", ("Maven", "org.apache.x:lib"): "imported", ("Hex", "q"): "unknown"}
    calls = spark.createDataFrame([("yaml.load(x); yaml.load (y); f(z)",)], "t string").select(imports.called_functions(F.col("t"))).first()[0]
    assert calls == ["yaml.load"]


def test_detectors(spark):
    rows = [
        ("package.json", '{"scripts": {"postinstall": "node x"}, "dependencies": {"a": "github:x/y"}}', ["install_hook", "git_dependency"]), ("src/package.json", '{"scripts": {"test": "x"}}', []),
        ("build.rs", "Command::new(\"sh\")", ["build_script"]), ("pkg/__init__.py", "x = 1\nexec(y)", ["import_time_execution"]), ("run.sh", "curl -s u | sh", ["piped_download"]),
        (".github/workflows/a.yml", "uses: a/b@main", ["mutable_action"]), (".github/workflows/b.yml", "uses: a/b@v1", []), (None, None, []),
    ]
    df = spark.createDataFrame([(f, t, k) for k, (f, t, _) in enumerate(rows)], "file string, text string, k int")
    got = [r.d for r in df.orderBy("k").select(detectors.detected(F.col("file"), F.col("text")).alias("d")).collect()]
    assert got == [w for _, _, w in rows]
    deps = spark.createDataFrame([("npm", "a", "1.0"), ("npm", "b", "4.2")], "ecosystem string, name string, version string")
    latest = spark.createDataFrame([("npm", "a", "3.0"), ("npm", "b", "5.0")], "ecosystem string, name string, version string")
    assert [(r.name, r.behind) for r in detectors.majors_behind(deps, latest).collect()] == [("a", 2)]
    assert detectors.yanked(deps, deps.limit(1)).count() == 1
    refs = spark.createDataFrame([("x", "v1", "a"), ("y", "v1", "a")], "name string, ref string, sha string")
    assert [r.name for r in detectors.moved_refs(refs, refs.withColumn("sha", F.when(F.col("name") == "x", "b").otherwise("a"))).collect()] == ["x"]


def test_query_gate(spark):
    for good in ("SELECT 1", "with a as (select 1 x) select * from a", "SELECT 'drop table t' -- ; x", "select a from t where b > 1 order by a limit 3", "select 1 union select 2"):
        assert validate_query(spark, good) == good
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "CREATE TABLE t AS SELECT 1", "SET a = b", "", "SELEC 1"):
        with pytest.raises(ValueError):
            validate_query(spark, bad)
